"""Exact top-k inner products by a Voronoi join.

Vectors become integers floor(scale * x).  Pivots (a bounded choice by hash
of the ids) cut the space into Voronoi cells.  Two summaries per cell, the
number of rows and the largest distance to the pivot, give for a group of
queries (pivot p, radius a) and a data cell (pivot c, radius r)

    |q.v - p.c| <= |p| r + a |c| + a r

so the cells with the best lower bounds that together hold k + 1 rows bound
the k-th score of every query of the group from below, and a cell whose
upper bound is smaller cannot hold an answer.  Only rows of the other cells
are sent to the group.  Groups and cells are cut (or pooled) to tiles of at
most about ``DATA_TILE`` rows and ``QUERY_TILE`` queries, whatever the size
of a cell; a tile returns the k best of each query, and the k best of those
are the answer.  On the driver there are only tables over pivots.

Vectors that are null or hold null or non-finite components, and rows with a
null id, take no part; nor do integer vectors whose product with themselves
does not fit a long (2^63), as no score of theirs need fit one.  Shorter vectors count as padded with zeros.  Of
several rows with one id the smallest vector counts.  Inner products are
exact integers: in double arithmetic while they stay below 2^53, else in
Python integers.  Ties go to the smaller id.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trueline.llm.common import stage

#: Pivots (about; chosen by hash of the id).
MAX_PIVOTS = 512
DATA_TILE, QUERY_TILE = 8192, 2048
EXACT = 2.0 ** 53
#: Squared length from which a vector's scores may not fit a long.
LONGEST = 2.0 ** 63 * (1 - 2.0 ** -40)


def integer_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v: array of doubles with integer values)."""
    ok = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    raw = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    whole = raw.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select(
        "vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    # |a . b| <= |a| |b|, so products of shorter vectors fit a long
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = whole.where(length < LONGEST)
    return whole.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of the list array, padded with zeros to ``width``."""
    n = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance to its pivot, rounded up)."""
    d = (m * m).sum(axis=1)[:, None] - 2 * m @ pivots.T + (pivots * pivots).sum(axis=1)[None, :]
    cell = d.argmin(axis=1)
    far = np.sqrt(((m - pivots[cell]) ** 2).sum(axis=1))
    return cell, far * (1 + 1e-9)


def assign(vectors: DataFrame, pivots: np.ndarray, is_query: Column) -> DataFrame:
    """(vec_id, v, query, cell, far)."""
    width = pivots.shape[1]

    def run(batches):
        for b in batches:
            cell, far = nearest(matrix(b.column(1), width), pivots)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)],
                                             ["vec_id", "v", "query", "cell", "far"])

    return vectors.select("vec_id", "v", is_query.alias("query")).mapInArrow(
        run, "vec_id long, v array<double>, query boolean, cell int, far double")


def pool(counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each cell, parts of each group): neighbouring small cells
    share a group of about ``limit`` rows, a larger cell has its own group in
    several parts."""
    group = np.full(len(counts), -1)
    parts: list[int] = []
    held = limit + 1
    for c in np.flatnonzero(counts):
        if counts[c] >= limit:
            parts.append(-(-int(counts[c]) // limit))
            group[c] = len(parts) - 1
        else:
            if held + counts[c] > limit:
                parts.append(1)
                pooled, held = len(parts) - 1, 0
            group[c] = pooled
            held += counts[c]
    return group, np.array(parts or [0])


def needed_cells(pivots: np.ndarray, count: np.ndarray, radius: np.ndarray,
                 q_radius: np.ndarray, k: int) -> np.ndarray:
    """need[q, d]: may data cell d hold one of the k best of a query in cell q
    (q_radius < 0: no queries there)."""
    norm = np.sqrt((pivots * pivots).sum(axis=1)) * (1 + 1e-9)
    centre = pivots @ pivots.T
    a = np.maximum(q_radius, 0)[:, None]
    slack = norm[:, None] * radius[None, :] + a * norm[None, :] + a * radius[None, :]
    slack = slack * (1 + 1e-9) + 1e-6
    need = np.zeros(centre.shape, dtype=bool)
    held = count > 0
    for q in np.flatnonzero(q_radius >= 0):
        low = np.where(held, centre[q] - slack[q], -np.inf)
        order = np.argsort(-low, kind="stable")
        enough = np.searchsorted(np.cumsum(count[order]), k + 1)
        floor = low[order[enough]] if enough < len(order) else -np.inf
        need[q] = held & (centre[q] + slack[q] >= floor)
    return need


def tile_best(ids: np.ndarray, data: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query among the tile's data (all, if fewer)."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    largest = max(np.abs(data).max(initial=0), np.abs(queries).max(initial=0))
    if largest * largest * max(1, data.shape[1]) >= EXACT:
        as_int = np.vectorize(int, otypes=[object])
        data, queries = as_int(data), as_int(queries)
    found: list[tuple] = []
    for lo in range(0, len(q_ids), 256):
        scores = queries[lo:lo + 256] @ data.T
        for q, s in zip(q_ids[lo:lo + 256], scores):
            own = np.searchsorted(ids, q)
            other = np.ones(len(ids), dtype=bool)
            if own < len(ids) and ids[own] == q:
                other[own] = False
            at = np.flatnonzero(other)
            s = s[at]
            if len(at) > k:
                if s.dtype == object:
                    keep = sorted(range(len(s)), key=lambda i: (-s[i], i))[:k]
                else:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    above = np.flatnonzero(s > least)
                    keep = np.concatenate([above, np.flatnonzero(s == least)[:k - len(above)]])
                at, s = at[keep], s[keep]
            found.append((np.full(len(at), q), ids[at], s))
    return pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]),
                         "vec_id": np.concatenate([f[1] for f in found]),
                         "score": np.array([int(x) for f in found for x in f[2]], dtype=np.int64)})


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k best of each query row
    among all rows but its own.  ``is_query`` is a condition on ``vec_id``."""
    vectors = stage(integer_vectors(rows, scale), "vectors")
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = shape["n"], shape["width"] or 0
    empty = "query_id long, rank int, vec_id long, score long"
    if not n:
        return rows.sparkSession.createDataFrame([], empty)
    step = -(-n // min(MAX_PIVOTS, 1 + math.isqrt(n)))
    some = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).select("v").collect()
    pivots = np.unique(np.array([r["v"] + [0.0] * (width - len(r["v"])) for r in some] or [[0.0] * width]), axis=0)
    cells = stage(assign(vectors, pivots, is_query), "cells")
    count, radius, q_count, q_radius = (np.zeros(len(pivots)) for _ in range(4))
    q_radius -= 1
    for r in cells.groupBy("cell", "query").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect():
        count[r["cell"]] += r["n"]
        radius[r["cell"]] = max(radius[r["cell"]], r["r"])
        if r["query"]:
            q_count[r["cell"]], q_radius[r["cell"]] = r["n"], r["r"]
    need = needed_cells(pivots, count, radius, q_radius, k)
    d_group, d_parts = pool(count, DATA_TILE)
    q_group, q_parts = pool(q_count, QUERY_TILE)
    # Which query groups a data cell goes to, and which data groups a query group meets.
    wants = np.zeros((len(q_parts), len(pivots)), dtype=bool)
    for c in np.flatnonzero(q_group >= 0):
        wants[q_group[c]] |= need[c]
    meets = [np.unique(d_group[np.flatnonzero(w)]) for w in wants]

    def spread(batches):
        for b in batches:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            cell = b.column("cell").to_numpy(zero_copy_only=False)
            asks = b.column("query").to_numpy(zero_copy_only=False)
            mixed = pd.util.hash_array(ids)
            out = []
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                mine = mixed[at] % np.uint64(d_parts[d_group[c]])
                for g in np.flatnonzero(wants[:, c]):
                    out += [(at, g, p, d_group[c], mine, False) for p in range(q_parts[g])]
                at = at[asks[at]]
                if len(at):
                    g = q_group[c]
                    mine = mixed[at] % np.uint64(q_parts[g])
                    out += [(at, g, mine, d, p, True) for d in meets[g] for p in range(d_parts[d])]
            for at, qg, qp, dg, dp, asks_now in out:
                full = lambda x: pa.array(np.broadcast_to(np.asarray(x, dtype=np.int64), len(at)).astype(np.int32))  # noqa: B023, E731
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [full(qg), full(qp), full(dg), full(dp), pa.array(np.full(len(at), asks_now)),
                     b.column("vec_id").take(where), b.column("v").take(where)],
                    ["qg", "qp", "dg", "dp", "asks", "vec_id", "v"])

    def solve(tile: pa.Table) -> pa.Table:
        asks = tile.column("asks").combine_chunks()
        m = matrix(tile.column("v").combine_chunks(), width)
        ids = tile.column("vec_id").to_numpy()
        asks = asks.to_numpy(zero_copy_only=False)
        if asks.all() or not asks.any():
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        best = tile_best(ids[~asks], m[~asks], ids[asks], m[asks], k)
        return pa.Table.from_pandas(best, preserve_index=False)

    tiles = cells.select("vec_id", "v", "query", "cell").mapInArrow(
        spread, "qg int, qp int, dg int, dp int, asks boolean, vec_id long, v array<double>")
    best = tiles.groupBy("qg", "qp", "dg", "dp").applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
