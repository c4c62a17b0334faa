"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints: one pass over the texts; the result (doc_id, 64 bits) is
   staged and collapsed to distinct fingerprints, so any number of copies is
   one row from here on.
2. Bits that correlate over all distinct fingerprints are grouped into m
   partitions.  If two fingerprints differ in at most tau bits and the
   partitions have thresholds t_i (-1: partition unused) with
   sum t_i = tau - m + 1, then in at least one partition they differ in at
   most t_i bits.  Thresholds come from dynamic programming on estimated
   costs (rows to probe and candidate pairs to verify), m from the best of
   all programmes.  The estimates decide the speed only.
3. Every fingerprint is filed under its own value in each partition and
   probes the values within t_i (of a pair only the side with the smaller
   value probes).  Members of one value are compared in numpy on the
   whole 64 bits.  A value with more than ``TILE`` rows is cut into tiles, so
   no task holds a large group, and a tile reports at most a spanning
   forest of its links, never all pairs.
4. Components of the links over staged tables, joined back by fingerprint.

Null or empty text has no shingles: fingerprint zero, linked like any other.
Fewer words than the shingle length: the whole sequence is the one shingle.
A null ``doc_id`` is kept; its component is the smallest non-null id
reachable, or null if there is none.  Repeated rows each get their row.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trueline.llm.common import stage
from trueline.llm.components import connected_components

WORDS, DISTANCE, SEED = 4, 4, 42
#: Most rows of one value that are compared at once.
TILE = 1024
#: Fingerprints (about) whose random pairs are looked at for the estimates, and
#: the cost of verifying a candidate pair relative to moving a probe row.
PAIR_SAMPLE, PAIR_COST = 16_384, 0.02
#: Shingles unpacked to bits at once.
CHUNK = 65_536


def shingle_digests(text: str, words: int) -> list[bytes]:
    """XXH64 digests (big-endian) of all word shingles; bytes.split() splits
    at exactly [\\x20\\x09-\\x0D] and bytes.lower() changes A-Z only."""
    tokens = text.encode().lower().split()
    if not tokens:
        return []
    if len(tokens) <= words:
        return [xxhash.xxh64_digest(b" ".join(tokens), SEED)]
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    return [digest(joined[a:b], SEED)
            for a, b in zip(starts[:len(tokens) - words + 1].tolist(), ends[words - 1:].tolist())]


def fingerprints_of(texts: list[str], words: int) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set if set in over half the hashes."""
    total = np.zeros((len(texts), 64), dtype=np.int64)
    size = np.zeros(len(texts), dtype=np.int64)
    pending: list[bytes] = []
    owner: list[tuple[int, int]] = []

    def flush() -> None:
        if pending:
            bits = np.unpackbits(np.frombuffer(b"".join(pending), dtype=np.uint8)).reshape(-1, 64)
            at = np.cumsum([0] + [n for _, n in owner[:-1]])
            np.add.at(total, [i for i, _ in owner], np.add.reduceat(bits, at, axis=0, dtype=np.int64))
            pending.clear()
            owner.clear()

    for i, text in enumerate(texts):
        digests = shingle_digests(text, words)
        size[i] = len(digests)
        for lo in range(0, len(digests), CHUNK):
            part = digests[lo:lo + CHUNK]
            pending += part
            owner.append((i, len(part)))
            if len(pending) >= CHUNK:
                flush()
    flush()
    return np.packbits(2 * total > size[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the ``carry`` columns of every row."""
    schema = StructType([*StructType.fromDDL("doc_id long, fp long"), *(docs.schema[c] for c in carry)])

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = [fingerprints_of(texts[k:k + 256], words) for k in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(fps or [np.empty(0, np.int64)])),
                                              *b.columns[2:]], schema.names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                         *carry)
    return source.mapInArrow(run, schema)


# --- the plan of partitions and thresholds ----------------------------------

def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, 64 x 64 co-occurrence counts, sample of XORs of random pairs).
    All rows count; what reaches the driver is 4,160 sums and a bounded
    sample of pairs."""
    def run(batches):
        sums = np.zeros((64, 64))
        n = 0
        for b in batches:
            raw = b.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            sums += bits.T @ bits
            n += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array([[float(n), *sums.ravel()]], pa.list_(pa.float64()))], ["s"])

    partial = fps.select("fp").mapInArrow(run, "s array<double>").select(
        array_to_vector("s").alias("s"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("g"))
    half = partial.groupBy("g").agg(Summarizer.sum(F.col("s")).alias("s"))
    vec = half.agg(Summarizer.sum(F.col("s")).alias("s")).first()["s"].toArray()
    n = int(vec[0])
    mixed = F.xxhash64("fp")
    some = np.array([r["fp"] for r in fps.where(F.pmod(mixed, F.lit(max(1, n // PAIR_SAMPLE))) == 0)
                     .select("fp", mixed.alias("at")).sort("at").select("fp").collect()], dtype=np.int64)
    return n, vec[1:].reshape(64, 64), some ^ np.roll(some, 1)


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits, each grown from a seed by its strongest correlations."""
    p = np.diag(together) / n
    cov = together / n - np.outer(p, p)
    dev = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        pool = sorted(free)
        group = [max(pool, key=lambda b: corr[b, pool].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def close_share(group: list[int], p: np.ndarray, xors: np.ndarray, limit: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most t = 0..limit bits of
    the group: the larger of the random pairs' share and that of independent
    bits."""
    dist = np.array([1.0])
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        dist = np.convolve(dist, [1 - q, q])
    mask = mask_of(group)
    seen = np.bitwise_count((xors & mask).view(np.uint64)) if len(xors) else np.empty(0)
    return np.array([max(dist[:t + 1].sum(), (seen <= t).mean() if len(seen) else 0.0) for t in range(limit + 1)])


def mask_of(group: list[int]) -> np.int64:
    """Bit b of a group is the b-th from the left."""
    return np.array([sum(1 << (63 - b) for b in group)], dtype=np.uint64).view(np.int64)[0]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``total`` and the least cost; costs[i][t + 1]."""
    best = {0: (0.0, [])}
    for k, row in enumerate(costs):
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(row) - 1):
                if s + t not in after or c + row[t + 1] < after[s + t][0]:
                    after[s + t] = (c + row[t + 1], [*ts, t])
        best = after
    return best[total]


def plan(fps: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use."""
    n, together, xors = bit_statistics(fps)
    if n < 2:
        return []
    p = np.diag(together) / n
    choices = []
    for m in range(1, tau + 2):
        groups = group_bits(together, n, m)
        costs = []
        for g in groups:
            share = close_share(g, p, xors, tau)
            ball = np.cumsum([comb(len(g), t) for t in range(tau + 1)])
            costs.append([0.0, *(n * (1 + (ball - 1) / 2) + PAIR_COST * n * n * share / 2)])
        cost, ts = allocate(costs, tau - m + 1)
        choices.append((cost, m, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(choices)[2]


# --- probing and verifying --------------------------------------------------

def filed(fps: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, home, fp): every fingerprint at home in each partition,
    and as a probe at the larger values within the threshold."""
    flips = []
    for g, t in partitions:
        one = [mask_of([b]) for b in g]
        flips.append((mask_of(g), [np.bitwise_xor.reduce(c) for r in range(1, t + 1) for c in combinations(one, r)]))

    def batch_of(k: int, value: np.ndarray, fp: np.ndarray, home: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(fp), k, dtype=np.int32)), pa.array(value),
             pa.array(np.full(len(fp), home)), pa.array(fp)], ["part", "value", "home", "fp"])

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, (mask, masks) in enumerate(flips):
                own = fp & mask
                yield batch_of(k, own, fp, True)
                for f in masks:
                    near = own ^ f
                    up = near.view(np.uint64) > own.view(np.uint64)
                    yield batch_of(k, near[up], fp[up], False)

    return fps.select("fp").mapInArrow(run, "part int, value long, home boolean, fp long")


def tiles(rows: DataFrame) -> DataFrame:
    """Add (i, j): a value's rows in tiles of about TILE x TILE.  Home rows of
    block i meet all rows of block j."""
    sizes = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    large = stage(sizes.where(F.col("n") > TILE).select(
        "part", "value", F.ceil(F.col("n") / TILE).cast("int").alias("k")), "large-values")
    block = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    spread = rows.join(large, ["part", "value"], "left").select(
        "part", "value", "home", "fp", F.coalesce("k", F.lit(1)).alias("k")).withColumn("own", block)
    to = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    inner = spread.withColumn("other", to)
    as_home = inner.where("home").select("part", "value", F.col("own").alias("i"), F.col("other").alias("j"),
                                         F.lit(True).alias("home"), "fp")
    as_any = inner.where("not home or k > 1").select("part", "value", F.col("other").alias("i"),
                                                     F.col("own").alias("j"), F.lit(False).alias("home"), "fp")
    return as_home.union(as_any)


def tile_links(home: np.ndarray, rest: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between the home rows and all rows of a tile; a spanning
    forest of them if there are many."""
    every = np.unique(np.concatenate([home, rest]))
    home = np.unique(home)
    near = np.bitwise_count((home[:, None] ^ every[None, :]).view(np.uint64)) <= tau
    near &= home[:, None] != every[None, :]
    a, b = np.nonzero(near)
    if len(a) <= 2 * len(every):
        return home[a], every[b]
    at = np.searchsorted(every, home)
    label = np.arange(len(every))
    while True:
        low = np.minimum(label[at], np.where(near, label[None, :], len(every)).min(axis=1))
        new = label.copy()
        new[at] = np.minimum(new[at], low)
        np.minimum(new, np.where(near, new[at][:, None], len(every)).min(axis=0), out=new)
        if (new == label).all():
            break
        label = new
    odd = label != np.arange(len(every))
    return every[odd], every[label[odd]]


def links(fps: DataFrame, partitions: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """(a, b): links between distinct fingerprints, complete up to connectivity."""
    keys = ["part", "value", "i", "j"]
    rows = tiles(filed(fps, partitions)).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held: pd.DataFrame | None = None

        def solve(df: pd.DataFrame) -> pa.RecordBatch:
            edge = (df[keys].ne(df[keys].shift())).any(axis=1).to_numpy()
            cuts = [*np.flatnonzero(edge).tolist(), len(df)]
            fp, home = df["fp"].to_numpy(), df["home"].to_numpy()
            found = [tile_links(fp[x:y][home[x:y]], fp[x:y][~home[x:y]], tau)
                     for x, y in zip(cuts, cuts[1:]) if y - x > 1]
            a = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
            b = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            df = batch.to_pandas()
            if held is not None:
                df = pd.concat([held, df], ignore_index=True)
            last = (df[keys] == df[keys].iloc[-1]).all(axis=1) if len(df) else None
            if last is None or last.all():
                held = df
                continue
            yield solve(df[~last])
            held = df[last].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id among all documents
    reachable over fingerprints that differ in at most ``distance`` bits.
    With ``carry``, also root, a fingerprint that names the component whatever
    its ids are, and the ``carry`` columns."""
    rows = stage(fingerprints(docs, words, carry), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    partitions = plan(fps, distance)
    root = ["root"] if carry else []
    if not partitions:
        return rows.join(fps, "fp").withColumn("root", F.col("fp")).select(
            "doc_id", "fp", F.col("first").alias("component_id"), *root, *carry)
    found = connected_components(links(fps, partitions, distance))
    rooted = fps.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    low = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = stage(rooted.join(low, "root").select("fp", "component_id", *root), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", *root, *carry)


def keep_one(docs: DataFrame, columns: tuple[str, ...], words: int = 4, distance: int = 4) -> DataFrame:
    """The ``columns`` (doc_id and text among them) of one document of each
    component: the smallest doc_id, a row without an id only if no row of the
    component has one; of several rows with that id the one with the smallest
    hash.  Repeated rows are one document and stay rows."""
    values = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    docs = docs.select(*columns, F.xxhash64(*values).alias("__a"), F.xxhash64(F.lit(1), *values).alias("__b"))
    groups = near_duplicates(docs, words=words, distance=distance, carry=("__a", "__b"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__a", "__b"))
    stay = groups.groupBy("root").agg(first.alias("first")).select("first.__a", "first.__b")
    return docs.join(stay, ["__a", "__b"], "left_semi").select(*columns)
