"""Regression trees grown level by level, all fits together.

A fit is one training set (the hold-out fit, or all rows outside one fold); a
job grows the trees of all fits from shared scans, so six fits read the table
as often as one.  The training table is staged once as blocks of at most
``BLOCK_ROWS`` rows (features, bin codes, target, fold, hash).

Per level every open node needs sums per side of its candidate cuts:

* ``best`` (forest, boosting): features are cut at ``max_bins`` quantiles, or
  between all values if there are no more; tasks sum rows, weights and targets
  per (tree, node, feature, bin) and the cut with the least squared error wins;
* ``random`` (extra trees): each node draws one cut per feature between the
  node's own least and largest value, by a hash of (seed, fit, tree, node,
  feature); tasks first find the ranges, then sum the rows left of the cuts.

Sums meet in one aggregation per level; the splits are chosen from them on the
executors and only the chosen splits reach the driver, which holds the node
tables.  A table of one block needs no meeting: the task that has it grows its
share of the trees through all levels by the same functions.  Draws depend on
hashes alone, so trees do not depend on the number of blocks.

Bootstrap weights are Poisson(1) by a hash of (row, fit, tree).  Boosting
starts from the mean and shrinks every tree; margins are kept in the blocks and
staged again every ``STAGED_ROUNDS`` rounds.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 65_536
STAGED_ROUNDS = 10
#: Nodes of a tree whose sums one task receives.
NODE_GROUP = 256
#: Nodes that the driver holds for one model.
NODE_LIMIT = 50_000_000
HOLDOUT = -1
_MASK = np.uint64(0xFFFFFFFF)


def mix(z):
    """Hash of 32-bit values (multiplications modulo 2 ** 32)."""
    z = np.asarray(z, np.uint64) & _MASK
    for multiplier, shift in ((2246822519, 15), (3266489917, 13)):
        z = (z * np.uint64(multiplier)) & _MASK
        z = z ^ (z >> np.uint64(shift))
    return z


def draw(seed: int, *parts) -> np.ndarray:
    """Uniform draws in [0, 1) that depend on the parts only."""
    z = mix(seed + 1)
    for x in parts:
        z = mix(z + mix(np.asarray(x, np.uint64) + np.uint64(374761393)))
    return z.astype(np.float64) / 4294967296.0


#: Cumulative probabilities of Poisson(1).
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])


@dataclass(frozen=True)
class TreeParams:
    kind: str = "best"                 # or "random"
    trees: int = 100
    max_depth: int = 40
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    features: int | None = None        # candidates per node, None: all
    bootstrap: bool = False
    seed: int = 42


class Tree:
    """Node table: feature (-1: leaf), cut (left if value <= cut), children,
    value; ``key`` hashes the way to a node, so draws do not depend on numbers."""

    __slots__ = ("feature", "cut", "left", "right", "value", "depth", "open", "key")

    def __init__(self, value: float = 0.0, is_open: bool = True):
        self.feature, self.left, self.right = (np.full(1, -1, np.int32) for _ in range(3))
        self.cut, self.value = np.zeros(1), np.full(1, value)
        self.depth, self.open, self.key = np.zeros(1, np.int16), np.full(1, is_open), np.zeros(1, np.uint64)

    def __getstate__(self):
        return [getattr(self, k) for k in self.__slots__]

    def __setstate__(self, state):
        for k, v in zip(self.__slots__, state):
            setattr(self, k, v)

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The node each row of ``x`` stands in."""
        at = np.zeros(len(x), np.int32)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            node = at[live]
            go = x[live, self.feature[node]] <= self.cut[node]
            at[live] = np.where(go, self.left[node], self.right[node])
            live = live[self.feature[at[live]] >= 0]
        return at

    def split(self, s: dict, p: TreeParams) -> None:
        """Apply chosen splits (see :func:`_choose`) and open their children."""
        node = s["node"]
        self.value[node] = s["value"]
        self.open[node] = False
        good = s["feature"] >= 0
        node = node[good]
        if not len(node):
            return
        n, first = len(node), len(self.feature)
        self.feature[node], self.cut[node] = s["feature"][good], s["cut"][good]
        self.left[node], self.right[node] = first + np.arange(n), first + n + np.arange(n)
        depth = self.depth[node] + 1
        count = np.concatenate([s["n_left"][good], s["n_right"][good]])
        spread = np.concatenate([s["e_left"][good], s["e_right"][good]])
        depth = np.concatenate([depth, depth])
        grow = (depth < p.max_depth) & (count >= max(2, p.min_samples_split)) & spread
        add = lambda a, b: np.concatenate([a, np.asarray(b, a.dtype)])
        self.feature = add(self.feature, np.full(2 * n, -1))
        self.left, self.right = add(self.left, np.full(2 * n, -1)), add(self.right, np.full(2 * n, -1))
        self.cut = add(self.cut, np.zeros(2 * n))
        self.value = add(self.value, np.concatenate([s["v_left"][good], s["v_right"][good]]))
        self.depth, self.open = add(self.depth, depth), add(self.open, grow)
        own = self.key[node]
        self.key = add(self.key, np.concatenate([mix(own + np.uint64(1)), mix(own + np.uint64(2))]))


class Block:
    """Rows of the training table in a task."""

    def __init__(self, row: dict, cuts: list[np.ndarray] | None):
        n = row["n"]
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.x = read("x", np.float64).reshape(n, -1)
        self.y, self.fold = read("y", np.float64), read("fold", np.int32)
        self.test, self.hash = read("test", np.uint8).astype(bool), read("hash", np.uint64)
        self.margin = {int(k): np.frombuffer(v, np.float64) for k, v in dict(row.get("margins") or ()).items()}
        if cuts is not None:
            self.bins = max((len(c) for c in cuts), default=0) + 1
            self.code = np.stack([np.searchsorted(c, self.x[:, j], "left") for j, c in enumerate(cuts)], axis=1)

    def weights(self, fit: int, tree: int, p: TreeParams) -> np.ndarray:
        own = ~self.test if fit == HOLDOUT else self.fold != fit
        if not p.bootstrap:
            return own.astype(np.float64)
        times = np.searchsorted(POISSON, draw(p.seed, self.hash, fit + 2, tree), "right")
        return np.where(own, times, 0).astype(np.float64)


def _candidates(key: np.ndarray, n_features: int, fit: int, tree: int, p: TreeParams) -> np.ndarray:
    """(node, feature): which features a node may split on."""
    k = n_features if p.features is None else max(1, min(p.features, n_features))
    if k == n_features:
        return np.ones((len(key), n_features), bool)
    score = draw(p.seed + 7, fit + 2, tree, key[:, None], np.arange(n_features)[None, :])
    return score.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < k


def _choose(node, left, total, cut_of, allowed, p: TreeParams) -> dict:
    """Best split of each node.  ``left``: sums (rows, weight, target, target²)
    left of each cut, axes (4, node, feature, cut); ``total``: (4, node)."""
    n, w, s, q = left
    tn, tw, ts, tq = (t[:, None, None] for t in total)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / w + (ts - s) ** 2 / (tw - w) - ts * ts / tw
    legal = (n >= p.min_samples_leaf) & (tn - n >= p.min_samples_leaf) & (w > 0) & (tw - w > 0) & allowed[:, :, None]
    legal &= tn >= p.min_samples_split
    gain = np.where(legal, gain, -np.inf)
    flat = gain.reshape(len(node), -1)
    best = flat.argmax(axis=1)
    rows = np.arange(len(node))
    feature, cut = np.unravel_index(best, gain.shape[1:])
    # targets that differ by rounding only are not split
    uneven = lambda w, s, q: q - s * s / w > 1e-12 * np.maximum(q, 1e-300)
    good = np.isfinite(flat[rows, best]) & uneven(*total[1:])
    ln, lw, ls, lq = (a[rows, feature, cut] for a in left)
    rn, rw, rs, rq = (t - a for t, a in zip(total, (ln, lw, ls, lq)))
    with np.errstate(divide="ignore", invalid="ignore"):
        v_left, v_right = ls / lw, rs / rw
        out = {"node": node, "feature": np.where(good, feature, -1), "cut": cut_of(rows, feature, cut),
               "value": total[2] / total[1], "v_left": v_left, "v_right": v_right, "n_left": ln, "n_right": rn,
               "e_left": uneven(lw, ls, lq), "e_right": uneven(rw, rs, rq)}
    return out


def _sums(key: np.ndarray, size: int, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(key, v, size) for v in (np.ones(len(key)), w, w * y, w * y * y)])


def _open_rows(tree: Tree, block: Block, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(open nodes, rows in them, each row's place among the open nodes)."""
    node = np.flatnonzero(tree.open)
    place = np.full(len(tree.feature), -1)
    place[node] = np.arange(len(node))
    at = place[tree.walk(block.x)]
    rows = np.flatnonzero((at >= 0) & (w > 0))
    return node, rows, at[rows]


def _histogram(block: Block, rows, at, n_open: int, w, y) -> np.ndarray:
    """(4, node, feature, bin) sums."""
    n_f, b = block.code.shape[1], block.bins
    out = np.zeros((4, n_open, n_f, b))
    for j in range(n_f):
        out[:, :, j] = _sums(at * b + block.code[rows, j], n_open * b, w[rows], y[rows]).reshape(4, n_open, b)
    return out


def _best_from_histogram(node, key, h, cuts, fit, t, p) -> dict:
    total = h[:, :, 0, :].sum(axis=2)
    left = h.cumsum(axis=3)
    width = left.shape[3]                             # behind the last bin there is no cut
    table = np.full((len(cuts), width), np.nan)
    for j, c in enumerate(cuts):
        table[j, :len(c)] = c
    left[:, :, np.isnan(table)] = 0.0
    return _choose(node, left, total, lambda r, f, c: table[f, c], _candidates(key, len(cuts), fit, t, p), p)


def _node_ranges(block: Block, rows, at, n_open: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full((n_open, block.x.shape[1]), np.inf), np.full((n_open, block.x.shape[1]), -np.inf)
    by = np.argsort(at, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(at[by]) != 0])) if len(by) else by
    if len(by):
        x = block.x[rows[by]]
        low[at[by][head]], high[at[by][head]] = np.minimum.reduceat(x, head), np.maximum.reduceat(x, head)
    return low, high


def random_cuts(key, low, high, fit: int, t: int, p: TreeParams) -> np.ndarray:
    """One cut per (node, feature), below the largest value; NaN where constant."""
    u = draw(p.seed, fit + 2, t, key[:, None], np.arange(low.shape[1])[None, :])
    with np.errstate(invalid="ignore"):
        return np.where(high > low, np.minimum(low + u * (high - low), np.nextafter(high, -np.inf)), np.nan)


def _left_of(block: Block, rows, at, cuts, w, y) -> tuple[np.ndarray, np.ndarray]:
    n_open, n_f = cuts.shape
    left = np.zeros((4, n_open, n_f, 1))
    x, w, y = np.ascontiguousarray(block.x[rows].T), w[rows], y[rows]
    parts = (np.ones(len(rows)), w, w * y, w * y * y)
    for j in range(n_f):
        k = np.flatnonzero(x[j] <= cuts[at, j])
        mine = at[k]
        for i, v in enumerate(parts):
            left[i, :, j, 0] = np.bincount(mine, v[k], n_open)
    return left, _sums(at, n_open, w, y)


def _best_random(node, key, left, total, cuts, fit, t, p) -> dict:
    allowed = _candidates(key, cuts.shape[1], fit, t, p) & ~np.isnan(cuts)
    return _choose(node, left, total, lambda r, f, c: cuts[r, f], allowed, p)


def _grow_here(block: Block, cuts, fit: int, t: int, p: TreeParams, y) -> Tree:
    """All levels of a tree in the task that has the only block."""
    tree, w = Tree(), block.weights(fit, t, p)
    rows = np.flatnonzero(w > 0)                      # rows in open nodes, and the node of each
    stands = np.zeros(len(rows), np.int32)
    while tree.open.any() and len(rows):
        node = np.flatnonzero(tree.open)
        at = np.searchsorted(node, stands)
        if p.kind == "best":
            # few nodes at a time, so the sums of a level stay small
            step = max(1, (1 << 22) // (4 * block.code.shape[1] * block.bins))
            for a in range(0, len(node), step):
                mine = (at >= a) & (at < a + step)
                part = node[a:a + step]
                tree.split(_best_from_histogram(part, tree.key[part], _histogram(block, rows[mine], at[mine] - a, len(part), w, y),
                                                cuts, fit, t, p), p)
        else:
            drawn = random_cuts(tree.key[node], *_node_ranges(block, rows, at, len(node)), fit, t, p)
            tree.split(_best_random(node, tree.key[node], *_left_of(block, rows, at, drawn, w, y), drawn, fit, t, p), p)
        rows, stands = _step_down(tree, block, rows, stands)
    return tree


def _step_down(tree: Tree, block: Block, rows, stands) -> tuple[np.ndarray, np.ndarray]:
    """The rows that reach an open child of the node they stood in, and the child."""
    inner = tree.feature[stands] >= 0
    rows, stands = rows[inner], stands[inner]
    go = block.x[rows, tree.feature[stands]] <= tree.cut[stands]
    stands = np.where(go, tree.left[stands], tree.right[stands])
    live = tree.open[stands]
    return rows[live], stands[live]


def quantile_cuts(data: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Cut points of every feature: between all values where there are at most
    ``max_bins``, else at quantiles."""
    few = data.agg(*[F.approx_count_distinct(c).alias(f"f{j}") for j, c in enumerate(features)]).first()
    out: list = [None] * len(features)
    for j, c in enumerate(features):
        if few[f"f{j}"] <= 2 * max_bins:
            values = sorted(r[0] for r in data.select(c).distinct().limit(4 * max_bins + 1).collect())
            if len(values) <= max_bins:
                v = np.array(values, float)
                out[j] = (v[:-1] + v[1:]) / 2
    rest = [j for j, c in enumerate(out) if c is None]
    if rest:
        share = [k / max_bins for k in range(1, max_bins)]
        row = data.agg(*[F.percentile_approx(features[j], share, 10_000).alias(f"f{j}") for j in rest]).first()
        for j in rest:
            out[j] = np.unique(np.array(row[f"f{j}"], float))
    return out


class Grower:
    """Grows trees for several fits over one staged training table."""

    def __init__(self, data: DataFrame, features: Sequence[str], label: str, fold: str, test: str, row_hash):
        self.features = list(features)
        names = [*(f"__f{j}" for j in range(len(self.features))), "__y", "__fold", "__test", "__hash"]
        rows = data.select(*[F.col(c).cast("double").alias(f"__f{j}") for j, c in enumerate(self.features)],
                           F.col(label).cast("double").alias("__y"), F.col(fold).cast("int").alias("__fold"),
                           F.col(test).alias("__test"), row_hash.cast("long").alias("__hash"))
        self.table = data
        limit = BLOCK_ROWS

        def pack(batches: Iterator[pa.RecordBatch]):
            held: list[pd.DataFrame] = []

            def block(df):
                return pa.RecordBatch.from_pydict({
                    "n": pa.array([len(df)], pa.int64()),
                    "x": [np.ascontiguousarray(df[names[:-4]].to_numpy(float)).tobytes()],
                    "y": [df["__y"].to_numpy(float).tobytes()], "fold": [df["__fold"].to_numpy(np.int32).tobytes()],
                    "test": [df["__test"].to_numpy(np.uint8).tobytes()],
                    "hash": [df["__hash"].to_numpy(np.uint64).tobytes()]})

            for b in batches:
                held.append(b.to_pandas())
                if sum(map(len, held)) >= limit:
                    whole = pd.concat(held)
                    for a in range(0, len(whole) - len(whole) % limit, limit):
                        yield block(whole.iloc[a:a + limit])
                    held = [whole.iloc[len(whole) - len(whole) % limit:]]
            if held and sum(map(len, held)):
                yield block(pd.concat(held))

        n = data.count()
        rows = rows.coalesce(1) if n <= limit else rows
        self.schema = "n long, x binary, y binary, fold binary, test binary, hash binary"
        self.blocks = cut_lineage(rows.mapInArrow(pack, self.schema).repartition(
            max(1, min(-(-n // limit), 4 * data.sparkSession.sparkContext.defaultParallelism))) if n > limit
            else rows.mapInArrow(pack, self.schema))
        self.single = self.blocks.count() <= 1
        self.margins = False

    def _send(self, value):
        return self.blocks.sparkSession.sparkContext.broadcast(value)

    # -- one block: every task grows whole trees ---------------------------------
    def _grow_single(self, jobs, cuts, p) -> dict:
        spread = 4 * self.blocks.sparkSession.sparkContext.defaultParallelism
        groups = [jobs[k::spread] for k in range(min(spread, len(jobs)))]
        todo = self._send((groups, cuts, p))

        def run(batches):
            groups, cuts, p = todo.value
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row, cuts)
                    for fit, t in groups[row["part"]]:
                        tree = _grow_here(block, cuts, fit, t, p, block.y)
                        yield pa.RecordBatch.from_pydict({"fit": pa.array([fit], pa.int32()), "tree": pa.array([t], pa.int32()),
                                                          "nodes": [pickle.dumps(tree)]})

        parts = self.blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))))
        rows = parts.repartition(len(groups), "part").mapInArrow(run, "fit int, tree int, nodes binary").collect()
        return {(r["fit"], r["tree"]): pickle.loads(bytes(r["nodes"])) for r in rows}

    # -- many blocks: one meeting per level --------------------------------------
    def _level(self, trees: dict, cuts, p: TreeParams, margin_of=None) -> None:
        """Split the open nodes of all trees."""
        fine = {k: t for k, t in trees.items() if t.open.any()}
        drawn = self._drawn_cuts(fine, p) if p.kind == "random" else None
        state = self._send((fine, cuts, p, drawn))

        def partial(batches):
            fine, cuts, p, drawn = state.value
            total: dict = {}
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row, cuts)
                    for (fit, t), tree in fine.items():
                        w = block.weights(fit, t, p)
                        node, rows, at = _open_rows(tree, block, w)
                        y = block.y if margin_of is None else block.y - block.margin[fit]
                        if p.kind == "best":
                            part = _histogram(block, rows, at, len(node), w, y)
                        else:
                            left, all_of = _left_of(block, rows, at, drawn[fit, t], w, y)
                            part = np.concatenate([left, np.broadcast_to(all_of[:, :, None, None], left.shape)], axis=3)
                        total[fit, t] = total[fit, t] + part if (fit, t) in total else part
                    yield from _flush(total, fine) if sum(x.nbytes for x in total.values()) > 1 << 28 else ()
            yield from _flush(total, fine)

        # cells that hold rows, summed by (fit, tree, node, feature, bin)
        cells = self.blocks.mapInArrow(partial, "fit int, tree int, node int, cell int, n double, w double, s double, q double")
        sums = cells.groupBy("fit", "tree", "node", "cell").agg(*[F.sum(c).alias(c) for c in "nwsq"])
        splits = (sums.withColumn("part", F.floor(F.col("node") / NODE_GROUP))
                  .groupBy("fit", "tree", "part").applyInArrow(_chooser(state), "fit int, tree int, splits binary"))
        found = splits.collect()
        for r in found:
            trees[r["fit"], r["tree"]].split(pickle.loads(bytes(r["splits"])), p)
        asked = {(r["fit"], r["tree"]) for r in found}
        for k in fine:
            if k not in asked:
                trees[k].open[:] = False

    def _drawn_cuts(self, fine: dict, p: TreeParams) -> dict:
        """Ranges of the open nodes from one aggregation, then the cuts."""
        state = self._send((fine, p))
        n_f = len(self.features)

        def ranges(batches):
            fine, p = state.value
            low, high = {}, {}
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row, None)
                    for (fit, t), tree in fine.items():
                        node, rows, at = _open_rows(tree, block, block.weights(fit, t, p))
                        lo, hi = _node_ranges(block, rows, at, len(node))
                        low[fit, t] = np.minimum(low.get((fit, t), lo), lo)
                        high[fit, t] = np.maximum(high.get((fit, t), hi), hi)
            for k in low:
                yield pa.RecordBatch.from_pydict({
                    "fit": pa.array(np.full(low[k].size, k[0], np.int32)), "tree": pa.array(np.full(low[k].size, k[1], np.int32)),
                    "cell": pa.array(np.arange(low[k].size, dtype=np.int32)), "lo": low[k].ravel(), "hi": high[k].ravel()})

        rows = (self.blocks.mapInArrow(ranges, "fit int, tree int, cell int, lo double, hi double")
                .groupBy("fit", "tree", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .groupBy("fit", "tree").agg(F.sort_array(F.collect_list(F.struct("cell", "lo", "hi"))).alias("r")))
        out = {}
        for r in rows.toLocalIterator():
            lo, hi = (np.array([x[c] for x in r["r"]]).reshape(-1, n_f) for c in ("lo", "hi"))
            k = r["fit"], r["tree"]
            out[k] = random_cuts(fine[k].key[fine[k].open], lo, hi, *k, p)
        return out

    def grow(self, fits: Sequence[int], p: TreeParams, max_bins: int = 32) -> dict:
        """{fit: [Tree]}"""
        cuts = quantile_cuts(self.table, self.features, max_bins) if p.kind == "best" else None
        jobs = [(fit, t) for fit in fits for t in range(p.trees)]
        if self.single:
            trees = self._grow_single(jobs, cuts, p)
        else:
            trees = {k: Tree() for k in jobs}
            while any(t.open.any() for t in trees.values()):
                self._level(trees, cuts, p)
                if sum(len(t.feature) for t in trees.values()) > NODE_LIMIT:
                    raise ValueError(f"more than {NODE_LIMIT} nodes: set max_depth or min_samples_leaf")
        return {fit: [trees[fit, t] for t in range(p.trees)] for fit in fits}

    def boost(self, fits: Sequence[int], p: TreeParams, rate: float, share: float = 1.0, max_bins: int = 32) -> dict:
        """{fit: (start, [Tree])}: least-squares boosting; leaf values are not yet shrunk."""
        cuts = quantile_cuts(self.table, self.features, max_bins)
        start = self._means(fits)
        out: dict = {fit: (start[fit], []) for fit in fits}
        self._stage_margins({fit: (start[fit], []) for fit in fits}, rate)
        done = 0
        while done < p.trees:
            rounds = min(STAGED_ROUNDS, p.trees - done)
            grown = self._rounds(fits, done, rounds, cuts, p, rate, share)
            for fit in fits:
                out[fit][1].extend(grown[fit])
            done += rounds
            if done < p.trees:
                self._stage_margins({fit: (None, grown[fit]) for fit in fits}, rate)
        return out

    def _means(self, fits) -> dict:
        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row, None)
                    w = np.stack([block.weights(f, 0, TreeParams()) for f in fits])
                    yield pa.RecordBatch.from_pydict({"fit": pa.array(fits, pa.int32()), "n": w.sum(axis=1), "s": w @ block.y})
        rows = self.blocks.mapInArrow(run, "fit int, n double, s double").groupBy("fit").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        found = {r["fit"]: r["s"] / r["n"] if r["n"] else 0.0 for r in rows.collect()}
        return {f: found.get(f, 0.0) for f in fits}

    def _stage_margins(self, new: dict, rate: float) -> None:
        """Add the start (or the new trees) to the margins in the blocks."""
        todo = self._send(new)

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    block, margins = Block(row, None), {}
                    for fit, (start, trees) in todo.value.items():
                        m = np.full(len(block.y), start) if start is not None else block.margin[fit].copy()
                        for tree in trees:
                            m += rate * tree.value[tree.walk(block.x)]
                        margins[fit] = m.tobytes()
                    row["margins"] = list(margins.items())
                    yield pa.RecordBatch.from_pylist([row], pa.schema([
                        ("n", pa.int64()), *((c, pa.binary()) for c in ("x", "y", "fold", "test", "hash")),
                        ("margins", pa.map_(pa.int32(), pa.binary()))]))

        base = self.blocks if self.margins else self.blocks.withColumn("margins", F.lit(None).cast("map<int,binary>"))
        self.blocks = cut_lineage(base.mapInArrow(run, self.schema + ", margins map<int,binary>"))
        self.margins = True

    def _rounds(self, fits, first: int, rounds: int, cuts, p: TreeParams, rate: float, share: float) -> dict:
        if self.single:
            todo = self._send((cuts, p))

            def run(batches):
                cuts, p = todo.value
                for b in batches:
                    for row in b.to_pylist():
                        block = Block(row, cuts)
                        fit, trees = row["fit"], []
                        margin = block.margin[fit].copy()
                        for t in range(first, first + rounds):
                            part = _part_of(block, share, fit, t, p)
                            trees.append(_grow_here(part, cuts, fit, t, p, block.y - margin))
                            margin += rate * trees[-1].value[trees[-1].walk(block.x)]
                        yield pa.RecordBatch.from_pydict({"fit": pa.array([fit], pa.int32()), "trees": [pickle.dumps(trees)]})

            each = self.blocks.withColumn("fit", F.explode(F.array(*map(F.lit, fits))))
            rows = each.repartition(len(fits), "fit").mapInArrow(run, "fit int, trees binary").collect()
            return {r["fit"]: pickle.loads(bytes(r["trees"])) for r in rows}
        if share < 1:
            raise ValueError("subsample below 1 needs a table of one block")
        out: dict = {fit: [] for fit in fits}
        kept, margins = self.blocks, self.margins
        for t in range(first, first + rounds):
            trees = {(fit, t): Tree() for fit in fits}
            while any(x.open.any() for x in trees.values()):
                self._level(trees, cuts, p, margin_of=True)
            for fit in fits:
                out[fit].append(trees[fit, t])
            if t + 1 < first + rounds:
                self._stage_margins({fit: (None, out[fit][-1:]) for fit in fits}, rate)
        self.blocks, self.margins = kept, margins
        return out


def _part_of(block: Block, share: float, fit: int, t: int, p: TreeParams) -> Block:
    """The block with rows outside the round's subsample given no weight."""
    if share >= 1:
        return block
    keep = draw(p.seed + 3, block.hash, fit + 2, t) < share
    part = object.__new__(Block)
    part.__dict__.update(block.__dict__)
    part.weights = lambda f, tree, q: Block.weights(block, f, tree, q) * keep
    return part


def _flush(total: dict, fine: dict):
    for (fit, t), part in total.items():
        node = np.flatnonzero(fine[fit, t].open)
        cells = part.reshape(4, len(node), -1)
        at, cell = np.nonzero(cells[0])
        n, w, s, q = cells[:, at, cell]
        yield pa.RecordBatch.from_pydict({
            "fit": pa.array(np.full(len(at), fit, np.int32)), "tree": pa.array(np.full(len(at), t, np.int32)),
            "node": pa.array(node[at].astype(np.int32)), "cell": pa.array(cell.astype(np.int32)), "n": n, "w": w, "s": s, "q": q})
    total.clear()


def _chooser(state):
    def run(table: pa.Table) -> pa.Table:
        fine, cuts, p, drawn = state.value
        fit, t = table["fit"][0].as_py(), table["tree"][0].as_py()
        number, cell = table["node"].to_numpy(), table["cell"].to_numpy()
        node, at = np.unique(number, return_inverse=True)
        if p.kind == "best":
            shape = (4, len(node), len(cuts), max((len(c) for c in cuts), default=0) + 1)
        else:
            mine = drawn[fit, t][np.searchsorted(np.flatnonzero(fine[fit, t].open), node)]
            shape = (4, len(node), mine.shape[1], 2)
        sums = np.zeros((4, len(node), shape[2] * shape[3]))
        for k, c in enumerate("nwsq"):
            sums[k, at, cell] = table[c].to_numpy()
        sums = sums.reshape(shape)
        if p.kind == "best":
            found = _best_from_histogram(node, fine[fit, t].key[node], sums, cuts, fit, t, p)
        else:
            found = _best_random(node, fine[fit, t].key[node], sums[:, :, :, :1], sums[:, :, 0, 1], mine, fit, t, p)
        return pa.table({"fit": pa.array([fit], pa.int32()), "tree": pa.array([t], pa.int32()), "splits": [pickle.dumps(found)]})
    return run


@dataclass
class TreeModel:
    """Mean of trees, or a start plus shrunken trees.  ``transform`` adds a
    ``prediction``; node tables travel by broadcast."""

    features: list[str]
    trees: list[Tree] = field(repr=False)
    start: float = 0.0
    rate: float | None = None          # None: the mean of the trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree.value[tree.walk(x)]
        return self.start + self.rate * total if self.rate is not None else total / max(1, len(self.trees))

    def column(self, spark: SparkSession):
        shipped = spark.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predict(x: pd.DataFrame) -> pd.Series:
            return pd.Series(shipped.value.predict(x.to_numpy(float)))
        return predict(F.struct(*[F.col(c).cast("double") for c in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.column(df.sparkSession))

    def save(self, spark: SparkSession, path: str) -> None:
        """Parquet rows, one per tree."""
        about = json.dumps({"features": self.features, "start": self.start, "rate": self.rate})
        rows = [(k, about, pickle.dumps(t)) for k, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, model string, nodes binary").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TreeModel":
        rows = spark.read.parquet(path).orderBy("tree").collect()
        about = json.loads(rows[0]["model"])
        return TreeModel(about["features"], [pickle.loads(bytes(r["nodes"])) for r in rows], about["start"], about["rate"])
