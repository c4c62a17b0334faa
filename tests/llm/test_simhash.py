import numpy as np
import pytest

from brute import components, edge_docs, edge_rows, simhash as brute
from trueline.llm import simhash
from trueline.llm.components import connected_components


def test_edges(spark):
    rows = [(d, t) for d, t, *_ in edge_rows()]
    fps = [brute(t) for _, t in rows]
    roots = components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    ids = [min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None)
           for r in roots]
    want = sorted(((d, f - (f >> 63 << 64), i) for (d, _), f, i in zip(rows, fps, ids)), key=str)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(edge_docs(spark)).collect()),
                 key=str)
    assert got == want


def test_empty_and_single(spark):
    assert simhash.near_duplicates(edge_docs(spark, [])).collect() == []
    one = simhash.near_duplicates(edge_docs(spark, [(5, "just one", "en", "a")])).collect()
    assert [(r.doc_id, r.component_id) for r in one] == [(5, 5)]


def found_components(spark, values, tau, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(3)
    parts = simhash.plan(fps, tau)
    assert sum(t for _, t in parts) + sum(1 for _ in parts) >= 1
    pairs = connected_components(simhash.links(fps, parts, tau)).collect()
    root = {int(v): int(v) for v in values} | {r.node: r.root for r in pairs}
    return parts, root


@pytest.mark.parametrize("tile", [1024, 8])
@pytest.mark.parametrize("shape", ["random", "dense", "skewed bits"])
def test_links_lose_no_component(spark, monkeypatch, shape, tile):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    flips = lambda n: np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 63, n))
    if shape == "random":
        values = [b ^ flips(rng.integers(0, 7)) if k else b for b in base for k in range(4)]
    elif shape == "dense":
        values = [base[0] ^ flips(rng.integers(0, 4)) for _ in range(250)] + list(base)
    else:
        values = [(b & np.int64(0xFF0F)) ^ flips(rng.integers(0, 2)) for b in base for _ in range(4)]
    values = np.unique(np.array(values, dtype=np.int64))
    u = values.view(np.uint64)
    want = components(len(values), lambda a, b: int(np.bitwise_count(u[a] ^ u[b])) <= 4)
    parts, root = found_components(spark, values, 4, tile, monkeypatch)
    groups = lambda label: {frozenset(int(values[k]) for k in range(len(values)) if label[k] == x)
                            for x in set(label)}
    assert groups([root[int(v)] for v in values]) == groups(want)
    bits = sorted(b for g, _ in parts for b in g)
    assert len(bits) == len(set(bits))


def test_allocation_is_optimal():
    from itertools import product
    rng = np.random.default_rng(3)
    for m in (1, 2, 3, 4):
        costs = [[0.0, *np.cumsum(rng.random(5)).tolist()] for _ in range(m)]
        total = 4 - m + 1
        best = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in product(range(-1, 5), repeat=m) if sum(ts) == total)
        cost, ts = simhash.allocate(costs, total)
        assert sum(ts) == total and abs(cost - best) < 1e-9


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(60)]
    hub = [(1000, 1000 + k) for k in range(1, 200)]
    loose = [(5000, 5000), (6001, 6000), (6000, 6001)]
    df = spark.createDataFrame(chain + hub + loose, "a long, b long")
    got = {(r.node, r.root) for r in connected_components(df).collect()}
    want = {(k, 0) for k in range(1, 61)} | {(1000 + k, 1000) for k in range(1, 200)} | {(6001, 6000)}
    assert got == want
