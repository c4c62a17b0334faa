import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trueline.llm import knn


def brute(rows, k, every=20):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * float(x)) for x in v]
        best[i] = min(best.get(i, w), w)
    width = max(map(len, best.values()), default=0)
    m = {i: w + [0] * (width - len(w)) for i, w in best.items()}
    out = []
    for q in m:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(m[q], m[i])), i) for i in m if i != q)[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                 "vec_id long, embedding array<double>, cell string, query int")


def result(df, k):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(df, F.col("vec_id") % 20 == 0, k).collect())


@pytest.mark.parametrize("tiles", [(8192, 2048), (40, 3)])
@pytest.mark.parametrize("shape", ["spread", "clusters", "hot"])
def test_equals_brute_force(spark, monkeypatch, shape, tiles):
    monkeypatch.setattr(knn, "DATA_TILE", tiles[0])
    monkeypatch.setattr(knn, "QUERY_TILE", tiles[1])
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8))
    if shape == "clusters":
        v = 5 * rng.normal(size=(8, 8))[rng.integers(0, 8, 400)] + 0.05 * v
    if shape == "hot":
        v[:150] = v[0]
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(400), v)]
    assert result(table(spark, rows), 7) == brute(rows, 7)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, -0.01]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (1, None), (2, [1.0, None]),
            (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [3.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]),
            (None, [9.0, 9.0]), (40, [-1.0, 0.0, 1.0])]
    assert result(table(spark, rows), 20) == brute(rows, 20)
    assert result(table(spark, []), 20) == []
    assert result(table(spark, [(0, [1.0])]), 20) == []
    assert result(table(spark, [(1, [1.0]), (2, [2.0])]), 20) == []


def test_large_components_stay_exact(spark):
    rows = [(k, [1e6 + k / 3, -1e6 + k * 0.7, float(k)]) for k in range(45)]
    assert result(table(spark, rows), 5) == brute(rows, 5)


def test_far_groups_are_not_sent(spark):
    centre = np.array([[100.0, 0.0], [0.0, 100.0], [-100.0, 0.0]])
    need = knn.needed_cells(centre, np.array([50, 50, 50]), np.array([1.0, 1.0, 1.0]), np.array([1.0, -1.0, 1.0]), 5)
    assert need.tolist() == [[True, False, False], [False, False, False], [False, False, True]]


def test_vectors_too_long_for_a_long_score_take_no_part(spark):
    """Any finite vector has a defined result: none, if its product with itself
    does not fit a long."""
    rows = [(k, [k / 3, 1.0, -2.0 * k]) for k in range(45)]
    big = [(100, [3e38, 1.0, 0.0]), (101, [-1.7e308, 0.0, 0.0]), (120, [4.8e7, 4.8e7, 4.8e7]), (121, [0.0, 5e7, 0.0])]
    near = [(60, [4.7e7, 0.0, 0.0]), (61, [-4.7e7, 3e6, 0.0])]
    assert result(table(spark, rows + near + big), 5) == brute(rows + near, 5)


def test_clustered_data_is_pruned(spark, monkeypatch):
    """On 100,000 rows in clusters only a small share of (row, group) pairs is sent."""
    rng = np.random.default_rng(7)
    centre = 40 * rng.normal(size=(24, 16))
    v = centre[rng.integers(0, 24, 100_000)] + rng.normal(size=(100_000, 16))
    seen = []
    plain = knn.needed_cells

    def noted(*args):
        need = plain(*args)
        seen.append(need.mean())
        return need
    monkeypatch.setattr(knn, "needed_cells", noted)
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(100_000), "embedding": v.tolist()}))
    found = result(df, 5)
    assert len(found) == 5000 * 5 and seen and seen[0] < 0.5
    w = np.floor(64 * v)
    for q in rng.choice(5000, 40, replace=False) * 20:
        s = w @ w[q]
        s[q] = -np.inf
        want = sorted(range(100_000), key=lambda i: (-s[i], i))[:5]
        assert [r[2] for r in found if r[0] == q] == want
