"""Level-wise trees: one block and many blocks agree; rules of the estimators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trueline.ml import tree_grower
from trueline.ml.registry import get_selected_models, tree_params
from trueline.ml.train import FOLD, IS_TEST, train_models
from trueline.ml.tree_grower import HOLDOUT, Grower, TreeModel, TreeParams
from trueline.sources.sinks import load_model, save_model


def table(spark, n=240, seed=1):
    """Quarter-valued targets and features: sums are exact in any order."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)) * 4) / 4
    y = np.round((np.sin(2 * x[:, 0]) * 3 + (x[:, 1] > 0) * 2) * 4) / 4
    rows = [(*map(float, x[i]), float(y[i]), int(i % 3), bool(i % 5 == 0), int(rng.integers(1 << 32))) for i in range(n)]
    return spark.createDataFrame(rows, f"a double, b double, c double, y double, {FOLD} int, {IS_TEST} boolean, h long")


def shape(tree):
    """Splits of a tree in walking order, independent of node numbers."""
    def walk(k):
        if tree.feature[k] < 0:
            return round(float(tree.value[k]), 9)
        return int(tree.feature[k]), float(tree.cut[k]), walk(tree.left[k]), walk(tree.right[k])
    return walk(0)


def grower(spark):
    return Grower(table(spark), ["a", "b", "c"], "y", FOLD, IS_TEST, F.col("h"))


@pytest.mark.parametrize("params", [
    TreeParams("best", trees=2, max_depth=4, bootstrap=True), TreeParams("best", trees=2, max_depth=3, features=2),
    TreeParams("random", trees=2, max_depth=4), TreeParams("random", trees=2, max_depth=5, min_samples_leaf=4, features=1)])
def test_blocks_do_not_matter(spark, monkeypatch, params):
    one = grower(spark).grow([HOLDOUT, 0], params)
    monkeypatch.setattr(tree_grower, "BLOCK_ROWS", 50)
    monkeypatch.setattr(tree_grower, "NODE_GROUP", 3)
    many = grower(spark)
    assert not many.single
    many = many.grow([HOLDOUT, 0], params)
    assert {f: [shape(t) for t in ts] for f, ts in one.items()} == {f: [shape(t) for t in ts] for f, ts in many.items()}


def test_blocks_do_not_matter_for_boosting(spark, monkeypatch):
    """Three rounds, margins staged after every second."""
    monkeypatch.setattr(tree_grower, "STAGED_ROUNDS", 2)
    p = TreeParams("best", trees=3, max_depth=2)
    one = grower(spark).boost([HOLDOUT, 1], p, 0.5)
    monkeypatch.setattr(tree_grower, "BLOCK_ROWS", 100)
    many = grower(spark).boost([HOLDOUT, 1], p, 0.5)
    for fit in (HOLDOUT, 1):
        assert abs(one[fit][0] - many[fit][0]) < 1e-12
        x = np.array([[r.a, r.b, r.c] for r in table(spark).collect()])
        a, b = (TreeModel(["a", "b", "c"], m[fit][1], m[fit][0], 0.5).predict(x) for m in (one, many))
        assert np.allclose(a, b, atol=1e-9)


def test_first_boosted_tree_is_shrunk(spark):
    start, trees = grower(spark).boost([HOLDOUT], TreeParams("best", trees=1, max_depth=1), 0.1)[HOLDOUT]
    rows = [r for r in table(spark).collect() if not r[IS_TEST]]
    assert abs(start - np.mean([r.y for r in rows])) < 1e-9
    best = min((sum((v - np.mean(s)) ** 2 for s in (left, right) for v in s), j, cut)
               for j, c in enumerate("abc") for cut in sorted({r[c] for r in rows})[:-1]
               for left, right in [([r.y for r in rows if r[c] <= cut], [r.y for r in rows if r[c] > cut])])
    assert trees[0].feature[0] == best[1] and best[2] <= trees[0].cut[0]


def test_deep_trees_reach_every_value(spark):
    """Depth 40 with one row per leaf repeats the training targets."""
    n = 200
    data = spark.createDataFrame([(float(k), float(k * k % 17), 0, False, k) for k in range(n)],
                                 f"a double, y double, {FOLD} int, {IS_TEST} boolean, h long")
    grown = Grower(data, ["a"], "y", FOLD, IS_TEST, F.col("h"))
    tree = grown.grow([HOLDOUT], TreeParams("random", trees=1, max_depth=40))[HOLDOUT][0]
    x = np.arange(n, dtype=float)[:, None]
    assert np.allclose(tree.value[tree.walk(x)], x[:, 0] ** 2 % 17)
    flat = spark.createDataFrame([(float(k), 1.0, 0, False, k) for k in range(9)], data.schema)
    assert len(Grower(flat, ["a"], "y", FOLD, IS_TEST, F.col("h")).grow([HOLDOUT], TreeParams())[HOLDOUT][0].feature) == 1


def test_rules_of_split_sizes(spark):
    x = np.array([[r.a, r.b, r.c] for r in table(spark).collect() if not r[IS_TEST]])
    for p in (TreeParams("best", trees=1, min_samples_leaf=9), TreeParams("random", trees=1, min_samples_leaf=9)):
        tree = grower(spark).grow([HOLDOUT], p)[HOLDOUT][0]
        assert min(np.unique(tree.walk(x), return_counts=True)[1]) >= 9
    lone = grower(spark).grow([HOLDOUT], TreeParams("best", trees=1, min_samples_split=1000))[HOLDOUT][0]
    assert len(lone.feature) == 1


def test_parameters():
    spec = get_selected_models({"selected_models": ["extra_trees"], "model_params": {
        "extra_trees": {"max_features": "sqrt", "min_samples_split": 5, "max_depth": 40}}})["extra_trees"]
    p = tree_params(spec.name, spec.params, spec.seed, 16)
    assert (p.kind, p.features, p.min_samples_split, p.max_depth, p.trees) == ("random", 4, 5, 40, 100)
    with pytest.raises(ValueError, match="max_features"):
        tree_params("random_forest", {**spec.params, "bootstrap": True, "max_features": "half"}, 1, 16)


def test_saved_model_scores_alike(spark, tmp_path):
    from test_models import synthetic
    df, _, _ = synthetic(spark, n=120, nonlinear=True)
    model = train_models(df, "y", "timestamp", {"selected_models": ["gradient_boosting"],
                                                "model_params": {"gradient_boosting": {"n_estimators": 4}}}, 42,
                         cross_validate=False)[0].model
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    x = np.random.default_rng(0).normal(size=(50, 4))
    assert (model.predict(x) == again.predict(x)).all() and again.features == model.features


def test_single_block_rows_step_down_instead_of_walking_from_the_root(monkeypatch):
    """A level costs the rows of its open nodes, not all rows times the depth; the trees stay the same."""
    import numpy as np
    from trueline.ml import tree_grower as g
    rng = np.random.default_rng(3)
    n = 700
    x = np.round(rng.normal(size=(n, 4)), 2)
    y = x[:, 0] * 2 + rng.normal(size=n)
    row = {"n": n, "x": x.tobytes(), "y": y.tobytes(), "fold": (np.arange(n) % 3).astype(np.int32).tobytes(),
           "test": (np.arange(n) % 5 == 0).astype(np.uint8).tobytes(), "hash": np.arange(n, dtype=np.uint64).tobytes()}
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, 16) / 16)) for j in range(4)]
    walk = g.Tree.walk

    def slow(block, fit, t, p):
        """Every level finds the place of all rows from the root."""
        tree, w = g.Tree(), block.weights(fit, t, p)
        while tree.open.any():
            node, rows, at = g._open_rows(tree, block, w)
            if p.kind == "best":
                s = g._best_from_histogram(node, tree.key[node], g._histogram(block, rows, at, len(node), w, block.y), cuts, fit, t, p)
            else:
                drawn = g.random_cuts(tree.key[node], *g._node_ranges(block, rows, at, len(node)), fit, t, p)
                s = g._best_random(node, tree.key[node], *g._left_of(block, rows, at, drawn, w, block.y), drawn, fit, t, p)
            tree.split(s, p)
        return tree

    def forbidden(*a):
        raise AssertionError("all rows walked from the root")
    for p in (g.TreeParams(kind="random"), g.TreeParams(bootstrap=True), g.TreeParams(kind="random", min_samples_leaf=4, features=2)):
        block = g.Block(row, cuts)
        for fit in (g.HOLDOUT, 1):
            monkeypatch.setattr(g.Tree, "walk", walk)
            want = slow(block, fit, 2, p)
            monkeypatch.setattr(g.Tree, "walk", forbidden)
            got = g._grow_here(block, cuts, fit, 2, p, block.y)
            for k in g.Tree.__slots__:
                assert np.array_equal(getattr(got, k), getattr(want, k)), k
            assert len(got.feature) > 50
