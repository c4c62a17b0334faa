"""Models per series: the same as training each series alone."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from trueline.ml.per_key import HOLDOUT, add_holdout_per_key, calibrated_per_key, train_models_per_key
from trueline.ml.train import IS_TEST

MODELS = ["linear_regression", "ridge", "lasso"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for key, n, slope in (("a", 120, 2.0), ("b", 35, -1.0), (None, 50, 0.5)):
        for i in range(n):
            x, z = rng.normal(1e4, 5), rng.normal()
            rows.append((key, 60 * i, float(x), float(z), float(slope * x + z + rng.normal() * 0.1)))
    return spark.createDataFrame(rows, "k string, s long, x double, z double, y double").select(
        "k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"), "x", "z", "y").repartition(3)


def test_exact_share_per_series(data):
    got = {r["k"]: (r["n"], r["t"]) for r in add_holdout_per_key(data, "timestamp", ["k"], 0.2).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(IS_TEST).cast("int")).alias("t")).collect()}
    assert got == {"a": (120, 24), "b": (35, 7), None: (50, 10)}


def test_each_series_is_fitted_alone(data):
    r = train_models_per_key(data, "y", "timestamp", {"selected_models": MODELS}, 42, ["k"])
    assert r.models.count() == 3 * 3 * 6
    models = {(m["k"], m["model"], m["split"]): (np.array(m["w"]), m["b"]) for m in r.models.collect()}
    for key in ("a", "b", None):
        rows = add_holdout_per_key(data, "timestamp", ["k"]).where(
            F.col("k").eqNullSafe(F.lit(key))).where(~F.col(IS_TEST)).collect()
        X, y = np.array([[q["x"], q["z"]] for q in rows]), np.array([q["y"] for q in rows])
        w = np.linalg.lstsq(X - X.mean(0), y - y.mean(), rcond=None)[0]
        got, b = models[(key, "linear_regression", HOLDOUT)]
        assert np.allclose(got, w, atol=1e-7) and abs(b - (y.mean() - X.mean(0) @ w)) < 1e-3
    board = r.leaderboard.collect()
    assert sorted((str(x["k"]), x["place"]) for x in board) == sorted((k, p) for k in ("a", "b", "None") for p in (1, 2, 3))
    for key in ("a", "b", None):
        ranked = sorted((x["place"], x["rmse"]) for x in board if x["k"] == key)
        assert [v for _, v in ranked] == sorted(v for _, v in ranked)
    assert r.cv_predictions.count() == data.count() * 3
    out = calibrated_per_key(data, r, "timestamp", "y", ["k"])
    assert out.count() == data.count()
    assert out.agg(F.max(F.abs(F.col("reference_value") - F.col("calibrated_prediction")))).first()[0] < 1.0


def test_needs_keys_and_linear_models(data):
    with pytest.raises(ValueError, match="keys"):
        train_models_per_key(data, "y", "timestamp", {}, 42, [])
    with pytest.raises(ValueError, match="only linear"):
        train_models_per_key(data, "y", "timestamp", {"selected_models": ["random_forest"]}, 42, ["k"])
