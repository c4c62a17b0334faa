"""Rows that must not be lost, keyed plans, limits that raise, exactness."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trueline.functions.rules import parse_rule
from trueline.ml import linear
from trueline.ml.evaluate import ranked
from trueline.ml.registry import get_selected_models
from trueline.ml.train import IS_TEST, add_holdout_flag, train_models
from trueline.operators import joins
from trueline.operators.ordered import dense_positions
from trueline.operators.preprocess import impute_missing_values, preprocess_dataset
from trueline.operators.quantiles import exact_quantiles
from trueline.operators.resample import resample_timeseries
from trueline.operators.validate import coerce_timestamp, validate_series
from trueline.plans.calibration import create_leaderboard, select_best
from trueline.sources.readers import scan_csv

NAN = float("nan")


def series(spark, rows, key="string"):
    return spark.createDataFrame(rows, f"k {key}, timestamp timestamp, x double, y double").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))


def minutes(n):
    from datetime import datetime, timedelta
    return [datetime(2024, 1, 1) + timedelta(minutes=5 * i) for i in range(n)]


def test_nan_is_imputed_like_null(spark):
    rows = [("a", t, NAN if i == 3 else float(i), 1.0) for i, t in enumerate(minutes(12))]
    df = validate_series(series(spark, rows).drop("k"))
    assert df.where("x is null").count() == 1
    out, _ = preprocess_dataset(df, "timestamp", {"outlier_method": "iqr", "normalization": "none"})
    assert out.count() == 12 and out.where("isnan(x) or x is null").count() == 0
    hour = resample_timeseries(df, "timestamp", "1h", "mean").collect()
    assert len(hour) == 1 and abs(hour[0]["x"] - np.mean([i for i in range(12) if i != 3])) < 1e-12


def test_null_keys_are_a_series(spark):
    rows = [(k, t, float(i), float(i)) for k in ("a", None) for i, t in enumerate(minutes(12))]
    df = validate_series(series(spark, rows), keys=["k"])
    got = dense_positions(df, "timestamp", ["k"], pos_col="p").collect()
    assert sorted((str(r["k"]), r["p"]) for r in got) == sorted((str(k), i) for k in ("a", None) for i in range(12))
    out, _ = preprocess_dataset(df, "timestamp", {}, keys=["k"])
    assert out.count() == 24
    for rule in ("1h", "7h", "2W"):
        assert {r["k"] for r in resample_timeseries(df, "timestamp", rule, "count", ["k"]).collect()} == {"a", None}


def test_all_null_series_is_named(spark):
    rows = [(k, t, None if k == "b" else 1.0 * i, 2.0) for k in "ab" for i, t in enumerate(minutes(5))]
    with pytest.raises(ValueError, match=r"'b'.*x"):
        impute_missing_values(series(spark, rows), ["x", "y"], "median", ["k"])


def test_csv_tokens_types_and_schema(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("timestamp,a,b,c,d\n2024-01-01 00:00:00,1,NA,x,true\n2024-01-01 01:00:00,NaN,2.5,null,\n"
                    "2024-01-01 02:00:00,3, N/A ,z,FALSE\n")
    df = scan_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double", "string", "boolean"]
    assert [tuple(r)[1:] for r in df.collect()] == [(1, None, "x", True), (None, 2.5, None, None), (3, None, "z", False)]
    from pyspark.sql.types import StructType
    given = StructType().add("timestamp", "string").add("a", "double").add("b", "double").add("c", "double").add("d", "string")
    assert [r["c"] for r in scan_csv(spark, str(path), schema=given).collect()] == [None] * 3


@pytest.mark.parametrize("text, utc", [
    ("2024-01-05T13:00:00+05:30", "2024-01-05 07:30:00"), ("2024-01-05 13:00:00-0800", "2024-01-05 21:00:00"),
    ("2024-01-05 13:00:00.5Z", "2024-01-05 13:00:00.500000"), ("2024-01-05 13:00:00+01", "2024-01-05 12:00:00"),
    ("2024-01-05 13:00:00", "2024-01-05 13:00:00"), ("2024-01-05", "2024-01-05 00:00:00"), ("05/01/2024", "None")])
def test_offsets_become_utc(spark, text, utc):
    df = spark.createDataFrame([(text,)], "timestamp string")
    assert str(coerce_timestamp(df).first()[0]) == utc


def test_format(spark):
    df = spark.createDataFrame([("05/01/2024 13:00",), ("2024-01-05 13:00",), ("31/03/2024 02:30",)], "timestamp string")
    got = [str(r[0]) for r in coerce_timestamp(df, fmt="dd/MM/yyyy HH:mm").collect()]
    assert got == ["2024-01-05 13:00:00", "None", "2024-03-31 02:30:00"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_keyed_parameters_do_not_shuffle_rows_by_key(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    rows = spark.range(0, 20_000, numPartitions=4).select(
        (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("timestamp"),
        F.col("id").cast("double").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, _ = impute_missing_values(rows, ["x"], "mean", ["k"])
        out = resample_timeseries(out, "timestamp", "7h", "mean", ["k"])
        text = plan(out)
        want = out.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    import re
    by_key_only = re.findall(r"Exchange hashpartitioning\((?:k#\d+L?|__series#\d+), \d+\)", text)
    assert not by_key_only, text
    assert re.search(r"hashpartitioning\(k#\d+L?, __bucket#\d+L?", text)
    assert want == sum(math.ceil((20_000 * 60) / (7 * 3600)) for _ in range(3))


def test_spine_of_a_long_series_is_not_one_row(spark):
    from datetime import datetime
    df = spark.createDataFrame([(datetime(1970, 1, 1), 1.0), (datetime(1971, 1, 1), 2.0)], "timestamp timestamp, x double")
    df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    out = resample_timeseries(df, "timestamp", "1min", "count")
    assert out.agg(F.count(F.lit(1)), F.sum("x")).first() == (365 * 1440 + 1, 2)


def test_limits_raise(spark):
    for name in ("random_forest", "extra_trees"):
        with pytest.raises(ValueError, match="max_depth 50"):
            get_selected_models({"selected_models": [name], "model_params": {name: {"max_depth": 50}}})[name] \
                .estimator(None, "y")
    spec = get_selected_models({"selected_models": ["lasso"], "model_params": {"lasso": {"max_iter": 5}}})
    assert spec["lasso"].params["max_iter"] == 5
    spec = get_selected_models({"selected_models": ["ridge"], "model_params": {"ridge": {"n_jobs": -1, "copy_X": False}}})
    assert spec["ridge"].params == {"alpha": 1.0, "fit_intercept": True}
    with pytest.raises(RuntimeError, match="mllib"):
        linear._exact(np.array([[1.0, 0.99], [0.99, 1.0]]), np.array([1.0, 0.9]), 1.0, 0.01, rounds=0)


@pytest.mark.parametrize("values", ["wide", "repeated", "skewed"])
def test_quantile_ways_are_bit_equal(spark, values):
    rng = np.random.default_rng(0)
    x = {"wide": 10.0 ** rng.uniform(-300, 300, 1500), "repeated": np.repeat([1.0, 2.5, 7.0], [900, 1, 599]),
         "skewed": np.exp(rng.normal(0, 8, 1500))}[values]
    df = spark.createDataFrame([(float(v), "s") for v in x], "x double, k string").repartition(3)
    probs = [0.25, 0.5, 0.75]
    small = exact_quantiles(df, ["x"], probs, ["k"]).first()["values"]
    large = exact_quantiles(df, ["x"], probs, ["k"], final_rows=20).first()["values"]
    assert list(small) == list(large)
    assert np.allclose(small, np.quantile(x, probs), rtol=1e-12)


def test_large_means_do_not_cancel(spark):
    rng = np.random.default_rng(3)
    base = 1e6 + 10 * rng.normal(size=400)
    x = np.column_stack([base, np.convolve(base, np.ones(3) / 3, "same"), 1e6 + 10 * rng.normal(size=400)])[5:-5]
    y = x @ np.array([0.5, 1.0, -0.3]) + rng.normal(size=len(x))
    df = spark.createDataFrame([(*map(float, r), float(v), 0) for r, v in zip(x, y)], "a double, b double, c double, y double, cell int")
    moments = linear.cell_moments(df, ["a", "b", "c"], "y", ["cell"])
    fit = linear.solve("ols", {}, linear.combine(moments, list(moments)))
    w, b = fit.w, fit.b
    ref = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    rmse = lambda p: float(np.sqrt(np.mean((y - p) ** 2)))
    assert abs(rmse(x @ w + b) - rmse((x - x.mean(0)) @ ref + y.mean())) < 1e-6
    fit = linear.solve("ols", {"fit_intercept": False}, linear.combine(moments, list(moments)))
    w0, b0 = fit.w, fit.b
    assert b0 == 0 and np.allclose(w0, np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-3, atol=1e-3)


def test_small_tables_keep_both_sides(spark):
    rows = [("a", t, float(i), 2.0 * i + 1) for i, t in enumerate(minutes(10))]
    df = series(spark, rows).drop("k")
    flags = [r[IS_TEST] for r in add_holdout_flag(df, "timestamp").collect()]
    assert sum(flags) == 2
    results = train_models(df, "y", "timestamp", {"selected_models": ["linear_regression", "ridge"],
                                                  "cross_validation_folds": 2}, 1)
    assert all(r.metrics["rmse"] is not None for r in results)
    board = create_leaderboard(results, {"sort_by": "nonsense"})
    assert [r["model"] for r in board.collect()] == [r.model_name for r in ranked(results, {})]
    assert select_best(results, {}).model_name == board.first()["model"]
    assert "Scan ExistingRDD" in plan(board) and "Aggregate" not in plan(board) and "Join" not in plan(board)
    with pytest.raises(ValueError, match="cannot be split"):
        add_holdout_flag(df.limit(1), "timestamp")


@pytest.mark.parametrize("rule, kind, width, multiple", [
    ("1h30min", "fixed", 5_400_000_000, 1), ("100ms", "fixed", 100_000, 1), ("5us", "fixed", 5, 1), ("2W", "week", 0, 2),
    ("W-MON", "week", 0, 1), ("3M", "month_end", 0, 3), ("2MS", "month_start", 0, 2), ("h", "fixed", 3_600_000_000, 1)])
def test_rules(rule, kind, width, multiple):
    r = parse_rule(rule)
    assert (r.kind, r.width_us, r.multiple) == (kind, width, multiple)


@pytest.mark.parametrize("rule", ["", "B", "1h30", "0h", "W-XYZ", "0W", "min30", "-1h"])
def test_bad_rules(rule):
    with pytest.raises(ValueError):
        parse_rule(rule)


@pytest.mark.parametrize("rule", ["2W", "W-WED", "3ME", "2MS", "2QE", "2YS", "1h30min", "7h"])
def test_rules_equal_pandas(spark, rule):
    import pandas as pd
    rng = np.random.default_rng(1)
    ts = pd.Timestamp("2023-02-10 05:00") + pd.to_timedelta(np.sort(rng.choice(60 * 24 * 700, 400, replace=False)), "min")
    pdf = pd.DataFrame({"timestamp": ts, "x": rng.normal(size=400)})
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    for agg in ("mean", "count"):
        want = getattr(pdf.set_index("timestamp").resample(rule), agg)()
        want = want.dropna() if agg == "mean" else want
        got = resample_timeseries(df, "timestamp", rule, agg).orderBy("timestamp").toPandas()
        assert got["timestamp"].tolist() == want.index.tolist()
        assert np.allclose(got["x"], want["x"])
