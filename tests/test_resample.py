import datetime as dt

import pandas as pd
import pytest

from conftest import TEST_TZ

from trueline.operators.resample import resample_timeseries


def series(spark, rows, schema="timestamp timestamp_ntz, v double"):
    return spark.createDataFrame(rows, schema)


def T(*a):
    return dt.datetime(*a)


def test_mean_hourly_matches_pandas(spark):
    rows = [(T(2024, 1, 1, 0, 10), 1.0), (T(2024, 1, 1, 0, 50), 3.0), (T(2024, 1, 1, 3, 5), 5.0)]
    out = resample_timeseries(series(spark, rows), "timestamp", "1h", "mean").orderBy("timestamp").collect()
    pdf = pd.DataFrame(rows, columns=["timestamp", "v"]).set_index("timestamp").resample("1h").agg("mean").dropna(how="all")
    assert [(r.timestamp, r.v) for r in out] == [(i.to_pydatetime(), v) for i, v in pdf["v"].items()]


def test_seven_hour_grid_starts_at_first_midnight(spark):
    rows = [(T(2020, 1, 3, 0, 10), 1.0), (T(2020, 1, 3, 8, 0), 2.0)]
    out = resample_timeseries(series(spark, rows), "timestamp", "7h").orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == [T(2020, 1, 3, 0), T(2020, 1, 3, 7)]


def test_two_streams_different_first_days_keep_own_origin(spark):
    a = resample_timeseries(series(spark, [(T(2020, 1, 3, 1), 1.0)]), "timestamp", "7h").collect()
    b = resample_timeseries(series(spark, [(T(2020, 1, 2, 1), 1.0), (T(2020, 1, 3, 1), 1.0)]), "timestamp", "7h")
    assert a[0].timestamp == T(2020, 1, 3, 0)
    assert sorted(r.timestamp for r in b.collect())[-1] == T(2020, 1, 2, 21)


def test_sum_and_count_keep_empty_buckets(spark):
    rows = [(T(2024, 1, 1, 0, 5), 1.0), (T(2024, 1, 1, 0, 6), None), (T(2024, 1, 1, 3, 0), 4.0)]
    s = resample_timeseries(series(spark, rows), "timestamp", "1h", "sum").orderBy("timestamp").collect()
    assert [r.v for r in s] == [1.0, 0.0, 0.0, 4.0]
    c = resample_timeseries(series(spark, rows), "timestamp", "1h", "count").orderBy("timestamp").collect()
    assert [r.v for r in c] == [1, 0, 0, 1]


def test_std_single_row_bucket_dropped_and_first_skips_nulls(spark):
    rows = [(T(2024, 1, 1, 0, 5), 1.0), (T(2024, 1, 1, 0, 6), 3.0), (T(2024, 1, 1, 2, 0), 4.0)]
    s = resample_timeseries(series(spark, rows), "timestamp", "1h", "std").collect()
    assert len(s) == 1
    rows = [(T(2024, 1, 1, 0, 5), None), (T(2024, 1, 1, 0, 6), 3.0), (T(2024, 1, 1, 0, 7), 4.0)]
    f = resample_timeseries(series(spark, rows), "timestamp", "1h", "first").collect()
    assert f[0].v == 3.0


def test_weekly_label_is_sunday_ending_week(spark):
    rows = [(T(2024, 1, 7, 10), 1.0), (T(2024, 1, 8, 0), 2.0)]   # Sunday, Monday
    out = resample_timeseries(series(spark, rows), "timestamp", "W").orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == [T(2024, 1, 7), T(2024, 1, 14)]


@pytest.mark.parametrize("rule,label", [("ME", T(2024, 2, 29)), ("MS", T(2024, 2, 1)), ("QE", T(2024, 3, 31)),
                                        ("QS", T(2024, 1, 1)), ("YE", T(2024, 12, 31)), ("YS", T(2024, 1, 1))])
def test_calendar_labels(spark, rule, label):
    out = resample_timeseries(series(spark, [(T(2024, 2, 10, 5), 1.0)]), "timestamp", rule).collect()
    assert out[0].timestamp == label


def test_string_column_under_mean_is_rejected(spark):
    df = spark.createDataFrame([(T(2024, 1, 1), "a")], "timestamp timestamp_ntz, s string")
    with pytest.raises(ValueError, match="numeric"):
        resample_timeseries(df, "timestamp", "1h", "mean")
    assert resample_timeseries(df, "timestamp", "1h", "max").collect()[0].s == "a"


@pytest.mark.parametrize("agg", ["size", "ohlc", "bogus"])
def test_rejected_aggregations(spark, agg):
    with pytest.raises(ValueError):
        resample_timeseries(series(spark, [(T(2024, 1, 1), 1.0)]), "timestamp", "1h", agg)


def test_dst_gap_bucket_under_new_york_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = resample_timeseries(series(spark, [(T(2024, 3, 10, 2, 30), 1.0)]), "timestamp", "1h").collect()
        assert out[0].timestamp == T(2024, 3, 10, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", TEST_TZ)


def test_keyed_resample(spark):
    df = spark.createDataFrame([("a", T(2024, 1, 1, 0, 1), 1.0), ("a", T(2024, 1, 1, 0, 2), 3.0),
                                ("b", T(2024, 1, 1, 0, 3), 10.0)], "k string, timestamp timestamp_ntz, v double")
    out = {(r.k, r.v) for r in resample_timeseries(df, "timestamp", "1h", "mean", ["k"]).collect()}
    assert out == {("a", 2.0), ("b", 10.0)}


def test_median_resample_by_selection_matches_pandas(spark, monkeypatch):
    import numpy as np
    import trueline.operators.quantiles as qmod
    monkeypatch.setattr(qmod, "FINAL_ROWS", 3)      # force histogram passes inside every bucket
    monkeypatch.setattr(qmod, "EDGES", 3)
    rng = np.random.default_rng(2)
    rows = [(T(2024, 1, 1) + dt.timedelta(minutes=int(m)), float(v), None if i % 7 == 0 else float(i % 5))
            for i, (m, v) in enumerate(zip(rng.integers(0, 300, 200), rng.normal(size=200)))]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, a double, b double")
    df = df.dropDuplicates(["timestamp"])
    got = {r.timestamp: (r.a, r.b) for r in resample_timeseries(df, "timestamp", "1h", "median").collect()}
    pdf = df.toPandas().set_index("timestamp").resample("1h").agg("median").dropna(how="all")
    assert len(got) == len(pdf)
    for t, row in pdf.iterrows():
        a, b = got[t.to_pydatetime()]
        assert abs(a - row["a"]) < 1e-12 and (b is None if pd.isna(row["b"]) else abs(b - row["b"]) < 1e-12)
