import datetime as dt

import pytest

from conftest import TEST_TZ
from pyspark.sql import functions as F

from trueline.operators.validate import check_series, dedupe_timestamps, validate_series
from trueline.sources.readers import scan_csv
from trueline.sources.sinks import write_csv


def test_empty_dataset_raises(spark):
    df = spark.createDataFrame([], "timestamp string, v double")
    with pytest.raises(ValueError, match="no rows"):
        validate_series(df)


def test_missing_timestamp_column_raises(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError, match="timestamp"):
        validate_series(df)


def test_all_bad_timestamps_raise(spark):
    df = spark.createDataFrame([("bad", 1.0), ("worse", 2.0)], "timestamp string, v double")
    with pytest.raises(ValueError, match="can be read as a timestamp"):
        validate_series(df)


def test_numeric_timestamp_column_is_rejected(spark):
    df = spark.createDataFrame([(1, 1.0)], "timestamp long, v double")
    with pytest.raises(TypeError):
        validate_series(df)


def test_parse_drop_and_dedupe_deterministic(spark):
    rows = [("2024-01-01 00:00:00", 3.0, None), ("2024-01-01 00:00:00", 1.0, 5.0),
            ("2024-01-01 00:00:00", None, 9.0), ("nope", 1.0, 1.0), ("2024-01-01 01:00:00", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "timestamp string, a double, b double")
    out = validate_series(df).orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 1)]
    # copies: smallest remaining columns win, NULLs first
    assert out[0].a is None and out[0].b == 9.0
    assert validate_series(df.repartition(3)).orderBy("timestamp").collect() == out


def test_dedupe_per_key(spark):
    df = spark.createDataFrame([("k1", dt.datetime(2024, 1, 1), 1.0), ("k2", dt.datetime(2024, 1, 1), 2.0),
                                ("k1", dt.datetime(2024, 1, 1), 0.5)], "k string, timestamp timestamp_ntz, v double")
    out = {(r.k, r.v) for r in dedupe_timestamps(df, keys=["k"]).collect()}
    assert out == {("k1", 0.5), ("k2", 2.0)}


def test_dst_gap_timestamp_survives_non_utc_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00", 1.0)], "timestamp string, v double")
        out = validate_series(df).collect()
        assert out[0].timestamp == dt.datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", TEST_TZ)


def test_csv_roundtrip_keeps_microseconds(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575), 1.5)], "timestamp timestamp_ntz, v double")
    path = str(tmp_path / "out")
    write_csv(df, path)
    back = validate_series(scan_csv(spark, path)).collect()
    assert back[0].timestamp == dt.datetime(2024, 1, 1, 0, 0, 7, 179575) and back[0].v == 1.5


def test_check_series_reads_only_timestamp(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0)], "timestamp string, v double")
    check_series(validate_series(df, check=False))
