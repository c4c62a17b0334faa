"""Series validation: parse timestamps, drop bad ones, deduplicate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import to_ntz


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "dataset") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: column(s) {missing} are missing")


def coerce_timestamp(df: DataFrame, ts: str = "timestamp", name: str = "dataset",
                     fmt: str | None = None) -> DataFrame:
    """the timestamp column as ``timestamp_ntz``; unparseable values → NULL.

    Text is ISO, or of the pattern ``fmt``.  Text that carries an offset is an
    instant and is brought to UTC; text without one is taken as it stands."""
    require_columns(df, [ts], name)
    return df.withColumn(ts, to_ntz(ts, df.schema[ts].dataType, fmt))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN readings as NULL, in every float and double column."""
    cols = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields
            if f.dataType.simpleString() in ("float", "double")}
    return df.withColumns(cols) if cols else df


def drop_bad_timestamps(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """drop rows whose timestamp is NULL."""
    return df.where(F.col(ts).isNotNull())


def check_series(df: DataFrame, ts: str = "timestamp", name: str = "dataset") -> int:
    """F3 guards, one small action reading only the timestamp column.

    Raises when the dataset is empty or no timestamp parsed; returns the
    row count (an upper bound on the rows after validation).
    """
    require_columns(df, [ts], name)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(ts).alias("good")).first()
    if row["n"] == 0:
        raise ValueError(f"{name}: there are no rows")
    if row["good"] == 0:
        raise ValueError(f"{name}: no value of '{ts}' can be read as a timestamp")
    return int(row["n"])


def dedupe_timestamps(df: DataFrame, ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """A1: one row per (keys, timestamp).

    Among copies the row whose remaining columns are smallest (in column
    order, NULLs first) wins, so the choice is deterministic.  Done as an
    aggregation rather than a ``row_number`` window so that copies collapse
    map-side before the shuffle: a timestamp with millions of copies costs
    one row per map task, not one giant sorted group.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != ts]
    if not rest:
        return df.select(*keys, ts).distinct()
    picked = df.groupBy(*keys, ts).agg(F.min(F.struct(*rest)).alias("__row"))
    out = picked.select(*keys, ts, *[F.col("__row")[c].alias(c) for c in rest])
    return out.select(*df.columns)


def sort_series(df: DataFrame, ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """O1: order by (keys, timestamp).  Only useful right before a sink;
    inside the library order lives in window specifications."""
    return df.orderBy(*keys, ts)


def validate_series(df: DataFrame, ts: str = "timestamp", keys: Sequence[str] = (),
                    name: str = "dataset", check: bool = True, fmt: str | None = None) -> DataFrame:
    """F1 (and NaN → NULL) → F3 → F2 → A1.  The result has unique (keys,
    timestamp).  A NULL key is a series of its own."""
    parsed = nan_to_null(coerce_timestamp(df, ts, name, fmt))
    if check:
        check_series(parsed, ts, name)
    return dedupe_timestamps(drop_bad_timestamps(parsed, ts), ts, keys)
