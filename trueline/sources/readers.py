"""Sources.  Paths (CSV or Parquet) or DataFrames."""

from __future__ import annotations

from typing import Sequence, Union

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.validate import validate_series

Source = Union[str, DataFrame]


# CSV texts read as missing.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _present(name: str) -> Column:
    """The text, or NULL for a missing-value token."""
    return F.when(~F.trim(F.col(f"`{name}`")).isin(*NULL_TOKENS), F.col(f"`{name}`"))


def infer_types(text: DataFrame, ts: str) -> StructType:
    """Types of all-text columns from one aggregation: boolean, long or
    double if every present value is one, else string (also the timestamp)."""
    names = [c for c in text.columns if c != ts]
    tests = {"boolean": lambda v: F.lower(F.trim(v)).isin("true", "false"),
             "long": lambda v: v.rlike(r"^\s*[+-]?[0-9]+\s*$") & v.try_cast("bigint").isNotNull(),
             "double": lambda v: v.try_cast("double").isNotNull()}
    aggs = [F.count(_present(c)).alias(f"n{i}") for i, c in enumerate(names)]
    aggs += [F.count(F.when(test(_present(c)), 1)).alias(f"{kind}{i}")
             for i, c in enumerate(names) for kind, test in tests.items()]
    row = text.agg(*aggs).first() if names else None
    types = {ts: "string"}
    for i, c in enumerate(names):
        present = row[f"n{i}"]
        # a column without any value is numeric, as an all-missing column is
        types[c] = next((k for k in tests if present and row[f"{k}{i}"] == present), "string" if present else "double")
    return reduce(lambda s, c: s.add(c, types[c]), text.columns, StructType())


def scan_csv(spark: SparkSession, path: str, ts: str = "timestamp", schema: StructType | None = None,
             options: dict | None = None) -> DataFrame:
    """CSV with a header.  Missing-value tokens (``NULL_TOKENS``) become
    NULL in every column.  Types are inferred over all rows (one extra read)
    or taken from ``schema`` (no extra read; values that do not fit are
    NULL).  The timestamp column stays text for validation to parse, so a bad
    value cannot turn the whole column into strings or zones.  ``options``
    go to Spark's CSV reader."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").options(**(options or {}))
    if schema is not None:
        reader = reader.schema(StructType([StructField(f.name, StringType(), True) for f in schema.fields]))
    text = reader.csv(path)
    types = infer_types(text, ts) if schema is None else schema
    return text.select(*[_present(f.name).alias(f.name) if f.name == ts or isinstance(f.dataType, StringType)
                         else F.trim(_present(f.name)).try_cast(f.dataType).alias(f.name) for f in types.fields])


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_frame(source: Source, spark: SparkSession | None = None, ts: str = "timestamp",
               schema: StructType | None = None, options: dict | None = None) -> DataFrame:
    """A DataFrame passes through; a path is read by its suffix (``.csv``,
    ``.csv.gz``, or a glob or folder of them written as ``…csv/``), else as
    Parquet.  ``schema`` and ``options`` are for CSV."""
    if isinstance(source, DataFrame):
        return source
    if spark is None:
        spark = SparkSession.getActiveSession()
    path = str(source)
    if path.lower().rstrip("/").endswith((".csv", ".csv.gz")):
        return scan_csv(spark, path, ts, schema, options)
    return scan_parquet(spark, path)


def load_and_validate_dataset(source: Source, ts: str = "timestamp", name: str = "dataset",
                              keys: Sequence[str] = (), spark: SparkSession | None = None,
                              check: bool = True, schema: StructType | None = None,
                              options: dict | None = None, timestamp_format: str | None = None) -> DataFrame:
    """S3: source → validation."""
    return validate_series(scan_frame(source, spark, ts, schema, options), ts, keys, name, check, timestamp_format)
