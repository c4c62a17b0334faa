"""Shared helpers: the shared work folder, staged tables, distributed ranks."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trueline.session import checkpoint_dir


_written: list[str] = []


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what this process staged so far.  Call it once the results that
    read these tables have been written."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint (a lost executor only
    recomputes from these files) but stores compressed columns.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets_for(rows: int) -> int:
    """Number of rank buckets: about sqrt(rows), so neither the rows of a
    bucket nor the buckets of a group grow faster than that."""
    return max(1, math.isqrt(max(0, rows)))


def running_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Dense 0-based rank of each row within ``group``, ordered by
    ``(bucket, *order)``, without collecting a group into one task.

    Rows of one (group, bucket) are numbered by a window; bucket offsets are
    running sums over the (group, bucket) counts, a table of at most
    ``buckets`` rows per group.  ``group`` and ``bucket`` must not be null.
    With an empty ``group`` the running sum covers one row per bucket.
    """
    keys = [*group, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(bucket)
    offsets = counts.select(*keys, (F.sum("__n").over(w) - F.col("__n")).alias("__before"))
    inner = Window.partitionBy(*keys).orderBy(*order)
    return (df.join(offsets, keys)
            .withColumn(out, F.col("__before") + F.row_number().over(inner) - 1)
            .drop("__before"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
