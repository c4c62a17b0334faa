"""Sinks for calibrated data and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..ml.tree_grower import TreeModel


def write_csv(df: DataFrame, path: str, ts: str | None = "timestamp", mode: str = "overwrite") -> None:
    """CSV with a header, rows sorted by timestamp inside the output."""
    out = df.orderBy(ts) if ts and ts in df.columns else df
    (out.write.mode(mode).option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
     .csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_model(model: PipelineModel | TreeModel, path: str) -> None:
    """The fitted pipeline (assembler + regressor) or the node tables of a
    tree model, so feature order persists."""
    if isinstance(model, TreeModel):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | TreeModel:
    spark = SparkSession.active()
    about = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if about.getFileSystem(spark._jsc.hadoopConfiguration()).exists(about):
        return PipelineModel.load(path)
    return TreeModel.load(spark, path)
