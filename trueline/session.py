"""Session helpers: a tuned builder and the reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "trueline",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the settings the library relies on.

    AQE stays on so joins against small per-key parameter tables turn into
    broadcast joins at run time from measured sizes, and skewed shuffle
    partitions are split.  The web UI stays off.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files go when the frame that wrote them is collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used for reliable checkpoints.

    Reads ``spark.checkpoint.dir`` from the session.  Only when it is unset
    and the master is local (tests, laptops) is a private temporary folder
    created; on a cluster an unset value is an error, because a machine-local
    folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) on a cluster")
        configured = tempfile.mkdtemp(prefix="trueline-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder).

    Lost executors then recompute from the checkpoint files rather than
    from the raw scan.  Never a local checkpoint.  The frame is persisted
    while it is written: an eager checkpoint of an unpersisted frame
    computes it twice (once to count, once to write).
    """
    return cut_lineage_counted(df)[0]


def cut_lineage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut_lineage` that also returns the row count (taken while the
    frame is cached, so it costs no extra pass)."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows = cached.count()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out, rows


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return build_session(master=f"local[{cores}]", shuffle_partitions=shuffle_partitions,
                         extra={"spark.driver.memory": os.environ.get("TRUELINE_DRIVER_MEMORY", "8g"),
                                "spark.sql.session.timeZone": "UTC"})
