"""Proportional stratified interleaving of documents into shards.

Rows are shuffled within their source by a seeded hash and ranked; row i of
a source of n rows gets the fractional rank (2 i + 1) / (2 n).  Sorted by
fractional rank the sources interleave in proportion to their sizes
everywhere, so cutting the order into shards of equal row counts gives every
shard the mixture of the whole: the law that holds is ``rows`` (counts at
most one apart).

Both ranks are distributed (:func:`trueline.llm.common.running_rank`): hash
values and fractional ranks are cut into about sqrt(rows) buckets of nearly
equal size, so neither a source with a third of all rows nor the global order
meets in one task.  Only (doc_id, source, size, checksum) moves, never text.

A null text counts as none (size 1, checksum 0); rows with a null source are a
source of their own; null and repeated doc_ids are rows like any other, and
rows equal in every respect are interchangeable.  Shards of fewer rows than
shards asked for may be empty.  Equal texts are not kept together: the
method interleaves rows.  Columns other than doc_id, text and source are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trueline.llm.common import buckets_for, running_rank, stage


def interleave(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, text_crc32, fraction, shard, slot) of every row."""
    base = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("stratum"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
    ).withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), 1)), "rows")
    rows = base.count()
    buckets = buckets_for(rows)
    bucket = lambda share: F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
    tie = [F.col("draw"), F.col("doc_id"), F.col("size")]
    totals = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_rank(base.withColumn("bucket", bucket(F.col("draw") / F.lit(2.0 ** 63))),
                          ["stratum"], "bucket", tie, "i").drop("bucket")
    ranked = stage(ranked, "source-ranks")
    fraction = (2 * F.col("i") + 1) / (2 * F.col("n"))
    placed = ranked.join(stage(totals, "source-sizes"), "stratum").withColumn("fraction", fraction)
    placed = running_rank(placed.withColumn("bucket", bucket(F.col("fraction"))),
                          [], "bucket", [F.col("fraction"), F.col("stratum"), *tie], "position")
    # Integer division: exact at any size.
    shard = F.expr(f"cast((position * {shards}L) div {max(rows, 1)}L as int)")
    first = F.expr(f"(shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L")
    return (placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first)
            .select("doc_id", "source", "size", "text_crc32", "fraction", "shard", "slot"))
