"""Connected components of a distributed edge list (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trueline.llm.common import stage


def _pull(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """Join (u, v) with the staged (u, m); both sides are plain exchanges, so
    the edges of a hub are split among tasks."""
    return edges.join(lowest, "u")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns ``a``, ``b``;
    order, repeats and self-loops do not matter) that is not its own root;
    the root is the smallest node of the component.

    Large-star links every larger neighbour of a node to the smallest node
    it knows, small-star does so for the smaller ones; both keep the
    components.  They alternate until the edges are stars, in a number of
    rounds that grows with the logarithm of the longest chain.  All state
    is staged tables.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = stage(_pull(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .distinct(), "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = _pull(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, seen = seen, _fingerprint(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
