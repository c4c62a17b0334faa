"""Exact quantiles (linear interpolation, as pandas) without one big buffer.

Spark's ``percentile`` keeps a value → count map per group and merges it in
one task, which is impossible for one series of billions of readings.
Here the order statistics are found by selection:

1. one aggregation over the wide rows gives n, min and max per (keys,
   column); the quantile q needs the values of rank ⌊q(n−1)⌋ and ⌈q(n−1)⌉;
2. while a rank's value interval holds more than ``final_rows`` rows, one
   pass takes approximate quantiles of the interval as edges and the next
   counts rows per bucket exactly; every edge value is a bucket of its own.
   The interval shrinks to the [min, max] of the bucket that holds the rank.
   Edges follow the values, so a bucket between edges holds about
   1/``EDGES`` of the interval's rows whatever their spread, and a heavily
   repeated value becomes a resolved bucket at once;
3. the few remaining rows of each unresolved interval are sorted inside
   one aggregate (bounded by ``final_rows``) and the rank is picked.

Groups up to ``final_rows`` * ``FINEST`` / 8 values (:func:`_between_brackets`; of
8 ``DIGEST`` values on average, as below that a digest is as long as the values)
need two aggregations of the wide rows: digests merged per (keys, column) give
two values around each wanted rank, then the rows outside are counted and only
the values strictly between are gathered.  Digests are the finer the larger the
groups (:func:`_accuracy`), so these stay about ``BETWEEN`` values.  No cell is
exploded or moved by key.  A table of at most ``final_rows`` rows in all is sorted at once.
All ways end in the same interpolation of the two order statistics, so results
do not depend on the way, bit for bit.

Interval tables have a few rows per (keys, column); they are checkpointed
between passes and attached to the rows without shuffling them by key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_lineage_counted
from .joins import attach, keyed_join

FINAL_ROWS = 1_000_000
EDGES = 63
#: A digest's rank error is one in so many.
DIGEST = 200
#: In large groups finer, so that about so many values are between two
#: brackets: one in up to ``FINEST``, and all digests of a task together hold
#: about so many entries.
BETWEEN = 50_000
FINEST = 10_000
DIGEST_ENTRIES = 2_000_000


def long_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, column, v) for the non-null values of ``columns``."""
    keys = list(keys)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    return (df.select(*keys, F.explode(cells).alias("cell")).select(*keys, "cell.column", "cell.v")
            .where(F.col("v").isNotNull() & ~F.isnan("v")))


def value_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys…, column, n, lo, hi) from one aggregation of the wide rows."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"__n{i}"), F.min(v).alias(f"__lo{i}"), F.max(v).alias(f"__hi{i}")]
    wide = (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("n"), F.col(f"__lo{i}").alias("lo"),
                               F.col(f"__hi{i}").alias("hi")) for i, c in enumerate(columns)])
    return wide.select(*keys, F.explode(cells).alias("s")).select(*keys, "s.*").where("n > 0")


def interpolated(lo: Column, hi: Column, frac: Column) -> Column:
    """The one interpolation of two neighbouring order statistics."""
    return lo + frac * (hi - lo)


def _sorted_quantile(vs: Column, n: Column, q: float) -> Column:
    h = F.lit(float(q)) * (n - 1)
    at = lambda r: F.element_at(vs, (r + 1).cast("int"))
    return interpolated(at(F.floor(h)), at(F.ceil(h)), h - F.floor(h))


def _clean(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _accuracy(largest: int, cells: int) -> int:
    """How fine digests of ``cells`` (keys, column) are, the largest of ``largest`` values."""
    return max(DIGEST, min(-(-6 * largest // BETWEEN), FINEST, DIGEST_ENTRIES // max(1, cells)))


def _between_brackets(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: list,
                      accuracy: int) -> DataFrame | None:
    """``exact_quantiles`` by one pass of digests and one of counts; None if a
    digest was further off than it promises."""
    shares = [min(1.0, max(0.0, q + side * 3 / accuracy)) for q in probs for side in (-1, 1)]
    aggs = []
    for i, c in enumerate(columns):
        v = _clean(c)
        digest = F.percentile_approx(v, F.array(*map(F.lit, shares)), F.lit(accuracy))
        # beyond the first and the last share the bracket is the least and the largest value
        ends = F.array(*[F.min(v) if s <= 0 else F.max(v) if s >= 1 else digest[k] for k, s in enumerate(shares)])
        aggs += [F.count(v).alias(f"__n{i}"), ends.alias(f"__e{i}")]
    grouped = lambda frame: frame.groupBy(*keys) if keys else frame.groupBy()
    table, n_rows = cut_lineage_counted(grouped(df).agg(*aggs))
    names = [f"__{x}{i}" for i in range(len(columns)) for x in "ne"]
    rows = df.select(*keys, *dict.fromkeys(columns))
    if keys:
        rows = attach(rows, table, keys, rows=n_rows, array_bytes=16 * len(shares) * len(columns))
    else:
        one = table.first()
        rows = rows.select("*", *[(F.array(*[F.lit(x).cast("double") for x in (one[m] or [None] * len(shares))])
                                   if isinstance(one[m], list) or one[m] is None else F.lit(one[m])).alias(m) for m in names])
    aggs = [F.first(m).alias(m) for m in names]
    for i, c in enumerate(columns):
        v = _clean(c)
        for j in range(len(probs)):
            lo, hi = F.col(f"__e{i}")[2 * j], F.col(f"__e{i}")[2 * j + 1]
            aggs += [F.count(F.when(v < lo, 1)).alias(f"__b{i}_{j}"), F.count(F.when(v == lo, 1)).alias(f"__l{i}_{j}"),
                     F.count(F.when(v == hi, 1)).alias(f"__h{i}_{j}"),
                     F.sort_array(F.collect_list(F.when((v > lo) & (v < hi), v))).alias(f"__m{i}_{j}")]
    found = cut_lineage(grouped(rows).agg(*aggs))
    cells, sound = [], F.lit(True)
    for i, c in enumerate(columns):
        n, values = F.col(f"__n{i}"), []
        for j, q in enumerate(probs):
            lo, hi = F.col(f"__e{i}")[2 * j], F.col(f"__e{i}")[2 * j + 1]
            below, middle = F.col(f"__b{i}_{j}"), F.col(f"__m{i}_{j}")
            start = below + F.col(f"__l{i}_{j}")
            at = lambda r: (F.when(r < start, lo).when(r < start + F.size(middle), F.get(middle, (r - start).cast("int")))  # noqa: B023, E731
                            .otherwise(hi))
            h = F.lit(float(q)) * (n - 1)
            values.append(interpolated(at(F.floor(h)), at(F.ceil(h)), h - F.floor(h)))
            end = start + F.size(middle) + F.when(lo < hi, F.col(f"__h{i}_{j}")).otherwise(0)
            sound = sound & ((n == 0) | ((F.floor(h) >= below) & (F.ceil(h) < end)))
        cells.append(F.struct(F.lit(c).alias("column"), n.alias("n"), F.array(*values).alias("values")))
    if not found.agg(F.coalesce(F.min(sound), F.lit(True))).first()[0]:
        return None
    return found.select(*keys, F.explode(F.array(*cells)).alias("c")).where("c.n > 0").select(*keys, "c.column", "c.values")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
                    final_rows: int | None = None, row_bound: int | None = None) -> DataFrame:
    """``(keys…, column, values)`` where ``values[i]`` is the probs[i]
    quantile of the column's non-null values in that key.

    ``row_bound``, an upper bound on the rows of ``df`` (e.g. the count made
    by validation), lets small inputs skip the group-size pass."""
    final_rows = FINAL_ROWS if final_rows is None else int(final_rows)
    keys = list(keys)
    group = [*keys, "column"]

    def direct() -> DataFrame:
        vs = long_values(df, columns, keys).groupBy(*group).agg(F.sort_array(F.collect_list("v")).alias("vs"))
        return vs.select(*group, F.array(*[_sorted_quantile(F.col("vs"), F.size("vs"), q) for q in probs])
                         .alias("values"))

    if row_bound is not None and row_bound <= final_rows:
        return direct()
    stats, cells = cut_lineage_counted(value_stats(df, columns, keys))
    largest, mean = stats.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    if largest <= final_rows and mean < 8 * DIGEST:
        return direct()                 # a digest of so few values would be the values
    # the values between two brackets are less than 8 / accuracy of a group
    accuracy = _accuracy(largest, cells)
    if largest <= final_rows * accuracy // 8:
        quick = _between_brackets(df, columns, probs, keys, accuracy)
        if quick is not None:
            return quick
    ranks = []
    for i, q in enumerate(probs):
        h = F.lit(float(q)) * (F.col("n") - 1)
        ranks.append(F.struct(F.lit(i).alias("qi"), F.floor(h).cast("bigint").alias("r_lo"),
                              F.ceil(h).cast("bigint").alias("r_hi"), (h - F.floor(h)).alias("frac")))
    wanted = cut_lineage(stats.select(*group, "n", "lo", "hi", F.explode(F.array(*ranks)).alias("t")).select(
        *group, "n", "lo", "hi", "t.*"))
    targets = wanted.select(*group, F.explode(F.array_distinct(F.array("r_lo", "r_hi"))).alias("rank"), "n", "lo", "hi") \
        .distinct().select(*group, "rank", F.col("lo").alias("a"), F.col("hi").alias("b"),
                           F.lit(0).cast("bigint").alias("below"), F.col("n").alias("cnt"))
    resolved = []

    def rows_in(intervals: DataFrame, n: int) -> DataFrame:
        """The values inside open intervals (only those columns are exploded)."""
        return attach(long_values(df, columns, keys), intervals, keys, ["column"], "inner", n).where(
            F.col("v").between(F.col("a"), F.col("b")))

    while True:
        targets = cut_lineage(targets)
        done = targets.where(F.col("a") == F.col("b"))
        resolved.append(done.select(*group, "rank", F.col("a").alias("value")))
        open_ = targets.where(F.col("a") < F.col("b"))
        big, n_big = cut_lineage_counted(open_.where(F.col("cnt") > final_rows))
        if not n_big:
            break
        cuts = F.array(*[F.lit(i / (EDGES + 1)) for i in range(1, EDGES + 1)])
        edges, n_edges = cut_lineage_counted(rows_in(big, n_big).groupBy(*group, "rank", "below", "a", "b").agg(
            F.array_distinct(F.percentile_approx("v", cuts, F.lit(100 * EDGES))).alias("edges")))
        # 2·(edges below) + (on an edge): an edge value is a bucket of its own
        bucket = F.expr("aggregate(edges, 0, (n, e) -> n + if(e < v, 2, if(e = v, 1, 0)))")
        hist = rows_in(edges, n_edges).groupBy(*group, "rank", "below", bucket.alias("bk")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("bmin"), F.max("v").alias("bmax"))
        w = Window.partitionBy(*group, "rank").orderBy("bk").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.col("below") + F.sum("c").over(w))
        chosen = hist.where((F.col("upto") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        refined = chosen.select(*group, "rank", F.col("bmin").alias("a"), F.col("bmax").alias("b"),
                                (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("cnt"))
        targets = open_.where(F.col("cnt") <= final_rows).unionByName(refined)
    small, n_small = cut_lineage_counted(targets.where((F.col("a") < F.col("b")) & (F.col("cnt") <= final_rows)))
    picked = (rows_in(small, n_small).groupBy(*group, "rank", "below")
              .agg(F.sort_array(F.collect_list("v")).alias("vs"))
              .select(*group, "rank", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value")))
    found = picked
    for part in resolved:
        found = found.unionByName(part)
    found = cut_lineage(found)
    lo = found.select(*group, F.col("rank").alias("r_lo"), F.col("value").alias("v_lo"))
    hi = found.select(*group, F.col("rank").alias("r_hi"), F.col("value").alias("v_hi"))
    per_q = keyed_join(keyed_join(wanted, lo, keys, ["column", "r_lo"]), hi, keys, ["column", "r_hi"]).select(
        *group, "qi", interpolated(F.col("v_lo"), F.col("v_hi"), F.col("frac")).alias("value"))
    result = per_q.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("qi", "value"))).alias("s")) \
        .select(*group, F.transform("s", lambda x: x["value"]).alias("values"))
    return cut_lineage(result)


def exact_quantile_params(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str],
                          name: str, scalar: bool, row_bound: int | None = None) -> DataFrame:
    """Wide table (keys…, ``name``__<column>) for :class:`~trueline.operators.params.Params`:
    the single value when ``scalar`` else the array in ``probs`` order."""
    keys = list(keys)
    long = exact_quantiles(df, columns, probs, keys, row_bound=row_bound)
    col = F.col("values")[0] if scalar else F.col("values")
    long = long.select(*keys, "column", col.alias("p"))
    grouped = long.groupBy(*keys) if keys else long.groupBy()
    # a global aggregation returns its row even on empty input
    return grouped.agg(*[F.first(F.when(F.col("column") == c, F.col("p")), ignorenulls=True).alias(f"{name}__{c}")
                         for c in columns])
