"""A2: resample a series to a time grid and aggregate every column.

Fixed rules label a bucket by its start; the grid origin is midnight of the
series' first day (per key), as pandas does.  When the width divides a day
the origin does not matter and no extra pass is made.  Calendar rules number
their periods; multiples count from the series' first period.  Buckets are
``groupBy(keys, bucket)`` aggregations with map-side partial aggregation.
Aggregations whose empty bucket is a number (sum, prod, count, nunique)
get a spine of every bucket from first to last per key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, BooleanType

from ..functions.rules import Rule, parse_rule
from ..functions.stats import aggregation
from ..functions.timecols import US_PER_DAY, epoch_us, from_epoch_us
from .joins import attach, keyed_join

_B = "__bucket"
#: Buckets of a spine that one row makes.
SPINE_BUCKETS = 1 << 14


def _period_number(ts: Column, r: Rule) -> Column:
    """Consecutive number of the week, month, quarter or year of ``ts``."""
    d = ts.cast("date")
    if r.kind == "week":
        first = (r.week_end + 1) % 7                   # the week's first day; day 0 was a Thursday
        return F.floor((F.unix_date(d).cast("bigint") + F.lit(3 - first)) / 7).cast("bigint")
    year = F.year(d).cast("bigint")
    if r.kind.startswith("month"):
        return year * 12 + F.month(d) - 1
    if r.kind.startswith("quarter"):
        return year * 4 + F.quarter(d) - 1
    return year


def _period_label(n: Column, r: Rule) -> Column:
    """First or last day of a period."""
    if r.kind == "week":
        first = (r.week_end + 1) % 7
        d = F.date_from_unix_date((n * 7 - F.lit(3 - first) + 6).cast("int"))
    else:
        per = {"m": 12, "q": 4, "y": 1}[r.kind[0]]
        year, month = F.floor(n / per).cast("int"), (F.pmod(n, F.lit(per)) * (12 // per) + 1).cast("int")
        d = F.make_date(year, month, F.lit(1))
        if r.kind.endswith("_end"):
            d = F.last_day(F.add_months(d, 12 // per - 1))
    return d.cast("timestamp_ntz")


def _from_first(df: DataFrame, keys: list[str], value: Column) -> tuple[DataFrame, Column]:
    """The smallest ``value`` of each row's series: a literal without keys, else
    attached without shuffling the rows by key."""
    if keys:
        return attach(df, df.groupBy(*keys).agg(F.min(value).alias("__origin")), keys), F.col("__origin")
    row = df.agg(F.min(value).alias("o")).first()
    return df, F.lit(int(row["o"] or 0)).cast("bigint")


def _bucket(df: DataFrame, ts: str, keys: list[str], r: Rule) -> tuple[DataFrame, Column]:
    """Bucket of each row: its start in microseconds (fixed rules) or its
    labelling period's number."""
    if r.kind != "fixed":
        p = _period_number(F.col(ts), r)
        if r.multiple == 1:
            return df, p
        df, origin = _from_first(df, keys, p)
        steps = (p - origin) / F.lit(r.multiple)
        # labelled by its last period, a bucket ends with it; else it starts there
        steps = F.floor(steps) if r.kind.endswith("_start") else F.ceil(steps)
        return df, origin + steps.cast("bigint") * F.lit(r.multiple)
    t, w = epoch_us(ts), F.lit(r.width_us)
    if r.divides_day:
        return df, F.floor(t / w).cast("bigint") * w
    midnight = F.unix_date(F.col(ts).cast("date")).cast("bigint") * F.lit(US_PER_DAY)
    df, origin = _from_first(df, keys, midnight)
    return df, origin + F.floor((t - origin) / w).cast("bigint") * w


def resample_timeseries(df: DataFrame, ts: str = "timestamp", rule: str = "1h", aggregation_name: str = "mean",
                        keys: Sequence[str] = ()) -> DataFrame:
    """Bucket by ``rule`` and aggregate each non-key column with one name."""
    keys = list(keys)
    r = parse_rule(rule)
    agg = aggregation(aggregation_name)
    values = [c for c in df.columns if c != ts and c not in keys]
    if agg.numeric_only:
        bad = [f.name for f in df.schema.fields if f.name in values
               and (not isinstance(f.dataType, NumericType) or isinstance(f.dataType, BooleanType))]
        if bad:
            raise ValueError(f"aggregation {aggregation_name!r} needs numeric columns; not numeric: {bad}")
    src, bucket = _bucket(df, ts, keys, r)
    tsc = F.col(ts)
    if aggregation_name == "median" and values:
        grouped = _bucket_medians(src.withColumn(_B, bucket), keys, values)
    else:
        grouped = src.withColumn(_B, bucket).groupBy(*keys, _B).agg(
            *[agg.build(F.col(c), tsc).alias(c) for c in values])
    if agg.empty is None:
        out = grouped.dropna(how="all", subset=values) if values else grouped
    else:
        out = _with_spine(grouped, keys, values, r, agg.empty)
    label = from_epoch_us(F.col(_B)) if r.kind == "fixed" else _period_label(F.col(_B), r)
    return out.select(*keys, label.alias(ts), *values)


def _bucket_medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Exact per-bucket medians without a per-bucket buffer of all values
    (:mod:`trueline.operators.quantiles`; Spark's ``percentile`` when every
    bucket is small).  Buckets whose values are all NULL get no row, as the
    all-NULL drop would remove them anyway."""
    from .quantiles import exact_quantiles
    long = exact_quantiles(df, values, [0.5], [*keys, _B])
    return long.groupBy(*keys, _B).agg(*[
        F.first(F.when(F.col("column") == c, F.col("values")[0]), ignorenulls=True).alias(c) for c in values])


def _with_spine(grouped: DataFrame, keys: list[str], values: list[str], r: Rule, empty) -> DataFrame:
    """Every bucket between the first and last one per key; empty → ``empty``."""
    span = grouped.groupBy(*keys).agg(F.min(_B).alias("__lo"), F.max(_B).alias("__hi"))
    step = r.width_us if r.kind == "fixed" else r.multiple
    # starts of stretches first, dealt out over the tasks, then the buckets
    # inside each: no row ever holds a series' whole spine
    stretch = SPINE_BUCKETS * step
    starts = span.where("__lo is not null").select(*keys, "__hi", F.explode(
        F.sequence(F.col("__lo"), F.col("__hi"), F.lit(stretch).cast("bigint"))).alias("__from"))
    last = F.least(F.col("__hi"), F.col("__from") + F.lit(stretch - step))
    spine = starts.repartition(*keys, "__from").select(*keys, F.explode(
        F.sequence(F.col("__from"), last, F.lit(step).cast("bigint"))).alias(_B))
    joined = keyed_join(spine, grouped, keys, [_B], "left")
    fills = {c: F.coalesce(F.col(c), F.lit(empty).cast(grouped.schema[c].dataType)) for c in values}
    return joined.select(*keys, _B, *[fills[c].alias(c) for c in values])
