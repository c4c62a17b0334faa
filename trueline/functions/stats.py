"""Aggregate expressions shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_pearson(a, b) -> Column:
    """Pearson correlation over rows where both sides are non-null.

    NULL (not an error) when either side is constant or there are no pairs;
    ``F.corr`` raises DIVIDE_BY_ZERO under ANSI mode on a constant series.
    """
    a, b = _c(a), _c(b)
    both = a.isNotNull() & b.isNotNull()
    am, bm = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(am, bm), F.stddev_pop(am) * F.stddev_pop(bm))


def safe_pearson_sql(a: str, b: str) -> str:
    """:func:`safe_pearson` as SQL text over two column names."""
    both = f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL"
    am, bm = f"CASE WHEN {both} THEN `{a}` END", f"CASE WHEN {both} THEN `{b}` END"
    return f"try_divide(covar_pop({am}, {bm}), stddev_pop({am}) * stddev_pop({bm}))"


def first_value(v, ts) -> Column:
    """First non-null value by timestamp."""
    v = _c(v)
    return F.min_by(v, F.when(v.isNotNull(), _c(ts)))


def last_value(v, ts) -> Column:
    v = _c(v)
    return F.max_by(v, F.when(v.isNotNull(), _c(ts)))


@dataclass(frozen=True)
class Aggregation:
    """How one resample aggregation name maps to Spark.

    ``empty`` is the value of a bucket with no rows (between the first and
    last bucket).  None means the bucket is NaN in pandas and so disappears
    with the all-null row drop; a number means the bucket is kept.
    """
    build: Callable[[Column, Column], Column]
    empty: float | None
    numeric_only: bool


# The resample aggregation names accepted, with pandas'
# value for an empty bucket (None = NaN, dropped).
AGGREGATIONS: dict[str, Aggregation] = {
    "mean": Aggregation(lambda v, ts: F.avg(v), None, True),
    "median": Aggregation(lambda v, ts: F.percentile(v, 0.5), None, True),
    "min": Aggregation(lambda v, ts: F.min(v), None, False),
    "max": Aggregation(lambda v, ts: F.max(v), None, False),
    "std": Aggregation(lambda v, ts: F.stddev_samp(v), None, True),
    "var": Aggregation(lambda v, ts: F.var_samp(v), None, True),
    "sem": Aggregation(lambda v, ts: F.stddev_samp(v) / F.sqrt(F.count(v)), None, True),
    "first": Aggregation(first_value, None, False),
    "last": Aggregation(last_value, None, False),
    "sum": Aggregation(lambda v, ts: F.coalesce(F.sum(v), F.lit(0)), 0.0, True),
    "prod": Aggregation(lambda v, ts: F.coalesce(F.product(v), F.lit(1.0)), 1.0, True),
    "count": Aggregation(lambda v, ts: F.count(v), 0, False),
    "nunique": Aggregation(lambda v, ts: F.count_distinct(v), 0, False),
}
REJECTED_AGGREGATIONS = {
    "size": "returns one unnamed column, so the target column disappears",
    "ohlc": "returns four columns per input column, so the target column disappears",
}


def aggregation(name: str) -> Aggregation:
    if name in REJECTED_AGGREGATIONS:
        raise ValueError(f"aggregation {name!r} is not supported: {REJECTED_AGGREGATIONS[name]}")
    if name not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {name!r}; choose one of {sorted(AGGREGATIONS)}")
    return AGGREGATIONS[name]
