"""Fitted per-series parameters and how they reach the rows.

Statistics are computed with one ``groupBy(keys).agg`` (partial aggregation
runs map-side).  With no keys the result is one row; it is read on the
driver and inlined as literals, so applying it is a plain projection with no
join.  With keys the table has one row per key; it is checkpointed, counted
and attached by :func:`trueline.operators.joins.attach` (broadcast below a
size bound, salted beyond it), so rows are never shuffled by key alone.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage_counted
from .joins import attach


class Params:
    def __init__(self, table: DataFrame, keys: Sequence[str] = ()):
        self.keys = list(keys)
        self._row = None
        if self.keys:
            self.table, self.rows = cut_lineage_counted(table)
        else:
            self._row = table.first()
            if self._row is None:
                raise ValueError("cannot fit parameters on an empty dataset")
            self.table = table.sparkSession.createDataFrame([self._row], table.schema)

    def value(self, name: str):
        """Driver-side value (unkeyed parameters only)."""
        if self._row is None:
            raise ValueError("keyed parameters have no single value")
        return self._row[name]

    def col(self, name: str) -> Column:
        if self._row is not None:
            v = self._row[name]
            dtype = self.table.schema[name].dataType.simpleString()
            return F.lit(v).cast(dtype)
        return F.col(f"__p_{name}")

    def attach(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        if self._row is not None:
            return df
        small = self.table.select(*self.keys, *[F.col(n).alias(f"__p_{n}") for n in names])
        return attach(df, small, self.keys, rows=self.rows)

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c.startswith("__p_")])

    def apply(self, df: DataFrame, names: Sequence[str], columns: dict[str, Column]) -> DataFrame:
        """Replace / add ``columns`` (built with :meth:`col`) keeping column order."""
        joined = self.attach(df, names)
        out = [columns[c].alias(c) if c in columns else F.col(c) for c in df.columns]
        out += [v.alias(k) for k, v in columns.items() if k not in df.columns]
        return joined.select(*out)


def fit(df: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> Params:
    keys = list(keys)
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    table = grouped.agg(*[v.alias(k) for k, v in stats.items()])
    return Params(table, keys)
