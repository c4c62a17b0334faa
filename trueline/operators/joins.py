"""Joins on series keys.

Keys are compared as one struct, in which NULL fields are equal, so a
series whose key is NULL keeps its rows like any other.  Small per-key
tables reach the rows without shuffling the rows by key: see :func:`attach`.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage_counted

KEY = "__series"
SALT = "__salt"
#: Largest estimated size of a per-key table that is broadcast, and the
#: number of copies of a larger one.
BROADCAST_BYTES = 32 << 20
SALTS = 64
_ROW_BYTES, _CELL_BYTES = 64, 24


def with_series(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(KEY, F.struct(*keys))


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], extra: Sequence[str] = (),
               how: str = "inner") -> DataFrame:
    """Join on the keys (NULL-safe) and the ``extra`` columns."""
    keys, extra = list(keys), list(extra)
    if not keys:
        return left.join(right, on=extra, how=how)
    return with_series(left, keys).join(with_series(right, keys).drop(*keys), on=[KEY, *extra], how=how).drop(KEY)


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], extra: Sequence[str] = (),
           how: str = "left", rows: int | None = None, array_bytes: int = 0) -> DataFrame:
    """Join a table with a few rows per key onto ``df``'s rows.

    The table is checkpointed and counted (unless the caller knows its
    ``rows``; ``array_bytes`` is the size of a row's arrays); up to an estimated
    ``BROADCAST_BYTES`` it is broadcast, so the rows stay
    where they are.  A larger one is repeated ``SALTS`` times and joined on
    (key, salt), with the salt from a hash of the whole row, so one series is
    spread over up to ``SALTS`` tasks.
    """
    if rows is None:
        table, rows = cut_lineage_counted(table)
    if rows * (_ROW_BYTES + _CELL_BYTES * len(table.columns) + array_bytes) <= BROADCAST_BYTES:
        return keyed_join(df, F.broadcast(table), keys, extra, how)
    copies = table.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn(SALT, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return keyed_join(salted, copies, keys, [*extra, SALT], how).drop(SALT)
