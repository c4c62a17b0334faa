"""Partition-independent pseudo-random draws keyed by (keys, timestamp).

A row's draw depends only on its own key values, its timestamp and the seed,
so hold-out membership and fold ids survive recomputation after a lost
executor, re-partitioning and AQE re-plans (``rand()`` does not).
The same integer is reproducible in DuckDB:
``('0x' || substr(md5(s), 1, 8))::UBIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecols import epoch_us

KEY_SEPARATOR = "|"


def hash_input(ts, keys=(), salt: str = "") -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    parts.append(epoch_us(ts).cast("string"))
    return F.concat_ws(KEY_SEPARATOR, *parts, F.lit(salt))


def hash_uint32(ts, keys=(), salt: str = "") -> Column:
    """First 32 bits of md5(keys|epoch_us|salt) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(hash_input(ts, keys, salt)), 1, 8), 16, 10).cast("bigint")


def split_salt(seed: int) -> str:
    return f"split:{int(seed)}"


def fold_salt(seed: int) -> str:
    return f"fold:{int(seed)}"
