"""Ordered windows over long series without a single-partition window.

A bare ``Window.orderBy(ts)`` makes Spark move the whole series into one
task.  Ordered operators here go through two steps instead:

1. :func:`dense_positions` numbers the rows of every series 0, 1, 2, …
   by timestamp.  Rows are grouped into coarse time blocks; the block sizes
   form a small table whose running sum gives each block's first position,
   and ``row_number`` inside a block adds the rest.  Only the block-count
   table is ever ordered as a whole.
2. :func:`halo_select` cuts the numbered rows into blocks of ``block_rows``
   positions and copies the few rows a window needs from each neighbouring
   block (the *halo*).  Windows then run partitioned by (keys, block), and
   only rows in their own block are kept.  Lags of up to ``back`` rows and
   leads of up to ``fwd`` rows see exactly the rows an unpartitioned window
   would see.

A series key holding a third of all rows is still cut into many blocks, so
no key becomes one task.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import US_PER_DAY, epoch_us
from .joins import KEY, with_series

POS = "__pos"
_BLK = "__tblk"
_OWN = "__own"
_GRP = "__grp"

DEFAULT_BLOCK_ROWS = 1 << 16


def dense_positions(df: DataFrame, ts: str, keys: Sequence[str] = (),
                    time_block_us: int = US_PER_DAY, pos_col: str = POS) -> DataFrame:
    """Add ``pos_col``: 0-based rank of the row by ``ts`` within its keys.

    Timestamps must be unique per key (true after validation or
    resampling).  Deterministic, so recomputation gives the same numbers.
    The block sizes are joined back onto the rows, so ``df`` is read twice:
    pass a persisted or checkpointed frame (the library's composite
    operators do: persisted grids, checkpointed aligned data).
    """
    keys = list(keys)
    blk = F.floor(epoch_us(ts) / F.lit(time_block_us)).cast("bigint")
    # one exchange by (keys, block) feeds both the block sizes and the row
    # numbers, so Spark reuses it and the input is computed once
    # (keys compare as one struct: a NULL key is a series like any other)
    series = [KEY] if keys else []
    with_blk = (with_series(df, keys) if keys else df).withColumn(_BLK, blk).repartition(*series, _BLK)
    sizes = with_blk.groupBy(*series, _BLK).agg(F.count(F.lit(1)).alias("__n"))
    offsets = _block_offsets(sizes, series)
    inner = Window.partitionBy(*series, _BLK).orderBy(ts)
    joined = with_blk.join(offsets, on=[*series, _BLK], how="inner")
    return joined.withColumn(pos_col, F.col("__off") + F.row_number().over(inner) - 1).drop(_BLK, "__off", KEY)


SUPER_BLOCK = 1024


def _block_offsets(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """First position of every block: running sums in two levels.

    Blocks are grouped by ⌊block / 1024⌋; running sums inside a group run
    partitioned by (keys, group), and only the table of group totals (1024×
    smaller than the block table) is ordered per key as a whole.
    """
    grouped = sizes.withColumn("__sb", F.floor(F.col(_BLK) / F.lit(SUPER_BLOCK)).cast("bigint"))
    inner = Window.partitionBy(*keys, "__sb").orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    totals = grouped.groupBy(*keys, "__sb").agg(F.sum("__n").alias("__tot"))
    outer = Window.partitionBy(*keys).orderBy("__sb").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__sb", F.coalesce(F.sum("__tot").over(outer), F.lit(0)).alias("__sbo"))
    return within.join(starts, on=[*keys, "__sb"]).select(
        *keys, _BLK, (F.col("__sbo") + F.col("__in")).alias("__off"))


def halo_select(df: DataFrame, keys: Sequence[str], back: int, fwd: int,
                build: Callable[[Window], list[Column]], pos_col: str = POS,
                block_rows: int = DEFAULT_BLOCK_ROWS, keep: Sequence[str] | None = None) -> DataFrame:
    """Select ``keep`` columns plus the window columns produced by ``build``.

    ``build`` receives ``Window.partitionBy(keys, block).orderBy(pos)`` and
    returns aliased columns; it may use lags up to ``back`` rows and leads
    up to ``fwd`` rows (rolling frames count as lags of ``size - 1``).
    """
    keys = list(keys)
    back, fwd = max(int(back), 0), max(int(fwd), 0)
    size = max(int(block_rows), 10 * max(back, fwd, 1))
    keep = list(df.columns) if keep is None else list(keep)
    pos = F.col(pos_col)
    own = F.floor(pos / F.lit(size)).cast("bigint")
    rem = pos - own * F.lit(size)
    targets = [own]
    if back:
        targets.append(F.when(rem >= F.lit(size - back), own + 1))
    if fwd:
        targets.append(F.when((rem < F.lit(fwd)) & (own > 0), own - 1))
    spread = df.withColumn(_OWN, own)
    spread = spread.withColumn(_GRP, F.explode(F.array_compact(F.array(*targets))) if len(targets) > 1 else own)
    w = Window.partitionBy(*keys, _GRP).orderBy(pos_col)
    spec = "PARTITION BY " + ", ".join(f"`{c}`" for c in [*keys, _GRP]) + f" ORDER BY `{pos_col}`"
    # columns may be Columns over ``w`` or SQL text with ``{w}`` standing
    # for the window specification (one parse instead of a call per node)
    cols = [F.expr(c.replace("{w}", spec)) if isinstance(c, str) else c for c in build(w)]
    out = spread.select(*keep, *cols, F.col(_OWN), F.col(_GRP))
    return out.where(F.col(_OWN) == F.col(_GRP)).drop(_OWN, _GRP)


def ordered_select(df: DataFrame, ts: str, keys: Sequence[str], back: int, fwd: int,
                   build: Callable[[Window], list[Column]], block_rows: int = DEFAULT_BLOCK_ROWS,
                   time_block_us: int = US_PER_DAY) -> DataFrame:
    """Positions then halo windows: all input columns plus ``build``'s columns."""
    numbered = dense_positions(df, ts, keys, time_block_us)
    return halo_select(numbered, keys, back, fwd, build, block_rows=block_rows, keep=list(df.columns))


def time_block_for(width_us: int | None, block_rows: int = DEFAULT_BLOCK_ROWS) -> int:
    """Time block for numbering: about ``block_rows`` grid steps, at least a day."""
    if not width_us:
        return 366 * US_PER_DAY
    return max(US_PER_DAY, (block_rows * width_us) // US_PER_DAY * US_PER_DAY)
