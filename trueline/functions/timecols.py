"""Zone-safe timestamp expressions for ``timestamp_ntz`` columns.

``date_trunc`` and ``timestampdiff`` go through the session zone and are
wrong inside a DST gap, so epoch arithmetic is done on calendar fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000
US_PER_DAY = 86_400 * US_PER_SECOND


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_us(col) -> Column:
    """Microseconds since 1970-01-01 00:00 of a ``timestamp_ntz`` (no zone)."""
    c = _c(col)
    return (F.unix_date(c.cast("date")).cast("bigint") * F.lit(US_PER_DAY)
            + F.hour(c).cast("bigint") * F.lit(3_600 * US_PER_SECOND)
            + F.minute(c).cast("bigint") * F.lit(60 * US_PER_SECOND)
            + (F.extract(F.lit("SECOND"), c) * F.lit(US_PER_SECOND)).cast("bigint"))


def from_epoch_us(col) -> Column:
    """Inverse of :func:`epoch_us`; returns ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", _c(col), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


# a time of day followed by a zone offset
_OFFSET = r":\d{2}(\.\d+)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)$"


def to_ntz(col, dtype, fmt: str | None = None) -> Column:
    """Cast a date / timestamp / string column to ``timestamp_ntz``.

    Strings use ``try_cast`` so that unparseable values become NULL under ANSI
    mode instead of failing the job.  A string that ends in an offset is an
    instant: it becomes its UTC wall time, whatever the session zone.  With
    ``fmt`` (a Spark datetime pattern) strings are read by that pattern only.
    """
    c = _c(col)
    name = dtype.simpleString()
    if name == "timestamp_ntz":
        return c
    if name in ("date", "timestamp"):
        return c.cast("timestamp_ntz")
    if name == "string":
        if fmt is not None:
            zoned = any(x in fmt.split("'")[::2][0] for x in "XxZOV")
            text, pattern = (c, fmt) if zoned else (F.concat(c, F.lit("Z")), f"{fmt}X")
            return from_epoch_us(F.unix_micros(F.try_to_timestamp(text, F.lit(pattern))))
        t = F.trim(c)
        # "+0530" and "+05" as "+05:30" and "+05:00", which the cast reads
        colon = F.regexp_replace(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"([+-]\d{2})$", "$1:00")
        return F.when(t.rlike(_OFFSET), from_epoch_us(F.unix_micros(colon.try_cast("timestamp")))) \
            .otherwise(c.try_cast("timestamp_ntz"))
    raise TypeError(f"cannot read a timestamp from a {name} column; give ISO strings, dates or timestamps")


def weekday0(col) -> Column:
    """Day of week with Monday = 0 … Sunday = 6."""
    return F.weekday(_c(col))


def calendar_columns(col) -> dict[str, Column]:
    """hour, day_of_week (Mon=0), month and is_weekend (0/1) of a timestamp."""
    c = _c(col)
    return {
        "hour": F.hour(c).cast("int"),
        "day_of_week": weekday0(c).cast("int"),
        "month": F.month(c).cast("int"),
        "is_weekend": (weekday0(c) >= 5).cast("int"),
    }
