"""Resampling rules: a frequency string → how to label a bucket.

Fixed widths: ``us``, ``ms``, ``s``/``sec``, ``T``/``min``, ``H``/``h``, ``D``/``d``
with integer multiples, also compound (``1h30min``).  Calendar rules, with
integer multiples counted from the series' first period: ``W`` (week ending
Sunday) or ``W-MON`` … ``W-SUN`` (week ending on that day), ``ME``/``M``,
``QE``/``Q``, ``YE``/``Y``/``A``, labelled by the last day of the period, and
``MS``, ``QS``, ``YS``/``AS``, labelled by the first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .timecols import US_PER_DAY, US_PER_SECOND

# Pandas frequency aliases accepted here and their meaning.
FIXED_UNITS_US = {
    "us": 1, "ms": US_PER_SECOND // 1000,
    "s": US_PER_SECOND, "sec": US_PER_SECOND,
    "t": 60 * US_PER_SECOND, "min": 60 * US_PER_SECOND,
    "h": 3600 * US_PER_SECOND,
    "d": US_PER_DAY,
}
CALENDAR_RULES = {
    "W": "week",
    "ME": "month_end", "M": "month_end",
    "QE": "quarter_end", "Q": "quarter_end",
    "YE": "year_end", "Y": "year_end", "A": "year_end",
    "MS": "month_start", "QS": "quarter_start", "YS": "year_start", "AS": "year_start",
}

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")

_RULE_RE = re.compile(r"^\s*(\d*)\s*([A-Za-z][A-Za-z-]*)\s*$")
_PART_RE = re.compile(r"\s*(\d*)\s*([A-Za-z]+)")


@dataclass(frozen=True)
class Rule:
    text: str
    kind: str              # "fixed" or one of CALENDAR_RULES values
    width_us: int = 0      # fixed rules only
    multiple: int = 1      # calendar rules: periods per bucket
    week_end: int = 6      # week rules: last day of the week, Monday = 0

    @property
    def divides_day(self) -> bool:
        return self.kind == "fixed" and US_PER_DAY % self.width_us == 0


def _fixed_width(text: str) -> int | None:
    """Microseconds of a plain or compound fixed rule, or None."""
    total, at = 0, 0
    while at < len(text):
        m = _PART_RE.match(text, at)
        if not m or m.group(2).lower() not in FIXED_UNITS_US or (at and not m.group(1)):
            return None
        total += int(m.group(1) or 1) * FIXED_UNITS_US[m.group(2).lower()]
        at = m.end()
    return total


def parse_rule(rule: str) -> Rule:
    text = str(rule).strip()
    m = _RULE_RE.match(text)
    unit = m.group(2) if m else ""
    name, _, day = unit.upper().partition("-")
    calendar = name in CALENDAR_RULES and unit not in ("h", "s", "d", "min", "sec", "t", "ms")
    if calendar and (not day or (name == "W" and day in WEEKDAYS)):
        multiple = int(m.group(1) or 1)
        if multiple <= 0:
            raise ValueError(f"rule multiple must be positive: {rule!r}")
        return Rule(str(rule), CALENDAR_RULES[name], multiple=multiple,
                    week_end=WEEKDAYS.index(day) if day else 6)
    width = _fixed_width(text)
    if width is None:
        raise ValueError(f"unsupported resample rule {rule!r}")
    if width <= 0:
        raise ValueError(f"rule multiple must be positive: {rule!r}")
    return Rule(str(rule), "fixed", width)
