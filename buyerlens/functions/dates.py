"""Date arithmetic.

Day differences follow "elapsed time floored to whole days": 01:00 minus 23:00
of the previous day is 0 days, the reverse is -1.  ``datediff`` counts
calendar days and ``timestampdiff(DAY)`` truncates toward zero, so neither is
used; we floor the exact microsecond difference instead.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_days_between(end, start) -> Column:
    """Whole days from ``start`` to ``end``, floored (negative when end < start)."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    # Integer floor division: subtract the non-negative remainder first.
    return ((micros - F.pmod(micros, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("long")


def days_since(snapshot: str, ts) -> Column:
    """Days from ``ts`` to a fixed snapshot date."""
    return floor_days_between(F.to_timestamp_ntz(F.lit(snapshot)), _col(ts))


def to_timestamp_strict(c, fmt: str | None = None) -> Column:
    """Parse to timestamp; with ANSI on an invalid value fails the job."""
    c = _col(c)
    return F.to_timestamp(c, F.lit(fmt)) if fmt else F.to_timestamp(c)
