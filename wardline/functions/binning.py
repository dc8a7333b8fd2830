"""Right-closed 24-hour bins counted from an anchor time.

Day 1 is (0 h, 24 h], day 2 is (24 h, 48 h] and so on.  A time at or before the
anchor, or after the last bin, has no day (NULL).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import _col, micros_between

MAX_DAYS = 28
MICROS_PER_DAY = 86_400_000_000


def day_bin(anchor: Column | str, time: Column | str, max_days: int = MAX_DAYS) -> Column:
    """Day number of ``time`` after ``anchor``, in exact integer microseconds."""
    return day_of_micros(micros_between(anchor, time), max_days)


def day_of_micros(us: Column, max_days: int = MAX_DAYS) -> Column:
    """Day number of an offset in microseconds."""
    day = F.call_function("div", us + F.lit(MICROS_PER_DAY - 1), F.lit(MICROS_PER_DAY))
    return F.when((us > 0) & (us <= max_days * MICROS_PER_DAY), day.cast("int"))


def hour_bin(hour: Column | str, max_days: int = MAX_DAYS) -> Column:
    """Day number of an hour offset."""
    hour = _col(hour)
    return F.when((hour > 0) & (hour <= 24 * max_days), F.ceil(hour / 24).cast("int"))
