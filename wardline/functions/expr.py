"""Scalar expressions whose missing-value rules differ from plain SQL.

Everything here is built from built-in Spark functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: Column | str) -> Column:
    """The value as a double, with NaN turned into NULL so that min / max / sum skip it."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def is_finite(c: Column | str) -> Column:
    """True when the value is neither NULL, NaN nor infinite (never NULL itself)."""
    value = no_nan(c)
    return value.isNotNull() & (F.abs(value) < F.lit(float("inf")))


def finite(c: Column | str) -> Column:
    """The value when it is finite, else NULL."""
    return F.when(is_finite(c), _col(c))


def na_ifelse(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that is NULL when the condition is NULL.

    ``when(c, a).otherwise(b)`` would give ``b`` there.
    """
    return F.when(condition, yes).when(~condition, no)


def micros(time: Column | str) -> Column:
    """Microseconds since the epoch; a time without a zone counts as UTC in every session zone.

    The zone and the type are known when the query is planned, so one branch is left then.
    """
    time = _col(time)
    instant = F.unix_micros(time.cast("timestamp"))
    since = time.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    seconds = since.cast("interval second").cast("decimal(18,6)")
    free = (F.current_timezone() == "UTC") | (F.typeof(time) != "timestamp_ntz")
    return F.when(free, instant).otherwise((seconds * 1_000_000).cast("long"))


def micros_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in whole microseconds."""
    return micros(end) - micros(start)


def hours_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in hours."""
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def round_half_even(c: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals, ties to the even digit."""
    factor = F.lit(float(10**digits))
    return F.rint(c * factor) / factor


def safe_ratio(a: Column | str, b: Column | str, digits: int = 2) -> Column:
    """``a / b`` rounded half to even; x/0 is signed infinity, 0/0 is NULL."""
    a, b = no_nan(a), no_nan(b)
    inf = float("inf")
    at_zero = F.when(a > 0, F.lit(inf)).when(a < 0, F.lit(-inf))
    return F.when(b == 0, at_zero).otherwise(round_half_even(F.try_divide(a, b), digits))


def to_number(c: Column | str) -> Column:
    """Text to double; text that is no number gives NULL."""
    return no_nan(_col(c).try_cast("double"))


def strip_text(c: Column | str, text: str) -> Column:
    """Remove every occurrence of a literal text."""
    return F.replace(_col(c), F.lit(text), F.lit(""))


def meld_na(meld: Column | str, sodium: Column | str) -> Column:
    """Sodium-adjusted MELD (2016): ``10 M + 1.32 (137 - Na) - 0.033 * 10 M (137 - Na)``."""
    ten_meld = _col(meld) * 10
    gap = F.lit(137) - _col(sodium)
    return ten_meld + F.lit(1.32) * gap - F.lit(0.033) * ten_meld * gap
