"""Column expressions shared by the operators."""

from .binning import MAX_DAYS, MICROS_PER_DAY, day_bin, day_of_micros, hour_bin
from .expr import (
    finite,
    hours_between,
    is_finite,
    meld_na,
    micros,
    micros_between,
    na_ifelse,
    no_nan,
    safe_ratio,
    strip_text,
    to_number,
)

__all__ = [
    "MAX_DAYS",
    "MICROS_PER_DAY",
    "day_bin",
    "day_of_micros",
    "finite",
    "hour_bin",
    "hours_between",
    "is_finite",
    "meld_na",
    "micros",
    "micros_between",
    "na_ifelse",
    "no_nan",
    "safe_ratio",
    "strip_text",
    "to_number",
]
