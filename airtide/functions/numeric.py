"""Numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_true(predicate: Column) -> Column:
    """Three-valued predicate -> two-valued: an unknown outcome counts as false."""
    return F.coalesce(predicate, F.lit(False))


def positive_ln(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def percent_difference(value: Column, base: Column) -> Column:
    return (value - base) / base * 100


def growth_percent(log_ratio: Column) -> Column:
    """Log ratio -> percent above or below 1."""
    return (F.exp(log_ratio) - 1) * 100


def log_growth(percent: Column) -> Column:
    """Percent -> log ratio; undefined (NULL) at or below -100 %."""
    return F.ln(1 + percent / 100.0)


def log_growth_or_zero(percent: Column) -> Column:
    """Percent -> log ratio, 0 at or below -100 %."""
    ratio = 1 + percent / 100.0
    return F.when(ratio <= 0, F.lit(0.0)).otherwise(F.ln(ratio))


def round_binary_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value of a double, exact ties to even.

    ``round`` and ``bround`` work on the shortest decimal form of the double, so
    12.35 (binary 12.3499...) is a tie for them; here it rounds down.
    """
    pattern = F.lit("0." + "0" * digits)
    return F.call_function("format_number", value, pattern).cast("double")


def weighted_mean_of_rounded(
    weighted_units: Column, weight: Column, units: int, digits: int
) -> Column:
    """Weighted mean of values held as whole ``1/units``, rounded to ``digits``.

    The sums stay exact integers up to the one division, so the result does not depend
    on summation order even where the mean is an exact rounding tie. NULL for weight 0.
    """
    scale = 10**digits
    scaled = weighted_units.cast("double") * (scale / units)
    return F.round(F.try_divide(scaled, weight.cast("double")), 0) / scale
