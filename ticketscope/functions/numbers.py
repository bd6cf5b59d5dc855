"""Rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round1(value: Column) -> Column:
    """One decimal, ties to the even digit (Spark's ``round`` sends ties up)."""
    return F.rint(value * 10) / 10


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent; NULL if ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def mean_hours(total_seconds: Column, measured: Column) -> Column:
    """Mean in hours from an exact total; the result does not depend on summation order."""
    return F.try_divide(total_seconds.cast("double"), measured * F.lit(3600.0))


def printed_tenths(value: Column) -> Column:
    """Round to one decimal the way ``%.1f`` prints a binary double, so 0.15 gives 0.1.

    0.15 is stored slightly below 0.15 and 0.35 slightly above 0.35; only true ties such as
    0.25 go to the even digit. ``16 * value`` and ``4 * value`` are exact, so ``rest`` is the
    exact distance of ``20 * value`` from the nearest whole number. For values >= 0.
    """
    twentieths = F.rint(value * 20)
    rest = value * 4 - (twentieths - value * 16)
    half = twentieths / 2
    tenths = (
        F.when(twentieths % 2 == 0, half)
        .when(rest > 0, F.ceil(half).cast("double"))
        .when(rest < 0, F.floor(half).cast("double"))
        .otherwise(F.rint(half))
    )
    return tenths / 10


def text1(value: Column) -> Column:
    """A number with one decimal as text; for values already rounded by ``round1``."""
    return F.when(value.isNotNull(), F.format_string("%.1f", value))


def printed1(value: Column) -> Column:
    """An unrounded number with one decimal as text."""
    return text1(printed_tenths(value))
