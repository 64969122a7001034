"""Null-aware arithmetic on columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_if_any(*parts: Column) -> Column:
    """Sum that skips NULL parts and is NULL only when every part is NULL."""
    total = reduce(add, [F.coalesce(part, F.lit(0.0)) for part in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def mean_of_two(opening: Column, closing: Column) -> Column:
    """(opening + closing) / 2, NULL unless both are known."""
    return (opening + closing) / F.lit(2.0)


def mean_of_positives(opening: Column, closing: Column) -> Column:
    """As :func:`mean_of_two`, and both ends have to be above zero."""
    return F.when((opening > 0) & (closing > 0), mean_of_two(opening, closing))


def positive_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL for a missing, zero or negative denominator."""
    return F.when(denominator > 0, numerator / denominator)


def ratio_of_sums(numerator: Column, denominator: Column) -> Column:
    """Aggregate ratio; NULL when the denominators add up to zero."""
    return F.try_divide(F.sum(numerator), F.sum(denominator))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def is_finite(value: Column) -> Column:
    number = value.cast("double")
    return ~(F.isnan(number) | (F.abs(number) == F.lit(float("inf"))))


def exact_sum(value: Column, scale: int = 4) -> Column:
    """Order-independent sum of doubles that have at most ``scale`` decimals, returned as double.

    Values are added as whole numbers of the smallest unit, so the total does not depend on how
    Spark split the rows. The upper and lower halves of the units are added apart, as long integers (a
    decimal sum makes an object of every addition), so there is room for two thousand million rows of
    a group; totals beyond a long are put together as decimals.
    """
    units = F.floor(value * float(10**scale) + 0.5).cast("decimal(18,0)").cast("long")
    upper, lower = F.sum(F.shiftright(units, 32)), F.sum(units.bitwiseAND(F.lit(2**32 - 1)))
    short = upper.between(-(2**29), 2**29) & (lower < 2**61)
    long = upper.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + lower.cast("decimal(20,0)")
    return F.when(short, (upper * F.lit(2**32) + lower).cast("double")).otherwise(long.cast("double")) / float(10**scale)


def money(value: Column) -> Column:
    return F.round(value, 2)


def ratio(value: Column) -> Column:
    return F.round(value, 4)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)
