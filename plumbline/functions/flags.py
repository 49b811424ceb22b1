"""Derived flags, rates and brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``scale * part / whole``, NULL where there is no whole to divide by."""
    return F.when(whole > 0, F.lit(scale) * part / whole)


def is_small(count: Column, below: int = 10) -> Column:
    return count < below


def tally(condition: Column) -> Column:
    """Rows for which the condition holds; unknown does not count."""
    return F.count_if(condition)


def sum_where(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def max_where(value: Column, condition: Column) -> Column:
    return F.max(F.when(condition, value))


def value_at_max(value: Column, order: Column) -> Column:
    """The value of the latest row that has one."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def value_at_min(value: Column, order: Column) -> Column:
    """The value of the earliest row that has one."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def income_bracket(income_thousands: Column, area_median: Column) -> Column:
    """Applicant income against the area median: below 50, 80 and 120 percent."""
    share = F.try_divide(F.lit(100.0) * income_thousands * 1000, area_median)
    return (
        F.when(income_thousands.isNull() | area_median.isNull(), None)
        .when(share < 50, "low")
        .when(share < 80, "moderate")
        .when(share < 120, "middle")
        .otherwise("upper")
    )


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return ~((low_a > high_b) | (low_b > high_a))


def payment_flags(building: Column, contents: Column, icc: Column,
                  reason_building: Column, reason_contents: Column) -> dict[str, Column]:
    """A missing payment, a zero payment and a negative one are three different facts."""
    explained = reason_building.isNotNull() | reason_contents.isNotNull()
    negative = [F.coalesce(p < 0, F.lit(False)) for p in (building, contents, icc)]
    return {
        "is_closed_without_payment": building.isNull() & explained,
        "is_unexplained_missing_payment": building.isNull() & ~explained,
        "is_zero_paid": F.coalesce(building + contents + icc == 0, F.lit(False)),
        "has_negative_payment": negative[0] | negative[1] | negative[2],
    }
