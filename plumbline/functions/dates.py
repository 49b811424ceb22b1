"""Dates and the period keys built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.fixed_values import ANNUAL_AVERAGE_PERIOD


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_between(begin: Column, end: Column) -> Column:
    return F.datediff(end, begin).cast("int")


def period_id(grain: str, key: Column) -> Column:
    """``month:2019-03``, so a year and a survey cycle of the same name never collide."""
    return F.concat(F.lit(f"{grain}:"), key.cast("string"))


def year_of_key(key: Column) -> Column:
    return F.substring(key, 1, 4).cast("smallint")


def price_period(raw_period: Column, year: Column) -> dict[str, Column]:
    """Months, the annual average and semiannual averages share one code column."""
    code = F.trim(raw_period)
    is_month = code.startswith("M")
    is_annual = code == ANNUAL_AVERAGE_PERIOD
    month = F.substring(code, 2, 2)
    return {
        "period_code": code,
        "period_kind": F.when(is_annual, "annual_average")
        .when(is_month, "month")
        .when(code.startswith("S"), "semiannual"),
        "calendar_month": F.when(is_month & ~is_annual, month.try_cast("tinyint")),
        "period_key": F.when(is_annual, year.cast("string")).when(
            is_month, F.concat(year.cast("string"), F.lit("-"), month)
        ),
    }
