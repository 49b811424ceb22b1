"""Calendars and period spines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The span of the conformed calendar and of the year spine.
CALENDAR_FIRST, CALENDAR_LAST = dt.date(1953, 1, 1), dt.date(2029, 12, 31)
YEARS_FIRST, YEARS_LAST = 1913, 2029


def date_range(spark: SparkSession, first: dt.date, last: dt.date, step: str, name: str) -> DataFrame:
    one = spark.range(1)
    days = F.sequence(F.lit(first), F.lit(last), F.expr(f"interval 1 {step}"))
    return one.select(F.explode(days).alias(name))


def calendar_attributes(day: Column) -> dict[str, Column]:
    """The seventeen attributes of a calendar day."""
    iso_weekday = F.weekday(day) + 1
    month_end = F.last_day(day)
    return {
        "date_key": F.date_format(day, "yyyyMMdd").cast("int"),
        "calendar_year": F.year(day).cast("smallint"),
        "calendar_quarter": F.quarter(day).cast("tinyint"),
        "calendar_month": F.month(day).cast("tinyint"),
        "month_name": F.date_format(day, "MMMM"),
        "year_month": F.date_format(day, "yyyy-MM"),
        "year_quarter": F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")),
        "month_start": F.trunc(day, "MM"),
        "month_end": month_end,
        "quarter_start": F.trunc(day, "quarter"),
        "year_start": F.trunc(day, "year"),
        "day_of_year": F.dayofyear(day).cast("smallint"),
        "iso_day_of_week": iso_weekday.cast("tinyint"),
        "day_name": F.date_format(day, "EEEE"),
        "iso_week": F.weekofyear(day).cast("tinyint"),
        "is_weekend": iso_weekday.isin(6, 7),
        "is_month_end": day == month_end,
    }


def month_ends_between(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Every month end between two dates of a one-row frame."""
    months = F.sequence(F.trunc(F.col(first), "MM"), F.trunc(F.col(last), "MM"), F.expr("interval 1 month"))
    spine = bounds.select(F.explode(months).alias("m"), first, last)
    month_end = F.last_day("m")
    return spine.where((month_end >= F.col(first)) & (month_end <= F.col(last))).select(
        month_end.alias("month_end"))
