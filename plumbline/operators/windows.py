"""Window operators: lag over named orders and top-n per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_prior(df: DataFrame, partition: Sequence[str], order: Sequence[Column],
               columns: dict[str, str]) -> DataFrame:
    """The previous row's values inside a series. ``order`` must be total, or ties would vary.

    Meant for aggregated series, whose partitions hold one row per period.
    """
    series = Window.partitionBy(*partition).orderBy(*order)
    return df.select("*", *[F.lag(source).over(series).alias(name) for source, name in columns.items()])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark limits each group before the shuffle (a window group limit), so a hot group sends
    at most ``n`` rows per task.
    """
    ranked = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n).drop("_rank")
