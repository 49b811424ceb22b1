"""Deterministic samples: no random numbers, no dependence on plan or partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import row_md5
from plumbline.operators.reshape import union_all
from plumbline.operators.windows import top_per_group


@dataclass(frozen=True)
class Stratum:
    """A slice the sample must contain, and how many of its rows."""

    name: str
    where: Column
    limit: int


def top_by_md5(df: DataFrame, n: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``n`` rows whose text hashes lowest; each task keeps only its own best ``n``.

    Rows with equal text are interchangeable when ``columns`` is the whole row.
    """
    return df.orderBy(row_md5(columns or df.columns), *df.columns).limit(n)


def stratified_sample(df: DataFrame, strata: Sequence[Stratum],
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Every stratum's top rows, one copy of each row that several strata chose.

    Each stratum is a scan in which every task keeps its best ``limit`` rows on a heap. One scan for
    all would have to sort every row under its strata, which spills far more than it saves.
    """
    return union_all([top_by_md5(df.where(s.where), s.limit, columns) for s in strata]).distinct()


def stratum_counts(df: DataFrame, strata: Sequence[Stratum]) -> DataFrame:
    """What each stratum contributes, from one scan; an empty one is protecting nothing."""
    counted = df.agg(*[F.count_if(s.where).alias(s.name) for s in strata])
    rows = F.array(*[
        F.struct(F.lit(s.name).alias("stratum"), F.lit(s.limit).cast("bigint").alias("row_limit"),
                 F.col(s.name).alias("matching_rows")) for s in strata])
    return counted.select(F.inline(rows)).select(
        "stratum", "matching_rows", F.least("matching_rows", "row_limit").alias("sampled_rows"),
        (F.col("matching_rows") == 0).alias("is_empty"))


def sample_per_group(df: DataFrame, group: Sequence[str], n: int,
                     columns: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows of each group in md5 order."""
    chosen = list(columns or df.columns)
    return top_per_group(df, group, [row_md5(chosen), *[F.col(c) for c in df.columns]], n)


def slice_and_sample(df: DataFrame, whole: Column, n: int,
                     columns: Sequence[str] | None = None) -> DataFrame:
    """A slice kept whole, beside ``n`` sampled rows of everything else."""
    rest = df.where(~F.coalesce(whole, F.lit(False)))
    return union_all([df.where(whole), top_by_md5(rest, n, columns)])
