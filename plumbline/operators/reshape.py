"""Wide to long, unions, and decoding what a column name says."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def union_distinct(parts: Sequence[DataFrame]) -> DataFrame:
    """Distinct rows over all parts; each part is reduced before the shuffle."""
    return union_all(parts).distinct()


def columns_where(df: DataFrame, keep: Callable[[str], bool]) -> list[str]:
    """The columns a predicate on the name selects, in file order."""
    return [c for c in df.columns if keep(c)]


def drop_then_add(df: DataFrame, drop: Sequence[str], add: dict[str, Column]) -> DataFrame:
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in drop],
        *[column.alias(name) for name, column in add.items()])


def unpivot_named(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                  name_column: str = "source_column", value_column: str = "raw_value") -> DataFrame:
    """One row per non-NULL cell. ``Expand`` does it in one pass over the scan."""
    return df.unpivot(list(ids), list(values), name_column, value_column).where(
        F.col(value_column).isNotNull())


def rename(df: DataFrame, names: dict[str, str], rule: Callable[[str], str] | None = None) -> DataFrame:
    """Rename every column: by the explicit map first, by ``rule`` otherwise."""
    return df.select([
        F.col(f"`{c}`").alias(names.get(c, rule(c) if rule else c)) for c in df.columns
    ])
