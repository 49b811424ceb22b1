"""Aggregations Spark has no safe built-in for when one group holds a third of the rows."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise
from plumbline.sources.readers import HIVE_NULL


def _magnitude_bin(value: Column) -> Column:
    """A bin number that never decreases as the value grows: 64 bins per doubling of its size.

    Bins are relative, so shares near 0 are told apart as well as amounts. Infinities have end
    bins, and NaN, the largest value in Spark's order, has the last one.
    """
    size = (F.floor(F.log2(F.abs(value)) * 64) + 70_000).cast("int")  # 1 at least, for the smallest double
    return (F.when(F.isnan(value), 1_000_000)
            .when(value == float("inf"), 999_999).when(value == float("-inf"), -999_999)
            .when(value == 0, 0).when(value < 0, -size).otherwise(size))


_DIVISIONS = 65_536


def _matched(rows: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``few`` where all keys are equal, NULL keys too.

    ``few`` has at most two rows per group; the optimizer may broadcast it by its measured size.
    """
    named = few.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(named, same).drop(*[f"_of_{k}" for k in keys])


def _holding_middle(bins: DataFrame, within: Sequence[str], bin_name: str) -> DataFrame:
    """The bins that hold a middle rank, with ``_before`` counting the values below each."""
    order = Window.partitionBy(*within).orderBy(bin_name)
    return (bins.withColumn("_before", F.col("_below") + F.sum("_bin_n").over(order) - F.col("_bin_n"))
            .where((F.col("_hi") > F.col("_before")) & (F.col("_lo") <= F.col("_before") + F.col("_bin_n"))))


def _summary() -> list[Column]:
    return [F.sum("_n").alias("_bin_n"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_least"), F.max("_v").alias("_most")]


def _divided(counts: DataFrame, full: DataFrame, keys: Sequence[str], level: int) -> tuple[DataFrame, DataFrame]:
    """The values inside ``full`` bins with a finer bin each, and which of those hold a middle rank.

    A bin is divided evenly from its least to its greatest value. Rounding is monotone, so finer
    bins keep the order of the values.
    """
    name = f"_bin{level}"
    width = F.col("_most") - F.col("_least")
    inside = _matched(counts, full.select(*keys, "_least", "_most", F.col("_before").alias("_below"), "_lo", "_hi"), keys)
    inside = inside.withColumn(name, F.when(width > 0, F.floor((F.col("_v") - F.col("_least")) / width * _DIVISIONS)).otherwise(0).cast("int"))
    inside = inside.drop("_least", "_most")
    fine = inside.groupBy(*keys, name).agg(*_summary(), *[F.first(c).alias(c) for c in ("_below", "_lo", "_hi")])
    return inside.drop("_below", "_lo", "_hi"), _holding_middle(fine, keys, name)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str, ordered: int | None = None) -> DataFrame:
    """Exact median per group without gathering any group in one task.

    1. Count distinct values per group. The shuffle key includes the value, so a hot group
       spreads over the cluster and repeated values merge before they move.
    2. Count values per magnitude bin. A group has a few thousand bins at most, whatever its
       size, so finding the bins that hold the two middle ranks is small.
    3. Order only the values inside those bins.

    A bin spans 1.1 % of a value's size, which amounts, rates and counts fill with few distinct
    values. Where a bin may hold more than a task should order, give that number as ``ordered``: a
    middle bin above it is divided into 65,536 parts, and a part still above it once more. A bin
    spans under 2 ** 47 doubles, so what is left is about 2 ** 15 values at most, however close
    together they lie. It reads the counted values four times more.

    NaN counts as the largest value. Groups without a value are absent from the result; join it back from the left.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin0", _magnitude_bin(F.col("_v")))
    )
    total = F.sum("_bin_n").over(Window.partitionBy(*keys))
    bins = (counts.groupBy(*keys, "_bin0").agg(*_summary()).withColumn("_below", F.lit(0).cast("long"))
            .withColumn("_lo", F.floor((total + 1) / 2)).withColumn("_hi", F.floor(total / 2) + 1))
    middle, levels, parts = _holding_middle(bins, keys, "_bin0"), [*keys, "_bin0"], []
    for level in () if ordered is None else (1, 2):
        full = F.col("_values") > ordered
        parts.append(_placed(counts, middle.where(~full), levels))
        counts, middle = _divided(counts, middle.where(full), levels, level)
        levels = [*levels, f"_bin{level}"]
    parts.append(_placed(counts, middle, levels))
    found = reduce(DataFrame.unionByName, [p.select(*keys, "_a", "_b") for p in parts])
    found = found.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return found.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name))


def _placed(counts: DataFrame, middle: DataFrame, levels: Sequence[str]) -> DataFrame:
    """The values at the two middle ranks, ``_a`` and ``_b``, NULL on other rows; orders the values of the middle bins."""
    inside = _matched(counts, middle.select(*levels, "_before", "_lo", "_hi"), levels)
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*levels).orderBy("_v"))
    placed = inside.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))
    return placed.select(*levels, *[
        F.when((F.col(rank) > F.col("_start")) & (F.col(rank) <= F.col("_end")), F.col("_v")).alias(name)
        for rank, name in (("_lo", "_a"), ("_hi", "_b"))]).where("_a IS NOT NULL OR _b IS NOT NULL")


def exact_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians of several columns for the groups in which a median lies between its least and greatest value.

    Up to two values, or equal ones, have their median halfway between the extremes, which an
    aggregate knows anyway. Where nearly all groups are so, only the others' values move: the
    groups in which any column has more are found by one aggregate and written, so that their
    size decides how the rows are matched. A column's median is NULL where it has no value.
    """
    keys = list(keys)
    least, most = [F.min(v).alias(f"_least_{v}") for v in values], [F.max(v).alias(f"_most_{v}") for v in values]
    extremes = df.groupBy(*keys).agg(*[F.count(v).alias(f"_n_{v}") for v in values], *least, *most)
    inner = reduce(operator.or_, [(F.col(f"_n_{v}") > 2) & (F.col(f"_least_{v}") < F.col(f"_most_{v}")) for v in values])
    wide = materialise(extremes.where(inner).select(*keys), "wide-groups")
    rows = _matched(df, wide, keys).select(*keys, F.explode(F.create_map(
        *[x for v in values for x in (F.lit(v), F.col(v).cast("double"))])).alias("_measure", "_value"))
    found = exact_median(rows, [*keys, "_measure"], "_value", "_median")
    return found.select(*keys, *[F.when(F.col("_measure") == v, F.col("_median")).alias(v) for v in values])


def stitch_groups(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Put aggregates of one grouping side by side when its keys may be NULL.

    Grouping treats NULL keys as equal, which a join does not, so the parts are stacked and
    grouped once more. Each part has one row per group.
    """
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def group_total(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """A group total on each row, by aggregate and join back rather than by a window.

    A window would sort a hot group in one task. The aggregate combines before its shuffle
    and the join can split the hot side.
    """
    keys = list(keys)
    totals = df.groupBy(*keys).agg(value.alias(name))
    return df.join(totals, keys, "left").select(*df.columns, name)


#: Column of a profile with content.
DIGEST = "content_digest"
#: Limbs of a content digest, and hexadecimal digits of each.
LIMBS, DIGITS = 4, 8


def content_digest(columns: Sequence[str]) -> Column:
    """An aggregate that is equal for equal multisets of rows, whatever their order.

    A row is written as JSON with its nulls, so that null, blank and a value in another column
    differ, and hashed to 128 bits; the hashes are summed in four limbs of 32 bits. Such sums
    combine before a shuffle, over partitions and over loads, and a changed, moved or repeated
    value changes them.
    """
    row = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))
    limbs = [F.conv(F.substring(row, 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(20,0)") for i in range(LIMBS)]
    return F.concat_ws(":", *[F.coalesce(F.sum(x), F.lit(0)).cast("string") for x in limbs])


def profile(df: DataFrame, key: str | Column, sums: Sequence[str] = (), content: bool = False) -> DataFrame:
    """Rows and exact decimal control sums per partition key, and a digest of all columns if asked for, in one scan."""
    column = F.col(f"`{key}`") if isinstance(key, str) else key
    return df.groupBy(F.coalesce(column.cast("string"), F.lit(HIVE_NULL)).alias("partition_key")).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.coalesce(F.sum(F.col(f"`{c}`").cast("decimal(20,2)")), F.lit(0)).cast("decimal(38,2)")
          .alias(c) for c in sums],
        *[content_digest(sorted(df.columns)).alias(DIGEST)] * content)


def distinct_keys(df: DataFrame, columns: Sequence[str]) -> Column:
    """Distinct count over a tuple that keeps rows whose key has a NULL part."""
    return F.count_distinct(F.struct(*[F.col(c) for c in columns]))


def coverage_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of low-cardinality columns as sorted rows of (field, value)."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*fields)).alias("f")).select("f.*").distinct()
