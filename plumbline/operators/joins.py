"""Joins: lookups, fan-outs, intervals, events, clamped vintages and restated amounts.

Sizes decide the strategy. A fixed list is broadcast because its size is proven; a one-row
aggregate is a scalar subquery. Any other side is left to the optimizer, which broadcasts below its
threshold and sort-merges (splitting skewed partitions) above it. Keys that may be NULL or
hot are aggregated before they are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_fixed(facts: DataFrame, fixed: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Left lookup into a fixed list (states, code lists): at most a few hundred rows."""
    return facts.join(F.broadcast(fixed), on, "left")


def with_totals(facts: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of an ungrouped aggregate on every row, as a scalar subquery.

    The aggregate is computed once and arrives as a constant, so nothing is joined.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
    return facts.withColumn("_row", packed).select(
        *facts.columns, *[F.col("_row")[c].alias(c) for c in one_row.columns])


def spread_missing(facts: DataFrame, key: str) -> Column:
    """A text key in which rows without one are shared out.

    A NULL matches nothing, yet all NULLs hash to one partition. Such rows get one of several
    stand-ins no dimension holds, chosen by a hash of the row: four for each partition of a
    shuffle, whatever their number.
    """
    spread = 4 * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stand_in = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(*facts.columns[:8]), F.lit(spread)).cast("string"))
    return F.coalesce(F.col(key), stand_in)


def left_lookup(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left lookup on a text key that may be NULL for any share of the rows."""
    right = dimension.withColumnRenamed(key, "_lookup_key")
    keyed = facts.withColumn("_lookup_key", spread_missing(facts, key))
    return keyed.join(right, "_lookup_key", "left").drop("_lookup_key")


def explode_month_ends(rows: DataFrame, begin: str, end: str, horizon: Column | str,
                       name: str = "month_end") -> DataFrame:
    """One row per month end inside ``[begin, end)`` and not past ``horizon``.

    A calendar join would compare every row with every month. Each row knows its own months,
    so it generates them and the aggregation after it stays an equi-key one.
    """
    limit = F.col(horizon) if isinstance(horizon, str) else horizon
    first = F.last_day(F.col(begin))
    last = F.greatest(first, F.least(F.last_day(F.col(end)), F.last_day(limit)))
    months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    spread = rows.withColumn(name, F.explode(months)).withColumn(name, F.last_day(F.col(name)))
    inside = (F.col(name) >= F.col(begin)) & (F.col(name) < F.col(end)) & (F.col(name) <= limit)
    return spread.where(inside)


def clamp_to_bounds(value: Column, low: Column, high: Column) -> Column:
    """The nearest published vintage: values outside the published range take its edge."""
    return F.least(F.greatest(value, low), high)


def attach_clamped(facts: DataFrame, vintages: DataFrame, year: str, key: str, vintage: str,
                   columns: Sequence[str], flag: str, fact_key: str | None = None) -> DataFrame:
    """Left join each fact to the nearest vintage of its key, flagging extrapolated rows.

    ``facts`` must be aggregated, so no key holds more rows than it has groups.
    """
    bounds = vintages.agg(F.min(vintage).alias("_low"), F.max(vintage).alias("_high"))
    placed = with_totals(facts, bounds).withColumn(
        "_vintage", clamp_to_bounds(F.col(year), F.col("_low"), F.col("_high")))
    right = vintages.select(
        F.col(key).alias("_vintage_key"), F.col(vintage).alias("_vintage"),
        *[F.col(c).alias(f"_of_{c}") for c in columns])
    joined = placed.withColumn("_vintage_key", spread_missing(placed, fact_key or key)).join(
        right, ["_vintage_key", "_vintage"], "left")
    return joined.select(
        *facts.columns, *[F.col(f"_of_{c}").alias(c) for c in columns],
        (~F.col(year).between(F.col("_low"), F.col("_high"))).alias(flag))


def price_index(observations: DataFrame) -> DataFrame:
    """Annual averages of the deflator: one row per published year."""
    return observations.where(
        F.col("is_deflator_series") & (F.col("period_kind") == "annual_average")
    ).select(F.col("calendar_year").cast("int").alias("_index_year"),
             F.col("index_value").alias("_index"))


def constant_dollars(facts: DataFrame, index: DataFrame, year: str, amounts: dict[str, Column],
                     base_year: int) -> DataFrame:
    """Restate amounts in ``base_year`` money: ``amount * index[base] / index[year]``.

    Both index lookups are NULL when the year is not published, and so is the result. The
    index has one row per calendar year (the series began in 1913), which is what makes
    broadcasting it safe.
    """
    base = index.where(F.col("_index_year") == base_year).agg(F.max("_index").alias("_base"))
    yearly = F.broadcast(index.groupBy("_index_year").agg(F.max("_index").alias("_index")))
    with_year = facts.join(yearly, F.col(year).cast("int") == F.col("_index_year"), "left")
    restated = with_totals(with_year, base).select(
        *facts.columns,
        *[F.try_divide(amount.cast("double") * F.col("_base"), F.col("_index")).alias(name)
          for name, amount in amounts.items()])
    return restated


#: Keys that a frequency sketch tracks; its counts are short by at most about the total over three quarters of this.
TRACKED = 10_000


def hot_slices(facts: DataFrame, key: str, slices: int) -> Column:
    """Hash key -> slices, for the keys of more than 1/``slices`` of the rows, as a scalar subquery.

    A frequency sketch of fixed size is merged over the tasks, so one small row finds the keys
    and how often they occur. No more than ``slices`` keys can be hot.
    """
    top = facts.agg(F.expr(f"approx_top_k({key}, {min(slices, TRACKED)}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("total"))
    hot = F.filter("top", lambda x: x["count"] * slices > F.col("total"))
    cut = F.transform(hot, lambda x: F.struct(x["item"], F.ceil(x["count"] * slices / F.col("total")).cast("int")))
    return top.select(F.map_from_entries(cut)).scalar()


def match_events(facts: DataFrame, areas: DataFrame, day: str, begin: str, until: str,
                 state: str, county: str, is_statewide: str, slices: int | None = None) -> DataFrame:
    """Facts inside an event's window whose county, or whole state, the event designated.

    ``(statewide OR same county) AND day BETWEEN begin AND until`` as one equi-join: a fact has
    two keys, its county and its whole state, and an event the one it designated, so no pair
    meets twice. Each window is cut into the months it touches, so a fact only meets the
    events of its own month rather than every event of its state. An event spanning years
    adds a row per month to the small side. Rows of one disaster repeated for one area stay
    repeated. ``facts`` and ``areas`` carry the state and county keys under the same names.

    A storm can put a third of all facts into one key. A sketch finds such keys; their facts are
    dealt over slices of about 1/``slices`` of all rows (the shuffle's partitions, if not given)
    and their events are repeated for each slice. Both sides are joined from one scan; the
    sketch reads the three key columns of the facts besides.
    """
    spark = facts.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    month, area, key, cut = "_month", "_area", "_key", "_slice"
    hashed = F.xxhash64(state, month, area)
    spans = F.sequence(F.trunc(begin, "MM"), F.trunc(until, "MM"), F.expr("interval 1 month"))
    both = F.array_compact(F.array(F.col(county).cast("string"), F.lit("*")))
    dated = (facts.withColumn(month, F.trunc(day, "MM")).where(F.col(state).isNotNull() & F.col(month).isNotNull())
             .withColumn(area, F.explode(both)).withColumn(key, hashed))
    parts = F.coalesce(F.try_element_at(hot_slices(dated, key, slices), F.col(key)), F.lit(1))
    # Copies of one row must part, so rows are dealt by their place and not by what they hold.
    left = dated.withColumn(cut, F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    windows = (areas.where(F.col(until) >= F.col(begin)).withColumn(month, F.explode(spans))
               .withColumn(area, F.when(F.col(is_statewide), "*").otherwise(F.col(county).cast("string"))).drop(county)
               .withColumn(key, hashed).withColumn(cut, parts).withColumn(cut, F.explode(F.sequence(F.lit(0), F.col(cut) - 1))))
    inside = F.col(day).between(F.col(begin), F.col(until))
    columns = [*facts.columns, *[c for c in areas.columns if c not in (state, county)]]
    return left.join(windows.drop(key), [state, month, area, cut]).where(inside).select(columns)


def event_totals(facts: DataFrame, areas: DataFrame, day: str, begin: str, until: str,
                 state: str, county: str, is_statewide: str, event: str) -> DataFrame:
    """What ``match_events`` matches, per county of the fact and kind of designation, without a row per pair.

    Facts times events grows with the square of the data. Facts are counted per place and day and
    windows are taken once each, so days meet windows only; both are bounded by the calendar. Every
    area then takes the sums of its window, a row per county at most. ``matches`` counts the pairs,
    ``days_in`` adds up the days from a window's begin, ``events`` counts distinct events.
    """
    place = "_place"
    placed = areas.withColumn(place, F.when(F.col(is_statewide), "*").otherwise(F.col(county).cast("string")))
    window = [state, place, begin, until]
    windows = placed.groupBy(*window).agg(F.max(county).alias(county), (F.col(place) == "*").alias(is_statewide))
    days = facts.groupBy(state, county, day).agg(F.count(F.lit(1)).alias("_n"))
    hits = match_events(days, windows, day, begin, until, state, county, is_statewide)
    found = hits.groupBy(*window, county).agg(
        F.sum("_n").alias("_matches"), F.sum(F.col("_n") * F.date_diff(day, begin)).alias("_days_in"))
    return placed.select(*window, is_statewide, event).join(found, window).groupBy(county, is_statewide).agg(
        F.sum("_matches").alias("matches"), F.sum("_days_in").alias("days_in"), F.count_distinct(event).alias("events"))


def pair_rows(df: DataFrame, left: Column, right: Column, columns: dict[str, str]) -> DataFrame:
    """Put two single rows of one table side by side, each picked by a condition.

    ``columns`` maps a source column to the stem of its two outputs (``from_``/``to_``). Both
    picks are aggregates of one scan, so the pair is one row even when either is missing.
    """
    picks = []
    for source, stem in columns.items():
        picks.append(F.max(F.when(left, F.col(source))).alias(f"from_{stem}"))
        picks.append(F.max(F.when(right, F.col(source))).alias(f"to_{stem}"))
    return df.agg(*picks)
