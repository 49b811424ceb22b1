"""Integrity of a load: counts, control sums, rosters, years, keys and pages.

Every check is an aggregate of partition counts or of one scan. Rosters are compared by
anti-joins against fixed lists; nothing is collected to be compared on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.operators.aggregates import DIGEST
from plumbline.operators.joins import with_totals
from plumbline.quality.results import (
    FAIL,
    PASS,
    SKIP,
    WARN,
    counted,
    coverage_status,
    passes,
    results,
)
from plumbline.sources.seeds import fixed_table


def gap_status(reported: Column, landed: Column, data_refresh: Column, metadata_refresh: Column) -> Column:
    """The publisher's count against what its file held.

    A gap is timing when two refresh stamps differ, a defect when they agree, and cannot be
    told apart when only one was published.
    """
    return (
        F.when(reported.isNull(), SKIP)
        .when(reported == landed, PASS)
        .when(metadata_refresh.isNull(), WARN)
        .when(data_refresh.eqNullSafe(metadata_refresh), FAIL)
        .otherwise(WARN)
    )


def count_chain(counts: DataFrame, track: str, source: str) -> DataFrame:
    """Source -> landing -> raw -> table, from a one-row frame of counts and stamps."""
    landing, raw, table = F.col("rows_landing"), F.col("rows_raw"), F.col("rows_table")
    reported = F.col("source_reported_count")
    stamps = F.col("source_last_refresh"), F.col("source_metadata_refresh")
    return results(
        counts, track, source,
        ("source -> landing", gap_status(reported, landing, *stamps), counted(reported=reported, landing=landing)),
        ("landing -> raw -> table", passes((landing == raw) & (raw == table)),
         counted(landing=landing, raw=raw, table=table)))


def compare_profiles(landing: DataFrame, raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two profiles of one table, partition by partition; NULL where a side has no such key."""
    left = landing.select("partition_key", *[F.col(c).alias(f"landing_{c}") for c in columns])
    right = raw.select("partition_key", *[F.col(c).alias(f"raw_{c}") for c in columns])
    return left.join(right, "partition_key", "full_outer")


def lossless(landing: DataFrame, raw: DataFrame, sums: Sequence[str], track: str, source: str) -> DataFrame:
    """Nothing changed between landing and raw: exact decimal sums, counts per partition, and contents.

    Contents are compared where both profiles have digests; they show values exchanged between
    rows, which leave all sums and counts as they were.
    """
    digested = DIGEST in landing.columns and DIGEST in raw.columns
    both = compare_profiles(landing, raw, ["row_count", *sums, *[DIGEST] * digested])
    here, there = F.col("landing_row_count"), F.col("raw_row_count")
    unlike = ~F.col(f"landing_{DIGEST}").eqNullSafe(F.col(f"raw_{DIGEST}")) if digested else F.lit(False)
    totals = both.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.count_if(there.isNull()).alias("only_landing"), F.count_if(here.isNull()).alias("only_raw"),
        F.count_if(here != there).alias("differing"), F.count_if(unlike).alias("unlike"),
        *[F.coalesce(F.sum(f"{side}_{c}"), F.lit(0)).alias(f"{side}_{c}")
          for c in sums for side in ("landing", "raw")])
    mismatched = sum((F.when(F.col(f"landing_{c}") != F.col(f"raw_{c}"), 1).otherwise(0) for c in sums), F.lit(0))
    only_landing, only_raw, differing = F.col("only_landing"), F.col("only_raw"), F.col("differing")
    contents = ("content digests", passes(F.col("unlike") == 0), counted(partitions=F.col("partitions"), differing=F.col("unlike")))
    return results(
        totals, track, source,
        ("control sums", passes(mismatched == 0) if sums else SKIP,
         counted(columns=F.lit(len(sums)), mismatched=mismatched)),
        ("per-partition counts", passes((only_landing == 0) & (only_raw == 0) & (differing == 0)),
         counted(partitions=F.col("partitions"), only_landing=only_landing, only_raw=only_raw,
                 differing=differing)),
        *[contents] * digested)


def partitions_sum(counts: DataFrame, table_rows: DataFrame, track: str, source: str) -> DataFrame:
    """No row fell between the partitions; ``table_rows`` is one row with ``n``."""
    both = with_totals(counts.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("total")), table_rows)
    return results(both, track, source, ("partitions sum to table", passes(F.col("total") == F.col("n")),
                                         counted(partitions=F.col("total"), table=F.col("n"))))


def roster_gap(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys on one side only: ``is_missing`` for expected keys without rows, else unexpected."""
    keys = expected.select("partition_key", F.lit(True).alias("is_expected"))
    both = counts.select("partition_key", "row_count").join(keys, "partition_key", "full_outer")
    missing = F.col("row_count").isNull()
    return both.where(missing | F.col("is_expected").isNull()).select(
        "partition_key", F.coalesce("row_count", F.lit(0)).alias("row_count"), missing.alias("is_missing"))


def _against_states(counts: DataFrame) -> DataFrame:
    """Partition counts beside the fixed state list, measured in one row."""
    listed = fixed_table(counts.sparkSession, fixed.STATES).select(
        F.col("state_code").alias("partition_key"),
        F.col("state_code").isin(*fixed.TERRITORIES).alias("is_territory"))
    both = counts.join(listed, "partition_key", "full_outer")
    territory, absent, unlisted = F.col("is_territory"), F.col("row_count").isNull(), F.col("is_territory").isNull()
    return both.agg(
        F.count_if(absent & ~territory).alias("missing_states"),
        F.count_if(absent & territory).alias("missing_territories"),
        F.count_if(~absent & territory).alias("present_territories"),
        F.count_if(unlisted).alias("unlisted"),
        F.coalesce(F.sum(F.when(unlisted, F.col("row_count"))), F.lit(0)).alias("unlisted_rows"))


def state_roster(counts: DataFrame, track: str, source: str, is_sample: bool = False) -> DataFrame:
    """Every state and DC, then the territories, then what no list knows (kept, and counted)."""
    states, territories = F.col("missing_states"), F.col("missing_territories")
    return results(
        _against_states(counts), track, source,
        ("states + DC present", coverage_status(states == 0, is_sample), counted(missing=states)),
        ("territories present", coverage_status(territories == 0, is_sample, WARN), counted(missing=territories)),
        ("unknown-state rows kept", PASS, counted(keys=F.col("unlisted"), rows=F.col("unlisted_rows"))))


def year_coverage(counts: DataFrame, track: str, source: str, first_expected: int | None = None,
                  is_sample: bool = False) -> DataFrame:
    """An unbroken run of years from the first to the newest; malformed keys are kept."""
    key = F.col("partition_key")
    year = F.when(key.rlike("^[0-9]+$"), key.try_cast("int"))
    # Years are whole numbers, so a run is unbroken when it has as many as it spans.
    measured = counts.agg(
        F.min(year).alias("first"), F.max(year).alias("last"), F.count_distinct(year).alias("present"),
        F.count_if(~key.rlike("^[0-9]+$")).alias("malformed"),
        F.coalesce(F.sum(F.when(~key.rlike("^[0-9]+$"), F.col("row_count"))), F.lit(0)).alias("malformed_rows"))
    first, last, present = F.col("first"), F.col("last"), F.col("present")
    gaps = last - first + 1 - present
    # With no year at all the check fails on any mode: there is nothing to cover.
    coverage = F.when(present == 0, FAIL).otherwise(coverage_status(gaps == 0, is_sample))
    checks = [
        ("year coverage", coverage, counted(first=first, last=last, gaps=gaps)),
        ("malformed dates kept", PASS, counted(keys=F.col("malformed"), rows=F.col("malformed_rows"))),
    ]
    if first_expected is not None:
        status = coverage_status(first == first_expected, is_sample, WARN)
        checks.append(("earliest year", status, counted(first=first, expected=F.lit(first_expected))))
    return results(measured, track, source, *checks)


def missing_years(counts: DataFrame) -> DataFrame:
    """The years a coverage gap consists of."""
    key = F.col("partition_key")
    years = counts.where(key.rlike("^[0-9]+$")).select(F.expr("try_cast(partition_key AS int)").alias("year")).where("year IS NOT NULL").distinct()
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b")).where(F.col("a").isNotNull())
    return span.select(F.explode(F.sequence("a", "b")).alias("year")).join(years, "year", "left_anti")


def expected_keys(counts: DataFrame, expected: Sequence[str], track: str, source: str,
                  tolerated: Sequence[str] = ()) -> DataFrame:
    """A key column whose whole domain is known. Tolerated extras are an observation."""
    spark = counts.sparkSession
    wanted = fixed_table(spark, "partition_key\n" + "\n".join(expected))
    gap = roster_gap(counts, wanted)
    missing = F.col("is_missing")
    allowed = F.col("partition_key").isin(*tolerated) if tolerated else F.lit(False)
    measured = gap.agg(
        F.count_if(missing).alias("missing"), F.count_if(~missing & ~allowed).alias("unexpected"),
        F.count_if(~missing & allowed).alias("tolerated"))
    unexpected, kept = F.col("unexpected"), F.col("tolerated")
    return results(
        measured, track, source,
        ("expected keys present", passes(F.col("missing") == 0),
         counted(expected=F.lit(len(expected)), missing=F.col("missing"))),
        ("no unexpected keys", F.when(unexpected > 0, FAIL).when(kept > 0, WARN).otherwise(PASS),
         counted(unexpected=unexpected, tolerated=kept)))


def peers_and_rollups(counts: DataFrame, track: str, source: str, is_sample: bool = False) -> DataFrame:
    """One key column holding states beside the regions and nation that contain them."""
    missing, rollups = F.col("missing_states"), F.col("unlisted")
    return results(
        _against_states(counts), track, source,
        ("states + DC present", coverage_status(missing == 0, is_sample), counted(missing=missing)),
        ("territories present", PASS, counted(present=F.col("present_territories"))),
        ("rollups kept, not summed", passes(rollups > 0), counted(rollups=rollups, rows=F.col("unlisted_rows"))))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; NULL parts count as values."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def paging(rows: DataFrame, page: str, position: str, key: str, page_size: int, track: str, source: str) -> DataFrame:
    """A keyset pull is whole: ids unique and ascending as they arrived, no page missing, all full but the last.

    ``position`` is the place of a row inside its page. Each row is compared with the one that
    arrived before it: inside a page (its size bounds the window), and across the edge to the
    page before it in rank, so a missing page cannot hide a descent. Edges are ordered a
    thousand pages at a time.
    """
    rows = rows.select(F.col(page).cast("bigint").alias("page"), F.col(position).alias("position"), F.col(key).alias("key"))
    prior = F.lag("key").over(Window.partitionBy("page").orderBy("position"))
    pages = rows.withColumn("prior", prior).groupBy("page").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("key") <= F.col("prior")).alias("down"),
        F.min_by("key", "position").alias("first"), F.max_by("key", "position").alias("last"),
    ).withColumn("thousand", F.floor(F.col("page") / 1000))
    ends = pages.groupBy("thousand").agg(F.max_by("last", "page").alias("end"))
    ends = ends.select("thousand", F.lag("end").over(Window.orderBy("thousand")).alias("edge"))
    within = F.lag("last").over(Window.partitionBy("thousand").orderBy("page"))
    chained = pages.withColumn("within", within).join(ends, "thousand").withColumn("before", F.coalesce("within", "edge"))
    last = pages.agg(F.max("page").alias("last_page"))
    repeats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    is_last = F.col("page") == F.col("last_page")
    measured = with_totals(with_totals(chained, last).agg(
        F.count(F.lit(1)).alias("pages"),
        (F.coalesce(F.sum("down"), F.lit(0)) + F.count_if(F.col("first") <= F.col("before"))).alias("descending"),
        F.count_if(~is_last & (F.col("n") != page_size)).alias("short"),
        F.coalesce(F.max("page") - F.min("page") + 1 - F.count(F.lit(1)), F.lit(0)).alias("missing"),
        F.count_if(is_last & (F.col("n") >= page_size)).alias("full_last")), repeats)
    columns = {c: F.col(c) for c in ("pages", "repeated", "descending", "short", "missing", "full_last")}
    return results(
        measured, track, source,
        ("ids unique and ascending", passes((columns["repeated"] == 0) & (columns["descending"] == 0)),
         counted(pages=columns["pages"], repeated=columns["repeated"], descending=columns["descending"])),
        ("pages full but the last", passes((columns["short"] == 0) & (columns["missing"] == 0)),
         counted(short=columns["short"], missing=columns["missing"])),
        ("last page not full", passes(columns["full_last"] == 0, WARN), counted(full_last=columns["full_last"])))


def header_mismatches(headers: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Files whose header is not the one their columns will be read by."""
    wanted = F.array(*[F.lit(c) for c in expected])
    return headers.where(~F.col("header").eqNullSafe(wanted))


def below_floor(df: DataFrame, keys: Sequence[str], floor: int) -> DataFrame:
    """Groups with fewer rows than their geography must have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") < floor)


def outside_scope(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows that belong to another state, or another year, than the pull asked for."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def pad_widths(df: DataFrame, column: str) -> DataFrame:
    """Distinct lengths of a fixed-width column; more than one means padding was lost."""
    return df.groupBy(F.length(column).alias("width")).agg(F.count(F.lit(1)).alias("row_count"))


def undefined_keys(facts: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """Keys facts use that their definition table does not list."""
    return facts.select(key).where(F.col(key).isNotNull()).distinct().join(
        definitions.select(key), key, "left_anti")


def cross_check(measured: DataFrame, published: DataFrame, keys: Sequence[str], value: str,
                tolerance: float = 0.0) -> DataFrame:
    """Our figures beside the publisher's, with the gap and whether it is within tolerance."""
    theirs = published.select(*keys, F.col(value).alias(f"published_{value}"))
    gap = F.col(value) - F.col(f"published_{value}")
    return measured.join(theirs, list(keys), "left").select(
        *keys, value, f"published_{value}", gap.alias("gap"),
        F.coalesce(F.abs(gap) <= tolerance, F.lit(False)).alias("agrees"))


def zero_weight_profile(crosswalk: DataFrame) -> DataFrame:
    """ZIPs without residential addresses, and without any."""
    zips = crosswalk.groupBy("zip5").agg(
        F.sum("res_ratio").alias("residential"), F.sum("tot_ratio").alias("total"))
    return zips.agg(
        F.count(F.lit(1)).alias("zips"), F.count_if(F.col("residential") == 0).alias("no_residential"),
        F.count_if(F.col("total") == 0).alias("no_weight_at_all"))
