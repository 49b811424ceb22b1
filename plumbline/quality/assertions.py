"""Assertions over finished tables. Each returns the rows that break it; none means it holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.flags import tally
from plumbline.operators.reshape import union_all, union_distinct
from plumbline.operators.joins import with_totals
from plumbline.params import DEFAULT, Params
from plumbline.sources.seeds import fixed_table

# ── generic column tests ─────────────────────────────────────────────────────────────────


def not_unique(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def is_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unaccepted(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*accepted)).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))


def unrelated(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child keys no parent row has. Keys are reduced before they meet the parent."""
    keys = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return keys.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


# ── assertions over the marts ────────────────────────────────────────────────────────────


def directions_cross_break(compared: DataFrame) -> DataFrame:
    """A direction computed from a flagged or multi-year endpoint."""
    changed = F.col("mi_change_from_prior").isNotNull()
    judged = F.col("mi_direction").isin("improving", "deteriorating")
    return compared.where(
        (changed & (F.col("mi_not_comparable_pre_2019") | F.col("spans_multiple_years"))) | (judged & ~changed))


def unlisted_cycles(cells: DataFrame) -> DataFrame:
    cycles = fixed_table(cells.sparkSession, fixed.SURVEY_CYCLES).select("cycle_key")
    return cells.select("cycle_key", "year_start", "year_end").distinct().join(
        F.broadcast(cycles), "cycle_key", "left_anti")


def allocation_loss(complaints: DataFrame, allocation: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """States whose allocated complaints do not add up to those received."""
    received = complaints.where(F.col("state_code").isNotNull()).groupBy("state_code").agg(
        F.count(F.lit(1)).alias("complaints"))
    placed = allocation.groupBy("state_code").agg(F.sum("allocated_complaints").alias("allocated"))
    gap = F.col("allocated") - F.col("complaints")
    return received.join(placed, "state_code", "left").withColumn("gap", gap).where(
        F.col("allocated").isNull() | (F.abs("gap") > tolerance))


def unstandardized_payments(services: DataFrame) -> DataFrame:
    payments = F.col("measure_kind").isin("per_capita", "per_user", "amount", "share_of_pymt")
    return services.where(payments & F.col("is_standardized").isNull())


def empty_long_term_care(services: DataFrame) -> DataFrame:
    """One row when the long-term-care slice the comparison rests on is empty."""
    kept = F.col("is_long_term_care") & F.col("is_standardized") & (F.col("measure_kind") == "per_capita")
    return services.agg(tally(kept).alias("row_count")).where(F.col("row_count") == 0)


def cost_off_series(cost: DataFrame, measures: DataFrame) -> DataFrame:
    """Cost rows that are not the standardised series' own figure."""
    keys = ["measure_year", "geo_level", "geo_description", "age_level"]
    series = measures.where(
        (F.col("service_code") == "TOT") & (F.col("measure_kind") == "per_capita") & F.col("is_standardized")
    ).select(*keys, F.col("measure_value").alias("series_value"))
    return cost.select(*keys, "cost_per_capita").join(series, keys, "left").where(
        ~F.col("cost_per_capita").eqNullSafe(F.col("series_value")))


def varying_denominators(mart: DataFrame, month: str) -> DataFrame:
    """County-months carrying more than one population or vintage window."""
    population, window = F.col("county_population"), F.col("population_vintage_window")
    # A constant column has equal extremes, which is cheaper to know than a distinct count.
    return mart.where(F.col("county_fips").isNotNull()).groupBy("county_fips", month).agg(
        F.min(population).alias("lo"), F.max(population).alias("hi"),
        F.min(window).alias("first"), F.max(window).alias("last"),
    ).where((F.col("lo") != F.col("hi")) | (F.col("first") != F.col("last")))


def repeated_periods(periods: DataFrame) -> DataFrame:
    return periods.groupBy("grain", "period_key").agg(
        F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def overlapping_growth(need: DataFrame, elderly: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(claim, detail) rows when the growth pair overlaps or is not in the data."""
    claimed = need.where(~F.col("windows_are_non_overlapping")).select(
        F.lit("model reports overlapping windows").alias("claim"),
        F.concat_ws(" -> ", "population_window_from", "population_window_to").alias("detail")).distinct()
    first, last = params.growth_from_vintage, params.growth_to_vintage
    pair = fixed_table(need.sparkSession, f"vintage_year\n{first}\n{last}")
    configured = pair.where(F.lit(last - 4 <= first)).select(
        F.lit("configured vintages overlap").alias("claim"),
        F.lit(f"{first} -> {last}").alias("detail")).distinct()
    present = elderly.select(F.col("vintage_year").cast("string").alias("vintage_year")).distinct()
    missing = pair.join(present, "vintage_year", "left_anti").select(
        F.lit("configured vintage missing from the data").alias("claim"), F.col("vintage_year").alias("detail"))
    return union_all([claimed, configured, missing])


def unfound_events(bridge: DataFrame, anchors: Sequence[int]) -> DataFrame:
    """Anchor disasters to which no claim was attributed."""
    wanted = fixed_table(bridge.sparkSession, "disaster_number\n" + "\n".join(str(a) for a in anchors))
    found = bridge.select(F.col("disaster_number").cast("string").alias("disaster_number")).where(
        F.col("disaster_number").isin(*[str(a) for a in anchors])).distinct()
    return wanted.join(found, "disaster_number", "left_anti")


def unmapped_labels(complaints: DataFrame) -> DataFrame:
    """Products and responses without a family, counted, from one scan."""
    pairs = F.array(
        F.struct(F.lit("product").alias("field"), F.col("product").alias("value"),
                 F.col("product_family").alias("family")),
        F.struct(F.lit("company_response").alias("field"), F.col("company_response").alias("value"),
                 F.col("response_family").alias("family")))
    return complaints.select(F.inline(pairs)).where(
        F.col("value").isNotNull() & F.col("family").isNull()
    ).groupBy("field", "value").agg(F.count(F.lit(1)).alias("row_count"))


def unresolved_counties(referenced: Sequence[tuple[str, DataFrame]], counties: DataFrame) -> DataFrame:
    keys = union_distinct([df.select(F.lit(name).alias("source_name"), "county_fips") for name, df in referenced])
    return keys.where(F.trim("county_fips") != "").join(
        counties.select("county_fips"), "county_fips", "left_anti")


def unresolved_periods(facts: Mapping[str, tuple[str, DataFrame]], periods: DataFrame) -> DataFrame:
    """Periods of each mart the spine lacks, or holds at another grain."""
    used = union_distinct([
        df.select(F.lit(model).alias("model"), F.lit(grain).alias("expected_grain"), "period_id")
        for model, (grain, df) in facts.items()])
    known = periods.select("period_id", "grain")
    problem = F.when(F.col("grain").isNull(), "no matching period").otherwise("another grain")
    return used.join(known, "period_id", "left").where(
        F.col("grain").isNull() | (F.col("grain") != F.col("expected_grain"))
    ).select("model", "expected_grain", "period_id", problem.alias("problem"))


# Every table that names periods, and the grain it names them at.
PERIOD_GRAINS = {
    "fct_ins_claims_monthly": "month", "fct_ins_claims_detail_mi": "month", "fct_ins_policies_mi_monthly": "month",
    "fct_fin_complaints_monthly_geo": "month", "fct_fin_complaints_monthly_company": "month",
    "fct_fin_complaints_daily_state": "month", "rpt_fin_publication_window": "month", "fct_fin_hmda_annual": "year",
    "fct_hlt_medicare_cost_annual": "year", "fct_hlt_medicare_service_county": "year", "fct_hlt_mi_population_65_plus": "year",
    "fct_hlt_cdc_indicators": "survey_cycle", "fct_hlt_cdc_mi_vs_national": "survey_cycle",
}


def period_facts(built: Mapping[str, DataFrame]) -> dict[str, tuple[str, DataFrame]]:
    """Grain and table of all facts of a build, for ``unresolved_periods`` and ``period_usage``."""
    tables = {name.rpartition(".")[2]: df for name, df in built.items()}
    return {name: (grain, tables[name]) for name, grain in PERIOD_GRAINS.items() if name in tables}


def period_usage(facts: Mapping[str, tuple[str, DataFrame]], periods: DataFrame) -> DataFrame:
    """Per fact its periods, how many the spine lacks, how many it holds at another grain, and rows without one.

    All facts are one aggregate: each task keeps one row per fact and period, whatever the
    facts' sizes, and the spine meets what is left.
    """
    used = union_all([
        df.select(F.lit(model).alias("model"), F.lit(grain).alias("expected_grain"), "period_id")
        for model, (grain, df) in facts.items()]).groupBy("model", "expected_grain", "period_id").agg(F.count(F.lit(1)).alias("rows"))
    missing, named = F.col("period_id").isNull(), F.col("grain").isNotNull()
    return used.join(periods.select("period_id", "grain"), "period_id", "left").groupBy("model", "expected_grain").agg(
        F.count("period_id").alias("periods"),
        F.count_if(~missing & ~named).alias("unknown"),
        F.count_if(named & (F.col("grain") != F.col("expected_grain"))).alias("other_grain"),
        F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("rows_without"))


# Register columns whose codes must all decode, and the list of each.
DECODED_CODES = {
    **{c: c for c in ("action_taken", "loan_purpose", "loan_type", "lien_status", "occupancy_type",
                      "construction_method", "preapproval", "hoepa_status", "purchaser_type",
                      "conforming_loan_limit")},
    "denial_reason_1": "denial_reason",
    "applicant_sex": "sex", "co_applicant_sex": "sex",
    "applicant_ethnicity_1": "ethnicity", "co_applicant_ethnicity_1": "ethnicity",
    "applicant_race_1": "race", "co_applicant_race_1": "race",
}


def undecoded(lending: DataFrame) -> DataFrame:
    """Codes no list explains; seventeen columns stacked in one scan."""
    stacked = F.array(*[
        F.struct(F.lit(lst).alias("list_name"), F.col(c).alias("code"))
        for c, lst in DECODED_CODES.items() if c in lending.columns])
    used = lending.select(F.inline(stacked)).where(F.col("code").isNotNull()).distinct()
    lists = fixed_table(lending.sparkSession, fixed.LENDING_CODES).select("list_name", "code")
    return used.join(F.broadcast(lists), ["list_name", "code"], "left_anti")


def ties(measures: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(measure, mart_value, base_value, gap): each side a one-row frame with ``v``."""
    parts = []
    for name, mart, base in measures:
        sides = with_totals(mart.select(F.col("v").cast("double").alias("mart_value")),
                              base.select(F.col("v").cast("double").alias("base_value")))
        parts.append(sides.select(F.lit(name).alias("measure"), "mart_value", "base_value",
                                  (F.col("mart_value") - F.col("base_value")).alias("gap")))
    return union_all(parts)


def untied(measures: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    return ties(measures).where(~F.col("mart_value").eqNullSafe(F.col("base_value")))


def total(df: DataFrame, value: Column | str, places: int | None = None) -> DataFrame:
    """A one-row total for :func:`ties`."""
    summed = F.sum(value)
    return df.agg((F.round(summed, places) if places is not None else summed).alias("v"))


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("v"))


def ungrouped_actions(lending_mart: DataFrame) -> DataFrame:
    grouped = sum((F.col(c) for c in ("withdrawn_count", "closed_incomplete_count", "purchased_count",
                                      "preapproval_count")), F.col("decided_applications"))
    return lending_mart.groupBy("activity_year").agg(
        F.sum("application_count").alias("applications"), F.sum(grouped).alias("grouped")
    ).where(F.col("applications") != F.col("grouped"))


def incomplete_roster(counties: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row unless the focus state has all its counties and one unassigned bucket."""
    return counties.where("is_michigan").agg(
        tally(F.col("is_reportable_county")).alias("reportable_counties"),
        tally(F.col("geography_kind") == "unknown_county").alias("unassigned_buckets"),
    ).where((F.col("reportable_counties") != params.focus_county_count) | (F.col("unassigned_buckets") != 1))


def mixed_age_levels(services: DataFrame, cost: DataFrame) -> DataFrame:
    """County rows that are not all-ages; jurisdiction-years without all three age levels."""
    partial = services.where(F.col("age_level") != "All").groupBy(
        F.col("county_fips").alias("subject"), F.col("age_level").alias("detail")
    ).agg(F.count(F.lit(1)).alias("rows_found")).withColumn("claim", F.lit("county rows must be all-ages"))
    uneven = cost.where(F.col("is_jurisdiction") | (F.col("geo_level") == "National")).groupBy(
        F.col("geo_description").alias("subject"), F.col("measure_year").cast("string").alias("detail")
    ).agg(F.count_distinct("age_level").alias("rows_found")).where(F.col("rows_found") != 3).withColumn(
        "claim", F.lit("jurisdiction-years must carry all three age levels"))
    return union_all([partial, uneven])


def nonflood_attributions(bridge: DataFrame) -> DataFrame:
    return bridge.where(~F.lower("incident_type").isin(*fixed.FLOOD_INCIDENTS)).select("incident_type").distinct()


def rates_out_of_range(mart: DataFrame, rates: Sequence[str]) -> DataFrame:
    outside = F.lit(False)
    for rate in rates:
        outside = outside | F.coalesce(~F.col(rate).between(0, 100), F.lit(False))
    return mart.where(outside)


def parts_above_whole(mart: DataFrame) -> DataFrame:
    """Outcome counts that exceed, or do not add up to, the counts they are part of."""
    closed = F.col("closed_complaints")
    return mart.where(
        (F.col("timely_count") > closed) | (F.col("relief_count") > closed)
        | (closed + F.col("pending_complaints") != F.col("complaint_count")))


def allocated_timely_above_closed(geo: DataFrame) -> DataFrame:
    closed = F.col("allocated_complaints") - F.col("allocated_pending")
    return geo.where(F.col("allocated_timely") > closed + 0.000001)


def denials_above_decisions(lending_mart: DataFrame) -> DataFrame:
    return lending_mart.where(F.col("denied_count") > F.col("decided_applications"))


def past_horizon(mart: DataFrame, column: str, base: DataFrame, horizon: Column) -> DataFrame:
    """Rows dated after the newest date of the file they came from."""
    newest = base.agg(F.max(horizon).alias("_newest"))
    return with_totals(mart, newest).where(F.col(column) > F.col("_newest")).drop("_newest")


def mislabelled_spans(periods: DataFrame) -> DataFrame:
    spans = F.year("period_end") > F.year("period_start")
    return periods.where(F.col("spans_multiple_years") != spans)


def count_failures(assertions: Mapping[str, DataFrame]) -> DataFrame:
    """(check_name, failing_rows) for every assertion, so that a pass is a visible zero."""
    return union_all([
        df.agg(F.count(F.lit(1)).alias("failing_rows")).select(F.lit(name).alias("check_name"), "failing_rows")
        for name, df in assertions.items()])


