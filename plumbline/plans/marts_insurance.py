"""Insurance marts: claims, policies in force, disasters and their attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dates import days_between, period_id, year_month
from plumbline.functions.flags import is_small, tally
from plumbline.operators.joins import (
    attach_clamped,
    constant_dollars,
    with_totals,
    explode_month_ends,
    left_lookup,
    match_events,
    price_index,
)
from plumbline.operators.reshape import union_all
from plumbline.params import DEFAULT, Params

# The six building characteristics a monthly row is split by.
CHARACTERISTICS = ("rated_flood_zone", "flood_zone_current", "occupancy_type", "pre_firm_indicator",
                   "post_firm_construction_indicator", "crs_class_code")
PAID = {
    "paid_building": "amount_paid_on_building_claim",
    "paid_contents": "amount_paid_on_contents_claim",
    "paid_icc": "amount_paid_on_icc_claim",
    "paid_total": "total_amount_paid",
    "net_paid_total": "total_net_payment",
    "building_coverage": "total_building_insurance_coverage",
    "contents_coverage": "total_contents_insurance_coverage",
}


def county_population(population: DataFrame) -> DataFrame:
    """County vintages that can serve as a denominator, with the window each averages over."""
    return population.where(
        (F.col("geo_level") == "county") & F.col("total_population").isNotNull()
    ).select(
        F.col("county_fips").alias("_county"), "vintage_year",
        F.col("total_population").alias("county_population"),
        F.concat(F.col("vintage_window_start").cast("string"), F.lit("-"),
                 F.col("vintage_window_end").cast("string")).alias("population_vintage_window"))


def county_names(counties: DataFrame, *extra: str) -> DataFrame:
    return counties.select("county_fips", "county_name", F.col("is_michigan").alias("_focus"), *extra)


def _money_sum(df: DataFrame, column: str) -> Column:
    """Sums of decimals are published as decimal(38,2), whatever the width summed."""
    total = F.sum(column)
    return total.cast("decimal(38,2)") if df.schema[column].dataType.typeName() == "decimal" else total


def claims_monthly(claims: DataFrame, population: DataFrame, prices: DataFrame,
                   counties: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """County x loss month x six characteristics, nominal and in constant dollars."""
    keys = ["loss_year", "loss_month", "loss_year_month", "state_code", "county_fips",
            "is_state_unknown", *CHARACTERISTICS]
    cells = claims.withColumnRenamed("year_of_loss", "loss_year").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claim_count"),
        tally(F.col("is_closed_without_payment")).alias("closed_without_payment_count"),
        tally(F.col("is_zero_paid")).alias("zero_paid_count"),
        tally(~F.col("has_usable_county")).alias("no_county_count"),
        *[_money_sum(claims, source).alias(name) for name, source in PAID.items()])
    # One column of the scan; the cells themselves may be many.
    extent = claims.agg(F.max("date_of_loss").alias("_last_loss"))
    dated = with_totals(cells, extent)
    placed = attach_clamped(
        dated, county_population(population), "loss_year", "_county", "vintage_year",
        ["county_population", "population_vintage_window"], "population_is_extrapolated",
        fact_key="county_fips")
    named = left_lookup(placed, county_names(counties, "state_name"), "county_fips")
    priced = constant_dollars(named, price_index(prices), "loss_year",
                              {"paid_total_constant": F.col("paid_total")}, params.deflator_base_year)
    claims_here = F.col("claim_count")
    year = F.col("loss_year")
    return priced.select(
        "loss_year", "loss_month", "loss_year_month",
        period_id("month", F.col("loss_year_month")).alias("period_id"),
        year.cast("string").alias("loss_year_key"),
        "state_code", "county_fips", "county_name", "state_name",
        F.coalesce("_focus", F.lit(False)).alias("is_michigan"), "is_state_unknown",
        *CHARACTERISTICS, "claim_count", "closed_without_payment_count", "zero_paid_count",
        "no_county_count", *PAID,
        (F.col("paid_total").cast("double") / claims_here).alias("avg_paid_per_claim"),
        "paid_total_constant",
        (F.col("paid_total_constant") / claims_here).alias("avg_paid_per_claim_constant"),
        (year < F.year("_last_loss")).alias("is_complete_loss_year"),
        (F.col("_last_loss") >= F.make_date((year + 1).cast("int"), F.lit(12), F.lit(31)))
        .alias("is_development_mature"),
        "county_population", "population_vintage_window", "population_is_extrapolated",
        is_small(claims_here, params.small_cell).alias("is_small_cell"))


DETAIL_COLUMNS = (
    "rated_flood_zone", "flood_zone_current", "occupancy_type", "crs_class_code",
    "pre_firm_indicator", "post_firm_construction_indicator", "foundation_type", "water_depth",
    "exterior_water_depth", "interior_water_depth", "building_damage_amount",
    "contents_damage_amount", "total_building_insurance_coverage",
    "total_contents_insurance_coverage", "number_of_floors_in_the_insured_building",
    "primary_residence_indicator", "rental_property_indicator", "elevated_building_indicator",
    "nfip_community_name", "reported_city", "reported_zip_code", "open_date",
    "most_recent_payment_date",
)


def claims_detail(claims: DataFrame, prices: DataFrame, counties: DataFrame,
                  params: Params = DEFAULT) -> DataFrame:
    """One row per claim of the focus state, with settlement lag and season."""
    mine = claims.where(F.col("state_code") == params.focus_state)
    priced = constant_dollars(mine, price_index(prices), "year_of_loss",
                              {"total_amount_paid_constant": F.col("total_amount_paid")},
                              params.deflator_base_year)
    named = left_lookup(priced, county_names(counties), "county_fips")
    return named.select(
        "claim_id", "county_fips", "county_name", "has_usable_county",
        "county_matches_reported_state", "date_of_loss", F.col("year_of_loss").alias("loss_year"),
        "loss_month", "loss_year_month",
        period_id("month", F.col("loss_year_month")).alias("period_id"),
        "amount_paid_on_building_claim", "amount_paid_on_contents_claim", "amount_paid_on_icc_claim",
        "total_amount_paid", "total_net_payment", "is_closed_without_payment", "is_zero_paid",
        "has_negative_payment", "total_amount_paid_constant",
        *[c for c in DETAIL_COLUMNS if c in named.columns],
        days_between(F.col("date_of_loss"), F.col("most_recent_payment_date"))
        .alias("days_loss_to_last_payment"),
        F.col("loss_month").between(3, 5).alias("is_spring_melt_season"))


def policies_in_force(policies: DataFrame, counties: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Policies covering each month end, per county; a record may stand for several policies."""
    horizon = policies.agg(F.max("as_of_date").alias("_horizon"))
    valid = with_totals(policies.where(~F.col("has_invalid_term")), horizon)
    sums = {
        "premium_in_force": "total_insurance_premium_of_the_policy",
        "building_coverage_in_force": "total_building_insurance_coverage",
        "contents_coverage_in_force": "total_contents_insurance_coverage",
        "policy_cost_in_force": "policy_cost",
    }
    # Policies of one county with the same first and last month end go on as one row, so a dozen
    # months per term multiply a few thousand cells and not the policies.
    begin, end = F.col("policy_effective_date"), F.col("policy_termination_date")
    before_end = F.least(F.date_sub(end, 1), F.col("_horizon"))
    last = F.when(F.last_day(before_end) == before_end, before_end).otherwise(F.last_day(F.add_months(before_end, -1)))
    spans = valid.select("*", F.last_day(begin).alias("_first"), last.alias("_last")).where("_first <= _last AND _horizon IS NOT NULL").groupBy(
        "county_fips", "_first", "_last").agg(
        F.sum("policy_count").alias("policies_in_force"), F.count(F.lit(1)).alias("policy_records"),
        *[F.sum(source).alias(name) for name, source in sums.items()])
    active = explode_month_ends(spans.withColumn("_until", F.date_add("_last", 1)), "_first", "_until", "_last")
    cells = active.groupBy("month_end", "county_fips").agg(
        F.sum("policies_in_force").cast("bigint").alias("policies_in_force"),
        F.sum("policy_records").cast("bigint").alias("policy_records"),
        *[_money_sum(spans, name).alias(name) for name in sums])
    named = left_lookup(cells, county_names(counties), "county_fips")
    month = year_month(F.col("month_end"))
    return named.select(
        "month_end", month.alias("year_month"), period_id("month", month).alias("period_id"),
        F.year("month_end").cast("smallint").alias("calendar_year"),
        "county_fips", "county_name", F.coalesce("_focus", F.lit(False)).alias("is_michigan"),
        "policies_in_force", "policy_records", *sums,
        (F.col("policies_in_force") - F.col("policy_records")).alias("policies_beyond_records"),
        is_small(F.col("policy_records"), params.small_cell).alias("is_small_cell"))


def disasters(declarations: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per disaster, collapsed from its designated areas."""
    still_open = tally(F.col("is_incident_open"))
    firsts = ("fema_declaration_string", "declaration_type", "declaration_title", "incident_type",
              "declaration_date", "incident_begin_date")
    return declarations.groupBy("disaster_number").agg(
        *[F.min(c).alias(c) for c in firsts],
        # Only a disaster whose every area has closed has an end.
        F.when(still_open == 0, F.max("incident_end_date")).alias("incident_end_date"),
        (still_open > 0).alias("is_incident_open"),
        F.bool_or("has_invalid_incident_window").alias("has_invalid_incident_window"),
        F.count(F.lit(1)).alias("designated_area_count"),
        F.count_distinct("county_fips").alias("designated_county_count"),
        tally(F.col("is_statewide")).alias("statewide_area_count"),
        F.count_distinct("state_code").alias("state_count"),
        F.bool_or("is_flood_related").alias("is_flood_related"),
        F.bool_or("is_major_disaster").alias("is_major_disaster"),
        F.bool_or(F.col("state_code") == params.focus_state).alias("touches_michigan"),
        F.bool_or("ia_program_declared").alias("ia_program_declared"),
        F.bool_or("pa_program_declared").alias("pa_program_declared"))


def claim_declarations(claims: DataFrame, declarations: DataFrame, disaster_rows: DataFrame,
                       params: Params = DEFAULT) -> DataFrame:
    """Which claims of the focus state fall inside which flood disaster, area by area."""
    today = F.lit(params.as_of) if params.as_of else F.current_date()
    grace = params.event_grace_days
    flood = disaster_rows.where("is_flood_related").select(
        "disaster_number", "declaration_type", "declaration_title", "incident_begin_date",
        "incident_end_date", "incident_type",
        F.date_add(F.coalesce("incident_end_date", today), grace).alias("_until"))
    areas = declarations.where(F.col("state_code") == params.focus_state).select(
        "state_code", "county_fips", "disaster_number", "is_statewide").join(flood, "disaster_number")
    mine = claims.where(F.col("state_code") == params.focus_state).select(
        "state_code", "claim_id", "county_fips", "date_of_loss", "year_of_loss", "total_amount_paid")
    hits = match_events(mine, areas, "date_of_loss", "incident_begin_date", "_until",
                        "state_code", "county_fips", "is_statewide")
    begin, end, loss = F.col("incident_begin_date"), F.col("incident_end_date"), F.col("date_of_loss")
    return hits.select(
        "claim_id", "county_fips", "date_of_loss", F.col("year_of_loss").alias("loss_year"),
        "total_amount_paid", "disaster_number", "declaration_type", "declaration_title",
        "incident_begin_date", "incident_end_date", "incident_type",
        F.col("is_statewide").alias("matched_via_statewide_declaration"),
        days_between(begin, end).alias("incident_duration_days"),
        days_between(begin, loss).alias("days_into_incident"),
        (loss > end).alias("is_in_grace_window"),
        F.lit(grace).alias("grace_window_days"))


def reconciliation(manifests: dict[str, DataFrame], claims: DataFrame, claims_mart: DataFrame,
                   declarations: DataFrame, disaster_rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Publisher, landing, raw, staged and mart counts of the three sources, with their gaps.

    Each manifest is one row. Every count is its own one-row aggregate, so nothing but
    counters meets in a join.
    """
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    def line(source: str, label: str, note, publisher, in_mart, frame: DataFrame) -> DataFrame:
        reported = publisher.cast("bigint")
        return frame.select(
            F.lit(source).alias("source_name"), F.lit(label).alias("measure_label"),
            reported.alias("publisher_figure"),
            *[F.col(c).cast("bigint").alias(c) for c in ("rows_landing", "rows_raw", "rows_duckdb")],
            F.col("_staged").alias("rows_staged"), in_mart.cast("bigint").alias("rows_in_mart"),
            (reported - F.col("rows_landing")).cast("bigint").alias("publisher_to_landing_gap"),
            (in_mart - F.col("rows_duckdb")).cast("bigint").alias("warehouse_to_mart_gap"),
            *[(F.col(c) if c in frame.columns else F.lit(None)).cast("string").alias(c)
              for c in ("retrieved_at", "source_last_refresh", "source_metadata_refresh")],
            note.alias("interpretation"))

    claim_counts = with_totals(with_totals(
        manifests["nfip_claims"], rows(claims, "_staged")),
        claims_mart.agg(F.sum("claim_count").alias("_mart")))
    area_counts = with_totals(with_totals(
        manifests["fema_declarations"], rows(declarations, "_staged")), rows(disaster_rows, "_mart"))
    policy_counts = with_totals(manifests["nfip_policies"], rows(policies, "_staged"))
    return union_all([
        line("nfip_claims", "claim records",
             F.lit("A publisher gap is timing; a warehouse-to-mart gap is a defect here."),
             F.col("source_reported_count"), F.col("_mart"), claim_counts),
        line("fema_declarations", "declaration-area records",
             F.concat(F.lit("Area rows collapse to "), F.col("_mart").cast("string"),
                      F.lit(" disasters in the mart.")),
             F.col("source_reported_count"), F.col("_staged"), area_counts),
        line("nfip_policies", "policy records (Michigan slice)",
             F.concat(F.lit("The slice has no published count; nationally there are "),
                      F.col("source_reported_national").cast("string"), F.lit(" policies.")),
             F.lit(None), F.col("_staged"), policy_counts),
    ])
