"""Fintech marts: complaint outcomes, publication window, lending, match rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.dates import period_id, year_month, year_of_key
from plumbline.functions.flags import income_bracket, is_small, percent, sum_where, tally
from plumbline.functions.text import packed, unpacked
from plumbline.operators.aggregates import exact_medians
from plumbline.operators.joins import attach_clamped, left_lookup, lookup_fixed
from plumbline.params import DEFAULT, Params
from plumbline.session import materialise
from plumbline.plans.conformed import state_dimension
from plumbline.plans.marts_insurance import county_names, county_population
from plumbline.plans.staging import LABELLED, code_list


def outcome_counts(unspecified: bool) -> dict[str, Column]:
    """Complaint tallies by outcome. Open complaints have no outcome and are counted apart."""
    pending, family = F.col("is_response_pending"), F.col("response_family")
    counts = {
        "complaint_count": F.count(F.lit(1)),
        "closed_complaints": tally(~pending),
        "pending_complaints": tally(pending),
        "timely_count": tally(F.col("is_timely_response") & ~pending),
        "relief_count": tally(F.col("response_grants_relief")),
        "monetary_relief_count": tally(family == "monetary_relief"),
        "non_monetary_relief_count": tally(family == "non_monetary_relief"),
    }
    if unspecified:
        counts["relief_unspecified_count"] = tally(family.isin("relief_unspecified", "closed_unspecified"))
    counts.update({
        "untimely_count": tally(family == "untimely"),
        "older_american_count": tally(F.col("has_tag_older_american")),
        "servicemember_count": tally(F.col("has_tag_servicemember")),
        "narrative_count": tally(F.col("has_narrative")),
    })
    return counts


def _rates(params: Params) -> list[Column]:
    closed = F.col("closed_complaints")
    return [
        percent(F.col("timely_count"), closed).alias("timely_rate_pct"),
        percent(F.col("relief_count"), closed).alias("relief_rate_pct"),
        is_small(F.col("complaint_count"), params.small_cell).alias("is_small_cell"),
    ]


def complaints_daily(complaints: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Day x state x full product and issue taxonomy."""
    counts = outcome_counts(unspecified=False)
    taxonomy = ["product_family", "product", "sub_product", "issue", "sub_issue"]
    cells = complaints.where(F.col("state_code").isNotNull()).groupBy(
        "date_received", "state_code", *taxonomy
    ).agg(*[c.alias(n) for n, c in counts.items()])
    states = state_dimension(complaints.sparkSession, params).select(
        "state_code", "state_name", F.col("is_michigan").alias("_focus"), "census_division_name")
    day = F.col("date_received")
    return lookup_fixed(cells, states, "state_code").select(
        "date_received", year_month(day).alias("year_month"),
        period_id("month", year_month(day)).alias("period_id"),
        F.year(day).cast("smallint").alias("received_year"),
        F.quarter(day).cast("tinyint").alias("received_quarter"),
        "state_code", "state_name", F.coalesce("_focus", F.lit(False)).alias("is_michigan"),
        "census_division_name", *taxonomy, *counts, *_rates(params))


def complaints_by_company(complaints: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Month x state x company x product family."""
    counts = outcome_counts(unspecified=True)
    cells = complaints.where(F.col("state_code").isNotNull()).groupBy(
        F.col("received_year_month").alias("year_month"), "state_code", "company_name", "product_family"
    ).agg(*[c.alias(n) for n, c in counts.items()])
    states = state_dimension(complaints.sparkSession, params).select(
        "state_code", F.col("is_michigan").alias("_focus"))
    return lookup_fixed(cells, states, "state_code").select(
        "year_month", period_id("month", F.col("year_month")).alias("period_id"),
        year_of_key(F.col("year_month")).alias("received_year"),
        "state_code", F.coalesce("_focus", F.lit(False)).alias("is_michigan"),
        "company_name", "product_family", *counts, *_rates(params))


ALLOCATED = ("allocated_complaints", "allocated_timely", "allocated_relief", "allocated_pending",
             "allocated_older_american")


def complaints_by_county(allocation: DataFrame, population: DataFrame, counties: DataFrame,
                         params: Params = DEFAULT) -> DataFrame:
    """Month x county x product family, per 100,000 residents of the nearest vintage."""
    dated = allocation.withColumn("received_year", year_of_key(F.col("received_year_month")))
    placed = attach_clamped(
        dated, county_population(population), "received_year", "_county", "vintage_year",
        ["county_population", "population_vintage_window"], "population_is_extrapolated",
        fact_key="county_fips")
    named = left_lookup(placed, county_names(counties, "geography_kind"), "county_fips")
    total = F.col("allocated_complaints")
    return named.select(
        F.col("received_year_month").alias("year_month"),
        period_id("month", F.col("received_year_month")).alias("period_id"),
        "received_year", "state_code", "county_fips", "county_name",
        F.coalesce("_focus", F.lit(False)).alias("is_michigan"), "geography_kind",
        "product_family", "allocation_method", *ALLOCATED, "county_population",
        "population_vintage_window", "population_is_extrapolated",
        percent(total, F.col("county_population"), 100000.0).alias("complaints_per_100k"),
        is_small(total, params.small_cell).alias("is_small_cell"))


def publication_window(complaints: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Which months are closed enough to report, and the latest of them.

    The windows run over one row per month of publication, whatever the number of complaints.
    """
    threshold = F.lit(params.pending_threshold_pct)
    months = complaints.where(F.col("received_year_month").isNotNull()).groupBy(
        F.col("received_year_month").alias("year_month")
    ).agg(F.min("date_received").alias("first_received"), F.max("date_received").alias("last_received"),
          F.count(F.lit(1)).alias("complaint_count"),
          tally(F.col("is_response_pending")).alias("pending_count"))
    every_month = Window.partitionBy(F.lit(0))
    month, share = F.col("year_month"), F.col("_share")
    complete = share < threshold
    rated = months.withColumn("_share", percent(F.col("pending_count"), F.col("complaint_count"))).withColumns({
        "_last": F.max("last_received").over(every_month),
        "_latest_complete": F.max(F.when(complete, month)).over(every_month),
    })
    return rated.select(
        "year_month", period_id("month", month).alias("period_id"), "first_received", "last_received",
        "complaint_count", "pending_count", F.round(share, 4).alias("pending_pct"),
        (year_month(F.col("_last")) > month).alias("is_calendar_month_over"),
        complete.alias("is_publication_complete"), threshold.alias("pending_threshold_pct"),
        (month == F.col("_latest_complete")).alias("is_latest_complete_month"))


LENDING_TRAITS = (
    "loan_purpose_label", "loan_type_label", "lien_status_label", "occupancy_type_label",
    "construction_method_label", "applicant_age_band", "applicant_race_label",
    "applicant_ethnicity_label", "applicant_sex_label", "dti_band", "denial_reason_1_label",
    "applicant_income_bracket",
)
# What each action code means for a decision.
ACTION_GROUPS = {
    "decided_applications": ("1", "2", "3"),
    "originated_count": ("1",),
    "approved_not_accepted_count": ("2",),
    "denied_count": ("3",),
    "withdrawn_count": ("4",),
    "closed_incomplete_count": ("5",),
    "purchased_count": ("6",),
    "preapproval_count": ("7", "8"),
}


def _usual_labels(trait: str) -> list[str]:
    """The labels that a trait's code list knows; bands have none."""
    known = LABELLED.get(trait.removesuffix("_label"))
    return list(dict.fromkeys(code_list(known[0]).values())) if known else []


def lending_annual(lending: DataFrame, institutions: DataFrame, counties: DataFrame,
                   params: Params = DEFAULT, medians: bool = True) -> DataFrame:
    """Year x county x lender x twelve loan and applicant traits; without the two ``medians`` if nobody reads them.

    The register is aggregated before anything is joined, so a lender or county holding a
    third of it is one key in the joins. Nearly every application is a group of its own, so what
    moves is kept narrow: the traits travel as one short text, and a median of up to two values lies
    between the extremes that the cells know. Others come from the distributed selection, because a
    built-in median gathers a group's values in one task; they join the cells' own aggregate as rows.
    """
    action = F.col("action_taken")
    originated = action == "1"
    usual = {t: _usual_labels(t) for t in LENDING_TRAITS}
    keys = ["activity_year", "county_fips", "has_no_reported_county", "lei", "_traits"]
    measures = {"median_originated_amount": F.col("loan_amount"), "median_applicant_income": F.col("income")}
    traits = lending.withColumn("applicant_income_bracket", income_bracket(
        F.col("income"), F.col("ffiec_msa_md_median_family_income"))).withColumn("_traits", packed(usual)).select(
        *keys, "action_taken", "loan_amount", "income", "is_partially_exempt",
        F.col("denial_reason_2_label").isNotNull().alias("_has_second"))
    if medians:
        # The register is wide and read by the cells and by the medians: the columns they need are written once.
        traits = materialise(traits, "register-traits")
        measured = traits.where(originated).select(*keys, *[v.alias(m) for m, v in measures.items()])
        rows = traits.withColumn("_application", F.lit(1)).unionByName(
            exact_medians(measured, keys, list(measures)), allowMissingColumns=True)
    else:
        rows, measures = traits.withColumn("_application", F.lit(1)), {}
    stitched = rows.groupBy(*keys).agg(
        F.count("_application").alias("application_count"),
        *[tally(action.isin(*codes)).alias(name) for name, codes in ACTION_GROUPS.items()],
        sum_where(F.col("loan_amount"), originated).alias("originated_amount"),
        F.sum("loan_amount").alias("application_amount"),
        *[F.coalesce(F.max(m), (F.min(F.when(originated, v)) + F.max(F.when(originated, v))) / 2).alias(m)
          for m, v in measures.items()],
        tally(F.col("is_partially_exempt")).alias("partially_exempt_count"),
        tally(F.col("_has_second")).alias("has_secondary_denial_reason"))
    # A lender files once a year, so the name adds no rows.
    names = institutions.select("lei", "activity_year", "institution_name")
    names = materialise(names, "institution-names")
    named = left_lookup(stitched.join(names, ["lei", "activity_year"], "left"),
                        county_names(counties), "county_fips")
    named = named.select("*", *unpacked(F.col("_traits"), usual))
    return named.select(
        F.col("activity_year").cast("smallint").alias("activity_year"),
        period_id("year", F.col("activity_year")).alias("period_id"),
        "county_fips", "county_name", F.coalesce("_focus", F.lit(False)).alias("is_michigan"),
        "has_no_reported_county", "lei", "institution_name", *LENDING_TRAITS,
        "application_count", *ACTION_GROUPS, "originated_amount", "application_amount",
        *measures, "partially_exempt_count",
        "has_secondary_denial_reason",
        percent(F.col("denied_count"), F.col("decided_applications")).alias("denial_rate_pct"),
        is_small(F.col("application_count"), params.small_cell).alias("is_small_cell"))


def match_rate(matches: DataFrame) -> DataFrame:
    """Four coverage figures of the company match, from one scan."""
    status = F.col("match_status")
    matched = status == "matched"
    totals = matches.agg(
        F.count(F.lit(1)).alias("names"), F.sum("complaint_count").alias("complaints"),
        F.sum("michigan_complaint_count").alias("focus"), tally(matched).alias("m_names"),
        sum_where(F.col("complaint_count"), matched).alias("m_complaints"),
        sum_where(F.col("michigan_complaint_count"), matched).alias("m_focus"),
        tally(status == "ambiguous").alias("ambiguous"))
    bases = (
        ("company_names", "m_names", "names", "Company names that found exactly one lender."),
        ("complaints_national", "m_complaints", "complaints", "Complaints of matched companies."),
        ("complaints_michigan", "m_focus", "focus", "Focus-state complaints of matched companies."),
        ("ambiguous_names", "ambiguous", "names", "Names shared by several lenders, left unmatched."),
    )
    lines = F.array(*[
        F.struct(F.lit(basis).alias("coverage_basis"), F.col(part).alias("matched"),
                 F.col(whole).alias("total"), F.lit(note).alias("interpretation"))
        for basis, part, whole, note in bases])
    return totals.select(F.inline(lines)).select(
        "coverage_basis", "matched", "total",
        F.round(F.try_divide(F.lit(100.0) * F.col("matched"), F.col("total")), 2).alias("coverage_pct"),
        "interpretation")
