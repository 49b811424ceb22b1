"""Staging: rename, type and flag one raw table. Nothing is filtered.

Every function takes a raw frame and returns the staged one; both hold the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.functions import typed
from plumbline.functions.dates import days_between, price_period, year_month
from plumbline.functions.flags import payment_flags
from plumbline.functions.text import (
    blank_to_null,
    has_tag,
    marker_to_null,
    normalize_company_name,
    snake_case,
)
from plumbline.operators.joins import lookup_fixed
from plumbline.operators.reshape import columns_where, drop_then_add, rename
from plumbline.params import DEFAULT, Params
from plumbline.plans.conformed import state_dimension
from plumbline.sources.seeds import code_list, fixed_map



# ── insurance ────────────────────────────────────────────────────────────────────────────


def stage_claims(raw: DataFrame) -> DataFrame:
    """One row per flood claim."""
    names = {"id": "claim_id", "state": "state_code",
             "amountPaidOnIncreasedCostOfComplianceClaim": "amount_paid_on_icc_claim"}
    df = rename(raw, names, snake_case).withColumn(
        "reported_zip_code", F.nullif(F.col("reported_zip_code"), F.lit("")))
    county, county_source = typed.first_key(
        ("county_code", blank_to_null(F.col("county_code"))),
        ("census_geoid", typed.geoid_county(F.col("census_geoid"))))
    df = df.withColumns({"county_fips": county, "county_fips_source": county_source})
    states = state_dimension(raw.sparkSession).select(
        "state_code", F.col("state_fips").alias("_fips"))
    building, contents, icc = (F.col(f"amount_paid_on_{part}_claim") for part in ("building", "contents", "icc"))
    net = [F.col(f"net_{part}_payment_amount") for part in ("building", "contents", "icc")]
    flags = payment_flags(building, contents, icc,
                          F.col("non_payment_reason_building"), F.col("non_payment_reason_contents"))
    return lookup_fixed(df, states, "state_code").withColumns({
        "has_usable_county": F.col("county_fips").isNotNull(),
        "is_state_unknown": F.col("state_code") == "UN",
        "county_matches_reported_state": F.substring("county_fips", 1, 2) == F.col("_fips"),
        "loss_year_month": year_month(F.col("date_of_loss")),
        "loss_month": F.month("date_of_loss").cast("tinyint"),
        "total_amount_paid": building + contents + icc,
        "total_net_payment": net[0] + net[1] + net[2],
        **flags,
    }).drop("_fips")


def stage_policies(raw: DataFrame) -> DataFrame:
    """One row per policy record of the focus state."""
    names = {"id": "policy_id", "propertyState": "state_code",
             "preFIRMConstructionIndicator": "pre_firm_construction_indicator"}
    df = rename(raw, names, snake_case)
    begin, end = F.col("policy_effective_date"), F.col("policy_termination_date")
    county = typed.geoid_county(F.col("census_geoid"))
    return df.withColumns({
        "reported_zip_code": F.nullif(F.col("reported_zip_code"), F.lit("")),
        "county_fips": county,
        "has_usable_county": county.isNotNull(),
        "policy_term_days": days_between(begin, end),
        "has_invalid_term": end <= begin,
        "is_multi_policy_row": F.col("policy_count") > 1,
    })


def stage_declarations(raw: DataFrame) -> DataFrame:
    """One row per designated area of a disaster declaration."""
    df = rename(raw, {"id": "declaration_area_id", "state": "state_code"}, snake_case)
    begin, end = F.col("incident_begin_date"), F.col("incident_end_date")
    county = F.col("fips_county_code")
    return df.withColumns({
        "county_fips": F.concat("fips_state_code", "fips_county_code"),
        "is_statewide": county == "000",
        "has_usable_county": county != "000",
        "is_incident_open": end.isNull(),
        "has_invalid_incident_window": F.coalesce(end < begin, F.lit(False)),
        "incident_duration_days": days_between(begin, end),
        "is_major_disaster": F.col("declaration_type") == "DR",
        "is_flood_related": F.lower("incident_type").isin(*fixed.FLOOD_INCIDENTS),
    })


# ── fintech ──────────────────────────────────────────────────────────────────────────────

# The complaint archive's column titles.
COMPLAINT_COLUMNS = {
    "Complaint ID": "complaint_id",
    "Date received": "date_received",
    "Date sent to company": "date_sent_to_company",
    "Product": "product",
    "Sub-product": "sub_product",
    "Issue": "issue",
    "Sub-issue": "sub_issue",
    "Consumer complaint narrative": "consumer_narrative",
    "Company public response": "company_public_response",
    "Company": "company_name",
    "State": "state_code_raw",
    "ZIP code": "zip_code_raw",
    "Tags": "tags",
    "Submitted via": "submitted_via",
    "Company response to consumer": "company_response",
    "Timely response?": "timely_response_raw",
    "year": "partition_year",
}


def stage_complaints(raw: DataFrame) -> DataFrame:
    """One row per complaint. Labels of three taxonomy eras map to one family by literal maps."""
    kept = [c for c in raw.columns if c in COMPLAINT_COLUMNS]
    df = rename(raw.select([F.col(f"`{c}`") for c in kept]), COMPLAINT_COLUMNS)
    received = F.col("date_received").try_cast("date")
    sent = F.col("date_sent_to_company").try_cast("date")
    state, malformed = typed.same_length_state(F.col("state_code_raw"))
    zip_raw, response = F.col("zip_code_raw"), F.col("company_response")
    families = fixed_map(fixed.PRODUCT_FAMILIES, "product", "product_family")
    outcomes = {
        key: fixed_map(fixed.RESPONSE_FAMILIES, "company_response", key)
        for key in ("response_family", "is_closed", "grants_relief")
    }
    closed = typed.code_label(outcomes["is_closed"], response).cast("boolean")
    return drop_then_add(df, ["date_received", "date_sent_to_company", "timely_response_raw"], {
        "date_received": received,
        "date_sent_to_company": sent,
        "received_year_month": year_month(received),
        "received_year": F.year(received).cast("smallint"),
        "was_sent_before_received": F.coalesce(sent < received, F.lit(False)),
        "product_family": typed.code_label(families, F.col("product")),
        "response_family": typed.code_label(outcomes["response_family"], response),
        "response_grants_relief": typed.code_label(outcomes["grants_relief"], response).cast("boolean"),
        "is_response_pending": F.coalesce(~closed, F.lit(False)),
        "is_timely_response": F.col("timely_response_raw") == "Yes",
        "has_tag_older_american": has_tag(F.col("tags"), "Older American"),
        "has_tag_servicemember": has_tag(F.col("tags"), "Servicemember"),
        "has_narrative": F.col("consumer_narrative").isNotNull(),
        "state_code": state,
        "has_malformed_state": malformed,
        "zip_mask_kind": typed.zip_mask_kind(zip_raw),
        "zip5": typed.zip5(zip_raw),
        "zip3": typed.zip3(zip_raw),
    })


def stage_institutions(raw: DataFrame) -> DataFrame:
    """One row per filer and year."""
    return raw.select(
        "lei",
        F.col("name").alias("institution_name"),
        normalize_company_name(F.col("name")).alias("institution_name_normalized"),
        typed.as_whole(F.col("count")).cast("int").alias("filings_reported"),
        F.col("period").alias("activity_year"),
    )


# Which code list decodes which column, where the two names differ.
LABELLED = {
    **{name: (name, name) for name in (
        "action_taken", "loan_purpose", "loan_type", "lien_status", "occupancy_type",
        "construction_method", "preapproval", "hoepa_status", "business_or_commercial_purpose",
        "reverse_mortgage", "open_end_line_of_credit", "purchaser_type", "conforming_loan_limit",
        "submission_of_application", "initially_payable_to_institution")},
    **{f"{who}_sex": ("sex", f"{who}_sex") for who in ("applicant", "co_applicant")},
    **{f"{who}_{what}": (what, f"{who}_{what}_1")
       for what in ("ethnicity", "race") for who in ("applicant", "co_applicant")},
    **{f"denial_reason_{n}": ("denial_reason", f"denial_reason_{n}") for n in (1, 2, 3, 4)},
}
NOT_AN_AMOUNT = ("Exempt", "NA")
NOT_AN_AGE = ("8888", "9999")


def stage_lending(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per application. Twenty-five labels decode without a single join."""
    df = rename(raw, {}, snake_case)
    present = set(df.columns)
    amounts = [c for c in fixed.EXEMPTIBLE_AMOUNTS if c in present]
    plain = [c for c in fixed.PLAIN_AMOUNTS if c in present]
    codes = [c for c in fixed.EXEMPTIBLE_CODES if c in present]
    county, dti = F.col("county_code"), F.col("debt_to_income_ratio")
    added: dict[str, Column] = {}
    for name in amounts:
        added[name] = typed.as_number(F.col(name), NOT_AN_AMOUNT)
        added[f"{name}_sentinel"] = typed.only(F.col(name), NOT_AN_AMOUNT)
    for name in plain:
        added[name] = typed.as_number(F.col(name), NOT_AN_AMOUNT)
    added.update({
        "income": typed.as_number(F.col("income"), ("NA",)),
        "income_sentinel": typed.only(F.col("income"), ("NA",)),
        "is_partially_exempt": typed.any_true(
            [F.col(c) == "Exempt" for c in amounts] + [F.col(c) == "1111" for c in codes]),
        "county_fips": F.nullif(county, F.lit("NA")),
        "has_no_reported_county": county == "NA",
        "is_michigan_county": F.coalesce(county.startswith(params.focus_state_fips), F.lit(False)),
        "census_tract_geoid": F.nullif(F.col("census_tract"), F.lit("NA")),
        "has_no_reported_tract": F.col("census_tract") == "NA",
        "dti_band": dti,
        "dti_exact_pct": typed.banded_number(dti),
        "dti_sentinel": typed.only(dti, NOT_AN_AMOUNT),
        "total_units_band": F.col("total_units"),
        "total_units_exact": typed.banded_whole(F.col("total_units")).cast("int"),
        "applicant_age_band": typed.without(F.col("applicant_age"), NOT_AN_AGE),
        "applicant_age_sentinel": typed.only(F.col("applicant_age"), NOT_AN_AGE),
        "co_applicant_age_band": typed.without(F.col("co_applicant_age"), NOT_AN_AGE),
        "co_applicant_age_sentinel": typed.only(F.col("co_applicant_age"), NOT_AN_AGE),
    })
    for name, (list_name, source) in LABELLED.items():
        if source in present:
            added[f"{name}_label"] = typed.code_label(code_list(list_name), F.col(source))
    replaced = [*amounts, *plain, "income", "debt_to_income_ratio", "applicant_age",
                "co_applicant_age", "total_units"]
    return drop_then_add(df, replaced, added)


# ── health ───────────────────────────────────────────────────────────────────────────────

# The indicator file's run-together column names.
INDICATOR_COLUMNS = {
    "rowid": "cdc_rowid", "yearstart": "year_start", "yearend": "year_end",
    "locationabbr": "location_abbr", "locationdesc": "location_desc", "locationid": "location_id",
    "datasource": "data_source", "classid": "class_id", "topicid": "topic_id",
    "questionid": "question_id", "datavaluetypeid": "data_value_type_id",
    "data_value_footnote_symbol": "footnote_symbol", "data_value_footnote": "footnote_text",
    "stratificationcategory1": "stratification_category_1", "stratification1": "stratification_1",
    "stratificationcategoryid1": "stratification_category_id_1",
    "stratificationid1": "stratification_id_1",
    "stratificationcategory2": "stratification_category_2", "stratification2": "stratification_2",
    "stratificationcategoryid2": "stratification_category_id_2",
    "stratificationid2": "stratification_id_2",
}


def stage_indicators(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per indicator cell: a question for a place, cycle and stratification."""
    df = rename(raw, INDICATOR_COLUMNS)
    states = state_dimension(raw.sparkSession).select(
        F.col("state_code").alias("_code"), F.col("entity_type").alias("_kind"))
    df = lookup_fixed(df, states, F.col("location_abbr") == F.col("_code"))
    place, begin, end = F.col("location_abbr"), F.col("year_start"), F.col("year_end")
    topic_class = F.lower("class")
    kind = (
        F.when(place == "US", "national")
        .when(place.isin(*fixed.CENSUS_REGIONS), "census_region")
        .when(F.col("_kind").isin("state", "district", "territory"), F.col("_kind"))
        .otherwise("other")
    )
    numbers = ("data_value", "low_confidence_limit", "high_confidence_limit")
    return drop_then_add(df, ["year_start", "year_end", *numbers, "_code", "_kind"], {
        "year_start": begin.cast("smallint"),
        "year_end": end.cast("smallint"),
        "cycle_key": F.when(begin == end, begin).otherwise(F.concat(begin, F.lit("-"), end)),
        "period_grain": F.lit("survey_cycle"),
        "spans_multiple_years": begin != end,
        "location_kind": kind,
        "is_michigan": place == params.focus_state,
        "is_cognitive_decline": topic_class.contains("cognitive decline"),
        "is_caregiving": topic_class.contains("caregiv"),
        **{name: typed.blankable_number(F.col(name)) for name in numbers},
        "is_suppressed": typed.is_blank(F.col("data_value")),
        "has_footnote": F.col("footnote_symbol").isNotNull(),
        "has_confidence_interval": ~typed.is_blank(F.col("low_confidence_limit"))
        & ~typed.is_blank(F.col("high_confidence_limit")),
        "is_overall_age_group": F.col("stratification_1") == "Overall",
        "is_unstratified_second_dimension": F.coalesce(
            F.col("stratification_category_2") == "None", F.lit(True)),
    })


# Enrolment columns whose staged name is not just the lower-case one.
ENROLMENT_COLUMNS = {
    "YEAR": "measure_year", "BENE_GEO_LVL": "geo_level", "BENE_GEO_CD": "geo_code",
    "BENE_GEO_DESC": "geo_description", "BENE_AGE_LVL": "age_level",
    "BENES_WTH_PTAPTB_CNT": "benes_with_part_a_and_b_cnt",
    "BENES_OM_CNT": "benes_original_medicare_cnt",
    "BENES_MA_CNT": "benes_medicare_advantage_cnt",
    "MA_PRTCPTN_RATE": "ma_participation_rate",
    "BENE_FEML_PCT": "bene_female_pct", "BENE_RACE_WHT_PCT": "bene_race_white_pct",
    "BENE_RACE_HSPNC_PCT": "bene_race_hispanic_pct", "BENE_RACE_OTHR_PCT": "bene_race_other_pct",
    "BENE_DUAL_PCT": "bene_dual_eligible_pct",
    "ACUTE_HOSP_READMSN_CNT": "acute_hospital_readmission_cnt",
    "ACUTE_HOSP_READMSN_PCT": "acute_hospital_readmission_pct",
    "TOT_PBPMT_RDCTN_AMT": "total_payment_reduction_amt",
    "TOT_PBPMT_RDCTN_PCC": "total_payment_reduction_pct",
}
# Conditions in the prevention-quality column names.
QUALITY_CONDITIONS = {
    "DBTS": "diabetes", "COPD_ASTHMA": "copd_asthma", "HYPRTNSN": "hypertension",
    "CHF": "heart_failure", "BCTRL_PNA": "pneumonia", "UTI": "uti", "ASTHMA": "asthma",
    "LWRXTRMTY_AMPUTN": "amputation",
}
GEOGRAPHY_KEYS = ("YEAR", "BENE_GEO_LVL", "BENE_GEO_CD", "BENE_GEO_DESC", "BENE_AGE_LVL")


def enrolment_name(column: str) -> str:
    quality = re.fullmatch(r"(PQI\d\d)_(.+)_(AGE_.+)", column)
    if quality:
        number, condition, ages = quality.groups()
        return f"{number}_{QUALITY_CONDITIONS[condition]}_{ages}".lower()
    return ENROLMENT_COLUMNS.get(column, column.lower())


def stage_medicare(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Enrolment and quality figures per geography, year and age level."""
    measures = columns_where(raw, lambda c: c in fixed.NON_SERVICE_MEASURES or c.startswith("PQI"))
    df = rename(raw.select(*GEOGRAPHY_KEYS, *measures), {}, enrolment_name)
    names = [enrolment_name(c) for c in measures]
    county = F.col("geo_level") == "County"
    code = F.col("geo_code")
    marked = typed.count_marked([F.col(c) for c in names])
    return drop_then_add(df, ["measure_year", *names], {
        "measure_year": F.col("measure_year").cast("smallint"),
        **{c: typed.suppressed_number(F.col(c)) for c in names},
        "suppressed_cell_count": marked,
        "county_fips": F.when(county, code),
        "is_county_row": county,
        "is_unassigned_county": F.coalesce(county & (F.right(code, F.lit(3)) == "000"), F.lit(False)),
        "is_michigan_county": F.coalesce(county & code.startswith(params.focus_state_fips), F.lit(False)),
        "period_key": F.col("measure_year").cast("smallint").cast("string"),
        "period_grain": F.lit("year"),
        "is_all_ages": F.col("age_level") == "All",
        "ffs_beneficiary_denominator": typed.suppressed_number(F.col("benes_original_medicare_cnt")),
        "has_suppressed_cells": marked > 0,
    })


# ── shared ───────────────────────────────────────────────────────────────────────────────


def _vintage_columns(params: Params) -> list[Column]:
    year = F.col("vintage").cast("smallint")
    start = (year - 4).cast("smallint")
    county = F.when(F.col("geo_level") == "county", F.concat("state", "county"))
    return [
        F.col("vintage"),
        year.alias("vintage_year"),
        start.alias("vintage_window_start"),
        year.alias("vintage_window_end"),
        F.concat(start.cast("string"), F.lit("-"), F.col("vintage")).alias("vintage_label"),
        F.col("geo_level"),
        F.col("state").alias("state_fips"),
        F.col("county").alias("county_fips_3"),
        county.alias("county_fips"),
        F.col("NAME").alias("geography_name"),
        F.coalesce(F.col("state") == params.focus_state_fips, F.lit(False)).alias("is_michigan"),
    ]


def stage_population(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Population and housing units per place and five-year vintage."""
    estimates = {"total_population": "B01003_001", "total_housing_units": "B25001_001"}
    return raw.select(
        *_vintage_columns(params),
        *[typed.as_whole(F.col(f"{code}E")).alias(name) for name, code in estimates.items()],
        *[typed.annotated_margin(F.col(f"{code}M")).alias(f"{name}_margin")
          for name, code in estimates.items()],
        typed.is_annotated(F.col("B01003_001M")).alias("population_is_controlled_estimate"),
        typed.is_annotated(F.col("B25001_001M")).alias("housing_units_is_controlled_estimate"),
    )


def stage_population_65(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Residents over 65. Before the first such vintage the same line held a median age."""
    published = F.col("vintage").cast("smallint") >= params.first_65_plus_vintage
    return raw.select(
        *_vintage_columns(params),
        published.alias("population_65_plus_is_published"),
        F.when(published, typed.as_whole(F.col("S0101_C01_030E"))).alias("population_65_plus"),
        F.when(published, typed.annotated_margin(F.col("S0101_C01_030M")))
        .alias("population_65_plus_margin"),
        F.coalesce(published & typed.is_annotated(F.col("S0101_C01_030M")), F.lit(False))
        .alias("is_controlled_estimate"),
    )


def stage_prices(raw: DataFrame) -> DataFrame:
    """Price-index observations, de-padded; ``-`` means unavailable."""
    year = F.trim("year")
    value = marker_to_null(F.col("value"), "-")
    series = F.trim("series_id")
    return raw.select(
        series.alias("series_id"),
        year.cast("smallint").alias("calendar_year"),
        *[column.alias(name) for name, column in price_period(F.col("period"), year).items()],
        typed.as_number(value).alias("index_value"),
        value.isNull().alias("is_unavailable"),
        blank_to_null(F.col("footnote_codes")).alias("footnote_codes"),
        (series == fixed.DEFLATOR_SERIES).alias("is_deflator_series"),
        (F.substring(series, 3, 1) == "S").alias("is_seasonally_adjusted"),
    )


def stage_price_series(raw: DataFrame) -> DataFrame:
    """Definitions of the price-index series."""
    texts = ("series_id", "area_code", "item_code", "periodicity_code", "base_code", "base_period",
             "series_title", "begin_period", "end_period")
    return raw.select(
        *[F.trim(c).alias(c) for c in texts],
        blank_to_null(F.col("footnote_codes")).alias("footnote_codes"),
        F.trim("begin_year").cast("smallint").alias("begin_year"),
        F.trim("end_year").cast("smallint").alias("end_year"),
        F.col("seasonal").alias("seasonal_code"),
        (F.col("seasonal") == "S").alias("is_seasonally_adjusted"),
    )


def stage_crosswalk(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """ZIP to county weights, falling back to all addresses where a ZIP has no residents."""
    ratios = ("res_ratio", "bus_ratio", "oth_ratio", "tot_ratio")
    df = raw.select(
        F.col("zip").alias("zip5"),
        F.substring("zip", 1, 3).alias("zip3"),
        F.col("geoid").alias("county_fips"),
        F.col("city").alias("usps_city"),
        F.col("state").alias("state_code"),
        *[typed.as_number(F.col(c)).alias(c) for c in ratios],
    )
    total = F.sum("res_ratio").over(Window.partitionBy("zip5"))  # a handful of counties share a ZIP
    return df.select(
        *df.columns,
        F.when(total > 0, F.col("res_ratio")).otherwise(F.col("tot_ratio")).alias("allocation_weight"),
        F.when(total > 0, "res_ratio").otherwise("tot_ratio").alias("allocation_weight_source"),
        (total == 0).alias("zip_has_no_residential_addresses"),
        (F.length("county_fips") == 5).alias("has_full_county_fips"),
        (F.col("state_code") == params.focus_state).alias("is_michigan"),
    )
