"""Intermediate models: ZIP weights, complaint allocation, entity matching, long measures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.flags import tally, value_at_max
from plumbline.functions.text import normalize_company_name
from plumbline.functions.typed import suppressed_number
from plumbline.operators.joins import lookup_fixed
from plumbline.operators.reshape import columns_where, union_all, unpivot_named
from plumbline.params import DEFAULT, Params
from plumbline.plans.conformed import state_dimension
from plumbline.plans.staging import GEOGRAPHY_KEYS
from plumbline.sources.seeds import fixed_table


def prefix_weights(crosswalk: DataFrame) -> DataFrame:
    """Three-digit ZIP prefixes to counties, weights scaled to add up to one per prefix."""
    pairs = crosswalk.groupBy("zip3", "county_fips").agg(
        F.sum("allocation_weight").alias("weight_sum")).where(F.col("weight_sum") > 0)
    prefix = Window.partitionBy("zip3")  # a few hundred counties at most
    return pairs.select(
        "zip3", "county_fips", "weight_sum",
        (F.col("weight_sum") / F.sum("weight_sum").over(prefix)).alias("allocation_weight"),
        F.count(F.lit(1)).over(prefix).alias("counties_in_prefix"))


def allocate_complaints(complaints: DataFrame, crosswalk: DataFrame, weights: DataFrame) -> DataFrame:
    """Place every complaint that names a state in counties, fractionally and without loss.

    Complaints are counted before they fan out. Full ZIPs and masked prefixes meet one
    weight table on one key, so the counts are joined once; what finds no ZIP or prefix, or
    has none, goes to its state's unassigned county. A state code without a FIPS code has a
    bucket of its own, named after it.
    """
    kind = F.col("zip_mask_kind")
    route = F.when(kind.isin("full", "prefix_masked"), kind).otherwise("unplaceable")
    place = F.when(kind == "full", F.col("zip5")).when(kind == "prefix_masked", F.col("zip3"))
    pending = F.col("is_response_pending")
    counts = (
        complaints.where(F.col("state_code").isNotNull())
        .groupBy("received_year_month", "state_code", "product_family",
                 route.alias("route"), place.alias("place"))
        .agg(F.count(F.lit(1)).alias("n"),
             tally(F.col("is_timely_response") & ~pending).alias("n_timely"),
             tally(F.col("response_grants_relief")).alias("n_relief"),
             tally(pending).alias("n_pending"),
             tally(F.col("has_tag_older_american")).alias("n_older"))
    )
    targets = union_all([
        crosswalk.select(F.lit("full").alias("route"), F.col("zip5").alias("place"),
                         "county_fips", "allocation_weight"),
        weights.select(F.lit("prefix_masked").alias("route"), F.col("zip3").alias("place"),
                       "county_fips", "allocation_weight"),
    ]).withColumn("found", F.lit(True))
    states = state_dimension(complaints.sparkSession).select("state_code", "state_fips")
    spread = lookup_fixed(counts.join(targets, ["route", "place"], "left"), states, "state_code")
    found = F.coalesce("found", F.lit(False))
    method = (
        F.when(found & (F.col("route") == "full"), "full_zip")
        .when(found, "zip3_prefix")
        .when(F.col("state_fips").isNull(), "state_without_fips")
        .when(F.col("route") == "full", "zip_not_in_crosswalk")
        .when(F.col("route") == "prefix_masked", "prefix_not_in_crosswalk")
        .otherwise("state_unassigned")
    )
    weight = F.when(found, F.col("allocation_weight")).otherwise(F.lit(1.0))
    unassigned = F.concat(F.coalesce("state_fips", "state_code"), F.lit("000"))
    placed = spread.withColumns({
        "allocation_method": method,
        "county_fips": F.when(found, F.col("county_fips")).otherwise(unassigned),
        "w": weight,
    })
    shares = {"allocated_complaints": "n", "allocated_timely": "n_timely",
              "allocated_relief": "n_relief", "allocated_pending": "n_pending",
              "allocated_older_american": "n_older"}
    return placed.groupBy(
        "received_year_month", "state_code", "county_fips", "product_family", "allocation_method"
    ).agg(*[F.sum(F.col(c) * F.col("w")).alias(name) for name, c in shares.items()],
          F.sum("n").alias("source_complaints_before_allocation"))


def match_companies(complaints: DataFrame, institutions: DataFrame,
                    params: Params = DEFAULT) -> DataFrame:
    """Company names to lender ids by exact normalised name; shared names are refused."""
    companies = complaints.where(F.col("company_name").isNotNull()).groupBy("company_name").agg(
        F.count(F.lit(1)).alias("complaint_count"),
        tally(F.col("state_code") == params.focus_state).alias("michigan_complaint_count"),
    ).withColumn("normalized_name", normalize_company_name(F.col("company_name")))
    year = F.col("activity_year")
    latest = institutions.where(F.col("institution_name_normalized").isNotNull()).groupBy("lei").agg(
        value_at_max(F.col("institution_name"), year).alias("institution_name"),
        value_at_max(F.col("institution_name_normalized"), year).alias("normalized_name"))
    names = latest.groupBy("normalized_name").agg(
        F.count(F.lit(1)).alias("_leis"), F.min("lei").alias("_lei"),
        F.min("institution_name").alias("_name"))
    single = F.col("_leis") == 1
    status = (
        F.when(F.col("normalized_name").isNull(), "unnormalizable")
        .when(F.col("_leis").isNull(), "no_lei_found")
        .when(~single, "ambiguous")
        .otherwise("matched")
    )
    return companies.join(names, "normalized_name", "left").select(
        "company_name", "normalized_name", "complaint_count", "michigan_complaint_count",
        F.when(single, F.col("_lei")).alias("lei"),
        F.when(single, F.col("_name")).alias("institution_name"),
        status.alias("match_status"),
        F.coalesce("_leis", F.lit(0)).alias("candidate_lei_count"),
        F.lit("exact_normalized_name").alias("match_method"))


# Endings of the measure column names, in the order they are tried, and the
# kind of measure each marks.
MEASURE_KINDS = (
    ("_PER_1000_BENES", "per_1000"),
    ("_PYMT_AMT", "amount"),
    ("_PYMT_PC", "per_capita"),
    ("_PYMT_PCT", "share_of_pymt"),
    ("_PYMT_PER_USER", "per_user"),
    ("_PYMT_PU", "per_user"),
    ("_PYMT", "amount"),
)
# Beneficiary counts and shares name their kind at the end, the word BENES first.
USER_KINDS = {"CNT": "user_count", "PCT": "user_pct"}
# Units a per-thousand measure may be counted in.
UTILISATION_UNITS = ("CVRD_STAYS", "CVRD_DAYS", "EPISODES", "VISITS", "EVNTS")
# Publisher spellings of a service and the code each stands for.
SERVICE_SPELLINGS = {"IP_CVRD_STAY": "IP", "ER_VISITS": "ER", "PRCDR": "PRCDRS"}


def decode_measure(column: str) -> tuple[str, str | None, bool]:
    """(service code, measure kind, whether standardised) from a measure column's name."""
    standardized = "_MDCR_STDZD_PYMT" in column
    kind = None
    user = re.fullmatch(r"BENES_.*_(CNT|PCT)", column)
    if column.endswith("_PER_1000_BENES"):
        kind = "per_1000"
    elif user:
        kind = USER_KINDS[user.group(1)]
    else:
        kind = next((k for ending, k in MEASURE_KINDS if column.endswith(ending)), None)
    if column.startswith("BENES_"):
        service = re.sub(r"_(CNT|PCT)$", "", column.removeprefix("BENES_"))
    elif column.endswith("_PER_1000_BENES"):
        service = re.sub(rf"_({'|'.join(UTILISATION_UNITS)})_PER_1000_BENES$", "", column)
    else:
        service = re.sub(r"_MDCR_(STDZD_)?PYMT(_.*)?$", "", column)
    return SERVICE_SPELLINGS.get(service, service), kind, standardized


def service_columns(df: DataFrame) -> list[str]:
    """Every column that is neither a key nor an enrolment or quality figure."""
    apart = {*GEOGRAPHY_KEYS, *fixed.NON_SERVICE_MEASURES}
    return columns_where(df, lambda c: c not in apart and not c.startswith("PQI"))


def decoded_names(df: DataFrame) -> DataFrame:
    """What each measure column of this file says, one row per column (some two hundred)."""
    lines = ["source_column|service_code|measure_kind|is_standardized"]
    for name in service_columns(df):
        service, kind, standardized = decode_measure(name)
        lines.append(f"{name}|{service}|{kind or ''}|{str(standardized).lower()}")
    names = fixed_table(df.sparkSession, "\n".join(lines)).withColumn(
        "is_standardized", F.col("is_standardized").cast("boolean"))
    services = fixed_table(df.sparkSession, fixed.SERVICE_CATEGORIES).withColumn(
        "is_long_term_care", F.col("is_long_term_care").cast("boolean"))
    return lookup_fixed(names, services, "service_code")


def service_measures(medicare_raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per published service figure; a figure the file leaves empty has no row."""
    long = unpivot_named(medicare_raw, GEOGRAPHY_KEYS, service_columns(medicare_raw))
    decoded = lookup_fixed(long, decoded_names(medicare_raw), "source_column")
    county = F.col("BENE_GEO_LVL") == "County"
    code = F.col("BENE_GEO_CD")
    return decoded.select(
        F.col("YEAR").cast("smallint").alias("measure_year"),
        F.col("YEAR").cast("string").alias("period_key"),
        F.lit("year").alias("period_grain"),
        F.col("BENE_GEO_LVL").alias("geo_level"),
        code.alias("geo_code"),
        F.col("BENE_GEO_DESC").alias("geo_description"),
        F.when(county, code).alias("county_fips"),
        F.coalesce(county & code.startswith(params.focus_state_fips), F.lit(False))
        .alias("is_michigan_county"),
        F.col("BENE_AGE_LVL").alias("age_level"),
        "service_code", "service_name", "is_long_term_care", "measure_kind", "is_standardized",
        suppressed_number(F.col("raw_value")).alias("measure_value"),
        (F.col("raw_value") == "*").alias("is_suppressed"),
        "source_column")
