"""Conformed dimensions: days, periods, states and counties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.dates import year_month
from plumbline.functions.flags import value_at_max
from plumbline.functions.text import blank_to_null
from plumbline.functions.typed import geoid_county
from plumbline.operators import generators as gen
from plumbline.operators.joins import with_totals, lookup_fixed
from plumbline.operators.reshape import union_all, union_distinct
from plumbline.params import DEFAULT, Params
from plumbline.sources.seeds import fixed_table


def date_dimension(spark: SparkSession) -> DataFrame:
    days = gen.date_range(spark, gen.CALENDAR_FIRST, gen.CALENDAR_LAST, "day", "date_day")
    return days.select("date_day", *[c.alias(n) for n, c in gen.calendar_attributes(F.col("date_day")).items()])


def period_dimension(spark: SparkSession, cycles: DataFrame | None = None) -> DataFrame:
    """Months, years and survey cycles under ids that name their grain."""
    start = F.col("period_start")
    months = gen.date_range(spark, gen.CALENDAR_FIRST, gen.CALENDAR_LAST, "month", "period_start").select(
        F.lit("month").alias("grain"), year_month(start).alias("period_key"), start,
        F.last_day(start).alias("period_end"), year_month(start).alias("period_label"),
        F.year(start).cast("smallint").alias("calendar_year"),
        F.lit(False).alias("spans_multiple_years"))
    year = F.col("y").cast("int")
    years = spark.range(gen.YEARS_FIRST, gen.YEARS_LAST + 1).toDF("y").select(
        F.lit("year").alias("grain"), year.cast("string").alias("period_key"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("period_start"),
        F.make_date(year, F.lit(12), F.lit(31)).alias("period_end"),
        year.cast("string").alias("period_label"), year.cast("smallint").alias("calendar_year"),
        F.lit(False).alias("spans_multiple_years"))
    seed = cycles if cycles is not None else fixed_table(spark, fixed.SURVEY_CYCLES)
    spans = seed.select(
        F.lit("survey_cycle").alias("grain"), F.col("cycle_key").alias("period_key"),
        F.make_date(F.col("year_start").cast("int"), F.lit(1), F.lit(1)).alias("period_start"),
        F.make_date(F.col("year_end").cast("int"), F.lit(12), F.lit(31)).alias("period_end"),
        F.col("cycle_label").alias("period_label"),
        F.col("year_end").cast("smallint").alias("calendar_year"),
        F.col("spans_multiple_years").cast("boolean").alias("spans_multiple_years"))
    ids = F.concat(F.col("grain"), F.lit(":"), F.col("period_key")).alias("period_id")
    return union_all([months, years, spans]).select(ids, "*")


def state_dimension(spark: SparkSession, params: Params = DEFAULT) -> DataFrame:
    """States, districts and territories; postal areas; and one row for an unknown state."""
    null = F.lit(None).cast("string")
    census = ("census_region", "census_region_name", "census_division", "census_division_name")
    first = ("state_code", "state_fips", "state_name", "entity_type")
    states = fixed_table(spark, fixed.STATES).select(
        *first, *census, F.lit(True).alias("is_us_jurisdiction"),
        (F.col("state_code") == params.focus_state).alias("is_michigan"))
    areas = fixed_table(spark, fixed.AREAS).select(
        "state_code", "state_fips", F.col("area_name").alias("state_name"), "entity_type",
        *[null.alias(c) for c in census], F.lit(False).alias("is_us_jurisdiction"),
        F.lit(False).alias("is_michigan"))
    unknown = spark.range(1).select(
        F.lit("UN").alias("state_code"), null.alias("state_fips"),
        F.lit("State unavailable").alias("state_name"), F.lit("unknown").alias("entity_type"),
        *[null.alias(c) for c in census], F.lit(None).cast("boolean").alias("is_us_jurisdiction"),
        F.lit(False).alias("is_michigan"))
    return union_all([states, areas, unknown])


def county_universe(claims_raw: DataFrame | None = None, policies_raw: DataFrame | None = None,
                    declarations_raw: DataFrame | None = None, medicare_raw: DataFrame | None = None,
                    lending_raw: DataFrame | None = None, crosswalk_raw: DataFrame | None = None,
                    population_65: DataFrame | None = None) -> list[tuple[str, DataFrame]]:
    """Each source's county keys as published, one column per source, repeats and all."""
    found: list[tuple[str, DataFrame]] = []

    def add(name: str, df: DataFrame | None, key, where=None) -> None:
        if df is not None:
            rows = df if where is None else df.where(where)
            found.append((name, rows.select(key.alias("county_fips"))))

    geoid = geoid_county(F.col("censusGeoid"))
    add("nfip_claims", claims_raw, F.coalesce(blank_to_null(F.col("countyCode")), geoid))
    add("nfip_policies", policies_raw, geoid)
    add("fema_declarations", declarations_raw, F.concat("fipsStateCode", "fipsCountyCode"))
    add("cms_geographic_variation", medicare_raw, F.col("BENE_GEO_CD"), F.col("BENE_GEO_LVL") == "County")
    add("hmda_lar", lending_raw, F.col("county_code"), F.col("county_code") != "NA")
    add("zip_county_crosswalk", crosswalk_raw, F.col("geoid"))
    add("acs5_subject", population_65, F.col("county_fips"), F.col("geo_level") == "county")
    return found


def county_dimension(population: DataFrame, referenced: list[tuple[str, DataFrame]],
                     params: Params = DEFAULT) -> DataFrame:
    """Every county key anything refers to, named where a vintage names it and classified."""
    spark = population.sparkSession
    vintage = F.col("vintage")
    named = population.where(F.col("geo_level") == "county").groupBy(
        "county_fips", "state_fips", "county_fips_3"
    ).agg(F.min(vintage).alias("first_vintage"), F.max(vintage).alias("last_vintage"),
          value_at_max(F.col("geography_name"), vintage).alias("county_name_full"))
    latest = population.agg(F.max(vintage).alias("_latest"))
    exceptions = fixed_table(spark, fixed.COUNTY_EXCEPTIONS)
    keys = union_distinct([
        named.select("county_fips"), exceptions.select("county_fips"), *[df for _, df in referenced],
    ]).where(F.trim("county_fips") != "")
    own = named.select("county_fips", F.col("state_fips").alias("_state"),
                       F.col("county_fips_3").alias("_three"), "first_vintage", "last_vintage",
                       "county_name_full")
    joined = keys.join(own, "county_fips", "left")
    joined = lookup_fixed(joined, exceptions.select(
        "county_fips", F.col("county_name").alias("_exception"), F.col("note").alias("geography_note")),
        "county_fips")
    key = F.col("county_fips")
    full = F.length(key) == 5
    kind = (
        F.when(F.col("_state").isNotNull(), "county")
        .when(full & (F.right(key, F.lit(3)) == "000"), "unknown_county")
        .when(F.substring(key, 1, 2).isin(*fixed.ISLAND_AREA_FIPS), "island_area")
        .otherwise("retired")
    )
    classified = joined.withColumns({
        "state_fips": F.coalesce("_state", F.substring(key, 1, 2)),
        "county_fips_3": F.coalesce(F.col("_three"), F.when(full, F.substring(key, 3, 3))),
        "geography_kind": kind,
    })
    states = state_dimension(spark, params).where(F.col("state_fips").isNotNull()).select(
        "state_fips", "state_code", "state_name")
    placed = with_totals(lookup_fixed(classified, states, "state_fips"), latest)
    short_name = F.nullif(F.split_part(F.col("county_name_full"), F.lit(","), F.lit(1)), F.lit(""))
    unknown_name = F.when(F.col("geography_kind") == "unknown_county",
                          F.concat("state_code", F.lit("-UNKNOWN")))
    return placed.select(
        "county_fips", "state_fips", "county_fips_3", "state_code", "state_name",
        F.coalesce(short_name, F.col("_exception"), unknown_name).alias("county_name"),
        "county_name_full", "geography_kind",
        (F.col("geography_kind") == "county").alias("is_reportable_county"),
        (F.col("state_fips") == params.focus_state_fips).alias("is_michigan"),
        "first_vintage", "last_vintage",
        (F.col("last_vintage") == F.col("_latest")).alias("is_current_vintage"),
        "geography_note",
    )
