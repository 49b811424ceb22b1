"""Can a source carry a county measure of the focus state? One scan per source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.typed import geoid_county
from plumbline.params import DEFAULT, Params
from plumbline.quality.results import PASS, WARN, counted, coverage_status, passes, results


@dataclass(frozen=True)
class Gate:
    """What "focus state" and "no usable county" mean in one source."""

    track: str
    source: str
    focus: Column
    unusable: Column
    county: Column | None
    needs_every_county: bool = False
    is_national: bool = True


def _blank(column: str) -> Column:
    value = F.col(column)
    return value.isNull() | (F.trim(value) == "")


def gates(params: Params = DEFAULT) -> dict[str, Gate]:
    """Per source; the columns are the raw ones."""
    state, fips = params.focus_state, params.focus_state_fips
    geoid = geoid_county(F.col("censusGeoid"))

    def vintage(source: str) -> Gate:
        return Gate("shared", source, (F.col("geo_level") == "county") & (F.col("state") == fips),
                    _blank("county"), F.concat("state", "county"), needs_every_county=True)

    listed = [
        Gate("insurance", "nfip_claims", F.col("state") == state, _blank("censusGeoid"), geoid),
        Gate("insurance", "nfip_policies", F.col("propertyState") == state, _blank("censusGeoid"), geoid,
             is_national=False),
        Gate("insurance", "fema_declarations", F.col("state") == state,
             _blank("fipsCountyCode") | (F.col("fipsCountyCode") == "000"),
             F.concat("fipsStateCode", "fipsCountyCode")),
        Gate("fintech", "cfpb_complaints", F.col("State") == state, _blank("`ZIP code`"), None),
        Gate("fintech", "hmda_lar", F.col("state_code") == state,
             _blank("county_code") | ~F.col("county_code").startswith(fips), F.col("county_code"),
             needs_every_county=True, is_national=False),
        Gate("health", "cms_geographic_variation",
             (F.col("BENE_GEO_LVL") == "County") & F.col("BENE_GEO_CD").startswith(fips),
             F.col("BENE_GEO_CD").endswith("000"), F.col("BENE_GEO_CD"), needs_every_county=True),
        vintage("acs5_detailed"), vintage("acs5_subject"),
        Gate("shared", "zip_county_crosswalk", F.col("state") == state,
             _blank("geoid") | (F.length("geoid") != 5), F.col("geoid"), needs_every_county=True),
    ]
    return {gate.source: gate for gate in listed}


def unusable_rates(raw: DataFrame, gate: Gate) -> DataFrame:
    """Focus and national rows, the unusable ones of each, and distinct focus counties."""
    national = F.lit(True) if gate.is_national else gate.focus
    county = gate.county if gate.county is not None else F.lit(None).cast("string")
    usable = gate.focus & ~F.coalesce(gate.unusable, F.lit(False))
    return raw.agg(
        F.count_if(gate.focus).alias("focus_rows"),
        F.count_if(gate.focus & gate.unusable).alias("focus_unusable"),
        F.count_if(national).alias("national_rows"),
        F.count_if(national & gate.unusable).alias("national_unusable"),
        F.count_distinct(F.when(usable, county)).alias("counties"))


def check_geography(raw: DataFrame, gate: Gate, params: Params = DEFAULT, is_sample: bool = False) -> DataFrame:
    rates = unusable_rates(raw, gate)
    rows, bad, counties = F.col("focus_rows"), F.col("focus_unusable"), F.col("counties")
    share = F.when(rows > 0, F.lit(100.0) * bad / rows)
    within = F.lit(True) if is_sample else share <= params.unusable_warn_pct
    usable = F.when(rows == 0, WARN).otherwise(passes(within, WARN))
    if gate.needs_every_county:
        roster = coverage_status(counties == params.focus_county_count, is_sample, WARN)
    else:
        roster = F.lit(PASS)
    return results(
        rates, gate.track, gate.source,
        ("focus geography usable", usable,
         counted(unusable=bad, rows=rows, national_unusable=F.col("national_unusable"),
                 national_rows=F.col("national_rows"))),
        ("focus county roster", roster, counted(counties=counties)))
