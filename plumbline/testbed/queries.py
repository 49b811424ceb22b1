"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans import intermediate, staging
from plumbline.plans import marts_health as health
from plumbline.plans import marts_insurance as insurance
from plumbline.plans import marts_lending as lending
from plumbline.testbed.frames import Testbed


@dataclass(frozen=True)
class Entry:
    build: Callable[[Testbed], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    """Fractional sums depend on the order of addition, so both engines round them."""
    return df.select([
        F.round(F.col(c), places).alias(c) if c in columns else F.col(c) for c in df.columns])


def entry(name: str, sql: str | None):
    def register(build: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(build, sql)
        return build

    return register


def _replace(relation: str, columns: list[str], places: int = 6) -> str:
    rounding = ", ".join(f"round({c}, {places}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({rounding}) FROM {relation}" if columns else f"SELECT * FROM {relation}"


# ── staging: one query per raw table ─────────────────────────────────────────────────────
_UNPUBLISHED = ["cdc_rowid", "location_id", "data_source", "topic_id", "data_value_type_id", "footnote_text",
                "stratification_category_1", "stratification_category_id_1", "stratification_id_1",
                "stratification_category_id_2", "stratification_id_2", "geolocation"]

entry("stage_claims", "SELECT * FROM claims")(lambda t: t.claims)
entry("stage_policies", "SELECT * FROM policies")(lambda t: t.policies)
entry("stage_declarations", "SELECT * FROM declarations")(lambda t: t.declarations)
entry("stage_complaints", "SELECT * FROM complaints")(lambda t: t.complaints)
entry("stage_institutions", "SELECT * FROM institutions")(lambda t: t.institutions)
entry("stage_lending", "SELECT * FROM lending")(lambda t: t.lending)
entry("stage_indicators", "SELECT * FROM cells")(lambda t: t.indicators.drop(*_UNPUBLISHED))
entry("stage_medicare", "SELECT * FROM medicare")(lambda t: t.medicare)
entry("stage_population", "SELECT * FROM population")(lambda t: t.population)
entry("stage_population_65", "SELECT * FROM population_65")(lambda t: t.population_65)
entry("stage_prices", "SELECT * FROM prices")(lambda t: t.prices)
entry("stage_price_series", "SELECT * FROM price_series")(lambda t: staging.stage_price_series(t.raw("price_series")))
entry("stage_crosswalk", "SELECT * FROM crosswalk")(lambda t: t.crosswalk)

# ── conformed and intermediate ───────────────────────────────────────────────────────────
entry("county_dimension", "SELECT * FROM counties")(lambda t: t.counties)
entry("prefix_weights", _replace("weights", ["weight_sum", "allocation_weight"]))(
    lambda t: rounded(t.weights, ["weight_sum", "allocation_weight"]))
entry("complaint_allocation", _replace("allocation", list(lending.ALLOCATED)))(
    lambda t: rounded(t.allocation, list(lending.ALLOCATED)))
entry("allocation_conservation", "SELECT state_code, count(*) AS complaints FROM complaints WHERE state_code IS NOT NULL GROUP BY ALL")(
    lambda t: t.allocation.groupBy("state_code").agg(
        F.round(F.sum("allocated_complaints"), 4).cast("bigint").alias("complaints")))
entry("company_matches", "SELECT * FROM matches")(
    lambda t: intermediate.match_companies(t.complaints, t.institutions, t.params))
entry("service_measures", "SELECT * FROM measures")(lambda t: t.measures)

# ── marts ────────────────────────────────────────────────────────────────────────────────
_CLAIM_RATES = ["avg_paid_per_claim", "paid_total_constant", "avg_paid_per_claim_constant"]
entry("claims_monthly", _replace("claims_monthly", _CLAIM_RATES, 4))(lambda t: rounded(
    insurance.claims_monthly(t.claims, t.population, t.prices, t.counties, t.params), _CLAIM_RATES, 4))
entry("claims_detail", _replace("claims_detail", ["total_amount_paid_constant"], 4))(lambda t: rounded(
    insurance.claims_detail(t.claims, t.prices, t.counties, t.params), ["total_amount_paid_constant"], 4))
entry("policies_in_force", "SELECT * FROM in_force")(
    lambda t: insurance.policies_in_force(t.policies, t.counties, t.params))
entry("disasters", "SELECT * FROM disasters")(lambda t: insurance.disasters(t.declarations, t.params))
entry("claim_declarations", "SELECT * FROM bridge")(lambda t: insurance.claim_declarations(
    t.claims, t.declarations, insurance.disasters(t.declarations, t.params), t.params))
entry("complaints_daily", _replace("complaints_daily", ["timely_rate_pct", "relief_rate_pct"]))(lambda t: rounded(
    lending.complaints_daily(t.complaints, t.params), ["timely_rate_pct", "relief_rate_pct"]))
entry("complaints_by_company", _replace("complaints_company", ["timely_rate_pct", "relief_rate_pct"]))(
    lambda t: rounded(lending.complaints_by_company(t.complaints, t.params), ["timely_rate_pct", "relief_rate_pct"]))
_GEO = [*lending.ALLOCATED, "complaints_per_100k"]
entry("complaints_by_county", f"""SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in _GEO)},
  round(allocated_complaints, 4) < 10 AS is_small_cell) FROM complaints_geo""")(
    lambda t: rounded(lending.complaints_by_county(t.allocation, t.population, t.counties, t.params), _GEO, 4)
    .withColumn("is_small_cell", F.col("allocated_complaints") < 10))
entry("publication_window", "SELECT * FROM publication")(lambda t: lending.publication_window(t.complaints, t.params))
entry("lending_annual", "SELECT * REPLACE (round(originated_amount, 2) AS originated_amount, "
      "round(application_amount, 2) AS application_amount, round(denial_rate_pct, 6) AS denial_rate_pct) FROM lending_annual")(
    lambda t: rounded(rounded(lending.lending_annual(t.lending, t.institutions, t.counties, t.params),
                              ["originated_amount", "application_amount"], 2), ["denial_rate_pct"]))
entry("match_rate", "SELECT * FROM match_rate")(
    lambda t: lending.match_rate(intermediate.match_companies(t.complaints, t.institutions, t.params)))
entry("health_indicators", "SELECT * FROM indicators")(lambda t: health.indicators(t.indicators))
_CHANGES = ["gap_to_national", "mi_change_from_prior"]
entry("state_vs_national", _replace("versus", _CHANGES))(
    lambda t: rounded(health.state_vs_national(health.indicators(t.indicators), t.params), _CHANGES))
_COSTS = [f"{c}{s}" for c in ("cost_per_capita", "national_cost_per_capita", "gap_to_national") for s in ("", "_constant")]
entry("medicare_cost", _replace("cost", _COSTS))(
    lambda t: rounded(health.medicare_cost(t.measures, t.medicare, t.prices, t.params), _COSTS))
entry("medicare_services", _replace("services", ["ratio_to_national", "gap_to_national"]))(lambda t: rounded(
    health.medicare_services(t.measures, t.medicare, t.counties, t.params), ["ratio_to_national", "gap_to_national"]))
entry("population_65_plus", _replace("elderly", ["county_share_of_state_pct"]))(lambda t: rounded(
    health.population_65_plus(t.population_65, t.counties, t.params), ["county_share_of_state_pct"]))
entry("need_vs_capacity", _replace("need", ["population_change_pct", "indicator_change_pp"]))(lambda t: rounded(
    health.need_vs_capacity(
        health.population_65_plus(t.population_65, t.counties, t.params),
        health.state_vs_national(health.indicators(t.indicators), t.params), t.params),
    ["population_change_pct", "indicator_change_pp"]))
