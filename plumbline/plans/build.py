"""The whole run: raw trees to staged views, conformed dimensions and published marts.

Staging and intermediate models are views over the raw trees. Dimensions and marts are
tables: each is written once and the next model reads its files, so the county dimension
has a measured size by the time a mart looks it up.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.joins import with_totals
from plumbline.operators.reshape import union_all

from plumbline.params import DEFAULT, Params
from plumbline.plans import conformed, intermediate, staging
from plumbline.plans import marts_health as health
from plumbline.plans import marts_insurance as insurance
from plumbline.plans import marts_lending as lending
from plumbline.quality.catalog import catalogue_rows, data_dictionary
from plumbline.quality.results import SKIP, counted, passes, results
from plumbline.sources.readers import read_manifest, read_partitioned
from plumbline.sources.registry import RAW_TABLES, RawTable
from plumbline.sources.sinks import publish_view, save_table


def load_raw(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every registered raw tree that has landed under ``root/<track>/<source>``."""
    found = {t.source: _landed(spark, f"{root}/{t.track}/{t.source}") for t in RAW_TABLES}
    return {source: df for source, df in found.items() if df is not None}


def _landed(spark: SparkSession, path: str) -> DataFrame | None:
    """A raw tree, or None where there is none or no file in it."""
    try:
        return read_partitioned(spark, path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_manifests(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The manifest beside each raw tree that has one."""
    found: dict[str, DataFrame] = {}
    for t in RAW_TABLES:
        try:
            found[t.source] = read_manifest(spark, f"{root}/{t.track}/{t.source}/manifest.json")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def load_report(spark: SparkSession, raw: Mapping[str, DataFrame], manifests: Mapping[str, DataFrame],
                tables: Sequence[RawTable] = RAW_TABLES) -> DataFrame:
    """One result per registered source: what was loaded against what its manifest recorded.

    A source that has not landed is skipped, one without a manifest passes unchecked.
    """
    parts = []
    for t in tables:
        if t.source not in raw:
            parts.append(results(spark.range(1), t.track, t.source, ("reload", SKIP, F.lit("not landed"))))
            continue
        rows = raw[t.source].agg(F.count(F.lit(1)).alias("rows"))
        recorded = F.lit(None).cast("bigint")
        if t.source in manifests:
            rows, recorded = with_totals(rows, manifests[t.source].select(F.col("rows_duckdb").cast("bigint").alias("recorded"))), F.col("recorded")
        parts.append(results(rows, t.track, t.source, (
            "reload", passes(F.coalesce(F.col("rows") == recorded, F.lit(True))), counted(rows=F.col("rows"), recorded=recorded))))
    return union_all(parts)


def stage_all(raw: Mapping[str, DataFrame], params: Params = DEFAULT) -> dict[str, DataFrame]:
    """Each landed source staged; a source that is absent is simply not there."""
    steps = {
        "nfip_claims": staging.stage_claims,
        "nfip_policies": staging.stage_policies,
        "fema_declarations": staging.stage_declarations,
        "cfpb_complaints": staging.stage_complaints,
        "hmda_lar": lambda df: staging.stage_lending(df, params),
        "hmda_institutions": staging.stage_institutions,
        "cdc_healthy_aging": lambda df: staging.stage_indicators(df, params),
        "cms_geographic_variation": lambda df: staging.stage_medicare(df, params),
        "acs5_detailed": lambda df: staging.stage_population(df, params),
        "acs5_subject": lambda df: staging.stage_population_65(df, params),
        "cpi_u": staging.stage_prices,
        "cpi_u_series": staging.stage_price_series,
        "zip_county_crosswalk": lambda df: staging.stage_crosswalk(df, params),
    }
    return {source: step(raw[source]) for source, step in steps.items() if source in raw}


def publish_views(staged: Mapping[str, DataFrame]) -> None:
    """Temporary views named as the layers are, for ad-hoc SQL over the run."""
    for table in RAW_TABLES:
        if table.source in staged:
            publish_view(staged[table.source], table.staged.partition(".")[2])


def build_all(spark: SparkSession, raw: Mapping[str, DataFrame], params: Params = DEFAULT,
              manifests: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Write every dimension and mart whose sources have landed; returns them by table name.

    ``manifests`` adds the insurance reconciliation, which compares against publishers'
    counts.
    """
    staged = stage_all(raw, params)
    publish_views(staged)
    built: dict[str, DataFrame] = {}

    def table(name: str, make: Callable[..., DataFrame], *needs: str) -> None:
        """Write a table from staged sources and earlier tables; without one of them it is left out."""
        if all(n in staged or n in built for n in needs):
            built[name] = save_table(make(*[staged[n] if n in staged else built[n] for n in needs]), name)

    table("conformed.dim_date", lambda: conformed.date_dimension(spark))
    table("conformed.dim_period", lambda: conformed.period_dimension(spark))
    table("conformed.dim_state", lambda: conformed.state_dimension(spark, params))
    named = (raw.get(s) for s in ("nfip_claims", "nfip_policies", "fema_declarations", "cms_geographic_variation",
                                  "hmda_lar", "zip_county_crosswalk"))
    referenced = conformed.county_universe(*named, staged.get("acs5_subject"))
    table("conformed.dim_geography_county", lambda people: conformed.county_dimension(people, referenced, params), "acs5_detailed")
    counties = "conformed.dim_geography_county"

    if "zip_county_crosswalk" in staged:
        staged["zip3 weights"] = publish_view(
            intermediate.prefix_weights(staged["zip_county_crosswalk"]), "int_fin__zip3_county_weights")
    table("int.int_fin__complaint_county_allocation", intermediate.allocate_complaints,
          "cfpb_complaints", "zip_county_crosswalk", "zip3 weights")
    table("int.int_fin__company_lei_match", lambda c, f: intermediate.match_companies(c, f, params),
          "cfpb_complaints", "hmda_institutions")
    if "cms_geographic_variation" in raw:
        staged["service measures"] = publish_view(
            intermediate.service_measures(raw["cms_geographic_variation"], params), "int_hlt__cms_service_measures")

    table("mart_ins.dim_ins_disaster_declaration", lambda a: insurance.disasters(a, params), "fema_declarations")
    table("mart_ins.fct_ins_claims_monthly", lambda c, p, i, k: insurance.claims_monthly(c, p, i, k, params),
          "nfip_claims", "acs5_detailed", "cpi_u", counties)
    table("mart_ins.fct_ins_claims_detail_mi", lambda c, i, k: insurance.claims_detail(c, i, k, params),
          "nfip_claims", "cpi_u", counties)
    table("mart_ins.fct_ins_policies_mi_monthly", lambda p, k: insurance.policies_in_force(p, k, params),
          "nfip_policies", counties)
    table("mart_ins.bridge_ins_claim_declaration", lambda c, a, d: insurance.claim_declarations(c, a, d, params),
          "nfip_claims", "fema_declarations", "mart_ins.dim_ins_disaster_declaration")
    if manifests is not None and {"nfip_claims", "fema_declarations", "nfip_policies"} <= set(manifests):
        table("mart_ins.rpt_ins_reconciliation",
              lambda c, m, a, d, p: insurance.reconciliation(dict(manifests), c, m, a, d, p),
              "nfip_claims", "mart_ins.fct_ins_claims_monthly", "fema_declarations",
              "mart_ins.dim_ins_disaster_declaration", "nfip_policies")

    table("mart_fin.fct_fin_complaints_monthly_geo", lambda a, p, k: lending.complaints_by_county(a, p, k, params),
          "int.int_fin__complaint_county_allocation", "acs5_detailed", counties)
    table("mart_fin.fct_fin_complaints_monthly_company", lambda c: lending.complaints_by_company(c, params), "cfpb_complaints")
    table("mart_fin.fct_fin_complaints_daily_state", lambda c: lending.complaints_daily(c, params), "cfpb_complaints")
    table("mart_fin.rpt_fin_publication_window", lambda c: lending.publication_window(c, params), "cfpb_complaints")
    table("mart_fin.fct_fin_hmda_annual", lambda r, f, k: lending.lending_annual(r, f, k, params),
          "hmda_lar", "hmda_institutions", counties)
    table("mart_fin.rpt_fin_entity_match_rate", lending.match_rate, "int.int_fin__company_lei_match")

    table("mart_hlt.fct_hlt_cdc_indicators", health.indicators, "cdc_healthy_aging")
    table("mart_hlt.fct_hlt_cdc_mi_vs_national", lambda c: health.state_vs_national(c, params), "mart_hlt.fct_hlt_cdc_indicators")
    table("mart_hlt.fct_hlt_medicare_cost_annual", lambda m, s, i: health.medicare_cost(m, s, i, params),
          "service measures", "cms_geographic_variation", "cpi_u")
    table("mart_hlt.fct_hlt_medicare_service_county", lambda m, s, k: health.medicare_services(m, s, k, params),
          "service measures", "cms_geographic_variation", counties)
    table("mart_hlt.fct_hlt_mi_population_65_plus", lambda e, k: health.population_65_plus(e, k, params), "acs5_subject", counties)
    table("mart_hlt.rpt_hlt_need_vs_capacity", lambda o, c: health.need_vs_capacity(o, c, params),
          "mart_hlt.fct_hlt_mi_population_65_plus", "mart_hlt.fct_hlt_cdc_mi_vs_national")
    table("meta.meta_dictionary", lambda: data_dictionary(catalogue_rows(
        spark, ["conformed", "int", "mart_ins", "mart_fin", "mart_hlt"])))
    return built
