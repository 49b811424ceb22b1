"""Schema drift against a committed roster, and row conservation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.joins import with_totals
from plumbline.quality.results import FAIL, PASS, SKIP, WARN, counted, passes, results
from plumbline.sources.seeds import fixed_table

# How much of each source's schema its publisher lets us compare.
COMPARISONS = {
    "nfip_claims": "exact", "nfip_policies": "exact", "fema_declarations": "exact",
    "cfpb_complaints": "none", "hmda_lar": "count", "hmda_institutions": "exact",
    "cdc_healthy_aging": "exact", "cms_geographic_variation": "none",
    "acs5_detailed": "subset", "acs5_subject": "subset", "cpi_u": "exact",
    "cpi_u_series": "exact", "zip_county_crosswalk": "exact",
}


def column_roster(frames: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(source, column_name) of every landed table, from the catalogue and not the data."""
    lines = ["source|column_name"] + [f"{s}|{c}" for s, df in frames.items() for c in df.columns]
    return fixed_table(spark, "\n".join(lines))


def schema_drift(observed: DataFrame, baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """A dropped column can break a model, a new one cannot: FAIL and WARN respectively.

    ``comparison`` holds (source, mode, expected_count). A source compared by ``count`` only
    matches a number, by ``subset`` only what was asked for, by ``none`` not at all.
    """
    left = observed.select("source", "column_name", F.lit(True).alias("here"))
    right = baseline.select("source", "column_name", F.lit(True).alias("there"))
    columns = left.join(right, ["source", "column_name"], "full_outer").groupBy("source").agg(
        F.count_if(F.col("here")).alias("present"),
        F.count_if(F.col("here").isNull()).alias("dropped"),
        F.count_if(F.col("there").isNull()).alias("added"))
    known = comparison.join(columns, "source", "left")
    mode, present = F.col("mode"), F.coalesce("present", F.lit(0))
    dropped, added = F.coalesce("dropped", F.lit(0)), F.coalesce("added", F.lit(0))
    status = (
        F.when((mode == "none") | (present == 0), SKIP)
        .when(mode == "count", passes(present == F.col("expected_count").cast("bigint")))
        .when(dropped > 0, FAIL)
        .when((mode == "exact") & (added > 0), WARN)
        .otherwise(PASS))
    return known.select(
        "source", F.lit("schema drift").alias("check_name"), status.alias("status"),
        counted(present=present, dropped=dropped, added=added).alias("detail"))


def conserves_rows(raw: DataFrame, staged: DataFrame, track: str, source: str) -> DataFrame:
    """Staging types and renames; it never filters and never fans out."""
    both = with_totals(raw.agg(F.count(F.lit(1)).alias("raw")), staged.agg(F.count(F.lit(1)).alias("staged")))
    return results(both, track, source, ("staging conserves rows", passes(F.col("raw") == F.col("staged")),
                                         counted(raw=F.col("raw"), staged=F.col("staged"))))
