"""Is every executive question answerable from what was landed?

A question names ingredients; an ingredient is a count over one raw table, or a key of a
manifest, with a minimum. All ingredients of a table are measured in one scan of it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.operators.reshape import union_all
from plumbline.params import DEFAULT, Params
from plumbline.quality.results import FAIL, PASS, SKIP


@dataclass(frozen=True)
class Ingredient:
    name: str
    table: str
    measure: Callable[[Params], Column]
    minimum: int = 1
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Question:
    id: str
    track: str
    asks: str
    ingredients: tuple[Ingredient, ...]


def _rows(where: Callable[[Params], Column]) -> Callable[[Params], Column]:
    return lambda p: F.count_if(where(p))


def _filled(column: str, where: Callable[[Params], Column] | None = None) -> Callable[[Params], Column]:
    value = f"`{column}`"
    if where is None:
        return lambda p: F.count(F.col(value))
    return lambda p: F.count(F.when(where(p), F.col(value)))


def _distinct(value: Callable[[], Column], where: Callable[[Params], Column] | None = None):
    if where is None:
        return lambda p: F.count_distinct(value())
    return lambda p: F.count_distinct(F.when(where(p), value()))


def _claims(p: Params) -> Column:
    return F.col("state") == p.focus_state


def _complaints(p: Params) -> Column:
    return F.col("State") == p.focus_state


def _cms(p: Params) -> Column:
    return (F.col("BENE_GEO_LVL") == "County") & F.col("BENE_GEO_CD").startswith(p.focus_state_fips)


def _acs(p: Params) -> Column:
    return (F.col("geo_level") == "county") & (F.col("state") == p.focus_state_fips)


def _nation(p: Params) -> Column:
    return F.col("geo_level") == "us"


def _place(code: str | None = None, text: str | None = None, column: str = "topic"):
    def where(p: Params) -> Column:
        condition = F.col("locationabbr") == (code or p.focus_state)
        return condition & F.lower(column).contains(text) if text else condition
    return where


def _deflator(p: Params) -> Column:
    return (F.trim("series_id") == fixed.DEFLATOR_SERIES) & (F.trim("period") == fixed.ANNUAL_AVERAGE_PERIOD)


def _older(p: Params) -> Column:
    return F.col("BENE_AGE_LVL") == ">=65"


CLAIMS, POLICIES, DECLARATIONS = "nfip_claims", "nfip_policies", "fema_declarations"
COMPLAINTS, LENDING, FILERS = "cfpb_complaints", "hmda_lar", "hmda_institutions"
CELLS, MEDICARE, PRICES = "cdc_healthy_aging", "cms_geographic_variation", "cpi_u"
PEOPLE, ELDERLY = "acs5_detailed", "acs5_subject"

_dated_claims = Ingredient("focus claims with a loss date", CLAIMS,
                           _rows(lambda p: _claims(p) & F.col("dateOfLoss").isNotNull()))
_price_level = Ingredient("annual deflator", PRICES, _rows(_deflator))

QUESTIONS: tuple[Question, ...] = (
    Question("INS-E1", "insurance", "flood cost of the latest loss year against earlier ones", (
        _dated_claims,
        Ingredient("paid amounts", CLAIMS, _filled("amountPaidOnBuildingClaim", _claims)),
        Ingredient("loss years", CLAIMS, _distinct(lambda: F.year("dateOfLoss"), _claims), 6))),
    Question("INS-E2", "insurance", "severity per claim in constant dollars", (
        Ingredient("paid amounts nationally", CLAIMS, _filled("amountPaidOnBuildingClaim")),
        Ingredient("states", CLAIMS, _distinct(lambda: F.col("state")), 50), _price_level)),
    Question("INS-E3", "insurance", "event-driven share of paid losses", (
        _dated_claims,
        Ingredient("declarations with a window", DECLARATIONS,
                   _rows(lambda p: _claims(p) & F.col("incidentBeginDate").isNotNull())))),
    Question("INS-E4", "insurance", "policies in force per housing unit", (
        Ingredient("policy counts", POLICIES, _filled("policyCount")),
        Ingredient("county housing units", PEOPLE, _filled("B25001_001E", _acs)),
        Ingredient("national housing units", PEOPLE, _filled("B25001_001E", _nation)))),
    Question("INS-E5", "insurance", "totals tie to the publisher's", (
        Ingredient("claims landed", CLAIMS, lambda p: F.count(F.lit(1))),
        Ingredient("declarations landed", DECLARATIONS, lambda p: F.count(F.lit(1))),
        Ingredient("published claim total", "manifest:nfip_claims", _filled("source_reported_count")))),
    Question("FIN-E1", "fintech", "complaints per head of the latest complete window", (
        Ingredient("dated complaints", COMPLAINTS, _filled("Date received", _complaints)),
        Ingredient("months", COMPLAINTS,
                   _distinct(lambda: F.substring(F.col("`Date received`"), 1, 7), _complaints), 12),
        Ingredient("county population", PEOPLE, _filled("B01003_001E", _acs)),
        Ingredient("national population", PEOPLE, _filled("B01003_001E", _nation)))),
    Question("FIN-E2", "fintech", "largest and fastest-growing product", (
        Ingredient("products", COMPLAINTS, _distinct(lambda: F.col("Product"), _complaints), 2),
        Ingredient("years", COMPLAINTS, _distinct(lambda: F.col("year"), _complaints), 2))),
    Question("FIN-E3", "fintech", "timeliness and relief", (
        Ingredient("timely flags", COMPLAINTS, _filled("Timely response?", _complaints)),
        Ingredient("outcomes", COMPLAINTS,
                   _distinct(lambda: F.col("`Company response to consumer`"), _complaints), 2),
        Ingredient("national timely flags", COMPLAINTS, _filled("Timely response?")))),
    Question("FIN-E4", "fintech", "originations and denials", (
        Ingredient("actions", LENDING, _distinct(lambda: F.col("action_taken")), 2),
        Ingredient("loan amounts", LENDING, _filled("loan_amount")),
        Ingredient("years", LENDING, _distinct(lambda: F.col("activity_year")), 2),
        Ingredient("national control totals", "manifest:hmda_lar", _filled("control_totals")))),
    Question("FIN-E5", "fintech", "complaints per billion originated", (
        Ingredient("lenders with amounts", LENDING,
                   _rows(lambda p: F.col("lei").isNotNull() & F.col("loan_amount").isNotNull())),
        Ingredient("lender names", FILERS, _rows(lambda p: F.col("lei").isNotNull() & F.col("name").isNotNull())),
        Ingredient("company names", COMPLAINTS, _filled("Company", _complaints)))),
    Question("HLT-E1", "health", "cognitive decline against the nation", (
        Ingredient("estimates with limits", CELLS,
                   _filled("low_confidence_limit", _place(text="cognitive decline"))),
        Ingredient("national row", CELLS, _rows(_place("US", "cognitive decline"))))),
    Question("HLT-E2", "health", "nursing and home-health use", (
        Ingredient("county figures", MEDICARE, _rows(
            lambda p: _cms(p) & F.col("SNF_MDCR_STDZD_PYMT_PC").isNotNull()
            & F.col("HH_MDCR_STDZD_PYMT_PC").isNotNull())),
        Ingredient("national benchmark", MEDICARE, _rows(lambda p: F.col("BENE_GEO_LVL") == "National")),
        Ingredient("years", MEDICARE, _distinct(lambda: F.col("YEAR"), _cms), 5))),
    Question("HLT-E3", "health", "cost per older beneficiary in constant dollars", (
        Ingredient("standardised cost", MEDICARE, _filled("TOT_MDCR_STDZD_PYMT_PC", _older)),
        Ingredient("focus and nation", MEDICARE, _distinct(
            lambda: F.col("BENE_GEO_LVL"),
            lambda p: _older(p) & ((F.col("BENE_GEO_DESC") == p.focus_state)
                                   | (F.col("BENE_GEO_LVL") == "National"))), 2), _price_level)),
    Question("HLT-E4", "health", "direction of caregiver burden", (
        Ingredient("caregiving indicators", CELLS, _rows(_place(text="caregiv", column="class"))),
        Ingredient("cycles", CELLS,
                   _distinct(lambda: F.col("yearstart"), _place(text="caregiv", column="class")), 2))),
    Question("HLT-E5", "health", "need against screening and care", (
        Ingredient("population over 65", ELDERLY, _filled("S0101_C01_030E", _acs)),
        Ingredient("vintages", ELDERLY, _distinct(lambda: F.col("vintage"), _acs), 5),
        Ingredient("indicators", CELLS, _rows(_place())))),
)


def measure_ingredients(raw: Mapping[str, DataFrame], spark: SparkSession, params: Params = DEFAULT,
                        is_sample: bool = False, questions: tuple[Question, ...] = QUESTIONS) -> DataFrame:
    """(question, ingredient, minimum, found): ``found`` is NULL for a table not landed yet.

    A column the publisher dropped measures -1, which is a failure rather than an absence.
    """
    wanted = [(q, i) for q in questions for i in q.ingredients]
    parts = []
    for table in dict.fromkeys(i.table for _, i in wanted):
        mine = [(n, q, i) for n, (q, i) in enumerate(wanted) if i.table == table]
        if table in raw:
            present = set(raw[table].columns)
            aggregates = []
            for n, _, ingredient in mine:
                try:
                    raw[table].agg(ingredient.measure(params)).schema  # resolves, runs nothing
                    aggregates.append(ingredient.measure(params).cast("bigint").alias(f"m{n}"))
                except AnalysisException as error:
                    if not present or not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                        raise
                    aggregates.append(F.max(F.lit(-1)).cast("bigint").alias(f"m{n}"))
            row = raw[table].agg(*aggregates)
        else:
            row = spark.range(1).select(*[F.lit(None).cast("bigint").alias(f"m{n}") for n, _, _ in mine])
        lines = F.array(*[
            F.struct(F.lit(q.track).alias("track"), F.lit(q.id).alias("question"), F.lit(i.name).alias("ingredient"),
                     F.lit(1 if is_sample else i.minimum).cast("bigint").alias("minimum"),
                     F.col(f"m{n}").alias("found")) for n, q, i in mine])
        parts.append(row.select(F.inline(lines)))
    return union_all(parts)


def check_questions(measured: DataFrame) -> DataFrame:
    """One result per question: everything is there, or how much is not."""
    found, minimum = F.col("found"), F.col("minimum")
    absent, short = F.count_if(found.isNull()), F.count_if(found < minimum)
    return measured.groupBy("track", F.col("question").alias("source")).agg(
        F.lit("answerable from raw").alias("check_name"),
        F.when(absent > 0, SKIP).when(short > 0, FAIL).otherwise(PASS).alias("status"),
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" ingredients, missing="), (absent + short).cast("string"))
        .alias("detail"))
