"""Health marts: indicators, comparisons with the nation, Medicare cost and use, need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.dates import period_id
from plumbline.functions.flags import (
    max_where,
    overlap,
    percent,
    tally,
    value_at_max,
    value_at_min,
)
from plumbline.operators.aggregates import group_total
from plumbline.operators.joins import (
    constant_dollars,
    with_totals,
    left_lookup,
    lookup_fixed,
    pair_rows,
    price_index,
)
from plumbline.operators.windows import with_prior
from plumbline.params import DEFAULT, Params
from plumbline.plans.conformed import state_dimension
from plumbline.plans.marts_insurance import county_names
from plumbline.sources.seeds import fixed_table


def indicators(cells: DataFrame) -> DataFrame:
    """Every indicator cell with its catalogue entry and what its footnote forbids."""
    catalogue = fixed_table(cells.sparkSession, fixed.INDICATORS).select(
        "question_id", "indicator_family", "short_label",
        F.col("higher_is_better").cast("boolean").alias("higher_is_better"))
    symbol = F.col("footnote_symbol")

    def footnote(mark: str, name: str) -> Column:
        return F.coalesce(symbol == mark, F.lit(False)).alias(name)

    return lookup_fixed(cells, catalogue, "question_id").select(
        "cycle_key", period_id("survey_cycle", F.col("cycle_key")).alias("period_id"),
        "year_start", "year_end", "period_grain", "spans_multiple_years", "location_abbr",
        "location_desc", "location_kind", "is_michigan", "class_id", "class", "topic", "question_id",
        "question", "indicator_family", "short_label", "higher_is_better", "is_cognitive_decline",
        "is_caregiving",
        F.coalesce(F.col("indicator_family") == "screening", F.lit(False)).alias("is_screening"),
        F.col("stratification_1").alias("age_group"),
        F.coalesce("stratification_2", F.lit("Overall")).alias("stratification"),
        F.coalesce("stratification_category_2", F.lit("Overall")).alias("stratification_category"),
        "is_overall_age_group", "is_unstratified_second_dimension", "data_value_type",
        "data_value_unit", "data_value", "low_confidence_limit", "high_confidence_limit",
        "is_suppressed", "has_confidence_interval", "footnote_symbol", "footnote_text",
        footnote("**", "is_not_comparable_pre_2019"),
        footnote("#", "is_fewer_than_50_states_reporting"),
        footnote("&", "is_regional_estimate"))


NOT_COMPARABLE = "not comparable"


def _better(now: Column, then: Column, higher_is_better: Column, good: str, bad: str) -> Column:
    return F.when((now > then) == higher_is_better, good).otherwise(bad)


def state_vs_national(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The focus state beside the nation, judged by whether their intervals overlap.

    A direction is given only between comparable single-year cycles; ties of the cycle order
    are broken by the cycle's own key.
    """
    mine = F.col("is_michigan")
    measures = {"value": "data_value", "low": "low_confidence_limit", "high": "high_confidence_limit"}
    series = ["question_id", "age_group", "stratification"]
    texts = ("question", "class_id", "class", "indicator_family", "short_label")
    any_flags = ("spans_multiple_years", "is_cognitive_decline", "is_caregiving", "is_screening",
                 "is_unstratified_second_dimension", "higher_is_better")

    def flagged(name: str, condition: Column) -> Column:
        return F.coalesce(F.bool_or(F.when(condition, F.col(name))), F.lit(False))

    paired = rows.where(F.col("location_abbr").isin(params.focus_state, "US")).groupBy(
        "cycle_key", *series
    ).agg(
        F.max("year_start").alias("year_start"), F.max("year_end").alias("year_end"),
        *[F.max(c).alias(c) for c in texts], *[F.bool_or(c).alias(c) for c in any_flags],
        F.bool_and(F.col("higher_is_better").isNull()).alias("_no_polarity"),
        *[max_where(F.col(c), ~mine).alias(f"national_{n}") for n, c in measures.items()],
        *[max_where(F.col(c), mine).alias(f"mi_{n}") for n, c in measures.items()],
        flagged("is_not_comparable_pre_2019", ~mine).alias("national_not_comparable_pre_2019"),
        flagged("is_fewer_than_50_states_reporting", ~mine).alias("national_fewer_than_50_states"),
        flagged("is_not_comparable_pre_2019", mine).alias("mi_not_comparable_pre_2019"))
    mi, low, high = F.col("mi_value"), F.col("mi_low"), F.col("mi_high")
    us, us_low, us_high = F.col("national_value"), F.col("national_low"), F.col("national_high")
    complete = F.lit(True)
    for figure in (mi, low, high, us, us_low, us_high):
        complete = complete & figure.isNotNull()
    compared = paired.withColumns({
        "is_comparable": complete,
        "intervals_overlap": overlap(low, high, us_low, us_high),
        "gap_to_national": mi - us,
    })
    order = [F.when(F.col("spans_multiple_years"), 1).otherwise(0), F.col("year_end").asc_nulls_last(),
             F.col("cycle_key")]
    lagged = with_prior(compared, series, order, {
        "cycle_key": "prior_cycle_key", "mi_value": "mi_prior_value", "mi_low": "_prior_low",
        "mi_high": "_prior_high", "mi_not_comparable_pre_2019": "_prior_break"})
    comparable, same = F.col("is_comparable"), F.col("intervals_overlap")
    polarity, unknown = F.col("higher_is_better"), F.col("_no_polarity")
    prior, prior_low, prior_high = F.col("mi_prior_value"), F.col("_prior_low"), F.col("_prior_high")
    multi, broken = F.col("spans_multiple_years"), F.col("mi_not_comparable_pre_2019")
    prior_broken = F.coalesce("_prior_break", F.lit(True))
    both = mi.isNotNull() & prior.isNotNull()
    no_interval = low.isNull() | high.isNull() | prior_low.isNull() | prior_high.isNull()
    significance = (
        F.when(~comparable, NOT_COMPARABLE).when(same, "no significant difference")
        .when(mi > us, "MI higher").otherwise("MI lower"))
    verdict = (
        F.when(~comparable, NOT_COMPARABLE).when(same, "no significant difference")
        .when(unknown, None).otherwise(_better(mi, us, polarity, "MI better", "MI worse")))
    direction = (
        F.when(multi, None)
        .when(~both | broken | prior_broken | no_interval, NOT_COMPARABLE)
        .when(overlap(low, high, prior_low, prior_high), "no significant change")
        .when(unknown, None)
        .otherwise(_better(mi, prior, polarity, "improving", "deteriorating")))
    return lagged.select(
        "cycle_key", period_id("survey_cycle", F.col("cycle_key")).alias("period_id"),
        "year_start", "year_end", "spans_multiple_years", "question_id", "question", "class_id",
        "class", "indicator_family", "short_label", "higher_is_better", "is_cognitive_decline",
        "is_caregiving", "is_screening", "age_group", "stratification",
        "is_unstratified_second_dimension", "mi_value", "mi_low", "mi_high", "national_value",
        "national_low", "national_high", "gap_to_national", "national_fewer_than_50_states",
        "mi_not_comparable_pre_2019", "national_not_comparable_pre_2019", "is_comparable",
        "intervals_overlap", significance.alias("significance"), verdict.alias("benchmark_verdict"),
        "prior_cycle_key", "mi_prior_value",
        F.when(~multi & both & ~broken & ~prior_broken, mi - prior).alias("mi_change_from_prior"),
        direction.alias("mi_direction"))


def medicare_cost(measures: DataFrame, enrolment: DataFrame, prices: DataFrame,
                  params: Params = DEFAULT) -> DataFrame:
    """Standardised cost per beneficiary of states and the nation, nominal and constant.

    Enrolment joins on the description: some rows of a state level carry no code.
    """
    wide = F.col("geo_level").isin("State", "National")
    cost = measures.where(
        wide & (F.col("service_code") == "TOT") & (F.col("measure_kind") == "per_capita")
        & F.col("is_standardized")
    ).withColumnRenamed("measure_value", "cost_per_capita")
    national = cost.where(F.col("geo_level") == "National").select(
        "measure_year", "age_level", F.col("cost_per_capita").alias("national_cost_per_capita"))
    context = ("ma_participation_rate", "ffs_beneficiary_denominator", "benes_total_cnt",
               "bene_avg_age", "bene_dual_eligible_pct")
    people = enrolment.where(wide).select(
        "measure_year", "geo_level", "age_level", "geo_description", *context)
    joined = cost.join(national, ["measure_year", "age_level"], "left").join(
        people, ["measure_year", "geo_level", "age_level", "geo_description"], "left"
    ).withColumn("gap_to_national", F.col("cost_per_capita") - F.col("national_cost_per_capita"))
    amounts = ("cost_per_capita", "national_cost_per_capita", "gap_to_national")
    priced = constant_dollars(joined, price_index(prices), "measure_year",
                              {f"{a}_constant": F.col(a) for a in amounts}, params.deflator_base_year)
    states = state_dimension(measures.sparkSession, params).where(F.col("state_fips").isNotNull()).select(
        F.col("state_fips").alias("geo_code"), "state_name")
    code = F.col("geo_code")
    return lookup_fixed(priced, states, "geo_code").select(
        "measure_year", "period_key", period_id("year", F.col("period_key")).alias("period_id"),
        "period_grain", "geo_level", "geo_code", "geo_description", "state_name",
        ((F.col("geo_level") == "State") & code.isNotNull()).alias("is_jurisdiction"),
        F.coalesce(code == params.focus_state_fips, F.lit(False)).alias("is_michigan"), "age_level",
        *amounts, *[f"{a}_constant" for a in amounts],
        F.lit(params.deflator_base_year).alias("constant_dollar_base_year"), *context, "is_suppressed")


def medicare_services(measures: DataFrame, enrolment: DataFrame, counties: DataFrame,
                      params: Params = DEFAULT) -> DataFrame:
    """County service figures against the nation's figure of the same source column.

    Totals grow with population, so only rates get a ratio or a gap.
    """
    all_ages = measures.where(F.col("age_level") == "All")
    national = all_ages.where(F.col("geo_level") == "National").select(
        "measure_year", "service_code", "measure_kind", "source_column",
        F.col("measure_value").alias("national_value"), F.col("is_suppressed").alias("_us_suppressed"))
    mine = all_ages.where("is_michigan_county")
    series = ["service_code", "measure_kind", "source_column"]
    hidden = tally(F.col("is_suppressed"))
    # A column name fixes its service and kind; both may be NULL, the name may not.
    coverage = mine.groupBy("source_column").agg(
        hidden.alias("service_suppressed_cells"), percent(hidden, F.count(F.lit(1))).alias("_share"),
        F.first("service_code").alias("_code"), F.first("measure_kind").alias("_kind"))
    # A series without a code or kind matches nothing, as an equality on NULL would not.
    coverage = coverage.where(F.col("_code").isNotNull() & F.col("_kind").isNotNull()).drop("_code", "_kind")
    people = enrolment.where(F.col("is_county_row") & F.col("is_all_ages")).select(
        "measure_year", "county_fips", "ma_participation_rate", "ffs_beneficiary_denominator",
        "is_unassigned_county")
    joined = (
        mine.join(national, ["measure_year", *series], "left")
        .join(coverage, "source_column", "left")
        .join(people, ["measure_year", "county_fips"], "left"))
    named = left_lookup(joined, county_names(counties), "county_fips")
    value, us, kind = F.col("measure_value"), F.col("national_value"), F.col("measure_kind")
    shown = ~F.col("is_suppressed")
    is_total = kind.isin("amount", "user_count")
    return named.select(
        "measure_year", "period_key", period_id("year", F.col("period_key")).alias("period_id"),
        "period_grain", "county_fips", "county_name", F.col("geo_description").alias("cms_county_label"),
        F.coalesce("_focus", F.lit(False)).alias("is_michigan"),
        F.coalesce("is_unassigned_county", F.lit(False)).alias("is_unassigned_county"),
        "age_level", "service_code", "service_name", "is_long_term_care", "measure_kind",
        "is_standardized", "source_column", value.alias("county_value"), "national_value",
        F.when(is_total, None).when((us > 0) & shown, value / us).alias("ratio_to_national"),
        F.when(is_total, None).when(shown, value - us).alias("gap_to_national"),
        "is_suppressed", F.coalesce(shown & (value == 0), F.lit(False)).alias("is_true_zero"),
        F.coalesce("_us_suppressed", F.lit(False)).alias("national_is_suppressed"),
        "service_suppressed_cells", F.round("_share", 2).alias("service_suppressed_pct"),
        (F.col("_share") >= params.suppressed_service_pct).alias("is_small_cell_service"),
        "ma_participation_rate", "ffs_beneficiary_denominator")


def population_65_plus(subject: DataFrame, counties: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Residents over 65 per county of the focus state, and the share of its total."""
    rows = subject.where(
        (F.col("geo_level") == "county") & F.col("is_michigan") & F.col("population_65_plus_is_published"))
    kept = ["vintage", "vintage_year", "vintage_window_start", "vintage_window_end", "vintage_label",
            "county_fips", "geography_name", "population_65_plus", "population_65_plus_margin",
            "is_controlled_estimate"]
    totals = group_total(rows.select(*kept), ["vintage_year"], F.struct(
        F.sum("population_65_plus").alias("people"), F.count(F.lit(1)).alias("n")), "_state")
    # One row per vintage: a vintage is a calendar year, so this window orders a few rows.
    windows = with_prior(
        rows.select("vintage_year", "vintage_window_start", "vintage_window_end").distinct(),
        [F.lit(0)], [F.col("vintage_year")], {"vintage_window_end": "_prior_end"})
    overlapping = windows.select(
        "vintage_year", (F.col("vintage_window_start") > F.col("_prior_end")).alias("_apart"))
    named = left_lookup(totals.join(overlapping, "vintage_year", "left"), county_names(counties), "county_fips")
    return named.select(
        "vintage", period_id("year", F.col("vintage")).alias("period_id"), "vintage_year",
        "vintage_window_start", "vintage_window_end", "vintage_label", "county_fips",
        F.coalesce("county_name", "geography_name").alias("county_name"),
        F.coalesce("_focus", F.lit(False)).alias("is_michigan"), "population_65_plus",
        "population_65_plus_margin", "is_controlled_estimate",
        F.col("_state.people").alias("state_population_65_plus"),
        F.col("_state.n").alias("counties_reporting"),
        percent(F.col("population_65_plus"), F.col("_state.people")).alias("county_share_of_state_pct"),
        F.coalesce("_apart", F.lit(False)).alias("is_non_overlapping_with_prior"))


def need_vs_capacity(elderly: DataFrame, compared: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Whether care and screening keep pace with growth of the population over 65."""
    vintage = F.col("vintage_year")
    growth = pair_rows(
        elderly, vintage == params.growth_from_vintage, vintage == params.growth_to_vintage,
        {"vintage_year": "vintage", "vintage_window_start": "start", "vintage_window_end": "end",
         "state_population_65_plus": "people"},
    ).where(F.col("from_vintage").isNotNull() & F.col("to_vintage").isNotNull())
    change = F.col("to_people") - F.col("from_people")

    def window(side: str) -> Column:
        return F.concat(F.col(f"{side}_start").cast("string"), F.lit("-"), F.col(f"{side}_end").cast("string"))

    growth = growth.select(
        "from_vintage", "to_vintage", window("from").alias("population_window_from"),
        window("to").alias("population_window_to"), F.col("from_people").alias("population_from"),
        F.col("to_people").alias("population_to"), change.alias("population_change"),
        percent(change, F.col("from_people")).alias("population_change_pct"),
        (F.col("to_start") > F.col("from_end")).alias("windows_are_non_overlapping"))

    points = compared.where(
        F.col("is_unstratified_second_dimension") & ~F.col("spans_multiple_years")
        & F.col("mi_value").isNotNull()
        & F.col("indicator_family").isin("screening", "caregiving", "cognitive_decline"))
    year = F.col("year_end")
    ends: dict[str, Column] = {}
    for name in ("cycle", "value", "low", "high"):
        source = F.col("cycle_key" if name == "cycle" else f"mi_{name}")
        ends[f"indicator_from_{name}"] = value_at_min(source, year)
        ends[f"indicator_to_{name}"] = value_at_max(source, year)
    broken = F.col("mi_not_comparable_pre_2019")
    change_rows = points.groupBy("question_id", "age_group").agg(
        *[F.any_value(c, True).alias(c)
          for c in ("question", "class_id", "indicator_family", "short_label")],
        F.bool_or("higher_is_better").alias("higher_is_better"),
        F.bool_and(F.col("higher_is_better").isNull()).alias("_no_polarity"),
        F.min(year).alias("_from_year"), F.max(year).alias("_to_year"),
        *[c.alias(n) for n, c in ends.items()],
        (F.coalesce(value_at_min(broken, year), F.lit(False))
         | F.coalesce(value_at_max(broken, year), F.lit(False))).alias("straddles_2019_break"),
        F.count(F.lit(1)).alias("cycles_available"))
    was, now = F.col("indicator_from_value"), F.col("indicator_to_value")
    was_low, was_high = F.col("indicator_from_low"), F.col("indicator_from_high")
    now_low, now_high = F.col("indicator_to_low"), F.col("indicator_to_high")
    no_interval = was_low.isNull() | was_high.isNull() | now_low.isNull() | now_high.isNull()
    direction = (
        F.when((F.col("cycles_available") < 2) | F.col("straddles_2019_break") | no_interval, NOT_COMPARABLE)
        .when(overlap(now_low, now_high, was_low, was_high), "no significant change")
        .when(F.col("_no_polarity"), None)
        .otherwise(_better(now, was, F.col("higher_is_better"), "improving", "deteriorating")))
    # Without both vintages there is no growth to compare with, and no row.
    assessed = with_totals(change_rows.withColumn("indicator_direction", direction), growth).where(
        F.col("from_vintage").isNotNull())
    verdict, pct = F.col("indicator_direction"), F.col("population_change_pct")
    return assessed.select(
        "question_id", "question", "class_id", "indicator_family", "short_label", "higher_is_better",
        "age_group", *growth.columns, "indicator_from_cycle", "indicator_to_cycle",
        F.concat(F.col("_from_year").cast("string"), F.lit("-"), F.col("_to_year").cast("string"))
        .alias("indicator_window"),
        "cycles_available", was.alias("indicator_from_value"), now.alias("indicator_to_value"),
        (now - was).alias("indicator_change_pp"), "straddles_2019_break", "indicator_direction",
        ((F.col("population_window_from") == F.col("indicator_from_cycle"))
         & (F.col("population_window_to") == F.col("indicator_to_cycle"))).alias("windows_are_aligned"),
        F.when(verdict.isNull(), None)
        .when((verdict == NOT_COMPARABLE) | pct.isNull(), NOT_COMPARABLE)
        .when(pct <= 0, "need not growing")
        .when(verdict == "improving", "capacity keeping pace")
        .otherwise("need outpacing capacity").alias("need_vs_capacity_verdict"))
