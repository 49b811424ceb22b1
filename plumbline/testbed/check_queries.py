"""Registered queries for the data-quality and reconciliation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.contracts import ContractBreach, checked, contracts
from plumbline.operators.aggregates import profile
from plumbline.operators.joins import with_totals
from plumbline.operators.reshape import union_all
from plumbline.plans import conformed, intermediate, staging
from plumbline.plans import marts_health as health
from plumbline.plans import marts_insurance as insurance
from plumbline.plans import marts_lending as lending
from plumbline.quality import assertions as must
from plumbline.quality import coverage, drift, geography, integrity
from plumbline.quality.catalog import catalogue_rows, data_dictionary
from plumbline.quality.results import passes, results, tally
from plumbline.session import materialise, shared_folder
from plumbline.sources import readers, sinks
from plumbline.sources.seeds import fixed_table, parse_fixed
from plumbline.sources.sinks import flag_nonstandard_keys, partition_counts
from plumbline.testbed.dialect import TABLES
from plumbline.testbed.frames import Testbed
from plumbline.testbed.queries import entry

# ── D1, D2, D3: counts and control sums ──────────────────────────────────────────────────


@entry("gap_classifier", """
SELECT y, reported, landed, CASE WHEN reported IS NULL THEN 'SKIP' WHEN reported = landed THEN 'PASS' WHEN metadata IS NULL THEN 'WARN'
  WHEN metadata IS NOT DISTINCT FROM refreshed THEN 'FAIL' ELSE 'WARN' END AS status
FROM (SELECT year(o_orderdate)::INT AS y, count(*) AS landed, CASE year(o_orderdate) % 5 WHEN 0 THEN NULL WHEN 1 THEN count(*) ELSE count(*) + 3 END AS reported,
  'd1' AS refreshed, CASE year(o_orderdate) % 5 WHEN 2 THEN 'd1' WHEN 3 THEN 'd2' END AS metadata FROM orders GROUP BY year(o_orderdate))""")
def gap_classifier(t: Testbed) -> DataFrame:
    year = F.year("o_orderdate")
    manifest = t.table("orders").groupBy(year.alias("y")).agg(F.count(F.lit(1)).alias("landed")).withColumns({
        "reported": F.when(F.col("y") % 5 == 0, None).when(F.col("y") % 5 == 1, F.col("landed")).otherwise(F.col("landed") + 3),
        "refreshed": F.lit("d1"),
        "metadata": F.when(F.col("y") % 5 == 2, "d1").when(F.col("y") % 5 == 3, "d2"),
    })
    status = integrity.gap_status(F.col("reported"), F.col("landed"), F.col("refreshed"), F.col("metadata"))
    return manifest.select("y", "reported", "landed", status.alias("status"))


_CHAIN = """SELECT 'fintech' AS track, source, unnest(['source -> landing', 'landing -> raw -> table']) AS check_name, unnest([gap, kept]) AS status,
  unnest([concat('reported=', n + 2, ', landing=', n), concat('landing=', n, ', raw=', n, ', table=', t)]) AS detail
FROM (SELECT 'cfpb_complaints' AS source, 'WARN' AS gap, 'PASS' AS kept, count(*) AS n, count(*) AS t FROM raw_complaints
  UNION ALL SELECT 'cfpb_complaints, table cut short', 'WARN', 'FAIL', count(*), count(*) FILTER (timely_response_raw IS NOT NULL) FROM raw_complaints)"""


@entry("count_chain", _CHAIN)
def count_chain(t: Testbed) -> DataFrame:
    """Three stores, each counted for itself: landed lines, the published tree, a written table. Then a table that lost rows."""
    landed, tree = shared_folder(t.spark, "landed"), shared_folder(t.spark, "tree")
    t.raw("complaints").write.csv(landed, header=True, escape='"')
    read = readers.read_csv_text(t.spark, landed, t.raw("complaints").columns)
    sinks.write_partitioned(read, tree, "year")
    raw = readers.read_partitioned(t.spark, tree)
    table = materialise(staging.stage_complaints(raw), "complaints-table")
    short = materialise(staging.stage_complaints(raw.where("`Timely response?` IS NOT NULL")), "complaints-short")

    def counts(df: DataFrame) -> DataFrame:
        parts = [x.agg(F.count(F.lit(1)).alias(f"rows_{name}")) for name, x in (("landing", read), ("raw", raw), ("table", df))]
        return with_totals(with_totals(parts[0], parts[1]), parts[2]).select(
            "*", (F.col("rows_landing") + 2).alias("source_reported_count"),
            F.lit("2001-08-01").alias("source_last_refresh"), F.lit("2001-07-30").alias("source_metadata_refresh"))

    return union_all([integrity.count_chain(counts(df), "fintech", name) for name, df in (
        ("cfpb_complaints", table), ("cfpb_complaints, table cut short", short))])


@entry("lossless_conversion", """
SELECT 'insurance' AS track, 'nfip_claims' AS source, unnest(['control sums', 'per-partition counts']) AS check_name, unnest(['PASS', 'FAIL']) AS status,
  unnest(['columns=2, mismatched=0', concat('partitions=', n, ', only_landing=', a, ', only_raw=', b, ', differing=0')]) AS detail
FROM (SELECT count(*) AS n, count(*) FILTER (k = 'PR') AS a, count(*) FILTER (k = 'Puerto Rico') AS b FROM (
  SELECT DISTINCT state_code AS k FROM raw_claims UNION SELECT 'Puerto Rico' FROM raw_claims WHERE state_code = 'PR'))""")
def lossless_conversion(t: Testbed) -> DataFrame:
    # Raw renames one partition, which sums cannot see and partition counts must.
    sums = ["amountPaidOnBuildingClaim", "netIccPaymentAmount"]
    claims, key = t.raw("claims"), F.col("state")
    renamed = F.when(key == "PR", "Puerto Rico").otherwise(key)
    return integrity.lossless(profile(claims, key, sums), profile(claims, renamed, sums), sums, "insurance", "nfip_claims")


def _swapped(value: str) -> str:
    """Of each status the first and the last order exchange a value: row counts and sums stay what they were."""
    return f"""(SELECT o_orderkey, o_orderstatus, o_totalprice, o_clerk_note, CASE o_orderkey WHEN lo THEN at_hi WHEN hi THEN at_lo ELSE {value} END AS o_priority
  FROM (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '' END AS o_clerk_note, o_orderpriority FROM orders)
  JOIN (SELECT o_orderstatus, min(o_orderkey) AS lo, max(o_orderkey) AS hi, arg_min(o_orderpriority, o_orderkey) AS at_lo, arg_max(o_orderpriority, o_orderkey) AS at_hi
    FROM orders GROUP BY ALL) USING (o_orderstatus))"""


@entry("lossless_content", f"""
WITH differing AS (SELECT count(DISTINCT o_orderstatus) AS d FROM (SELECT o_orderkey, o_orderstatus, o_priority FROM {_swapped('o_orderpriority')} EXCEPT ALL
  SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)), n AS (SELECT count(DISTINCT o_orderstatus) AS p FROM orders)
SELECT 'testbed' AS track, source, unnest(['control sums', 'per-partition counts', 'content digests']) AS check_name,
  unnest(['PASS', 'PASS', CASE WHEN x = 0 THEN 'PASS' ELSE 'FAIL' END]) AS status,
  unnest(['columns=1, mismatched=0', concat('partitions=', p, ', only_landing=0, only_raw=0, differing=0'), concat('partitions=', p, ', differing=', x)]) AS detail
FROM (SELECT 'orders, other row order' AS source, 0 AS x UNION ALL SELECT 'orders, values exchanged', d FROM differing
  UNION ALL SELECT 'orders, blanks for nulls', (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderkey % 3 = 0)), n""")
def lossless_content(t: Testbed) -> DataFrame:
    """The same rows in another order, then two changes that no count and no sum can see."""
    note = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit(""))
    landing = t.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", note.alias("o_clerk_note"), F.col("o_orderpriority").alias("o_priority"))
    ends = landing.groupBy("o_orderstatus").agg(
        F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"),
        F.min_by("o_priority", "o_orderkey").alias("at_lo"), F.max_by("o_priority", "o_orderkey").alias("at_hi"))
    key = F.col("o_orderkey")
    exchanged = landing.join(ends, "o_orderstatus").withColumn("o_priority", F.when(key == F.col("lo"), F.col("at_hi")).when(
        key == F.col("hi"), F.col("at_lo")).otherwise(F.col("o_priority"))).select(landing.columns)
    blanks = landing.withColumn("o_clerk_note", F.coalesce("o_clerk_note", F.lit("")))
    here = profile(landing, "o_orderstatus", ["o_totalprice"], content=True)
    return union_all([
        integrity.lossless(here, profile(df, "o_orderstatus", ["o_totalprice"], content=True), ["o_totalprice"], "testbed", f"orders, {name}")
        for name, df in (("other row order", landing.repartition(7, "o_orderkey")),
                         ("values exchanged", exchanged), ("blanks for nulls", blanks))])


# ── D4 to D8: rosters ────────────────────────────────────────────────────────────────────
_CODES = "(SELECT state_code AS k, state_code IN ('AS', 'GU', 'MP', 'PR', 'VI') AS t FROM seed_states)"


def _against(keys: str) -> str:
    return f"""(SELECT count(*) FILTER (c.k IS NULL AND NOT s.t) AS ms, count(*) FILTER (c.k IS NULL AND s.t) AS mt, count(*) FILTER (c.k IS NOT NULL AND s.t) AS pt,
  count(*) FILTER (s.k IS NULL) AS u, coalesce(sum(c.n) FILTER (s.k IS NULL), 0)::BIGINT AS ur FROM ({keys}) c FULL JOIN {_CODES} s ON s.k = c.k)"""


_ROSTER_SQL = f"""
SELECT 'insurance' AS track, 'nfip_claims' AS source, unnest(['states + DC present', 'territories present', 'unknown-state rows kept']) AS check_name,
  unnest([if(ms = 0, 'PASS', 'FAIL'), if(mt = 0, 'PASS', 'WARN'), 'PASS']) AS status,
  unnest([concat('missing=', ms), concat('missing=', mt), concat('keys=', u, ', rows=', ur)]) AS detail
FROM {_against("SELECT state_code AS k, count(*) AS n FROM raw_claims GROUP BY ALL")}
UNION ALL
SELECT 'fintech', 'cfpb_complaints', unnest(['year coverage', 'malformed dates kept', 'earliest year']), unnest([if(b - a + 1 = n, 'PASS', 'FAIL'), 'PASS', if(a = 1996, 'PASS', 'WARN')]),
  unnest([concat('first=', a, ', last=', b, ', gaps=', b - a + 1 - n), 'keys=0, rows=0', concat('first=', a, ', expected=1996')])
FROM (SELECT min(partition_year::INT) AS a, max(partition_year::INT) AS b, count(DISTINCT partition_year) AS n FROM raw_complaints)
UNION ALL
SELECT 'shared', 'zip_county_crosswalk', unnest(['expected keys present', 'no unexpected keys']), unnest([if(m = 0, 'PASS', 'FAIL'), if(u > 0, 'FAIL', if(k > 0, 'WARN', 'PASS'))]),
  unnest([concat('expected=25, missing=', m), concat('unexpected=', u, ', tolerated=', k)])
FROM (SELECT count(*) FILTER (c.s IS NULL) AS m, count(*) FILTER (e.s IS NULL AND c.s NOT IN ('AL', 'AK')) AS u, count(*) FILTER (e.s IS NULL AND c.s IN ('AL', 'AK')) AS k
  FROM (SELECT DISTINCT state AS s FROM raw_crosswalk) c FULL JOIN (SELECT state_code AS s FROM seed_states WHERE state_code BETWEEN 'AR' AND 'MO' AND entity_type <> 'territory') e ON e.s = c.s)
UNION ALL
SELECT 'health', 'cdc_healthy_aging', unnest(['states + DC present', 'territories present', 'rollups kept, not summed']), unnest([if(ms = 0, 'PASS', 'FAIL'), 'PASS', if(u > 0, 'PASS', 'FAIL')]),
  unnest([concat('missing=', ms), concat('present=', pt), concat('rollups=', u, ', rows=', ur)])
FROM {_against("SELECT locationabbr AS k, count(*) AS n FROM raw_indicators GROUP BY ALL")}
UNION ALL
SELECT 'health', 'cms_geographic_variation', 'partitions sum to table', 'PASS', concat('partitions=', count(*), ', table=', count(*)) FROM raw_medicare"""


def _middle_states() -> list[str]:
    """The states between AR and MO, territories apart."""
    header, lines = parse_fixed(fixed.STATES)
    code, kind = header.index("state_code"), header.index("entity_type")
    return [line[code] for line in lines if "AR" <= line[code] <= "MO" and line[kind] != "territory"]


@entry("roster_checks", _ROSTER_SQL.replace("expected=25", f"expected={len(_middle_states())}"))
def roster_checks(t: Testbed) -> DataFrame:
    medicare = partition_counts(t.raw("medicare"), "BENE_GEO_LVL")
    return union_all([
        integrity.state_roster(partition_counts(t.raw("claims"), "state"), "insurance", "nfip_claims"),
        integrity.year_coverage(partition_counts(t.raw("complaints"), "year"), "fintech", "cfpb_complaints", 1996),
        integrity.expected_keys(partition_counts(t.raw("crosswalk"), "state"), _middle_states(), "shared",
                                "zip_county_crosswalk", tolerated=("AL", "AK")),
        integrity.peers_and_rollups(partition_counts(t.raw("indicators"), "locationabbr"), "health", "cdc_healthy_aging"),
        integrity.partitions_sum(medicare, t.raw("medicare").agg(F.count(F.lit(1)).alias("n")), "health",
                                 "cms_geographic_variation"),
    ])


@entry("roster_gaps", f"""
SELECT coalesce(c.k, s.k) AS partition_key, coalesce(c.n, 0) AS row_count, c.k IS NULL AS is_missing
FROM (SELECT state_code AS k, count(*) AS n FROM raw_claims GROUP BY ALL) c FULL JOIN {_CODES} s ON s.k = c.k WHERE c.k IS NULL OR s.k IS NULL""")
def roster_gaps(t: Testbed) -> DataFrame:
    expected = fixed_table(t.spark, fixed.STATES).select(F.col("state_code").alias("partition_key"))
    return integrity.roster_gap(partition_counts(t.raw("claims"), "state"), expected)


@entry("missing_years", """
SELECT y::INT AS year FROM (SELECT unnest(range(min(a), max(a) + 1)) AS y FROM (SELECT vintage::INT AS a FROM raw_population_65)) WHERE y NOT IN (SELECT vintage::INT FROM raw_population_65)""")
def missing_years(t: Testbed) -> DataFrame:
    return integrity.missing_years(partition_counts(t.raw("population_65"), "vintage"))


@entry("nonstandard_keys", """
SELECT county_code AS partition_key, count(*) AS row_count, county_code NOT IN (SELECT county_fips FROM counties WHERE geography_kind = 'county') AS is_nonstandard
FROM raw_lending GROUP BY ALL""")
def nonstandard_keys(t: Testbed) -> DataFrame:
    known = t.counties.where(F.col("geography_kind") == "county").select("county_fips")
    return flag_nonstandard_keys(partition_counts(t.raw("lending"), "county_code"), known)


# ── D9, D10: geography and questions ─────────────────────────────────────────────────────
_SOURCES = {"nfip_claims": "claims", "nfip_policies": "policies", "fema_declarations": "declarations",
            "cfpb_complaints": "complaints", "hmda_lar": "lending", "hmda_institutions": "institutions",
            "cdc_healthy_aging": "indicators", "cms_geographic_variation": "medicare",
            "acs5_detailed": "population", "acs5_subject": "population_65", "cpi_u": "prices",
            "zip_county_crosswalk": "crosswalk"}
# source: (track, focus rows, unusable rows, county, every county needed, national)
_GATES_SQL = {
    "nfip_claims": ("insurance", "state_code = 'MI'", "coalesce(trim(census_geoid), '') = ''", "census_geoid[1:5]", False, True),
    "nfip_policies": ("insurance", "state_code = 'MI'", "coalesce(trim(census_geoid), '') = ''", "census_geoid[1:5]", False, False),
    "fema_declarations": ("insurance", "state_code = 'MI'", "fips_county_code = '000'", "fips_state_code || fips_county_code", False, True),
    "cfpb_complaints": ("fintech", "state_code_raw = 'MI'", "coalesce(trim(zip_code_raw), '') = ''", "NULL", False, True),
    "hmda_lar": ("fintech", "state_code = 'MI'", "county_code NOT LIKE '26%'", "county_code", True, False),
    "cms_geographic_variation": ("health", "BENE_GEO_LVL = 'County' AND BENE_GEO_CD LIKE '26%'", "BENE_GEO_CD LIKE '%000'", "BENE_GEO_CD", True, True),
    "acs5_detailed": ("shared", "geo_level = 'county' AND state = '26'", "county IS NULL", "state || county", True, True),
    "acs5_subject": ("shared", "geo_level = 'county' AND state = '26'", "county IS NULL", "state || county", True, True),
    "zip_county_crosswalk": ("shared", "state = 'MI'", "length(geoid) <> 5", "geoid", True, True),
}


def _gate_sql(source: str) -> str:
    track, focus, bad, county, every, national = _GATES_SQL[source]
    scope = "true" if national else focus
    roster = "if(c = 83, 'PASS', 'WARN')" if every else "'PASS'"
    return f"""SELECT '{track}' AS track, '{source}' AS source, unnest(['focus geography usable', 'focus county roster']) AS check_name,
  unnest([CASE WHEN f = 0 THEN 'WARN' WHEN 100.0 * fb / f <= 10 THEN 'PASS' ELSE 'WARN' END, {roster}]) AS status,
  unnest([concat('unusable=', fb, ', rows=', f, ', national_unusable=', nb, ', national_rows=', n), concat('counties=', c)]) AS detail
FROM (SELECT count(*) FILTER ({focus}) AS f, count(*) FILTER (({focus}) AND ({bad})) AS fb, count(*) FILTER ({scope}) AS n, count(*) FILTER (({scope}) AND ({bad})) AS nb,
  count(DISTINCT {county}) FILTER (({focus}) AND NOT coalesce(({bad}), false)) AS c FROM raw_{_SOURCES[source]})"""


@entry("geography_gates", "\nUNION ALL ".join(_gate_sql(s) for s in _GATES_SQL))
def geography_gates(t: Testbed) -> DataFrame:
    return union_all([
        geography.check_geography(t.raw(_SOURCES[source]), gate, t.params)
        for source, gate in geography.gates(t.params).items()])


_FOUND = {
    # ingredient: SQL that counts it
    ("INS-E1", 0): "count(*) FILTER (state_code = 'MI') FROM raw_claims",
    ("INS-E1", 1): "count(amount_building) FILTER (state_code = 'MI') FROM raw_claims",
    ("INS-E1", 2): "count(DISTINCT year_of_loss) FILTER (state_code = 'MI') FROM raw_claims",
    ("INS-E2", 0): "count(amount_building) FROM raw_claims",
    ("INS-E2", 1): "count(DISTINCT state_code) FROM raw_claims",
    ("INS-E2", 2): "count(*) FROM prices WHERE is_deflator_series AND period_code = 'M13'",
    ("INS-E3", 0): "count(*) FILTER (state_code = 'MI') FROM raw_claims",
    ("INS-E3", 1): "count(*) FROM raw_declarations WHERE state_code = 'MI'",
    ("INS-E4", 0): "count(policy_count) FROM raw_policies",
    ("INS-E4", 1): "count(B25001_001E) FROM raw_population WHERE geo_level = 'county' AND state = '26'",
    ("INS-E4", 2): "count(B25001_001E) FROM raw_population WHERE geo_level = 'us'",
    ("INS-E5", 0): "count(*) FROM raw_claims",
    ("INS-E5", 1): "count(*) FROM raw_declarations",
    ("INS-E5", 2): "1::BIGINT",
    ("FIN-E1", 0): "count(date_received) FROM raw_complaints WHERE state_code_raw = 'MI'",
    ("FIN-E1", 1): "count(DISTINCT date_received[1:7]) FROM raw_complaints WHERE state_code_raw = 'MI'",
    ("FIN-E1", 2): "count(B01003_001E) FROM raw_population WHERE geo_level = 'county' AND state = '26'",
    ("FIN-E1", 3): "count(B01003_001E) FROM raw_population WHERE geo_level = 'us'",
    ("FIN-E2", 0): "count(DISTINCT product) FROM raw_complaints WHERE state_code_raw = 'MI'",
    ("FIN-E2", 1): "count(DISTINCT partition_year) FROM raw_complaints WHERE state_code_raw = 'MI'",
    ("FIN-E3", 0): "count(timely_response_raw) FROM raw_complaints WHERE state_code_raw = 'MI'",
    ("FIN-E3", 1): "count(DISTINCT company_response) FROM raw_complaints WHERE state_code_raw = 'MI'",
    ("FIN-E3", 2): "count(timely_response_raw) FROM raw_complaints",
    ("FIN-E4", 0): "count(DISTINCT action_taken) FROM raw_lending",
    ("FIN-E4", 1): "count(loan_amount) FROM raw_lending",
    ("FIN-E4", 2): "count(DISTINCT activity_year) FROM raw_lending",
    ("FIN-E4", 3): "NULL::BIGINT",
    ("FIN-E5", 0): "count(*) FROM raw_lending WHERE lei IS NOT NULL AND loan_amount IS NOT NULL",
    ("FIN-E5", 1): "count(name) FROM raw_institutions",
    ("FIN-E5", 2): "count(company_name) FROM raw_complaints WHERE state_code_raw = 'MI'",
    ("HLT-E1", 0): "count(low) FROM raw_indicators WHERE locationabbr = 'MI' AND topic ILIKE '%cognitive decline%'",
    ("HLT-E1", 1): "count(*) FROM raw_indicators WHERE locationabbr = 'US' AND topic ILIKE '%cognitive decline%'",
    # The derived geography file has no per-capita home-health column: a dropped column is -1.
    ("HLT-E2", 0): "-1::BIGINT",
    ("HLT-E2", 1): "count(*) FROM raw_medicare WHERE BENE_GEO_LVL = 'National'",
    ("HLT-E2", 2): "count(DISTINCT YEAR) FROM raw_medicare WHERE BENE_GEO_LVL = 'County' AND BENE_GEO_CD LIKE '26%'",
    ("HLT-E3", 0): "count(TOT_MDCR_STDZD_PYMT_PC) FROM raw_medicare WHERE BENE_AGE_LVL = '>=65'",
    ("HLT-E3", 1): "count(DISTINCT BENE_GEO_LVL) FROM raw_medicare WHERE BENE_AGE_LVL = '>=65' AND (BENE_GEO_DESC = 'MI' OR BENE_GEO_LVL = 'National')",
    ("HLT-E3", 2): "count(*) FROM prices WHERE is_deflator_series AND period_code = 'M13'",
    ("HLT-E4", 0): "count(*) FROM raw_indicators WHERE locationabbr = 'MI' AND class ILIKE '%caregiv%'",
    ("HLT-E4", 1): "count(DISTINCT yearstart) FROM raw_indicators WHERE locationabbr = 'MI' AND class ILIKE '%caregiv%'",
    ("HLT-E5", 0): "count(S0101_C01_030E) FROM raw_population_65 WHERE geo_level = 'county' AND state = '26'",
    ("HLT-E5", 1): "count(DISTINCT vintage) FROM raw_population_65 WHERE geo_level = 'county' AND state = '26'",
    ("HLT-E5", 2): "count(*) FROM raw_indicators WHERE locationabbr = 'MI'",
}


def _ingredients_sql() -> str:
    return "\nUNION ALL ".join(
        f"(SELECT '{q.track}' AS track, '{q.id}' AS question, '{i.name}' AS ingredient, {i.minimum}::BIGINT AS minimum, x.f AS found FROM (SELECT {_FOUND[(q.id, n)].replace(' FROM', ' AS f FROM', 1) if ' FROM' in _FOUND[(q.id, n)] else _FOUND[(q.id, n)] + ' AS f'}) x)"
        for q in coverage.QUESTIONS for n, i in enumerate(q.ingredients))


def _landed(t: Testbed) -> dict[str, DataFrame]:
    raw = {source: t.raw(name) for source, name in _SOURCES.items()}
    raw["manifest:nfip_claims"] = raw["nfip_claims"].agg(F.count(F.lit(1)).alias("source_reported_count"))
    return raw


@entry("coverage_ingredients", _ingredients_sql())
def coverage_ingredients(t: Testbed) -> DataFrame:
    return coverage.measure_ingredients(_landed(t), t.spark, t.params)


@entry("question_coverage", f"""
SELECT track, question AS source, 'answerable from raw' AS check_name,
  CASE WHEN count(*) FILTER (found IS NULL) > 0 THEN 'SKIP' WHEN count(*) FILTER (found < minimum) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  concat(count(*), ' ingredients, missing=', count(*) FILTER (found IS NULL OR found < minimum)) AS detail
FROM ({_ingredients_sql()}) GROUP BY track, question""")
def question_coverage(t: Testbed) -> DataFrame:
    return coverage.check_questions(coverage.measure_ingredients(_landed(t), t.spark, t.params))


# ── D11 to D18 ───────────────────────────────────────────────────────────────────────────


@entry("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Testbed) -> DataFrame:
    return integrity.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@entry("paging_invariants", """
WITH clean AS (SELECT event_id // 1000 AS page, event_id % 1000 AS pos, event_id AS id FROM events),
r AS (
  SELECT 'events' AS source, * FROM clean
  UNION ALL SELECT 'events_disordered', page, CASE pos WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE pos END, id FROM clean WHERE page <> 1
  UNION ALL SELECT 'events_disordered', page, 2000 + pos, id FROM clean WHERE page % 2 = 0 AND page <> 1 AND pos = 7),
o AS (SELECT *, lag(id) OVER (PARTITION BY source ORDER BY page, pos) AS prior, max(page) OVER (PARTITION BY source) AS top FROM r),
p AS (SELECT source, page, any_value(top) AS top, count(*) AS n FROM o GROUP BY ALL),
m AS (SELECT source, count(*) AS pages, count(*) FILTER (page < top AND n <> 1000) AS short, max(page) - min(page) + 1 - count(*) AS missing,
  count(*) FILTER (page = top AND n >= 1000) AS fl FROM p GROUP BY ALL),
d AS (SELECT source, count(*) - count(DISTINCT id) AS rep, count(*) FILTER (id <= prior) AS des FROM o GROUP BY ALL)
SELECT 'insurance' AS track, source, unnest(['ids unique and ascending', 'pages full but the last', 'last page not full']) AS check_name,
  unnest([if(rep = 0 AND des = 0, 'PASS', 'FAIL'), if(short = 0 AND missing = 0, 'PASS', 'FAIL'), if(fl = 0, 'PASS', 'WARN')]) AS status,
  unnest([concat('pages=', pages, ', repeated=', rep, ', descending=', des), concat('short=', short, ', missing=', missing),
          concat('full_last=', fl)]) AS detail FROM m JOIN d USING (source)""")
def paging_invariants(t: Testbed) -> DataFrame:
    """The ids as they are, and once with a page gone, two rows swapped in every page and repeats at the end of pages."""
    place = F.col("event_id") % 1000
    clean = t.table("events").select("event_id", F.floor(F.col("event_id") / 1000).alias("page"), place.alias("pos"))
    swapped = F.when(F.col("pos") == 5, 6).when(F.col("pos") == 6, 5).otherwise(F.col("pos")).cast("bigint")
    left = clean.where("page <> 1")
    again = left.where("page % 2 = 0 and pos = 7").withColumn("pos", F.col("pos") + 2000)
    faulty = union_all([left.withColumn("pos", swapped), again])
    return union_all([integrity.paging(df, "page", "pos", "event_id", 1000, "insurance", source)
                      for df, source in ((clean, "events"), (faulty, "events_disordered"))])


@entry("scope_and_floors", """
SELECT 'outside scope' AS check_name, state_code AS key, count(*) AS row_count FROM raw_lending WHERE state_code <> 'MI' GROUP BY ALL
UNION ALL SELECT 'below floor', vintage || ' ' || geo_level, count(*) FROM raw_population WHERE geo_level = 'county' GROUP BY ALL HAVING count(*) < 400
UNION ALL SELECT 'no core state', vintage, count(*) FILTER (state = '26') FROM raw_population WHERE geo_level = 'state' GROUP BY ALL HAVING count(*) FILTER (state = '26') = 0""")
def scope_and_floors(t: Testbed) -> DataFrame:
    leaked = integrity.outside_scope(t.raw("lending"), "state_code", ["MI"]).groupBy(
        F.col("state_code").alias("key")).agg(F.count(F.lit(1)).alias("row_count"))
    places = t.raw("population")
    counties = places.where(F.col("geo_level") == "county")
    thin = integrity.below_floor(counties, ["vintage", "geo_level"], 400).select(
        F.concat_ws(" ", "vintage", "geo_level").alias("key"), "row_count")
    core = places.where(F.col("geo_level") == "state").groupBy(F.col("vintage").alias("key")).agg(
        F.count_if(F.col("state") == "26").alias("row_count")).where(F.col("row_count") == 0)
    return union_all([
        df.select(F.lit(name).alias("check_name"), "key", "row_count")
        for name, df in (("outside scope", leaked), ("below floor", thin), ("no core state", core))])


@entry("price_checks", f"""
SELECT 'pad width' AS check_name, length(series_id)::VARCHAR AS key, count(*) AS row_count FROM raw_prices GROUP BY ALL
UNION ALL SELECT 'annual averages', period_code, count(*) FROM prices WHERE period_code = 'M13' GROUP BY ALL
UNION ALL SELECT 'undefined series', series_id, 0 FROM (SELECT DISTINCT series_id FROM prices WHERE series_id NOT IN (SELECT series_id FROM price_series))""")
def price_checks(t: Testbed) -> DataFrame:
    widths = integrity.pad_widths(t.raw("prices"), "series_id").select(F.col("width").cast("string").alias("key"), "row_count")
    annual = t.prices.where(F.col("period_code") == fixed.ANNUAL_AVERAGE_PERIOD).groupBy(
        F.col("period_code").alias("key")).agg(F.count(F.lit(1)).alias("row_count"))
    undefined = integrity.undefined_keys(t.prices, staging.stage_price_series(t.raw("price_series")), "series_id").select(
        F.col("series_id").alias("key"), F.lit(0).cast("bigint").alias("row_count"))
    return union_all([
        df.select(F.lit(name).alias("check_name"), "key", "row_count")
        for name, df in (("pad width", widths), ("annual averages", annual), ("undefined series", undefined))])


@entry("observation_crosscheck", """
SELECT loss_year, claims, claims + CASE WHEN loss_year = 1997 THEN 1 ELSE 0 END AS published_claims, (CASE WHEN loss_year = 1997 THEN -1 ELSE 0 END)::BIGINT AS gap,
  loss_year <> 1997 AS agrees FROM (SELECT year_of_loss AS loss_year, count(*) AS claims FROM raw_claims GROUP BY ALL)""")
def observation_crosscheck(t: Testbed) -> DataFrame:
    measured = t.claims.groupBy(F.col("year_of_loss").alias("loss_year")).agg(F.count(F.lit(1)).alias("claims"))
    year = F.year("l_shipdate")
    published = t.table("lineitem").groupBy(year.alias("loss_year")).agg(F.count(F.lit(1)).alias("claims")).withColumn(
        "claims", F.col("claims") + F.when(F.col("loss_year") == 1997, 1).otherwise(0))
    return integrity.cross_check(measured, published, ["loss_year"], "claims")


@entry("zero_weight_profile", """
SELECT count(*) AS zips, count(*) FILTER (r = 0) AS no_residential, count(*) FILTER (a = 0) AS no_weight_at_all
FROM (SELECT zip5, sum(res_ratio) AS r, sum(tot_ratio) AS a FROM crosswalk GROUP BY zip5)""")
def zero_weight_profile(t: Testbed) -> DataFrame:
    return integrity.zero_weight_profile(t.crosswalk)


# ── D19 to D24: drift, conservation, contracts, generic tests ────────────────────────────
_DRIFT_BASE = {"orders": ("exact", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
               "customer": ("exact", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_phone"]),
               "supplier": ("exact", ["s_suppkey", "s_name", "s_nationkey"]),
               "part": ("subset", ["p_partkey", "p_name"]), "events": ("count", []), "documents": ("none", [])}
_MODES = "source|mode|expected_count\n" + "\n".join(
    f"{s}|{m}|{6 if m == 'count' else ''}" for s, (m, _) in _DRIFT_BASE.items())



def _row_counts(t: Testbed, names) -> DataFrame:
    return union_all([
        t.table(name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("source"), "row_count")
        for name in names])


def _row_counts_sql(names) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS row_count FROM {n}" for n in names)


@entry("schema_drift", f"""
SELECT source, 'schema drift' AS check_name, status, detail, row_count FROM (VALUES ('orders', 'PASS', 'present=6, dropped=0, added=0'),
  ('customer', 'FAIL', 'present=5, dropped=1, added=1'), ('supplier', 'WARN', 'present=4, dropped=0, added=1'), ('part', 'PASS', 'present=6, dropped=0, added=4'),
  ('events', 'PASS', 'present=6, dropped=0, added=6'), ('documents', 'SKIP', 'present=5, dropped=0, added=5')) AS v(source, status, detail)
JOIN ({_row_counts_sql(_DRIFT_BASE)}) USING (source)""")
def schema_drift(t: Testbed) -> DataFrame:
    observed = drift.column_roster({s: t.table(s) for s in _DRIFT_BASE}, t.spark)
    lines = ["source|column_name"] + [f"{s}|{c}" for s, (_, columns) in _DRIFT_BASE.items() for c in columns]
    checked = drift.schema_drift(observed, fixed_table(t.spark, "\n".join(lines)), fixed_table(t.spark, _MODES))
    return checked.join(_row_counts(t, _DRIFT_BASE), "source")


_TRACK = {"claims": "insurance", "policies": "insurance", "declarations": "insurance", "complaints": "fintech",
          "lending": "fintech", "institutions": "fintech", "indicators": "health", "medicare": "health",
          "population": "shared", "population_65": "shared", "prices": "shared", "crosswalk": "shared"}


@entry("staging_conservation", "\nUNION ALL ".join(
    f"SELECT '{track}' AS track, '{name}' AS source, 'staging conserves rows' AS check_name, 'PASS' AS status, concat('raw=', count(*), ', staged=', count(*)) AS detail FROM raw_{name}"
    for name, track in _TRACK.items()))
def staging_conservation(t: Testbed) -> DataFrame:
    return union_all([
        drift.conserves_rows(t.raw(name), getattr(t, name), track, name) for name, track in _TRACK.items()])


@entry("generic_tests", """
SELECT 'unique claim_id' AS check_name, count(*) AS failing_rows FROM (SELECT claim_id FROM claims GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'not_null county_fips', count(*) FROM claims WHERE county_fips IS NULL
UNION ALL SELECT 'accepted zip_mask_kind', count(DISTINCT zip_mask_kind) FROM complaints WHERE zip_mask_kind NOT IN ('full', 'null')
UNION ALL SELECT 'related lei', count(DISTINCT lei) FROM lending WHERE lei NOT IN (SELECT lei FROM institutions WHERE institution_name_normalized IS NOT NULL)
UNION ALL SELECT 'unique orders', 0""")
def generic_tests(t: Testbed) -> DataFrame:
    named = t.institutions.where(F.col("institution_name_normalized").isNotNull()).select("lei").distinct()
    return must.count_failures({
        "unique claim_id": must.not_unique(t.claims, "claim_id"),
        "not_null county_fips": must.is_null(t.claims, "county_fips"),
        "accepted zip_mask_kind": must.unaccepted(t.complaints, "zip_mask_kind", ["full", "null"]),
        "related lei": must.unrelated(t.lending, "lei", named, "lei"),
        "unique orders": must.not_unique(t.table("orders"), "o_orderkey"),
    })


_CONTRACTED = {"mart_ins.dim_ins_disaster_declaration": ("insurance", "disasters"), "mart_fin.fct_fin_complaints_daily_state": ("fintech", "complaints_daily")}


def _contracted(t: Testbed) -> dict[str, DataFrame]:
    return dict(zip(_CONTRACTED, (insurance.disasters(t.declarations, t.params), lending.complaints_daily(t.complaints, t.params)), strict=True))


def _lost_and_retyped(df: DataFrame) -> DataFrame:
    """A frame that breaks its contract: the last column is gone, the first is text, one is new."""
    first, *kept = df.columns[:-1]
    return df.select(F.concat(F.lit("n"), F.col(first).cast("string")).alias(first), *kept, F.lit(1).alias("added"))


_CONTRACT_SQL = "\nUNION ALL ".join(f"""
SELECT '{track}' AS track, '{table}' AS source, unnest(['contract', 'a breach is refused']) AS check_name, unnest(['PASS', 'PASS']) AS status,
  unnest([concat('breaches=0, rows=', count(*)), concat('breaches=3, rows=', count(*))]) AS detail FROM {relation}"""
                                     for table, (track, relation) in _CONTRACTED.items())


@entry("contract_check", _CONTRACT_SQL)
def contract_check(t: Testbed) -> DataFrame:
    """Tables written under their contracts, and what a frame meets that breaks one."""
    parts = []
    for table, df in _contracted(t).items():
        track, contract, wrong = _CONTRACTED[table][0], contracts()[table], _lost_and_retyped(df)
        try:
            checked(wrong, table)
            refused = False
        except ContractBreach:
            refused = True
        detail = lambda n: F.concat(F.lit(f"breaches={n}, rows="), F.col("n").cast("string"))
        parts.append(results(
            df.agg(F.count(F.lit(1)).alias("n")), track, table,
            ("contract", passes(F.lit(not contract.breaches(df))), detail(len(contract.breaches(df)))),
            ("a breach is refused", passes(F.lit(refused)), detail(len(contract.breaches(wrong))))))
    return union_all(parts)


_DICTIONARY_SQL = "\nUNION ALL ".join(f"""
SELECT '{table.split('.')[0]}' AS schema_name, '{table.split('.')[1]}' AS relation_name, '{'insurance' if '_ins' in table else 'fintech'}' AS track, 'mart' AS layer, i AS ordinal_position,
  c[1] AS column_name, c[2] AS data_type, true AS is_documented, true AS is_described, (SELECT count(*) FROM {relation}) AS row_count
FROM (SELECT unnest(range(1, {len(contracts()[table].columns) + 1})) AS i, unnest([{', '.join(f"['{c}', '{k}']" for c, k in contracts()[table].columns.items())}]) AS c)"""
                                       for table, (_, relation) in _CONTRACTED.items())


@entry("contracted_dictionary", _DICTIONARY_SQL)
def contracted_dictionary(t: Testbed) -> DataFrame:
    """Two contracted tables as the catalogue has them after they were saved."""
    saved = {table: sinks.save_table(df, table, path=shared_folder(t.spark, "saved")) for table, df in _contracted(t).items()}
    rows = catalogue_rows(t.spark, ["mart_ins", "mart_fin"])
    described = data_dictionary(rows.where(F.concat_ws(".", "schema_name", "relation_name").isin(*saved)))
    counts = union_all([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(table).alias("table"), "row_count") for table, df in saved.items()])
    return described.join(counts, F.col("table") == F.concat_ws(".", "schema_name", "relation_name")).select(
        "schema_name", "relation_name", "track", "layer", "ordinal_position", "column_name", "data_type", "is_documented",
        F.col("relation_description").isNotNull().alias("is_described"), "row_count")


@entry("report_tally", f"""
SELECT track, source, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'SKIP') AS skip,
  count(*) FILTER (status = 'FAIL') AS fail FROM ({' UNION ALL '.join(_gate_sql(s) for s in _GATES_SQL)}) GROUP BY track, source""")
def report_tally(t: Testbed) -> DataFrame:
    return tally(geography_gates(t))


# ── V1 to V21: assertions over the marts ─────────────────────────────────────────────────


@entry("assertions_insurance", """
SELECT 'denominators constant (claims)' AS check_name, count(*) AS failing_rows FROM (SELECT county_fips, loss_year_month FROM claims_monthly WHERE county_fips IS NOT NULL
  GROUP BY ALL HAVING count(DISTINCT county_population) > 1 OR count(DISTINCT population_vintage_window) > 1)
UNION ALL SELECT 'anchor events found', count(*) FROM (VALUES (0), (1), (3)) a(d) WHERE d NOT IN (SELECT disaster_number FROM bridge)
UNION ALL SELECT 'only floods attribute', count(DISTINCT incident_type) FROM bridge WHERE lower(incident_type) NOT IN ('flood', 'severe storm', 'dam/levee break')
UNION ALL SELECT 'roster complete', count(*) FROM (SELECT count(*) FILTER (is_reportable_county) AS a, count(*) FILTER (geography_kind = 'unknown_county') AS b FROM counties WHERE is_michigan) WHERE a <> 83 OR b <> 1
UNION ALL SELECT 'county keys resolve', count(*) FROM county_refs r WHERE r.county_fips <> '' AND r.county_fips NOT IN (SELECT county_fips FROM counties)
UNION ALL SELECT 'marts tie', 0
UNION ALL SELECT 'no loss past horizon', count(*) FROM claims_monthly WHERE loss_year_month > (SELECT strftime(max(date_of_loss), '%Y-%m') FROM claims)
UNION ALL SELECT 'no policy month past horizon', count(*) FROM in_force WHERE month_end > (SELECT max(as_of_date) FROM policies)""")
def assertions_insurance(t: Testbed) -> DataFrame:
    # Each mart feeds several assertions, so the columns that they read are written once and read back.
    monthly = materialise(insurance.claims_monthly(t.claims, t.population, t.prices, t.counties, t.params).select(
        "county_fips", "loss_year_month", "county_population", "population_vintage_window", "claim_count", "paid_total"), "monthly")
    counties = materialise(t.counties, "counties")
    in_force = insurance.policies_in_force(t.policies, counties, t.params)
    bridge = materialise(insurance.claim_declarations(
        t.claims, t.declarations, insurance.disasters(t.declarations, t.params), t.params).select("disaster_number", "incident_type"), "bridge")
    detail = insurance.claims_detail(t.claims, t.prices, counties, t.params)
    mine = t.claims.where(F.col("state_code") == t.params.focus_state)
    return must.count_failures({
        "denominators constant (claims)": must.varying_denominators(monthly, "loss_year_month"),
        "anchor events found": must.unfound_events(bridge, [0, 1, 3]),
        "only floods attribute": must.nonflood_attributions(bridge),
        "roster complete": must.incomplete_roster(counties, t.params),
        "county keys resolve": must.unresolved_counties(t.referenced, counties),
        "marts tie": must.untied([
            ("claim_count", must.total(monthly, "claim_count"), must.row_total(t.claims)),
            ("paid_total", must.total(monthly, "paid_total", 2), must.total(t.claims, "total_amount_paid", 2)),
            ("claim_detail", must.row_total(detail), must.row_total(mine)),
            ("reconciliation_warehouse_to_mart", must.total(monthly, "claim_count"), must.row_total(t.raw("claims")))]),
        "no loss past horizon": must.past_horizon(
            monthly, "loss_year_month", t.claims, F.date_format("date_of_loss", "yyyy-MM")),
        "no policy month past horizon": must.past_horizon(in_force, "month_end", t.policies, F.col("as_of_date")),
    })


def _complaints_once(t: Testbed) -> DataFrame:
    """The staged complaints, written once for several marts without the texts that none of them reads."""
    return materialise(t.complaints.drop(
        "consumer_narrative", "company_public_response", "state_code_raw", "zip_code_raw", "tags", "submitted_via"), "staged-complaints")


@entry("assertions_fintech", """
SELECT 'allocation conserves' AS check_name, count(*) AS failing_rows FROM (SELECT state_code, count(*) AS n FROM complaints WHERE state_code IS NOT NULL GROUP BY ALL) c
  LEFT JOIN (SELECT state_code, sum(allocated_complaints) AS a FROM allocation GROUP BY ALL) s USING (state_code) WHERE a IS NULL OR abs(a - n) > 0.1
UNION ALL SELECT 'denominators constant (complaints)', count(*) FROM (SELECT county_fips, year_month FROM complaints_geo WHERE county_fips IS NOT NULL
  GROUP BY ALL HAVING count(DISTINCT county_population) > 1 OR count(DISTINCT population_vintage_window) > 1)
UNION ALL SELECT 'labels map to a family', (SELECT count(DISTINCT product) FROM complaints WHERE product_family IS NULL) + (SELECT count(DISTINCT company_response) FROM complaints WHERE response_family IS NULL)
UNION ALL SELECT 'codes decode', count(DISTINCT loan_purpose) FROM lending WHERE loan_purpose_label IS NULL
UNION ALL SELECT 'marts tie', 0
UNION ALL SELECT 'actions partition applications', 0
UNION ALL SELECT 'parts within whole (company)', count(*) FROM complaints_company WHERE timely_count > closed_complaints OR relief_count > closed_complaints OR closed_complaints + pending_complaints <> complaint_count
UNION ALL SELECT 'parts within whole (daily)', count(*) FROM complaints_daily WHERE timely_count > closed_complaints OR relief_count > closed_complaints OR closed_complaints + pending_complaints <> complaint_count
UNION ALL SELECT 'allocated timely within closed', count(*) FROM complaints_geo WHERE allocated_timely > allocated_complaints - allocated_pending + 0.000001
UNION ALL SELECT 'denials within decisions', count(*) FROM lending_annual WHERE denied_count > decided_applications
UNION ALL SELECT 'rates within 0-100', 0""")
def assertions_fintech(t: Testbed) -> DataFrame:
    complaints = _complaints_once(t)
    allocation = materialise(intermediate.allocate_complaints(complaints, t.crosswalk, t.weights), "allocation")
    # Of each mart the columns that the assertions read.
    geo = materialise(lending.complaints_by_county(allocation, t.population, t.counties, t.params).select(
        "county_fips", "year_month", "county_population", "population_vintage_window",
        "allocated_complaints", "allocated_timely", "allocated_pending"), "geo")
    parts = ("period_id", "complaint_count", "closed_complaints", "pending_complaints", "timely_count", "relief_count", "timely_rate_pct", "relief_rate_pct")
    company = materialise(lending.complaints_by_company(complaints, t.params).select(*parts), "company")
    daily = materialise(lending.complaints_daily(complaints, t.params).select(*parts), "daily")
    annual = materialise(lending.lending_annual(t.lending, t.institutions, t.counties, t.params, medians=False).select(
        "activity_year", "period_id", "application_count", *lending.ACTION_GROUPS, "denial_rate_pct"), "annual")
    placed = complaints.where(F.col("state_code").isNotNull())
    rates = union_all([
        must.rates_out_of_range(company, ["timely_rate_pct", "relief_rate_pct"]).select("period_id"),
        must.rates_out_of_range(daily, ["timely_rate_pct", "relief_rate_pct"]).select("period_id"),
        must.rates_out_of_range(annual, ["denial_rate_pct"]).select("period_id")])
    return must.count_failures({
        "allocation conserves": must.allocation_loss(complaints, allocation),
        "denominators constant (complaints)": must.varying_denominators(geo, "year_month"),
        "labels map to a family": must.unmapped_labels(complaints),
        "codes decode": must.undecoded(t.lending),
        "marts tie": must.untied([
            ("geo_rows", must.row_total(geo), must.row_total(allocation)),
            ("geo_complaints", must.total(geo, "allocated_complaints", 0), must.total(allocation, "allocated_complaints", 0)),
            ("company_complaints", must.total(company, "complaint_count"), must.row_total(placed)),
            ("daily_complaints", must.total(daily, "complaint_count"), must.row_total(placed)),
            ("daily_rolls_up", must.total(daily, "complaint_count"), must.total(company, "complaint_count")),
            ("applications", must.total(annual, "application_count"), must.row_total(t.lending))]),
        "actions partition applications": must.ungrouped_actions(annual),
        "parts within whole (company)": must.parts_above_whole(company),
        "parts within whole (daily)": must.parts_above_whole(daily),
        "allocated timely within closed": must.allocated_timely_above_closed(geo),
        "denials within decisions": must.denials_above_decisions(annual),
        "rates within 0-100": rates,
    })


@entry("assertions_health", """
SELECT 'directions never cross the break' AS check_name, count(*) AS failing_rows FROM versus WHERE (mi_change_from_prior IS NOT NULL AND (mi_not_comparable_pre_2019 OR spans_multiple_years))
  OR (mi_direction IN ('improving', 'deteriorating') AND mi_change_from_prior IS NULL)
UNION ALL SELECT 'cycles are listed', count(DISTINCT cycle_key) FROM cells WHERE cycle_key NOT IN (SELECT cycle_key FROM seed_cycles)
UNION ALL SELECT 'payments carry a flag', count(*) FROM services WHERE measure_kind IN ('per_capita', 'per_user', 'amount', 'share_of_pymt') AND is_standardized IS NULL
UNION ALL SELECT 'long-term care is not empty', if(count(*) FILTER (is_long_term_care AND is_standardized AND measure_kind = 'per_capita') = 0, 1, 0) FROM services
UNION ALL SELECT 'cost is the standardised series', 0
UNION ALL SELECT 'growth windows do not overlap', 0
UNION ALL SELECT 'age levels are not mixed', count(*) FROM (SELECT geo_description, measure_year FROM cost WHERE is_jurisdiction OR geo_level = 'National' GROUP BY ALL HAVING count(DISTINCT age_level) <> 3)
UNION ALL SELECT 'marts tie', 0
UNION ALL SELECT 'a planted gap is seen', if(count(*) > 0, 1, 0) FROM population_65
  WHERE geo_level = 'county' AND is_michigan AND population_65_plus_is_published AND county_fips <= '26001'""")
def assertions_health(t: Testbed) -> DataFrame:
    measures = materialise(t.measures, "measures")
    cells = materialise(health.indicators(t.indicators), "cells")
    compared = materialise(health.state_vs_national(cells, t.params), "compared")
    cost = materialise(health.medicare_cost(measures, t.medicare, t.prices, t.params), "cost")
    services = materialise(health.medicare_services(measures, t.medicare, t.counties, t.params), "services")
    elderly = materialise(health.population_65_plus(t.population_65, t.counties, t.params), "elderly")
    need = health.need_vs_capacity(elderly, compared, t.params)
    published = t.population_65.where("geo_level = 'county' AND is_michigan AND population_65_plus_is_published")
    latest = F.col("vintage_year") == t.params.growth_to_vintage
    county_rows = measures.where((F.col("age_level") == "All") & F.col("is_michigan_county"))
    return must.count_failures({
        "directions never cross the break": must.directions_cross_break(compared),
        "cycles are listed": must.unlisted_cycles(t.indicators),
        "payments carry a flag": must.unstandardized_payments(services),
        "long-term care is not empty": must.empty_long_term_care(services),
        "cost is the standardised series": must.cost_off_series(cost, measures),
        "growth windows do not overlap": must.overlapping_growth(need, elderly, t.params),
        "age levels are not mixed": must.mixed_age_levels(services, cost),
        "marts tie": must.untied([
            ("cells", must.row_total(cells), must.row_total(t.indicators)),
            ("county_service_measures", must.row_total(services), must.row_total(county_rows)),
            ("cost_geography_years", must.row_total(cost), must.row_total(measures.where(
                "service_code = 'TOT' AND measure_kind = 'per_capita' AND is_standardized AND geo_level IN ('State', 'National')"))),
            ("mi_population_county_vintages", must.row_total(elderly), must.row_total(published)),
            ("mi_population_latest_vintage", must.total(elderly.where(latest), "population_65_plus"),
             must.total(published.where(latest), "population_65_plus"))]),
        # The same tie with one county left out of one side must fail, or the ties above say nothing.
        "a planted gap is seen": must.untied([
            ("short", must.row_total(published.where("county_fips > '26001'")), must.row_total(published))]),
    })


@entry("assertions_periods", """
WITH used AS (SELECT DISTINCT 'complaints' AS model, 'month' AS expected_grain, 'month:' || received_year_month AS period_id FROM complaints
  UNION SELECT 'lending', 'year', 'year:' || activity_year FROM lending UNION SELECT 'cells', 'survey_cycle', 'survey_cycle:' || cycle_key FROM cells
  UNION SELECT 'wrong grain', 'month', 'year:' || activity_year FROM lending)
SELECT 'periods unique' AS check_name, count(*) AS failing_rows FROM (SELECT grain, period_key FROM periods GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'spans agree with dates', count(*) FROM periods WHERE spans_multiple_years <> (year(period_end) > year(period_start))
UNION ALL SELECT 'fact periods resolve', count(*) FROM used LEFT JOIN periods p USING (period_id) WHERE p.grain IS NULL OR p.grain <> expected_grain""")
def assertions_periods(t: Testbed) -> DataFrame:
    periods = conformed.period_dimension(t.spark)
    month, year = F.concat(F.lit("month:"), F.col("received_year_month")), F.concat(F.lit("year:"), F.col("activity_year"))
    cycle = F.concat(F.lit("survey_cycle:"), F.col("cycle_key"))
    years = t.lending.select(year.alias("period_id"))
    return must.count_failures({
        "periods unique": must.repeated_periods(periods),
        "spans agree with dates": must.mislabelled_spans(periods),
        "fact periods resolve": must.unresolved_periods({
            "complaints": ("month", t.complaints.select(month.alias("period_id"))),
            "lending": ("year", years), "cells": ("survey_cycle", t.indicators.select(cycle.alias("period_id"))),
            "wrong grain": ("month", years)}, periods),
    })


_FACT_RELATIONS = {
    "fct_ins_claims_monthly": "claims_monthly", "fct_ins_claims_detail_mi": "claims_detail", "fct_ins_policies_mi_monthly": "in_force",
    "fct_fin_complaints_monthly_geo": "complaints_geo", "fct_fin_complaints_monthly_company": "complaints_company",
    "fct_fin_complaints_daily_state": "complaints_daily", "rpt_fin_publication_window": "publication", "fct_fin_hmda_annual": "lending_annual",
    "fct_hlt_medicare_cost_annual": "cost", "fct_hlt_medicare_service_county": "services", "fct_hlt_mi_population_65_plus": "elderly",
    "fct_hlt_cdc_indicators": "indicators", "fct_hlt_cdc_mi_vs_national": "versus"}
#: Facts that claim a grain which they do not have: each grain once, by the fact whose periods it takes.
_WRONG_GRAINS = {"month": "fct_hlt_mi_population_65_plus", "year": "fct_hlt_cdc_indicators", "survey_cycle": "rpt_fin_publication_window"}
_USED = " UNION ALL ".join(
    [f"SELECT '{m}' AS model, '{must.PERIOD_GRAINS[m]}' AS expected_grain, period_id FROM {r}" for m, r in _FACT_RELATIONS.items()]
    + [f"SELECT 'wrong {grain}', '{grain}', period_id FROM {_FACT_RELATIONS[m]}" for grain, m in _WRONG_GRAINS.items()])


@entry("fact_periods", f"""
SELECT model, expected_grain, count(u.period_id) AS periods, count(*) FILTER (u.period_id IS NOT NULL AND p.grain IS NULL) AS unknown,
  count(*) FILTER (p.grain <> expected_grain) AS other_grain, coalesce(sum(n) FILTER (u.period_id IS NULL), 0)::BIGINT AS rows_without
FROM (SELECT model, expected_grain, period_id, count(*) AS n FROM ({_USED}) GROUP BY ALL) u LEFT JOIN periods p USING (period_id) GROUP BY ALL""")
def fact_periods(t: Testbed) -> DataFrame:
    """The periods of all thirteen facts in one pass, and of three that claim a wrong grain."""
    indicators, complaints = health.indicators(t.indicators), _complaints_once(t)
    allocation = intermediate.allocate_complaints(complaints, t.crosswalk, t.weights)
    built = dict(zip(must.PERIOD_GRAINS, (
        insurance.claims_monthly(t.claims, t.population, t.prices, t.counties, t.params),
        insurance.claims_detail(t.claims, t.prices, t.counties, t.params),
        insurance.policies_in_force(t.policies, t.counties, t.params),
        lending.complaints_by_county(allocation, t.population, t.counties, t.params),
        lending.complaints_by_company(complaints, t.params), lending.complaints_daily(complaints, t.params),
        lending.publication_window(complaints, t.params),
        lending.lending_annual(t.lending, t.institutions, t.counties, t.params, medians=False),
        health.medicare_cost(t.measures, t.medicare, t.prices, t.params),
        health.medicare_services(t.measures, t.medicare, t.counties, t.params),
        health.population_65_plus(t.population_65, t.counties, t.params),
        indicators, health.state_vs_national(indicators, t.params)), strict=True))
    facts = must.period_facts(built)
    wrong = {f"wrong {grain}": (grain, built[m]) for grain, m in _WRONG_GRAINS.items()}
    return must.period_usage({**facts, **wrong}, conformed.period_dimension(t.spark))


@entry("tie_out", """
SELECT 'claims' AS measure, (SELECT sum(claim_count) FROM claims_monthly)::DOUBLE AS mart_value, (SELECT count(*) FROM claims)::DOUBLE AS base_value, 0::DOUBLE AS gap
UNION ALL SELECT 'complaints', (SELECT sum(complaint_count) FROM complaints_company)::DOUBLE, (SELECT count(*) FROM complaints)::DOUBLE, -(SELECT count(*) FROM complaints WHERE state_code IS NULL)::DOUBLE""")
def tie_out(t: Testbed) -> DataFrame:
    monthly = insurance.claims_monthly(t.claims, t.population, t.prices, t.counties, t.params)
    company = lending.complaints_by_company(t.complaints, t.params)
    return must.ties([
        ("claims", must.total(monthly, "claim_count"), must.row_total(t.claims)),
        ("complaints", must.total(company, "complaint_count"), must.row_total(t.complaints))])


# ── reports over the whole run ───────────────────────────────────────────────────────────


@entry("insurance_reconciliation", """
SELECT 'nfip_claims' AS source_name, 'claim records' AS measure_label, n + 5 AS publisher_figure, n AS rows_landing, n AS rows_raw, n AS rows_duckdb, n AS rows_staged, n AS rows_in_mart,
  5::BIGINT AS publisher_to_landing_gap, 0::BIGINT AS warehouse_to_mart_gap, '2001-12-31' AS retrieved_at, '2001-12-30' AS source_last_refresh, '2001-12-29' AS source_metadata_refresh,
  'A publisher gap is timing; a warehouse-to-mart gap is a defect here.' AS interpretation FROM (SELECT count(*) AS n FROM claims)
UNION ALL SELECT 'fema_declarations', 'declaration-area records', n, n, n, n, n, n, 0, 0, '2001-12-31', '2001-12-30', NULL, concat('Area rows collapse to ', d, ' disasters in the mart.')
FROM (SELECT count(*) AS n, count(DISTINCT disaster_number) AS d FROM declarations)
UNION ALL SELECT 'nfip_policies', 'policy records (Michigan slice)', NULL, n, n, n, n, n, NULL, 0, '2001-12-31', '2001-12-30', NULL, concat('The slice has no published count; nationally there are ', n * 10, ' policies.')
FROM (SELECT count(*) AS n FROM policies)""")
def insurance_reconciliation(t: Testbed) -> DataFrame:
    def manifest(name: str, key: str, **facts) -> DataFrame:
        """Counted, written and read back as a load does it."""
        counts = sinks.flag_nonstandard_keys(sinks.partition_counts(t.raw(name), key))
        path = shared_folder(t.spark, f"manifest-{name}") + "/manifest.json"
        sinks.write_manifest(sinks.manifest_row(
            counts, source_last_refresh="2001-12-30", retrieved_at="2001-12-31", **facts), path)
        return readers.read_manifest(t.spark, path)

    n_claims, n_areas, n_policies = (t.raw(name).count() for name in ("claims", "declarations", "policies"))
    manifests = {
        "nfip_claims": manifest("claims", "state", source_reported_count=n_claims + 5, source_metadata_refresh="2001-12-29"),
        "fema_declarations": manifest("declarations", "state", source_reported_count=n_areas),
        "nfip_policies": manifest("policies", "propertyState", source_reported_national=n_policies * 10),
    }
    monthly = insurance.claims_monthly(t.claims, t.population, t.prices, t.counties, t.params)
    return insurance.reconciliation(manifests, t.claims, monthly, t.declarations,
                                    insurance.disasters(t.declarations, t.params), t.policies)


@entry("data_dictionary", f"""
SELECT table_name AS relation_name, 'view' AS relation_kind, 'other' AS layer, 'shared' AS track, column_index AS ordinal_position, column_name, false AS is_documented, row_count
FROM duckdb_columns() JOIN ({_row_counts_sql(TABLES)}) ON source = table_name""")
def dictionary(t: Testbed) -> DataFrame:
    for name in TABLES:
        t.table(name).createOrReplaceTempView(name)
    rows = catalogue_rows(t.spark).where(F.col("relation_name").isin(*TABLES) & (F.col("relation_kind") == "view"))
    described = data_dictionary(rows).select(
        "relation_name", "relation_kind", "layer", "track", "ordinal_position", "column_name", "is_documented").distinct()
    return described.join(_row_counts(t, TABLES).withColumnRenamed("source", "relation_name"), "relation_name")
