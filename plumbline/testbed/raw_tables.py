"""Raw tables in the publishers' shapes, derived from the test tables.

The test tables hold no sentinels, masks or suppressed cells, so each query below writes
them in from the keys of its rows. The same text runs on Spark and on DuckDB; every row of
the source tables takes part, so the raw tables grow with the data.
"""

from __future__ import annotations

from plumbline.fixed_values import EXEMPTIBLE_AMOUNTS
from plumbline.testbed.dialect import Dialect


def complaints(d: Dialect) -> str:
    k, c = "o.o_orderkey", "o.o_custkey"
    day = "CAST(o.o_orderdate AS DATE)"
    year = "CAST(year(o.o_orderdate) AS INT)"
    zip5 = f"lpad({d.text(f'10000 + ({c} % 400) * 7')}, 5, '0')"
    closed = ["Closed with monetary relief", "Closed with non-monetary relief", "Closed with explanation",
              "Closed with relief", "Closed without relief", "Closed", "Untimely response",
              "Closed with explanation"]
    suffix = d.pick(f"{c} % 4", [" Bank", ", Corp.", " USA", " & Co"])
    return f"""
SELECT {d.text(k)} AS complaint_id,
  {d.text(day)} AS date_received,
  CASE WHEN {k} % 53 = 0 THEN NULL ELSE {d.text(d.plus_days(day, f'{k} % 9 - 1'))} END AS date_sent_to_company,
  CASE WHEN o.o_orderpriority LIKE '1%' THEN
         CASE WHEN {year} < 1997 THEN 'Credit reporting'
              WHEN {year} < 2000 THEN 'Credit reporting, credit repair services, or other personal consumer reports'
              ELSE 'Credit reporting or other personal consumer reports' END
       WHEN o.o_orderpriority LIKE '2%' THEN 'Mortgage'
       WHEN o.o_orderpriority LIKE '3%' THEN CASE WHEN {k} % 2 = 0 THEN 'Credit card' ELSE 'Credit card or prepaid card' END
       WHEN o.o_orderpriority LIKE '4%' THEN 'Payday loan, title loan, or personal loan'
       WHEN {k} % 41 = 0 THEN 'Loan of seeds'
       ELSE 'Checking or savings account' END AS product,
  c.c_mktsegment AS sub_product,
  'Issue ' || {d.text(f'{k} % 4')} AS issue,
  CASE WHEN {k} % 5 = 0 THEN NULL ELSE 'Sub ' || {d.text(f'{k} % 3')} END AS sub_issue,
  CASE WHEN {k} % 6 = 0 THEN 'Narrative ' || {d.text(k)} END AS consumer_narrative,
  CAST(NULL AS STRING) AS company_public_response,
  CASE WHEN {k} % 89 = 0 THEN NULL WHEN {c} % 97 = 0 THEN '** --'
       ELSE 'LENDER ' || {d.text(f'{c} % 200')} || {suffix} END AS company_name,
  CASE WHEN {k} % 61 = 0 THEN NULL WHEN {k} % 59 = 0 THEN 'MICHIGAN'
       WHEN {k} % 67 = 0 THEN 'ZZ'
       WHEN {c} % 3 = 0 THEN 'MI' ELSE {d.state('c.c_nationkey')} END AS state_code_raw,
  CASE WHEN {k} % 29 = 0 THEN '999XX' WHEN {k} % 11 = 0 THEN substr({zip5}, 1, 3) || 'XX' WHEN {k} % 13 = 0 THEN 'XXXXX'
       WHEN {k} % 17 = 0 THEN NULL WHEN {k} % 19 = 0 THEN 'N/A' WHEN {k} % 23 = 0 THEN '99999'
       ELSE {zip5} END AS zip_code_raw,
  CASE WHEN {k} % 30 = 0 THEN 'Older American, Servicemember' WHEN {k} % 10 = 0 THEN 'Older American'
       WHEN {k} % 12 = 0 THEN 'Servicemember' END AS tags,
  'Web' AS submitted_via,
  CASE WHEN o.o_orderstatus = 'P' AND ({year} = 2001 OR {k} % 300 = 0) THEN 'In progress'
       WHEN {k} % 43 = 0 THEN NULL WHEN {k} % 47 = 0 THEN 'Reviewed'
       ELSE {d.pick(f'{k} % 8', closed)} END AS company_response,
  CASE WHEN {k} % 83 = 0 THEN NULL WHEN {k} % 7 = 0 THEN 'No' ELSE 'Yes' END AS timely_response_raw,
  substr({d.text(day)}, 1, 4) AS partition_year
FROM {d.table('orders')} o JOIN {d.table('customer')} c ON c.c_custkey = o.o_custkey"""


def claims(d: Dialect) -> str:
    k, p = "(l.l_orderkey * 7 + l.l_linenumber)", "l.l_partkey"
    day = "CAST(l.l_shipdate AS DATE)"
    place = f"CASE WHEN {p} % 3 = 0 THEN 22 ELSE l.l_suppkey % 25 END"
    fips = f"CASE WHEN {p} % 29 = 1 THEN '72' ELSE {d.fips(place)} END"
    county = d.county3(f"{p} % 12")
    unpaid = f"{k} % 9 = 0"

    def money(expression: str) -> str:
        return f"CAST({expression} AS DECIMAL(12,2))"

    building = money(f"CASE WHEN {unpaid} THEN NULL WHEN {k} % 13 = 0 THEN 0 WHEN {k} % 101 = 0 THEN -50.25 "
                     "ELSE CAST(l.l_extendedprice AS DECIMAL(12,2)) END")
    contents = money(f"CASE WHEN {unpaid} THEN NULL WHEN {k} % 13 = 0 THEN 0 ELSE l.l_quantity * 10 END")
    icc = money(f"CASE WHEN {unpaid} OR {k} % 113 = 0 THEN NULL WHEN {k} % 13 = 0 THEN 0 ELSE l.l_linenumber * 5 END")
    return f"""
SELECT {d.text('l.l_orderkey')} || '-' || {d.text('l.l_linenumber')} || '-' || {d.text(p)} AS claim_id,
  CASE WHEN {p} % 3 = 0 THEN 'MI' WHEN {p} % 29 = 1 THEN 'PR' WHEN {p} % 31 = 1 THEN 'UN'
       ELSE {d.state(place)} END AS state_code,
  {day} AS date_of_loss, CAST(year(l.l_shipdate) AS INT) AS year_of_loss,
  CASE WHEN {k} % 5 = 0 THEN NULL WHEN {k} % 7 = 0 THEN '' WHEN {p} % 37 = 0 THEN '99001'
       ELSE {fips} || {county} END AS county_code,
  CASE WHEN {k} % 10 = 0 THEN NULL WHEN {k} % 35 = 5 THEN '' ELSE {fips} || {county} || '000100' END AS census_geoid,
  {building} AS amount_building, {contents} AS amount_contents, {icc} AS amount_icc,
  CAST({building} - 100 AS DECIMAL(12,2)) AS net_building, {contents} AS net_contents, {icc} AS net_icc,
  CASE WHEN {k} % 18 = 0 THEN '01' END AS reason_building,
  CASE WHEN {k} % 27 = 0 THEN '02' END AS reason_contents,
  l.l_returnflag AS rated_flood_zone, l.l_linestatus AS flood_zone_current,
  CAST(l.l_linenumber AS INT) AS occupancy_type,
  l.l_quantity < 25 AS pre_firm_indicator, l.l_quantity >= 25 AS post_firm_indicator,
  CAST(round(l.l_discount * 100) AS INT) AS crs_class_code,
  CAST(l.l_quantity * 1000 AS BIGINT) AS building_coverage, CAST(l.l_quantity * 400 AS BIGINT) AS contents_coverage,
  CASE WHEN {k} % 17 = 0 THEN '' ELSE '4' || lpad({d.text(f'{p} % 9999')}, 4, '0') END AS reported_zip_code,
  {day} AS open_date,
  CASE WHEN {unpaid} THEN NULL ELSE {d.plus_days(day, f'{k} % 120')} END AS most_recent_payment_date
FROM {d.table('lineitem')} l"""


def policies(d: Dialect) -> str:
    k = "o.o_orderkey"
    begin = "CAST(o.o_orderdate AS DATE)"
    term = f"CASE WHEN {k} % 29 = 0 THEN 0 WHEN {k} % 31 = 0 THEN -5 ELSE 30 * (1 + {k} % 14) END"
    return f"""
SELECT {d.text(k)} AS policy_id, 'MI' AS state_code,
  CASE WHEN {k} % 23 = 0 THEN NULL WHEN {k} % 37 = 0 THEN '' ELSE '26' || {d.county3('o.o_custkey % 12')} || '000200' END AS census_geoid,
  CASE WHEN {k} % 17 = 0 THEN '' ELSE '48001' END AS reported_zip_code,
  CAST(CASE WHEN {k} % 10 = 0 THEN 3 ELSE 1 END AS INT) AS policy_count,
  {begin} AS effective_date, {d.plus_days(begin, term)} AS termination_date, DATE '2001-06-30' AS as_of_date,
  CAST(o.o_totalprice AS DECIMAL(12,2)) AS policy_cost, CAST({k} % 900 AS BIGINT) AS premium,
  CAST({k} % 77 AS BIGINT) * 1000 AS building_coverage, CAST({k} % 55 AS BIGINT) * 500 AS contents_coverage
FROM {d.table('orders')} o"""


def declarations(d: Dialect) -> str:
    # One area per brand and size: disasters do not multiply as claims do.
    k = "p.k"
    n = f"CAST({d.floor_div(k, '5')} AS INT)"
    begin = d.plus_days("DATE '1995-01-01'", f"({n} * 37) % 2400")
    place = f"CASE WHEN {k} % 3 = 0 THEN 22 ELSE {k} % 25 END"
    return f"""
SELECT {d.text(k)} AS area_id, {n} AS disaster_number,
  'DR-' || {d.text(n)} AS declaration_string,
  {d.pick(f'{n} % 3', ['DR', 'EM', 'FM'])} AS declaration_type,
  {d.plus_days(begin, '10')} AS declaration_date,
  {d.pick(f'{n} % 5', ['Flood', 'Severe Storm', 'Dam/Levee Break', 'Biological', 'Fire'])} AS incident_type,
  p.title AS declaration_title,
  {n} % 2 = 0 AS ia_program_declared, {n} % 4 = 0 AS pa_program_declared,
  {begin} AS incident_begin_date,
  CASE WHEN {k} % 19 = 0 THEN NULL WHEN {k} % 23 = 0 THEN {d.plus_days(begin, '-3')}
       ELSE {d.plus_days(begin, f'5 + {k} % 30')} END AS incident_end_date,
  {d.fips(place)} AS fips_state_code,
  CASE WHEN {k} % 7 = 0 THEN '000' ELSE {d.county3(f'{k} % 12')} END AS fips_county_code,
  {d.state(place)} AS state_code
FROM (SELECT CAST(replace(p_brand, 'Brand#', '') AS INT) * 50 + p_size AS k, min(p_name) AS title
      FROM {d.table('part')} GROUP BY 1) p"""


def lending(d: Dialect) -> str:
    k, p, s = "(l.l_orderkey * 7 + l.l_linenumber)", "l.l_partkey", "l.l_suppkey"
    place = f"CASE WHEN {p} % 3 = 0 THEN 22 ELSE {s} % 25 END"
    amounts = []
    for i, name in enumerate(EXEMPTIBLE_AMOUNTS):
        number = f"'.45'" if name == "interest_rate" else d.text(f"{k} % {30 + i}")
        amounts.append(f"CASE WHEN {k} % 47 = 3 THEN 'Exempt' WHEN {k} % {11 + i} = 0 THEN 'NA' "
                       f"ELSE {number} END AS {name}")
    codes = {
        "action_taken": d.text(f"1 + {k} % 8"),
        "loan_purpose": d.pick(f"{k} % 6", ["1", "2", "31", "32", "4", "77"]),
        "loan_type": d.text(f"1 + {k} % 4"),
        "lien_status": d.text(f"1 + {k} % 2"),
        "occupancy_type": d.text(f"1 + {k} % 3"),
        "construction_method": d.text(f"1 + {p} % 2"),
        "preapproval": d.text(f"1 + {p} % 2"),
        "hoepa_status": d.text(f"1 + {p} % 3"),
        "purchaser_type": d.pick(f"{p} % 4", ["0", "1", "71", "6"]),
        "conforming_loan_limit": d.pick(f"{p} % 4", ["C", "NC", "NA", "U"]),
        "business_or_commercial_purpose": d.pick(f"{k} % 9", ["1111"] + ["1", "2"] * 4),
        "reverse_mortgage": "'2'",
        "open_end_line_of_credit": "'2'",
        "submission_of_application": d.text(f"1 + {k} % 3"),
        "initially_payable_to_institution": d.text(f"1 + {k} % 3"),
        "applicant_sex": d.text(f"1 + {k} % 3"),
        "co_applicant_sex": "'5'",
        "applicant_ethnicity_1": d.pick(f"{s} % 3", ["1", "11", "2"]),
        "co_applicant_ethnicity_1": "'5'",
        "applicant_race_1": d.pick(f"{s} % 4", ["2", "21", "3", "5"]),
        "co_applicant_race_1": "'8'",
        "denial_reason_1": f"CASE WHEN {k} % 8 = 2 THEN {d.text(f'1 + {p} % 9')} ELSE '10' END",
        "denial_reason_2": f"CASE WHEN {k} % 16 = 2 THEN {d.text(f'1 + {p} % 4')} END",
        "denial_reason_3": "CAST(NULL AS STRING)",
        "denial_reason_4": "CAST(NULL AS STRING)",
    }
    coded = ",\n  ".join(f"{expression} AS {name}" for name, expression in codes.items())
    return f"""
SELECT substr({d.text('CAST(l.l_shipdate AS DATE)')}, 1, 4) AS activity_year,
  'LEI' || lpad({d.text(s)}, 8, '0') AS lei,
  {d.state(place)} AS state_code,
  CASE WHEN {k} % 31 = 0 THEN 'NA' ELSE {d.fips(place)} || {d.county3(f'{p} % 12')} END AS county_code,
  CASE WHEN {k} % 31 = 0 OR {k} % 37 = 0 THEN 'NA' ELSE {d.fips(place)} || {d.county3(f'{p} % 12')} || '000100' END AS census_tract,
  CASE WHEN {k} % 43 = 0 THEN '1.5065E7' ELSE {d.text('CAST(l.l_extendedprice AS DECIMAL(12,2))')} END AS loan_amount,
  CASE WHEN {k} % 19 = 0 THEN 'NA' ELSE {d.text('CAST(l.l_quantity * 3 AS INT)')} END AS income,
  CASE WHEN {p} % 41 = 0 THEN NULL ELSE {d.text(f'60000 + 1000 * ({p} % 30)')} END AS ffiec_msa_md_median_family_income,
  {d.pick(f'{k} % 5', ['20%-<30%', '36', 'NA', 'Exempt', '>60%'])} AS debt_to_income_ratio,
  {d.pick(f'{k} % 4', ['25-34', '8888', '>74', '9999'])} AS applicant_age,
  {d.pick(f'{k} % 3', ['35-44', '9999', '45-54'])} AS co_applicant_age,
  {d.pick(f'{k} % 4', ['1', '2', '5-24', '>149'])} AS total_units,
  {coded},
  {', '.join(amounts)}
FROM {d.table('lineitem')} l"""


def institutions(d: Dialect) -> str:
    s, y = "i.l_suppkey", "i.y"
    number = f"CASE WHEN {s} % 10 = 9 THEN {s} - 1 ELSE {s} END"
    return f"""
SELECT 'LEI' || lpad({d.text(s)}, 8, '0') AS lei,
  CASE WHEN {s} % 50 = 7 THEN '***' ELSE 'Lender ' || {d.text(number)} || {d.pick(f'{y} % 3', [', Inc.', ' LLC', ' Bank, N.A.'])} END AS name,
  {d.text('i.n')} AS filings, {d.text(y)} AS period
FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS y, count(*) AS n
      FROM {d.table('lineitem')} GROUP BY l_suppkey, CAST(year(l_shipdate) AS INT)) i"""


QUESTIONS = ["Q30", "Q31", "Q42", "Q36", "Q40", "Q12", "Q18", "Q27", "Q22", "Q99"]


def indicators(d: Dialect) -> str:
    k, c = "o_orderkey", "o_custkey"
    years = "CAST(year(o_orderdate) AS INT) + 20"
    place = (f"CASE WHEN {c} % 3 = 0 THEN 'MI' WHEN {c} % 3 = 1 THEN 'US' WHEN {c} % 50 = 2 THEN 'MDW' "
             f"WHEN {c} % 50 = 5 THEN 'PR' WHEN {c} % 50 = 8 THEN 'ZZ' ELSE {d.state(f'{c} % 25')} END")
    topic = "CASE WHEN g.q IN ('Q30','Q31','Q42') THEN 'Cognitive Decline' WHEN g.q IN ('Q36','Q40') THEN 'Caregiving' WHEN g.q IN ('Q27') THEN 'Mental Health' ELSE 'Screenings and Vaccines' END"
    # The same questions, ages and places have a cell in every cycle, so series are long.
    mean = d.floor_div("g.s * 1000", "g.n * 997")
    return f"""
SELECT g.y AS yearstart, CASE WHEN g.span = 1 THEN '2022' ELSE g.y END AS yearend, g.place AS locationabbr,
  'Place ' || g.place AS locationdesc, {topic} AS class, 'C' || substr(g.q, 2, 1) AS classid, {topic} AS topic,
  'Question ' || g.q AS question, g.q AS questionid, '%' AS data_value_unit, 'Percentage' AS data_value_type,
  CASE WHEN g.n % 11 = 0 THEN ' ' ELSE {d.tenths(mean)} END AS data_value,
  CASE WHEN g.place = 'US' AND g.y = '2017' THEN '#' WHEN g.place = 'MDW' THEN '&' WHEN {topic} = 'Caregiving' AND g.y = '2019' THEN '**' WHEN g.n % 11 = 0 THEN '****' END AS footnote,
  CASE WHEN g.n % 11 = 0 OR g.n % 13 = 0 THEN '' ELSE {d.tenths(f'({mean} - CASE WHEN {mean} < 30 THEN {mean} ELSE 30 END)')} END AS low,
  CASE WHEN g.n % 11 = 0 OR g.n % 13 = 0 THEN '' ELSE {d.tenths(f'({mean} + 30)')} END AS high,
  g.age AS stratification1, g.category2 AS stratificationcategory2, g.value2 AS stratification2
FROM (
  SELECT {d.text(years)} AS y,
    CASE WHEN {k} % 9 = 0 AND {years} IN (2019, 2021) THEN 1 ELSE 0 END AS span,
    {place} AS place,
    {d.pick(f'{k} % 10', QUESTIONS)} AS q,
    {d.pick(f'{k} % 3', ['50-64 years', '65 years or older', 'Overall'])} AS age,
    {d.pick(f'{c} % 4', [None, None, 'Sex', 'None'])} AS category2,
    {d.pick(f'{c} % 4', [None, None, 'Male', None])} AS value2,
    count(*) AS n, sum({k} % 997) AS s
  FROM {d.table('orders')} GROUP BY 1, 2, 3, 4, 5, 6, 7) g"""


# Measure columns of the derived geography file: name, divisor applied to a base amount, and
# whether the figure is written as a whole number.
MEASURES = {
    "TOT_MDCR_STDZD_PYMT_PC": 3, "TOT_MDCR_PYMT_AMT": 1, "IP_MDCR_STDZD_PYMT_PC": 5,
    "SNF_MDCR_STDZD_PYMT_PC": 7, "SNF_MDCR_PYMT_PCT": 11, "HH_MDCR_STDZD_PYMT_PU": 13,
    "HH_MDCR_STDZD_PYMT_PER_USER": 17, "BENES_SNF_CNT": 19, "BENES_SNF_PCT": 23,
    "IP_CVRD_STAYS_PER_1000_BENES": 29, "IP_CVRD_DAYS_PER_1000_BENES": 31,
    "BENES_IP_CVRD_STAY_CNT": 37, "BENES_ER_VISITS_CNT": 41, "ER_VISITS_PER_1000_BENES": 43,
    "PTB_OTHR_SRVCS_MDCR_PYMT": 47, "HH_EPISODES_PER_1000_BENES": 53,
}
ENROLMENT = {"BENES_TOTAL_CNT": 1, "BENES_WTH_PTAPTB_CNT": 2, "BENES_OM_CNT": 3, "BENES_MA_CNT": 4,
             "MA_PRTCPTN_RATE": 59, "BENE_AVG_AGE": 61, "BENE_DUAL_PCT": 67,
             "PQI03_DBTS_AGE_LT_65": 71, "PQI08_CHF_AGE_GE_75": 73}


def medicare(d: Dialect) -> str:
    p, s = "l_partkey", "l_suppkey"
    place = f"CASE WHEN {p} % 3 = 0 THEN 22 ELSE {s} % 25 END"
    columns = []
    for i, (name, divisor) in enumerate({**ENROLMENT, **MEASURES}.items()):
        value = d.tenths(d.floor_div("a.v", str(divisor)))
        zero = f"WHEN a.v % {19 + i} = 1 THEN '0' "
        columns.append(f"CASE WHEN a.v % {23 + i} = 2 THEN NULL WHEN a.n % {3 + i % 5} = 1 THEN '*' {zero}ELSE {value} END AS {name}")
    return f"""
SELECT a.y AS YEAR, a.lvl AS BENE_GEO_LVL, a.cd AS BENE_GEO_CD, a.descr AS BENE_GEO_DESC, a.age AS BENE_AGE_LVL,
  {', '.join(columns)}
FROM (
  SELECT b.y, b.age, CAST(sum(b.n) AS BIGINT) AS n, CAST(sum(b.v) AS BIGINT) AS v,
    CASE grouping(b.st) + grouping(b.cty) WHEN 2 THEN 'National' WHEN 1 THEN 'State' ELSE 'County' END AS lvl,
    CASE WHEN grouping(b.st) = 1 THEN NULL WHEN grouping(b.cty) = 0 THEN b.fips || b.cty
         WHEN b.st = 'MO' THEN NULL ELSE b.fips END AS cd,
    CASE WHEN grouping(b.st) = 1 THEN 'National' WHEN grouping(b.cty) = 1 THEN b.st ELSE b.st || '-' || b.cty END AS descr
  FROM (
    SELECT {d.text('CAST(year(l_shipdate) AS INT)')} AS y, {d.state(place)} AS st, {d.fips(place)} AS fips,
      CASE WHEN {p} % 13 = 0 THEN '000' ELSE {d.county3(f'{p} % 12')} END AS cty,
      {d.pick('l_orderkey % 3', ['All', '<65', '>=65'])} AS age,
      count(*) AS n, sum(CAST(l_quantity AS BIGINT) * 17 + l_orderkey % 101) AS v
    FROM {d.table('lineitem')} GROUP BY 1, 2, 3, 4, 5) b
  GROUP BY GROUPING SETS ((b.y, b.age), (b.y, b.age, b.st, b.fips), (b.y, b.age, b.st, b.fips, b.cty))) a
WHERE a.lvl <> 'County' OR a.age = 'All'"""


def _county_counts(d: Dialect, vintage: str) -> str:
    return f"""SELECT {vintage} AS v, o_custkey % 25 AS st, o_custkey % 12 AS cty, count(*) AS n, sum(o_orderkey % 89) AS s
      FROM {d.table('orders')} GROUP BY 1, 2, 3"""


def _places(d: Dialect, inner: str, figures: dict[str, tuple[str, str]]) -> str:
    """Nation, state and county rows of one set of county counts."""
    estimates = ", ".join(
        f"{estimate} AS {code}E, {margin} AS {code}M" for code, (estimate, margin) in figures.items())
    return f"""
SELECT v AS vintage, lvl AS geo_level, st AS state, cty AS county,
  'Place ' || coalesce(st, 'US') || coalesce(cty || ', State', '') AS name, {estimates}
FROM (
  SELECT c.v, CASE grouping(c.st) + grouping(c.cty) WHEN 2 THEN 'us' WHEN 1 THEN 'state' ELSE 'county' END AS lvl,
    CASE WHEN grouping(c.st) = 0 THEN {d.fips('c.st')} END AS st,
    CASE WHEN grouping(c.cty) = 0 THEN {d.county3('c.cty')} END AS cty,
    CAST(sum(c.n) AS BIGINT) AS n, CAST(sum(c.s) AS BIGINT) AS s
  FROM ({inner}) c GROUP BY GROUPING SETS ((c.v), (c.v, c.st), (c.v, c.st, c.cty))) x"""


def population(d: Dialect) -> str:
    # Vintages cover 1996 to 2000, so the first and last fact years are extrapolated.
    year = "CAST(year(o_orderdate) AS INT)"
    vintage = d.text(f"CASE WHEN {year} < 1996 THEN 1996 WHEN {year} > 2000 THEN 2000 ELSE {year} END")
    people = f"CASE WHEN n % 41 = 0 THEN NULL ELSE {d.text('n * 1000 + s')} END"
    margin = f"CASE WHEN n % 5 = 0 THEN '-555555555' ELSE {d.text('s % 50')} END"
    return _places(d, _county_counts(d, vintage), {
        "B01003_001": (people, margin), "B25001_001": (d.text("n * 400"), d.text("s % 20"))})


def population_65(d: Dialect) -> str:
    year = "CAST(year(o_orderdate) AS INT)"
    vintage = d.pick(f"{year} - 1995", ["2012", "2017", "2018", "2019", "2021", "2023", "2024"])
    margin = f"CASE WHEN n % 5 = 0 THEN '-555555555' ELSE {d.text('s % 50')} END"
    return _places(d, _county_counts(d, vintage), {"S0101_C01_030": (d.text("n * 100 + s"), margin)})


def prices(d: Dialect) -> str:
    year, month = "CAST(year(o_orderdate) AS INT)", "CAST(month(o_orderdate) AS INT)"
    value = "(1500 + (x.y - 1990) * 40 + x.n % 30)"
    orders = d.table("orders")
    monthly = f"'M' || lpad({d.text(month)}, 2, '0')"
    half = f"CASE WHEN {month} < 7 THEN 'S01' ELSE 'S02' END"
    return f"""
SELECT x.series || '      ' AS series_id, {d.text('x.y')} AS year, x.period,
  CASE WHEN x.period = 'M07' AND x.y = 1998 THEN '           -' ELSE lpad({d.tenths(value)}, 12, ' ') END AS value,
  CASE WHEN x.period = 'M07' AND x.y = 1998 THEN 'X' ELSE '  ' END AS footnote_codes
FROM (
  SELECT 'CUUR0000SA0' AS series, {year} AS y, {monthly} AS period, count(*) AS n FROM {orders} GROUP BY 1, 2, 3
  UNION ALL SELECT 'CUSR0000SA0', {year}, {monthly}, count(*) FROM {orders} GROUP BY 1, 2, 3
  UNION ALL SELECT 'CUUR0000SA0', {year}, 'M13', count(*) FROM {orders} WHERE {year} > 1995 GROUP BY 1, 2, 3
  UNION ALL SELECT 'CUUR0000AA0', {year}, {half}, count(*) FROM {orders} GROUP BY 1, 2, 3) x"""


def price_series(d: Dialect) -> str:
    return f"""
SELECT 'CU' || CASE WHEN z.k % 2 = 0 THEN 'U' ELSE 'S' END || 'R' || lpad({d.text('z.k')}, 4, '0') || '   ' AS series_id,
  lpad({d.text('z.k')}, 4, '0') || ' ' AS area_code, 'SA0 ' AS item_code, 'R' AS periodicity_code, 'S' AS base_code,
  ' 1982-84=100' AS base_period, z.brand || ' items ' AS series_title,
  CASE WHEN z.k % 3 = 0 THEN '  ' ELSE 'A ' END AS footnote_codes,
  {d.text('1913 + z.k')} AS begin_year, 'M01' AS begin_period, {d.text('1990 + z.k')} AS end_year, 'M13 ' AS end_period,
  CASE WHEN z.k % 2 = 0 THEN 'U' ELSE 'S' END AS seasonal
FROM (SELECT p_brand AS brand, CAST(min(p_partkey) AS INT) AS k FROM {d.table('part')} GROUP BY p_brand) z"""


def crosswalk(d: Dialect) -> str:
    bucket = "c_custkey % 400"

    def ratio(part: str) -> str:
        share = d.floor_div(f"{part} * 1000000000", "t.n")
        return f"CASE WHEN {part} = t.n THEN '1.0' ELSE '0.' || lpad({d.text(share)}, 9, '0') END"

    return f"""
SELECT lpad({d.text('10000 + p.b * 7')}, 5, '0') AS zip,
  CASE WHEN p.st = 24 AND p.b % 7 = 0 THEN {d.fips('p.st')} ELSE {d.fips('p.st')} || {d.county3('p.cty')} END AS geoid,
  'CITY ' || {d.text('p.b')} AS city, {d.state('p.st')} AS state,
  CASE WHEN p.b % 20 = 0 THEN '0' ELSE {ratio('p.n')} END AS res_ratio,
  {ratio('p.n')} AS bus_ratio, '0.5' AS oth_ratio, {ratio('p.n')} AS tot_ratio
FROM (SELECT {bucket} AS b, c_custkey % 25 AS st, c_custkey % 12 AS cty, count(*) AS n FROM {d.table('customer')} GROUP BY 1, 2, 3) p
JOIN (SELECT {bucket} AS b, count(*) AS n FROM {d.table('customer')} GROUP BY 1) t ON t.b = p.b"""
