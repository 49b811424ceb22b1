"""Registered queries for single operators, over the test tables and the derived ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import typed
from plumbline.functions.dates import period_id, year_month
from plumbline.functions.flags import is_small, percent, tally
from plumbline.functions.text import normalize_company_name, row_text
from plumbline.operators import generators
from plumbline.operators.aggregates import coverage_lists, distinct_keys, exact_median, profile
from plumbline.operators.joins import constant_dollars, event_totals, price_index, with_totals
from plumbline.operators.reshape import union_all, union_distinct
from plumbline.operators.sampling import (
    Stratum,
    sample_per_group,
    slice_and_sample,
    stratified_sample,
    stratum_counts,
)
from plumbline.operators.windows import top_per_group, with_prior
from plumbline.plans.conformed import date_dimension, period_dimension, state_dimension
from plumbline.sources.readers import file_inventory
from plumbline.testbed.frames import Testbed
from plumbline.testbed.queries import entry, rounded

_RATE = "CASE WHEN closed > 0 THEN round(100.0::DOUBLE * {part} / closed, 6) END"


@entry("monthly_outcomes_by_segment", f"""
SELECT month, period_id, n_name, o_orderpriority, orders, closed, pending, filled, {_RATE.format(part='filled')} AS filled_pct,
  orders < 10 AS is_small_cell
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, 'month:' || strftime(o_orderdate, '%Y-%m') AS period_id, n_name, o_orderpriority,
        count(*) AS orders, count(*) FILTER (o_orderstatus <> 'P') AS closed, count(*) FILTER (o_orderstatus = 'P') AS pending,
        count(*) FILTER (o_orderstatus = 'F') AS filled
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)""")
def monthly_outcomes_by_segment(t: Testbed) -> DataFrame:
    # Counting per customer first turns a customer with a third of the orders into one row
    # per month and segment before anything is joined.
    month, status = year_month(F.col("o_orderdate").cast("date")), F.col("o_orderstatus")
    per_customer = t.table("orders").groupBy(month.alias("month"), "o_custkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), tally(status == "P").alias("p"), tally(status == "F").alias("f"))
    people = t.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    cells = (
        per_customer.join(people, "o_custkey").groupBy("month", "n_nationkey", "o_orderpriority")
        .agg(F.sum("n").alias("orders"), F.sum("p").alias("pending"), F.sum("f").alias("filled"))
        .join(t.table("nation").select("n_nationkey", "n_name"), "n_nationkey"))
    closed = F.col("orders") - F.col("pending")
    return cells.select(
        "month", period_id("month", F.col("month")).alias("period_id"), "n_name", "o_orderpriority", "orders",
        closed.alias("closed"), "pending", "filled",
        F.round(percent(F.col("filled"), closed), 6).alias("filled_pct"), is_small(F.col("orders")).alias("is_small_cell"))


@entry("calendar_activity", """
SELECT d AS date_day, strftime(d, '%Y%m%d')::INT AS date_key, year(d)::SMALLINT AS calendar_year, quarter(d)::TINYINT AS calendar_quarter,
  month(d)::TINYINT AS calendar_month, monthname(d) AS month_name, strftime(d, '%Y-%m') AS year_month, concat(year(d), '-Q', quarter(d)) AS year_quarter,
  date_trunc('month', d)::DATE AS month_start, last_day(d) AS month_end, date_trunc('quarter', d)::DATE AS quarter_start,
  date_trunc('year', d)::DATE AS year_start, dayofyear(d)::SMALLINT AS day_of_year, isodow(d)::TINYINT AS iso_day_of_week, dayname(d) AS day_name,
  weekofyear(d)::TINYINT AS iso_week, isodow(d) > 5 AS is_weekend, d = last_day(d) AS is_month_end, n AS orders
FROM (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY ALL)""")
def calendar_activity(t: Testbed) -> DataFrame:
    daily = t.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date_day")).agg(
        F.count(F.lit(1)).alias("orders"))
    return date_dimension(t.spark).join(daily, "date_day")


@entry("period_activity", """
SELECT p.*, o.n AS orders FROM periods p JOIN (
  SELECT 'month:' || strftime(o_orderdate, '%Y-%m') AS period_id, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'year:' || year(o_orderdate), count(*) FROM orders GROUP BY ALL
  UNION ALL SELECT 'survey_cycle:' || (year(o_orderdate) + 20), count(*) FROM orders GROUP BY ALL) o USING (period_id)""")
def period_activity(t: Testbed) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    monthly = t.table("orders").groupBy(F.trunc(day, "MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    keys = F.array(
        period_id("month", year_month(F.col("m"))), period_id("year", F.year("m")),
        period_id("survey_cycle", F.year("m") + 20))
    used = monthly.select(F.explode(keys).alias("period_id"), "n").groupBy("period_id").agg(F.sum("n").alias("orders"))
    return period_dimension(t.spark).join(used, "period_id")


@entry("state_activity", """
SELECT s.*, coalesce(n, 0) AS complaints FROM states s LEFT JOIN (SELECT state_code, count(*) AS n FROM complaints GROUP BY ALL) c USING (state_code)""")
def state_activity(t: Testbed) -> DataFrame:
    counts = t.complaints.where(F.col("state_code").isNotNull()).groupBy("state_code").agg(
        F.count(F.lit(1)).alias("complaints"))
    return state_dimension(t.spark, t.params).join(counts, "state_code", "left").withColumn(
        "complaints", F.coalesce("complaints", F.lit(0)))


@entry("month_end_spine", """
SELECT DISTINCT last_day(d) AS month_end FROM (SELECT unnest(generate_series((SELECT min(policy_effective_date) FROM policies),
  (SELECT max(as_of_date) FROM policies), INTERVAL 1 DAY))::DATE AS d) WHERE last_day(d) <= (SELECT max(as_of_date) FROM policies)""")
def month_end_spine(t: Testbed) -> DataFrame:
    bounds = t.policies.agg(F.min("policy_effective_date").alias("a"), F.max("as_of_date").alias("z"))
    return generators.month_ends_between(bounds, "a", "z")


@entry("median_by_status", """
SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median_price FROM lineitem GROUP BY ALL""")
def median_by_status(t: Testbed) -> DataFrame:
    return exact_median(t.table("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "median_price")


@entry("median_of_close_values", """
SELECT l_returnflag, median(1 + l_extendedprice::DOUBLE / 1e9) AS median_factor FROM lineitem GROUP BY l_returnflag""")
def median_of_close_values(t: Testbed) -> DataFrame:
    """Every distinct price lies in one magnitude bin, which is divided until a part holds 64 values at most."""
    factors = t.table("lineitem").select("l_returnflag", (1 + F.col("l_extendedprice").cast("double") / 1e9).alias("factor"))
    return exact_median(factors, ["l_returnflag"], "factor", "median_factor", ordered=64)


@entry("restated_amounts", """
SELECT loss_year, claims, round(paid, 2) AS paid, round(paid * base / i, 4) AS paid_constant FROM (
  SELECT year_of_loss AS loss_year, count(*) AS claims, sum(total_amount_paid)::DOUBLE AS paid FROM claims GROUP BY ALL) LEFT JOIN deflator ON y = loss_year""")
def restated_amounts(t: Testbed) -> DataFrame:
    yearly = t.claims.groupBy(F.col("year_of_loss").alias("loss_year")).agg(
        F.count(F.lit(1)).alias("claims"), F.sum("total_amount_paid").cast("double").alias("paid"))
    priced = constant_dollars(yearly, price_index(t.prices), "loss_year", {"paid_constant": F.col("paid")},
                              t.params.deflator_base_year)
    return rounded(rounded(priced, ["paid"], 2), ["paid_constant"], 4)


@entry("composite_key_lookup", """
SELECT l.lei, l.activity_year, institution_name, filings_reported, n AS applications FROM (SELECT lei, activity_year, count(*) AS n FROM lending GROUP BY ALL) l
LEFT JOIN institutions i ON i.lei = l.lei AND i.activity_year = l.activity_year""")
def composite_key_lookup(t: Testbed) -> DataFrame:
    counts = t.lending.groupBy("lei", "activity_year").agg(F.count(F.lit(1)).alias("applications"))
    names = t.institutions.select("lei", "activity_year", "institution_name", "filings_reported")
    return counts.join(names, ["lei", "activity_year"], "left")


KEYWORDS = ("red", "ring", "bolt")


@entry("described_events", f"""
SELECT DISTINCT disaster_number, incident_type, declaration_title, incident_begin_date FROM declarations
WHERE state_code = 'MI' AND incident_begin_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
  AND ({' OR '.join(f"contains(lower(declaration_title), '{k}') OR contains(lower(incident_type), '{k}')" for k in KEYWORDS)})""")
def described_events(t: Testbed) -> DataFrame:
    named = F.lit(False)
    for keyword in KEYWORDS:
        for column in ("declaration_title", "incident_type"):
            named = named | F.lower(column).contains(keyword)
    begin = F.col("incident_begin_date")
    return t.declarations.where(
        (F.col("state_code") == t.params.focus_state) & begin.between("1996-01-01", "2000-12-31") & named
    ).select("disaster_number", "incident_type", "declaration_title", "incident_begin_date").distinct()


@entry("membership_filters", """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%' OR c_name LIKE '%\\_1' ESCAPE '\\')
  AND (o_orderpriority, o_orderstatus) NOT IN (SELECT o_orderpriority, min(o_orderstatus) FROM orders GROUP BY ALL)
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  AND o_totalprice NOT BETWEEN 1000 AND 20000 AND o_orderstatus IS DISTINCT FROM 'O'
  AND o_orderdate < (SELECT max(l_shipdate) FROM lineitem) AND regexp_matches(o_orderpriority, '^[1-3]-')""")
def membership_filters(t: Testbed) -> DataFrame:
    orders, lines = t.table("orders"), t.table("lineitem")
    buyers = t.table("customer").where(
        F.col("c_mktsegment").like("B%") | F.col("c_name").like("%\\_1")).select(F.col("c_custkey").alias("o_custkey"))
    least = orders.groupBy("o_orderpriority").agg(F.min("o_orderstatus").alias("o_orderstatus"))
    returned = lines.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    newest = lines.agg(F.max("l_shipdate").alias("_newest"))
    kept = orders.where(
        ~F.col("o_totalprice").between(1000, 20000) & ~F.col("o_orderstatus").eqNullSafe("O")
        & F.col("o_orderpriority").rlike("^[1-3]-"))
    return (
        with_totals(kept, newest).where(F.col("o_orderdate") < F.col("_newest"))
        .join(buyers, "o_custkey", "left_semi")
        .join(least, ["o_orderpriority", "o_orderstatus"], "left_anti")
        .join(returned, "o_orderkey", "left_anti")
        .select("o_orderkey", "o_custkey", "o_orderpriority"))


@entry("pivoted_outcomes", """
SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS avg_f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS avg_o,
  round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS avg_p FROM orders GROUP BY ALL""")
def pivoted_outcomes(t: Testbed) -> DataFrame:
    wide = t.table("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return rounded(wide.toDF("o_orderpriority", "avg_f", "avg_o", "avg_p"), ["avg_f", "avg_o", "avg_p"], 4)


@entry("distinct_and_having", """
SELECT l_suppkey, count(DISTINCT (l_partkey, l_returnflag)) AS part_states, bool_or(l_discount > 0.09) AS any_discounted, bool_and(l_quantity > 0) AS all_positive,
  any_value(l_linestatus) FILTER (l_linestatus = 'F') AS f_status, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS latest_order
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10""")
def distinct_and_having(t: Testbed) -> DataFrame:
    lines = t.table("lineitem")
    closed = F.when(F.col("l_linestatus") == "F", F.col("l_linestatus"))
    return lines.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("_n"), distinct_keys(lines, ["l_partkey", "l_returnflag"]).alias("part_states"),
        F.bool_or(F.col("l_discount") > 0.09).alias("any_discounted"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"),
        F.any_value(closed, True).alias("f_status"),
        F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("latest_order"),
    ).where(F.col("_n") > 10).drop("_n")


@entry("coverage_lists", """
SELECT 'l_returnflag' AS field, l_returnflag AS value FROM lineitem UNION SELECT 'l_linestatus', l_linestatus FROM lineitem
UNION SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem""")
def coverage(t: Testbed) -> DataFrame:
    return coverage_lists(t.table("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@entry("partition_profile", """
SELECT l_returnflag || l_linestatus AS partition_key, count(*) AS row_count, sum(l_extendedprice::DECIMAL(20,2))::DECIMAL(38,2) AS l_extendedprice,
  sum(l_quantity::DECIMAL(20,2))::DECIMAL(38,2) AS l_quantity FROM lineitem GROUP BY ALL""")
def partition_profile(t: Testbed) -> DataFrame:
    return profile(t.table("lineitem"), F.concat("l_returnflag", "l_linestatus"), ["l_extendedprice", "l_quantity"])


@entry("yearly_change", """
SELECT n_nationkey, y, orders, lag(orders) OVER (PARTITION BY n_nationkey ORDER BY y) AS prior_orders FROM (
  SELECT c_nationkey AS n_nationkey, year(o_orderdate)::INT AS y, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)""")
def yearly_change(t: Testbed) -> DataFrame:
    per_customer = t.table("orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    people = t.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    yearly = per_customer.join(people, "o_custkey").groupBy("n_nationkey", "y").agg(F.sum("n").alias("orders"))
    return with_prior(yearly, ["n_nationkey"], [F.col("y")], {"orders": "prior_orders"})


@entry("top_orders_per_customer", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def top_orders_per_customer(t: Testbed) -> DataFrame:
    orders = t.table("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_group(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@entry("roster_difference", """
SELECT coalesce(a.k, b.k) AS county_fips, a.k IS NOT NULL AS in_claims, b.k IS NOT NULL AS in_policies
FROM (SELECT DISTINCT county_fips AS k FROM claims WHERE county_fips IS NOT NULL) a
FULL JOIN (SELECT DISTINCT county_fips AS k FROM policies WHERE county_fips IS NOT NULL) b ON a.k = b.k""")
def roster_difference(t: Testbed) -> DataFrame:
    def keys(df: DataFrame, flag: str) -> DataFrame:
        return df.where(F.col("county_fips").isNotNull()).select("county_fips", F.lit(flag).alias("s")).distinct()

    both = union_all([keys(t.claims, "c"), keys(t.policies, "p")])
    return both.groupBy("county_fips").agg(
        F.bool_or(F.col("s") == "c").alias("in_claims"), F.bool_or(F.col("s") == "p").alias("in_policies"))


@entry("key_universe", """
SELECT c_nationkey AS nation_key FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation""")
def key_universe(t: Testbed) -> DataFrame:
    return union_distinct([
        t.table(name).select(F.col(column).alias("nation_key"))
        for name, column in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))])


@entry("json_props_typed", """
SELECT event_id, event_type, (props ->> '$.k')::INT AS k, props ->> '$.k' AS k_text, ts::DATE AS event_day FROM events""")
def json_props_typed(t: Testbed) -> DataFrame:
    doc = F.from_json("props", "k string")
    return t.table("events").select(
        "event_id", "event_type", typed.as_whole(doc["k"]).cast("int").alias("k"),
        F.get_json_object("props", "$.k").alias("k_text"), F.col("ts").cast("date").alias("event_day"))




@entry("text_functions", """
SELECT doc_id, length(text)::INT AS n_characters, lower(lang) AS lang, split_part(source, '_', 1) AS source_head, right(lang, 1) AS lang_tail,
  length(regexp_replace(text, '[^0-9]', '', 'g'))::INT AS n_digits, nullif(trim(substr(text, 1, 1)), '') AS first_character,
  regexp_matches(text, '[0-9]{3}') AS has_long_number, regexp_extract(text, '([A-Z][a-z]+)', 1) AS first_name, coalesce(nullif(lang, 'en'), 'english') AS lang_label
FROM documents""")
def text_functions(t: Testbed) -> DataFrame:
    text, lang = F.col("text"), F.col("lang")
    return t.table("documents").select(
        "doc_id", F.length(text).alias("n_characters"), F.lower(lang).alias("lang"),
        F.split_part("source", F.lit("_"), F.lit(1)).alias("source_head"), F.right(lang, F.lit(1)).alias("lang_tail"),
        F.length(F.regexp_replace(text, "[^0-9]", "")).alias("n_digits"),
        F.nullif(F.trim(F.substring(text, 1, 1)), F.lit("")).alias("first_character"),
        text.rlike("[0-9]{3}").alias("has_long_number"), F.regexp_extract(text, "([A-Z][a-z]+)", 1).alias("first_name"),
        F.coalesce(F.nullif(lang, F.lit("en")), F.lit("english")).alias("lang_label"))


@entry("content_hashes", """
SELECT 'document' AS kind, doc_id AS id, md5(text) AS md5, sha256(text) AS sha256, strlen(text) AS bytes FROM documents
UNION ALL SELECT 'page', page_id, md5(html), sha256(html), strlen(html) FROM pages""")
def content_hashes(t: Testbed) -> DataFrame:
    def hashed(kind: str, table: str, key: str, column: str) -> DataFrame:
        content = F.col(column).cast("binary")
        return t.table(table).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), F.md5(content).alias("md5"),
            F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("bytes"))

    return union_all([hashed("document", "documents", "doc_id", "text"), hashed("page", "pages", "page_id", "html")])


@entry("file_inventory", None)
def landed_files(t: Testbed) -> DataFrame:
    return file_inventory(t.spark, f"{t.folder}/*.parquet")


@entry("normalized_names", f"""
SELECT company_name, normalized_name, count(*) AS n FROM (SELECT name AS company_name, institution_name_normalized AS normalized_name
  FROM raw_institutions r JOIN institutions i ON i.lei = r.lei AND i.activity_year = r.period) GROUP BY ALL""")
def normalized_names(t: Testbed) -> DataFrame:
    names = t.raw("institutions").groupBy(F.col("name").alias("company_name")).agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("normalized_name", normalize_company_name(F.col("company_name")))


# ── samples ──────────────────────────────────────────────────────────────────────────────
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
_LINE_MD5 = "md5(concat_ws('|', " + ", ".join(f"{c}::VARCHAR" for c in _LINE) + "))"


def _line_strata() -> list[Stratum]:
    return [Stratum("returned", F.col("l_returnflag") == "R", 40), Stratum("open", F.col("l_linestatus") == "O", 60),
            Stratum("first_lines", F.col("l_linenumber") == 1, 30), Stratum("spread", F.lit(True), 100)]


_STRATA_SQL = (("returned", "l_returnflag = 'R'", 40), ("open", "l_linestatus = 'O'", 60),
               ("first_lines", "l_linenumber = 1", 30), ("spread", "true", 100))


@entry("stratified_sample", " UNION ".join(
    f"(SELECT {', '.join(_LINE)} FROM lineitem WHERE {where} ORDER BY {_LINE_MD5} LIMIT {n})" for _, where, n in _STRATA_SQL))
def sampled_lines(t: Testbed) -> DataFrame:
    return stratified_sample(t.table("lineitem").select(*_LINE), _line_strata())


@entry("stratum_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS stratum, count(*) AS matching_rows, least(count(*), {n})::BIGINT AS sampled_rows, count(*) = 0 AS is_empty FROM lineitem WHERE {where}"
    for name, where, n in _STRATA_SQL))
def counted_strata(t: Testbed) -> DataFrame:
    return stratum_counts(t.table("lineitem"), _line_strata())


@entry("sample_per_year", """
SELECT lei, name, filings AS count, period FROM raw_institutions
QUALIFY row_number() OVER (PARTITION BY period ORDER BY md5(concat_ws('|', lei, name, filings, period))) <= 40""")
def sample_per_year(t: Testbed) -> DataFrame:
    return sample_per_group(t.raw("institutions"), ["period"], 40)


@entry("slice_and_sample", """
SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 22
UNION ALL (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey <> 22
  ORDER BY md5(concat_ws('|', c_custkey::VARCHAR, c_nationkey::VARCHAR, c_mktsegment)) LIMIT 40)""")
def whole_slice(t: Testbed) -> DataFrame:
    people = t.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return slice_and_sample(people, F.col("c_nationkey") == 22, 40)


@entry("row_texts", """
SELECT l_returnflag, count(*) AS n, min(concat_ws('|', l_orderkey::VARCHAR, l_linestatus)) AS first_text FROM lineitem GROUP BY ALL""")
def row_texts(t: Testbed) -> DataFrame:
    return t.table("lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.min(row_text(["l_orderkey", "l_linestatus"])).alias("first_text"))


_STORM = """SELECT l_orderkey, l_linenumber, 'MI' AS state_code, CASE WHEN l_suppkey % 11 <> 0 THEN '26' || lpad((l_suppkey % 12 * 2 + 1)::VARCHAR, 3, '0') END AS county_fips,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 5 < 2 THEN DATE '1997-04-01' + (l_linenumber * 3)::INT ELSE l_shipdate::DATE END AS loss FROM lineitem"""


@entry("storm_attribution", f"""
WITH claims_of AS ({_STORM}),
areas AS (SELECT p_partkey AS event, CASE WHEN p_partkey % 6 = 0 THEN '26000' ELSE '26' || lpad((p_partkey % 12 * 2 + 1)::VARCHAR, 3, '0') END AS county_fips,
  DATE '1995-01-01' + (p_partkey * 13 % 2500)::INT AS begins, DATE '1995-01-01' + (p_partkey * 13 % 2500 + p_size)::INT AS ends FROM part)
SELECT county_fips, is_statewide, count(*) AS matches, sum(days)::BIGINT AS days_in, count(DISTINCT event) AS events FROM (
  SELECT c.county_fips, a.county_fips = '26000' AS is_statewide, event, loss - begins AS days FROM claims_of c JOIN areas a
  ON loss BETWEEN begins AND ends AND (a.county_fips = '26000' OR a.county_fips = c.county_fips)) GROUP BY ALL""")
def storm_attribution(t: Testbed) -> DataFrame:
    """Events of every part against lines of which one storm month holds two in five."""
    def county(number):
        return F.concat(F.lit("26"), F.lpad((number % 12 * 2 + 1).cast("string"), 3, "0"))

    line = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    storm = F.date_add(F.lit("1997-04-01").cast("date"), (F.col("l_linenumber") * 3).cast("int"))
    losses = t.table("lineitem").select(
        F.lit("MI").alias("state_code"), F.when(F.col("l_suppkey") % 11 != 0, county(F.col("l_suppkey"))).alias("county_fips"),
        F.when(line % 5 < 2, storm).otherwise(F.col("l_shipdate").cast("date")).alias("loss"))
    first = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") * 13 % 2500).cast("int"))
    areas = t.table("part").select(
        F.lit("MI").alias("state_code"), F.when(F.col("p_partkey") % 6 == 0, "26000").otherwise(county(F.col("p_partkey"))).alias("county_fips"),
        F.col("p_partkey").alias("event"), first.alias("begins"), F.date_add(first, F.col("p_size").cast("int")).alias("ends"),
        (F.col("p_partkey") % 6 == 0).alias("is_statewide"))
    return event_totals(losses, areas, "loss", "begins", "ends", "state_code", "county_fips", "is_statewide", "event")
