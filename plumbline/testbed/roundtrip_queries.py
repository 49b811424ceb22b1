"""Registered queries that write a table in a publisher's form and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import with_totals
from plumbline.plans import build, staging
from plumbline.plans.conformed import county_universe
from plumbline.quality.integrity import header_mismatches
from plumbline.quality.results import counted, passes, results
from plumbline.session import shared_folder
from plumbline.sources import readers, sinks
from plumbline.sources.quoted_csv import misquoted_records, quoted_records, read_quoted_csv
from plumbline.sources.registry import raw_table
from plumbline.sources.split_json import read_arrays_split, read_envelope_split
from plumbline.testbed.frames import Testbed
from plumbline.testbed.queries import entry


@entry("roundtrip_csv", """
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN text = '' THEN NULL ELSE text END AS text, lang, source, substr(lang, 1, 4) AS year FROM documents""")
def roundtrip_csv(t: Testbed) -> DataFrame:
    # Documents hold newlines and quotes. Many part files, so that reading them whole per
    # file still spreads over tasks.
    folder = shared_folder(t.spark, "csv")
    t.table("documents").select("doc_id", "text", "lang", "source").write.csv(folder, header=True, escape='"', quoteAll=True)
    landed = readers.read_csv_text(t.spark, folder, ["doc_id", "text", "lang", "source"], multi_line=True)
    return sinks.add_year_partition(landed, "lang")


@entry("roundtrip_csv_split", """
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN text = '' THEN NULL ELSE text END AS text, lang, source FROM documents""")
def roundtrip_csv_split(t: Testbed) -> DataFrame:
    """The same landing, read by the block and not by the file."""
    folder = shared_folder(t.spark, "csv")
    t.table("documents").select("doc_id", "text", "lang", "source").write.csv(folder, header=True, escape='"', quoteAll=True)
    return read_quoted_csv(t.spark, folder, ["doc_id", "text", "lang", "source"])


@entry("misquoted_csv", """
SELECT o_orderpriority, count(*) AS misquoted FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL""")
def misquoted_csv(t: Testbed) -> DataFrame:
    """Every fifth line holds a quote inside an unquoted field, which the quoting rule forbids; the others are well quoted."""
    folder, key = shared_folder(t.spark, "misquoted"), F.col("o_orderkey")
    note = F.when(key % 5 == 0, '5" pipe, 6" pipe').when(key % 5 == 1, '"say ""it"",\nthen"').otherwise("plain")
    t.table("orders").select(F.concat_ws(",", "o_orderpriority", note).alias("value")).write.text(folder)
    found = misquoted_records(quoted_records(t.spark, folder))
    return found.groupBy(F.substring_index("record", ",", 1).alias("o_orderpriority")).agg(F.count(F.lit(1)).alias("misquoted"))


@entry("roundtrip_csv_lines", """
SELECT c_custkey::VARCHAR AS c_custkey, c_name, 'a, "b" ' || c_mktsegment AS segment FROM customer""")
def roundtrip_csv_lines(t: Testbed) -> DataFrame:
    """Records of one line each: the reader's splittable mode, which needs no count of quotes."""
    folder = shared_folder(t.spark, "lines")
    t.table("customer").select("c_custkey", "c_name", F.concat(F.lit('a, "b" '), "c_mktsegment").alias("segment")).write.csv(
        folder, header=True, escape='"')
    return readers.read_csv_text(t.spark, folder, ["c_custkey", "c_name", "segment"])


@entry("roundtrip_tsv", """
SELECT rpad(c_name, 24, ' ') AS padded, '  ' || c_mktsegment AS segment, CASE WHEN c_custkey % 5 = 0 THEN '"' || c_custkey ELSE c_custkey::VARCHAR END AS key FROM customer""")
def roundtrip_tsv(t: Testbed) -> DataFrame:
    folder, key = shared_folder(t.spark, "tsv"), F.col("c_custkey")
    t.table("customer").select(
        F.rpad("c_name", 24, " ").alias("padded"), F.concat(F.lit("  "), "c_mktsegment").alias("segment"),
        F.when(key % 5 == 0, F.concat(F.lit('"'), key.cast("string"))).otherwise(key.cast("string")).alias("key"),
    ).write.csv(folder, header=True, sep="\t", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_tsv_text(t.spark, folder, ["padded", "segment", "key"])


_ACS = ["B01003_001E", "B01003_001M", "B25001_001E", "B25001_001M"]


def _write_responses(t: Testbed, folder: str) -> None:
    """One response per vintage and level: a header row, then a row per place.

    A response lists the nation, its states or its counties once, a few thousand rows at
    most; the population table is already aggregated to that grain.
    """
    for level, keys in (("us", ["us"]), ("state", ["state"]), ("county", ["state", "county"])):
        rows = t.raw("population").where(F.col("geo_level") == level).withColumn("us", F.lit("1"))
        names = ["NAME", *_ACS, *keys]
        body = rows.groupBy("vintage").agg(F.concat(
            F.array(F.array(*[F.lit(n) for n in names])),
            F.collect_list(F.array(*[F.col(n) for n in names]))).alias("cells"))
        name = F.concat(F.lit("acs5-detailed-"), F.col("vintage"), F.lit(f"-{level}.json"))
        body.select(name.alias("name"), F.to_json("cells").alias("value")).write.mode("append").partitionBy(
            "name").text(folder)


@entry("roundtrip_json_arrays", """
SELECT name AS "NAME", B01003_001E, B01003_001M, B25001_001E, B25001_001M, CASE WHEN geo_level = 'us' THEN '1' END AS us, geo_level, vintage, state, county FROM raw_population""")
def roundtrip_json_arrays(t: Testbed) -> DataFrame:
    folder = shared_folder(t.spark, "arrays")
    _write_responses(t, folder)
    return readers.read_population_vintages(t.spark, folder, "detailed", _ACS)


@entry("split_json_arrays", """
SELECT name AS "NAME", B01003_001E, B01003_001M, B25001_001E, B25001_001M, vintage, state, county FROM raw_population WHERE geo_level = 'county'""")
def split_json_arrays(t: Testbed) -> DataFrame:
    """The counties' responses, read by the block."""
    folder = shared_folder(t.spark, "arrays")
    _write_responses(t, folder)
    return read_arrays_split(t.spark, f"{folder}/*acs5-detailed-*-county.json", _ACS, "county").drop("geo_level")


@entry("array_headers", """
SELECT 'shared' AS track, 'acs5_detailed' AS source, 'header order' AS check_name, 'PASS' AS status, concat('files=', count(DISTINCT vintage), ', mismatched=0') AS detail FROM raw_population
UNION ALL SELECT 'shared', 'acs5_detailed', 'header order, ' || vintage, CASE WHEN vintage = last THEN 'FAIL' ELSE 'PASS' END,
  concat('files=1, mismatched=', (vintage = last)::INT) FROM (SELECT DISTINCT vintage FROM raw_population), (SELECT max(vintage) AS last FROM raw_population)""")
def array_headers(t: Testbed) -> DataFrame:
    """Headers as landed, then with two columns of the last vintage swapped, vintage by vintage."""
    folder = shared_folder(t.spark, "headers")
    _write_responses(t, folder)
    headers = readers.json_array_headers(t.spark, f"{folder}/*acs5-detailed-*-county.json")
    expected = ["NAME", *_ACS, "state", "county"]
    last = t.raw("population").agg(F.max("vintage").alias("last"))
    vintage = F.regexp_extract("file", r"detailed-(\d{4})-", 1)
    swapped = with_totals(headers.withColumn("vintage", vintage), last).withColumn("header", F.when(
        F.col("vintage") == F.col("last"), F.concat(F.slice("header", 1, 1), F.reverse(F.slice("header", 2, 2)), F.slice("header", 4, 99))
    ).otherwise(F.col("header")))
    wrong = header_mismatches(swapped, expected).groupBy("vintage").agg(F.count(F.lit(1)).alias("wrong"))
    each = swapped.groupBy("vintage").agg(F.count(F.lit(1)).alias("files")).join(wrong, "vintage", "left").withColumn("wrong", F.coalesce("wrong", F.lit(0)))
    whole = with_totals(headers.agg(F.count(F.lit(1)).alias("files")), header_mismatches(headers, expected).agg(F.count(F.lit(1)).alias("wrong")))
    right, detail = passes(F.col("wrong") == 0), counted(files=F.col("files"), mismatched=F.col("wrong"))
    return results(whole, "shared", "acs5_detailed", ("header order", right, detail)).unionByName(
        each.select(F.lit("shared").alias("track"), F.lit("acs5_detailed").alias("source"),
                    F.concat(F.lit("header order, "), "vintage").alias("check_name"), right.alias("status"), detail.alias("detail")))


_CROSSWALK = ["zip", "geoid", "city", "state", "res_ratio", "bus_ratio", "oth_ratio", "tot_ratio"]


def _write_envelopes(t: Testbed) -> str:
    """Ratios go out as bare numbers, as the publisher sends them, and must come back digit
    for digit. One response per state, as the publisher answers one query per state."""
    folder = shared_folder(t.spark, "envelope")
    pairs = [F.concat(F.lit(f'"{c}":"'), F.col(c), F.lit('"')) if not c.endswith("ratio")
             else F.concat(F.lit(f'"{c}":'), F.col(c)) for c in _CROSSWALK]
    row = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    body = t.raw("crosswalk").groupBy("state").agg(F.concat(
        F.lit('{"data":{"year":2024,"results":['), F.array_join(F.collect_list(row), ","), F.lit("]}}")).alias("value"))
    body.select("state", "value").write.partitionBy("state").text(folder)
    return f"{folder}/*/*.txt"


@entry("roundtrip_envelope", f"SELECT {', '.join(_CROSSWALK)} FROM raw_crosswalk")
def roundtrip_envelope(t: Testbed) -> DataFrame:
    return readers.read_json_envelope(t.spark, _write_envelopes(t), "data.results", _CROSSWALK)


@entry("split_envelope", f"SELECT {', '.join(_CROSSWALK)} FROM raw_crosswalk")
def split_envelope(t: Testbed) -> DataFrame:
    """The same responses, read by the block and not by the file."""
    return read_envelope_split(t.spark, _write_envelopes(t), "data.results", _CROSSWALK)


@entry("roundtrip_partitioned", """
SELECT coalesce(k, '__HIVE_DEFAULT_PARTITION__') AS partition_key, count(*) AS row_count, NOT coalesce(regexp_full_match(k, '\\d{4}') AND k BETWEEN '1996' AND '2000', false) AS is_nonstandard
FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 77 = 0 THEN '02' ELSE strftime(o_orderdate, '%Y') END AS k FROM orders) GROUP BY ALL""")
def roundtrip_partitioned(t: Testbed) -> DataFrame:
    folder, key = shared_folder(t.spark, "partitioned"), F.col("o_orderkey")
    year = F.when(key % 50 == 0, None).when(key % 77 == 0, "02").otherwise(F.date_format("o_orderdate", "yyyy"))
    orders = t.table("orders").withColumn("k", year)
    sinks.write_partitioned(orders.limit(0), folder, "k")
    sinks.write_partitioned(orders, folder, "k")
    counts = sinks.partition_counts(readers.read_partitioned(t.spark, folder), "k")
    return sinks.flag_nonstandard_keys(counts, years=(1996, 2000))


@entry("published_versions", """
SELECT v AS version, count(*) AS row_count, count(DISTINCT o_orderstatus) AS partitions FROM orders, range(1, 4) r(v) WHERE v > 2 OR (o_orderkey % 3) < v GROUP BY v
UNION ALL SELECT 4, count(*), count(DISTINCT o_orderstatus) FROM orders WHERE o_orderkey % 3 < 2""")
def published_versions(t: Testbed) -> DataFrame:
    """What readers find after each of three publishes, and through a frame that began before the last."""
    folder, orders = shared_folder(t.spark, "published"), t.table("orders")
    seen = []
    for version in (1, 2, 3):
        sinks.write_partitioned(orders.where((F.lit(version) > 2) | (F.col("o_orderkey") % 3 < version)), folder, "o_orderstatus")
        seen.append(readers.read_partitioned(t.spark, folder))
    frames = [df.select(F.lit(v).cast("bigint").alias("version"), "o_orderstatus") for v, df in zip((1, 2, 3, 4), [*seen, seen[1]], strict=True)]
    return readers.union_by_name(frames).groupBy("version").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("o_orderstatus").alias("partitions"))


@entry("manifest_counts", """
SELECT count(*) AS rows_raw, count(DISTINCT l_returnflag) AS partitions, 0::BIGINT AS null_partition_rows, count(*) FILTER (l_returnflag = 'N') AS nonstandard_rows,
  42::BIGINT AS source_reported_count, '2001-01-02' AS source_last_refresh, CAST(NULL AS VARCHAR) AS source_metadata_refresh FROM lineitem""")
def manifest_counts(t: Testbed) -> DataFrame:
    known = t.table("lineitem").where(F.col("l_returnflag") != "N").select("l_returnflag").distinct()
    counts = sinks.flag_nonstandard_keys(sinks.partition_counts(t.table("lineitem"), "l_returnflag"), known)
    path = shared_folder(t.spark, "manifest") + ".json"
    sinks.write_manifest(sinks.manifest_row(counts, 42, "2001-01-02"), path)
    read = readers.read_manifest(t.spark, path)
    return read.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("rows_raw", "partitions", "null_partition_rows", "nonstandard_rows",
                                                     "source_reported_count")],
        "source_last_refresh", F.col("source_metadata_refresh").cast("string").alias("source_metadata_refresh"))


@entry("table_load", """
SELECT 'insurance' AS track, 'nfip_claims' AS source, 'reload' AS check_name, 'PASS' AS status, concat('rows=', count(*), ', recorded=', count(*)) AS detail FROM raw_claims
UNION ALL SELECT 'insurance', 'fema_declarations', 'reload', 'FAIL', concat('rows=', count(*), ', recorded=', count(*) + 3) FROM raw_declarations
UNION ALL SELECT 'shared', 'zip_county_crosswalk', 'reload', 'PASS', concat('rows=', count(*), ', recorded=none') FROM raw_crosswalk
UNION ALL SELECT 'insurance', 'nfip_policies', 'reload', 'SKIP', 'not landed'""")
def table_load(t: Testbed) -> DataFrame:
    """Three of the registered trees land: one as recorded, one short of its manifest, one without; one is absent."""
    root = shared_folder(t.spark, "landing")
    for source, name, short in (("nfip_claims", "claims", 0), ("fema_declarations", "declarations", 3), ("zip_county_crosswalk", "crosswalk", None)):
        spec = raw_table(source)
        path = f"{root}/{spec.track}/{source}"
        rows = sinks.write_partitioned(t.raw(name), path, spec.partition_key)
        if short is not None:
            counts = sinks.flag_nonstandard_keys(sinks.partition_counts(t.raw(name), spec.partition_key))
            sinks.write_manifest(sinks.manifest_row(counts, rows_duckdb=rows + short), f"{path}/manifest.json")
    wanted = [raw_table(s) for s in ("nfip_claims", "fema_declarations", "zip_county_crosswalk", "nfip_policies")]
    return build.load_report(t.spark, build.load_raw(t.spark, root), build.load_manifests(t.spark, root), wanted)


@entry("landing_shapes", """
SELECT source_name, count(county_fips) AS keys FROM county_refs GROUP BY source_name""")
def landing_shapes(t: Testbed) -> DataFrame:
    found = county_universe(t.raw("claims"), t.raw("policies"), t.raw("declarations"), t.raw("medicare"),
                            t.raw("lending"), t.raw("crosswalk"), staging.stage_population_65(t.raw("population_65")))
    parts = [df.select(F.lit(name).alias("source_name"), "county_fips") for name, df in found]
    return readers.union_by_name(parts).groupBy("source_name").agg(F.count_distinct("county_fips").alias("keys"))
