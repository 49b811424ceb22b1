import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from plumbline.quality.integrity import header_mismatches
from plumbline.sources import quoted_csv, readers, sinks, split_json, versions
from plumbline.sources.registry import RAW_TABLES, raw_table
from plumbline.sources.seeds import code_list, fixed_table, seed_csv
from plumbline import fixed_values as fixed


def test_csv_keeps_text_and_newlines(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('id,note,code\n1,"two\nlines, ""quoted""",02\n2,Exempt,*\n')
    found = rows(readers.read_csv_text(spark, str(tmp_path / "a.csv"), multi_line=True))
    assert found == [("1", 'two\nlines, "quoted"', "02"), ("2", "Exempt", "*")]


def test_tsv_keeps_padding_and_quotes(spark, tmp_path, rows):
    (tmp_path / "a.tsv").write_text('series_id\tvalue\nCUUR0000SA0      \t       1.50\nX"Y  \t           -\n')
    found = rows(readers.read_tsv_text(spark, str(tmp_path / "a.tsv")))
    assert ("CUUR0000SA0      ", "       1.50") in found and ('X"Y  ', "           -") in found


def test_array_responses_by_position(spark, tmp_path, rows):
    header = ["NAME", "B01003_001E", "state", "county"]
    (tmp_path / "acs5-detailed-2019-county.json").write_text(json.dumps([header, ["A", "10", "26", "001"], ["B", None, "26", "003"]]))
    (tmp_path / "acs5-detailed-2019-us.json").write_text(json.dumps([["NAME", "B01003_001E", "us"], ["US", "99", "1"]]))
    (tmp_path / "acs5-detailed-2019-state.json").write_text(json.dumps([["NAME", "B01003_001E", "state"], ["MI", "50", "26"]]))
    df = readers.read_population_vintages(spark, str(tmp_path), "detailed", ["B01003_001E"])
    assert rows(df, "NAME", "B01003_001E", "state", "county", "geo_level", "vintage") == [
        ("A", "10", "26", "001", "county", "2019"), ("B", None, "26", "003", "county", "2019"),
        ("MI", "50", "26", None, "state", "2019"), ("US", "99", None, None, "us", "2019")]
    headers = readers.json_array_headers(spark, str(tmp_path / "*-county.json"))
    assert header_mismatches(headers, header).count() == 0
    assert header_mismatches(headers, header[::-1]).count() == 1


def test_envelope_keeps_number_text(spark, tmp_path, rows):
    body = '{"data":{"year":2024,"results":[{"zip":"48001","city":"A 12, B: 3","res_ratio":1.50,"tot_ratio":0.00001},' \
           '{"zip":"48002","city":"say \\"5\\"","res_ratio":-2E3,"tot_ratio":0}]}}'
    (tmp_path / "a.json").write_text(body)
    found = rows(readers.read_json_envelope(spark, str(tmp_path / "a.json"), "data.results", ["zip", "city", "res_ratio", "tot_ratio"]))
    assert found == [("48001", "A 12, B: 3", "1.50", "0.00001"), ("48002", 'say "5"', "-2E3", "0")]


def test_partitioned_tree_is_swapped_whole(spark, tmp_path, rows):
    root = str(tmp_path / "tree")
    first = spark.createDataFrame([(1, "02"), (2, None), (3, "26")], "n int, state string")
    assert sinks.write_partitioned(first, root, "state") == 3
    (tmp_path / "tree" / "manifest.json").write_text("{}")
    assert sinks.write_partitioned(first.where("n < 3"), root, "state") == 2
    assert (tmp_path / "tree" / "manifest.json").exists()
    back = readers.read_partitioned(spark, root)
    assert rows(back, "n", "state") == [(1, "02"), (2, None)]
    counts = dict(rows(sinks.partition_counts(back, "state")))
    assert counts == {"02": 1, readers.HIVE_NULL: 1}


def test_readers_never_find_a_missing_or_mixed_tree(spark, tmp_path):
    root, stop, seen, errors = str(tmp_path / "tree"), threading.Event(), set(), []

    def version(n):
        return spark.range(300).select((F.col("id") % 5).cast("string").alias("state"), F.lit(n).alias("n"), "id")

    def read():
        while not stop.is_set():
            try:
                rows = readers.read_partitioned(spark, root).groupBy("n").count().collect()
                seen.add(tuple((r.n, r["count"]) for r in rows))
            except Exception as error:  # noqa: BLE001
                errors.append(error)

    sinks.write_partitioned(version(0), root, "state")
    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in range(1, 11):
            sinks.write_partitioned(version(n), root, "state")
    finally:
        stop.set()
        reader.join()
    assert not errors
    assert all(len(s) == 1 and s[0][1] == 300 for s in seen) and len(seen) > 1


def test_a_failed_publish_leaves_the_old_version(spark, tmp_path, rows):
    root = str(tmp_path / "tree")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    sinks.write_partitioned(df, root, "k")
    before = readers.read_partitioned(spark, root)
    with pytest.raises(Exception, match="broken"):
        sinks.write_partitioned(df.withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.lit("broken"))).otherwise(F.col("n"))), root, "k")
    assert rows(readers.read_partitioned(spark, root), "n", "k") == [(1, "a"), (2, "b")]
    sinks.write_partitioned(df.limit(1), root, "k")
    assert before.count() == 2 and readers.read_partitioned(spark, root).count() == 1


def test_expiry_keeps_what_readers_may_hold(spark, tmp_path):
    root, df = str(tmp_path / "tree"), spark.createDataFrame([(1, "a")], "n int, k string")
    for _ in range(4):
        sinks.write_partitioned(df, root, "k", grace=3600)
    (tmp_path / "tree" / "versions" / "abandoned").mkdir()
    assert len(versions.commits(spark, root)) == 4  # all of them young
    assert len(versions.expire_versions(spark, root, keep=2, grace=-60)) == 3
    assert [c.number for c in versions.commits(spark, root)] == [4, 3]
    assert len(list((tmp_path / "tree" / "versions").iterdir())) == 2
    assert readers.read_partitioned(spark, root).count() == 1
    assert versions.published_folder(spark, str(tmp_path / "none")) is None


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    root, df = str(tmp_path / "tree"), spark.createDataFrame([(1, "a")], "n int, k string")
    sinks.write_partitioned(df, root, "k")
    monkeypatch.setattr(versions, "_numbers", lambda files, path: [])  # as if the first commit came meanwhile
    with pytest.raises(versions.PublishConflict):
        sinks.write_partitioned(df.limit(0), root, "k")
    monkeypatch.undo()
    assert readers.read_partitioned(spark, root).count() == 1
    assert len(list((tmp_path / "tree" / "versions").iterdir())) == 1


# ── quoted files split inside ────────────────────────────────────────────────────────────
@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def limit(size):
        for n, v in zip(names, (str(size), "1"), strict=True):
            spark.conf.set(n, v)

    yield limit
    for n, v in before.items():
        spark.conf.set(n, v)


def _quoted_file(seed):
    """Fields with newlines, returns, separators and doubled quotes; sometimes an unclosed end or blank lines."""
    rng = random.Random(seed)

    def field():
        text = "".join(rng.choice(("a", "é", "\n", "\n\n", ",", '"', "\r\n", " ", "x1")) for _ in range(rng.choice((0, 1, 3, 40))))
        plain = "".join(c for c in text if c not in '",\r\n')
        return plain if rng.random() < 0.3 else '"' + text.replace('"', '""') + '"'

    end = "\r\n" if seed % 3 == 2 else "\n"
    body = end.join(["id,b,c", *(f"{i},{field()},{field()}" for i in range(rng.choice((0, 1, 5, 60))))])
    return body + {0: "", 1: end, 2: end + '99,"never closed, \n""oh', 3: end + end + "77,1,2" + end + end}[seed % 4]


@pytest.mark.parametrize("seed", range(12))
def test_split_reading_equals_the_multi_line_reader(spark, tmp_path, rows, small_blocks, seed):
    path = tmp_path / "a.csv"
    path.write_bytes(_quoted_file(seed).encode())
    small_blocks((7, 50, 300, 100_000)[seed % 4 if seed % 5 else 0])
    mine = quoted_csv.read_quoted_csv(spark, str(path))
    whole = readers.read_csv_text(spark, str(path), multi_line=True)
    assert mine.columns == whole.columns == ["id", "b", "c"]
    assert rows(mine) == rows(whole)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, rows, small_blocks):
    path = tmp_path / "big.csv"
    path.write_text("id,b\n" + "".join(f'{i},"line {i}\nand, ""so"" on"\n' for i in range(2000)))
    small_blocks(4000)
    lines = quoted_csv._lines(spark, str(path))
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() >= path.stat().st_size // 4000
    mine = quoted_csv.read_quoted_csv(spark, str(path))
    assert rows(mine) == rows(readers.read_csv_text(spark, str(path), multi_line=True)) and mine.count() == 2000
    assert mine.select("b").distinct().count() == 2000


def test_quotes_inside_unquoted_fields_are_found(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('id,b\n1,"fine ""x"""\n2,5" pipe 6"\n3,"a"b"c"\n4,"",""\n')
    found = quoted_csv.misquoted_records(quoted_csv.quoted_records(spark, str(tmp_path)))
    assert rows(found, "record") == [('2,5" pipe 6"',), ('3,"a"b"c"',)]


# ── responses split inside ───────────────────────────────────────────────────────────────
def _response(seed):
    """An envelope with siblings of every kind, nested fields, and brackets, quotes and escapes in strings."""
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice(("a", "é", "{", "}", "[", "]", '"', "\\", "\n", ",", ":", '"}', "\\\"")) for _ in range(rng.choice((0, 2, 9, 50))))

    def row(i):
        return {"id": i, "b": text(), "c": rng.choice((None, {"x": [text(), {"y": text()}]}, [[1], [{"z": "}"}]], 1.50, True))}

    rows = [row(i) for i in range(rng.choice((0, 1, 4, 40)))]
    data = {"year": 2024, "meta": {"b": text()}, "lists": [[{"id": 5}, {"id": text()}]], "others": [{"id": "no"}, {"b": text()}],
            "results": rows, "after": [{"id": "no"}] * rng.choice((0, 2)), "none": []}
    return json.dumps({"head": text(), "data": data, "tail": [text()]}, indent=rng.choice((None, 1)), ensure_ascii=False)


@pytest.mark.parametrize("seed", range(6))
def test_split_responses_equal_whole_ones(spark, tmp_path, rows, small_blocks, seed):
    (tmp_path / "a.json").write_text(_response(seed) + ("\n" if seed % 2 else ""))
    (tmp_path / "b.json").write_text(_response(seed + 100))
    small_blocks((9, 60, 400, 100_000)[seed % 4])
    mine = split_json.read_envelope_split(spark, str(tmp_path), "data.results", ["id", "b", "c"])
    assert rows(mine) == rows(readers.read_json_envelope(spark, str(tmp_path), "data.results", ["id", "b", "c"]))
    assert split_json.broken_responses(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("size", (11, 100, 100_000))
def test_split_arrays_equal_whole_ones(spark, tmp_path, rows, small_blocks, size):
    rng = random.Random(size)
    for vintage in (2019, 2020):
        cells = [["NAME", "v", "state", "county"], *([f"A]{i}, \"[", rng.choice((None, "1")), "01", f"{i:03}"] for i in range(vintage - 1990))]
        (tmp_path / f"acs5-x-{vintage}-county.json").write_text(json.dumps(cells).replace("], [", "],\n["))
    small_blocks(size)
    mine = split_json.read_arrays_split(spark, str(tmp_path), ["v"], "county")
    assert rows(mine) == rows(readers.read_json_arrays(spark, str(tmp_path), ["v"], "county")) and mine.count() == 59


def test_one_response_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"results": [{"id": i, "t": "} " * 9} for i in range(2000)]}))
    small_blocks(4000)
    pieces = split_json._pieces(spark, str(path), "}")
    assert pieces.select(F.spark_partition_id().alias("p")).distinct().count() >= path.stat().st_size // 4000
    found = split_json.read_envelope_split(spark, str(path), "results", ["id", "t"])
    assert found.select("id").distinct().count() == found.count() == 2000


def test_cut_and_ambiguous_responses(spark, tmp_path, rows):
    whole = '{"results":[{"id":"1"},{"id":"2"}]}'
    for n in range(len(whole)):
        (tmp_path / f"{n:02}.json").write_text(whole[:n])
    assert split_json.read_envelope_split(spark, str(tmp_path), "results", ["id"]).count() == 0
    assert split_json.broken_responses(spark, str(tmp_path)).count() == len(whole) - 1  # all but the empty file
    (tmp_path / "whole.json").write_text(whole)
    assert rows(split_json.read_envelope_split(spark, str(tmp_path), "results", ["id"])) == [("1",), ("2",)]
    twice = tmp_path / "twice"
    twice.mkdir()
    (twice / "a.json").write_text('{"a":{"results":[{"id":"1"}]},"b":{"results":[{"id":"2"}]}}')
    with pytest.raises(Exception, match="more than one array"):
        split_json.read_envelope_split(spark, str(twice), "a.results", ["id"]).collect()


def test_manifest_round_trip(spark, tmp_path):
    counts = sinks.flag_nonstandard_keys(
        spark.createDataFrame([("2019", 5), ("0219", 1), (readers.HIVE_NULL, 2)], "partition_key string, row_count bigint"), years=(2000, 2030))
    path = str(tmp_path / "manifest.json")
    sinks.write_manifest(sinks.manifest_row(counts, 9, "d1"), path)
    row = readers.read_manifest(spark, path).first()
    assert (row.rows_raw, row.partitions, row.null_partition_rows, row.nonstandard_rows, row.source_reported_count) == (8, 3, 2, 3, 9)


def test_samples_in_every_form(spark, tmp_path, rows):
    df = spark.createDataFrame([("2", "b"), ("1", "a")], "zip string, city string")
    for form in ("csv", "tsv", "parquet", "json_envelope"):
        sinks.write_sample(df, str(tmp_path / form), form, ["zip"])
    assert rows(readers.read_csv_text(spark, str(tmp_path / "csv"), ["zip", "city"])) == [("1", "a"), ("2", "b")]
    assert rows(spark.read.parquet(str(tmp_path / "parquet"))) == [("1", "a"), ("2", "b")]
    assert rows(readers.read_json_envelope(spark, str(tmp_path / "json_envelope"), "data.results", ["zip", "city"])) == [("1", "a"), ("2", "b")]
    [part] = [p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv"]
    assert part.read_text() == "zip,city\n1,a\n2,b\n"


def test_file_inventory_hashes_content(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = readers.file_inventory(spark, str(tmp_path / "x.bin")).first()
    assert (row.file_name, row.bytes) == ("x.bin", 3)
    assert row.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


@pytest.mark.parametrize("end", [b"", b"\n", b"\n\n", b"\r\n"])
def test_large_files_are_digested_in_steps(spark, tmp_path, monkeypatch, end):
    steps = []
    monkeypatch.setattr(readers, "WHOLE", 100_000)
    monkeypatch.setattr(readers, "_sha256_step", lambda state, make=readers._sha256_step: steps.append(state) or make(state))
    rng = random.Random(len(end))
    data = {"a.bin": rng.randbytes(450_000) + end, "b.bin": b"\n" * 3 + rng.randbytes(99_000) + end,
            "c.bin": b"\xef\xbb\xbf" + rng.randbytes(120_000) + end, "d.bin": b"\0" * 250_000 + end}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        found = {r.file_name: (r.bytes, r.sha256) for r in readers.file_inventory(spark, str(tmp_path / "*.bin")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items()}
    assert len([x for x in steps if x is not None]) >= 4  # the state was handed on


def test_seeds_stay_text(spark, tmp_path):
    states = fixed_table(spark, fixed.STATES)
    assert states.count() == 56 and {f.dataType.simpleString() for f in states.schema} == {"string"}
    assert states.where("state_code = 'AL'").first().state_fips == "01"
    (tmp_path / "s.csv").write_text("code,name\n02,Alaska\n")
    assert seed_csv(spark, str(tmp_path / "s.csv"), ["code", "name"]).first().code == "02"
    assert code_list("loan_purpose")["31"] == "Refinancing"


def test_registry_names():
    assert len(RAW_TABLES) == 13 and len({t.source for t in RAW_TABLES}) == 13
    assert raw_table("nfip_claims").table == "raw.ins_nfip_claims"
    assert raw_table("cpi_u").staged == "stg.stg_ref__cpi_u"


def test_saved_tables_carry_comments(spark):
    saved = sinks.save_table(spark.createDataFrame([(1,)], "n int"), "commented_table", {"n": "A number"})
    assert saved.schema["n"].metadata["comment"] == "A number"
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_absent_short_and_unrecorded_sources(spark, tmp_path, rows):
    from plumbline.plans.build import load_manifests, load_raw, load_report

    df = spark.createDataFrame([("MI", 1), ("OH", 2), (None, 3)], "state string, n int")
    for source, recorded in (("nfip_claims", 3), ("fema_declarations", 5), ("zip_county_crosswalk", None)):
        spec = raw_table(source)
        path = f"{tmp_path}/{spec.track}/{source}"
        assert sinks.write_partitioned(df, path, "state") == 3
        if recorded:
            counts = sinks.flag_nonstandard_keys(sinks.partition_counts(df, "state"))
            sinks.write_manifest(sinks.manifest_row(counts, rows_duckdb=recorded), f"{path}/manifest.json")
    raw, manifests = load_raw(spark, str(tmp_path)), load_manifests(spark, str(tmp_path))
    assert set(raw) == {"nfip_claims", "fema_declarations", "zip_county_crosswalk"}
    found = {r.source: (r.status, r.detail) for r in load_report(spark, raw, manifests).collect()}
    assert found["nfip_claims"] == ("PASS", "rows=3, recorded=3") and found["fema_declarations"] == ("FAIL", "rows=3, recorded=5")
    assert found["zip_county_crosswalk"] == ("PASS", "rows=3, recorded=none") and found["cpi_u"] == ("SKIP", "not landed")
    row = manifests["nfip_claims"].first()
    assert (row.rows_landing, row.rows_raw, row.partition_rows.MI) == (3, 3, 1) and set(row.nonstandard_partition_keys) == {"MI", "OH", readers.HIVE_NULL}


def test_partitions_are_few_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 16).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 7) END AS k")
    assert sinks.write_partitioned(df, str(tmp_path / "tree"), "k") == 4000
    assert len(list((tmp_path / "tree").glob("*/*.parquet"))) <= 2 * 8


def test_samples_are_bounded_and_ordered(spark, tmp_path):
    df = spark.createDataFrame([("1", "b"), ("2", "a"), (None, "c")], "zip string, city string")
    sinks.write_sample(df, str(tmp_path / "json"), "json_envelope", ["city"])
    [part] = (tmp_path / "json").glob("*.json")
    assert [r.get("city") for r in json.loads(part.read_text())["data"]["results"]] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        sinks.write_sample(df, str(tmp_path / "csv"), "csv", limit=2)
