import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import fixed_values as fixed
from plumbline.contracts import ContractBreach, contract_breaches, contracts
from plumbline.params import Params
from plumbline.plans.conformed import period_dimension
from plumbline.quality import assertions, coverage, drift, geography, integrity
from plumbline.quality.catalog import COLUMNS, data_dictionary
from plumbline.quality.results import exit_code, results, tally
from plumbline.sources.seeds import parse_fixed
from plumbline.sources.sinks import save_table


def counts(spark, **keys):
    return spark.createDataFrame([(k, n) for k, n in keys.items()], "partition_key string, row_count bigint")


def statuses(df):
    return {r.check_name: (r.status, r.detail) for r in df.collect()}


def every_state():
    _, lines = parse_fixed(fixed.STATES)
    return {line[0]: 1 for line in lines}


def test_gap_statuses(spark, rows):
    df = spark.createDataFrame([
        ("none", None, 5, "a", "a"), ("equal", 5, 5, "a", "a"), ("same stamps", 6, 5, "a", "a"),
        ("other stamps", 6, 5, "a", "b"), ("one stamp", 6, 5, "a", None)], "k string, r int, l int, d string, m string")
    found = dict(rows(df.select("k", integrity.gap_status(F.col("r"), F.col("l"), F.col("d"), F.col("m")))))
    assert found == {"none": "SKIP", "equal": "PASS", "same stamps": "FAIL", "other stamps": "WARN", "one stamp": "WARN"}


def test_lossless_sees_moved_rows(spark):
    columns = "partition_key string, row_count bigint, paid decimal(38,2)"
    landing = spark.createDataFrame([("MI", 3, None), ("OH", 2, None)], columns).withColumn("paid", F.lit(5).cast("decimal(38,2)"))
    moved = spark.createDataFrame([("MI", 2, None), ("TX", 3, None)], columns).withColumn("paid", F.lit(5).cast("decimal(38,2)"))
    same = statuses(integrity.lossless(landing, landing, ["paid"], "t", "s"))
    assert same["control sums"][0] == same["per-partition counts"][0] == "PASS"
    other = statuses(integrity.lossless(landing, moved, ["paid"], "t", "s"))
    assert other["control sums"][0] == "PASS"
    assert other["per-partition counts"] == ("FAIL", "partitions=3, only_landing=1, only_raw=1, differing=1")
    assert statuses(integrity.lossless(landing, landing, [], "t", "s"))["control sums"][0] == "SKIP"


def test_state_roster(spark):
    full = {**every_state(), "UN": 7}
    found = statuses(integrity.state_roster(counts(spark, **full), "t", "s"))
    assert found["states + DC present"][0] == found["territories present"][0] == "PASS"
    assert found["unknown-state rows kept"] == ("PASS", "keys=1, rows=7")
    less = {k: v for k, v in full.items() if k not in ("MI", "GU")}
    found = statuses(integrity.state_roster(counts(spark, **less), "t", "s"))
    assert (found["states + DC present"][0], found["territories present"][0]) == ("FAIL", "WARN")
    assert statuses(integrity.state_roster(counts(spark, **less), "t", "s", is_sample=True))["states + DC present"][0] == "SKIP"


def test_year_coverage(spark, rows):
    gap = counts(spark, **{"2011": 1, "2013": 1, "bad": 4})
    found = statuses(integrity.year_coverage(gap, "t", "s", 2011))
    assert found["year coverage"] == ("FAIL", "first=2011, last=2013, gaps=1")
    assert found["malformed dates kept"] == ("PASS", "keys=1, rows=4") and found["earliest year"][0] == "PASS"
    assert rows(integrity.missing_years(gap)) == [(2012,)]
    assert statuses(integrity.year_coverage(counts(spark, bad=1), "t", "s"))["year coverage"][0] == "FAIL"


def test_expected_keys(spark):
    found = statuses(integrity.expected_keys(counts(spark, S=1, U=1), ["S", "U"], "t", "s"))
    assert found["expected keys present"][0] == found["no unexpected keys"][0] == "PASS"
    found = statuses(integrity.expected_keys(counts(spark, S=1, FM=1), ["S", "U"], "t", "s", tolerated=("FM",)))
    assert (found["expected keys present"][0], found["no unexpected keys"][0]) == ("FAIL", "WARN")
    assert statuses(integrity.expected_keys(counts(spark, S=1, U=1, X=1), ["S", "U"], "t", "s"))["no unexpected keys"][0] == "FAIL"


def test_rollups_must_exist(spark):
    found = statuses(integrity.peers_and_rollups(counts(spark, **every_state()), "t", "s"))
    assert found["rollups kept, not summed"][0] == "FAIL"
    found = statuses(integrity.peers_and_rollups(counts(spark, **every_state(), US=3), "t", "s"))
    assert found["rollups kept, not summed"] == ("PASS", "rollups=1, rows=3")


def test_paging(spark):
    def check(ids):
        rows = [(p, n, i) for p, page in enumerate(ids) for n, i in enumerate(page or [])]
        df = spark.createDataFrame(rows, "page int, pos int, id int")
        return {k: v[0] for k, v in statuses(integrity.paging(df, "page", "pos", "id", 3, "t", "s")).items()}

    assert set(check([[1, 2, 3], [4, 5, 6], [7]]).values()) == {"PASS"}
    assert check([[1, 3, 2], [4, 5, 6], [7]])["ids unique and ascending"] == "FAIL"  # disorder inside a page
    gap = check([[4, 5, 6], None, [1]])  # a page is gone, and the ids descend over the gap
    assert gap["ids unique and ascending"] == "FAIL" and gap["pages full but the last"] == "FAIL"
    assert check([[1, 2, 3], [4, 5, 6], [6]])["ids unique and ascending"] == "FAIL"
    assert check([[1, 2, 3], [3, 5, 6], [7]])["ids unique and ascending"] == "FAIL"
    assert check([[1, 2], [4, 5, 6], [7]])["pages full but the last"] == "FAIL"
    assert check([[1, 2, 3], [4, 5, 6]])["last page not full"] == "WARN"


def test_drift_modes(spark):
    observed = spark.createDataFrame([("a", "x"), ("a", "new"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", "x")], "source string, column_name string")
    baseline = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "gone"), ("c", "x")], "source string, column_name string")
    modes = spark.createDataFrame([("a", "exact", None), ("b", "exact", None), ("c", "subset", None), ("d", "count", "1"), ("e", "exact", None)],
                                  "source string, mode string, expected_count string")
    found = {r.source: r.status for r in drift.schema_drift(observed, baseline, modes).collect()}
    assert found == {"a": "WARN", "b": "FAIL", "c": "PASS", "d": "PASS", "e": "SKIP"}


def test_contract_breaches(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    wanted = T.StructType([T.StructField("n", T.LongType()), T.StructField("m", T.StringType())])
    assert contract_breaches(df, df.schema) == []
    assert contract_breaches(df, wanted) == ["m: missing", "s: not in the contract", "n: int instead of bigint"]


def test_every_contract_has_meanings():
    assert len(contracts()) == 22
    for contract in contracts().values():
        assert contract.meaning and contract.columns and all(contract.comments.values())
        assert contract.comments.keys() == contract.columns.keys()


def test_a_table_that_breaks_its_contract_is_refused(spark, tmp_path):
    table = "conformed.dim_period"
    periods = period_dimension(spark)
    saved = save_table(periods, table, path=str(tmp_path / "a"))
    assert saved.schema["grain"].metadata["comment"] == contracts()[table].comments["grain"]
    assert spark.catalog.getTable(table).description == contracts()[table].meaning
    with pytest.raises(ContractBreach, match="calendar_year: int instead of smallint"):
        save_table(periods.withColumn("calendar_year", F.col("calendar_year").cast("int")), table, path=str(tmp_path / "b"))
    with pytest.raises(ContractBreach, match="grain: missing"):
        save_table(periods.drop("grain"), table, path=str(tmp_path / "b"))
    assert not (tmp_path / "b").exists() and spark.table(table).count() == periods.count()


def test_geography_gate(spark):
    gate = geography.gates()["zip_county_crosswalk"]
    good = [("MI", f"26{n:03d}") for n in range(1, 166, 2)]
    df = spark.createDataFrame(good + [("MI", "26"), ("OH", "39001")], "state string, geoid string")
    found = statuses(geography.check_geography(df, gate))
    assert found["focus geography usable"] == ("PASS", "unusable=1, rows=84, national_unusable=1, national_rows=85")
    assert found["focus county roster"] == ("PASS", "counties=83")
    assert statuses(geography.check_geography(df.limit(3), gate))["focus county roster"][0] == "WARN"
    assert statuses(geography.check_geography(df.where("state = 'TX'"), gate))["focus geography usable"][0] == "WARN"


def test_question_statuses(spark):
    claims = spark.createDataFrame([("MI", 1)], "state string, paid int")
    question = coverage.Question("Q", "t", "asks", (
        coverage.Ingredient("rows", "claims", lambda p: F.count_if(F.col("state") == p.focus_state)),
        coverage.Ingredient("more", "claims", lambda p: F.count("paid"), 2)))
    absent = coverage.Question("A", "t", "asks", (coverage.Ingredient("x", "nowhere", lambda p: F.count("y")),))
    dropped = coverage.Question("D", "t", "asks", (coverage.Ingredient("x", "claims", lambda p: F.count("gone")),))

    def run(sample):
        measured = coverage.measure_ingredients({"claims": claims}, spark, Params(), sample, (question, absent, dropped))
        return {r.source: r.status for r in coverage.check_questions(measured).collect()}

    assert run(False) == {"Q": "FAIL", "A": "SKIP", "D": "FAIL"}
    assert run(True) == {"Q": "PASS", "A": "SKIP", "D": "FAIL"}


def test_report(spark):
    one = spark.range(1)
    bad = results(one, "t", "s", ("a", "PASS", F.lit("")), ("b", "FAIL", F.lit("")))
    assert tuple(tally(bad).first())[2:] == (1, 0, 0, 1)
    assert exit_code(bad) == 1 and exit_code(bad.where("status = 'PASS'")) == 0


def test_assertions_find_what_is_wrong(spark, rows):
    complaints = spark.createDataFrame([("MI", "Mortgage", "m", "Odd", None), ("MI", "New", None, "Closed", "c")],
                                       "state_code string, product string, product_family string, company_response string, response_family string")
    assert rows(assertions.unmapped_labels(complaints)) == [("company_response", "Odd", 1), ("product", "New", 1)]
    allocation = spark.createDataFrame([("MI", 1.5)], "state_code string, allocated_complaints double")
    assert assertions.allocation_loss(complaints, allocation).count() == 1
    periods = spark.createDataFrame([("month:2019-01", "month")], "period_id string, grain string")
    facts = {"m": ("month", periods.select("period_id")), "y": ("year", periods.select("period_id")),
             "n": ("month", spark.createDataFrame([("month:1800-01",), (None,)], "period_id string"))}
    assert assertions.unresolved_periods(facts, periods).count() == 3
    mart = spark.createDataFrame([("26001", "2019-01", 5, "a"), ("26001", "2019-01", 6, "a"), ("26003", "2019-01", None, None)],
                                 "county_fips string, m string, county_population int, population_vintage_window string")
    assert assertions.varying_denominators(mart, "m").count() == 1
    rates = spark.createDataFrame([(101.0,), (None,), (50.0,)], "r double")
    assert assertions.rates_out_of_range(rates, ["r"]).count() == 1


def test_dictionary_layers(spark):
    line = [("mart_ins", "fct", "table", 1, "n", "int", True, " ", "text"), ("stg", "stg_fin__x", "view", 1, "n", "int", True, None, ""),
            ("raw", "hlt_y", "table", 1, "n", "int", True, None, None), ("martial", "z", "table", 1, "n", "int", True, None, None)]
    found = {r.relation_name: (r.layer, r.track, r.is_documented) for r in data_dictionary(spark.createDataFrame(line, COLUMNS)).collect()}
    assert found == {"fct": ("mart", "insurance", True), "stg_fin__x": ("staging", "fintech", False),
                     "hlt_y": ("raw", "health", False), "z": ("other", "shared", False)}
