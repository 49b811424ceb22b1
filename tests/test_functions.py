from pyspark.sql import functions as F

from plumbline.functions import typed
from plumbline.functions.dates import price_period
from plumbline.functions.flags import income_bracket, payment_flags, percent, value_at_max
from plumbline.functions.text import normalize_company_name, packed, snake_case, unpacked


def test_snake_case_follows_words_and_acronyms():
    names = {
        "amountPaidOnBuildingClaim": "amount_paid_on_building_claim",
        "originalNBDate": "original_nb_date",
        "postFIRMConstructionIndicator": "post_firm_construction_indicator",
        "lastIAFilingDate": "last_ia_filing_date",
        "co-applicant_ethnicity-1": "co_applicant_ethnicity_1",
        "derived_msa-md": "derived_msa_md",
    }
    assert {k: snake_case(k) for k in names} == names


def test_numbers_sentinels_and_whole_numbers(spark, rows):
    df = spark.createDataFrame(
        [("1.5065E7",), (".45",), ("Exempt",), ("NA",), (" 12 ",), ("",), (None,), ("36.5",), ("1e3",)], "x string")
    out = rows(df.select("x", *typed.number_and_sentinel("n", F.col("x"), ("Exempt", "NA")), typed.as_whole(F.col("x")).alias("w")))
    found = {r[0]: r[1:] for r in out}
    assert found["1.5065E7"] == (15065000.0, None, 15065000)
    assert found[".45"][0] == 0.45
    assert found["Exempt"] == (None, "Exempt", None)
    assert found["36.5"][2] == 37 and found["1e3"][2] == 1000
    assert found[None] == (None, None, None) and found[""] == (None, None, None)


def test_zip_masks(spark, rows):
    zips = ["48201", "481XX", "XXXXX", None, "4820", "N/A"]
    df = spark.createDataFrame([(z,) for z in zips], "z string")
    kinds = dict(rows(df.select("z", typed.zip_mask_kind(F.col("z")))))
    assert kinds == {"48201": "full", "481XX": "prefix_masked", "XXXXX": "fully_masked", None: "null",
                     "4820": "malformed", "N/A": "malformed"}
    assert dict(rows(df.select("z", typed.zip3(F.col("z")))))["4820"] == "482"


def test_company_names(spark, rows):
    df = spark.createDataFrame([("ACME, Inc.",), ("Acme Bank, N.A.",), ("***",), ("US",), (None,), ("Co-Op Holdings Group",)], "n string")
    found = dict(rows(df.select("n", normalize_company_name(F.col("n")))))
    assert found["ACME, Inc."] == "acme"
    assert found["***"] is None and found[None] is None
    assert found["US"] == "us"
    # A dropped word takes the blank after it, so the next suffix stays.
    assert found["Co-Op Holdings Group"] == "co op group"


def test_payment_states(spark, rows):
    df = spark.createDataFrame([
        ("unpaid", None, None, None, "01", None), ("unexplained", None, None, None, None, None),
        ("zero", 0.0, 0.0, 0.0, None, None), ("negative", -5.0, 1.0, 1.0, None, None)],
        "k string, b double, c double, i double, rb string, rc string")
    flags = payment_flags(F.col("b"), F.col("c"), F.col("i"), F.col("rb"), F.col("rc"))
    found = {r[0]: r[1:] for r in rows(df.select("k", *[f.alias(n) for n, f in flags.items()]))}
    assert found == {"unpaid": (True, False, False, False), "unexplained": (False, True, False, False),
                     "zero": (False, False, True, False), "negative": (False, False, False, True)}


def test_brackets_and_rates(spark, rows):
    df = spark.createDataFrame([(10.0, 50000.0), (30.0, 50000.0), (50.0, 50000.0), (70.0, 50000.0), (None, 1.0), (5.0, 0.0)],
                               "i double, m double")
    found = [r[2] for r in sorted(rows(df.select("i", "m", income_bracket(F.col("i"), F.col("m")))), key=lambda r: (r[0] or 0, r[1]))]
    assert found == [None, "upper", "low", "moderate", "middle", "upper"]
    assert spark.range(1).select(percent(F.lit(1), F.lit(0))).first()[0] is None


def test_price_periods(spark):
    df = spark.createDataFrame([("M01 ",), ("M13",), ("S01",)], "p string")
    parts = price_period(F.col("p"), F.lit("1999"))
    out = [tuple(r) for r in df.select(*[c.alias(n) for n, c in parts.items()]).collect()]
    assert out == [("M01", "month", 1, "1999-01"), ("M13", "annual_average", None, "1999"), ("S01", "semiannual", None, None)]


def test_latest_value_skips_missing_ones(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "y int, v string")
    assert df.agg(value_at_max(F.col("v"), F.col("y"))).first()[0] == "a"


def test_annotations_are_not_margins(spark, rows):
    df = spark.createDataFrame([("-555555555",), ("12",), (None,)], "m string")
    found = rows(df.select("m", typed.annotated_margin(F.col("m")), typed.is_annotated(F.col("m"))))
    assert ("-555555555", None, True) in found and ("12", 12, False) in found and (None, None, False) in found


def test_words_are_told_from_numbers_without_a_cast(spark):
    texts = ["36", "-1.5", "+.5", "5.", "1e3", " 7 ", "\t8\n", "9\x7f", "NaN", "nan", "Infinity", "-inf", "1d", "2F", "0x1p3", "-0X1.8P1", "1.2.3",
             "20%-<30%", ">60%", "5-24", ">149", "NA", "Exempt", "", " ", ".", "-", "e5", "1e", "1,000", "٣", "9223372036854775808", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    text = F.col("t")
    columns = {"n": (typed.banded_number(text), text.try_cast("double")), "w": (typed.banded_whole(text), typed.as_whole(text)),
               "a": (typed.as_number(text, ("NA", "Exempt")), text.try_cast("double"))}
    for name, (found, cast) in columns.items():
        assert df.where(~found.eqNullSafe(cast)).collect() == [], name
    # What is published as a band or a word for a number reaches no cast, which would raise inside.
    for shape in ("20%-<30%", ">60%", "5-24", ">149", "NA", "Exempt"):
        assert not spark.range(1).select(F.lit(shape).rlike(typed.NUMBER_SHAPE)).first()[0]


def test_packed_columns_come_back(spark, rows):
    values = [None, "", "Usual", "it's usual", "0", "=", "=0", "\u0001", "\u0002", "\u0002a\u0001b", "Other, label"]
    data = [(a, b, a) for a in values for b in values]
    df = spark.createDataFrame(data, "a string, b string, c string")
    columns = {"a": ["Usual", "it's usual"], "b": [], "c": ["Other, label"]}
    text = df.select(packed(columns).alias("t"))
    assert text.distinct().count() == len(data)
    assert rows(text.select(*unpacked(F.col("t"), columns))) == sorted(data, key=repr)
    assert df.where("a = 'Usual' AND b = '0'").select(packed(columns)).first()[0] == "0\u0001=0\u0001=Usual"
