import datetime as dt
import hashlib
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import aggregates, joins
from plumbline.operators.aggregates import exact_median, group_total, stitch_groups
from plumbline.operators.reshape import unpivot_named
from plumbline.operators.sampling import Stratum, sample_per_group, stratified_sample, stratum_counts
from plumbline.operators.windows import top_per_group
from plumbline.plans.intermediate import decode_measure


def test_exact_median_against_brute_force(spark, rows):
    seed = random.Random(7)
    data = [("hot" if i % 3 else f"g{i % 5}", seed.choice([None, 0.0, -3.5, 1e9, seed.uniform(-50, 50), 7.25]))
            for i in range(900)] + [(None, 4.0), (None, 6.0), ("empty", None)]
    df = spark.createDataFrame(data, "k string, v double")
    expected = {}
    for k, v in data:
        if v is not None:
            expected.setdefault(k, []).append(v)
    found = dict(rows(exact_median(df, ["k"], "v", "m")))
    assert found == {k: statistics.median(v) for k, v in expected.items()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30))
def test_exact_median_of_any_list(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    assert exact_median(df, ["k"], "v", "m").first().m == statistics.median(values)


def test_exact_median_divides_full_bins(spark, rows):
    seed = random.Random(9)
    wide = [seed.uniform(1.0, 1.01) for _ in range(701)]
    tight = [1.0 + i * 2.0 ** -52 for i in range(400)]
    data = [("wide", v) for v in wide] + [("tight", v) for v in tight] + [(None, -v) for v in wide[:300]] + [("one", 2.5), ("many", 4.0)] * 90
    data += [("ends", v) for v in (1.0, 1.005, float("inf"), float("inf"), float("nan"))]
    df = spark.createDataFrame(data, "k string, v double")
    expected = {"wide": statistics.median(wide), "tight": statistics.median(tight), None: statistics.median(-v for v in wide[:300]),
                "one": 2.5, "many": 4.0, "ends": float("inf")}
    for ordered in (1, 20):
        assert dict(rows(exact_median(df, ["k"], "v", "m", ordered=ordered))) == expected


def test_no_task_orders_a_hot_group(spark):
    """Two million different values between 1.00 and 1.01: divided bins hold few, and the plan orders only them."""
    n = 2_000_001
    df = spark.range(0, n, 1, 8).select(F.lit("hot").alias("k"), (1 + F.col("id") * 0.01 / n).alias("v"))
    counts = df.withColumn("_n", F.lit(1)).withColumn("_bin0", F.lit(0))
    middle = F.struct(F.lit("hot").alias("k"), F.lit(0).alias("_bin0"), F.lit(1.0).alias("_least"), F.lit(1.01).alias("_most"), F.lit(0).alias("_before"),
                      F.lit(n // 2 + 1).alias("_lo"), F.lit(n // 2 + 1).alias("_hi"))
    fine = aggregates._divided(counts.withColumnRenamed("v", "_v"), spark.range(1).select(middle.alias("m")).select("m.*"), ["k", "_bin0"], 1)[1]
    assert [r._values <= 64 for r in fine.collect()] == [True]
    assert exact_median(df, ["k"], "v", "m", ordered=1000).first().m == pytest.approx(1.005, abs=1e-8)


def test_stitched_groups_keep_null_keys(spark, rows):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, n int")
    b = spark.createDataFrame([(None, 9.5)], "k string, m double")
    assert rows(stitch_groups([a, b], ["k"]), "k", "n", "m") == [("x", 1, None), (None, 2, 9.5)]


def test_month_ends_inside_a_term(spark, rows):
    day = dt.date
    df = spark.createDataFrame([
        ("to_month_end", day(2020, 1, 15), day(2020, 3, 31)), ("one_day", day(2020, 1, 31), day(2020, 2, 1)),
        ("inside_month", day(2020, 1, 2), day(2020, 1, 20)), ("past_horizon", day(2020, 4, 1), day(2025, 1, 1))],
        "k string, b date, e date")
    found = rows(joins.explode_month_ends(df, "b", "e", F.lit(day(2020, 5, 31))), "k", "month_end")
    assert found == [("one_day", day(2020, 1, 31)), ("past_horizon", day(2020, 4, 30)), ("past_horizon", day(2020, 5, 31)),
                     ("to_month_end", day(2020, 1, 31)), ("to_month_end", day(2020, 2, 29))]


def test_month_ends_match_a_calendar_join(spark, rows):
    seed = random.Random(3)
    base = dt.date(2019, 1, 1)
    data = [(i, base + dt.timedelta(seed.randrange(900)), seed.randrange(1, 700)) for i in range(120)]
    terms = [(i, b, b + dt.timedelta(n)) for i, b, n in data]
    horizon = dt.date(2021, 6, 15)
    ends = [d for d in (base + dt.timedelta(i) for i in range(1500)) if (d + dt.timedelta(1)).day == 1]
    expected = sorted(((i, m) for i, b, e in terms for m in ends if b <= m < e and m <= horizon), key=repr)
    df = spark.createDataFrame(terms, "i int, b date, e date")
    assert rows(joins.explode_month_ends(df, "b", "e", F.lit(horizon)), "i", "month_end") == expected


def test_events_match_brute_force(spark, rows):
    seed = random.Random(11)
    base = dt.date(2000, 1, 1)
    claims = [(i, "MI", seed.choice(["26001", "26003", None]), base + dt.timedelta(seed.randrange(400))) for i in range(150)]
    areas = [(n, "MI", seed.choice(["26000", "26001", "26003"]), b, b + dt.timedelta(seed.randrange(-5, 200)))
             for n, b in ((n, base + dt.timedelta(seed.randrange(380))) for n in range(12))]
    areas.append(areas[0])  # an area listed twice matches twice
    expected = sorted(((c[0], a[0]) for c in claims for a in areas
                       if (a[2] == "26000" or a[2] == c[2]) and a[3] <= c[3] <= a[4]), key=repr)
    left = spark.createDataFrame(claims, "c int, state string, county string, d date")
    right = spark.createDataFrame(areas, "a int, state string, county string, b date, u date").withColumn(
        "sw", F.col("county").endswith("000"))
    found = joins.match_events(left, right, "d", "b", "u", "state", "county", "sw")
    assert rows(found, "c", "a") == expected


def test_a_storm_is_cut_into_slices(spark, rows):
    # Two in five facts lie in one month of one state; its slices hold no more than other tasks do.
    base, slices = dt.date(2000, 1, 1), 10
    claims = [(i, "MI" if i % 5 < 2 else f"S{i % 40}", f"c{i % 3}", base + dt.timedelta(i % 28 if i % 5 < 2 else i * 7 % 2000)) for i in range(3000)]
    areas = [(1, "MI", None, base, base + dt.timedelta(20), True), (2, "MI", "c1", base, base + dt.timedelta(40), False),
             (3, "S7", "c2", base + dt.timedelta(100), base + dt.timedelta(900), False), (3, "S7", "c2", base, base + dt.timedelta(5), False)]
    left = spark.createDataFrame(claims, "c int, state string, county string, d date")
    right = spark.createDataFrame(areas, "a int, state string, county string, b date, u date, sw boolean")
    expected = sorted(((c[0], a[0]) for c in claims for a in areas
                       if c[1] == a[1] and (a[5] or a[2] == c[2]) and a[3] <= c[3] <= a[4]), key=repr)
    found = joins.match_events(left, right, "d", "b", "u", "state", "county", "sw", slices)
    assert rows(found, "c", "a") == expected
    keyed = left.select("state", F.trunc("d", "MM").alias("m"), F.xxhash64("state", F.trunc("d", "MM")).alias("k"))
    parts = F.coalesce(F.try_element_at(joins.hot_slices(keyed, "k", slices), F.col("k")), F.lit(1))
    dealt = keyed.withColumn("slice", F.pmod(F.monotonically_increasing_id(), parts)).groupBy("k", "slice").count()
    assert dealt.agg(F.max("count")).first()[0] <= 2 * len(claims) / slices
    assert keyed.groupBy("k").count().agg(F.max("count")).first()[0] > 4 * len(claims) / slices - 100


def test_event_totals_are_those_of_all_pairs(spark, rows, monkeypatch):
    seed, base = random.Random(5), dt.date(2000, 1, 1)
    claims = [("MI", seed.choice(["26001", "26003", None]), seed.choice([None, base + dt.timedelta(seed.randrange(60))])) for _ in range(3000)]
    areas = [(n % 90, "MI", seed.choice(["26000", "26001", "26003", None]), b, seed.choice([None, b + dt.timedelta(seed.randrange(-3, 45))]))
             for n, b in ((n, base + dt.timedelta(seed.randrange(5))) for n in range(400))]
    left = spark.createDataFrame(claims, "state string, county string, d date")
    right = spark.createDataFrame(areas, "a int, state string, county string, b date, u date").withColumn("sw", F.col("county") == "26000")
    expected = {}
    for _, place, day in claims:
        for event, _, county, begin, until in areas:
            if day and until and county and (county == "26000" or county == place) and begin <= day <= until:
                expected.setdefault((place, county == "26000"), []).append((event, (day - begin).days))
    pairs = []

    def counted(*args):
        pairs.append(match_events(*args))
        return pairs[-1]

    match_events = joins.match_events
    monkeypatch.setattr(joins, "match_events", counted)
    found = joins.event_totals(left, right, "d", "b", "u", "state", "county", "sw", "a")
    assert rows(found, "county", "sw", "matches", "days_in", "events") == sorted(
        ((*k, len(v), sum(d for _, d in v), len({e for e, _ in v})) for k, v in expected.items()), key=repr)
    # Copies of facts and events add no rows to the join.
    [once] = pairs
    joins.event_totals(left.unionAll(left), right.unionAll(right), "d", "b", "u", "state", "county", "sw", "a")
    assert pairs[1].count() == once.count() < sum(map(len, expected.values())) / 4


def test_only_groups_with_inner_values_are_ordered(spark, rows, monkeypatch):
    seed = random.Random(3)
    data = [(seed.choice(["hot", None]), None, seed.uniform(-9, 9), seed.choice([None, 5.0])) for _ in range(300)]
    data += [("one", "x", 4.0, None), ("two", "x", 1.0, 2.0), ("two", "x", 8.0, None), ("none", "x", None, None)]
    data += [("same", "x", 7.0, v) for v in (1.0, 2.0, 6.0)] + [("equal", "x", 7.0, 7.0)] * 5
    df = spark.createDataFrame(data, "k string, j string, v double, w double")
    ordered = []

    def watched(rows, *args):
        ordered.append(rows)
        return exact_median(rows, *args)

    monkeypatch.setattr(aggregates, "exact_median", watched)
    found = aggregates.exact_medians(df, ["k", "j"], ["v", "w"])
    best = found.groupBy("k", "j").agg(F.max("v").alias("v"), F.max("w").alias("w"))
    assert {r[0] for r in ordered[0].select("k").distinct().collect()} == {"hot", None, "same"}

    def middle(k, c):
        values = [r[c] for r in data if r[0] == k and r[c] is not None]
        return statistics.median(values) if values else None

    assert rows(best) == sorted(((k, j, middle(k, 2), middle(k, 3)) for k, j in (("hot", None), (None, None), ("same", "x"))), key=repr)


def test_content_digests_see_what_sums_do_not(spark):
    rows = [("a", 1, "x", None), ("a", 2, "y", ""), ("b", 3, None, "z")]
    schema = "k string, n int, s string, t string"

    def digests(data, parts=3):
        df = spark.createDataFrame(data, schema).repartition(parts)
        return {r.partition_key: r.content_digest for r in aggregates.profile(df, "k", ["n"], content=True).collect()}

    same = digests(rows)
    assert digests(rows[::-1], 1) == same
    for changed in ([("a", 1, "y", None), ("a", 2, "x", ""), rows[2]], [("a", 1, "x", ""), *rows[1:]], [rows[0], rows[0], rows[2]],
                    [*rows[:2], ("b", 3, "z", None)], [rows[0], rows[1], rows[1], rows[2]]):
        assert digests(changed) != same
    # Digests are sums of limbs, so those of two loads add up to that of both.
    def limbs(data):
        return [int(x) for x in digests(data)["a"].split(":")]

    assert [x + y for x, y in zip(limbs(rows[:1]), limbs(rows[1:2]), strict=True)] == limbs(rows[:2])


def test_clamped_vintages(spark, rows):
    facts = spark.createDataFrame([("a", 1990), ("a", 2005), ("a", 2030), ("b", 2005), (None, 2005)], "county_fips string, y int")
    vintages = spark.createDataFrame([("a", 2000, 5), ("a", 2005, 6), ("a", 2010, 7)], "k string, vintage_year int, n int")
    found = joins.attach_clamped(facts, vintages, "y", "k", "vintage_year", ["n"], "far", fact_key="county_fips")
    assert rows(found) == [("a", 1990, 5, True), ("a", 2005, 6, False), ("a", 2030, 7, True), ("b", 2005, None, False), (None, 2005, None, False)]


def test_a_stratified_sample_sorts_no_input(spark, rows):
    df = spark.range(5000).selectExpr("id % 2500 AS a", "if(id % 7 = 0, NULL, id % 3) AS b")
    strata = [Stratum("twos", F.col("b") == 2, 3), Stratum("all", F.lit(True), 10), Stratum("none", F.col("b") == 9, 5)]
    found = stratified_sample(df, strata)
    text = [("|".join("~" if v is None else str(v) for v in r), tuple(r)) for r in df.collect()]
    best = sorted((hashlib.md5(t.encode()).hexdigest(), r) for t, r in text)
    assert rows(found) == sorted({r for _, r in [b for b in best if b[1][1] == 2][:3] + best[:10]}, key=repr)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("TakeOrderedAndProject") == len(strata) and "Window" not in plan


def test_missing_keys_survive_a_lookup(spark, rows):
    facts = spark.createDataFrame([(None, i) for i in range(20)] + [("a", 20), ("z", 21)], "k string, n int")
    found = joins.left_lookup(facts, spark.createDataFrame([("a", "A")], "k string, name string"), "k")
    assert [r for r in rows(found, "n", "name") if r[1]] == [(20, "A")] and found.count() == 22


def test_constant_dollars_need_both_years(spark, rows):
    index = spark.createDataFrame([(2000, 100.0), (2001, 110.0)], "_index_year int, _index double")
    facts = spark.createDataFrame([(2001, 11.0), (1950, 5.0)], "y int, v double")
    assert rows(joins.constant_dollars(facts, index, "y", {"c": F.col("v")}, 2000)) == [(1950, 5.0, None), (2001, 11.0, 10.0)]
    assert {r[2] for r in rows(joins.constant_dollars(facts, index, "y", {"c": F.col("v")}, 1999))} == {None}


def test_group_total_keeps_every_row(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert rows(group_total(df, ["k"], F.sum("v"), "t")) == [("a", 1, 3), ("a", 2, 3), ("b", 5, 5)]


def test_unpivot_drops_missing_cells(spark, rows):
    df = spark.createDataFrame([("k", "1", None)], "id string, a string, b string")
    assert rows(unpivot_named(df, ["id"], ["a", "b"])) == [("k", "a", "1")]


def test_measure_names_decode():
    assert decode_measure("TOT_MDCR_STDZD_PYMT_PC") == ("TOT", "per_capita", True)
    assert decode_measure("SNF_MDCR_PYMT_PCT") == ("SNF", "share_of_pymt", False)
    assert decode_measure("HH_MDCR_STDZD_PYMT_PU") == ("HH", "per_user", True)
    assert decode_measure("IP_CVRD_STAYS_PER_1000_BENES") == ("IP", "per_1000", False)
    assert decode_measure("BENES_IP_CVRD_STAY_CNT") == ("IP", "user_count", False)
    assert decode_measure("BENES_ER_VISITS_PCT") == ("ER", "user_pct", False)
    assert decode_measure("PTB_OTHR_SRVCS_MDCR_PYMT") == ("PTB_OTHR_SRVCS", "amount", False)
    assert decode_measure("PRCDR_EVNTS_PER_1000_BENES")[0] == "PRCDRS"


def test_samples_do_not_depend_on_partitioning(spark, rows):
    df = spark.createDataFrame([("MI", "a"), ("MI", "b"), ("OH", "c"), ("OH", "d"), ("UN", "e")], "state string, tag string")
    strata = [Stratum("michigan", F.col("state") == "MI", 2), Stratum("unknown", F.col("state") == "UN", 5),
              Stratum("spread", F.lit(True), 3), Stratum("none", F.col("state") == "TX", 3)]
    first = rows(stratified_sample(df, strata))
    assert first == rows(stratified_sample(df.repartition(7), strata))
    assert {("MI", "a"), ("MI", "b"), ("UN", "e")} <= set(first) and len(first) == len(set(first))
    counts = {r[0]: r[1:] for r in rows(stratum_counts(df, strata))}
    assert counts["none"] == (0, 0, True) and counts["michigan"] == (2, 2, False)
    assert len(rows(sample_per_group(df, ["state"], 1))) == 3


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    top = top_per_group(df, ["g"], [F.col("id")], 2)
    assert top.count() == 6
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_median_of_values_that_are_not_finite(spark, rows):
    nan, inf = float("nan"), float("inf")
    groups = {"a": [1.0, 2.0, inf], "b": [1.0, 2.0, nan], "c": [-inf, 5.0, 7.0], "d": [nan, nan, 1.0, inf], "e": [0.001, 0.002, 0.0031, -0.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    found = dict(rows(exact_median(df, ["k"], "v", "m"), "k", "m"))
    assert (found["a"], found["b"], found["c"]) == (2.0, 2.0, 5.0)
    assert found["d"] != found["d"] and abs(found["e"] - 0.0015) < 1e-12


def test_bins_split_small_shares(spark):
    from plumbline.operators.aggregates import _magnitude_bin

    df = spark.range(1, 10_001).select((F.col("id") / 1_000_000).alias("v")).withColumn("bin", _magnitude_bin(F.col("v")))
    assert df.select("bin").distinct().count() > 500
    assert df.withColumn("next", F.lead("bin").over(Window.orderBy("v"))).where("next < bin").count() == 0
