"""What the optimizer makes of the plans: pruning, joins and the absence of Python."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.operators.aggregates import exact_median
from plumbline.plans import marts_lending as lending
from plumbline.plans.marts_insurance import claims_detail
from plumbline.plans.staging import stage_claims
from plumbline.sources.readers import read_partitioned
from plumbline.sources.sinks import write_partitioned
from plumbline.testbed.frames import Testbed

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "claims_monthly", "claims_detail", "policies_in_force", "claim_declarations", "complaint_allocation",
    "complaints_by_county", "complaints_by_company", "complaints_daily", "company_matches", "lending_annual",
    "medicare_cost", "medicare_services", "state_vs_national", "need_vs_capacity", "median_by_status"])
def test_no_pairwise_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


def test_the_focus_slice_reads_one_partition_and_few_columns(spark, tmp_path):
    t = Testbed(spark, FOLDER)
    root = str(tmp_path / "claims")
    write_partitioned(t.raw("claims"), root, "state")
    detail = claims_detail(stage_claims(read_partitioned(spark, root)), t.prices, t.counties, t.params)
    text = plan(detail.select("claim_id", "total_amount_paid"))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "amountPaid" in line)
    assert "state" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    schema = scan.split("ReadSchema:")[1]
    assert "id:" in schema and "ratedFloodZone" not in schema


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["membership_filters"](spark, FOLDER))
    assert "EqualTo(l_returnflag,R)" in text


def test_a_hot_group_is_counted_before_it_is_ordered(spark):
    # A third of the rows in one group, all of one value: one row survives the first shuffle.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("k"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    found = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    assert found["hot"] == 7.0
    exchanges = [line for line in plan(exact_median(df, ["k"], "v", "m")).splitlines() if "Exchange hashpartitioning" in line]
    assert any("_v" in line or "_groupingexpression" in line for line in exchanges)


def test_unread_medians_are_not_computed(spark):
    t = Testbed(spark, FOLDER)
    whole = lending.lending_annual(t.lending, t.institutions, t.counties, t.params)
    counts = lending.lending_annual(t.lending, t.institutions, t.counties, t.params, medians=False)
    assert counts.columns == whole.drop("median_originated_amount", "median_applicant_income").columns
    assert sorted(map(str, counts.collect())) == sorted(map(str, whole.select(*counts.columns).collect()))
    assert "median_originated_amount" in plan(whole) and "median_originated_amount" not in plan(counts)
