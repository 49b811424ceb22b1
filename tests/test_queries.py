"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from plumbline.plans.build import build_all
from plumbline.plans.conformed import county_universe
from plumbline.testbed.check_queries import _SOURCES
from plumbline.testbed.compare import difference, duckdb_over
from plumbline.testbed.frames import Testbed
from plumbline.testbed.queries import ENTRIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
# Queries of the optional subpackage are tested beside it.
QUERIES = {name: query for name, query in entry.queries().items() if name in ENTRIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in ENTRIES}


@pytest.fixture(scope="module")
def duck():
    return duckdb_over(FOLDER)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, SQL[name]) is None


def test_queries_without_sql_return_rows(spark):
    for name in QUERIES.keys() - SQL.keys():
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_whole_build(spark):
    t = Testbed(spark, FOLDER)
    raw = {source: t.raw(name) for source, name in _SOURCES.items()} | {"cpi_u_series": t.raw("price_series")}
    built = build_all(spark, raw, t.params)
    assert len(built) == 4 + 2 + 17 + 1
    assert built["mart_fin.fct_fin_complaints_daily_state"].count() > 0
    layers = {r.layer for r in built["meta.meta_dictionary"].select("layer").distinct().collect()}
    assert layers == {"conformed", "intermediate", "mart"}
    staged = spark.table("stg_ins__nfip_claims")
    assert staged.count() == raw["nfip_claims"].count()


def test_build_without_some_sources(spark):
    t = Testbed(spark, FOLDER)
    built = build_all(spark, {"fema_declarations": t.raw("declarations"), "cdc_healthy_aging": t.raw("indicators")}, t.params)
    assert set(built) == {
        "conformed.dim_date", "conformed.dim_period", "conformed.dim_state", "mart_ins.dim_ins_disaster_declaration",
        "mart_hlt.fct_hlt_cdc_indicators", "mart_hlt.fct_hlt_cdc_mi_vs_national", "meta.meta_dictionary"}


def test_county_references_are_scanned_once(spark):
    t = Testbed(spark, FOLDER)
    raw = [t.raw(n) for n in ("claims", "policies", "declarations", "medicare", "lending", "crosswalk")]
    for (name, df), (written_name, written) in zip(county_universe(*raw, t.population_65), t.referenced, strict=True):
        assert name == written_name and written.columns == df.columns
        assert set(df.distinct().collect()) == set(written.collect())
        assert written.inputFiles() and all("/referenced-counties-" in f for f in written.inputFiles())
