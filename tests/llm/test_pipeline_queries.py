"""The registered queries on the smallest tables: against their SQL, or by their contracts."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from plumbline.llm.queries import ORACLE_SQL, QUERIES
from plumbline.testbed.compare import difference, duckdb_over

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_all_are_registered():
    assert QUERIES.items() <= entry.queries().items() and ORACLE_SQL.items() <= entry.oracle_sql().items()
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), duckdb_over(FOLDER), ORACLE_SQL[name]) is None


CONTRACTS = {
    "op1_wavelet": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2_minimax_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_quality_votes": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                         "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_ordinal_toxicity": "doc_id bigint, severity double, grade int, toxic boolean",
    "op5_bbit_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_run_length_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_one_row_per_document_with_the_agreed_columns(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert set(CONTRACTS[name].split(", ")) <= {" ".join(c) for c in df.dtypes}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
