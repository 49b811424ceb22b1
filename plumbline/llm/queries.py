"""One query per operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import (
    chat_log,
    lattice_sampling,
    merkle,
    minhash,
    minimax_shards,
    ordinal_toxicity,
    periodic_runs,
    run_length_index,
    source_mix,
    spelling_variants,
    token_rollups,
    wavelet,
    weak_supervision,
)
from plumbline.llm.common import WORD, let_workers_import
from plumbline.session import materialise, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_wavelet(spark: SparkSession, folder: str) -> DataFrame:
    at = shared_folder(spark, "wavelet")
    wavelet.write_shards(_table(spark, folder, "documents"), at, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.read_documents(spark, at, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return minimax_shards.assign(_table(spark, folder, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    return weak_supervision.judge(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality", 6).alias("quality"))


def op4_ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = ordinal_toxicity.fit(docs, _table(spark, folder, "labels"))
    return ordinal_toxicity.score(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), "grade", "toxic")


def op5_bbit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), words=2, percent=80)


#: Tokenizer versions of the rollup query: words, and runs of letters, digits or other signs.
TOKENIZERS = {"words-1": WORD, "runs-1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+"}
SIGNS = r"[#*$%&|<>]+"


def op6_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """All documents go in, counts are revised to those without runs of symbols, copies of a smaller id go out."""
    text = F.coalesce("text", F.lit(""))
    cleaned = F.regexp_replace(text, SIGNS, "")
    counts = {f"{name}{suffix}": F.regexp_count(of, F.lit(pattern)).cast("long")
              for name, pattern in TOKENIZERS.items() for suffix, of in (("", text), (" revised", cleaned))}
    rows = materialise(_table(spark, folder, "documents").select(
        "doc_id", "source", "lang", F.sha2(text, 256).alias("text_hash"), *[c.alias(n) for n, c in counts.items()]), "token-counts")
    first = rows.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"))
    copies = rows.join(first, "text_hash").where("doc_id > first_id")
    rollups = token_rollups.Rollups(spark, shared_folder(spark, "rollups"))

    def batch(of: DataFrame, op: str, suffix: str) -> DataFrame:
        parts = [token_rollups.changes(of, op, name, F.col(f"`{name}{suffix}`"), F.col(f"`{name}`") if op == "revise" else None)
                 for name in TOKENIZERS]
        return parts[0].unionByName(parts[1])

    load = batch(rows, "insert", "")
    rollups.apply("1-load", load)
    rollups.apply("2-revise", batch(rows, "revise", " revised"))
    rollups.apply("1-load", load)  # sent again, as after a lost answer: changes nothing
    rollups.apply("3-copies", batch(copies, "delete", " revised"))
    return rollups.totals()


def op7_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, folder, "documents"))


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.taken_words(_table(spark, folder, "documents"))


def op9_run_length_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = run_length_index.cut_repeats(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_gumbel_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    samples = lattice_sampling.sample_segmentations(
        _table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return samples.select(
        "doc_id", "sample", F.expr("cast(octet_length(ids) div 2 as long)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"), *[F.round(c, 6).alias(c) for c in ("log_prob", "perturbed", "inclusion")])


def op11_chat_log(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one of control strings, as event logs, folded, rendered, and read back."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = chat_log.fold(chat_log.log_of(rows.unionByName(extra)))
    return chat_log.digests(chat_log.samples(messages))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(_table(spark, folder, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.word_counts(_table(spark, folder, "documents"), planted=199))


QUERIES: dict[str, Query] = {
    "op1_wavelet": op1_wavelet,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_quality_votes": op3_quality_votes,
    "op4_ordinal_toxicity": op4_ordinal_toxicity,
    "op5_bbit_minhash": op5_bbit_minhash,
    "op6_token_rollups": op6_token_rollups,
    "op7_merkle": op7_merkle,
    "op8_source_mix": op8_source_mix,
    "op9_run_length_dedup": op9_run_length_dedup,
    "op10_gumbel_segmentations": op10_gumbel_segmentations,
    "op11_chat_log": op11_chat_log,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}



def _escaped(text: str) -> str:
    return f"regexp_replace({text}, '{chat_log.PLAIN}', '\\1\\\\\\2\\3', 'g')"


def _leaves(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{merkle.PARAGRAPH}'), lambda p: sha256(p))"


_ROOT = """sha256(array_to_string(list_transform(list_filter(string_split(array_to_string(list_transform({0},
  lambda h: h || CASE WHEN h < '4' THEN '|' ELSE ',' END), ''), '|'), lambda s: s <> ''), lambda s: sha256(s)), ','))"""
_LIKENESS = """round(CASE WHEN len(list_distinct({0})) + len(list_distinct({1})) = 0 THEN 1.0 ELSE
  2.0 * len(list_intersect(list_distinct({0}), list_distinct({1}))) / (len(list_distinct({0})) + len(list_distinct({1}))) END, 9)"""

#: DuckDB SQL. Operators left out keep models, indexes or hashes that SQL has no words for.
ORACLE_SQL: dict[str, str] = {
    "op6_token_rollups": " UNION ALL ".join(f"""
SELECT * FROM (SELECT source, lang, '{name}' AS tokenizer, count(*) AS n_docs,
  sum(len(regexp_extract_all(regexp_replace(coalesce(text, ''), '{SIGNS}', '', 'g'), '{pattern}')))::BIGINT AS n_tokens
FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE coalesce(e.text, '') = coalesce(d.text, '') AND e.doc_id < d.doc_id)
GROUP BY source, lang)""" for name, pattern in TOKENIZERS.items()),
    "op7_merkle": f"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS t,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC),
             first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS nxt
  FROM documents),
edited AS (
  SELECT *, substring(t, 1, length(t) - length(t) // 2) || substring(nxt, 1, length(t) // 2) AS e FROM ordered),
leaved AS (
  SELECT *, {_leaves('t')} AS lt, {_leaves('e')} AS le, {_leaves('nxt')} AS ln FROM edited)
SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, {_ROOT.format('lt')} AS fingerprint,
  {_ROOT.format('le')} AS edited_fingerprint, {_LIKENESS.format('lt', 'le')} AS near_edited,
  {_LIKENESS.format('lt', 'ln')} AS near_next
FROM leaved""",
    "op11_chat_log": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
sized AS (
  SELECT *, {len(chat_log.BEGIN + chat_log.MIDDLE + chat_log.END)} + length({_escaped('role')}) + length({_escaped('text')}) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
}
