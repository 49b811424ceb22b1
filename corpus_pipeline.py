"""From documents to training samples: five stages, each written and read again by the next.

1. Quality rules: documents that fail the base rule or whose posterior quality is low go.
2. Near duplicates (5-word shingles, similarity 0.8): the first document of each group stays.
3. Repeated passages: bytes covered by a 200-byte string that starts twice are cut out.
4. Source mix: every document as often, and of the last one as much, as its source's target says.
5. SentencePiece: three sampled segmentations of every text.

Nulls, empty texts, repeated rows and empty tables are handled as the operators say. Further
columns of the table travel along unchanged up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import lattice_sampling, minhash, run_length_index, source_mix, weak_supervision
from plumbline.llm.common import let_workers_import
from plumbline.session import Scratch, delete_folders, materialise


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders that the stage before wrote for itself.
_left: list[str] = []


def _stage(make: Callable[[DataFrame], DataFrame]) -> Stage:
    """A stage, which begins by deleting what the one before left: its result is written by then.

    Folders that ``docs`` itself still reads are kept, should a caller not have written them.
    """
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_workers_import(spark)
        read = docs.inputFiles() if _left else []
        delete_folders(spark, [f for f in _left if not any(f.rpartition("/")[2] in path for path in read)])
        with Scratch(spark) as scratch:
            result = make(docs)
        _left[:] = scratch.folders
        return result

    return run_stage


quality_rules = _stage(weak_supervision.keep_good)
near_duplicates = _stage(lambda docs: minhash.keep_one_of_each(docs, words=5, percent=80))
repeated_passages = _stage(run_length_index.cut_documents)
source_weights = _stage(source_mix.mixed_documents)
segmentations = _stage(lambda docs: lattice_sampling.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model")))

STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_weights", source_weights),
    ("segmentations", segmentations),
]

#: SQL has no words for the quality model, the sampled segmentations and the index.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
