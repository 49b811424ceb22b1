"""Token counts kept as additive rollups: signed changes go in by batch, each batch once.

A change inserts a document, deletes one or revises its count. Per source, language and
tokenizer version a batch comes down to a signed number of documents and tokens, and totals
are sums over batches, so nothing that was counted is read again.

A batch is a folder named after its id. Spark's committer marks it complete (``_SUCCESS``); a
batch without the mark is not counted and is written anew when it is sent again, a batch with
the mark is never applied a second time. ``compact`` folds all complete batches into one more folder that lists what it replaces.

Null sources and languages are groups of their own; null counts are 0; a repeated change
inside one batch counts as often as it occurs; an empty batch commits and changes nothing.
Only the columns named below are read.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def changes(docs: DataFrame, op: str, tokenizer: str, tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """Rows of ``docs`` as changes of one kind: insert, delete, or revise from ``old_tokens``."""
    if op not in ("insert", "delete", "revise") or (op == "revise") != (old_tokens is not None):
        raise ValueError("op is insert, delete, or revise with old_tokens")
    return docs.select(F.lit(op).alias("op"), F.col("source").cast("string"), F.col("lang").cast("string"),
                       F.lit(tokenizer).alias("tokenizer"), tokens.cast("long").alias("tokens"),
                       (F.lit(0) if old_tokens is None else old_tokens).cast("long").alias("old_tokens"))


def deltas(change: DataFrame) -> DataFrame:
    """Signed documents and tokens per group; combined before the shuffle, so a hot source is one row per task."""
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    signed = F.when(F.col("op") == "insert", tokens).when(F.col("op") == "delete", -tokens).otherwise(tokens - old)
    return change.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(signed).cast("long").alias("n_tokens"))


class Rollups:
    """The batches under one folder of a store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _exists(self, text: str) -> bool:
        path = self._path(text)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _place(self, batch: str) -> str:
        return f"{self.folder}/batch={quote(batch, safe='')}"

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self._place(batch)}/_SUCCESS")

    def apply(self, batch: str, change: DataFrame) -> bool:
        """Commit a batch of changes; False if it was committed before, then nothing is done."""
        if self.committed(batch):
            return False
        deltas(change).write.mode("overwrite").parquet(self._place(batch))
        return True

    def _complete(self) -> list[str]:
        """Folders to sum: complete batches that no complete compaction replaces. One name per batch."""
        path = self._path(self.folder)
        if not self._exists(self.folder):
            return []
        found = [s.getPath().toString() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        done = sorted(p for p in found if self._exists(f"{p}/_SUCCESS"))
        replaced: set[str] = set()
        for place in done:
            if self._exists(f"{place}-replaces/_SUCCESS"):
                replaced |= {r.name for r in self.spark.read.text(f"{place}-replaces").toDF("name").collect()}
        return [p for p in done if not p.endswith("-replaces") and p.rsplit("/", 1)[1] not in replaced
                and ("/compact=" not in p or self._exists(f"{p}-replaces/_SUCCESS"))]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all complete batches; groups without documents go."""
        places = self._complete()
        rows = self.spark.read.schema(DELTAS).parquet(*places) if places else self.spark.createDataFrame([], DELTAS)
        return (rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 or n_tokens <> 0"))

    def compact(self, name: str) -> None:
        """Fold the complete batches into one. The list of what it replaces is written last and makes it count."""
        places = self._complete()
        if not places:
            return
        at = f"{self.folder}/compact={quote(name, safe='')}"
        self.spark.read.schema(DELTAS).parquet(*places).groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode("overwrite").parquet(at)
        names = [(p.rsplit("/", 1)[1],) for p in places]
        self.spark.createDataFrame(names, "value string").write.mode("overwrite").text(f"{at}-replaces")
