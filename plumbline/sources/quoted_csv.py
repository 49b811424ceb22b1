"""Delimited files with newlines inside quotes, each file read by as many tasks as it has blocks.

A newline ends a record only outside quotes, and whether a line begins outside quotes depends
on all quotes before it in its file. Two passes answer that without reading a file in order:

1. Quotes are counted per block of a file (one row per block). The running sum over the blocks
   of a file says whether each block begins inside quotes. A doubled quote counts twice, so it
   changes nothing.
2. Inside each block, lines are numbered by record: a line that begins outside quotes begins a
   record. Lines of one record are joined. What a block begins with inside quotes belongs to
   the record left open before it; only these edges meet once more, by file.

The rule needs quotes as RFC 4180 has them: only around whole fields, doubled inside.
``misquoted_records`` finds the records that break it. Line feeds separate lines. In a file whose
first line ends with a carriage return and a line feed, both are read as a line feed everywhere,
inside quotes too, as the multi-line reader does. Empty records are skipped. A last record
without its closing quote runs to the end of the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.readers import header_of

QUOTE = '"'


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(QUOTE), F.lit("")))


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, block (its first byte), place (ascending inside a block), line, quotes."""
    text = spark.read.text(path if isinstance(path, str) else list(path), lineSep="\n")
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"), _quotes(F.col("value")).alias("quotes"))


def block_states(lines: DataFrame) -> DataFrame:
    """file, block, inside (1 where the block begins inside quotes), returns (whether the file's first line ends with one).

    One row per block.
    """
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("quotes").over(along) - F.col("quotes")
    return (lines.groupBy("file", "block")
            .agg(F.sum("quotes").alias("quotes"), F.min_by(F.endswith("line", F.lit("\r")), "place").alias("returns"))
            .select("file", "block", (upto % 2).alias("inside"), F.first("returns").over(along).alias("returns")))


def _joined(place: str, line: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(line).alias("line"))))
    return F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")


def quoted_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, block, number, record: the text of every record, under the block it begins in.

    ``number`` counts the records of a block from 1, so a file begins with block 0, number 1.
    """
    lines = _lines(spark, path)
    states = block_states(lines)
    upto = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    after = (F.col("inside") + F.sum("quotes").over(upto)) % 2
    begins = F.when((F.col("after") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    # The lines of a block are one partition of the scan and one group here; a group holds whole
    # records but for its edges, so the records are grouped without another shuffle.
    line = F.when(F.col("returns"), F.regexp_replace("line", "\r\\z", "")).otherwise(F.col("line"))
    numbered = (lines.join(states, ["file", "block"]).withColumn("line", line).withColumn("after", after)
                .withColumn("number", F.sum(begins).over(upto)))
    parts = numbered.groupBy("file", "block", "number").agg(
        _joined("place", "line").alias("record"), (F.max_by("after", "place") == 1).alias("open"))
    is_edge = F.col("open") | (F.col("number") == 0)
    whole = parts.where(~is_edge).select("file", "block", "number", "record")
    # An open record takes what the next blocks begin with: a few rows per block, none of them whole.
    along = Window.partitionBy("file").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, 0)
    owned = parts.where(is_edge).withColumn("owner", F.sum(F.when(F.col("number") > 0, 1).otherwise(0)).over(along))
    first = F.min(F.struct("block", "number"))
    stitched = (owned.groupBy("file", "owner").agg(first.alias("first"), _joined("block", "record").alias("record"))
                .select("file", "first.block", "first.number", "record"))
    return whole.unionByName(stitched)


def misquoted_records(records: DataFrame, separator: str = ",") -> DataFrame:
    """The records with quotes elsewhere than around whole fields, where a reader may differ from another."""
    marked = F.regexp_replace("record", f'{QUOTE}[^{QUOTE}]*+{QUOTE}', "\u0001")
    other = f"[^{separator}\u0001]"
    return records.where(F.col("record").contains(QUOTE)).where(
        marked.contains(QUOTE) | marked.rlike(f"{other}\u0001|\u0001{other}"))


def read_quoted_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                    separator: str = ",") -> DataFrame:
    """Delimited files with a header line each and every column as text, as the multi-line reader has them."""
    first = path if isinstance(path, str) else path[0]
    names = list(columns) if columns is not None else header_of(spark, first, separator)
    rows = quoted_records(spark, path).where((F.col("block") > 0) | (F.col("number") > 1)).where("record <> ''")
    options = {"sep": separator, "quote": QUOTE, "escape": QUOTE, "multiLine": "true"}
    return rows.select(F.from_csv("record", _ddl(names), options).alias("row")).select("row.*")


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
