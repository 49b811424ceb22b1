"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every source is a stream of words: its documents in the order of a seeded hash, laid end to
end and cut in blocks of ``block_words`` (the last block of a stream may be shorter). A
schedule of slots asks sources for blocks: slot i stands at the point frac(i * c) of [0, 1),
c the golden-ratio constant, and belongs to the source whose interval of cumulative weight
holds the point. So every stretch of the schedule has the sources near their shares. The
r-th slot of a source takes its r-th block; a source that runs out starts over, until each of
its blocks was taken ``max_epochs`` times.

Nothing orders a hot source in one task: positions come from ``running_total``, ranks from
counts per stretch of slots plus a window inside the stretch.

A null text has no words, a document without words is taken 0 times. A null source is a
source of its own and comes last. Every row is a document of its own, under a key that is
written with its size: rows that repeat an id stand beside each other in the stream, and a row
without an id is laid out by its text, so it is taken like any other. An empty table gives an
empty result. Only id, text and source are read, plus what ``mixed_documents`` copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ROW_KEY, WORD, bucket_bits, n_words, running_total, with_row_key
from plumbline.session import materialise

#: 2**32 / phi**2; the product with a 32-bit slot number stays below 2**63.
STEP = 1_640_531_527
SCALE = 2 ** 32
#: Slots that one window may order.
STRETCH = 65_536
#: Cells of [0, 1) by which points meet source intervals.
GRID = 4_096


def measured(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """Row key, id, source, size and place in the shuffle of each row; the text is read here only.

    Without ``key_col`` rows are numbered here, so the result must be written before it is used.
    """
    key, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(
        (F.col(key_col) if key_col else F.monotonically_increasing_id()).alias("row_key"), key.alias("doc_id"),
        F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"),
        F.when(key.isNotNull(), F.xxhash64(F.lit(seed), key)).otherwise(F.xxhash64(F.lit(seed), text.cast("string"))).alias("place"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: number, size, weight, target in words.

    Weights repeat over the sources by code point, null last. All sizes together are shared
    out by weight; no target exceeds ``max_epochs`` times its source, and the excess goes to
    the others by weight. That is a common level per unit of weight: sources are sorted by the
    level at which they are full, and the level is right where the next one isn't full yet.
    The windows hold one row per source.
    """
    n = len(weights)
    named = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number"), F.lit(n)).cast("int"))
    full = F.col("source_size") * max_epochs
    everything = Window.partitionBy()
    ranked = (named.withColumn("number", number).withColumn("weight", weight)
              .withColumn("full", full.cast("double")).withColumn("full_at", F.col("full") / F.col("weight")))
    earlier = Window.orderBy("full_at", "number").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(earlier), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    # The smallest valid level; rounding at the very end may leave none, then all are full.
    valid = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))
    return (ranked.withColumn("level", level)
            .withColumn("level", F.min(valid).over(everything)["level"])
            .withColumn("target", F.least(F.col("full"), F.coalesce(F.col("level") * F.col("weight"), F.col("full"))))
            .select("source", "number", "source_size", "weight", "target"))


def schedule(targets: DataFrame, block_words: int, max_epochs: int = 3) -> DataFrame:
    """Slots that take a block: slot, number (of the source), rank, block, epoch."""
    planned = (targets.where("source_size > 0")
               .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
               .withColumn("slots", F.col("target") / (F.col("source_size") / F.col("blocks"))))
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    edges = (planned.withColumn("all_slots", F.sum("slots").over(everything))
             .withColumn("hi", F.sum("slots").over(upto) / F.col("all_slots"))
             .withColumn("lo", F.col("hi") - F.col("slots") / F.col("all_slots"))
             .withColumn("hi", F.when(F.col("number") == F.max("number").over(everything), 1.0).otherwise(F.col("hi")))
             .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("number")), F.lit(0.0))))
    n_slots = int(edges.agg(F.round(F.max("all_slots"))).first()[0] or 0)
    cells = edges.select("number", "blocks", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * GRID).cast("int"),
        F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)).cast("int"))).alias("cell"))
    point = (F.col("id").bitwiseAND(SCALE - 1) * STEP).bitwiseAND(SCALE - 1) / float(SCALE)
    slots = (edges.sparkSession.range(n_slots).withColumn("point", point)
             .withColumn("cell", F.floor(F.col("point") * GRID).cast("int"))
             .join(cells, "cell").where("lo <= point and point < hi")
             .select(F.col("id").alias("slot"), "number", "blocks",
                     F.floor(F.col("id") / STRETCH).cast("long").alias("stretch")))
    before = Window.partitionBy("number").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = (slots.groupBy("number", "stretch").agg(F.count(F.lit(1)).alias("n"))
              .select("number", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("number", "stretch").orderBy("slot")
    return (slots.withColumn("inside", F.row_number().over(inside) - 1)
            .join(counts, ["number", "stretch"])
            .withColumn("rank", F.col("before") + F.col("inside"))
            .where(F.col("rank") < F.col("blocks") * max_epochs)
            .select("slot", "number", "rank", (F.col("rank") % F.col("blocks")).alias("block"),
                    F.expr("rank div blocks").cast("int").alias("epoch")))


def block_parts(rows: DataFrame, targets: DataFrame, block_words: int, bits: int) -> DataFrame:
    """The words of each row in each block: row_key, number, block, words. One row per pair that meets."""
    numbered = (rows.where("size > 0").join(targets.select("source", "number"), rows.source.eqNullSafe(targets.source))
                .select("row_key", "number", "size", "place"))
    laid = running_total(numbered, ["number"], "place", "row_key", "size", "start", bits)
    end = F.col("start") + F.col("size")
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    return (laid.select("*", F.explode(F.sequence(first, last)).alias("block"))
            .withColumn("words", F.least(end, (F.col("block") + 1) * block_words)
                        - F.greatest(F.col("start"), F.col("block") * block_words))
            .select("row_key", "number", "block", F.col("words").cast("long")))


def _prepared(docs: DataFrame, seed: int, max_epochs: int, weights: tuple[int, ...], names: tuple[str, ...]):
    rows = materialise(measured(docs, seed, *names), "mix-sizes")
    targets = materialise(source_targets(rows, weights, max_epochs), "mix-targets")
    return rows, targets, bucket_bits(rows.count())


def taken_words(docs: DataFrame, block_words: int = 128, seed: int = 8, max_epochs: int = 3,
                weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes of it."""
    rows, targets, bits = _prepared(docs, seed, max_epochs, weights, (id_col, text_col, source_col))
    visits = schedule(targets, block_words, max_epochs).groupBy("number", "block").agg(F.count(F.lit(1)).alias("visits"))
    taken = (block_parts(rows, targets, block_words, bits).join(visits, ["number", "block"])
             .groupBy("row_key").agg(F.sum(F.col("words") * F.col("visits")).alias("taken")))
    known = rows.join(targets, rows.source.eqNullSafe(targets.source)).select(
        "row_key", "doc_id", "size", "source_size", "target")
    return known.join(taken, "row_key", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = 128, seed: int = 8, max_epochs: int = 3,
                    weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix as documents: each row of ``docs`` once per epoch in which words of it are taken.

    Blocks of one epoch are taken in stream order, so a document taken in part is taken from
    its start; its text ends after the last word taken. The columns are those of ``docs``.
    """
    keyed = with_row_key(docs, "mix-documents")
    rows, targets, bits = _prepared(keyed, seed, max_epochs, weights, ("doc_id", "text", "source", ROW_KEY))
    visits = schedule(targets, block_words, max_epochs).select("number", "block", "epoch")
    taken = (block_parts(rows, targets, block_words, bits).join(visits, ["number", "block"])
             .groupBy("row_key", "epoch").agg(F.sum("words").alias("_taken"))
             .select(F.col("row_key").alias(ROW_KEY), "_taken"))
    whole = keyed.join(taken, ROW_KEY)
    size = n_words(F.col("text"))
    # Per source and epoch one document at most is taken in part.
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_taken").cast("int")), " ")
    text = F.when(F.col("_taken") >= size, F.col("text")).otherwise(part)
    cut = whole.withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
