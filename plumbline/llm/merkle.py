"""Merkle fingerprints of documents, in DataFrame functions only.

A text is cut into paragraphs: up to the end of a line or a sentence, 200 characters at most.
The cut at a place depends only on the text before it. A leaf is the sha256 of a paragraph; a
section ends with each leaf whose first hex digit is below 4, so its borders move with the
text and not with its position; a section's digest covers its leaves and the root covers the
sections. Equal roots mean equal texts. Where roots differ, the equal sections before and after
the difference are passed over and only leaves between them are compared (``edits``).

A null text counts as empty: no leaves, and the root of nothing. Rows that repeat an id are
one document for the order of ids and keep a row each; an id of null is the smallest id.
An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise

PARAGRAPH = r"(?s).{1,200}?(?:[.!?][ \t\n]+|\n+|\z)|.{1,200}"
NO_ID = -(2 ** 63)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; joined, they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))


def leaf_hashes(pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.sha2(x, 256))


def section_lists(leaves: Column) -> Column:
    """Each section as the comma-joined hashes of its leaves."""
    marked = F.array_join(F.transform(leaves, lambda h: F.concat(h, F.when(F.substring(h, 1, 1) < "4", "|").otherwise(","))), "")
    return F.filter(F.split(marked, r"\|"), lambda s: s != "")


def root_of(leaves: Column) -> Column:
    return F.sha2(F.array_join(F.transform(section_lists(leaves), lambda s: F.sha2(s, 256)), ","), 256)


def tree(text: Column) -> Column:
    """struct(root, sections: hashes, leaves: hashes)."""
    leaves = leaf_hashes(paragraphs(text))
    sections = F.transform(section_lists(leaves), lambda s: F.sha2(s, 256))
    return F.struct(root_of(leaves).alias("root"), sections.alias("sections"), leaves.alias("leaves"))


def leaf_keys(leaves: Column) -> Column:
    """Leaves as 64-bit numbers, for comparisons that move many of them."""
    return F.transform(leaves, lambda h: F.xxhash64(h))


def likeness(left: Column, right: Column) -> Column:
    """Shared distinct leaves, twice, over the distinct leaves of both; 1 for two empty texts."""
    both = F.size(F.array_distinct(left)) + F.size(F.array_distinct(right))
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / both)


def _equal_ahead(left: Column, right: Column) -> Column:
    """How many sections two lists have in common from their beginning."""
    differ = F.array_position(F.zip_with(left, right, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differ > 0, differ - 1).otherwise(F.size(left)).cast("int")


def edits(pairs: DataFrame, left: str, right: str, id_col: str = "doc_id") -> DataFrame:
    """What makes ``right`` of ``left``: id_col, kind, old_paragraph, old_start, new_paragraph, new_start, length.

    Paragraphs are numbered from 0, starts and lengths are code points. The k-th occurrence of a
    paragraph in one text answers the k-th in the other. One without an answer is a ``delete`` (new
    places null) or an ``insert`` (old places null). Of the answered ones, those out of order are
    a ``move``: read forwards, what comes after something that it preceded before; read backwards,
    the reverse. The reading with fewer moves counts, forwards if equal.

    Pairs with equal roots end there. Of the others, sections that agree from the beginning or from
    the end are passed over. Null texts are empty; rows that repeat an id and both texts count once.
    """
    rows = pairs.select(F.col(id_col).alias("_id"), F.col(left).alias("_left"), F.col(right).alias("_right")).select(
        "_id", tree(F.col("_left")).alias("_old"), tree(F.col("_right")).alias("_new"),
        F.transform(paragraphs(F.col("_left")), lambda p: F.length(p)).alias("_old_lengths"),
        F.transform(paragraphs(F.col("_right")), lambda p: F.length(p)).alias("_new_lengths"))
    rows = rows.where("_old.root <> _new.root").withColumns({"_l": F.col("_old.root"), "_r": F.col("_new.root")}).dropDuplicates(["_id", "_l", "_r"])
    old, new = F.col("_old.sections"), F.col("_new.sections")
    ahead = _equal_ahead(old, new)
    behind = F.least(_equal_ahead(F.reverse(old), F.reverse(new)), F.least(F.size(old), F.size(new)) - F.col("_ahead"))
    rows = rows.withColumn("_ahead", ahead).withColumn("_behind", behind)
    key = ["_id", "_l", "_r"]

    def leaves(which: str) -> DataFrame:
        """The leaves of one text, one per row, without those of the sections passed over."""
        each = rows.select(*key, "_ahead", (F.size(f"{which}.sections") - F.col("_behind")).alias("_until"), F.posexplode(
            F.arrays_zip(F.col(f"{which}.leaves").alias("hash"), F.col(f"{which}_lengths").alias("length"))).alias("paragraph", "_leaf"))
        order = Window.partitionBy(*key).orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)
        place = F.struct("paragraph", F.coalesce(F.sum("_leaf.length").over(order), F.lit(0)).alias("start"))
        section = F.coalesce(F.sum((F.substring("_leaf.hash", 1, 1) < "4").cast("int")).over(order), F.lit(0))
        again = Window.partitionBy(*key, "hash").orderBy("place")
        return (each.select(*key, "_ahead", "_until", F.col("_leaf.hash").alias("hash"), F.col("_leaf.length").alias("length"),
                            place.alias("place"), section.alias("section"))
                .where((F.col("section") >= F.col("_ahead")) & (F.col("section") < F.col("_until")))
                .select(*key, "hash", "length", "place", F.row_number().over(again).alias("occurrence"), F.lit(which).alias("side")))

    def of(which: str) -> Column:
        return F.max(F.when(F.col("side") == which, F.col("place")))

    met = leaves("_old").unionByName(leaves("_new")).groupBy(*key, "hash", "occurrence").agg(
        F.max("length").alias("length"), of("_old").alias("old"), of("_new").alias("new"))
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    order = Window.partitionBy(*key, both).orderBy("old")
    late = F.max("new").over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("new")
    early = F.min("new").over(order.rowsBetween(1, Window.unboundedFollowing)) < F.col("new")
    read = met.select("*", both.alias("both"), (both & F.coalesce(late, F.lit(False))).alias("late"), (both & F.coalesce(early, F.lit(False))).alias("early"))
    whole = Window.partitionBy(*key)
    fewer = F.count_if("early").over(whole) < F.count_if("late").over(whole)
    moved = read.withColumn("moved", F.when(fewer, F.col("early")).otherwise(F.col("late")))
    kind = F.when(F.col("moved"), "move").when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert")
    return moved.withColumn("kind", kind).where("kind IS NOT NULL").select(
        F.col("_id").alias(id_col), "kind", F.col("old.paragraph").alias("old_paragraph"), F.col("old.start").alias("old_start"),
        F.col("new.paragraph").alias("new_paragraph"), F.col("new.start").alias("new_start"), "length")


def _neighbours(lengths: DataFrame) -> DataFrame:
    """Per id: ``prev_id`` that it follows in descending order, and that document's length.

    ``lengths`` has one row per id. Ids are dealt out by range and written, so both readings
    see the same parts; a window orders one part, and the first and last of the parts are
    stitched. After the smallest id comes the largest.
    """
    parts = materialise(
        lengths.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "id-ranges")
    down = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    inside = parts.select("doc_id", "part", F.lag(F.struct("doc_id", "n_chars")).over(down).alias("prev"))
    ends = parts.groupBy("part").agg(F.max("doc_id").alias("top"), F.min(F.struct("doc_id", "n_chars")).alias("bottom"))
    # One row per part of the range exchange.
    over_parts = Window.orderBy(F.desc("top"))
    everything = Window.partitionBy()
    stitched = ends.select(F.col("top").alias("doc_id"), F.coalesce(
        F.lag("bottom").over(over_parts), F.min("bottom").over(everything)).alias("edge"))
    return (inside.join(stitched, "doc_id", "left")
            .withColumn("prev", F.coalesce("prev", "edge"))
            .select("doc_id", F.col("prev.doc_id").alias("prev_id"), F.col("prev.n_chars").alias("prev_chars")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they are.

    The edited text has its second half replaced by the beginning of the next document. Each
    document sends its predecessor no more than that beginning, and its leaves as numbers.
    """
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lengths = base.groupBy("doc_id").agg(F.max(F.length("text")).cast("long").alias("n_chars"))
    ordered = base.join(_neighbours(lengths), "doc_id")
    sent = (ordered.select(
        F.col("prev_id").alias("doc_id"),
        F.struct(F.expr("substring(text, 1, cast(prev_chars div 2 as int))").alias("head"),
                 leaf_keys(leaf_hashes(paragraphs(F.col("text")))).alias("keys")).alias("next"))
        .groupBy("doc_id").agg(F.min("next").alias("next")))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = base.join(sent, "doc_id").select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "text", F.col("next.keys").alias("next_keys"),
        F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.substring("next.head", F.lit(1), half))
        .alias("edited"))
    rows = rows.select("*", leaf_hashes(paragraphs(F.col("text"))).alias("leaves"),
                       leaf_hashes(paragraphs(F.col("edited"))).alias("edited_leaves"))
    return rows.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        root_of(F.col("leaves")).alias("fingerprint"), root_of(F.col("edited_leaves")).alias("edited_fingerprint"),
        F.round(likeness(F.col("leaves"), F.col("edited_leaves")), 9).alias("near_edited"),
        F.round(likeness(leaf_keys(F.col("leaves")), F.col("next_keys")), 9).alias("near_next"))
