"""Rows of an array inside a JSON response, each response read by as many tasks as it has blocks.

Where an element of the array begins depends on all brackets and quotes before it. A file is read
in pieces that end with the bracket that closes an element, and two passes tell the rest:

1. A piece changes the nesting depth by one of two amounts, as it begins outside or inside a
   string, and its quotes say which of the two the next piece begins in. So a block of a file is a
   small function: quotes, and the change of depth from either start (one row per block). Composed
   along the blocks of a file, these give the state that each block begins in.
2. Inside each block, the pieces from an element's opening bracket to the closing one are joined.
   What a block begins with inside an element belongs to the one left open before it; only these
   edges meet once more, by file.

The array is known by its depth and its own key; two such arrays in one response are an error.
Elements of another kind than asked for (a null among objects) are passed over. As by the
whole-file reader, a response cut short gives no rows; ``broken_responses`` lists those. Elements
are held whole by one task, and so is what surrounds the array up to the next closing bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.readers import numbers_as_text

OBJECT, ARRAY = "}", "]"
_OPENING = {OBJECT: "{", ARRAY: "["}
_ESCAPE = r"(?s)\\."
_STRING = '"[^"]*+"?'
_TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"?|[\[\]{}]|[^"\[\]{}]++'


def _depth_change(text: Column) -> Column:
    bare = F.regexp_replace(text, _STRING, "")
    return F.length(F.translate(bare, "]}", "")) - F.length(F.translate(bare, "[{", ""))


def _pieces(spark: SparkSession, path: str | Sequence[str], closing: str) -> DataFrame:
    """file, file_size, block, place, piece (without its closing bracket), quotes, from_outside, from_inside (changes of depth)."""
    text = spark.read.text(path if isinstance(path, str) else list(path), lineSep=closing)
    plain = F.regexp_replace("value", _ESCAPE, "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    closes = F.when(quotes % 2 == 0, 1).otherwise(0)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("piece"), quotes.alias("quotes"), (_depth_change(plain) - closes).alias("from_outside"),
        (_depth_change(F.concat(F.lit('"'), plain)) - (1 - closes)).alias("from_inside"))


def _upto(value: Column) -> Column:
    """An aggregate over the pieces of a block up to each one."""
    return value.over(Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))


def _change(inside: Column) -> Column:
    return F.when(inside == 1, F.col("from_inside")).otherwise(F.col("from_outside"))


def block_states(pieces: DataFrame) -> DataFrame:
    """file, block, inside and depth where the block begins, whole (whether the response ends closed). One row per block."""
    odd = (_upto(F.sum("quotes")) - F.col("quotes")) % 2
    blocks = (pieces.select("file", "file_size", "block", "place", "quotes", "from_outside", "from_inside",
                            (F.octet_length("piece") + 1).alias("bytes")).withColumn("odd", odd)
              .groupBy("file", "block").agg(
                  F.max("file_size").alias("file_size"), F.sum("bytes").alias("bytes"), F.sum("quotes").alias("quotes"),
                  F.sum(_change(F.col("odd"))).alias("from_outside"), F.sum(_change(1 - F.col("odd"))).alias("from_inside")))
    file = Window.partitionBy("file")
    along = file.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("inside", (F.sum("quotes").over(along) - F.col("quotes")) % 2)
    blocks = blocks.withColumn("change", _change(F.col("inside")))
    # The reader does not say whether the last piece had its bracket; the size of the file does.
    end = F.when(F.sum("bytes").over(file) > F.col("file_size"), -1).otherwise(0)
    whole = (F.sum("quotes").over(file) % 2 == 0) & (F.sum("change").over(file) == end)
    return blocks.select("file", "block", "inside", (F.sum("change").over(along) - F.col("change")).alias("depth"), whole.alias("whole"))


def _scanned(level: int) -> Column:
    """What a fold over the tokens of a piece finds, from its state: the token that opens an element which
    the piece does not close, that bracket, and the key of the array if it begins here."""
    start = F.struct(F.col("depth").cast("long").alias("depth"), F.lit(1).alias("next"), F.lit(0).alias("start"), F.lit("").alias("bracket"),
                     F.lit("").alias("text"), F.lit("").alias("key"), F.lit(None).cast("string").alias("array"))

    def step(s: Column, token: Column) -> Column:
        opens, closes = token.isin("[", "{"), token.isin("]", "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        begins = opens & (s["depth"] == level)
        return F.struct(
            depth.alias("depth"), (s["next"] + 1).alias("next"),
            F.when(begins, s["next"]).when(closes & (depth <= level), 0).otherwise(s["start"]).alias("start"),
            F.when(begins, token).otherwise(s["bracket"]).alias("bracket"),
            F.when(token.startswith('"'), token).otherwise(F.lit("")).alias("text"),
            F.when(F.trim(F.translate(token, "\t\r\n", "   ")) == ":", s["text"]).otherwise(F.lit("")).alias("key"),
            F.when((token == "[") & (s["depth"] == level - 1), s["key"]).otherwise(s["array"]).alias("array"))

    return F.aggregate("tokens", start, step)


def _joined(place: str, text: str, separator: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(text).alias("text"))))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), separator)


def array_elements(spark: SparkSession, path: str | Sequence[str], array_path: str = "", closing: str = OBJECT) -> DataFrame:
    """file, block, number, first (whether it is the first of its array), element (its JSON text).

    ``array_path`` names the keys down to the array, with dots; without keys it is the response itself.
    """
    steps = array_path.split(".") if array_path else []
    level = len(steps) + 1
    pieces = _pieces(spark, path, closing)
    odd = (_upto(F.sum("quotes")) - F.col("quotes")) % 2
    placed = pieces.drop("file_size").withColumn("odd", odd).join(
        block_states(pieces).where("whole").withColumnsRenamed({"inside": "block_inside", "depth": "block_depth"}), ["file", "block"])
    placed = placed.withColumn("inside", (F.col("block_inside") + F.col("odd")) % 2).withColumn("change", _change(F.col("inside")))
    placed = placed.withColumn("after", F.col("block_depth") + _upto(F.sum("change"))).withColumn("depth", F.col("after") - F.col("change"))
    opened = F.when(F.col("inside") == 1, F.concat(F.lit('"'), "piece")).otherwise(F.col("piece"))
    scanned = placed.withColumn("tokens", F.regexp_extract_all(opened, F.lit(_TOKEN), F.lit(0))).withColumn("scan", _scanned(level))
    begins = F.col("scan.start") > 0
    kind = F.col("scan.bracket") == _OPENING[closing]
    text = F.when(begins, F.array_join(F.slice("tokens", F.greatest(F.col("scan.start"), F.lit(1)), F.size("tokens")), "")).otherwise(F.col("piece"))
    ends = (F.col("inside") + F.col("quotes")) % 2 == 0
    # Inside elements only: a piece after an element and before the next one begins no deeper than the array.
    parts = scanned.select(
        "file", "block", "place", text.alias("text"), begins.alias("begins"), (begins & kind).alias("kind"),
        (ends & (F.col("after") == level)).alias("ends"), _upto(F.last("scan.array", ignorenulls=True)).alias("array"),
        F.col("scan.array").isNotNull().alias("opens"), _upto(F.sum(begins.cast("int"))).alias("number"),
        (begins | (F.col("depth") > level)).alias("part"))
    if steps:
        parts = _of_array(parts, steps[-1])
    groups = parts.where("part").groupBy("file", "block", "number").agg(
        _joined("place", "text", closing).alias("element"), F.bool_or("kind").alias("kind"),
        F.bool_or(F.col("begins") & F.col("opens")).alias("first"), F.bool_or("ends").alias("ended"))
    is_edge = ~F.col("ended") | (F.col("number") == 0)
    # An open element takes what the next blocks begin with: at most two rows per block.
    along = Window.partitionBy("file").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, 0)
    owned = groups.where(is_edge).withColumn("owner", F.sum(F.when(F.col("number") > 0, 1).otherwise(0)).over(along))
    head = F.min(F.struct("block", "number", "kind", "first"))
    stitched = (owned.groupBy("file", "owner").agg(head.alias("head"), _joined("block", "element", closing).alias("element"),
                                                   F.bool_or("ended").alias("ended"))
                .select("file", "head.block", "head.number", "head.first", "element", "head.kind", "ended"))
    whole = groups.where(~is_edge).select(*stitched.columns)
    return whole.unionByName(stitched).where("kind AND ended AND number > 0").select(
        "file", "block", "number", "first", F.concat("element", F.lit(closing)).alias("element"))


def _of_array(parts: DataFrame, key: str) -> DataFrame:
    """The parts of the array with this key; a block may begin inside an array that an earlier one opened."""
    wanted = F.col("array") == f'"{key}"'
    blocks = parts.groupBy("file", "block").agg(
        F.max_by("array", "place").alias("last"), F.sum((F.col("opens") & wanted).cast("int")).alias("found"))
    file = Window.partitionBy("file")
    before = F.last("last", ignorenulls=True).over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", before.alias("before"), F.sum("found").over(file).alias("found"))
    # What continues an element of an earlier block is kept: it is judged by where it began.
    return (parts.join(blocks, ["file", "block"]).withColumn("array", F.coalesce("array", "before"))
            .withColumn("array", F.when(F.col("found") <= 1, F.col("array")).otherwise(
                F.raise_error(F.concat(F.lit(f"more than one array {key} in "), "file"))))
            .withColumn("kind", F.col("kind") & F.coalesce(wanted, F.lit(False))).drop("before", "found"))


def broken_responses(spark: SparkSession, path: str | Sequence[str], closing: str = OBJECT) -> DataFrame:
    """The files whose brackets or quotes are not closed at their end."""
    return block_states(_pieces(spark, path, closing)).where("NOT whole").select("file").distinct()


def read_envelope_split(spark: SparkSession, path: str | Sequence[str], array_path: str, fields: Sequence[str],
                        keep_number_text: bool = True) -> DataFrame:
    """``readers.read_json_envelope``, by the block and not by the file."""
    row = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    element = F.col("element")
    rows = array_elements(spark, path, array_path)
    return rows.select(F.from_json(numbers_as_text(element) if keep_number_text else element, row).alias("row")).select("row.*")


def read_arrays_split(spark: SparkSession, path: str | Sequence[str], variables: Sequence[str], geo_level: str) -> DataFrame:
    """``readers.read_json_arrays``, by the block and not by the file."""
    keys = {"us": ["us"], "state": ["state"], "county": ["state", "county"]}[geo_level]
    rows = array_elements(spark, path, closing=ARRAY).where("NOT first").select(
        "file", F.from_json("element", "array<string>").alias("cells"))
    return rows.select(
        *[F.col("cells")[i].alias(name) for i, name in enumerate(["NAME", *variables, *keys])],
        F.lit(geo_level).alias("geo_level"), F.regexp_extract("file", r"-(\d{4})-[a-z]+\.json", 1).alias("vintage"))
