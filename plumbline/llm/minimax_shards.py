"""Sharding by minimax contiguous partition, in DataFrame functions only.

Equal texts form a group that one shard takes whole. Groups are ordered by the md5 of their
text. The ordered atoms are the 65,536 cells of its first four digits, so there are as many
at any scale and a cell holds about 1/2,700 of a shard, or one hot group and little else.

1. One scan measures each document and sums sizes per cell (combined before the shuffle).
2. The running sums of the cells become one array of at most ``CELLS + 1`` numbers. A binary
   search over capacities, each checked greedily from the left, finds the smallest capacity
   that ``shards`` contiguous runs of cells can meet. Cuts then go as near to equal as that
   capacity allows: a greedy pass from the right says how far left each cut may lie, the
   capacity says how far right.
3. Slots count rows within a cell, or within parts of a cell that has many rows, plus the
   rows of the cells before it in the shard. No window holds a shard.

A null text counts as empty (size 8, crc 0) and groups with empty texts; repeated rows are
rows of the same group and get slots of their own; an empty table gives no rows; where
there are fewer cells than shards, some shards stay empty. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise

CELLS = 65_536
#: Rows that one window may order; larger cells are numbered in parts.
ROWS_PER_PART = 100_000


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size, crc and cell of each row; the text is read here and nowhere else."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int").alias("cell"))


def _last_at_most(prefix: Column, bound: Column) -> Column:
    """Largest index (from 0) whose running sum is at most ``bound``; sums begin with 0 and ascend."""
    steps = F.sequence(F.lit(16), F.lit(0), F.lit(-1))

    def step(at: Column, bit: Column) -> Column:
        reach = at + F.expr("1").cast("int") * F.pow(F.lit(2), bit).cast("int")
        return F.when((reach < F.size(prefix)) & (F.get(prefix, reach) <= bound), reach).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def cut_cells(cells: DataFrame, shards: int) -> DataFrame:
    """One row: the smallest feasible ``capacity`` and ``cuts``, the first cell of each shard but the first.

    ``cells`` has (cell, size), at most ``CELLS`` rows, so its one window and one array are bounded.
    """
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = (cells.withColumn("end", F.sum("size").over(order))
           .agg(F.array_sort(F.collect_list(F.struct("cell", "end"))).alias("ends"))
           .select(F.col("ends.cell").alias("names"),
                   F.concat(F.array(F.lit(0).cast("long")), F.col("ends.end")).alias("prefix")))
    last = F.size("prefix") - 1
    one = one.withColumn("last", last).withColumn("total", F.get("prefix", last))
    prefix, n = F.col("prefix"), F.col("last")

    def farthest(at: Column, capacity: Column) -> Column:
        return _last_at_most(prefix, F.get(prefix, at) + capacity)

    def feasible(capacity: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.lit(0),
                           lambda at, _: farthest(at, capacity)) == n

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("long")
        fits = feasible(middle)
        # A span that has closed stays as it is.
        return F.when(span["lo"] >= span["hi"], span).otherwise(F.struct(
            F.when(fits, span["lo"]).otherwise(middle + 1).alias("lo"),
            F.when(fits, middle).otherwise(span["hi"]).alias("hi")))

    start = F.struct(F.ceil(F.col("total") / shards).cast("long").alias("lo"), F.col("total").alias("hi"))
    found = one.withColumn("capacity", F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, halve)["lo"])
    capacity = F.col("capacity")

    # least[k]: the first index from which k shards hold all the rest.
    least = F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)), F.array(n),
        lambda out, _: F.concat(out, F.array(F.greatest(F.lit(0), F.when(
            F.get(prefix, F.element_at(out, -1)) <= capacity, 0).otherwise(
            _last_at_most(prefix, F.get(prefix, F.element_at(out, -1)) - capacity - 1) + 1)))))
    found = found.withColumn("least", least)

    def cut(out: Column, k: Column) -> Column:
        at = F.element_at(out, -1)
        left = F.lit(shards) - k + 1  # shards still to fill
        ideal = F.get(prefix, at) + (F.col("total") - F.get(prefix, at)) / left
        below = _last_at_most(prefix, ideal)
        nearer = F.when((below < n) & (F.get(prefix, below + 1) - ideal < ideal - F.get(prefix, below)),
                        below + 1).otherwise(below)
        return F.concat(out, F.array(F.least(
            F.greatest(nearer, F.get(F.col("least"), F.lit(shards) - k)), farthest(at, capacity))))

    cuts = F.aggregate(F.sequence(F.lit(1), F.lit(shards - 1)), F.array(F.lit(0)), cut)
    # A cut behind the last cell leaves the shards that follow empty.
    named = F.transform(F.slice(cuts, 2, shards), lambda i: F.coalesce(F.get(F.col("names"), i), F.lit(CELLS)))
    return found.select("capacity", named.alias("cuts"))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    if shards < 2:
        raise ValueError("sharding needs two shards at least")
    rows = materialise(measured(docs, id_col, text_col), "shard-sizes")
    cells = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    cuts = cut_cells(cells.select("cell", "size"), shards).first()["cuts"]  # shards - 1 numbers
    starts = F.array(*[F.lit(c) for c in cuts])
    shard = F.size(F.filter(starts, lambda c: c <= F.col("cell"))).cast("int")
    # At most CELLS rows of a few bytes: the broadcast is bounded.
    homes = F.broadcast(cells.select("cell", shard.alias("shard"),
                                     F.ceil(F.col("n") / ROWS_PER_PART).cast("int").alias("parts")))
    placed = rows.join(homes, "cell").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
               .select("cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("cell", "part").orderBy("doc_id", "size")
    return (placed.withColumn("inside", F.row_number().over(inside) - 1)
            .join(offsets, ["cell", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot")))
