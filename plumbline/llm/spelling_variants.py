"""Spelling variants: words one inserted, deleted or replaced letter apart, and the common form of each.

1. Words are counted by Spark functions alone, combined before the shuffle.
2. Two words of at most L letters that differ in one edit agree in all letters before the edit and
   all behind it. Cut L into windows of ``WINDOW`` letters: the edit lies in the window of the
   first differing letter, and both words share what lies before and behind that window. Each
   word is dealt to the blocks (L, window, letters before, letters behind) for L = its length and
   its length + 1, so each pair meets in exactly one block: that of its first difference. Words of
   over ``MOST`` windows get wider ones.
3. Inside a block padded matrices of code points are compared pair by pair, from the front and
   from the back. Common prefix and suffix together reaching the longer length less one make
   a single edit.
4. A block of more than ``TILE`` words is cut into tiles; every two tiles are one group of their
   own, so a block of any size spreads over tasks. Blocks of one word go before any
   comparison. Pairs are summed per word and block (count, best), never written.

A form is the near word of largest count (of equals the first in code-point order) if that is
at least ``RATIO`` times the word's. Counts grow along forms, so roots are found by letting
every pointer jump over its target's, a few times.

Null and empty texts have no words. A null id counts as the empty string where ids decide about
planted errors. Repeated rows count as often as they occur. Further columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise

RUN = r"[A-Za-zÀ-ÿ]"
WINDOW, TILE, RATIO = 3, 512, 5
#: Windows of a word at most.
MOST = 32
#: Pairs that a task lists at once, and letters that it compares at once.
PAIRS, CELLS = 1 << 17, 1 << 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_planted_errors(run: Column, doc_id: Column, every: int = 199) -> Column:
    """``run`` less one letter where ``every`` divides the checksum of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, min_letters: int = 6, min_count: int = 5, planted: int | None = None) -> DataFrame:
    """word, n: lower-cased runs of letters of at least ``min_letters``, seen at least ``min_count`` times."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{min_letters},}}"), 0)).alias("run"))
    lowered = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    word = F.col("run") if planted is None else with_planted_errors(F.col("run"), F.col("doc_id"), planted)
    counted = lowered.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= min_letters) & (F.col("n") >= min_count))


def window_of(longer: Column | np.ndarray) -> Column | np.ndarray:
    """Letters of a window: ``WINDOW``, more for words so long that there would be more than ``MOST`` of them."""
    wide = (longer + (MOST - 1)) / MOST
    if isinstance(longer, np.ndarray):
        return np.maximum(WINDOW, wide.astype(np.int64))
    return F.greatest(F.lit(WINDOW), wide.cast("int"))


def block_keys(word: Column) -> Column:
    """The blocks of a word: key (a hash), longer (length of the longer word of its pairs), first (letter of its window)."""
    return F.concat(_blocks(word, F.length(word)), _blocks(word, F.length(word) + 1))


def _blocks(word: Column, longer: Column) -> Column:
    window = window_of(longer)
    windows = F.sequence(F.lit(0), F.floor((longer - 1) / window).cast("int"))
    return F.transform(F.transform(windows, lambda j: j * window), lambda first: F.struct(
        F.xxhash64(longer, first, F.substring(word, F.lit(1), first), _last(word, longer - first - window)).alias("key"),
        longer.alias("longer"), first.alias("first")))


def _last(word: Column, size: Column) -> Column:
    """The last ``size`` letters, none if that is not positive."""
    return F.when(size > 0, F.substring(word, F.length(word) - size + 1, size)).otherwise("")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points padded at the end and at the front."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    width = int(sizes.max(initial=0)) + 1
    fronts, backs = np.zeros((2, len(words), width), np.uint32)
    row = np.repeat(np.arange(len(words)), sizes)
    column = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fronts[row, column] = codes
    backs[row, column + width - np.repeat(sizes, sizes)] = codes
    return sizes, fronts, backs[:, ::-1]


def single_edits(left: np.ndarray, right: np.ndarray, words: list[str], longer: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which pairs of words (by number) are one edit apart, differ first inside their window and have their longer length."""
    used, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    sizes, fronts, backs = _matrices([words[i] for i in used])
    left, right = at[:len(left)], at[len(left):]
    most, least = np.maximum(sizes[left], sizes[right]), np.minimum(sizes[left], sizes[right])
    # The last column is a pad in every row; where it alone is left, all letters agree.
    prefix, suffix = (np.minimum(_agreeing(m[left], m[right]), least) for m in (fronts, backs))
    return ((most == longer) & (most - least <= 1) & (prefix + suffix >= most - 1) & (prefix < most)
            & (prefix >= first) & (prefix < first + window_of(longer)))


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    same = left == right
    same[:, -1] = False
    return np.argmin(same, axis=1)


def _pairs_inside(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both rows of every pair of rows of every group (rows ``start`` to ``start + size``)."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    behind = sizes[group] - 1 - place
    left = np.repeat(starts[group] + place, behind)
    step = np.arange(len(left)) - np.repeat(np.cumsum(behind) - behind, behind)
    return left, left + 1 + step


def near_words(counts: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, best (n and word of its near word of largest count) of words with a near word."""
    dealt = counts.select("word", "n", F.explode(block_keys(F.col("word"))).alias("block")).select("word", "n", "block.*")
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    tiled = (dealt.join(sizes, "key").withColumn("tiles", F.expr(f"cast((size + {tile - 1}) div {tile} AS int)"))
             .withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")))
    # Group (t, t) compares a tile with itself, group (t, u) two tiles.
    groups = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(
        F.least(u, F.col("tile")).alias("x"), F.greatest(u, F.col("tile")).alias("y")))
    spread = (tiled.select("word", "n", "key", "longer", "first", "tile", F.explode(groups).alias("g"))
              .select("word", "n", "longer", "first", "tile", F.xxhash64("key", "g.x", "g.y").alias("part"), (F.col("g.x") == F.col("g.y")).alias("alone")))
    grouped = spread.repartition("part").sortWithinPartitions("part")
    summed = grouped.mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return summed.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part in, per word its near words out: how many, and the best. Words may come several times."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        parts = rest.column("part").to_numpy()
        # The last group may go on in the next batch.
        whole = int(np.searchsorted(parts, parts[-1])) if len(parts) else 0
        if whole:
            yield from _compare_groups(rest.slice(0, whole))
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield from _compare_groups(rest)


def _compare_groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
    words = table.column("word").to_pylist()
    part, n, longer, first, tile = (table.column(c).to_numpy() for c in ("part", "n", "longer", "first", "tile"))
    alone = np.array(table.column("alone").to_pylist())
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    sizes = np.diff(np.append(starts, len(words)))
    # Rank 0 is the word that any other prefers as its form.
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    upto = np.cumsum(sizes * (sizes - 1) // 2)
    at = 0
    while at < len(sizes):
        done = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        left, right = _pairs_inside(starts[at:to], sizes[at:to])
        # Between two tiles only pairs of both count: each tile has a group of its own for the rest.
        meant = alone[left] | (tile[left] != tile[right])
        left, right = left[meant], right[meant]
        step = max(1, CELLS // (int(longer[starts[at]:starts[at] + int(sizes[at:to].sum())].max()) + 1))
        for cut in range(0, len(left), step):
            a, b = left[cut:cut + step], right[cut:cut + step]
            held = single_edits(a, b, words, longer[a], first[a])
            for here, there in ((a[held], b[held]), (b[held], a[held])):
                np.add.at(near, here, 1)
                np.minimum.at(best, here, rank[there])
        at = to
    rows = np.flatnonzero(near)
    if len(rows):
        chosen = order[best[rows]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in rows], pa.string()), pa.array(near[rows]), pa.array(n[chosen], pa.int64()),
             pa.array([words[i] for i in chosen], pa.string())], names=["word", "n_near", "best_n", "best"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): where forms end. Each round doubles how far a pointer reaches."""
    pointers = forms.select("word", F.col("form").alias("root"))
    while True:
        above = pointers.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = materialise(pointers.join(above, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        pointers = jumped.select("word", "root")
        if jumped.where("moved").limit(1).count() == 0:
            return pointers


def group_variants(counts: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``counts`` (word, n)."""
    counts = materialise(counts.select("word", F.col("n").cast("long").alias("n")), "word-counts")
    near = near_words(counts, tile)
    strong = F.col("best.n") >= F.lit(ratio) * F.col("n")
    formed = materialise(counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.word")).alias("form"), F.when(strong, F.col("best.n")).cast("long").alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
