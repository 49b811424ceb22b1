"""Repeated passages found with a run-length compressed Burrows-Wheeler index.

A byte goes if some ``length``-byte string that covers it starts at a second place anywhere.
One index over everything would have to live in one task, so strings are first dealt out by
content, and each task indexes what can match:

1. Every window of ``length`` bytes names its minimizer, the ``KMER``-byte substring of least
   hash. Equal windows name equal substrings, so windows that can match meet under one
   number. Neighbouring windows with one minimizer form a segment (about 250 bytes).
2. Segments are counted per number (combined before the shuffle). A number seen once has no
   match. If all segments of a number are equal, all their bytes are repeated. Only numbers
   with different segments go on, one copy of each distinct segment.
3. Tasks take whole numbers, half a megabyte of segments at a time, build the run-length
   BWT with sampled run ends, and read matching statistics off it in text order. A number
   with more than ``MAX_SEGMENTS`` distinct segments would not fit; its windows are counted by a
   128-bit digest instead, which spreads over the cluster and is as exact.
4. The marked stretches go back to the places of their segments and are cut out per document.

Every window belongs to exactly one segment, so no match is lost or counted with itself.

Nulls are empty texts; texts shorter than ``length`` bytes cannot match; a row that occurs
twice repeats itself, so its long stretches go from both; rows are told apart by id and text
and an id may be null; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, give_back_memory
from plumbline.session import materialise

KMER = 96
#: Distinct segments of one number that one index takes.
MAX_SEGMENTS = 4096
#: Bytes of segments after which a task closes an index and begins the next. Building one takes about a hundred times as much.
INDEX_BYTES = 500_000
#: Windows looked at at once; longer texts are taken in such pieces.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# ── the index ────────────────────────────────────────────────────────────────────────────
@dataclass(frozen=True)
class RunLengthIndex:
    """Runs of the BWT of separated strings. ``head[r]`` and ``tail[r]`` sample the suffix array at
    the first and last row of run r; ``lcp[r]`` is what the suffix at its head shares with the one before."""

    symbols: np.ndarray  # run symbols: byte + 1, 0 for a separator
    starts: np.ndarray  # first row of each run
    head: np.ndarray
    tail: np.ndarray
    lcp: np.ndarray
    n: int

    @property
    def runs(self) -> int:
        return len(self.starts)

    def matching_statistics(self) -> np.ndarray:
        """Per text position the longest match that also starts elsewhere.

        The suffix before (or after) a row inside a run moves along with the text, so what is
        shared shrinks by one per position until the next sampled run end sets it anew.
        """
        out = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for sample, shared in ((self.head, self.lcp), (self.tail[:-1], self.lcp[1:])):
            reach = np.zeros(self.n, np.int64)
            reach[sample] = sample + shared
            np.maximum(out, np.maximum.accumulate(reach) - place, out=out)
        return out

    def count(self, pattern: bytes) -> int:
        """Occurrences of a pattern by backward search over the runs."""
        ends = np.append(self.starts[1:], self.n)
        sizes = ends - self.starts
        lo, hi = 0, self.n
        for byte in reversed(pattern):
            own = self.symbols == byte + 1
            before = np.concatenate([[0], np.cumsum(np.where(own, sizes, 0))])

            def rank(row: int) -> int:
                run = int(np.searchsorted(self.starts, row, "right")) - 1
                return int(before[run]) + (row - int(self.starts[run]) if own[run] and row < self.n else
                                           int(before[run + 1] - before[run]) if row >= self.n else 0)

            smaller = int(sizes[self.symbols < byte + 1].sum())
            lo, hi = smaller + rank(lo), smaller + rank(hi)
            if lo >= hi:
                return 0
        return hi - lo


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; each separator is a symbol of its own, ordered by place."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    separator = np.zeros(n, np.int64)
    number = np.concatenate([np.cumsum(text == 0), np.full(4, n)])  # of the separator, counted from 1
    for shift in range(4):
        symbol = np.where(live, padded[shift:shift + n], 0)
        key = key << 9 | symbol
        met = live & (symbol == 0)
        separator[met] = number[shift:shift + n][met]
        live &= symbol != 0
    key = key << 27 | separator
    del padded, live, separator, number
    depth = 4
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], (ordered[1:] != ordered[:-1]).cumsum()])
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        del key, order, ordered, fresh
        follow = np.zeros(n, np.int64)
        follow[:max(0, n - depth)] = rank[depth:] + 1
        key = rank * (n + 1) + follow
        depth *= 2


def _shared(text: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    """Symbols that the strings at ``left`` and ``right`` share before a separator."""
    out = np.zeros(len(left), np.int64)
    padded = np.concatenate([text, np.zeros(limit + 9, text.dtype)])
    words = np.zeros(len(padded) - 4, np.uint64)
    for i in range(4):
        words |= padded[i:len(words) + i].astype(np.uint64) << np.uint64(16 * i)
    active = np.arange(len(left))
    for at in range(0, limit, 4):
        a, b = words[left[active] + at], words[right[active] + at]
        ended = np.zeros(len(active), bool)
        for i in range(4):
            x, y = (a >> np.uint64(16 * i)) & np.uint64(0xFFFF), (b >> np.uint64(16 * i)) & np.uint64(0xFFFF)
            ended |= (x != y) | (x == 0)
            out[active[~ended]] += 1
        active = active[~ended]
        if not len(active):
            break
    return out


def build_index(strings: list[bytes]) -> tuple[RunLengthIndex, np.ndarray]:
    """The index of the strings, and where each begins in its text."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    text[begin + sizes - 1] = 0
    order = _suffix_order(text)
    last = text[order - 1]  # order 0 wraps to the final separator
    starts = np.concatenate([[0], np.flatnonzero(last[1:] != last[:-1]) + 1])
    # Separators are symbols of their own, so they never continue a run.
    starts = np.union1d(starts, np.flatnonzero(last == 0))
    head = order[starts]
    tail = order[np.append(starts[1:], len(text)) - 1]
    lcp = np.zeros(len(starts), np.int64)
    lcp[1:] = _shared(text, head[1:], order[starts[1:] - 1], int(sizes.max()))
    return RunLengthIndex(last[starts], starts, head, tail, lcp, len(text)), begin


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string the places where a ``length``-byte match with another place begins."""
    index, begin = build_index(strings)
    hits = np.flatnonzero(index.matching_statistics() >= length)
    cuts = np.searchsorted(hits, begin)
    return [part - at for part, at in zip(np.split(hits, cuts[1:]), begin, strict=True)]


def covered(starts: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Maximal runs of bytes covered by windows at ``starts`` (ascending)."""
    if not len(starts):
        return [], []
    gap = np.flatnonzero(np.diff(starts) > length)
    first = np.concatenate([[0], gap + 1])
    last = np.concatenate([gap, [len(starts) - 1]])
    return starts[first].tolist(), (starts[last] + length).tolist()


# ── dealing out by content ───────────────────────────────────────────────────────────────
def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``KMER`` bytes at each place, by doubling."""
    table = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)}
    size = 1
    while size * 2 <= KMER:
        h, factor = table[size], np.uint64(pow(_BASE, size, 1 << 64))
        table[size * 2] = h[:-size] * factor + h[size:]
        size *= 2
    out, done = table[size], size
    for part in (2 ** i for i in range(20, -1, -1)):
        if part < size and (KMER & part):
            rest = table[part][done:]
            n = min(len(out), len(rest))
            out = out[:n] * np.uint64(pow(_BASE, part, 1 << 64)) + rest[:n]
            done += part
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def segments(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, size and number of every segment of a text."""
    firsts, sizes, numbers = [], [], []
    whole = np.frombuffer(data, np.uint8)
    n_windows = len(whole) - length + 1
    place_mask = np.uint64((1 << 24) - 1)
    for at in range(0, n_windows, CHUNK):
        windows = min(CHUNK, n_windows - at)
        hashes = _kmer_hashes(whole[at:at + windows + length - 1])
        keyed = (hashes & ~place_mask) | np.arange(len(hashes), dtype=np.uint64)  # leftmost of equal hashes
        place = (_sliding_min(keyed, length - KMER + 1) & place_mask).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        firsts.append(first + at)
        sizes.append(np.diff(np.append(first, windows)) + length - 1)
        numbers.append(hashes[place[first]].view(np.int64))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(firsts), np.concatenate(sizes), np.concatenate(numbers)


_KEY = ("doc_id", "text_key")


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Key and bytes of each row, and with ``carry`` the whole row as ``_row``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2 ** 63))).alias("doc_id"),
                       F.xxhash64(text).alias("text_key"), F.encode(text, "UTF-8").alias("data"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row")] if carry else []))


def _places(keyed: DataFrame, length: int) -> DataFrame:
    """doc_id, text_key, first, size, number, content of every segment."""
    schema = "doc_id long, text_key long, first long, size int, number long, content long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, keys, columns = part.column(0).to_numpy(), part.column(1).to_numpy(), []
                for row, data in enumerate(part.column(2).to_pylist()):
                    if len(data) < length:
                        continue
                    first, size, number = segments(data, length)
                    content = np.array([xxhash.xxh3_64_intdigest(data[a:a + b])
                                        for a, b in zip(first.tolist(), size.tolist(), strict=True)], np.uint64)
                    columns.append((np.full(len(first), ids[row]), np.full(len(first), keys[row]), first,
                                    size.astype(np.int32), number, content.view(np.int64)))
                if columns:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)],
                        names=["doc_id", "text_key", "first", "size", "number", "content"])
        give_back_memory()

    return keyed.mapInArrow(run, schema)


def _fetch(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of one copy of each distinct segment: number, content, n, large, data."""
    per_doc = wanted.groupBy(*_KEY).agg(F.collect_list(
        F.struct("number", "content", "n", "large", "first", "size")).alias("cuts"))
    return (keyed.join(per_doc, list(_KEY))
            .select("data", F.explode("cuts").alias("c"))
            .select("c.number", "c.content", "c.n", "c.large",
                    F.expr("substring(data, cast(c.first + 1 as int), c.size)").alias("data")))


def _marks(fetched: DataFrame, length: int) -> DataFrame:
    """number, content, starts, ends: repeated stretches within each distinct segment, by indexes."""
    schema = "number long, content long, starts array<int>, ends array<int>"

    def close(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[3] for r in rows], length)
        out = [(number, content, *(([0], [len(data)]) if n > 1 else covered(starts, length)))
               for (number, content, n, data), starts in zip(rows, found, strict=True)]
        out = [r for r in out if r[2]]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))],
            names=["number", "content", "starts", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, seen = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= INDEX_BYTES and row[0] != seen:
                    yield close(held)
                    held, size = [], 0
                if (row[0], row[1]) != (seen, held[-1][1] if held else None):  # a repeated row fetches twice
                    held.append(row)
                    size += len(row[3])
                seen = row[0]
        if held:
            yield close(held)
        held.clear()
        give_back_memory()

    dealt = (fetched.where("not large").select("number", "content", "n", "data")
             .repartition("number").sortWithinPartitions("number", "content"))
    return dealt.mapInArrow(run, schema)


def _large_marks(fetched: DataFrame, length: int) -> DataFrame:
    """The same for numbers with very many segments: windows counted by digest."""
    schema = "number long, content long, n long, start int, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for number, content, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                size = len(data) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, number)), pa.array(np.full(size, content)), pa.array(np.full(size, n)),
                     pa.array(np.arange(size, dtype=np.int32)),
                     pa.array([xxhash.xxh3_128_digest(data[i:i + length]) for i in range(size)], pa.binary())],
                    names=["number", "content", "n", "start", "digest"])

    windows = (fetched.where("large").select("number", "content", "n", "data")
               .dropDuplicates(["number", "content"]).mapInArrow(run, schema))
    common = windows.groupBy("digest").agg(F.sum("n").alias("all")).where("all > 1").select("digest")
    starts = F.array_sort(F.collect_list("start"))
    return (windows.join(common, "digest").groupBy("number", "content").agg(starts.alias("starts"))
            .select("number", "content", "starts", F.transform("starts", lambda s: s + length).alias("ends")))


def repeated_spans(keyed: DataFrame, length: int) -> DataFrame:
    """doc_id, text_key, spans: unmerged stretches to remove, per document that has any."""
    places = materialise(_places(keyed, length), "segment-places")
    numbers = (places.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("a"), F.max("content").alias("b"))
               .where("n > 1").select("number", (F.col("a") != F.col("b")).alias("mixed")))
    shared = materialise(places.join(numbers, "number"), "shared-places")
    distinct = (shared.where("mixed").groupBy("number", "content")
                .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY, "first", "size")).alias("at")))
    distinct = materialise(distinct.select("number", "content", "n", "at.*"), "distinct-segments")
    large = distinct.groupBy("number").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MAX_SEGMENTS)
    wanted = (distinct.join(large.select("number", F.lit(True).alias("large")), "number", "left")
              .withColumn("large", F.coalesce("large", F.lit(False))))
    fetched = _fetch(keyed, wanted)
    marks = _marks(fetched, length)
    if large.limit(1).count():
        marks = marks.unionByName(_large_marks(fetched, length))
    mixed = (shared.where("mixed").join(marks, ["number", "content"])
             .select(*_KEY, F.explode(F.arrays_zip("starts", "ends")).alias("s"), "first")
             .select(*_KEY, (F.col("first") + F.col("s.starts")).alias("start"), (F.col("first") + F.col("s.ends")).alias("end")))
    whole = shared.where("not mixed").select(*_KEY, F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("end"))
    return whole.unionByName(mixed).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cut(keyed: DataFrame, length: int, carried: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, starts, ends, kept of each row of ``keyed``, and ``_row`` where ``carried`` has it."""
    spans = repeated_spans(keyed, length)
    rows = (keyed if carried is None else carried).join(spans, list(_KEY), "left").select(
        "doc_id", "data", F.col("spans.start").alias("a"), F.col("spans.end").alias("b"), *([] if carried is None else ["_row"]))
    extra = "" if carried is None else f", _row {carried.schema['_row'].dataType.simpleString()}"
    schema = f"doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary{extra}"
    whole_characters = carried is not None  # the bytes become a text again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[tuple] = []
                for doc_id, data, firsts, ends in zip(*[c.to_pylist() for c in part.columns[:4]], strict=True):
                    a, b = merged(firsts or [], ends or [])
                    kept = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True))
                    if whole_characters and a:
                        kept = kept.decode("utf-8", "ignore").encode()
                    out.append((doc_id if doc_id != -(2 ** 63) else None, len(data), a, b, kept))
                longs = pa.list_(pa.int64())
                columns = [pa.array(c, t) for c, t in zip(
                    zip(*out, strict=True), (pa.int64(), pa.int64(), longs, longs, pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[4:]],
                                                 names=["doc_id", "n_bytes", "starts", "ends", "kept", "_row"][:5 + len(part.columns) - 4])
        give_back_memory()

    return rows.mapInArrow(run, schema)


def cut_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, starts and ends (maximal removed runs) and ``kept``, the bytes left."""
    if length <= KMER:
        raise ValueError(f"matches shorter than {KMER + 1} bytes are not looked for")
    return _cut(_keyed(docs, id_col, text_col), length)


def cut_documents(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with repeated stretches cut out of ``text``; characters cut in half go whole.

    A row of whose text no word is left is dropped, unless nothing was cut from it. ``n_chars``
    follows the text where there is such a column.
    """
    cut = _cut(_keyed(docs, "doc_id", "text"), length, _keyed(docs, "doc_id", "text", carry=True))
    text = F.col("kept").cast("string")
    rows = cut.where((F.size("starts") == 0) | text.rlike(WORD)).withColumn("_text", text)
    columns = [F.col("_text").alias(c) if c == "text" else
               F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c)
               for c in docs.columns]
    return rows.select(*columns)


def merged(firsts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Overlapping and touching stretches as maximal runs."""
    if not firsts:
        return [], []
    order = np.argsort(np.array(firsts), kind="stable")
    a, b = np.array(firsts)[order], np.maximum.accumulate(np.array(ends)[order])
    new = np.flatnonzero(a[1:] > b[:-1]) + 1
    return a[np.concatenate([[0], new])].tolist(), b[np.concatenate([new - 1, [len(b) - 1]])].tolist()
