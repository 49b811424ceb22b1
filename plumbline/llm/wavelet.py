"""Token ids as wavelet matrices: one file per shard that answers access, count and select.

A block of about ``BLOCK`` ids is a wavelet matrix: one plane of bits per bit of an id, most
significant first, each plane followed by a stable partition of zeros before ones. Beside the
bits a plane keeps the ones before every ``STEP`` bits, so rank is a lookup and a short count.
Blocks are rows of a Parquet file (zstd) that Spark's committer writes, one file per range of
ids, so a lost executor leaves no half file and any store that Spark writes to will do.

Shards hold ascending ids: the table is dealt out by range of the id and sorted, texts are
encoded after that move, and the number of a task and of its block give the order of blocks.
A null text is empty and consists of the end id; rows without an id come first; rows that
repeat an id are documents of their own beside each other; an empty table gives an empty
result. Only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1_000_000
STEP = 512
#: Bytes of text that are encoded at once; a word is looked up once in them.
SLICE = 8_000_000
#: Words of one generation of the memo.
MEMO = 400_000

SHARD = ("shard int, block int, n_tokens long, doc_ids array<long>, sizes array<int>, width int, "
         "zeros array<int>, planes array<binary>, ones array<binary>")


@dataclass(frozen=True)
class WaveletMatrix:
    n: int
    zeros: list[int]
    planes: list[bytes]
    ones: list[bytes]

    @property
    def width(self) -> int:
        return len(self.planes)

    @staticmethod
    def build(ids: np.ndarray, width: int) -> WaveletMatrix:
        x = ids.astype(np.uint16 if width <= 16 else np.uint32)
        other, steps = np.empty_like(x), -(-len(x) // STEP)
        zeros, planes, ones = [], [], []
        for bit in range(width - 1, -1, -1):
            high = (x & x.dtype.type(1 << bit)).astype(bool)
            packed = np.packbits(high, bitorder="little")
            words = np.zeros(steps * STEP // 64, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            per_step = np.bitwise_count(words).reshape(steps, STEP // 64).sum(1, dtype=np.int32)
            planes.append(packed.tobytes())
            ones.append(np.concatenate([[0], np.cumsum(per_step)]).astype(np.int32).tobytes())
            # Places are taken, since a choice by random bits costs a wrong guess per bit.
            above, below = np.flatnonzero(high), np.flatnonzero(~high)
            zeros.append(len(below))
            np.take(x, below, out=other[:len(below)], mode="clip")
            np.take(x, above, out=other[len(below):], mode="clip")
            x, other = other, x
        return WaveletMatrix(len(ids), zeros, planes, ones)

    def _bits(self, plane: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.planes[plane], np.uint8), count=self.n, bitorder="little").view(bool)

    def _rank(self, plane: int, at: int) -> int:
        """Ones of a plane before ``at``."""
        step = at // STEP
        start = step * STEP // 8
        rest = np.frombuffer(self.planes[plane], np.uint8, -(-at // 8) - start, start)
        bits = np.unpackbits(rest, bitorder="little")[:at - step * STEP]
        return int(np.frombuffer(self.ones[plane], np.int32)[step]) + int(bits.sum())

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up: each partition is undone by its bits."""
        x = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for plane in range(self.width - 1, -1, -1):
            high = self._bits(plane)
            up = np.empty_like(x)
            up[np.flatnonzero(~high)] = x[:self.zeros[plane]]
            up[np.flatnonzero(high)] = x[self.zeros[plane]:] | x.dtype.type(1 << (self.width - 1 - plane))
            x = up
        return x

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.width):
            bit = self.planes[plane][at >> 3] >> (at & 7) & 1
            ones = self._rank(plane, at)
            at = self.zeros[plane] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.width:
            return 0, 0
        for plane in range(self.width):
            a, b = self._rank(plane, lo), self._rank(plane, hi)
            if token >> (self.width - 1 - plane) & 1:
                lo, hi = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token: its run in the last level, followed up through every plane."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b)
        for plane in range(self.width - 1, -1, -1):
            high = self._bits(plane)
            places = np.flatnonzero(high if token >> (self.width - 1 - plane) & 1 else ~high)
            at = places[at - self.zeros[plane] if token >> (self.width - 1 - plane) & 1 else at]
        return at

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0)."""
        return int(self.occurrences(token)[k])


class WordEncoder:
    """A tokenizer that drops white space, remembering what each word encodes to.

    Such a tokenizer cuts at white space before anything else, so a text's ids are those of
    its words. Where it lowers letters and then cuts as ``_CUT`` does (tried once, at the start),
    texts of Latin letters are lowered before words are looked up, unknown words of Latin letters
    are cut here, and only pieces not met before go through the model. Other unknown words go through the
    library's own steps together: normalizer, pre-tokenizer, model. Texts with characters on
    which Python and the library disagree about white space are encoded whole. Two generations
    of words are kept, so frequent ones stay.
    """

    _ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    #: What is not cut here: all but ASCII and Latin letters below U+0250, which have one code point each, and so have
    #: their lower case forms, but for U+0130, which lowers to a letter and a combining sign that the tokenizer cuts
    #: apart; and what may name a special token.
    _STRANGE = re.compile("[^!-~À-ÖØ-öø-įı-ɏ]|<\\|")
    #: A sign that ends a word. No piece holds a letter or digit before a sign, so the sign may as well stand alone,
    #: and a word is the same word with a comma behind it.
    _END = r"([0-9a-zß-öø-ÿ])([!,.:;?])[ \n]"
    #: Contractions, letters, a digit, other signs, of lowered words.
    _CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^!-`{-~]+|[0-9]|[!-/:-@\[-`{-~]+")

    def __init__(self, path: str, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.memo, self.young, self.old, self.pieces = memo, {}, {}, {}
        normal, cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        signs = "".join(map(chr, range(33, 127)))
        letters = "".join(c for c in map(chr, range(0xC0, 0x250)) if not self._STRANGE.search(c))
        #: The pre-tokenizer's spelling of each character.
        self.spelling = {ord(c): cut(c)[0][0] for c in set((signs + letters).lower())}
        probe = ["Ab", "cD's", "don''T", "we'Re", "I'VE", "'m'll'd", "x'y", "12a3", "é!?é", "a.b,", *signs, signs, letters]
        self.cuts = [x for x, _ in cut(normal(" ".join(probe)))] == [
            x.translate(self.spelling) for word in probe for x in self._CUT.findall(word.lower())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Arrow tells the different words, so each is looked up once a call."""
        whole = {i: t for i, t in enumerate(texts) if any(c in t for c in self._ODD)}
        plain = ["" if i in whole else self._lowered(t) for i, t in enumerate(texts)]
        # White space beyond ASCII is cut here; an empty word, as Arrow finds at either end, has no ids.
        rows = pa.array([t if t.isascii() else " ".join(t.split()) for t in plain], pa.string())
        if self.cuts:
            rows = pc.replace_substring_regex(rows, self._END, r"\1 \2 ")
        split = pc.ascii_split_whitespace(rows)
        coded = split.flatten().dictionary_encode()
        found = pa.array(self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        _, places, data = found.take(coded.indices).buffers()
        ids = np.frombuffer(data or b"", np.uint32)
        cuts = np.frombuffer(places, np.int64)[split.offsets.to_numpy()] >> 2
        out = [ids[x:y] for x, y in pairwise(cuts.tolist())]
        for i, text in whole.items():
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return out

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        found = list(map(self.young.get, words))
        holes = [i for i, ids in enumerate(found) if ids is None]
        if len(self.young) + len(holes) > self.memo:
            self.old, self.young = self.young, {}
            holes = list(range(len(words)))
        unknown = []
        for i in holes:
            ids = self.old.get(words[i])
            if ids is None:
                unknown.append(words[i])
            else:
                self.young[words[i]] = ids
        if len(self.pieces) > 2 * self.memo:
            self.pieces = {}
        for at in range(0, len(unknown), 4096):
            self._learn_all(unknown[at:at + 4096])
        for i in holes:
            found[i] = self.young[words[i]]
        return found

    def _lowered(self, text: str) -> str:
        """The text in lower case, if that is surely what the tokenizer makes of it; fewer different words are left."""
        if not self.cuts or "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def _learn_all(self, words: list[str]) -> None:
        strange, known, young = self._STRANGE.search, self.pieces, self.young
        # A letter between the words neither makes nor hides a strange one.
        rest = words if not self.cuts else [w for w in words if strange(w)] if strange("a".join(words)) else []
        odd = set(rest)
        for word in words:
            if word in odd:
                continue
            lowered = word.lower()
            parts = (lowered,) if lowered.isalpha() else self._CUT.findall(lowered)
            for piece in parts:
                if piece not in known:
                    known[piece] = self._model(piece.translate(self.spelling))
            young[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[x] for x in parts])
        if rest:
            self._learn(rest)

    def _model(self, cut: str) -> bytes:
        return array("I", [x.id for x in self.tokenize(cut)]).tobytes()

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if "<|" not in w]
        special = set(words) - set(plain)  # may name a special token, which the steps below would not see
        joined = self.tokenizer.normalizer.normalize_str(" ".join(plain))
        if len(joined.split(" ")) != len(plain):
            special, plain, joined = set(words), [], ""
        ids: list[list[bytes]] = [[] for _ in plain]
        ends = np.cumsum([len(w) + 1 for w in joined.split(" ")]) if plain else np.zeros(0, int)
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(joined)
        owner = np.searchsorted(ends, [span[0] for _, span in found], "right").tolist()
        for (piece, _), word in zip(found, owner, strict=True):
            ids[word].append(self._model(piece))
        for word, parts in zip(plain, ids, strict=True):
            self.young[word] = b"".join(parts)
        for word in special:
            self.young[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _cuts(texts: pa.Array) -> list[int]:
    """Where a batch is cut: after about ``SLICE`` bytes of text, or behind one longer text."""
    passed = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // SLICE
    return [0, *(np.flatnonzero(np.diff(passed)) + 1).tolist(), len(texts)]


def _block(shard: int, block: int, doc_ids: list, parts: list[np.ndarray], width: int) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit in {width} bits")
    m = WaveletMatrix.build(ids, width)
    row = (shard, block, m.n, doc_ids, [len(p) for p in parts], width, m.zeros, m.planes, m.ones)
    types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(),
             pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)],
                                      names=[c.split()[0] for c in SHARD.split(", ")])


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 16,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, end each with ``end_id``, and write the shards in ascending id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = _encoder(tokenizer), np.array([end_id], np.uint32)
        shard, block, held, doc_ids, parts = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            for at, end_at in pairwise(_cuts(batch.column(1))):
                part = batch.slice(at, end_at - at)
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    doc_ids.append(key)
                    parts.append(np.concatenate([ids, end]))
                    held += len(parts[-1])
                    if held >= BLOCK:
                        yield _block(shard, block, doc_ids, parts, width)
                        block, held, doc_ids, parts = block + 1, 0, [], []
        if parts:
            yield _block(shard, block, doc_ids, parts, width)

    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SHARD)
     .write.option("compression", "zstd").parquet(folder))


def read_documents(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), and if wanted ids (the same bytes).

    All ids are decoded in any case; ids that nobody wants need not leave the Python worker.
    """
    shards = spark.read.parquet(folder)
    schema = "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, n, doc_ids, sizes, zeros, planes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = memoryview(WaveletMatrix(n, zeros, planes, []).decode().astype("<u4")).cast("B")
                ends = np.cumsum(sizes)
                own = [ids[4 * (b - a):4 * b] for a, b in zip(sizes, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(own), pa.int32()), pa.array([block] * len(own), pa.int32()), pa.array(doc_ids, pa.int64()),
                     pa.array(ends - np.array(sizes)), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                     *([pa.array([bytes(x) for x in own], pa.binary())] if with_ids else [])],
                    names=[c.split()[0] for c in schema.split(", ")])

    docs = shards.select("shard", "block", "n_tokens", "doc_ids", "sizes", "zeros", "planes").mapInArrow(run, schema)
    # Ids before a block: those of earlier shards (one row each) and of earlier blocks of its shard.
    earlier_shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    earlier_blocks = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(earlier_shards), F.lit(0)).alias("before"))
    offsets = shards.select("shard", "block", "n_tokens").withColumn(
        "offset", F.coalesce(F.sum("n_tokens").over(earlier_blocks), F.lit(0))).join(by_shard, "shard").select(
        "shard", "block", (F.col("before") + F.col("offset")).alias("offset"))
    return docs.join(offsets, ["shard", "block"]).select(
        "doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """shard, block, n and places of a token, answered from the bit planes without decoding."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, n, zeros, planes, ones in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = WaveletMatrix(n, zeros, planes, ones).occurrences(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(at)], pa.int64()),
                     pa.array([at.tolist()], pa.list_(pa.int64()))], names=["shard", "block", "n", "places"])

    return spark.read.parquet(folder).select("shard", "block", "n_tokens", "zeros", "planes", "ones").mapInArrow(
        run, "shard int, block int, n long, places array<long>")
