"""SentencePiece encoding by sampling: the Gumbel top-k segmentations of a text, without replacement.

A lattice holds every way to cut a text into pieces. A piece's log probability falls with the
logarithm of its rank in the vocabulary (``alpha`` is the power); characters without a piece
become their bytes. No piece reaches over a space, so the lattice is a chain of small ones,
one per unit (spaces and the run after them). A unit that recurs is solved once, and units are
solved side by side.

Backward sums give each node the mass behind it, so an edge has an exact conditional
probability, and a region of the search (a prefix, less the edges already used after it) an exact mass.
The search keeps regions in a heap by perturbed bound: the largest of all Gumbel-perturbed
scores in the region, drawn from a Gumbel truncated at the bound of the region it was split
from. The best region gives up its best segmentation, which is a draw from the
region, and falls into the regions that part from that segmentation at each of its pieces.
So the k first are the top k of all perturbed segmentations: k distinct draws. The bound left in the heap is
the (k + 1)-th score, and gives each sample the probability of being included at that threshold.

Draws depend on the seed, the row key and positions in the text only, so reruns, retries and
other batches agree. A null or empty text has one segmentation, the empty one. Texts with
fewer than k segmentations give as many rows. Rows that repeat a key and a text give the same
rows again. Only id and text are read. An empty table gives an empty result. Ids are written
with 16 bits, so a larger vocabulary is refused. A "▁" in a text is read as a space, as the
model does, and decodes to one.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back_memory

SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters of texts that are walked together, and share the units they have in common; a longer text is walked alone.
TOGETHER = 1_000_000
#: Pieces whose regions are drawn one by one.
NEAR = 64
#: A unit behind which no text has another.
NOTHING = np.iinfo(np.int64).max

SCHEMA = "doc_id long, sample int, ids binary, log_prob double, perturbed double, inclusion double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Ascending distinct hashes; the first bits of a hash say where to begin to look."""

    def __init__(self, ordered: np.ndarray) -> None:
        bits = max(1, (4 * len(ordered)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(ordered, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        # No hash is looked for behind the last one: the largest number ends the table.
        self.ordered = np.append(ordered, np.uint64(2 ** 64 - 1))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there; where it is not, the place means nothing."""
        slot = self.begin[wanted >> self.shift]
        behind = np.flatnonzero(self.ordered[slot] < wanted)
        while len(behind):
            slot[behind] += 1
            behind = behind[self.ordered[slot[behind]] < wanted[behind]]
        n = len(self.ordered) - 1
        known = (self.ordered[slot] == wanted) & (slot < n)
        return np.minimum(slot, n - 1), known


class Lattices:
    """The vocabulary, as one table of prefixes per length, and the spelling of other characters."""

    def __init__(self, model: str, alpha: float) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.model.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids of this model do not fit in 16 bits")
        plain = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i)
                                             or self.model.is_unknown(i) or self.model.is_unused(i))]
        total = math.log(sum((r + 1.0) ** -alpha for r in range(len(plain))))
        self.pieces = {self.model.id_to_piece(i): (i, -alpha * math.log(r + 1) - total) for r, i in enumerate(plain)}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece of this model reaches over a space")
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = -alpha * math.log(len(plain) + 1) - total
        self.size, self.spelled, self.codes = n, {}, []  # characters of several bytes get codes from n on
        self.tables = self._tables()

    def _tables(self) -> list[tuple[Hashes, np.ndarray, np.ndarray]]:
        """Per length: hashes of the prefixes of pieces in order, the piece that ends there (or -1), its score."""
        ending: list[dict[str, tuple[int, float]]] = [{} for _ in range(max(map(len, self.pieces)))]
        for piece, own in self.pieces.items():
            for size in range(1, len(piece)):
                ending[size - 1].setdefault(piece[:size], (-1, 0.0))
            ending[len(piece) - 1][piece] = own
        tables = []
        for size, own in enumerate(ending, 1):
            letters = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, size)
            hashes = np.zeros(len(own), np.uint64)
            for column in letters.T:
                hashes = _extended(hashes, column)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) != len(hashes):
                raise ValueError("two pieces of this model share a hash")
            codes, scores = (np.array([v[i] for v in own.values()])[order] for i in range(2))
            tables.append((Hashes(hashes[order]), codes, scores))
        return tables

    def spell(self, char: int) -> tuple[int, float]:
        """Code and score of a character that is no piece."""
        data = chr(char).encode()
        if len(data) == 1:
            return self.bytes[data[0]], self.byte_score
        if char not in self.spelled:
            self.spelled[char] = self.size + len(self.codes)
            self.codes.append([self.bytes[b] for b in data])
        return self.spelled[char], self.byte_score * len(data)

    def emit(self, codes: np.ndarray) -> np.ndarray:
        """Token ids of codes: spelled characters become their bytes."""
        if not len(codes) or codes.max() < self.size:
            return codes
        return np.array([i for c in codes.tolist() for i in (self.codes[c - self.size] if c >= self.size else (c,))])


def _extended(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return _mix(hashes + letters.astype(np.uint64) + np.uint64(1))


class Batch:
    """The lattices of some texts side by side, each distinct unit once: nodes and edges in flat arrays.

    A unit of n characters has n + 1 nodes. Edges are in node order; ``score`` is the log of an
    edge's probability at its node, ``upto`` the node's number plus the running probability.
    """

    def __init__(self, lattices: Lattices, texts: list[str]) -> None:
        distinct: defaultdict[str, int] = defaultdict()
        distinct.default_factory = distinct.__len__
        units = [[distinct[u] for u in UNITS.findall(SPACE + t.replace(" ", SPACE))] if t else [] for t in texts]
        lengths = np.array([len(u) for u in distinct], np.int64)
        letters = np.frombuffer("".join(distinct).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(letters))  # characters to the unit's end
        node = np.arange(len(letters)) + np.repeat(np.arange(len(lengths)), lengths)
        self.first_node = ends - lengths + np.arange(len(lengths))
        self.last_node = self.first_node + lengths
        self._solve(lattices, letters, left, node, len(letters) + len(lengths))
        counts = np.array([len(own) for own in units], np.int64)
        self.unit_of = np.fromiter(chain.from_iterable(units), np.int64, int(counts.sum()))
        self.n_docs, self.doc_of = len(texts), np.repeat(np.arange(len(texts)), counts)
        begins = np.cumsum(counts) - counts
        self.place_of = np.arange(len(self.unit_of)) - begins[self.doc_of]

    def _edges(self, lattices: Lattices, letters: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place, size, code and score of every edge, by place, long ones first.

        Prefixes grow a letter at a time while a piece may follow. A place has one edge of a
        size at most, so edges are dealt into their slots without a sort.
        """
        at, hashes = np.arange(len(letters)), np.zeros(len(letters), np.uint64)
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size, (table, codes, scores) in enumerate(lattices.tables, 1):
            hashes = _extended(hashes, letters[at + size - 1])
            slot, known = table.find(hashes)
            code = np.where(known, codes[slot], -1)
            if size == 1:
                bare = np.flatnonzero(code < 0)
                chars, which = np.unique(letters[bare], return_inverse=True)
                spelled = [lattices.spell(c) for c in chars.tolist()]
                own, score = (np.array([x[i] for x in spelled]) for i in range(2))
                if len(bare):
                    found.append((1, bare, own[which], score[which]))
            hit = np.flatnonzero(code >= 0)
            found.append((size, at[hit], code[hit], scores[slot[hit]]))
            known &= left[at] > size
            at, hashes = at[known], hashes[known]
            if not len(at):
                break
        free = np.zeros(len(letters) + 1, np.int64)
        for _, at, _, _ in found:
            free[at + 1] += 1
        np.cumsum(free, out=free)
        n = int(free[-1])
        place, sizes, codes, weights = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n)
        for size, at, code, score in reversed(found):
            slot = free[at]
            free[at] += 1
            place[slot], sizes[slot], codes[slot], weights[slot] = at, size, code, score
        return place, sizes, codes, weights

    def _solve(self, lattices: Lattices, letters: np.ndarray, left: np.ndarray, node: np.ndarray, n_nodes: int) -> None:
        """Backward sums, from the ends of all units towards their beginnings at once."""
        place, size, code, weight = self._edges(lattices, letters, left)
        own, remaining = node[place], left[place]
        beta = np.zeros(n_nodes)
        score = np.zeros(len(own))
        longest = int(left.max(initial=0))
        # Stable sorts of 16-bit numbers take one pass; only a very long unit needs more bits.
        by_left = np.argsort(remaining.astype(np.uint16) if longest < 1 << 16 else remaining, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(remaining, minlength=longest + 1)[1:])])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            edge = by_left[lo:hi]
            at = own[edge]
            total = weight[edge] + beta[at + size[edge]]
            first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            fan = np.diff(np.append(first, hi - lo))
            top = np.repeat(np.maximum.reduceat(total, first), fan)
            mass = np.log(np.add.reduceat(np.exp(total - top), first)) + top[first]
            beta[at[first]] = mass
            score[edge] = np.where(np.repeat(fan, fan) > 1, total - np.repeat(mass, fan), 0.0)
        counts = np.bincount(own, minlength=n_nodes)
        self.first_edge = np.concatenate([[0], np.cumsum(counts)])
        self.code, self.size, self.score = code, size, score
        running = np.concatenate([[0.0], np.cumsum(np.exp(score))])
        self.upto = own + np.minimum(1.0, running[1:] - running[self.first_edge[own]])
        last = self.first_edge[1:][counts > 0] - 1
        self.upto[last] = own[last] + 1.0

    def walk(self, seeds: np.ndarray, sample: int, behind_unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text a segmentation of the units behind the given one: edges, their nodes, and the unit each piece is in."""
        drawn = np.flatnonzero(self.place_of > behind_unit[self.doc_of])
        unit, doc, place = self.unit_of[drawn], self.doc_of[drawn], self.place_of[drawn]
        live = np.arange(len(drawn))
        node, ends = self.first_node[unit], self.last_node[unit]
        base = _mix(_mix(seeds + np.uint64(sample))[doc] + place.astype(np.uint64))
        walkers, nodes, edges, step = [], [], [], 0
        while len(live):
            u = (_mix(base[live] + np.uint64(step * 0x51_7C_C1B7)) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
            at = node[live]
            edge, target = self.first_edge[at], at + u
            behind = np.flatnonzero(self.upto[edge] <= target)
            while len(behind):  # long pieces come first and are likely, so few steps are needed
                edge[behind] += 1
                behind = behind[self.upto[edge[behind]] <= target[behind]]
            walkers.append(live)
            nodes.append(at)
            edges.append(edge)
            node[live] = at + self.size[edge]
            live = live[node[live] < ends[live]]
            step += 1
        if not walkers:
            none = np.zeros(0, np.int64)
            return [(none, none, none)] * self.n_docs
        steps = np.zeros(len(drawn), np.int64)
        for live in walkers:
            steps[live] += 1
        until = np.cumsum(steps)
        begin = until - steps
        node_of, edge_of = np.empty(int(until[-1]), np.int64), np.empty(int(until[-1]), np.int64)
        for step, live in enumerate(walkers):
            slot = begin[live] + step
            node_of[slot], edge_of[slot] = nodes[step], edges[step]
        cuts = np.concatenate([[0], until])[np.searchsorted(doc, np.arange(1, self.n_docs))]
        return list(zip(np.split(edge_of, cuts), np.split(node_of, cuts), np.split(np.repeat(place, steps), cuts), strict=True))


def _truncated(log_mass: np.ndarray, bound: float, rng: np.random.Generator, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` of Gumbel draws at ``log_mass``, each below ``bound``: their places and values.

    A draw is -log(exp(-bound) + E exp(-log_mass)), which falls with its second term, so the
    sum is taken of those wanted only. The smallest of many exponentials hardly differs from
    the bound, so sums stay in logs.
    """
    with np.errstate(divide="ignore"):
        term = np.log(rng.standard_exponential(len(log_mass))) - log_mass
    keep = np.argpartition(term, wanted)[:wanted] if len(term) > wanted else np.arange(len(term))
    keep = keep[np.argsort(term[keep], kind="stable")]
    return keep, -np.logaddexp(-bound, term[keep])


def _without(log_share: np.ndarray | float) -> np.ndarray:
    """Log of what a share leaves."""
    return np.log(-np.expm1(log_share))


class Search:
    """The k best perturbed segmentations of one text, one at a time.

    ``part`` takes the best region from the heap and says in which unit its best segmentation
    parts from its parent; ``take`` completes that with a walk of the units behind. Mass falls
    quickly along a text, so the regions behind the ``near`` first pieces are one region (with
    no used edges), which is divided should it ever come first.
    """

    def __init__(self, batch: Batch, whole: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, rng: np.random.Generator,
                 near: int = NEAR) -> None:
        self.batch, self.k, self.rng, self.near, self.pushed = batch, k, rng, near, 0
        self.leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.out: list[tuple[np.ndarray, float, float]] = []
        self.heap: list[tuple[float, int, int, int, tuple[int, ...], float]] = []
        self._leaf(whole, -math.log(rng.standard_exponential()), 0)

    def _push(self, draw: float, leaf: int, place: int, used: tuple[int, ...], before: float) -> None:
        heapq.heappush(self.heap, (-draw, self.pushed, leaf, place, used, before))
        self.pushed += 1

    def _leaf(self, leaf: tuple[np.ndarray, np.ndarray, np.ndarray], bound: float, since: int) -> None:
        """A segmentation found, and the best regions that part from it at piece ``since`` or later."""
        self.leaves.append(leaf)
        score = self.batch.score[leaf[0]]
        self.out.append((leaf[0], float(score.sum()), bound))
        until = min(since + self.near, len(score))
        places, mass, before = self._regions(leaf[0], since, until)
        rest = float(score[until:].sum())
        if rest < 0:
            places, before = np.append(places, until), np.append(before, score[:until].sum())
            mass = np.append(mass, before[-1] + _without(rest))
        self._push_best(len(self.leaves) - 1, places, mass, before, until, bound)

    def _regions(self, edges: np.ndarray, since: int, until: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places from ``since`` to ``until`` where another piece is possible, the mass of those, and that of the prefix."""
        score = self.batch.score[edges[since:until]]
        before = float(self.batch.score[edges[:since]].sum()) + np.cumsum(score) - score
        at = np.flatnonzero(score < 0)
        return since + at, before[at] + _without(score[at]), before[at]

    def _push_best(self, leaf: int, places: np.ndarray, mass: np.ndarray, before: np.ndarray, until: int, bound: float) -> None:
        """Draws for regions of a leaf; that at ``until`` holds all behind it."""
        edges = self.leaves[leaf][0]
        keep, draws = _truncated(mass, bound, self.rng, self.k + 1 - len(self.out))
        for i, draw in zip(keep.tolist(), draws.tolist(), strict=True):
            place = int(places[i])
            self._push(draw, leaf, place, (int(edges[place]),) if place < until else (), float(before[i]))

    def _divide(self) -> None:
        """The first region of the heap, one of all places from some piece on, becomes one region a place."""
        negative, _, leaf, since, _, _ = heapq.heappop(self.heap)
        edges = self.leaves[leaf][0]
        places, mass, before = self._regions(edges, since, len(edges))
        running = np.cumsum(np.exp(mass - mass.max()))
        first = min(int(np.searchsorted(running, self.rng.random() * running[-1], "right")), len(places) - 1)
        # One of them has the best score of all, the others' best ones lie below it.
        self._push(-negative, leaf, int(places[first]), (int(edges[places[first]]),), float(before[first]))
        places, mass, before = (np.delete(x, first) for x in (places, mass, before))
        self._push_best(leaf, places, mass, before, len(edges), -negative)

    def part(self) -> int | None:
        """The unit behind which the next segmentation is drawn anew; None if there is none."""
        if not self.heap or len(self.out) == self.k:
            return None
        if not self.heap[0][4]:
            self._divide()
        self.region = heapq.heappop(self.heap)
        _, _, parent, place, _, _ = self.region
        return int(self.leaves[parent][2][place])

    def take(self, tail: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        batch, rng = self.batch, self.rng
        negative, _, parent, place, used, before = self.region
        edges, nodes, units = self.leaves[parent]
        node, unit = int(nodes[place]), int(units[place])
        lo, hi = int(batch.first_edge[node]), int(batch.first_edge[node + 1])
        other = [e for e in range(lo, hi) if e not in used]
        weight = np.exp(batch.score[other])
        picked = other[min(int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), "right")), len(other) - 1)]
        walked, at = [(picked, node)], node + int(batch.size[picked])
        end = int(batch.last_node[np.searchsorted(batch.last_node, node, "right")])
        while at < end:
            u = rng.random()
            edge = min(int(np.searchsorted(batch.upto, at + u, "right")), int(batch.first_edge[at + 1]) - 1)
            walked.append((edge, at))
            at += int(batch.size[edge])
        own, bound = np.array(walked, np.int64), -negative
        rest = [e for e in other if e != picked]
        if rest:  # what else leaves the same node
            mass = before + math.log(np.exp(batch.score[rest]).sum())
            _, draws = _truncated(np.array([mass]), bound, rng, 1)
            self._push(float(draws[0]), parent, place, (*used, picked), before)
        self._leaf((np.concatenate([edges[:place], own[:, 0], tail[0]]),
                    np.concatenate([nodes[:place], own[:, 1], tail[1]]),
                    np.concatenate([units[:place], np.full(len(own), unit), tail[2]])), bound, place + 1)

    def found(self) -> list[tuple[np.ndarray, float, float, float]]:
        """(edges, log probability, perturbed score, inclusion) in falling order of the perturbed score."""
        limit = -self.heap[0][0] if self.heap and len(self.out) == self.k else -math.inf
        return [(edges, log_prob, g, -math.expm1(-math.exp(min(700.0, log_prob - limit))) if limit > -math.inf else 1.0)
                for edges, log_prob, g in self.out]


_LATTICES: dict[tuple[str, float], Lattices] = {}


def _lattices(model: str, alpha: float) -> Lattices:
    """One set of lattices per worker process, kept between tasks."""
    if (model, alpha) not in _LATTICES:
        _LATTICES[model, alpha] = Lattices(model, alpha)
    return _LATTICES[model, alpha]


def sample_texts(lattices: Lattices, keys: list[int | None], texts: list[str], k: int, seed: int,
                 near: int = NEAR) -> list[list[tuple]]:
    """Per text its samples as (ids, log probability, perturbed score, inclusion)."""
    batch = Batch(lattices, texts)
    numbers = np.array([(key or 0) & (2 ** 64 - 1) for key in keys], np.uint64)
    seeds = _mix(_mix(numbers + np.uint64(0x9E37_79B9_7F4A_7C15)) ^ np.uint64(seed))
    searches = [Search(batch, whole, k, np.random.Generator(np.random.PCG64(int(s))), near)
                for s, whole in zip(seeds, batch.walk(seeds, 0, np.full(len(texts), -1)), strict=True)]
    for sample in range(1, k):
        # Every text draws only what lies behind the unit where its next segmentation parts.
        parts = [search.part() for search in searches]
        since = np.array([NOTHING if unit is None else unit for unit in parts], np.int64)
        for search, unit, tail in zip(searches, parts, batch.walk(seeds, sample, since), strict=True):
            if unit is not None:
                search.take(tail)
    return [[(lattices.emit(batch.code[edges]), p, g, q) for edges, p, g, q in search.found()] for search in searches]


def _together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of the groups that are walked together."""
    first = size = 0
    for row, chars in enumerate(pc.utf8_length(texts).to_pylist()):
        if row > first and size + chars > TOGETHER:
            yield first, row - first
            first, size = row, 0
        size += chars
    if first < len(texts):
        yield first, len(texts) - first


def sample_segmentations(docs: DataFrame, model: str, k: int = 3, alpha: float = 1.0, seed: int = 10,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row k samples: doc_id, sample, ids (16-bit little-endian), log_prob, perturbed, inclusion.

    One pass without a shuffle. Texts are walked some at a time, each as a whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(model, alpha)
        for batch in batches:
            for at, n in _together(batch.column(1)):
                part = batch.slice(at, n)
                keys = part.column(0).to_pylist()
                found = sample_texts(lattices, keys, part.column(1).to_pylist(), k, seed)
                flat = [(key, i, ids.astype("<u2").tobytes(), p, g, q)
                        for key, own in zip(keys, found, strict=True) for i, (ids, p, g, q) in enumerate(own)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (
                        pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()), strict=True)],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])
        give_back_memory()

    return rows.mapInArrow(run, SCHEMA)


def decode(samples: DataFrame, model: str) -> DataFrame:
    """doc_id, sample, text of every row of ``samples``: the inverse of the encoding."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _lattices(model, 1.0).model
        for batch in batches:
            texts = [processor.decode(np.frombuffer(x, "<u2").tolist()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["doc_id", "sample", "text"])

    return samples.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")
