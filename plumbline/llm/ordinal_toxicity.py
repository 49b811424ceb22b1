"""Toxicity as graded severity: a cumulative-link model over sparse word features.

One weight vector w serves all thresholds: P(grade > g) = sigmoid(w.x - theta_g), with
theta_0 < theta_1 < ... A feature is a hashed word, or the beginning of a longer word (``STEMS``
letters, so that inflected forms share one), that occurs in the text, once however often.
The output is the probability of every step, the expected severity (their sum) and the
likeliest grade.

Labels say toxic or not. Grades above 0 come from how many features of a toxic text go with the
label: those whose document odds in toxic texts exceed those in clean texts by ``ASSOCIATION``
and stand out from chance. They are counted and cut at the terciles of the labelled toxic texts.

The model is fitted on a bounded sample of labelled rows, ``per_class`` of each label at most
by the hash of the id, gathered as word numbers. Labels of each kind are counted over the whole
table, and a sampled row weighs as many labels as it stands for, so the thresholds follow the
table's share of toxic labels, however large it is. Scoring reads every text once, whole.

Nulls and texts without words have no features and get the intercept's severity. A label or an
id of null is no label; an id labelled twice counts twice. Without labels of both kinds the model
is neutral: severity 0 for all. Repeated rows get equal answers; an empty table gives an
empty result. Only id, text and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
#: Labelled rows of each class that the fit may gather.
PER_CLASS = 6_000
#: Log odds from which a word counts as going with the label.
ASSOCIATION = 2.0
GRADES = 4
MEMO = 400_000
STEMS = (4, 6)
EDGES = ".,;:!?\"'()[]{}#*$%&|<>-"


def word_numbers(text: str | None, memo: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The hashed numbers of each word and its beginnings, in order; case and punctuation at its ends don't count."""
    import xxhash

    out: list[int] = []
    if len(memo) > MEMO:
        memo.clear()
    for word in (text or "").lower().split():
        numbers = memo.get(word)
        if numbers is None:
            bare = word.strip(EDGES)
            parts = [bare, *[f"{bare[:n]}-" for n in STEMS if len(bare) >= n]] if bare else []
            numbers = memo[word] = tuple(xxhash.xxh3_64_intdigest(p) & ((1 << BITS) - 1) for p in parts)
        out += numbers
    return np.array(out, np.int32)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def steps(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > g) per row and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -50, 50)))


def grades_of(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 of labelled texts, from the label and the number of words in the text that go with it."""
    n = [int((~toxic).sum()), int(toxic.sum())]
    own = [np.unique(r) for r in rows]
    used = told_apart(own, toxic)
    found = [np.bincount(np.concatenate([r for r, t in zip(own, toxic, strict=True) if t == label]), minlength=1 << BITS)[used]
             for label in (False, True)]
    odds = np.log((found[1] + 0.5) / (n[1] + 1)) - np.log((found[0] + 0.5) / (n[0] + 1))
    tells = np.zeros(1 << BITS, bool)
    tells[used[odds > ASSOCIATION]] = True
    telling = np.array([int(tells[r].sum()) for r in own])
    cuts = np.quantile(telling[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic, 1 + np.searchsorted(cuts, telling, "left"), 0)


def told_apart(own: list[np.ndarray], toxic: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Features whose document shares in toxic and clean texts differ by ``least`` standard errors.

    A million hashed features meet a few thousand texts, so most of them differ by chance only.
    """
    found = [np.bincount(np.concatenate([r for r, t in zip(own, toxic, strict=True) if t == label] or [np.zeros(0, int)]),
                         minlength=1 << BITS) for label in (False, True)]
    n = [int((~toxic).sum()), int(toxic.sum())]
    both = (found[0] + found[1]) / sum(n)
    error = np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    apart = np.abs(found[1] / n[1] - found[0] / n[0])
    return np.flatnonzero((found[0] + found[1] >= 5) & (apart >= least * error))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 300, rate: float = 0.05, l2: float = 1e-3,
                stands_for: np.ndarray | None = None) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by Adam, with an l2 term.

    ``stands_for``: how many labelled rows each row stands for, one each if not given.
    """
    n_steps, n = GRADES - 1, len(rows)
    share = np.full(n, 1 / n) if stands_for is None else stands_for / stands_for.sum()
    own = [np.unique(r) for r in rows]
    used = told_apart(own, grades > 0)
    at = np.repeat(np.arange(n), [len(r) for r in own])
    word = np.concatenate(own)
    slot = np.full(1 << BITS, -1)
    slot[used] = np.arange(len(used))
    known = slot[word] >= 0
    at, word = at[known], slot[word[known]]
    # Parameters: weights, the first threshold, logarithms of the gaps to the next ones.
    x = np.concatenate([np.zeros(len(used)), [1.0], np.zeros(n_steps - 1)])
    mean, square, row = np.zeros_like(x), np.zeros_like(x), np.arange(n)
    for step in range(1, rounds + 1):
        gaps = np.exp(x[len(used) + 1:])
        theta = x[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)])
        scores = np.bincount(at, x[word], minlength=n)
        upper = 1 / (1 + np.exp(-np.clip(scores[:, None] - theta[None, :], -50, 50)))
        padded = np.concatenate([np.ones((n, 1)), upper, np.zeros((n, 1))], 1)
        chance = np.maximum(padded[row, grades] - padded[row, grades + 1], 1e-9)
        slope = padded * (1 - padded)
        pull = (slope[row, grades] - slope[row, grades + 1]) / chance * share
        by_theta = np.array([(slope[:, g + 1] / chance * share)[grades == g].sum()
                             - (slope[:, g + 1] / chance * share)[grades == g + 1].sum() for g in range(n_steps)])
        behind = np.cumsum(by_theta[::-1])[::-1]  # a gap moves every threshold behind it
        gradient = np.concatenate([np.bincount(word, pull[at], minlength=len(used)) - l2 * x[:len(used)] / max(1, len(used)),
                                   behind[:1], behind[1:] * gaps])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        x = x + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x[:len(used)]
    return OrdinalModel(weights, x[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(x[len(used) + 1:]))]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> OrdinalModel:
    """The model of at most ``per_class`` labelled texts of each label."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).unionByName(
        known.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            numbers = [word_numbers(t, memo).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.binary())],
                                             names=["doc_id", "label", "numbers"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Two times per_class ids at most, so the broadcast and what is gathered are bounded.
    sample = (texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
              .mapInArrow(run, "doc_id long, label int, numbers binary").toArrow().sort_by("doc_id"))
    rows = [np.frombuffer(x, np.int32) for x in sample["numbers"].to_pylist()]
    toxic = np.array(sample["label"].to_pylist(), int) == 1
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, 50.0))
    stands_for = {label: n / min(n, per_class) for label, n in totals.items()}
    return fit_ordinal(rows, grades_of(rows, toxic), stands_for=np.where(toxic, stands_for[1], stands_for[0]))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest), steps (P(grade > g)), toxic (P(grade > 0) at 0.5)."""
    schema = "doc_id long, severity double, grade int, steps array<double>, toxic boolean"
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        own = OrdinalModel(weights, thresholds)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = np.array([float(weights[np.unique(word_numbers(t, memo))].sum(dtype=np.float64))
                                   for t in part.column(1).to_pylist()])
                steps = own.steps(scores)
                edges = np.concatenate([np.ones((len(steps), 1)), steps, np.zeros((len(steps), 1))], 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(steps.sum(1)), pa.array(np.argmax(edges[:, :-1] - edges[:, 1:], 1).astype(np.int32)),
                     pa.array(list(steps), pa.list_(pa.float64())), pa.array(steps[:, 0] >= 0.5)],
                    names=["doc_id", "severity", "grade", "steps", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
