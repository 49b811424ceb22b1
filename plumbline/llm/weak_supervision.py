"""Quality rules as weak labels: rules vote or abstain, EM weighs them, a posterior decides.

A document is not asked to pass every rule. Each rule says good, bad or nothing; expectation
maximisation finds how often each rule says what for good and for bad documents, from the
votes of all documents and no labels; the posterior probability of "good" is the verdict.

Votes are a pattern of a few rules, so there are at most 3 ** rules different patterns.
Spark counts documents per pattern, and EM over those counts gives what EM over every
document would: the driver holds the patterns, never documents.

Nulls count as empty texts, empty texts have no words and fail the base rule, repeated rows
count as often as they occur, and an empty table gives an empty result. Only the id and the
text column are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm.common import give_back_memory, map_rows
from plumbline.session import materialise

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for on with as was be by at this are from or an have he "
    b"de la el que y en un una los las por con no se del su al es lo como "
    b"le les des et est une du dans qui pour pas sur ne ce au plus par il "
    b"der die und das von den mit zu ist des im auf dem nicht ein eine sich auch fur er".split())
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

FEATURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_lines long, n_upper_words long, n_function_words long, n_distinct_words long")


def _repeat_words(ids: np.ndarray, n_ids: int) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * n_ids + ids[1:]
    if n_ids > 2_000_000:  # the third factor would leave 64 bits
        values, pair = np.unique(pair, return_inverse=True)
    _, inverse, counts = np.unique(pair[:-1] * n_ids + ids[2:], return_inverse=True, return_counts=True)
    window = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:len(window) + shift] |= window
    return int(covered.sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts that rules look at, over the whole text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(ids, len(seen)),
        len(lines),
        sum(map(bytes.isupper, words)),
        sum(w in FUNCTION_WORDS for w in data.lower().split()),
        len(seen),
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and counts. One pass, no shuffle."""
    return map_rows(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
        lambda rows, _: [(key, *text_features(text)) for key, text in rows], f"doc_id long, {FEATURES}")


@dataclass(frozen=True)
class Rule:
    """Votes bad (0) or good (2) where its condition holds, else abstains (1)."""

    name: str
    bad: Column
    good: Column

    @property
    def vote(self) -> Column:
        return F.when(self.bad, 0).when(self.good, 2).otherwise(1)


def _share(part: str) -> Column:
    return F.col(part) / F.greatest(F.col("n_words"), F.lit(1))


def default_rules() -> tuple[Rule, ...]:
    never = F.lit(False)
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return (
        Rule("length", F.col("n_words") < 20, F.col("n_words") >= 50),
        Rule("symbols", _share("n_symbols") > 0.2, _share("n_symbols") < 0.02),
        Rule("shouting", _share("n_upper_words") > 0.5, _share("n_upper_words") < 0.1),
        Rule("repetition", _share("n_repeat_words") > 0.35, _share("n_repeat_words") < 0.15),
        Rule("lines", (F.col("n_lines") >= 8) & (F.col("n_dup_lines") / lines > 0.3), never),
        Rule("function_words", _share("n_function_words") < 0.03, _share("n_function_words") > 0.1),
        Rule("word_length", (mean < 2.5) | (mean > 12), (mean >= 3.5) & (mean <= 9)),
        Rule("variety", (F.col("n_words") >= 20) & (_share("n_distinct_words") < 0.15), never),
    )


@dataclass(frozen=True)
class VoteModel:
    """``prior`` of good; ``said[rule][class][vote]`` with classes bad, good and votes bad, none, good."""

    prior: float
    said: np.ndarray
    iterations: int

    def evidence(self) -> np.ndarray:
        """Log odds for good that each vote of each rule adds."""
        return np.log(self.said[:, 1]) - np.log(self.said[:, 0])

    def accuracy(self) -> np.ndarray:
        """Per rule and class: how often a vote that was cast is right."""
        cast = self.said[:, :, 0] + self.said[:, :, 2]
        return np.stack([self.said[:, 0, 0] / cast[:, 0], self.said[:, 1, 2] / cast[:, 1]], 1)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, iterations: int = 200, smoothing: float = 1.0) -> VoteModel:
    """EM over pattern counts. Starts from "bad if any rule says bad", so classes keep their names."""
    n_rules = patterns.shape[1]
    good = np.where((patterns == 0).any(1), 0.1, 0.95)
    picked = np.stack([patterns == v for v in range(3)], 2).astype(float)  # pattern, rule, vote
    total, step, prior = float(counts.sum()), 0, 0.5
    said = np.full((n_rules, 2, 3), 1 / 3)
    for step in range(1, iterations + 1):
        weight = np.stack([(1 - good) * counts, good * counts])
        said = np.einsum("cp,prv->rcv", weight, picked) + smoothing
        said /= said.sum(2, keepdims=True)
        prior = (weight[1].sum() + smoothing) / (total + 2 * smoothing)
        odds = np.log(prior) - np.log1p(-prior) + np.einsum("prv,rv->p", picked, np.log(said[:, 1]) - np.log(said[:, 0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return VoteModel(float(prior), said, step)


def votes_of(stats: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return stats.select("*", *[r.vote.cast("int").alias(f"vote_{r.name}") for r in rules])


def fit(stats: DataFrame, rules: tuple[Rule, ...]) -> VoteModel:
    """The model of all rows of ``stats``; at most 3 ** len(rules) pattern counts reach the driver."""
    names = [f"vote_{r.name}" for r in rules]
    found = votes_of(stats, rules).groupBy(*names).count().collect()
    patterns = np.array([r[:-1] for r in found], int).reshape(-1, len(rules))
    return fit_votes(patterns, np.array([r[-1] for r in found], float))


def score(stats: DataFrame, rules: tuple[Rule, ...], model: VoteModel) -> DataFrame:
    """Adds ``quality``, the posterior of good: a sum of constants, so no join."""
    odds = F.lit(float(np.log(model.prior) - np.log1p(-model.prior)))
    for rule, row in zip(rules, model.evidence(), strict=True):
        vote = F.col(f"vote_{rule.name}")
        odds = odds + F.when(vote == 0, float(row[0])).when(vote == 1, float(row[1])).otherwise(float(row[2]))
    return votes_of(stats, rules).withColumn("quality", 1 / (1 + F.exp(-odds)))


def judge(docs: DataFrame, threshold: float = 0.5, rules: tuple[Rule, ...] | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts, votes, posterior ``quality``, ``base_failed`` and ``kept``.

    The counts are written once and read twice, by the fit and by the scoring; texts are read
    once.
    """
    rules = rules or default_rules()
    stats = materialise(features(docs, id_col, text_col), "quality-counts")
    base = _base_failed()
    return (score(stats, rules, fit(stats, rules))
            .withColumn("base_failed", base)
            .withColumn("kept", ~base & (F.col("quality") >= threshold)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a kept text; columns as they are.

    The verdict follows from the text alone once the model is fitted, so a second pass takes it
    row by row, whatever ids repeat or are missing, and no text is shuffled.
    """
    rules = default_rules()
    model = fit(features(docs), rules)  # its only reader, so the counts need not be written
    counted = StructType.fromDDL(FEATURES)
    target = to_arrow_schema(counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = zip(*map(text_features, part.column(0).field(at_text).cast(pa.string()).to_pylist()), strict=True)
                columns = [pa.array(c, f.type) for c, f in zip(found, target, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["_row", *target.names])
        give_back_memory()

    # The row goes to the worker with its text once.
    at_text = docs.columns.index("text")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    beside = whole.mapInArrow(count, StructType([whole.schema["_row"], *counted.fields]))
    kept = score(beside, rules, model).where(~_base_failed() & (F.col("quality") >= 0.5))
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
