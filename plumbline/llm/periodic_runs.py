"""Periodic runs of words by seeds and diagonals, and texts with the repeated periods taken out.

A run is a stretch of words with smallest period q (words q apart are the same), as long as it
can be and at least max(``min_length``, ``exponent`` * q) words long. On the diagonal of lag q it
is a stretch of matches of at least max(min_length - q, (exponent - 1) * q) words, so every run
holds two equal k-grams q words apart, where

* k = (exponent - 1) * min_length // exponent serves the lags up to k, and
* 2k, 4k, ... serve the lags above k, 2k, ... up to themselves (this needs exponent >= 3).

Because k is never below the lag, equal k-grams inside a run of smallest period q lie exactly
q apart: were they d < q apart, d and q would both be periods of d + k >= d + q words, and so
would their greatest common divisor. Hence neighbouring occurrences of a k-gram are all the
pairs that need a look (never all pairs of a phrase said thousands of times), and a stretch
found at lag q has no smaller period. A seed is extended both ways over the words themselves;
a table of how far each lag is covered skips the seeds inside stretches already found.
k-grams are compared by 64-bit hashes, words by numbers of their own.

A row's work is linear in its words but for one sort per level, and levels stop at the first k
without a repeat, mostly the first. Nulls, empty and blank texts have no words, no runs and an
empty text. Rows are taken one by one: ids may be null or repeat, further columns are not
read, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, map_rows

MIN_LENGTH, EXPONENT = 24, 3


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of what begins with ``left`` and ends with ``right``."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words that begin at each place where so many are left."""
    h, size = ids.astype(np.uint64) + np.uint64(1), 1
    while 2 * size <= k:
        h, size = _joined(h[:-size], h[size:]), 2 * size
    return h if size == k else _joined(h[:size - k], h[k - size:])


def _matches_after(ids: np.ndarray, at: int, lag: int) -> int:
    """First place from ``at`` on whose word differs from the one ``lag`` later."""
    end, step = len(ids) - lag, 64
    while at < end:
        to = min(end, at + step)
        wrong = np.flatnonzero(ids[at:to] != ids[at + lag:to + lag])
        if len(wrong):
            return at + int(wrong[0])
        at, step = to, 2 * step
    return end


def _matches_before(ids: np.ndarray, at: int, lag: int) -> int:
    """First place of the stretch of matches that ends before ``at``."""
    step = 64
    while at > 0:
        since = max(0, at - step)
        wrong = np.flatnonzero(ids[since:at] != ids[since + lag:at + lag])
        if len(wrong):
            return since + int(wrong[-1]) + 1
        at, step = since, 2 * step
    return 0


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if exponent < 3 or min_length < exponent:
        raise ValueError("runs need an exponent of 3 or more and at least so many words")
    n, found = len(ids), []
    k = (exponent - 1) * min_length // exponent
    low = 0
    if n < min_length:
        return []
    h = gram_hashes(ids, k)
    while exponent * (low + 1) <= n and len(h) > 1:
        order = np.argsort(h, kind="stable")
        held = h[order]
        same = np.flatnonzero(held[1:] == held[:-1])
        if not len(same):
            break
        at = order[same]
        lag = order[same + 1] - at
        fits = (lag > low) & (lag <= k)
        at, lag = at[fits], lag[fits]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # Of neighbouring seeds of one lag only the first can open a stretch.
        opens = np.ones(len(at), bool)
        opens[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(at[opens].tolist(), lag[opens].tolist(), strict=True):
            if covered.get(q, -1) > i:
                continue
            start, end = _matches_before(ids, i, q), _matches_after(ids, i, q)
            covered[q] = end
            if end - start + q >= max(min_length, exponent * q):
                found.append((start, end - start + q, q))
        if len(h) <= k:
            break
        h, low, k = _joined(h[:-k], h[k:]), k, 2 * k
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  exponent: int = EXPONENT) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period in words), collapsed.

    ``collapsed`` has the words that no run contains after its first period, one space between
    any two.
    """
    def search(rows: list[tuple], _: None) -> list[tuple]:
        out = []
        for doc_id, text in rows:
            # bytes.split() cuts at ASCII white space, as WORD does.
            words = (text or b"").split()
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            runs = find_runs(ids, min_length, exponent)
            if runs:
                kept = np.ones(len(words), bool)
                for start, length, period in runs:
                    kept[start + period:start + length] = False
                words = [words[i] for i in np.flatnonzero(kept)]
            out.append((doc_id, len(ids), [{"start": a, "length": b, "period": c} for a, b, c in runs], b" ".join(words)))
        return out

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return (map_rows(read, search, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
            .select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth id (by its checksum) says a part of its words over and over from some word on.

    With h = crc32 of the decimal id, g = h div 10 and n words: if 10 divides h and n > 0, word
    i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). A
    row without an id stays as it is.
    """
    chosen = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    planted = F.when(F.col("h") % 10 == 0, words)
    numbered = (chosen.withColumn("words", planted).withColumn("n", F.size("words"))
                .withColumn("a", F.expr("CASE WHEN n > 0 THEN cast((h div 10) % n AS int) END"))
                .withColumn("p", F.expr("CASE WHEN n > 0 THEN cast(1 + (n - a) div (3 + (h div 10) % 8) AS int) END")))
    said = F.expr("array_join(transform(words, (w, i) -> CASE WHEN i < a THEN w ELSE words[a + (i - a) % p] END), ' ')")
    return numbered.select("doc_id", F.when(F.col("n") > 0, said).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of each row of ``periodic_runs`` its count of runs, the run said most often over, and digests."""
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # Runs come by start and period, so only a greater exponent displaces an earlier one.
    best = F.aggregate("runs", nothing, lambda a, r: F.when(
        a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
