"""Chat samples, periodic runs and spelling variants against plain versions, and on odd and empty tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sample_texts import words

from plumbline.llm import chat_log, periodic_runs, spelling_variants
from plumbline.llm.common import let_workers_import
from plumbline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    let_workers_import(spark)


# ── chat samples ─────────────────────────────────────────────────────────────────────────
LOG = "conv_id long, seq long, kind string, turn long, message string, role string, text string"
ROWS = "conv_id long, turn long, role string, text string, seq string, message string, kind string"


def _plain_fold(events):
    """The log of one conversation, event by event."""
    said, opened, gone = {}, {}, set()
    for seq, kind, turn, message, role, text in sorted(set(events), key=lambda e: (e[0], e[5] or "")):
        if kind == "open":
            opened[turn, message], said[turn, message] = seq, [role or "", text or ""]
        elif kind == "delta":
            said[turn, message][1] += text or ""
        elif kind in ("edit", "regenerate"):
            said[turn, message][1] = text or ""
            if kind == "regenerate":
                gone |= {k for k in opened if k[0] > turn}
    return {k: tuple(v) for k, v in said.items() if k not in gone}


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_replaying_the_log(spark, seed):
    rng, log, expected = random.Random(seed), [], {}
    for conv in range(12):
        events, messages, seq = [], [], 0
        for _ in range(rng.randint(1, 40)):
            seq += rng.randint(1, 3)
            kind = rng.choice(("open", "delta", "delta", "edit", "regenerate")) if messages else "open"
            if kind == "open":
                # Some turns lie in another part of the running maximum.
                turn = rng.choice((0, 1, 2, 3, 5000, 9000))
                messages.append((turn, f"m{len(messages)}", rng.choice(("user", "assistant", None))))
                turn, message, role = messages[-1]
            else:
                turn, message, role = *rng.choice(messages)[:2], None
            text = None if kind == "regenerate" or rng.random() < 0.1 else rng.choice(("a", "b ", "</s>", "é"))
            events.append((seq, kind, turn, message, role, text))
        events += rng.sample(events, min(3, len(events)))  # delivered twice
        log += [(conv, *e) for e in events]
        expected |= {(conv, *k): v for k, v in _plain_fold(events).items()}
    rng.shuffle(log)
    got = chat_log.fold(spark.createDataFrame(log, LOG)).collect()
    assert {(r.conv_id, r.turn, r.message): (r.role, r.text) for r in got} == expected and len(got) == len(expected)


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\/s>", "<<|im_start|>|im_start|>", "<|im_sep|", "a\nb\\", "<",
         "[/INST", "é\U0001F600<s>", "\\<s>", "<\\s>", "[\\\\\\INST]"]


def test_control_strings_come_back(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("e", chat_log.escaped(F.col("t")))
    rows = df.withColumn("back", chat_log.unescaped(F.col("e"))).collect()
    control = re.compile(r"[<\[](/?s>|/?SYS>|/?INST\]|\|[a-z_]+\|>)")
    assert all(r.back == r.t and not control.search(r.e) for r in rows)
    assert next(r.e for r in rows if r.t == "plain") == "plain"


def test_samples_read_back(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(("user", "assistant", "to<s>ol")), rng.choice(TEXTS) + rng.choice(TEXTS), "x", "y", "z")
            for c in (*range(20), None) for t in range(rng.randint(1, 9))]
    rows += [(100, 0, "assistant", words(1, 3000) + "<s>", "x", "y", "z"), (100, 1, None, None, "x", "y", "z"), (101, None, "user", "late", "x", "y", "z"),
             (101, 4, "user", "again", "x", "y", "z"), (101, 4, "user", "again", "x", "y", "z"), (102, 1, "assistant", "", "x", "y", "z")]
    rendered = chat_log.samples(chat_log.fold(chat_log.log_of(spark.createDataFrame(rows, ROWS)))).collect()
    back = {r.conv_id: r for r in chat_log.read_samples(spark.createDataFrame(rendered)).collect()}
    expected = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == expected
    assert {c: "".join(r.learned) for c, r in back.items()} == {
        c: "".join(x for role, x in turns if role == "assistant") for c, turns in expected.items()}
    for r in rendered:
        assert sum(r.loss_runs) == len(r.formatted) == back[r.conv_id].n_chars
        at, under = 0, ""
        for i, size in enumerate(r.loss_runs):
            under, at = under + r.formatted[at:at + size] * (i % 2), at + size
        assert "<|im_end|>" not in under


def test_logs_without_rows_and_without_opening(spark):
    assert chat_log.samples(chat_log.fold(spark.createDataFrame([], LOG))).count() == 0
    lost = [(1, 5, "delta", 2, "m", None, "late"), (1, 6, "delta", 2, "m", None, "r"), (1, 6, "delta", 2, "m", None, "r")]
    assert [tuple(r) for r in chat_log.fold(spark.createDataFrame(lost, LOG)).collect()] == [(1, 2, "m", "", "later")]


def test_chat_operator_stays_in_the_jvm(spark):
    rows = spark.createDataFrame([], ROWS)
    plan = chat_log.digests(chat_log.samples(chat_log.fold(chat_log.log_of(rows))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ── periodic runs ────────────────────────────────────────────────────────────────────────
def _plain_runs(w, min_length=24, exponent=3):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        x = 0
        while x < n - q:
            s = x
            while x < n - q and w[x] == w[x + q]:
                x += 1
            size = x - s + q
            if x > s and size >= max(min_length, exponent * q) and not any(
                    all(w[s + k] == w[s + k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((s, size, q))
            x += x == s
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_all_lags(seed):
    rng = random.Random(seed)
    x: list[int] = []
    while len(x) < rng.choice((10, 60, 300)):
        kind = rng.random()
        piece = [rng.randrange(3 if kind < 0.7 else 500) for _ in range(rng.choice((1, 2, 5, 17, 33)))]
        x += piece * rng.choice((1, 1, 2, 3, 7, 20))
    assert periodic_runs.find_runs(np.array(x)) == _plain_runs(x)
    assert periodic_runs.find_runs(np.array(x), 9, 4) == _plain_runs(x, 9, 4)


def test_runs_whose_phrases_repeat_inside_the_period():
    # Every phrase of a period occurs twice in it, so neighbouring occurrences show smaller lags.
    a, b = list(range(20)), list(range(15)) + list(range(100, 107))
    x = (a * 2 + b * 2) * 3
    assert periodic_runs.find_runs(np.array(x)) == _plain_runs(x) == [(0, len(x), len(x) // 3)]
    assert periodic_runs.find_runs(np.zeros(20_000, np.int64)) == [(0, 20_000, 1)]
    assert periodic_runs.find_runs(np.tile(np.arange(6000), 3)) == [(0, 18_000, 6000)]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(5, np.int64), exponent=2)


def test_runs_on_odd_tables(odd, nothing):
    rows = periodic_runs.periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [tuple(r) for r in by_id[13].runs] == [(0, 500, 1)] and by_id[13].collapsed == "aaaa"
    assert all(by_id[i].n_words == 0 and by_id[i].runs == [] and by_id[i].collapsed == "" for i in (4, 5, 6))
    assert by_id[12].collapsed == "\x00 ﬁ ▁ <|endoftext|> \U0001F600"
    assert periodic_runs.periodic_runs(nothing).count() == 0
    planted = periodic_runs.with_planted_runs(odd)
    assert planted.count() == odd.count() and periodic_runs.with_planted_runs(nothing).count() == 0
    assert sum(r.doc_id is None for r in periodic_runs.digests(periodic_runs.periodic_runs(planted)).collect()) == 2


@TABLES
def test_periodic_query_equals_all_lags(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if n > 2000:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, kept = _plain_runs(w), [True] * n
        for s, size, q in runs:
            kept[s + q:s + size] = [False] * (size - q)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for x, k in zip(w, kept, strict=True) if k)).hexdigest()


# ── spelling variants ────────────────────────────────────────────────────────────────────
def _one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def _plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if _one_edit(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= ratio * counts[w] else None for w, b in best.items()}
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]]))
    return out


@pytest.mark.parametrize(("letters", "tile"), [("ab", 512), ("ab", 3), ("abcdé\U00010348", 4)])
def test_variants_equal_all_pairs(spark, letters, tile):
    rng = random.Random(tile)
    counts = {"".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 6, 7, 8)))): rng.choice((5, 6, 30, 31, 200, 2000)) for _ in range(220)}
    long = words(3, 60).replace(" ", "").replace("\n", "").replace(".", "")
    counts |= {long: 700, long[:-1]: 60, long[:90] + "q" + long[91:]: 5, long[1:]: 5, long + "zz": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling_variants.group_variants(df, tile=tile).collect()]
    assert len(got) == len(counts) and set(got) == _plain_variants(counts)


@TABLES
def test_spelling_query_equals_all_pairs(spark):
    lower, counts = str.maketrans(spelling_variants._UPPER, spelling_variants._LOWER), Counter()
    for doc_id, text in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = [tuple(r) for r in QUERIES["op13_spelling_variants"](spark, FOLDER).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(kept) and set(got) == _plain_variants(kept)


def test_words_are_counted_over_odd_tables(odd, nothing):
    got = {r.word: r.n for r in spelling_variants.word_counts(odd, 4, 1).collect()}
    texts = [r.text for r in odd.select("text").collect()]
    plain = Counter(w for t in texts for w in re.findall("[A-Za-zÀ-ÿ]{4,}", t or ""))
    assert got == dict(plain)
    assert spelling_variants.word_counts(odd, 4, 1, planted=2).count() > 0
    assert spelling_variants.group_variants(spelling_variants.word_counts(nothing)).count() == 0
