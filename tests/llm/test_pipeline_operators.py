"""Each operator against a plain version of itself, and on odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sample_texts import words

from plumbline.llm import (
    lattice_sampling,
    merkle,
    minhash,
    minimax_shards,
    ordinal_toxicity,
    run_length_index,
    source_mix,
    token_rollups,
    wavelet,
    weak_supervision,
)
from plumbline.llm.common import bucket_bits, let_workers_import, running_total
from plumbline.llm.components import connected_components
from plumbline.session import Scratch, shared_folder

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    let_workers_import(spark)


# ── wavelet matrices ─────────────────────────────────────────────────────────────────────
@pytest.mark.parametrize("n", [0, 1, 8, 513, 3000])
def test_wavelet_matrix_answers(n):
    x = np.random.default_rng(n).integers(0, 200, n).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(x, 8)
    assert (m.decode() == x).all()
    for token in (0, 7, 199, 255, 4000):
        assert m.count(token) == (x == token).sum()
        assert m.count(token, n // 3, n // 2) == (x[n // 3:n // 2] == token).sum()
        if token < 256:
            assert m.occurrences(token).tolist() == np.flatnonzero(x == token).tolist()
    for at in range(0, n, max(1, n // 9)):
        assert m.access(at) == x[at]
        assert m.select(int(x[at]), int((x[:at] == x[at]).sum())) == at


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    own, library = wavelet.WordEncoder(BPE, memo=50), Tokenizer.from_file(BPE)
    texts = ["don't  we'll 12　３４ naïve é", "É́ ﬁ İstanbul ΑΣ \x1c q\x85z", "", "  ", "a<|endoftext|>b x", words(3, 300), words(4, 300)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    for text in texts:  # one at a time, after the memo has turned over
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_that_grow_when_lowered():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    latin = [f"{chr(c)}tan {chr(c)}. a{chr(c)}b" for c in range(0x21, 0x250)]
    for texts in (["İstanbul", "İzmir, İSTANBUL. istanbul"], latin):
        for text, ids in zip(texts, wavelet.WordEncoder(BPE).encode(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_of_one_lower_case_are_learnt_once():
    from tokenizers import Tokenizer

    own, library = wavelet.WordEncoder(BPE), Tokenizer.from_file(BPE)
    modelled = []
    own._model = lambda cut, model=own._model: modelled.append(cut) or model(cut)
    texts = ["Word wORD, word. WORD's don''t 12a3 ***x", "Œuvre cœur ÉTÉ Été", "word <|ENDOFTEXT|> Word <|endoftext|> WORD"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert modelled.count("word") == 1 and len(set(modelled)) == len(modelled)


def test_a_sign_behind_a_word_makes_no_new_word():
    from tokenizers import Tokenizer

    own, library = wavelet.WordEncoder(BPE), Tokenizer.from_file(BPE)
    texts = ["alpha, beta. alpha; été: beta\nalpha! x", "  alpha.\nbeta? 9. été, ", "", "\x1c a, b",
             "a., b '. c don't. 's, d). e'll, ÷. f ×, µ. ª, 日. ΑΣ. q, <|endoftext|>. g É́. h\u0301. i\u0301, j,\tk"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert {"alpha", "beta", "été", "9", "."} <= own.young.keys()
    assert not {"alpha,", "alpha.", "alpha;", "alpha!", "beta.", "beta?", "été:", "9."} & own.young.keys()
    assert [len(x) for x in own.encode([" ", "", "\n\n"])] == [0, 0, 0] and own.encode([]) == []


def test_batches_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(wavelet, "SLICE", 10)
    assert wavelet._cuts(pa.array(["aaaa", "bbbb", "cc", "", "d" * 50, "e"])) == [0, 2, 4, 6]
    assert wavelet._cuts(pa.array(["a"])) == [0, 1]


def test_ids_need_not_leave_the_worker(spark, odd):
    at = shared_folder(spark, "wavelet-narrow")
    wavelet.write_shards(odd, at, BPE, end_id=2)
    whole, narrow = wavelet.read_documents(spark, at), wavelet.read_documents(spark, at, with_ids=False)
    assert narrow.columns == whole.drop("ids").columns
    assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.drop("ids").collect()))


def test_token_shards_round_trip(spark, odd):
    from tokenizers import Tokenizer

    at = shared_folder(spark, "wavelet-test")
    wavelet.write_shards(odd, at, BPE, end_id=2)
    library, start = Tokenizer.from_file(BPE), 0
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    got = wavelet.read_documents(spark, at).orderBy("start").collect()
    assert len(got) == odd.count()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in [library.encode(t, add_special_tokens=False).ids + [2] for t in texts[r.doc_id]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(r.ids))
        start += len(ids)
    found = wavelet.occurrences(spark, at, 2).collect()
    assert sum(r.n for r in found) == odd.count() and all(r.n == len(r.places) for r in found)


def test_no_documents_make_no_tokens(spark, nothing):
    at = shared_folder(spark, "wavelet-test")
    wavelet.write_shards(nothing, at, BPE, end_id=2)
    assert wavelet.read_documents(spark, at).count() == 0


# ── minimax shards ───────────────────────────────────────────────────────────────────────
def _smallest_capacity(sizes, shards):
    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_smallest(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 60 if seed % 2 else 6) for _ in range(rng.randint(1, 40))]
    cells = spark.createDataFrame([(i * 3, s) for i, s in enumerate(sizes)], "cell int, size long")
    row = minimax_shards.cut_cells(cells, 5).first()
    assert row.capacity == _smallest_capacity(sizes, 5)
    cuts = [0, *row.cuts, 10 ** 9]
    sums = [sum(s for i, s in enumerate(sizes) if a <= i * 3 < b) for a, b in zip(cuts, cuts[1:])]
    assert list(row.cuts) == sorted(row.cuts) and sum(sums) == sum(sizes) and max(sums) == row.capacity


def test_shards_keep_copies_together(odd, nothing):
    rows = minimax_shards.assign(odd, 4).collect()
    assert len(rows) == odd.count()
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        by_text[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    assert minimax_shards.assign(nothing, 4).count() == 0


def test_hot_cell_is_numbered_in_parts(frame, monkeypatch):
    monkeypatch.setattr(minimax_shards, "ROWS_PER_PART", 7)
    rows = minimax_shards.assign(frame([(i, "same text") for i in range(60)] + [(99, "other")]), 2).collect()
    assert {r.shard for r in rows if r.size == 17} != {r.shard for r in rows if r.size == 13}
    assert sorted(r.slot for r in rows if r.size == 17) == list(range(60))


# ── quality rules ────────────────────────────────────────────────────────────────────────
def _plain_features(text):
    text = text or ""
    found = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    grams = Counter(zip(found, found[1:], found[2:]))
    hit = {j for i, g in enumerate(zip(found, found[1:], found[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_counts_equal_the_plain_ones():
    texts = [None, "", " \n ", "a b c a b c d", "a a a a a", "x #| y\nx #| y\n\n \nz", words(5, 500), "é é \x1cq", "a b c x a b c y b c x"]
    for text in texts:
        assert weak_supervision.text_features(text)[:5] == _plain_features(text)


def test_em_over_patterns_equals_em_over_rows():
    rng = np.random.default_rng(3)
    good = rng.random(3000) < 0.8
    votes = np.stack([np.where(rng.random(3000) < 0.3, 1, np.where(rng.random(3000) < p, 2 * good, 2 - 2 * good))
                      for p in (0.95, 0.9, 0.85, 0.9)], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = weak_supervision.fit_votes(patterns, counts.astype(float), iterations=30)
    # The same rounds, a row at a time.
    p = np.where((votes == 0).any(1), 0.1, 0.95)
    for _ in range(model.iterations):
        said = np.array([[[(w * (votes[:, r] == v)).sum() + 1 for v in range(3)] for w in (1 - p, p)] for r in range(4)])
        said /= said.sum(2, keepdims=True)
        prior = (p.sum() + 1) / (len(p) + 2)
        odds = math.log(prior / (1 - prior)) + sum(np.log(said[r, 1, votes[:, r]] / said[r, 0, votes[:, r]]) for r in range(4))
        p = 1 / (1 + np.exp(-odds))
    assert np.allclose(said, model.said) and abs(prior - model.prior) < 1e-9
    assert ((p > 0.5) == good).mean() > 0.93 and inverse.size == len(votes)
    assert (model.accuracy() > 0.6).all()


def test_quality_verdicts(spark, frame, odd, nothing):
    junk = [(i, " ".join(f"{w}###" for w in words(i, 80).split())) for i in range(20)]
    fine = [(100 + i, words(1000 + i, 120) + " the of and to in is that it the of and to in is") for i in range(80)]
    rows = {r.doc_id: r for r in weak_supervision.judge(frame(junk + fine)).collect()}
    assert not any(rows[i].kept for i, _ in junk) and all(rows[i].kept for i, _ in fine)
    judged = weak_supervision.judge(odd).collect()
    assert len(judged) == odd.count() and all(r.kept is not None for r in judged)
    assert all(r.base_failed and not r.kept for r in judged if r.doc_id in (4, 5, 6, 7))
    assert weak_supervision.judge(nothing).count() == 0
    assert weak_supervision.keep_good(odd).columns == odd.columns


def test_quality_rules_write_nothing_and_send_a_text_once(spark, frame, odd):
    rows = [(i, words(i, 60 + i) + " the of and to in is") for i in range(30)]
    docs = frame(rows + [(50, None), (51, "")]).withColumn("more", F.lit("x"))
    with Scratch(spark) as scratch:
        kept = weak_supervision.keep_good(docs)
    assert scratch.folders == []
    verdict = {r.doc_id for r in weak_supervision.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict and verdict
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"


# ── toxicity ─────────────────────────────────────────────────────────────────────────────
def test_toxicity_on_held_out_rows(spark, frame, odd, nothing):
    rng = random.Random(4)
    slurs = ["vilest", "rotten", "wretch", "foulest"]
    rows, labels = [], []
    for i in range(600):
        own = words(i, 60).split()
        n = rng.choice((1, 2, 4)) if i % 3 == 0 else 0
        for _ in range(n):
            own.insert(rng.randrange(len(own)), rng.choice(slurs))
        rows.append((i, " ".join(own)))
        labels.append((i, int(n > 0)))
    docs, known = frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = ordinal_toxicity.fit(docs, known.where("doc_id < 400"))
    assert (np.diff(model.thresholds) > 0).all()
    scored = {r.doc_id: r for r in ordinal_toxicity.score(docs, model).collect()}
    held = [(scored[i].toxic, bool(t)) for i, t in labels if i >= 400]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    for r in scored.values():
        assert list(r.steps) == sorted(r.steps, reverse=True) and abs(sum(r.steps) - r.severity) < 1e-9
    mild, harsh = (np.mean([scored[i].severity for i, t in rows if sum(w in slurs for w in t.split()) == n]) for n in (1, 4))
    assert harsh > mild > 0.5
    assert ordinal_toxicity.score(odd, model).count() == odd.count()
    assert ordinal_toxicity.score(nothing, model).count() == 0
    neutral = ordinal_toxicity.fit(docs, known.where("toxic = 0"))
    assert ordinal_toxicity.score(docs, neutral).where("toxic").count() == 0


# ── MinHash ──────────────────────────────────────────────────────────────────────────────
def test_toxicity_keeps_the_class_ratio_of_the_table(spark, frame):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(2200):
        toxic = i % 11 == 0
        rows.append((i, words(9000 + i, 20) + (" vile" if rng.random() < (0.6 if toxic else 0.06) else "")))
        labels.append((i, int(toxic)))
    docs, known = frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, sampled = (ordinal_toxicity.fit(docs, known, per_class=n) for n in (10_000, 100))
    share = [float(m.steps(np.zeros(1))[0, 0]) for m in (whole, sampled)]
    assert abs(share[0] - share[1]) < 0.1 and share[1] < 0.25
    toxic = [ordinal_toxicity.score(docs, m).where("toxic").count() for m in (whole, sampled)]
    assert abs(toxic[0] - toxic[1]) < 60


def _plain_components(rows, n, percent):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def _near_rows():
    rows, rng = [], random.Random(6)
    for g in range(12):
        base = words(g, 90).split()
        for c in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.choice((0, 1, 2, 4, 8))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, "lone"), (901, "LONE"), (902, None), (903, " "), (904, "lone pair"), (905, "")]


@pytest.mark.parametrize("n,percent", [(2, 80), (5, 80)])
def test_components_equal_all_pairs(frame, n, percent):
    rows = _near_rows()
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(rows), n, percent).collect()}
    for key, (size, component) in _plain_components(rows, n, percent).items():
        assert (got[key].n_shingles, got[key].component_id, got[key].kept) == (size, component, key == component)


def test_possible_pairs_have_every_link(spark):
    """Without any link confirmed before, the rarest shingles alone find all pairs at the threshold."""
    memo: dict[bytes, int] = {}
    sets = {k: minhash.shingle_set(t, 2, memo) for k, t in _near_rows() if t and t.strip()}
    classes = spark.createDataFrame(
        [(k, k, minhash.packed(minhash.minima(s)).tolist()) for k, s in sets.items()], "doc_id long, component long, signature array<long>")
    rows = spark.createDataFrame([(k, s.view(np.int64).tolist(), minhash.parity(s).tolist()) for k, s in sets.items()],
                                 "doc_id long, shingles array<long>, parity array<long>")
    found = {(r.a, r.b) for r in minhash.possible_pairs(classes, rows, 80).collect()}
    linked = {(a, b) for a in sets for b in sets if a < b
              and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked and linked <= found and len(found) < len(sets) ** 2 / 8
    confirmed = minhash.confirmed(spark.createDataFrame(sorted(found), "a long, b long"), rows, 80)
    assert {(r.a, r.b) for r in confirmed.collect()} == linked


def test_estimate_is_near_the_similarity(spark):
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[:800], a[:200] + np.uint64(7)])
    frame = spark.createDataFrame([(minhash.packed(minhash.minima(a)).tolist(), minhash.packed(minhash.minima(b)).tolist())],
                                  "x array<long>, y array<long>")
    got = frame.select(minhash.estimate(F.col("x"), F.col("y")), minhash.estimate(F.col("x"), F.col("x"))).first()
    assert abs(got[0] - 800 / 1200) < 0.2 and got[1] == 1.0


def test_near_duplicates_on_odd_tables(odd, nothing):
    rows = minhash.near_duplicates(odd, 2, 80).collect()
    assert len(rows) == odd.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.component_id, r.kept))
    assert by_id[1] == {(1, True)} and by_id[2] == {(1, False)} and by_id[3] == {(1, False)} and by_id[9] == {(9, True)}
    assert by_id[None] == {(None, True)} and by_id[4] == {(4, True)}
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.keep_one_of_each(odd).columns == odd.columns


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for e in edges if e[0] != e[1] for n in e}


# ── rollups ──────────────────────────────────────────────────────────────────────────────
def test_rollups_apply_each_batch_once(spark, odd):
    store = token_rollups.Rollups(spark, shared_folder(spark, "rollup-test"))
    assert store.totals().count() == 0
    count = F.length(F.coalesce("text", F.lit("")))
    load = token_rollups.changes(odd, "insert", "v1", count)
    assert store.apply("a", load) and not store.apply("a", load)
    assert store.apply("b/1", token_rollups.changes(odd.where("source = 'a'"), "revise", "v1", count + 10, count))
    assert store.apply("c", token_rollups.changes(odd.where("source = 'z' or source is null"), "delete", "v1", count))
    assert store.apply("d", token_rollups.changes(odd.where("false"), "insert", "v1", count))
    expected = defaultdict(lambda: [0, 0])
    for r in odd.collect():
        if r.source != "z" and r.source is not None:
            expected[r.source][0] += 1
            expected[r.source][1] += len(r.text or "") + 10 * (r.source == "a")
    seen = lambda: {r.source: [r.n_docs, r.n_tokens] for r in store.totals().collect()}
    assert seen() == dict(expected)
    store.compact("first")
    assert seen() == dict(expected) and not store.apply("a", load)
    assert store.apply("e", load.where("source = 'a'")) and seen()["a"][0] == 2 * expected["a"][0]
    store.compact("second")
    assert seen()["a"][0] == 2 * expected["a"][0]


def test_a_broken_batch_is_written_anew(spark, odd):
    at = shared_folder(spark, "rollup-test")
    store = token_rollups.Rollups(spark, at)
    load = token_rollups.changes(odd, "insert", "v1", F.lit(1))
    token_rollups.deltas(load).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{at}/batch=x")
    assert store.totals().count() == 0  # as left by a job that was lost before its end
    assert store.apply("x", load) and store.totals().agg(F.sum("n_docs")).first()[0] == odd.count()


# ── Merkle trees ─────────────────────────────────────────────────────────────────────────
def test_paragraphs_join_to_the_text(spark, odd):
    joined = odd.select(F.coalesce("text", F.lit("")).alias("t"), F.array_join(merkle.paragraphs(F.col("text")), "").alias("j"))
    assert joined.where("t != j").count() == 0


def test_fingerprints(odd, nothing, frame):
    rows = merkle.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    texts = sorted({(r.doc_id, r.text or "") for r in odd.collect() if r.doc_id is not None}, key=lambda x: -x[0])
    by_id = {r.doc_id: r for r in rows}
    for (key, text), (_, following) in zip(texts, texts[1:]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = by_id[key]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[2].near_next == 1.0
    assert by_id[8].near_edited > 0.4 and by_id[8].near_next < 0.1
    assert merkle.fingerprints(nothing).count() == 0
    alone = merkle.fingerprints(frame([(5, "ab cd")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and alone.near_next == 1.0


def _plain_edits(old, new):
    """Edits of two lists of paragraphs by brute force, equal sections at both ends left aside."""
    def sections(leaves):
        result, at = [[]], 0
        for i, leaf in enumerate(leaves):
            result[-1].append((i, at, leaf))
            at += len(leaf)
            if hashlib.sha256(leaf.encode()).hexdigest()[0] < "4":
                result.append([])
        return [s for s in result if s]

    a, b = sections(old), sections(new)
    same = lambda x, y: [p[2] for p in x] == [p[2] for p in y]
    while a and b and same(a[0], b[0]):
        a, b = a[1:], b[1:]
    while a and b and same(a[-1], b[-1]):
        a, b = a[:-1], b[:-1]
    places = {}
    for side, part in enumerate((a, b)):
        seen = Counter()
        for i, at, leaf in sum(part, []):
            seen[leaf] += 1
            places.setdefault((leaf, seen[leaf]), [None, None])[side] = (i, at)
    both = sorted((o, n) for o, n in places.values() if o and n)
    late = {o for i, (o, n) in enumerate(both) if any(m > n for _, m in both[:i])}
    early = {o for i, (o, n) in enumerate(both) if any(m < n for _, m in both[i + 1:])}
    moved = early if len(early) < len(late) else late
    return list((("move" if o and n else "delete" if o else "insert"), *(o or (None, None)), *(n or (None, None)), len(leaf))
                  for (leaf, _), (o, n) in places.items() if not (o and n) or o in moved)


def test_edits_equal_a_plain_comparison(frame):
    pieces = [words(100 + i, 6).replace(".", "").replace("\n", " ") + f" {i}.\n" for i in range(60)]
    swapped = [*pieces[:20], pieces[21], pieces[20], *pieces[22:]]
    texts = {"same": (pieces, pieces), "insert": (pieces, [*pieces[:30], "Changed.\n", *pieces[30:]]), "delete": (pieces, [*pieces[:9], *pieces[10:]]),
             "swap": (pieces, swapped), "repeat": (pieces, [*pieces[:5], pieces[4], *pieces[5:]]), "first to last": (pieces, [*pieces[1:], pieces[0]]),
             "last to first": (pieces, [pieces[-1], *pieces[:-1]]), "all gone": (pieces, []), "all new": ([], pieces), "none": ([], []),
             "shuffled": (pieces, random.Random(3).sample(pieces, 45)), "twins": (pieces[:4] * 5, pieces[1:4] * 6)}
    rows = [(i, "".join(o) or None, "".join(n)) for i, (o, n) in enumerate(texts.values())]
    pairs = frame([(0, "")]).sparkSession.createDataFrame([*rows, *rows], "doc_id long, old string, new string")
    found = {}
    for r in merkle.edits(pairs, "old", "new").collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, (name, (old, new)) in enumerate(texts.items()):
        assert sorted(found.get(i, []), key=repr) == sorted(_plain_edits(old, new), key=repr), name
    assert [r[0] for r in found[1]] == ["insert"] and [r[0] for r in found[2]] == ["delete"] and [r[0] for r in found[3]] == ["move"]
    assert [r[0] for r in found[5]] == [r[0] for r in found[6]] == ["move"] and 0 not in found
    assert merkle.edits(pairs.limit(0), "old", "new").count() == 0


# ── source mix ───────────────────────────────────────────────────────────────────────────
def _plain_targets(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in free}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mix_meets_its_targets(frame):
    rng = random.Random(8)
    rows = [(i, words(i, rng.randint(0, 300)), s) for i, s in enumerate(
        ["a"] * 300 + ["b"] * 40 + ["c"] * 6 + [None] * 20 + ["é"] * 30)]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected = _plain_targets(sizes, (1, 2, 3))
    got = source_mix.taken_words(frame(rows), block_words=32).collect()
    again = source_mix.taken_words(frame(rows).repartition(3), block_words=32).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    taken = Counter()
    for r in got:
        source = rows[r.doc_id][2]
        taken[source] += r.taken
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[source] and r.taken <= 3 * r.size
        assert math.isclose(r.target, expected[source], rel_tol=1e-9)
    assert all(abs(taken[s] - expected[s]) < 0.03 * expected[s] + 64 for s in sizes)
    mixed = source_mix.mixed_documents(frame(rows), block_words=32)
    words_of = Counter()
    for r in mixed.collect():
        words_of[r.doc_id] += len(r.text.split())
        assert rows[r.doc_id][1].split()[:len(r.text.split())] == r.text.split() and r.n_chars == len(r.text)
    assert words_of == Counter({r.doc_id: r.taken for r in got if r.taken})


def test_schedule_is_even_everywhere(spark):
    targets = spark.createDataFrame([("a", 0, 6000, 1.0, 2000.0), ("b", 1, 3000, 2.0, 4000.0), ("c", 2, 2000, 3.0, 6000.0)],
                                    "source string, number int, source_size long, weight double, target double")
    slots = [r.number for r in source_mix.schedule(targets, 10).orderBy("slot").collect()]
    share = {0: 1 / 6, 1: 2 / 6, 2: 3 / 6}
    for upto in range(50, len(slots), 50):
        assert all(abs(slots[:upto].count(n) - upto * s) < 6 for n, s in share.items())


def test_mix_on_odd_tables(odd, nothing):
    rows = source_mix.taken_words(odd, block_words=16).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert source_mix.taken_words(nothing).count() == 0 and source_mix.mixed_documents(nothing).count() == 0
    assert source_mix.mixed_documents(odd).columns == odd.columns


def test_rows_without_or_with_a_repeated_id_are_mixed_like_others(frame):
    rows = [(None if i % 3 == 0 else i // 8 if i % 3 == 1 else i, words(i, 40 + i % 30), "ab"[i % 2]) for i in range(240)]
    docs = frame(rows)
    taken = source_mix.taken_words(docs, block_words=16).collect()
    assert len(taken) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in taken)
    assert any(r.taken > 0 for r in taken if r.doc_id is None)
    by_source = defaultdict(list)
    for r in taken:
        by_source[r.target].append(r.taken)
    assert len(by_source) == 2 and all(abs(sum(t) - target) <= 3 * 16 for target, t in by_source.items())
    mixed = source_mix.mixed_documents(docs, block_words=16).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in taken)
    assert Counter(r.doc_id is None for r in mixed)[True] > 60


def test_running_total_in_buckets(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(-2 ** 63, 2 ** 63), i, rng.randrange(9)) for i in range(300)]
    got = running_total(spark.createDataFrame(rows, "k string, h long, t long, v long"), ["k"], "h", "t", "v", "before", 4).collect()
    unsigned = lambda h: h % 2 ** 64
    for r in got:
        earlier = [x for x in rows if x[0] == r.k and (unsigned(x[1]) >> 60, x[1], x[2]) < (unsigned(r.h) >> 60, r.h, r.t)]
        assert r.before == sum(x[3] for x in earlier)
    assert bucket_bits(0) == 0 and bucket_bits(10 ** 9) == 16


# ── run-length index ─────────────────────────────────────────────────────────────────────
@pytest.mark.parametrize("seed", range(12))
def test_index_on_random_strings(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 15))]
    length = rng.randint(2, 9)
    seen = Counter(s[i:i + length] for s in strings for i in range(len(s) - length + 1))
    expected = [[i for i in range(len(s) - length + 1) if seen[s[i:i + length]] > 1] for s in strings]
    assert [x.tolist() for x in run_length_index.repeated_starts(strings, length)] == expected
    index, _ = run_length_index.build_index(strings)
    assert index.runs <= index.n
    for pattern in (b"a", b"ab", b"bba", b"abab"):
        assert index.count(pattern) == sum(s.startswith(pattern, i) for s in strings for i in range(len(s)))


def test_an_index_of_a_task_stays_small():
    rng, size = random.Random(5), run_length_index.INDEX_BYTES // 250
    strings = [words(rng.randrange(size // 2), 45).encode()[:250] for _ in range(size)]
    tracemalloc.start()
    found = run_length_index.repeated_starts(strings, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    seen = Counter(s[i:i + 200] for s in strings for i in range(len(s) - 199))
    assert [x.tolist() for x in found] == [[i for i in range(len(s) - 199) if seen[s[i:i + 200]] > 1] for s in strings]
    assert peak < 60e6  # 203 MB with two megabytes


def _plain_cut(texts, length=200):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + length, int)
        for i in range(len(t) - length + 1):
            hit[i:i + length] |= seen[t[i:i + length]] > 1
        hit = hit[:len(t)]
        out.append((len(t), int(hit.sum()), int((np.diff(np.concatenate([[0], hit])) == 1).sum()),
                    bytes(b for b, h in zip(t, hit) if not h)))
    return out


def _passages():
    shared, other = words(50, 60), "é" * 130
    rows = [(i, words(200 + i, 50) + shared[:180 + 12 * i] + words(300 + i, 40)) for i in range(12)]
    rows += [(20, words(20, 300)), (21, words(20, 300)), (22, "ab" * 400), (23, other + words(23, 30)), (24, words(24, 9) + other), (25, None), (26, "")]
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_cut_repeats_equals_all_windows(frame, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(run_length_index, "MAX_SEGMENTS", 2)
    rows = _passages()
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), bytes(r.kept))
           for r in run_length_index.cut_repeats(frame(rows)).collect()}
    expected = _plain_cut([(t or "").encode() for _, t in rows])
    assert got == {k: e for (k, _), e in zip(rows, expected)}


def test_long_texts_are_taken_in_pieces(monkeypatch):
    data = (words(70, 900) * 2).encode()
    whole = run_length_index.segments(data, 200)
    monkeypatch.setattr(run_length_index, "CHUNK", 1000)
    pieces = run_length_index.segments(data, 200)
    cover = lambda parts: sorted(i for a, n in zip(parts[0].tolist(), parts[1].tolist()) for i in range(a, a + n - 199))
    assert cover(whole) == cover(pieces) == list(range(len(data) - 199))


def test_cut_on_odd_tables(odd, nothing, frame):
    rows = run_length_index.cut_repeats(odd).collect()
    assert len(rows) == odd.count()
    expected = Counter(e[:3] for e in _plain_cut([(r.text or "").encode() for r in odd.where("doc_id is null or doc_id != 8").collect()]))
    got = Counter((r.n_bytes, r.n_bytes - len(r.kept), len(r.starts)) for r in rows if r.doc_id != 8)
    assert got == expected
    assert run_length_index.cut_repeats(nothing).count() == 0
    cut = run_length_index.cut_documents(frame(_passages()).withColumn("_row", F.lit(1)))
    texts = {r.doc_id: r for r in cut.collect()}
    assert 20 not in texts and texts[26].text == "" and all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)
    assert run_length_index.cut_documents(odd).columns == odd.columns


# ── lattice sampling ─────────────────────────────────────────────────────────────────────
def _all_segmentations(pieces, unit):
    if not unit:
        return [((), 0.0)]
    return [((pieces[unit[:e]][0], *rest), pieces[unit[:e]][1] + p)
            for e in range(1, len(unit) + 1) if unit[:e] in pieces for rest, p in _all_segmentations(pieces, unit[e:])]


@pytest.fixture(scope="module")
def lattices():
    return lattice_sampling.Lattices(PIECES, 0.4)


@pytest.mark.parametrize("near", [0, 1, 64])
def test_samples_follow_the_exact_distribution(lattices, near):
    known = _all_segmentations(lattices.pieces, "▁in▁a")
    total = math.log(sum(math.exp(p) for _, p in known))
    chance = {s: math.exp(p - total) for s, p in known}
    n = 8000
    found = [r for at in range(0, n, 1000) for r in lattice_sampling.sample_texts(lattices, list(range(at, at + 1000)), ["in a"] * 1000, 2, 1, near)]
    first, second = (Counter(tuple(r[i][0].tolist()) for r in found) for i in range(2))
    after = {s: sum(chance[a] * chance[s] / (1 - chance[a]) for a in chance if a != s) for s in chance}
    for s in chance:
        assert abs(first[s] / n - chance[s]) < 0.025 and abs(second[s] / n - after[s]) < 0.025
    for r in found[:200]:
        assert r[0][2] >= r[1][2] and r[0][0].tolist() != r[1][0].tolist()
        assert all(math.isclose(p, math.log(chance[tuple(ids.tolist())]), abs_tol=1e-9) for ids, p, _, _ in r)
    # Weighing each sample by its inclusion probability is unbiased.
    assert abs(np.mean([sum(math.exp(p) / q for _, p, _, q in r) for r in found]) - 1) < 0.02


@pytest.mark.parametrize("near", [0, 2, 64])
def test_all_segmentations_when_k_is_large(lattices, near):
    known = {s for s, _ in _all_segmentations(lattices.pieces, "▁abc")}
    got = lattice_sampling.sample_texts(lattices, [1], ["abc"], 500, 3, near)[0]
    assert {tuple(i.tolist()) for i, *_ in got} == known and len(got) == len(known)
    assert all(q == 1.0 for *_, q in got)


def test_decoding_gives_the_text_back(spark, odd, nothing):
    samples = lattice_sampling.sample_segmentations(odd, PIECES, k=3)
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id is not null").collect()}
    for r in lattice_sampling.decode(samples, PIECES).where("doc_id is not null").collect():
        assert r.text == texts[r.doc_id].replace("▁", " ")
    per_row = Counter(r.doc_id for r in samples.collect())
    assert per_row[8] == 3 and per_row[9] == 6 and per_row[4] == 1
    assert lattice_sampling.sample_segmentations(odd, PIECES).count() > 0
    assert lattice_sampling.sample_segmentations(nothing, PIECES).count() == 0
    again = lattice_sampling.sample_segmentations(odd.where("doc_id = 8"), PIECES, k=3).collect()
    assert sorted(bytes(r.ids) for r in again) == sorted(bytes(r.ids) for r in samples.where("doc_id = 8").collect())


# ── the pipeline ─────────────────────────────────────────────────────────────────────────
def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    import corpus_pipeline

    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns, name
            assert stage(spark, docs, "").count() <= 3 * docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, "").count() == 0


def test_a_repeated_row_leaves_one_document(spark, frame):
    import corpus_pipeline

    clean = [(i, words(i, 150) + " the of and to in is that it for on with as the of and to in") for i in range(40)]
    repeated = [clean[3], clean[4], clean[4]]
    unnamed = [(None, words(90, 150) + " the of and to in is that it for on with as the of and to in")] * 3
    docs = frame(clean + repeated + unnamed + [(None, clean[5][1]), (50, None), (50, None)])
    assert minhash.keep_one_of_each(docs).where("text is null").count() == 2
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
    expected = [*clean, unnamed[0]]
    assert sorted((r.text, r.doc_id) for r in docs.collect()) == sorted((t, i) for i, t in expected)


def test_pipeline_keeps_clean_documents(spark, frame, tmp_path):
    import corpus_pipeline

    clean = [(i, words(i, 150) + " the of and to in is that it for on with as the of and to in") for i in range(60)]
    copies = [(100 + i, clean[i][1]) for i in range(10)]
    junk = [(200 + i, " ".join(f"{w}###" for w in words(500 + i, 80).split())) for i in range(10)]
    frame(clean + copies + junk).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in clean}
    assert all(r.text == dict(clean)[r.doc_id] for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion"]
    assert {r.doc_id for r in out.collect()} <= {i for i, _ in clean}


def test_long_open_texts_carry_few_shingles(spark):
    """Texts that share most of their words: rows per text stay in proportion to its length, and no link is missing."""
    shared = [f"w{i}" for i in range(3000)]
    rows = []
    for d in range(6):
        own = [w if (i * 7 + d) % 9 else f"{w}x{d // 2}" for i, w in enumerate(shared)]
        rows.append((d, " ".join(own)))
    sets = {d: set(minhash.shingle_set(t, 2, {}).tolist()) for d, t in rows}
    classes = spark.createDataFrame([(d, d, minhash.packed(minhash.minima(minhash.shingle_set(t, 2, {}))).tolist()) for d, t in rows],
                                    "doc_id long, component long, signature array<long>")
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in minhash.possible_pairs(classes, minhash.shingle_sets(texts, classes.select("doc_id"), 2), 80).collect()}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked <= found


def test_verdicts_are_taken_row_by_row(spark, frame):
    good = [(i, words(i, 120), "a") for i in range(40)]
    rows = [*good, (None, words(99, 120), "a"), (None, "x", "a"), (None, "# " * 90, "a"), (3, "x", "a")]
    kept = weak_supervision.keep_good(frame(rows)).collect()
    assert "x" not in {r.text for r in kept} and "# " * 90 not in {r.text for r in kept}
    assert {r.doc_id for r in kept} >= {i for i, _, _ in good} and words(99, 120) in {r.text for r in kept}


def test_stages_delete_what_the_one_before_left(spark, frame, tmp_path):
    import os

    import corpus_pipeline

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    docs = frame([(i, words(i, 120), "ab"[i % 2]) for i in range(30)])
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(at)))
        left = [f.rpartition("/")[2] for f in corpus_pipeline._left]
        assert all(os.path.isdir(f"{root}/{f}") for f in left)
        docs = spark.read.parquet(str(tmp_path / str(at)))
    before = list(corpus_pipeline._left)
    corpus_pipeline.STAGES[3][1](spark, docs, "")
    assert before and not any(os.path.exists(f.removeprefix("file:")) for f in before)


def test_few_other_texts_move_with_the_wanted(spark):
    """The bit map of ids loses no wanted row, repeated ones included, and keeps few others."""
    docs = spark.range(20_000).selectExpr("id * 7 - 5000 AS doc_id", "cast(id AS string) AS text").unionByName(
        spark.createDataFrame([(-5000, "0"), (None, "x")], "doc_id long, text string"))
    wanted = spark.range(0, 20_000, 20).selectExpr("id * 7 - 5000 AS doc_id")
    got = minhash.likely(docs, wanted)
    assert got.columns == docs.columns
    assert got.join(wanted, "doc_id").count() == 1001 and got.count() < 1001 + 19_000 * 0.03
    assert minhash.likely(docs, wanted.limit(0)).count() == 0


def test_plausible_pairs_have_every_link(spark):
    sets = {k: minhash.shingle_set(t, 2, {}) for k, t in _near_rows() if t and t.strip()}
    rows = spark.createDataFrame([(k, s.view(np.int64).tolist(), minhash.parity(s).tolist()) for k, s in sets.items()],
                                 "doc_id long, shingles array<long>, parity array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    linked = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    found = {(r.a, r.b) for r in minhash.plausible(spark.createDataFrame(pairs, "a long, b long"), rows, 80).collect()}
    assert linked <= found and len(found) < len(pairs) / 8


def test_possible_pairs_lie_between_components(spark):
    """Every link between two components is found, whatever the classes of one of them share."""
    sets = {k: minhash.shingle_set(t, 2, {}) for k, t in _near_rows() if t and t.strip()}
    rows = spark.createDataFrame([(k, s.view(np.int64).tolist(), minhash.parity(s).tolist()) for k, s in sets.items()],
                                 "doc_id long, shingles array<long>, parity array<long>")
    linked = {(a, b) for a in sets for b in sets if a < b
              and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    for component in (lambda k: k % 2, lambda k: k // 3, lambda k: min([a for a, b in linked if b == k], default=k)):
        classes = spark.createDataFrame([(k, component(k), minhash.packed(minhash.minima(s)).tolist()) for k, s in sets.items()],
                                        "doc_id long, component long, signature array<long>")
        found = {(r.a, r.b) for r in minhash.possible_pairs(classes, rows, 80).collect()}
        assert {(a, b) for a, b in linked if component(a) != component(b)} <= found
        assert all(component(a) != component(b) for a, b in found)


def test_words_of_letters_are_not_cut_again():
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def findall(self, text):
            self.calls += 1
            return self.pattern.findall(text)

    own, library = wavelet.WordEncoder(BPE), Tokenizer.from_file(BPE)
    own._CUT = Counted(own._CUT)
    texts = ["alpha BETA Œuvre été x9 don't", "gamma DELTA ſ ŉ ǅ ª º × ÷", "日本 alpha zeta <|endoftext|> q"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert own._CUT.calls == 2
