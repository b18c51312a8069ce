"""The language model's counts, base score and likelihood against plain loops."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax.llm import hmm_lm
from parallax.llm.hmm_lm import STATES, HiddenMarkov, op10_hmm_lm, score_texts, train_hmm


def tokens(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [b"\n"]


def plain_log10(model, s):
    a, total = model.start * model.emit[:, s[0]], 0.0
    for t in range(len(s)):
        if t:
            a = (a @ model.move) * model.emit[:, s[t]]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


def random_model(size, seed=3):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return HiddenMarkov(norm(rng.random(STATES)), norm(rng.random((STATES, STATES))), norm(rng.random((STATES, size))))


def plain_counts(model, s):
    """Expected counts of one sequence, by the plain forward-backward recursion over the whole of it."""
    a, b = np.zeros((len(s), STATES)), np.ones((len(s), STATES))
    for t, x in enumerate(s):
        a[t] = (model.start if t == 0 else a[t - 1] @ model.move) * model.emit[:, x]
        a[t] /= a[t].sum()
    for t in range(len(s) - 2, -1, -1):
        b[t] = model.move @ (model.emit[:, s[t + 1]] * b[t + 1])
        b[t] /= b[t].sum()
    gamma = a * b / (a * b).sum(1, keepdims=True)
    move, emit = np.zeros((STATES, STATES)), np.zeros_like(model.emit)
    for t in range(1, len(s)):
        pair = a[t - 1][:, None] * model.move * (model.emit[:, s[t]] * b[t])
        move += pair / pair.sum()
    for t, x in enumerate(s):
        emit[:, x] += gamma[t]
    return gamma[0], move, emit


@pytest.mark.parametrize("long, segment, together", [(16_384, 512, 262_144), (40, 16, 300), (5, 3, 50)])
def test_whole_sequences_equal_plain_loops(monkeypatch, long, segment, together):
    """Also where texts are run as segments: moves across cuts count, and only a text's first symbol is a start."""
    for k, v in {"LONG": long, "SEGMENT": segment, "TOGETHER": together}.items():
        monkeypatch.setattr(hmm_lm, k, v)
    monkeypatch.setattr(hmm_lm.together, "__defaults__", (together,))
    model, rng = random_model(30), np.random.default_rng(4)
    sequences = [rng.integers(0, 30, n) for n in (1, 2, 7, 40, 41, 255, 16, 17, 613, 3, 3)]
    assert np.allclose(model.log10(sequences), [plain_log10(model, s) for s in sequences], rtol=1e-10)
    for got, want in zip(model.expected(sequences), map(sum, zip(*(plain_counts(model, s) for s in sequences), strict=True)), strict=True):
        assert np.allclose(got, want, rtol=2e-4, atol=1e-5)


def test_counts_beyond_single_precision():
    """A symbol that only one state can give, which the others hardly reach, and that state's rare symbols in a row."""
    model = random_model(30)
    model.emit[:, 0] = 1e-30
    model.emit[0, 0] = 0.5
    model.emit[0, 1] = 1e-40
    sequence = np.array([0, 1] * 40 + [2, 3])
    for got, want in zip(model.expected([sequence]), plain_counts(model, sequence), strict=True):
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-6, atol=1e-9)


def test_likelihood_of_very_long_texts():
    model, rng = random_model(30), np.random.default_rng(4)
    sequences = [rng.integers(0, 30, n) for n in (16_384, 16_385, 40_000, 12)]
    assert np.allclose(model.log10(sequences), [plain_log10(model, s) for s in sequences], rtol=1e-10)


def test_baum_welch_counts_raise_likelihood():
    rng = np.random.default_rng(5)
    sequences = [np.r_[rng.integers(0, 5, 30), rng.integers(5, 10, 30)] for _ in range(40)]
    model = random_model(10)
    before = model.log10(sequences).sum()
    for _ in range(5):
        start, move, emit = model.expected(sequences)
        assert math.isclose(emit.sum(), 60 * 40, rel_tol=1e-4) and math.isclose(move.sum(), 59 * 40, rel_tol=1e-4)
        model = HiddenMarkov(start / start.sum(), move / move.sum(1, keepdims=True), (emit + 1e-9) / (emit + 1e-9).sum(1, keepdims=True))
        after = model.log10(sequences).sum()
        assert after > before - 1e-2
        before = after


def check(rows, texts, train, trained=None):
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = tokens(texts[r.doc_id])
        assert r.n_tokens == len(ws) and r.train_tokens == n and r.n_known == sum(c[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    if trained:  # the whole probability: the symbols' by the model, and each rare word's share of its class
        lex = trained.lexicon
        top = {w for w, i in lex.index.items() if i < hmm_lm.TOP}
        kinds, total = Counter(), Counter()
        for w in c.keys() - top:
            kinds[hmm_lm.shape(w)] += 1
            total[hmm_lm.shape(w)] += c[w]
        for r in rows:
            ws = tokens(texts[r.doc_id])
            want = plain_log10(trained.model, [lex.index[w] if w in top else hmm_lm.TOP + hmm_lm.shape(w) for w in ws])
            want += sum(math.log10((c[w] + 0.1) / (total[hmm_lm.shape(w)] + 0.1 * (kinds[hmm_lm.shape(w)] + 1))) for w in ws if w not in top)
            assert math.isclose(r.score, want, rel_tol=1e-9)


def test_query(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(hmm_lm, "KNOWN", 500)  # most words then come by the join
    kept = []
    train = hmm_lm.train_hmm
    monkeypatch.setattr(hmm_lm, "train_hmm", lambda rows: kept.append(train(rows)) or kept[0])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    rows = op10_hmm_lm(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r.held_out == held[r.doc_id] for r in rows)
    check(rows, texts, [t for d, t in texts.items() if not held[d]], kept[0])
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(spark):
    texts = {1: "A b b c", 2: None, 3: "", 4: "b\tB\nC  d é", 5: "x " * 20000, 6: "\x1c\x85 b"}
    df = spark.createDataFrame([(d, t, "k") for d, t in texts.items()] + [(1, texts[1], "k")], "doc_id long, text string, word string")
    trained = train_hmm(df.filter("doc_id <= 3").dropDuplicates(["doc_id"]).select("text"))
    rows = score_texts(df, trained, ["doc_id"]).collect()
    assert len(rows) == 7
    check(rows, texts, [texts[1], None, ""], trained)
    assert score_texts(df.limit(0), trained, ["doc_id"]).count() == 0
    none = train_hmm(df.limit(0).select("text"))
    got = score_texts(df, none, ["doc_id"]).where(F.col("doc_id") == 2).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (1, 0, 0) and abs(got.base_score) < 1e-12


def test_every_round_sees_all_documents(spark, monkeypatch):
    texts = ["a b a b c", "c d c d a", "e a e b"]
    assert all(zlib.crc32(t.encode()) % 16 for t in texts)
    seen = []
    step = hmm_lm.baum_welch
    monkeypatch.setattr(hmm_lm, "baum_welch", lambda encoded, model, frequency: seen.append(encoded.count()) or step(encoded, model, frequency))
    trained = train_hmm(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert seen == [3] * 8
    first = hmm_lm.HiddenMarkov.first(np.full(hmm_lm.TOP + hmm_lm.SHAPES, 1.0))
    assert not np.allclose(trained.model.move, first.move)


def test_equal_counts_fill_the_lexicon(spark):
    """More words of one count than are broadcast: some of them and the end token are, and the model is trained."""
    counts = spark.createDataFrame([(b"w%d" % i, 1) for i in range(500)] + [(b"\n", 1)], "word binary, n long")
    got = {r.word for r in hmm_lm.most_frequent(counts, 100).collect()}
    assert b"\n" in map(bytes, got) and 60 < len(got) < 140
