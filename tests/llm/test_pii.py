"""Personal data: the base against plain patterns, the tagger's gradients, its gain on other forms, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from parallax.llm import pii
from parallax.llm.char_tagger import Tagger, logsum, viterbi, viterbi_long
from parallax.llm.pii import base_spans, find_pii, luhn, op1_pii, train_pii, written_otherwise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_equals_plain_patterns():
    rng = random.Random(6)
    pieces = ["a", "B.c", "@", ".", "x-y", " ", "12", "255", "256", "+", "4111 1111 1111 1111", "4111111111111111", "-", "(030)", "+49 30 1234567", "é", "192.168.0.1", "007.1.1.1", "_", "%"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert base_spans(text) == plain(text), text
    assert base_spans("a" * 200_000 + "@") == []


def test_gradients():
    rng = np.random.default_rng(0)
    t = Tagger(3)
    t.p = {k: v.astype(float) for k, v in t.p.items()}
    x, y = rng.integers(0, 99, (5, 2)), rng.integers(0, 3, (5, 2))
    x[4, 1] = -1

    def loss():
        e, total = t.emissions(x), 0.0
        for j in range(2):
            n = int((x[:, j] >= 0).sum())
            a, s = e[0, j], e[0, j, y[0, j]]
            for k in range(1, n):
                a = logsum(a[:, None] + t.p["move"], 0) + e[k, j]
                s += e[k, j, y[k, j]] + t.p["move"][y[k - 1, j], y[k, j]]
            total += logsum(a, 0) - s
        return total / 2

    g = t.gradients(x, y)
    for k, v in t.p.items():
        at = (int(x[1, 0]), 2) if k == "embed" else tuple(rng.integers(0, s) for s in v.shape)
        was = v[at]
        v[at] = was + 1e-2
        up = loss()
        v[at] = was - 1e-2
        down = loss()
        v[at] = was
        assert abs((up - down) / 2e-2 - g[k][at]) < 1e-4


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    regions, move = [rng.standard_normal((n, 3)) for n in (1, 4, 6)], rng.standard_normal((3, 3))
    value = lambda e, p: sum(e[i, k] for i, k in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p))
    for e, got in zip(regions, viterbi(regions, move), strict=True):
        assert tuple(got) == max(itertools.product(range(3), repeat=len(e)), key=lambda p: value(e, p))


def test_viterbi_by_pieces_and_by_cells():
    rng = np.random.default_rng(2)
    regions, move = [rng.standard_normal((n, 4)).astype(np.float32) for n in (1, 2, 63, 64, 65, 300)], rng.standard_normal((4, 4))
    want = viterbi(regions, move)
    for cells in (1, 70, 500):
        assert all((a == b).all() for a, b in zip(viterbi(regions, move, cells), want, strict=True))
    for piece in (1, 7, 64, 1000):
        for e, path in zip(regions, want, strict=True):
            assert (viterbi_long(len(e), lambda a, b, e=e: e[a:b], move, piece) == path).all()


@pytest.fixture(scope="module")
def model(spark):
    return train_pii(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_tagger_adds_other_forms(model):
    rng, found = np.random.default_rng(99), 0
    for _ in range(200):
        _, put = written_otherwise(rng)
        text = "the meeting is moved, write to " + put + " and ask for the new date " * 8
        spans = model.spans([text])[0][1]
        found += any(a <= 31 + len(put) // 2 < b for _, a, b in spans)
    assert found > 150
    clean = ["Licensed under the Apache License, Version 2.0. " * 3, "In 1989 and 2004 there were 35 of 120, or 29.2 %.", "password=b4713e97bca8cb3552 and id 7", "no digits at all"]
    assert [s for _, s in model.spans(clean)] == [[], [], [], []]


def test_long_stretches_by_pieces(model, monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice(["4111 1111 1111 1111", "10.0.0.1", "a@b.cd", "+49 30 1234567", "1234.5", "12", "(030) 555-1234"]) for _ in range(400))
    want = model.spans(["no digits", text, "x 12 y"])
    monkeypatch.setattr(pii, "PIECE", 500)
    assert model.spans(["no digits", text, "x 12 y"]) == want


def test_half_a_million_digits_in_bounded_memory(model):
    import tracemalloc

    rng = random.Random(9)
    digits = "".join(rng.choice("0123456789 ") for _ in range(500_000))
    tracemalloc.start()
    spans = model.spans([f"call {i} or +49 30 {1234567 + i}" for i in range(300)] + [digits])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) == 301 and spans[-1][0] == plain(digits)
    assert peak < 250_000_000


def test_odd_rows(spark, model):
    long = "word " * 30000 + "call +49 30 1234567 now " + "word " * 30000 + "a.b@c.de"
    rows = [(1, None, "s"), (2, "", "s"), (3, long, "s"), (None, "x@y.org", "s"), (3, long, "s"), (4, "1.2.3.4 ßé a@b.cd", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in find_pii(df, model, ["doc_id"]).collect()]
    assert len(got) == len(rows)
    texts = {d: t or "" for d, t, _ in rows}
    for d, base, spans in got:
        assert base == plain(texts[d]) and set(base) <= set(spans)
    assert find_pii(df.limit(0), model, ["doc_id"]).count() == 0


def test_query(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(pii, "train_pii", lambda docs: trained)
    trained = train_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), sample=50)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in base) for k in PLAIN]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
