"""Near words against all pairs, and whole results against plain loops."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parallax.llm import letter_trie
from parallax.llm.letter_trie import Halves, LetterTrie, Verifier, deal, one_edit, packed, unpacked, vectors
from parallax.llm.spelling_variants import near_words, op11_spelling_variants, variants, word_counts


def distance_is_one(a, b):
    """By the usual table."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        nxt = [i + 1]
        for j, y in enumerate(b):
            nxt.append(min(row[j + 1] + 1, nxt[j] + 1, row[j] + (x != y)))
        row = nxt
    return row[-1] == 1


def some_words(seed=1, n=500):
    rng = random.Random(seed)
    short = {"".join(rng.choice("abcdé") for _ in range(rng.randint(3, 8))) for _ in range(n)}
    long = {"".join(rng.choice("ab") for _ in range(rng.randint(46, 51))) for _ in range(40)}
    return sorted(short | long | {"a" * k for k in range(20, 70)} | {"z" * k for k in range(5, 8)})


@pytest.mark.parametrize(("small", "pairs"), [(1, 1), (6, 3000), (1, 10)])
def test_trie_finds_all_pairs(monkeypatch, small, pairs):
    monkeypatch.setattr(letter_trie, "SMALL", small)
    monkeypatch.setattr(letter_trie, "PAIRS", pairs)
    words = [w.encode("latin-1") for w in some_words()]
    want = {(i, j) for i in range(len(words)) for j in range(len(words)) if distance_is_one(words[i], words[j])}
    assert {(i, j) for i in range(len(words)) for j in range(len(words)) if one_edit(words[i], words[j])} == want
    v = vectors(words, deal(Counter(b"".join(words))))
    assert (unpacked(packed(v)) == v).all()
    got = []
    for asked, word in LetterTrie(v, np.arange(len(words)), Halves(words)).near(np.arange(len(words))):
        ok = Verifier(words).holds(asked, word)
        got += zip(asked[ok].tolist(), word[ok].tolist(), strict=True)
    assert len(got) == len(set(got)) and set(got) == want


def plain(counts):
    """word -> (form, root, n, n_near, form_n)."""
    near = {a: [b for b in counts if distance_is_one(a, b)] for a in counts}
    best = {a: min(bs, key=lambda b: (-counts[b], b)) if bs else None for a, bs in near.items()}
    form = {a: b if b is not None and counts[b] >= 2 * counts[a] else None for a, b in best.items()}

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return {a: (form[a], root(a), counts[a], len(near[a]), counts[form[a]] if form[a] else None) for a in counts}


@pytest.mark.parametrize(("least", "largest"), [(2000, 20000), (3, 3)])
def test_variants_equal_all_pairs(spark, least, largest):
    rng = random.Random(2)
    counts = {w: rng.choice([3, 3, 4, 6, 8, 16, 33, 70, 140]) for w in some_words(3, 300)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    want = plain(counts)
    near = {r.word: (r.near, r.best_n, r.best) for r in near_words(df, least, largest).collect()}
    assert {a: x[0] for a, x in near.items()} == {a: x[3] for a, x in want.items() if x[3]}
    if least > 3:
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants(df).collect()} == want


def test_counts_of_odd_rows(spark):
    rows = [(1, "Straße STRASSE straße, x÷y×z Éclair éclair'éclairs " * 4, 1), (None, "abcdef", 2), (None, "abcdef", 2), (2, None, 3), (3, "", 4), (4, "q" * 200_000, 5), (5, "中文abcdef中", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = {r.word: r.n for r in word_counts(df).collect()}
    want = Counter()
    for _, text, _ in rows:
        low = "".join(c.lower() if c < "\x80" else c for c in text or "")
        want.update(w for w in re.findall("[a-zÀ-ÿ]+", low) if len(w) >= 5)
    assert got == want
    assert word_counts(df.limit(0)).count() == 0 and variants(word_counts(df.limit(0))).count() == 0


def test_query_equals_plain_loops(spark, sf_dir):
    counts = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        low = "".join(c.lower() if c < "\x80" else c for c in r.text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    got = {r.word: (r.n, r.n_near, r.form) for r in op11_spelling_variants(spark, sf_dir).collect()}
    assert {w: x[0] for w, x in got.items()} == counts
    for w in sorted(counts)[::37]:
        near = [x for x in counts if distance_is_one(w, x)]
        assert got[w][1] == len(near)
        best = min(near, key=lambda b: (-counts[b], b), default=None)
        assert got[w][2] == (best if best and counts[best] >= 2 * counts[w] else None)
