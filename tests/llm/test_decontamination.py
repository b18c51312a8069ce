"""Contaminated documents against an exhaustive alignment, and recall on edited passages."""

import random
import re

import numpy as np

from parallax.llm import decontamination
from parallax.llm.decontamination import SHORT, TOLERANCE, ItemIndex, edit_window, find_contamination, op9_decontamination


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_alignment_is_exact():
    rng = random.Random(2)
    for _ in range(300):
        item, text = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(1, 14))]
        got = edit_window(np.array(item), np.array(text), 3)
        want = plain_distance(item, text)
        assert (got[0] if got else None) == (want if want <= 3 else None)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        p = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[p] = f"zz{rng.randrange(999)}"
        elif kind == 1:
            del w[p]
        else:
            w.insert(p, f"yy{rng.randrange(999)}")
    return w


def test_recall_on_edited_passages():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    pick = lambda n: [vocabulary[min(299, int(rng.paretovariate(0.7)))] for _ in range(n)]
    items = [pick(rng.randint(10, 60)) for _ in range(60)]
    index = ItemIndex(list(range(60)), [" ".join(i).encode() for i in items])
    hit, texts = 0, []
    for i, item in enumerate(items):
        n = rng.randint(0, int(TOLERANCE * len(item)))
        texts.append(" ".join(pick(rng.randint(0, 80)) + edited(rng, item, n) + pick(rng.randint(0, 80))).encode())
    for i, found in enumerate(index.matches(texts)):
        hit += i in {k for k, *_ in found}
        for k, _, edits in found:
            assert edits == plain_distance(items[k], texts[i].decode().split())
    assert hit >= 58


def test_tables_against_all_windows(spark):
    """A verbatim occurrence (by words) is always found, and nothing over the tolerance is."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: plain_words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: plain_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in op9_decontamination(spark, sf).collect()}
    joined = {d: " " + " ".join(w) + " " for d, w in docs.items()}
    for i, w in items.items():
        for d in docs:
            if " " + " ".join(w) + " " in joined[d]:
                assert got.get((d, i)) == 0
    for (d, i), edits in got.items():
        assert edits <= TOLERANCE * len(items[i]) and edits == plain_distance(items[i], docs[d])


def test_odd_rows(spark, monkeypatch):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    rows = [(1, None, 1), (2, "", 1), (3, "filler " * 40000 + passage.upper() + " filler" * 40000, 1), (None, passage, 1), (4, passage.replace("zeta", "z-e-t-a"), 1), (5, "short one here", 1), (5, "short one here", 1), (6, "alpha beta gamma", None)]
    items = [(1, passage), (2, None), (3, ""), (4, "one here"), (5, "!!"), (None, passage), (7, passage), (8, "here filler")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(3, 1), (3, 7), (-1, 1), (-1, 7), (5, 4), (5, 4)])
    for most in (20_000, 2):
        monkeypatch.setattr(decontamination, "MOST_ITEMS", most)
        got = find_contamination(docs, bench, ["doc_id"])
        assert got.count() == len(rows)
        assert sorted((-1 if r.doc_id is None else r.doc_id, m.item_id) for r in got.collect() for m in r.matches) == want
    assert {r.matches == [] for r in find_contamination(docs, bench.limit(0), ["doc_id"]).collect()} == {True}
    assert find_contamination(docs.limit(0), bench, ["doc_id"]).count() == 0
    assert SHORT == 8


def test_item_without_its_first_words_at_the_head_of_a_batch():
    for t, n, lost in [(0, 24, 3), (17, 28, 2), (21, 31, 4), (46, 40, 5), (52, 17, 2)]:
        item = [f"w{t}x{i}" for i in range(n)]
        index = ItemIndex([1], [" ".join(item).encode()])
        text = " ".join([*item[lost:], *(f"tail{i}" for i in range(9))]).encode()
        for texts, at in (([text], 0), ([text, b"other words"], 0), ([b"other words stand here", text], 1)):
            assert index.matches(texts)[at] == [(1, 0, lost)]


def test_passes_give_the_same_matches(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.withColumn("matches", docs.doc_id)
    rows = lambda: sorted((r.doc_id, sorted(map(tuple, r.matches))) for r in find_contamination(docs, items, ["doc_id", "matches"]).collect())
    one = rows()
    assert len(one) == docs.count() and any(m for _, m in one)
    monkeypatch.setattr(decontamination, "MOST_ITEMS", 50)
    assert rows() == one
    monkeypatch.setattr(decontamination, "MOST_ITEMS", 20_000)
    monkeypatch.setattr(decontamination, "MOST_BYTES", 3_000)
    assert rows() == one
