"""Toxicity: held-out accuracy, odd rows and the Kneser-Ney sums."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from parallax.llm.ngram_tables import discounts
from parallax.llm.toxicity import EDGE, ORDER, PIECE, SHARED, Evidence, KneserNey, PairKneserNey, ngram_keys, op8_toxicity, pair_counts, pieces, score_toxicity, train_toxicity, word_counts

ORDINARY = "the weather is mild today and we walk along the river with our friends".split()
TOXIC = "blargface snotwit grumblescum".split()


def make_rows(n=400):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = list(rng.choice(ORDINARY, 30))
        if toxic:
            words[3:5] = rng.choice(TOXIC, 2)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic), "x"))
    return docs, labels


def plain_counts(texts):
    """(n-gram counts by order, pair counts): in how many texts' distinct words, or texts, each occurs."""
    grams, pairs = [Counter() for _ in range(ORDER + 1)], Counter()
    for t in texts:
        words = [w.strip(EDGE) for w in t.lower().split()]
        for w in set(words):
            marked = b"\x02" + w + b"\x03"
            for n in range(1, ORDER + 1):
                for i in range(len(marked) - n + 1):
                    grams[n][marked[i : i + n]] += 1
        for p in set(zip(words, words[1:])):
            pairs[p] += 1
    return grams, pairs


def off(counts):
    """What is taken from a count, by the counts of counts."""
    d = discounts(*(sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)))
    return lambda count: d[min(count, 3) - 1] if count else 0


def plain_byte(grams, c, gram):
    """The interpolated probability of the last byte of gram in class c, by plain recursion."""
    if not gram:
        return 1 / 256
    n, below = len(gram), plain_byte(grams, c, gram[1:])
    if n <= SHARED:
        both = grams[0][n + 1].keys() | grams[1][n + 1].keys()
        counts = Counter(g[1:] for g in both)
    else:
        counts = grams[c][n]
    cut = off(counts)
    after = {g: k for g, k in counts.items() if g[:-1] == gram[:-1]}
    total = sum(after.values())
    return below if not total else (after.get(gram, 0) - cut(after.get(gram, 0))) / total + sum(map(cut, after.values())) / total * below


def plain_pair(pairs, u, v):
    both = pairs[0] + pairs[1]
    after = lambda counts: {y: k for (x, y), k in counts.items() if x == u}
    if not after(both):
        return 0.0
    mix = lambda found, below, cut: below if not found else (found.get(v, 0) - cut(found.get(v, 0)) + sum(map(cut, found.values())) * below) / sum(found.values())
    low = (sum(y == v for _, y in both) + 1) / (len(both) + len({y for _, y in both}) + 1)
    shared = mix(after(both), low, off(both))
    return math.log(mix(after(pairs[1]), shared, off(pairs[1]))) - math.log(mix(after(pairs[0]), shared, off(pairs[0])))


def models(ordinary, toxic):
    keys, rows = {}, {}
    for c, texts in enumerate((ordinary, toxic)):
        cells, n = word_counts(pa.array(texts))
        ws = cells[0].to_pylist()
        for k in range(1, ORDER + 1):
            key, inside, word = ngram_keys(ws, k)
            for x, m in zip(key[inside].tolist(), n[word[inside]].tolist()):
                keys.setdefault(x, [0, 0])[c] += m
        cells, n = pair_counts(pa.array(texts))
        for p, a, b, m in zip(*(x.to_pylist() for x in cells), n.tolist()):
            rows.setdefault((p, a, b), [0, 0])[c] += m
    counts = np.array(list(keys.values()))
    own = np.array(list(rows.values()))
    return KneserNey(np.array(list(keys)), counts[:, 0], counts[:, 1]), PairKneserNey(*np.array(list(rows)).T.astype(np.int64).view(np.uint64), own[:, 0], own[:, 1])


def test_evidence_equals_plain_dictionaries():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abé"), rng.integers(1, 6)))
    common = [word() for _ in range(12)]
    text = lambda: " ".join(word() + "," if rng.random() < 0.3 else str(rng.choice(common)) for _ in range(rng.integers(0, 25)))
    ordinary, toxic, asked = ([text() for _ in range(n)] for n in (15, 12, 200))
    language, pairs = models(ordinary, toxic)
    counted = [plain_counts([t.encode() for t in texts]) for texts in (ordinary, toxic)]
    grams, both = [c[0] for c in counted], [c[1] for c in counted]
    known: dict = {}

    def plain_word(w):
        if w not in known:
            marked = b"\x02" + w + b"\x03"
            known[w] = sum(math.log(plain_byte(grams, 1, marked[max(0, i - ORDER + 1) : i + 1]) / plain_byte(grams, 0, marked[max(0, i - ORDER + 1) : i + 1])) for i in range(1, len(marked)))
        return known[w]

    got = Evidence(language, pairs).features(pa.array(asked))
    for t, row in zip(asked, got):
        ws = [w.strip(EDGE) for w in t.encode().lower().split()]
        e, g = [plain_word(w) for w in ws], [plain_pair(both, u, v) for u, v in zip(ws, ws[1:])]
        top = lambda x: [max(x), sum(sorted(x)[-4:]) / 4] if x else [0, 0]
        want = [sum(e) / max(1, sum(len(w) + 1 for w in ws)), *top(e), sum(g) / max(1, len(g)), *top(g)]
        assert np.allclose(row, want, atol=2e-5), (t, row, want)


def test_probabilities_sum_to_one():
    language, _ = models(["abab abba", "cab"], ["abba caba", "abc"])
    for context in (b"", b"a", b"ab", b"abb", b"zz", b"bab"):
        p, _ = language.probabilities([context + bytes([x]) for x in range(256)])
        assert np.allclose(p.reshape(256, -1, 2)[:, len(context) + 1].sum(0), 1, atol=1e-5)
    same = models(["abab abba"], ["abab abba"])
    assert np.abs(Evidence(*same).features(pa.array(["abab zzz abba", None, ""]))).max() < 1e-5  # the same counts in both classes are no evidence


def test_expressions_of_harmless_words_count(spark):
    """No word tells the classes apart, only which word follows which."""
    rng = np.random.default_rng(2)
    words = "go home now you all are not my kind of people here".split()
    docs, labels = [], []
    for i in range(1200):
        ws = list(rng.choice(words, 25))
        if i % 3 == 0:
            at = int(rng.integers(0, 20))
            ws[at : at + 3] = ["kind", "home", "kind"]
        else:
            ws = [w for k, w in enumerate(ws) if not k or (ws[k - 1], w) not in {("kind", "home"), ("home", "kind")}]
        docs.append((i, " ".join(ws)))
        labels.append((i, int(i % 3 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = score_toxicity(d, train_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")), ["doc_id"]).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    assert ((held.score >= 0.3) == (held.doc_id % 3 == 0)).mean() > 0.9


def test_held_out_and_odd_rows(spark):
    docs, labels = make_rows()
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "word " * 30000, None), (None, "lost id", None), (5, docs[5][1], "x")]
    labels += [(None, 1, None), (7, None, None), (1000, 1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = train_toxicity(d, lab)
    got = score_toxicity(d, model, ["doc_id"]).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    held = got[got.doc_id < 400]
    assert ((held.score >= 0.3) == (held.doc_id % 4 == 0)).mean() > 0.97
    assert (got[got.doc_id >= 1000].score < 0.3).all()
    empty = train_toxicity(d.limit(0), lab.limit(0))
    assert set(score_toxicity(d, empty, ["doc_id"]).toPandas().score) == {0.0}
    assert score_toxicity(d.limit(0), model, ["doc_id"]).count() == 0


def test_query(spark, sf_dir):
    got = op8_toxicity(spark, sf_dir).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_runs_without_white_space_are_read_to_their_end(spark):
    docs, labels = make_rows()
    plain = "the weather is mild today and we walk along the river with our friends"
    docs += [(2000 + i, j.join([*plain.split(), *TOXIC[:2]]), "x") for i, j in enumerate("-,_/")] + [(2100 + i, j.join(plain.split()), "x") for i, j in enumerate("-,_/")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = train_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    got = {r.doc_id: r.score for r in score_toxicity(d, model, ["doc_id"]).collect()}
    assert all(got[2000 + i] >= 0.3 > got[2100 + i] for i in range(4))
    run = bytes(np.random.default_rng(3).integers(128, 256, 500, np.uint8))
    for n in (PIECE, PIECE + 1, PIECE + ORDER, 2 * PIECE, 500):
        inside = {p[i : i + ORDER] for p in pieces(run[:n]) for i in range(len(p) - ORDER + 1)}
        assert {run[i : i + ORDER] for i in range(n - ORDER + 1)} <= inside
    assert pieces(b"-" * 90) == [b""]


def test_held_out_recall_by_language(spark):
    """Of the toxic documents that the model hasn't learned from; those that no word tells apart are named in the README."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = op8_toxicity(spark, sf).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    recall = got[got.toxic == 1].groupby("lang").predicted.mean()
    assert recall.get("en", 1.0) >= 0.9
    assert got[got.toxic == 0].predicted.mean() < 0.02
