"""Fixed rules against plain loops, models against plain dictionaries, verdicts by held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from parallax.llm import quality_rules, word_ngrams
from parallax.llm.ngram_tables import PAD, chain, count_ngrams, discounts, name_code, ngram_rows, word_codes
from parallax.llm.quality_rules import QualityModel, Words, band, judge, op12_quality_rules, train_quality
from parallax.llm.word_ngrams import UNIT, count_records, frequent_of


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "b", "ab", "é", "#x", "中文", "&", "\n", "\n\n", " ", "\t", "\x0b", "\x1c", "\xa0", "a b a b a b a b a b a", "line one\nline one \nline one"]
    return [None, "", " \n \n", "a", "a a a a a a", "x" * 100_000, "one\ntwo\none\none\n\n"] + [" ".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]


def test_counts_equal_plain_loops():
    texts = odd_texts()
    words = Words()
    for part in (texts, texts[::-1]):
        got, _, _ = words.stats(pa.array(part, pa.string()))
        assert list(zip(*(c.tolist() for c in got), strict=True)) == [plain_counts(t) for t in part]


class PlainModel:
    """Interpolated modified Kneser-Ney over tuples."""

    def __init__(self, sequences, order):
        self.order = order
        raw = Counter()
        for s in sequences:
            s = ["<s>"] * (order - 1) + list(s)
            raw.update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
        self.counts = {order: raw}
        for n in range(order - 1, 0, -1):
            tops = defaultdict(int)
            for g, c in raw.items():
                tops[g[order - n - 1 :]] += c
            low = Counter()
            for g, c in tops.items():
                low[g[1:]] += c if g[1] == "<s>" else 1
            self.counts[n] = low
        self.d, self.total, self.left = {}, {}, {}
        for n, counts in self.counts.items():
            per = Counter(counts.values())
            self.d[n] = discounts(*(per[i] for i in (1, 2, 3, 4)))
            self.total[n], self.left[n] = defaultdict(float), defaultdict(float)
            for g, c in counts.items():
                self.total[n][g[:-1]] += c
                self.left[n][g[:-1]] += self.cut(n, c)

    def cut(self, n, c):
        return self.d[n][min(c, 3) - 1]

    def p(self, context, token):
        out = 1 / (len(self.counts[1]) + 1)
        for n in range(1, self.order + 1):
            h = tuple(context[len(context) - n + 1 :])
            t = self.total[n].get(h, 0)
            if t:
                c = self.counts[n].get((*h, token), 0)
                out = ((c - self.cut(n, c)) / t if c else 0) + self.left[n][h] / t * out
        return out


@pytest.mark.parametrize("order", [2, 3, 5])
def test_model_equals_plain_dictionaries(spark, order):
    rng = random.Random(order)
    sequences = [[rng.choice([1, 1, 1, 2, 3, 4, 5 + k % 9]) for _ in range(rng.randint(1, 30))] for k in range(60)]
    df = spark.createDataFrame([(s,) for s in sequences], "s array<long>").repartition(3)
    model = name_code("xx")

    def make():
        def step(batch):
            lists = batch.column(0).to_pylist()
            codes = np.array([x for s in lists for x in s], np.uint64)
            yield ngram_rows(codes, np.concatenate([[0], np.cumsum([len(s) for s in lists])]), None, model, order)

        return step

    tables = count_ngrams(df, order, make)
    want = PlainModel(sequences, order)
    for s in [sequences[0], [1, 2, 99, 1, 1], [99], [3, 3, 3, 5, 6, 7, 1, 1, 1]]:
        got = tables.log_probabilities(np.array(s, np.uint64), np.array([0, len(s)]), model)
        padded = ["<s>"] * (order - 1) + s
        for i, g in enumerate(got):
            assert math.isclose(g, math.log(want.p(padded[i : i + order - 1], s[i])), abs_tol=1e-4)
    total = sum(want.p(["<s>"] * (order - 1), t) for t in {x for s in sequences for x in s} | {99})
    assert abs(total - 1) < 1e-9 and PAD


def test_codes_of_words_do_not_depend_on_place():
    words = ["a", "", "ab", "é", "x" * 5000, "a"]
    codes = word_codes(pa.array(words))
    assert codes[0] == codes[5] and len(set(codes.tolist())) == 5
    assert (word_codes(pa.array(["zz", *words]).slice(1)) == codes).all() and not len(word_codes(pa.array([], pa.string())))


def test_band():
    good, bad = np.array([2.0, 2.1, 2.2, 2.0, 2.3]), np.array([5.0, 6.0, 2.2])
    low, high = band(good, bad, np.array([0.5]))
    assert low < 0.5 and 2.3 < high < 5.0
    assert band(np.array([]), bad, good) == (-np.inf, np.inf)


def test_odd_rows_without_labels(spark):
    rows = [(1, None, None, 1), (None, "", "xx", 2), (2, "word " * 30, None, 3), (3, "The small boat went slowly down the river until night fell upon us.", "en", 4), (3, "x" * 200_000, "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = train_quality(docs, none)
    assert model.sent is None
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in judge(docs, model, ["doc_id", "bits"]).collect())
    assert got == [(0, 0, True, False), (1, 0, True, False), (2, 30, True, False), (3, 1, True, False), (3, 13, False, True)]
    assert judge(docs.limit(0), QualityModel(None, {}), ["doc_id"]).count() == 0


def test_query_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op12_quality_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    met = Counter()
    for r in rows:
        n, chars, symbols, dup, repeated = plain_counts(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and not (r.base_failed and r.kept)
        if r.doc_id in quality and not r.base_failed:
            met[quality[r.doc_id], r.kept] += 1
    assert met[1, True] >= 0.98 * (met[1, True] + met[1, False])
    assert met[0, False] >= 0.7 * (met[0, True] + met[0, False])


class PlainWords(PlainModel):
    """The same over words, with a chance of its own for each word below the single words; n-grams of the highest order seen once are given up."""

    def __init__(self, sequences, order, base):
        super().__init__(sequences, order)
        self.base = base
        for h in self.total[order]:
            self.left[order][h] = sum(1 if c < 2 else self.cut(order, c) for g, c in self.counts[order].items() if g[:-1] == h)

    def p(self, context, token):
        out = self.base(token)
        for n in range(1, self.order + 1):
            h = tuple(context[len(context) - n + 1 :])
            t = self.total[n].get(h, 0)
            if t:
                c = self.counts[n].get((*h, token), 0)
                c = 0 if n == self.order and c < 2 else c
                out = ((c - self.cut(n, c)) / t if c else 0) + self.left[n][h] / t * out
        return out


@pytest.mark.parametrize("most", [0, 7, 10_000])
def test_joined_records_equal_plain_dictionaries(spark, most):
    rng = random.Random(3)
    sequences = [[rng.choice([1, 1, 1, 2, 3, 4, 5 + k % 9]) for _ in range(rng.randint(1, 30))] for k in range(60)]
    model, base = name_code("xx"), lambda w: 0.001 / w
    df = spark.createDataFrame([(s,) for s in sequences], "s array<long>").repartition(3)

    def read(batch):
        lists = batch.column(0).to_pylist()
        yield np.array([x for s in lists for x in s], np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in lists])]), model, 0

    keys = {w: int(chain(np.array([w], np.uint64), model, 1)[0][0].view(np.int64)) for w in range(1, 14)}
    spelled = spark.createDataFrame([(k, math.log(base(w))) for w, k in keys.items()], "z long, spelled double")
    records, left = count_records(df, read, spelled)
    frequent, rest = frequent_of(records, most)
    assert len(frequent.keys.keys) <= most
    others = {r.key: (r.share, r.weight) for r in rest.collect()}
    assert records.count() == len(others) + len(frequent.keys.keys)
    want = PlainWords(sequences, 3, base)
    asked_for = [sequences[0], [1, 2, 99, 1, 1], [99], [], [3, 3, 3, 5, 6, 7, 1, 1, 1]]
    total, (owner, key, own, context) = frequent.read(np.array([x for s in asked_for for x in s], np.uint64), np.concatenate([[0], np.cumsum(list(map(len, asked_for)))]), model)
    for o, k, a, c in zip(owner.tolist(), key.view(np.int64).tolist(), own.tolist(), context.tolist(), strict=True):
        share, weight = others.get(k, (0, 0))
        total[o] += share * a + weight * c
    for s, got in zip(asked_for, total.tolist(), strict=True):
        padded = ["<s>", "<s>", *s]
        plain = sum(math.log(want.p(padded[i : i + 2], x)) for i, x in enumerate(s))
        assert math.isclose(got / UNIT + sum(math.log(base(x)) + left[0] for x in s), plain, abs_tol=1e-3)


def test_every_labelled_document_counts(spark, monkeypatch):
    # Each language's texts are far more than 2 MB and its good documents of fold 3 more than 1500: words of each single one must be known.
    crc = lambda i: zlib.crc32(str(i).encode()) % 4
    text = lambda i: " ".join(f"w{i}x{k}" + "y" * 20 for k in range(12))
    ids = range(13_000)
    docs = spark.createDataFrame([(i, text(i), "xx") for i in ids], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_rules, "count_records", lambda rows, read, spelled: seen.append((rows, spelled)) or count_records(rows, read, spelled))
    fitted = []
    monkeypatch.setattr(quality_rules, "fit_bands", lambda scored, marked: fitted.append(scored.join(marked, "id").groupBy("part").count().collect()) or {})
    model = train_quality(docs, labels)
    learned = [i for i in ids if crc(i) < 2]
    assert sum(len(text(i)) for i in learned) > 2_000_000 and sum(crc(i) == 3 for i in ids) > 1500
    assert seen[0][0].count() == len(learned) and seen[0][1].count() == 12 * len(learned)
    assert {r["part"]: r["count"] for r in fitted[0]} == {2: len(learned), 1: sum(crc(i) == 3 for i in ids)}
    monkeypatch.undo()
    bits = {r.doc_id: r.bits for r in judge(docs, model, ["doc_id"]).collect()}
    # Those learned from are known word by word; others are spelled.
    assert max(bits[i] for i in learned) < min(bits[i] for i in ids if crc(i) == 2)


def test_rows_without_a_language_have_a_model_of_all(spark):
    rng = random.Random(9)
    words = {"aa": ["on", "the", "hill", "a", "tree", "stood"], "bb": ["im", "tal", "ein", "haus", "am", "bach"]}
    rows = [(i, " ".join(rng.choices(words[x], k=20)), x if i % 3 else None) for i in range(1200) for x in [("aa", "bb")[i % 2]]]
    rows += [(5000 + i, " ".join("".join(rng.choices("qxzjv", k=7)) for _ in range(20)), None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 5000)) for i, _, _ in rows], "doc_id long, quality int")
    model = train_quality(docs, labels)
    assert sorted(model.bands) == ["", "aa", "bb"]
    kept = {r.doc_id: r.kept for r in judge(docs, model, ["doc_id"]).collect()}
    good, bad = [kept[i] for i in kept if i < 5000], [kept[i] for i in kept if i >= 5000]
    assert sum(good) > 0.5 * len(good) and not any(bad)


def test_rarer_ngrams_are_joined(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(40)], k=25)), ["xx", None][i % 7 == 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 20 > 0)) for i, _, _ in rows], "doc_id long, quality int")
    got = []
    for most in (word_ngrams.FREQUENT, 60, 0):
        monkeypatch.setattr(word_ngrams, "FREQUENT", most)
        model = train_quality(docs, labels)
        got.append((model.bands, sorted(map(tuple, judge(docs, model, ["doc_id", "text", "lang"]).collect()), key=lambda r: r[0])))
    assert len(got[0][1]) == 600 and got[0] == got[1] == got[2]


def test_band_of_counts_equals_band_of_values():
    rng = np.random.default_rng(4)
    good, bad, learned = (np.round(rng.normal(m, 0.3, n), 1) for m, n in ((2, 400), (4, 90), (1.8, 300)))
    counted = [np.unique(x, return_counts=True) for x in (good, bad, learned)]
    assert np.allclose(band(good, bad, learned), band(*(x for x, _ in counted), times=tuple(n for _, n in counted)))


def test_packed_numbers():
    for x in ([], [0, 0, 0], [1, 255], [256, 1 << 63, 5]):
        assert word_ngrams.numbers_of(word_ngrams.numbers_packed(np.array(x, np.uint64))).tolist() == x
    for x in ([], [0], [-1, 1, -(1 << 40), 1 << 40]):
        assert word_ngrams.signed_of(word_ngrams.signed_packed(np.array(x, np.int64))).tolist() == x


def test_packed_records_answer_what_is_asked(spark):
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    share, weight = rng.integers(-9, 9, len(keys)), rng.integers(-9, 9, len(keys))
    rows = spark.createDataFrame(list(zip(keys.view(np.int64).tolist(), share.tolist(), weight.tolist(), strict=True)), "key long, share long, weight long").repartition(3)
    packed = word_ngrams.pack_records(rows, 4)
    assert sorted(map(tuple, word_ngrams.unpacked_records(packed).collect())) == sorted(map(tuple, rows.collect()))
    mask = word_ngrams.Mask.of(packed, 4)
    others = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    assert mask.may_hold(keys).all() and mask.may_hold(others).mean() < 0.01
    ask, owner = np.concatenate([keys[::3], others]), rng.integers(0, 50, len(keys[::3]) + len(others))
    own, context = rng.random((2, len(ask))) < 0.5
    asked = word_ngrams.asked_rows(owner, ask, own, context, 50, 0, 4)
    total = np.zeros(50, np.int64)
    by_bucket = {r["bucket"]: r for r in packed.toArrow().to_pylist()}
    for r in asked.to_pylist():
        one = pa.Table.from_pylist([by_bucket[r["bucket"]]])
        total += word_ngrams.signed_of(word_ngrams.answers(pa.Table.from_pylist([r]), one)[0])
    of = {k: (a, b) for k, a, b in zip(keys.tolist(), share.tolist(), weight.tolist(), strict=True)}
    want = [0] * 50
    for o, k, a, b in zip(owner.tolist(), ask.tolist(), own, context, strict=True):
        want[o] += of.get(k, (0, 0))[0] * a + of.get(k, (0, 0))[1] * b
    assert total.tolist() == want


def test_stages_go_once_they_are_read(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("stage-*"))
    op12_quality_rules(spark, "/root/testdata/sf0.001").collect()
    left = {p.name.split("-")[1] for p in set(shared.glob("stage-*")) - before}
    assert left <= {"surprise", "ngrams"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
