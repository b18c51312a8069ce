"""Spelling variants: words one edit apart, found in a trie of letter-group counts, and the form that each word is a variant of.

A word is a maximal run of Latin letters with A-Z in small letters, counted over all documents. Two words are near if one inserted,
deleted or replaced code point makes one of the other. The form of a word is its near word of the greatest count, if that is RATIO times
its own; the root is what the forms lead to at last.

The vocabulary is searched in the trie of letter_trie.py. Its top, the first groups of letters, is the key by which Spark deals the words out: as many groups
as it takes for no key to have over a share of the words (LEAST to LARGEST). A word goes to its own key, and, to be asked about there, to
the greater ones of the keys that one edit may lead to, so that each pair meets once. If even the whole vector is one of too many
words, its words are cut into parts by hash, and asked about in each part. In a task the trie goes on from there. Tasks return, for each
word, how many near words they found and the best of them, never the pairs.

Null texts have no words, and a null id counts as an empty one where the id matters. Repeated rows count each; ties in count go to the smaller
word by code points. Texts of any length are read to their end, runs of any length too. Other columns don't matter; an empty table has no words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, staged, table
from .letter_trie import BITS, GROUPS, Halves, LetterTrie, Verifier, deal, packed, reachable, unpacked, vectors
from .word_index import byte_slices

#: Code points and occurrences of a word, at least; how many times a form's count is the word's, at least.
LETTERS, SEEN, RATIO = 5, 3, 2
#: Words of a key: a five hundredth of all, but from LEAST to LARGEST.
LEAST, LARGEST, SHARE = 2000, 20_000, 500
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: A run in one of so many is met with a letter left out.
LEFT_OUT = 97


def words_of(text: str, seed: int, least: int, left_out: int | None, runs: re.Pattern) -> list[bytes]:
    """The runs of at least `least` letters as Latin-1 bytes, one in left_out without a letter that its hash tells."""
    found = runs.findall(text.encode("latin-1", "replace").lower())
    if not left_out:
        return found
    out = []
    for w in found:
        h = crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
        if h % left_out:
            out.append(w)
        elif len(w) > least:
            k = h % len(w)
            out.append(w[:k] + w[k + 1 :])
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LETTERS, left_out: int | None = None) -> DataFrame:
    """(word, n) over whole texts, words of at least `least` code points. With left_out, one run in so many, told by the crc32 of
    `<id>:<run>`, loses a code point before it is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        runs = re.compile(b"[a-z\xc0-\xff]{%d,}" % least)

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for a, b in byte_slices(batch.column(1), 2_000_000):
                for i, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    if text:
                        counts.update(words_of(text, crc32(f"{i or ''}:".encode()), least, left_out, runs))
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    rows = docs.select(named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def latin(words: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [w.encode("latin-1") for w in words.to_pylist()]


def letter_counts(words: DataFrame) -> dict[int, int]:
    """How often each code point occurs in the vocabulary: a row for each of the 256 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(latin(batch.column(0))), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["letter", "n"])

    rows = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    return {r["letter"]: r["n"] for r in rows}


def near_words(words: DataFrame, least: int = LEAST, largest: int = LARGEST) -> DataFrame:
    """From words (word, n), each word once: (word, near, best_n, best) of those with near words: their number, and the one of greatest count."""
    group = deal(letter_counts(words))

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed(vectors(latin(batch.column(0)), group)))], ["word", "n", "vector"])

    known = staged(words.select("word", "n").mapInArrow(vector, "word string, n long, vector long"), "vectors")
    most = min(largest, max(least, known.count() // SHARE))
    for depth in range(1, GROUPS + 1):
        sizes = known.groupBy(F.shiftright("vector", BITS * (GROUPS - depth)).alias("key")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= most:
            break
    # Only at the full depth can a key be left with more; there are no more of these than all words / most.
    parts = {r["key"]: -(-r["count"] // most) for r in sizes.filter(F.col("count") > most).collect()} if depth == GROUPS else {}
    shift = BITS * (GROUPS - depth)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, part, word, n, own, same): own, if the word is of the part; same, if it is of the key."""
        for batch in batches:
            code = batch.column(2).to_numpy() >> shift
            ways = [(code, np.arange(len(code)), True)]
            for other in reachable(unpacked(code, depth)):
                fine = np.flatnonzero(other[:, 0] >= 0)
                key = np.zeros(len(fine), np.int64)
                for g in range(depth):
                    key = key << BITS | other[fine, g]
                ways.append((key, fine, False))
            for key, at, same in ways:
                rows, own = batch.take(pa.array(at)), np.full(len(at), same)
                part = np.zeros(len(at), np.int64)
                if parts:
                    n = np.array([parts.get(k, 1) for k in key.tolist()], np.int64)
                    mine = np.array([crc32(w) for w in latin(rows.column(0))], np.int64) % n
                    turn = np.repeat(np.arange(len(at)), n)
                    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    rows, key, own = rows.take(pa.array(turn)), key[turn], own[turn] & (part == mine[turn])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), rows.column(0), rows.column(1), pa.array(own), pa.array(np.full(len(key), same))], ["key", "part", "word", "n", "own", "same"])

    def search(found: pa.Table) -> pa.Table:
        text = found["word"].to_pylist()
        rank = np.empty(len(text), np.int64)
        n = found["n"].to_numpy()
        by = sorted(range(len(text)), key=text.__getitem__)
        rank[by] = np.arange(len(text))
        best_first = np.lexsort((rank, -n))
        place = np.empty(len(text), np.int64)
        place[best_first] = np.arange(len(text))
        raw = [w.encode("latin-1") for w in text]
        own, same = found["own"].to_numpy(), found["same"].to_numpy()
        trie, verify = LetterTrie(vectors(raw, group), np.flatnonzero(own), Halves(raw)), Verifier(raw)
        near, best = np.zeros(len(text), np.int64), np.full(len(text), len(text))
        for asked, word in trie.near(np.arange(len(text))):
            once = ~same[asked] | (rank[asked] < rank[word])  # a key's own pairs are met from both sides
            asked, word = asked[once], word[once]
            ok = verify.holds(asked, word)
            for x, y in ((asked[ok], word[ok]), (word[ok], asked[ok])):
                near += np.bincount(x, minlength=len(text))
                np.minimum.at(best, x, place[y])
        some = np.flatnonzero(near)
        to = best_first[best[some]]
        return pa.table({"word": found["word"].take(pa.array(some)), "near": pa.array(near[some]), "best_n": pa.array(n[to]), "best": found["word"].take(pa.array(to))})

    dealt = known.mapInArrow(route, "key long, part long, word string, n long, own boolean, same boolean")
    pairs = dealt.groupBy("key", "part").applyInArrow(search, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return pairs.groupBy("word").agg(F.sum("near").alias("near"), top.alias("top")).select("word", "near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """From words (word, n), each word once: (word, form, root, n, n_near, form_n)."""
    words = staged(words, "vocabulary")
    found = words.join(near_words(words), "word", "left")
    holds = F.col("best_n") >= ratio * F.col("n")
    forms = staged(found.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best")).alias("form"), F.when(holds, F.col("best_n")).alias("form_n")), "forms")
    # A form's count is greater than the word's, so that the way ends; each round doubles how far a word has come on it.
    way = forms.filter("form is not null").select("word", F.col("form").alias("to"))
    while True:
        on = way.select(F.col("word").alias("to"), F.col("to").alias("_on"))
        way = staged(way.join(on, "to", "left").select("word", F.coalesce("_on", "to").alias("to"), F.col("_on").isNotNull().alias("moved")), "roots")
        if way.filter("moved").isEmpty():
            break
        way = way.drop("moved")
    roots = way.select("word", F.col("to").alias("root"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = word_counts(table(spark, sf_dir, "documents"), left_out=LEFT_OUT)
    return variants(counted.filter(F.col("n") >= SEEN))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
_KEPT = "a-zÀ-ÿ"
ORACLE = {
    "op11_spelling_variants": f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{_KEPT}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= {LETTERS} GROUP BY ALL),
h AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[x, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN
    flatten([CASE WHEN ascii(c) < 128 THEN [CAST(ascii(c) AS BIGINT)] ELSE [CAST(192 + ascii(c) // 64 AS BIGINT), 128 + ascii(c) % 64] END FOR c IN string_split(doc_id || ':' || run, '')])])),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), 4294967295) AS h FROM c),
v AS (SELECT CASE WHEN h % {LEFT_OUT} = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= {LETTERS} AND sum(k) >= {SEEN}),
-- Words that are near share a text with one place left out.
d AS (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS less FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.less UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS best_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * v.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * v.n THEN best_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
way(word, upto) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.upto WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.upto AS root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word JOIN f e ON e.word = way.upto AND e.form IS NULL
"""
}
