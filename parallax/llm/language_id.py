"""Language identification by word-first backoff.

A word that the sample knows scores its log frequency in each language. An unseen word falls back to its character n-grams (with a mark
at both ends): the longest length of which any n-gram is known counts, by the mean of the n-grams' log frequencies. A text's language is
the one with the greatest sum over all its words; ties go to the first name in order. A run of over PIECE characters without white space counts as
several words, which cover all of its letters.

Learning uses a bounded sample: at most SAMPLE documents of each language, the first by the hash of their id, with copies of a text
counted once; all of their words and n-grams are kept. Documents of the held-out fold, null languages and null texts are never learned from. A null text, or one without letters, is `und` with score 0; a text
whose words are all unknown takes the first language with an even score; without training rows every text is `und`. Rows and their ids
may repeat; a carried column named lang_pred or score gives way to the result, other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, crc_mod, named, table, unpacked
from .word_index import WordTable, split_words, sums
from .word_table import grouped_counts, per_group_sample

#: Documents of each language that are learned from, and the longest n-gram.
SAMPLE, LONGEST = 1500, 5
#: Characters of a word; longer runs without white space are cut into pieces, which are all learned from and scored.
PIECE = 40
#: Added to each count, and the number of words whose mean evidence the score is read from.
ALPHA, SCORE_WORDS = 0.5, 12
UNKNOWN = "und"


def bare(word: str) -> str:
    """The word from its first to its last letter; empty if it has none."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while a < b and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def pieces(word: str) -> list[str]:
    """A word of at most PIECE characters as it is; a longer run as its stretches of letters with their marks, and each of these that is
    still longer in pieces that overlap by LONGEST - 1, so that every n-gram lies in one of them."""
    if len(word) <= PIECE:
        return [word]
    core = bare(word)
    if len(core) <= PIECE:
        return [core]
    runs = "".join(c if c.isalpha() or category(c)[0] == "M" else " " for c in core).split()
    return [r[i : i + PIECE] for r in runs for i in range(0, max(1, len(r) - LONGEST + 1), PIECE - LONGEST + 1)]


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def word_counts(texts: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """The bare words of texts, and how often each occurs."""
    found = split_words(texts, unicode=True)[0].value_counts()
    total: Counter = Counter()
    for w, n in zip(found.field("values").cast(pa.binary()).to_pylist(), found.field("counts").to_pylist(), strict=True):
        for p in pieces(w.decode("utf-8", "replace")):
            total[bare(p)] += n
    total.pop("", None)
    return [pa.array(list(total), pa.string())], np.array(list(total.values()), np.int64)


class LanguageModel:
    """found: for each length of n-gram (0: words) the keys and their counts by language."""

    def __init__(self, languages: list[str], found: dict[int, tuple[list[str], np.ndarray]]):
        self.languages = languages
        self.levels = {n: self._logs(keys, counts) for n, (keys, counts) in found.items() if len(keys)}

    @staticmethod
    def _logs(keys: list[str], counts: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        logs = np.log((counts + ALPHA) / (counts.sum(0) + ALPHA * len(counts)))
        return {k: i for i, k in enumerate(keys)}, (logs - logs.max(1, keepdims=True)).astype(np.float32)

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        """For each run without white space the sum over its pieces: log frequency by language, less the greatest, and a one for letters."""
        cut = [pieces(w.decode("utf-8", "replace")) for w in words]
        begins = np.concatenate([[0], np.cumsum(list(map(len, cut)), dtype=np.int64)])
        return sums(self.rows([p for ps in cut for p in ps]), begins)

    def rows(self, words: list[str]) -> np.ndarray:
        """For each word its log frequency by language, less the greatest, and whether it has a letter."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        cores = [bare(w) for w in words]
        out[:, -1] = [bool(c) for c in cores]
        left = [i for i, c in enumerate(cores) if c]
        for n in [0, *range(LONGEST, 0, -1)]:
            if n not in self.levels or not left:
                continue
            index, logs = self.levels[n]
            hits: list[int] = []
            owner: list[int] = []
            rest = []
            for i in left:
                got = [x for x in map(index.get, [cores[i]] if not n else grams(cores[i], n)) if x is not None]
                if got:
                    hits += got
                    owner += [i] * len(got)
                else:
                    rest.append(i)
            if hits:
                at = np.array(owner)
                for k in range(len(self.languages)):
                    out[:, k] += np.bincount(at, logs[hits, k], len(words)) / np.maximum(np.bincount(at, minlength=len(words)), 1)
            left = rest
        return out

    def predict(self, seen: WordTable, texts: pa.Array) -> list[pa.Array]:
        words, begins = split_words(texts, unicode=True)
        rows = seen.read(words)
        total = sums(seen.values.values[rows], begins)
        n = total[:, -1]
        if not self.languages:
            return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
        z = total[:, :-1]
        best = z.argmax(1)
        z = (z - z.max(1, keepdims=True)) * np.minimum(1.0, SCORE_WORDS / np.maximum(n, 1))[:, None]
        names = [self.languages[i] if k else UNKNOWN for i, k in zip(best, n, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(n > 0, 1 / np.exp(z).sum(1), 0.0))]


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learn from rows whose fold (crc32 of the id as text, mod 4) is not 2."""
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), named(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null and id is not null").filter(crc_mod("id", 4) != 2)
    chosen = per_group_sample(rows.select("id", "lang"), "lang", "id", sample)
    learned = rows.join(F.broadcast(chosen), ["id", "lang"]).dropDuplicates(["lang", "text"])  # SAMPLE ids a language at most
    counted = grouped_counts(learned, "lang", "text", word_counts, "word string")

    def parts(batches):
        for batch in batches:
            langs, words, n = (c.to_pylist() for c in batch.columns)
            totals: Counter = Counter()
            for g, w, c in zip(langs, words, n, strict=True):
                totals[g, 0, w] += c
                for size in range(1, LONGEST + 1):
                    for key in grams(w, size):
                        totals[g, size, key] += c
            cols = [list(x) for x in zip(*totals, strict=True)] if totals else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(list(totals.values()), pa.int64())], ["lang", "size", "key", "n"])

    kept = counted.mapInArrow(parts, "lang string, size int, key string, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(kept["lang"].unique().to_pylist()))
    at = {x: i for i, x in enumerate(names)}
    size, n = kept["size"].to_numpy(), kept["n"].to_numpy()
    lang = np.array([at[x] for x in kept["lang"].to_pylist()], np.int64)
    found = {}
    for k in range(LONGEST + 1):
        here = np.flatnonzero(size == k)
        keys = kept["key"].take(pa.array(here)).combine_chunks().dictionary_encode()
        counts = np.zeros((len(keys.dictionary), len(names)))
        counts[keys.indices.to_numpy(), lang[here]] = n[here]
        found[k] = keys.dictionary.to_pylist(), counts
    return LanguageModel(names, found)


def identify_language(docs: DataFrame, model: LanguageModel, columns: list[str], text_col: str = "text") -> DataFrame:
    """`columns`, lang_pred and score (0 to 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        seen = WordTable(m.word_rows, len(m.languages) + 1)
        return lambda texts: m.predict(seen, texts)

    return unpacked(attach(docs, columns, text_col, make, "lang_pred string, score double"), columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, train_language_model(docs), ["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
