"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are words: A-Z in small letters, with all ASCII that is no letter or digit between them. A document holds an item of L
words if some stretch of it is within TOLERANCE * L word edits (insertions, deletions, substitutions) of the item.

The CGK embedding walks along words; at each step the word it stands on is written down and a random bit of that word and step decides
whether the walk goes on. Walks from windows at a small edit distance write mostly the same words, so edit distance becomes Hamming
distance. Documents are walked from each STRIDE-th word, items from every word, so that any shift of an occurrence meets a walk of its
item. An LSH key is the hash of SAMPLED places of a walk; WALKS walks with REPEATS keys each, and the several windows that an occurrence
holds, bring the recall. Windows are item-sized in that the places lie within the length of the item's class. Whatever shares a key is
verified exactly, by an alignment of the whole item with the stretch about the window; only that decides.

Items of fewer than SHORT words allow no edit and are looked up whole. Items that are null or without words match nothing, as do null and
empty texts. An item set over MOST_ITEMS, or whose texts are over MOST_BYTES together, is taken in several passes one after the other,
each with one broadcast of bounded size, whose matches are written to the shared folder. Rows may repeat. One pass needs no shuffle. A
carried column named matches gives way to the result; other columns don't matter.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, named, staged, table, text_bytes, unpacked
from .shingles import mix, powers, word_hashes

TOLERANCE, STRIDE, WALKS, REPEATS, SAMPLED, SHORT = 0.15, 4, 2, 6, 4, 8
#: Steps of the walk by the least length of an item; a walk of n steps passes about n / 2 words.
CLASSES = [(32, 40), (16, 18), (SHORT, 7)]
MOST_ITEMS, MOST_BYTES = 20_000, 32_000_000
TABLE_BITS = 22
_TABLE = bytes(ord(chr(i).lower()) if chr(i) in string.ascii_letters + string.digits else i if i >= 128 else 32 for i in range(256))
WINDOW_BASE = 0xD6E8FEB86659FD93


def words(text: bytes) -> np.ndarray:
    return word_hashes(text.translate(_TABLE))


def places(steps: int, walk: int) -> list[np.ndarray]:
    rng = np.random.default_rng(1000 * steps + walk)
    return [np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False)) for _ in range(REPEATS)]


def walk_keys(w: np.ndarray, starts: np.ndarray, steps: int, walk: int, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """REPEATS keys of the walk from each start, and whether each lies before `end`."""
    bits = mix(w ^ np.uint64(0x9E3779B97F4A7C15 * (walk + 1) & 0xFFFFFFFFFFFFFFFF))
    at = starts.astype(np.int64)
    last = len(w) - 1
    chosen = places(steps, walk)
    keys = np.full((REPEATS, len(starts)), steps * 64 + walk, np.uint64)
    inside = np.ones((REPEATS, len(starts)), bool)
    for j in range(steps):
        here = np.minimum(at, last)
        for r, p in enumerate(chosen):
            if j in p:
                keys[r] = keys[r] * np.uint64(0x9E3779B97F4A7C15) + w[here]
                if end is not None:
                    inside[r] &= at < end
        at += ((bits[here] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return mix(keys + np.arange(REPEATS, dtype=np.uint64)[:, None]), inside


def edit_window(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """The least number of word edits between the item and a stretch of text, and where the first such stretch ends; None if over most."""
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != x), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


def shared_words(bag: tuple[np.ndarray, np.ndarray], text: np.ndarray) -> int:
    """How many words of the item, given as its distinct words and their counts, occur in text."""
    own, times = bag
    at = np.minimum(np.searchsorted(own, text), len(own) - 1)
    there = np.zeros(len(own), bool)
    there[at[own[at] == text]] = True
    return int(times[there].sum())


class ItemIndex:
    """LSH keys of a bounded set of items."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.items = [], []
        for i, t in zip(ids, texts, strict=True):
            w = words(t)
            if len(w):
                self.ids.append(i)
                self.items.append(w)
        self.bags = [np.unique(w, return_counts=True) for w in self.items]
        keys, owners, offsets = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, w in enumerate(self.items):
            if len(w) < SHORT:
                self.short.setdefault(len(w), {}).setdefault(int(self.whole(w, len(w))[0]), []).append(k)
                continue
            steps = next(s for least, s in CLASSES if len(w) >= least)
            starts = np.arange(len(w))
            for walk in range(WALKS):
                found, inside = walk_keys(w, starts, steps, walk, len(w))
                r, o = np.nonzero(inside)
                keys.append(found[r, o])
                owners.append(np.full(len(r), k))
                offsets.append(o)
        self.classes = [s for least, s in CLASSES if any(next(x for y, x in CLASSES if len(w) >= y) == s for w in self.items if len(w) >= SHORT)]
        none = np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else none.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.owner, self.offset = (np.concatenate(x)[order] if x else none for x in (owners, offsets))
        self.mark = np.zeros(1 << TABLE_BITS, bool)
        self.mark[(self.key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    @staticmethod
    def whole(w: np.ndarray, size: int) -> np.ndarray:
        """A hash of each stretch of `size` words."""
        p = powers(WINDOW_BASE, size)
        n = len(w) - size + 1
        out = np.zeros(max(0, n), np.uint64)
        for i in range(size):
            out += w[i : i + n] * p[i]
        return mix(out)

    def matches(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (item id, first word, edits), one for each item, the best by edits and place."""
        parts = [words(t) for t in texts]
        lengths = np.array([len(p) for p in parts])
        begins = np.concatenate([[0], np.cumsum(lengths)])
        w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]

        def note(doc: int, k: int, edits: int, at: int) -> None:
            best = found[doc].get(k)
            if best is None or (edits, at) < best:
                found[doc][k] = edits, at

        if len(w):
            for size, known in self.short.items():
                h = self.whole(w, size)
                for p in np.flatnonzero(np.isin(h, np.array(list(known), np.uint64))):
                    doc = int(np.searchsorted(begins, p, "right")) - 1
                    for k in known[int(h[p])]:
                        if p + size <= begins[doc + 1] and (w[p : p + size] == self.items[k]).all():
                            note(doc, k, 0, int(p - begins[doc]))
            seen: set[tuple[int, int, int]] = set()
            starts = np.arange(0, len(w), STRIDE)
            for steps in self.classes:
                for walk in range(WALKS):
                    keys, _ = walk_keys(w, starts, steps, walk)
                    for row in keys:
                        hit = np.flatnonzero(self.mark[(row >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
                        a, b = np.searchsorted(self.key, row[hit], "left"), np.searchsorted(self.key, row[hit], "right")
                        for s, x, y in zip(starts[hit][a < b], a[a < b], b[a < b], strict=True):
                            doc = int(np.searchsorted(begins, s, "right")) - 1
                            for e in range(x, y):
                                seen.add((doc, int(self.owner[e]), int(s - self.offset[e])))
            self._verify(w, begins, sorted(seen), note)
        return [sorted((self.ids[k], at, edits) for k, (edits, at) in f.items()) for f in found]

    def _verify(self, w: np.ndarray, begins: np.ndarray, seen: list[tuple[int, int, int]], note) -> None:
        done: dict[tuple[int, int], int] = {}
        for doc, k, guess in seen:
            item = self.items[k]
            most = int(TOLERANCE * len(item))
            last = done.get((doc, k))
            if last is not None and last >= guess:  # within the stretch that was just aligned; a guess may lie before the first word
                continue
            lo = max(int(begins[doc]), guess - 2 * most - 1)
            hi = min(int(begins[doc + 1]), guess + len(item) + 4 * most + 1)
            done[doc, k] = guess + most
            if shared_words(self.bags[k], w[lo:hi]) < len(item) - most:  # too few of its words for that many edits
                continue
            got = edit_window(item, w[lo:hi], most)
            if got:
                back = edit_window(item[::-1], w[lo : lo + got[1]][::-1], most)
                note(doc, k, got[0], lo + got[1] - (back[1] if back else len(item)) - int(begins[doc]))


def contamination_rows(docs: DataFrame, items: DataFrame, columns: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, matches): row is a struct of `columns`, matches an array of (item_id, start, edits); start counts words."""
    listed = items.select(named(item_id).cast("long").alias("id"), named(item_text).cast("string").alias("text")).filter("text is not null and id is not null").distinct()
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["n"] // MOST_ITEMS), -(-size["bytes"] // MOST_BYTES))
    if passes == 1:
        return _one_pass(docs, columns, text_col, listed)[0]
    # Rows get a number that stays, since each pass reads them again.
    kept = staged(docs.select(F.struct(*map(named, columns)).alias("row"), named(text_col).alias("text"), F.monotonically_increasing_id().alias("uid")), "numbered")
    found = None
    for n in range(passes):
        out, held = _one_pass(kept, ["uid"], "text", listed.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == n))
        done = staged(out.filter(F.size("matches") > 0).select("row.uid", "matches"), "matches")
        held.unpersist()
        found = done if found is None else found.unionByName(done)
    matches = found.groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    return kept.drop("text").join(matches, "uid", "left").select("row", F.coalesce("matches", F.array().cast(matches.schema["matches"].dataType)).alias("matches"))


def find_contamination(docs: DataFrame, items: DataFrame, columns: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`columns` and matches: an array of (item_id, start, edits); start counts words. Each row of docs gives one row."""
    return unpacked(contamination_rows(docs, items, columns, text_col, item_id, item_text), columns)


def _one_pass(docs: DataFrame, columns: list[str], text_col: str, listed: DataFrame):
    """(row, matches) for a bounded set of items, and the broadcast."""
    part = listed.orderBy("id", "text").collect()
    held = docs.sparkSession.sparkContext.broadcast(ItemIndex([r["id"] for r in part], [r["text"].encode() for r in part]))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int64())]))

    def make():
        index = held.value
        return lambda texts: [pa.array([[{"item_id": i, "start": s, "edits": e} for i, s, e in f] for f in index.matches(text_bytes(texts))], kind)]

    return attach(docs, columns, text_col, make, "matches array<struct<item_id:bigint,start:bigint,edits:bigint>>", 1_000_000), held


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.start", "m.edits")


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE: dict[str, str] = {}
