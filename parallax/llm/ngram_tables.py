"""Interpolated modified Kneser-Ney models of any order, counted by Spark and held in sorted hash arrays.

A token is a 64-bit code; the key of an n-gram is a hash of the key of its context (the tokens before the last) and its last token, and a
model's name is in the keys, so that the models of several languages share the same arrays. Sequences are padded at their start.

The n-grams of the highest order keep their counts. One of a lower order counts how many different tokens stand before it, or, where
it begins at a sequence's start and nothing can, how often it occurs. The three discounts of each model and order, of counts of one, two, and more,
follow from how many n-grams have counts of one to four. What they take away goes to the next lower order, in the end to an even chance.

For each order there is one sorted array of keys, with the n-gram's own share of the probability and, as a context, the weight of
what lies below. A look-up begins where the key's first bits say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .hash_array import HashArray
from .shingles import BASE, INVERSE, mix, powers
from .word_index import sums

ODD = np.uint64(0x9E3779B97F4A7C15)
#: The token before a sequence.
PAD = np.uint64(0x51ED270B9F6E1A37)


def name_code(name: str) -> np.uint64:
    """A model's number, from its name."""
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def word_codes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    lists = words.cast(pa.large_binary())
    ends = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    if not len(lists):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    at = ends - ends[0]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, max(1, len(raw)))[: len(raw)], out=total[1:])
    return mix((total[at[1:]] - total[at[:-1]]) * powers(INVERSE, len(raw) + 1)[at[:-1]] + np.diff(at).astype(np.uint64))


def padded(codes: np.ndarray, begins: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences with order - 1 pads before each, and which places are tokens."""
    n = len(begins) - 1
    lengths = np.diff(begins)
    token = np.ones(len(codes) + n * (order - 1), bool)
    first = begins[:-1] + np.arange(n) * (order - 1)
    for k in range(order - 1):
        token[first + k] = False
    out = np.full(len(token), PAD, np.uint64)
    out[token] = codes
    assert token.sum() == lengths.sum()
    return out, token


def chain(codes: np.ndarray, model: np.ndarray | np.uint64, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of order 1 to `order` that end at each place; right where so many places lie before it in its sequence."""
    one = mix(codes * ODD + model)
    out = [one]
    for _ in range(1, order):
        before = np.empty_like(one)
        before[0], before[1:] = 0, out[-1][:-1]
        out.append(mix(before * ODD + one))
    return out


def ngram_rows(codes: np.ndarray, begins: np.ndarray, weight: np.ndarray | None, model: np.uint64, order: int) -> pa.RecordBatch:
    """The distinct n-grams of the sequences: model, k1 to k<order> (its suffixes), c2 to c<order> (their contexts), free (how many of its
    tokens are no pads), n. weight: how often each sequence counts."""
    code, token = padded(codes, begins, order)
    keys = chain(code, model, order)
    at = np.flatnonzero(token)
    place = np.arange(len(codes)) - np.repeat(begins[:-1], np.diff(begins))
    every = np.ones(len(at), np.int64) if weight is None else np.repeat(weight, np.diff(begins))
    top, first, turn = np.unique(keys[-1][at], return_index=True, return_inverse=True)
    n = np.bincount(turn, every, len(top)).astype(np.int64)
    own = at[first]
    columns = [np.full(len(own), model, np.uint64).view(np.int64)]
    columns += [k[own].view(np.int64) for k in keys] + [keys[i - 1][own - 1].view(np.int64) for i in range(1, order)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, np.minimum(place[first] + 1, order), n]], names_of(order))


def names_of(order: int) -> list[str]:
    return ["model", *[f"k{i + 1}" for i in range(order)], *[f"c{i + 1}" for i in range(1, order)], "free", "n"]


def ddl_of(order: int) -> str:
    return ", ".join(f"{c} long" for c in names_of(order))


class NgramTables:
    """Per order: sorted keys, the n-grams' own shares, and as contexts the weights of the lower order; for each model the lowest chance
    and its weight."""

    def __init__(self, order: int, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], even: dict[int, float], weight: dict[int, float]):
        self.order, self.tables, self.even, self.weight = order, tables, even, weight
        self.keys = [HashArray(keys) for keys, _, _ in tables]

    def find(self, order: int, keys: np.ndarray) -> np.ndarray:
        """The places of keys of an order (1 first), -1 where there is none."""
        return self.keys[order - 1].find(keys)

    def log_probabilities(self, codes: np.ndarray, begins: np.ndarray, model: np.uint64) -> np.ndarray:
        """Natural logarithm of each token's probability in its sequence."""
        code, token = padded(codes, begins, self.order)
        keys = chain(code, model, self.order)
        at = np.flatnonzero(token)
        found = [self.find(i, keys[i - 1]) for i in range(1, self.order)] + [None]
        p = np.full(len(at), self.even.get(int(model), 1e-9) * self.weight.get(int(model), 1.0))
        for i in range(1, self.order + 1):
            share = self.tables[i - 1][1]
            here = found[i - 1][at] if i < self.order else self.find(i, keys[-1][at])
            if i > 1:
                context = found[i - 2][at - 1]
                lower = self.tables[i - 2][2]
                p = p * np.where(context >= 0, lower[context], np.float32(1)) if len(lower) else p
            if len(share):
                p = p + np.where(here >= 0, share[here], np.float32(0))
        return np.log(np.maximum(p, 1e-30))

    def sequence_sums(self, codes: np.ndarray, begins: np.ndarray, model: np.uint64) -> np.ndarray:
        return sums(self.log_probabilities(codes, begins, model), begins)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts of one, two and more; where too little is known for them, an absolute discount."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2.0 * n2)
    return max(0.1, 1 - 2 * y * n2 / n1), max(0.2, 2 - 3 * y * n3 / n2), max(0.3, 3 - 4 * y * n4 / n3)


def count_ngrams(rows: DataFrame, order: int, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], least: int = 1) -> NgramTables:
    """The tables from what make()(batch) gives by ngram_rows for the batches of rows. What comes to the driver are the distinct n-grams of
    rows, so that these must be bounded. N-grams of the highest order seen fewer than `least` times are counted, but not kept: their share
    goes to the lower orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    others = [c for c in names_of(order) if c not in ("model", f"k{order}", "n")]
    level = rows.mapInArrow(run, ddl_of(order)).groupBy("model", f"k{order}").agg(*[F.first(c).alias(c) for c in others], F.sum("n").alias("n"))
    top = level = level.withColumn("adjusted", F.col("n")).persist()
    shares, weights = {}, {}
    even: dict[int, float] = {}
    held: DataFrame | None = None
    for i in range(order, 0, -1):
        context = F.col(f"c{i}") if i > 1 else F.col("model")
        shares[i], weights[i], sizes = _shares(level.select("model", F.col(f"k{i}").alias("key"), context.alias("context"), F.col("adjusted").alias("n")), least if i == order > 1 else 1)
        even = {np.uint64(m & (1 << 64) - 1).item(): 1.0 / (n + 1) for m, n in sizes.items()}
        if i > 1:
            kept = [f"k{k}" for k in range(1, i - 1)] + [f"c{k}" for k in range(2, i)] + ["free"]
            # Before a sequence's first tokens nothing stands: such an n-gram counts as often as it occurs.
            adjusted = F.when(F.first("free") < i - 1, F.sum("n")).otherwise(F.count("*"))
            level = level.groupBy("model", f"k{i - 1}").agg(*[F.first(c).alias(c) for c in kept], F.sum("n").alias("n"), adjusted.alias("adjusted"))
            above, level = held, staged(level, "ngrams")
            held = level
            if above is not None:
                discard(above)
    top.unpersist()
    if held is not None:
        discard(held)
    root, weight = weights[1]
    return NgramTables(order, [_table(*shares[i], *weights.get(i + 1, (np.zeros(0, np.uint64), np.zeros(0, np.float32)))) for i in range(1, order + 1)], even, dict(zip(root.tolist(), weight.tolist(), strict=True)))


def _shares(level: DataFrame, least: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], dict[int, int]]:
    """Of the n-grams of an order (model, key, context, n): the keys and shares of those kept, the contexts and weights, and how many
    n-grams each model has. Spark sums up; a key and a number for each comes to the driver."""
    of = lambda k: F.count_if(F.col("n") == k)
    found = level.groupBy("model").agg(F.count("*").alias("size"), *[of(k).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()
    cuts = [F.lit(x) for r in found for x in (r["model"], F.array(*map(F.lit, discounts(*(r[f"n{k}"] for k in (1, 2, 3, 4))))))]
    cut = F.create_map(*cuts)[F.col("model")][F.least(F.col("n"), F.lit(3)).cast("int") - 1] if cuts else F.lit(0.0)
    rows = level.select("key", "context", "n", F.when(F.col("n") < least, F.col("n").cast("double")).otherwise(cut).alias("cut"))
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
    kept = rows.filter(F.col("n") >= least).join(contexts.select("context", "total"), "context")
    pairs = []
    for df, k, v in ((kept, "key", (F.col("n") - F.col("cut")) / F.col("total")), (contexts, "context", F.col("left") / F.col("total"))):
        got = df.select(k, v.cast("float").alias("v")).toArrow()
        pairs.append((got[k].to_numpy().view(np.uint64).copy(), got["v"].to_numpy().copy()))
        del got
        pa.default_memory_pool().release_unused()
    return pairs[0], pairs[1], {r["model"]: r["size"] for r in found}


def _table(keys: np.ndarray, share: np.ndarray, heads: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted array of an order's n-grams and of those that are contexts of the next order, with shares and weights."""
    own = np.unique(np.concatenate([keys, heads]))
    a, g = np.zeros(len(own), np.float32), np.ones(len(own), np.float32)
    a[np.searchsorted(own, keys)] = share
    g[np.searchsorted(own, heads)] = weight
    return own, a, g
