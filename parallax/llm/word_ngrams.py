"""Modified Kneser-Ney models of word trigrams whose log-probabilities add up over a text's n-grams, so that they can be joined to it.

A record of an n-gram has two numbers: its share, by which the logarithm of its last word's chance exceeds what the next lower order
says, and its weight, the logarithm of what it leaves, as a context, to lower orders. A word's chance is then the sum of the shares of those
n-grams that end with it and have a record and, of the contexts before it, the weights; below the single words lies a model of
spelling. Each n-gram is looked up by itself, whatever else is found. Both numbers are whole UNITs, so that sums don't depend on their order.

Words are keys that have the model's name in them (chain() of ngram_tables.py); the n-grams of all orders and models lie in one table.
Trigrams seen once are counted, but have no record: their share goes to the lower orders.

What is dealt out in large numbers goes in few rows of packed numbers, those of a bucket of keys and a slice of texts together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import discard, staged
from .hash_array import HashArray
from .ngram_tables import ODD, PAD, chain, discounts, padded
from .shingles import mix
from .word_index import sums

ORDER = 3
#: A list of sequences: their words' codes, where each begins, the model's number in keys, and its place among the models.
Sequences = tuple[np.ndarray, np.ndarray, np.uint64, int]
#: Parts of a natural logarithm's unit that records are given in.
UNIT = 1_000_000
#: Records that are broadcast, and bits of the mask that says which others may be.
FREQUENT, MASK_BITS = 1_000_000, 27


class Mask:
    """Two bits for each key, both in its bucket's section; where one is not set, no such key is among them."""

    def __init__(self, cells: np.ndarray, bits: int):
        self.cells, self.bits = cells, bits

    @classmethod
    def of(cls, packed: DataFrame, bits: int) -> Mask:
        """The mask of PACKED records. It has the same size whatever there is of them."""

        def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, raw in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                    key = keys_of(raw)
                    cells = np.zeros(1 << (MASK_BITS - bits), bool)
                    cells[key >> np.uint64(64 - MASK_BITS)] = True
                    cells[key & np.uint64(len(cells) - 1)] = True
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())], ["bucket", "section"])

        found = packed.select("bucket", "keys").mapInArrow(sections, "bucket int, section binary").toArrow()
        cells = np.zeros(1 << (MASK_BITS - 3), np.uint8)
        for bucket, section in zip(found["bucket"].to_pylist(), found["section"].to_pylist(), strict=True):
            cells[bucket * len(section) : (bucket + 1) * len(section)] = np.frombuffer(section, np.uint8)
        return cls(cells.view(np.uint64), bits)

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = self._set(keys >> np.uint64(64 - MASK_BITS))
        left = keys[out]
        low = MASK_BITS - self.bits
        out[out] = self._set(left >> np.uint64(64 - self.bits) << np.uint64(low) | left & np.uint64((1 << low) - 1))
        return out


def _keys(codes: np.ndarray, begins: np.ndarray, model: np.uint64) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of all orders at each place of the padded sequences, which places are words, and which have a word of their sequence after them."""
    code, token = padded(codes, begins, ORDER)
    before = np.zeros(len(code), bool)
    before[:-1] = token[1:]
    before[np.cumsum(np.diff(begins) + ORDER - 1)[:-1] - 1] = False
    return chain(code, model, ORDER), token, before


def _cut() -> Column:
    return F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))


def numbers_packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as planes of bytes, the lowest first, as many as the largest takes."""
    x = np.ascontiguousarray(x).astype(np.uint64, copy=False)
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8).T[:width].tobytes() + (len(x).to_bytes(4, "little") if not width else b"")


def numbers_of(raw: bytes) -> np.ndarray:
    width = raw[0]
    if not width:
        return np.zeros(int.from_bytes(raw[1:], "little"), np.uint64)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def signed_packed(x: np.ndarray) -> bytes:
    """Whole numbers of either sign: the sign becomes the lowest bit."""
    return numbers_packed(((x << 1) ^ (x >> 63)).view(np.uint64))


def signed_of(raw: bytes) -> np.ndarray:
    x = numbers_of(raw)
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    """Arrow's form of a schema, also in tasks."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


#: What a task gives for a bucket of trigrams: those of a slice of texts, by their middle words.
TRIGRAMS = "bucket int, m int, pad long, v binary, runs binary, u binary, w binary, c binary"
#: A bucket's pairs v w (n: their count, met: how often they stand), its trigrams seen more than once (at: their pair, of: their context) and
#: the contexts of these (from, to: their words; t: how often a word follows, s1 to s3: trigrams seen once, twice and more often); a1 to a4 and
#: b1 to b4: how many trigrams and pairs have such counts.
STATE = "bucket int, m int, pad long, v binary, runs binary, w binary, n binary, met binary, at binary, of binary, c binary, begin binary, end binary, t binary, s1 binary, s2 binary, s3 binary, a1 long, a2 long, a3 long, a4 long, b1 long, b2 long, b3 long, b4 long"


def trigram_rows(codes: np.ndarray, begins: np.ndarray, model: np.uint64, m: int, buckets: int) -> pa.RecordBatch:
    """TRIGRAMS: the distinct trigrams of the sequences, each with its words and count, dealt out by its middle word."""
    keys, token, _ = _keys(codes, begins, model)
    places = np.flatnonzero(token)
    _, own, c = np.unique(keys[2][places], return_index=True, return_counts=True)
    at = places[own]
    u, v, w = (keys[0][at - k] for k in (2, 1, 0))
    by = np.lexsort((w, v, v % np.uint64(buckets)))
    u, v, w, c = u[by], v[by], w[by], c[by]
    bucket = (v % np.uint64(buckets)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(v)]
    pad = int(mix(np.array([PAD]) * ODD + model)[0].view(np.int64))
    rows: list[list] = [[] for _ in range(5)]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        first = np.flatnonzero(np.r_[True, v[a + 1 : b] != v[a : b - 1]])
        for out, x in zip(rows, (v[a:b][first], np.diff(np.r_[first, b - a]), u[a:b], w[a:b], c[a:b]), strict=True):
            out.append(numbers_packed(x))
    n = len(starts)
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([m] * n, pa.int32()), pa.array([pad] * n, pa.int64()), *(pa.array(x, pa.binary()) for x in rows)], _schema(TRIGRAMS).names)


def _joined(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([numbers_of(x) for x in table[name].to_pylist()])


def _pair_keys(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * ODD + y)


def _state(group: pa.Table) -> pa.Table:
    """STATE of a bucket, from its TRIGRAMS; a row for each model."""
    pa.default_memory_pool().release_unused()
    out = []
    for m in pc.unique(group["m"]).to_pylist():
        mine = group.filter(pc.equal(group["m"], m))
        pad = mine["pad"][0].as_py()
        u, w, times = _joined(mine, "u"), _joined(mine, "w"), _joined(mine, "c").astype(np.int64)
        v = np.repeat(_joined(mine, "v"), _joined(mine, "runs").astype(np.int64))
        _, own, turn = np.unique(_pair_keys(_pair_keys(u, v), w), return_index=True, return_inverse=True)
        c = np.bincount(turn, times).astype(np.int64)
        u, v, w = u[own], v[own], w[own]
        # Pairs, by their first word.
        by = np.lexsort((w, v))
        u, v, w, c = u[by], v[by], w[by], c[by]
        begin = np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])]
        first, pair = np.flatnonzero(begin), np.cumsum(begin) - 1
        met = np.bincount(pair, c).astype(np.int64)
        # Before a sequence's first word nothing stands: what ends with it counts as often as it occurs.
        n = np.where(v[first].view(np.int64) == pad, met, np.bincount(pair))
        runs = np.flatnonzero(np.r_[True, v[first][1:] != v[first][:-1]])
        _, head, context = np.unique(_pair_keys(u, v), return_index=True, return_inverse=True)
        t, s1, s2, s3 = (np.bincount(context, x).astype(np.int64) for x in (c, c == 1, c == 2, c > 2))
        kept = np.flatnonzero(s2 + s3)
        number = np.zeros(len(t), np.int64)
        number[kept] = np.arange(len(kept))
        more = np.flatnonzero(c > 1)
        blobs = [v[first][runs], np.diff(np.r_[runs, len(first)]), w[first], n, met, pair[more], number[context[more]], c[more], u[head[kept]], v[head[kept]], t[kept], s1[kept], s2[kept], s3[kept]]
        counted = [int((x == k).sum()) for x in (c, n) for k in (1, 2, 3, 4)]
        out.append([group["bucket"][0].as_py(), m, pad, *map(numbers_packed, blobs), *counted])
    return pa.table(list(map(list, zip(*out, strict=True))), schema=_schema(STATE))


def _discounts_of(found: list[Row], letter: str) -> dict[int, tuple[float, float, float]]:
    """For each model what is taken from counts of one, two and more, by how many n-grams have counts of one to four."""
    return {r["m"]: discounts(*(r[f"{letter}{k}"] or 0 for k in (1, 2, 3, 4))) for r in found}


def _sums_of(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.r_[0, np.cumsum(runs)[:-1]]) if len(runs) else values[:0]


def word_rows(batch: dict) -> pa.RecordBatch:
    """z, m, bucket, n, t, s1, s2, s3 of the words of a row of STATE: in how many of its pairs each is the last, and what its pairs as a first
    word add up to."""
    runs, n = numbers_of(batch["runs"]).astype(np.int64), numbers_of(batch["n"]).astype(np.int64)
    head = numbers_of(batch["v"])
    w, times = np.unique(numbers_of(batch["w"]), return_counts=True)
    none = np.zeros(len(w), np.int64)
    columns = [np.r_[w, head].view(np.int64), np.full(len(w) + len(head), batch["m"], np.int32), np.full(len(w) + len(head), batch["bucket"], np.int32), np.r_[times, np.zeros(len(head), np.int64)]]
    columns += [np.r_[none, _sums_of(x.astype(np.int64), runs)] for x in (n, n == 1, n == 2, n > 2)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["z", "m", "bucket", "n", "t", "s1", "s2", "s3"])


def _taken(n: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *cut])[np.minimum(n, 3)]


def _left(t: np.ndarray, s1: np.ndarray, s2: np.ndarray, s3: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    """The logarithm of the part of a context that its n-grams leave to lower orders."""
    return np.log((s1 * cut[0] + s2 * cut[1] + s3 * cut[2]) / t)


def _contexts(row: dict, cut: tuple[float, float, float]) -> np.ndarray:
    """What each context of a row of STATE leaves; its trigrams seen once leave all."""
    return _left(*(numbers_of(row[c]).astype(np.float64) for c in ("t", "s1", "s2", "s3")), (1.0, *cut[1:]))


def context_rows(row: dict, cut: tuple[float, float, float], buckets: int) -> pa.RecordBatch:
    """VALUES of the contexts of a row of STATE: each goes to the bucket that has it as a pair."""
    u, v = numbers_of(row["begin"]), numbers_of(row["end"])
    columns = [pa.array((u % np.uint64(buckets)).astype(np.int32)), pa.array(_pair_keys(u, v).view(np.int64)), pa.array(_contexts(row, cut)), pa.array(np.ones(len(u), bool))]
    return pa.RecordBatch.from_arrays(columns, _schema(VALUES).names)


#: What a bucket is to know of others: of a word the logarithm of its chance, of a pair what it leaves as a context.
VALUES = "bucket int, z long, log double, context boolean"
RECORDS = "key long, share int, weight int, size int"


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int32)


def _sizes(n: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log2(np.maximum(n, 1))).astype(np.int32)


def _pair_records(state: pa.Table, values: pa.Table, cut2: dict, cut3: dict) -> pa.Table:
    """RECORDS of a bucket's pairs and trigrams, from its STATE and VALUES."""
    pa.default_memory_pool().release_unused()
    z, log, context = values["z"].to_numpy().view(np.uint64), values["log"].to_numpy(), values["context"].to_numpy()
    by = np.argsort(z)
    z, log, context = z[by], log[by], context[by]
    words, chance = z[~context], log[~context]
    keys, shares, sizes, tops = [], [], [], []
    for row in state.to_pylist():
        runs, w = numbers_of(row["runs"]).astype(np.int64), numbers_of(row["w"])
        n, met = (numbers_of(row[c]).astype(np.int64) for c in ("n", "met"))
        v = np.repeat(numbers_of(row["v"]), runs)
        total = _sums_of(n, runs)
        left = _left(total, *(_sums_of(x.astype(np.int64), runs) for x in (n == 1, n == 2, n > 2)), cut2[row["m"]])
        below = np.repeat(left, runs) + chance[np.searchsorted(words, w)]
        mine = np.log((n - _taken(n, cut2[row["m"]])) / np.repeat(total, runs) + np.exp(below))
        keys.append(_pair_keys(v, w))
        shares.append(_units(mine - below))
        sizes.append(_sizes(np.maximum(n, met)))
        at, of, c = (numbers_of(row[k]).astype(np.int64) for k in ("at", "of", "c"))
        below = _contexts(row, cut3[row["m"]])[of] + mine[at]
        share = np.log((c - _taken(c, cut3[row["m"]])) / numbers_of(row["t"])[of] + np.exp(below)) - below
        begun = _pair_keys(numbers_of(row["begin"]), numbers_of(row["end"]))
        tops.append((_pair_keys(begun[of], w[at]), _units(share), np.zeros(len(c), np.int32), _sizes(c)))
    # What a pair leaves as a context; before a sequence's first word stands a pair that is no n-gram itself.
    key, share, size = map(np.concatenate, (keys, shares, sizes))
    by = np.argsort(key)
    key, share, size, weight = key[by], share[by], size[by], np.zeros(len(key), np.int32)
    begun, gives = z[context], _units(log[context])
    place = np.minimum(np.searchsorted(key, begun), len(key) - 1)
    has = key[place] == begun
    weight[place[has]] = gives[has]
    none = np.zeros((~has).sum(), np.int32)
    parts = [(key, share, weight, size), (begun[~has], none, gives[~has], none), *tops]
    columns = list(map(np.concatenate, zip(*parts, strict=True)))
    return pa.table([columns[0].view(np.int64), *columns[1:]], names=_schema(RECORDS).names)


def count_records(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Sequences]], spelled: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(key, share, weight, size) of all n-grams of the sequences that read(batch) gives for the batches of rows, and for each model the
    logarithm of what the words leave to their spelling. spelled: (z, spelled) for each word. size says how frequent a record is, in
    eighths of a power of two.

    One shuffle deals the trigrams out by their middle word: with it lie all trigrams that end with a pair and all that begin with one."""
    spark = rows.sparkSession
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sequences in read(batch):
                if len(sequences[0]):
                    yield trigram_rows(*sequences, buckets)

    state = staged(rows.mapInArrow(trigrams, TRIGRAMS).groupBy("bucket").applyInArrow(_state, STATE), "pairs")
    counted = state.groupBy("m").agg(*[F.sum(f"{x}{k}").alias(f"{x}{k}") for x in "ab" for k in (1, 2, 3, 4)]).collect()
    cut3, cut2 = _discounts_of(counted, "a"), _discounts_of(counted, "b")
    cuts = lambda cut: F.broadcast(spark.createDataFrame([(m, *d) for m, d in cut.items()], "m int, d1 double, d2 double, d3 double"))

    def each(emit: Callable[[dict], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield emit(batch.slice(i, 1).to_pylist()[0])

        return run

    words = state.select("bucket", "m", "v", "runs", "w", "n").mapInArrow(each(word_rows), "z long, m int, bucket int, n long, t long, s1 long, s2 long, s3 long")
    n = F.col("n")
    one = words.groupBy("z").agg(F.max("m").alias("m"), *[F.sum(c).alias(c) for c in ("t", "s1", "s2", "s3", "n")], F.collect_list(F.when(n > 0, F.col("bucket"))).alias("buckets"))
    one = staged(one, "words")
    of = [F.count_if(n == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    cut1 = cuts(_discounts_of(one.groupBy("m").agg(*of).collect(), "n"))
    roots = one.filter("n > 0").join(cut1, "m").groupBy("m").agg(F.sum("n").alias("total"), F.sum(_cut()).alias("cut")).select("m", "total", F.log(F.col("cut") / F.col("total")).alias("rest")).collect()
    root = F.broadcast(spark.createDataFrame([tuple(r) for r in roots], "m int, total long, rest double"))

    units = lambda c: F.round(c * UNIT).cast("int")
    size = F.floor(8 * F.log2(F.greatest("n", "t", F.lit(1)).cast("double"))).cast("int").alias("size")
    whole = one
    one = one.join(cuts(cut2), "m").withColumn("over", F.when(F.col("t") > 0, F.log((F.col("s1") * F.col("d1") + F.col("s2") * F.col("d2") + F.col("s3") * F.col("d3")) / F.greatest("t", F.lit(1)))).otherwise(0.0)).drop("d1", "d2", "d3")
    one = one.join(spelled, "z", "left").join(root, "m").join(cut1, "m").withColumn("below", F.col("rest") + F.coalesce("spelled", F.lit(-700.0)))
    one = one.withColumn("log", F.when(n > 0, F.log((n - _cut()) / F.col("total") + F.exp("below"))))
    one = staged(one.select(F.col("z").alias("key"), units(F.coalesce(F.col("log") - F.col("below"), F.lit(0.0))).alias("share"), units(F.col("over")).alias("weight"), size, "log", "buckets"), "word-records")
    discard(whole)

    values = one.filter("log is not null").select(F.explode("buckets").alias("bucket"), F.col("key").alias("z"), "log", F.lit(False).alias("context"))
    contexts = state.select("m", "begin", "end", "t", "s1", "s2", "s3").mapInArrow(each(lambda row: context_rows(row, cut3[row["m"]], buckets)), VALUES)
    both = state.groupBy("bucket").cogroup(values.unionAll(contexts).groupBy("bucket"))
    more = staged(both.applyInArrow(lambda a, b: _pair_records(a, b, cut2, cut3), RECORDS), "records")
    discard(state)
    found = one.select("key", "share", "weight", "size").unionAll(more)
    return found.select("key", F.col("share").cast("long").alias("share"), F.col("weight").cast("long").alias("weight"), "size"), {r["m"]: r["rest"] for r in roots}


class Frequent:
    """The records of the most frequent n-grams, and the mask of the others' keys."""

    def __init__(self, keys: np.ndarray, share: np.ndarray, weight: np.ndarray, mask: Mask):
        self.keys, self.share, self.weight, self.mask = HashArray(keys), share, weight, mask

    def __getstate__(self) -> tuple:
        """What is sent; where to look is found again there."""
        return self.keys.keys, self.share, self.weight, self.mask

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def read(self, codes: np.ndarray, begins: np.ndarray, model: np.uint64) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """What the records held add to each sequence, and what to ask the others for: the sequence, the key, as itself, as a context."""
        every, token, before = _keys(codes, begins, model)
        length = np.diff(begins)
        owner = np.repeat(np.arange(len(length)), length + ORDER - 1)
        total = np.zeros(len(token), np.int64)
        asked: list[tuple[np.ndarray, ...]] = []
        known = np.ones(len(token), bool)
        for i, keys in enumerate(every):
            own, context = token, before if i < ORDER - 1 else np.zeros(len(token), bool)
            use = np.flatnonzero((own | context) & known)
            at = self.keys.find(keys[use])
            hit, held = use[at >= 0], at[at >= 0]
            total[hit] += self.share[held] * own[hit] + self.weight[held] * context[hit]
            rest = use[at < 0]
            rest = rest[self.mask.may_hold(keys[rest])]
            asked.append((owner[rest], keys[rest], own[rest], context[rest]))
            # A trigram has a record only where both of its pairs have one.
            found = np.zeros(len(token), bool)
            found[hit] = found[rest] = True
            if i == 1:
                known = found.copy()
                known[1:] &= found[:-1]
        ends = np.concatenate([[0], np.cumsum(length + ORDER - 1)])
        return sums(total, ends).astype(np.int64), tuple(map(np.concatenate, zip(*asked, strict=True)))


#: Records by the first bits of their keys (bits: how many, bucket: which): the steps between the keys' other bits in order, share and weight.
PACKED = "bucket int, bits int, keys binary, share binary, weight binary"
#: Records that a bucket has, about, and those that a task holds before it packs them.
BUCKET, HELD_RECORDS = 1_000_000, 400_000


def _packed_row(bucket: int, bits: int, key: np.ndarray, share: np.ndarray, weight: np.ndarray) -> list:
    return [bucket, bits, numbers_packed(np.diff(key, prepend=key[:0].dtype.type(0))), signed_packed(share), signed_packed(weight)]


def keys_of(raw: bytes) -> np.ndarray:
    return np.cumsum(numbers_of(raw), dtype=np.uint64)


def _packed_table(rows: list[list]) -> pa.Table:
    return pa.table([[r[i] for r in rows] for i in range(5)], schema=_schema(PACKED))


def within(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, by its first bits, and the other bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64), keys & np.uint64((1 << (64 - bits)) - 1)


def pack_records(rest: DataFrame, bits: int) -> DataFrame:
    """PACKED, a row for each bucket, from (key, share, weight)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            key, share, weight = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            by = np.argsort(key)
            bucket, key = within(key[by], bits)
            share, weight = share[by], weight[by]
            ends = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            rows = [_packed_row(i, bits, key[a:b], share[a:b], weight[a:b]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            yield from _packed_table(rows).to_batches()
            pa.default_memory_pool().release_unused()

        n = 0
        for batch in batches:
            held.append([batch.column(0).to_numpy().view(np.uint64).copy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64)])
            n += batch.num_rows
            if n >= HELD_RECORDS:
                yield from out()
                n = 0
        if held:
            yield from out()

    def one(group: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        key, share, weight = (np.concatenate([f(x) for x in group[c].to_pylist()]) for c, f in (("keys", keys_of), ("share", signed_of), ("weight", signed_of)))
        by = np.argsort(key)
        return _packed_table([_packed_row(group["bucket"][0].as_py(), bits, key[by], share[by], weight[by])])

    return staged(rest.mapInArrow(parts, PACKED).groupBy("bucket").applyInArrow(one, PACKED), "rest")


def unpacked_records(packed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key = keys_of(row["keys"]) | np.uint64(row["bucket"] << (64 - row["bits"]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(signed_of(row["share"])), pa.array(signed_of(row["weight"]))], ["key", "share", "weight"])

    return packed.mapInArrow(run, "key long, share long, weight long")


def split_records(records: DataFrame, most: int | None = None) -> tuple[Frequent, DataFrame, int]:
    """The records to broadcast, `most` at the most, all others PACKED, and by how many bits of their keys."""
    most = FREQUENT if most is None else most
    least, others = 0, 0
    for r in records.groupBy("size").count().orderBy(F.desc("size")).collect():
        most -= r["count"]
        if most < 0:
            least = max(least, r["size"] + 1)
            others += r["count"]
    top = records.filter(F.col("size") >= least).select("key", F.col("share").cast("int"), F.col("weight").cast("int")).toArrow()
    bits = max(4, (others // BUCKET).bit_length())
    packed = pack_records(records.filter(F.col("size") < least).select("key", "share", "weight"), bits)
    keys = top["key"].to_numpy().view(np.uint64)
    by = np.argsort(keys)
    return Frequent(keys[by], top["share"].to_numpy()[by], top["weight"].to_numpy()[by], Mask.of(packed, bits)), packed, bits


def frequent_of(records: DataFrame, most: int | None = None) -> tuple[Frequent, DataFrame]:
    """The records to broadcast, `most` at the most, and (key, share, weight) of all others."""
    frequent, packed, _ = split_records(records, most)
    return frequent, unpacked_records(packed)


#: What the texts of a slice ask of a bucket: the next 48 bits of the keys, how many each text asks for, and bits that say whether as an n-gram and as a context.
ASKED = "bucket int, slice long, keys binary, counts binary, flags binary"
_NEXT = np.uint64(16)


def asked_rows(owner: np.ndarray, key: np.ndarray, own: np.ndarray, context: np.ndarray, texts: int, number: int, bits: int) -> pa.RecordBatch:
    """ASKED of a slice of so many texts, from what Frequent.read() leaves open."""
    bucket, rest = within(key, bits)
    by = np.argsort(bucket * texts + owner)
    bucket, owner = bucket[by], owner[by]
    rest, flags = (rest[by] << np.uint64(bits)) >> _NEXT, np.stack([own[by], context[by]])
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(bucket)][: len(starts)]
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    columns = [bucket[starts].astype(np.int32), np.full(len(starts), number, np.int64), [numbers_packed(rest[a:b]) for a, b in spans]]
    columns += [[numbers_packed(np.bincount(owner[a:b], minlength=texts)) for a, b in spans], [np.packbits(flags[:, a:b], axis=1).tobytes() for a, b in spans]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _schema(ASKED).types, strict=True)], schema=_schema(ASKED))


def answers(asked: pa.Table, packed: pa.Table) -> list[bytes]:
    """For each row of ASKED what the records of its bucket add to each of the slice's texts."""
    key = np.concatenate([keys_of(x) << np.uint64(b) for x, b in zip(packed["keys"].to_pylist(), packed["bits"].to_pylist(), strict=True)] or [np.zeros(0, np.uint64)])
    share, weight = (np.concatenate([signed_of(x) for x in packed[c].to_pylist()] or [np.zeros(0, np.int64)]) for c in ("share", "weight"))
    records = HashArray(key >> _NEXT << _NEXT)
    out = []
    for part in asked.select(["keys", "counts", "flags"]).to_batches(max_chunksize=256):
        keys, counts = ([numbers_of(x) for x in c.to_pylist()] for c in part.columns[:2])
        flags = [np.unpackbits(np.frombuffer(x, np.uint8).reshape(2, -1), axis=1, count=len(k)) for x, k in zip(part.column(2).to_pylist(), keys, strict=True)]
        at, (own, context) = records.find(np.concatenate(keys) << _NEXT), np.concatenate(flags, axis=1)
        value = np.zeros(len(at), np.int64)
        hit = np.flatnonzero(at >= 0)
        held = at[hit]
        value[hit] = share[held] * own[hit] + weight[held] * context[hit]
        total = sums(value, np.r_[0, np.cumsum(np.concatenate(counts).astype(np.int64))]).astype(np.int64)
        ends = np.cumsum([len(c) for c in counts])
        out += [signed_packed(total[e - len(c) : e]) for e, c in zip(ends.tolist(), counts, strict=True)]
    return out
