"""Toxicity by class-conditional Kneser-Ney models.

Two models of each class, toxic and ordinary, see a text. One reads its words as byte strings between a start and an end mark: n-grams of
bytes of orders 4 to 6 keep the class's own document counts with three absolute discounts (of counts of 1, 2 and more), which follow from the counts of counts; what a class has seen rarely or never backs off to
orders 1 to 3, whose Kneser-Ney continuation counts (how many different bytes precede) are shared by both classes. The other reads
expressions, words after words: the class's own document counts of word pairs back off to the pairs of both classes together, and these
to how many different words a word follows. Evidence is the difference of the two classes' log-likelihoods. A document's evidence is
length-normalised: the mean over its bytes or its pairs, the strongest word or pair, and the mean of the four strongest; a logistic
curve, fitted on training rows that the counts have not seen, maps these to 0..1. A run of over PIECE bytes without white space counts as
several words, which cover all of its letters and digits.

Learning uses a bounded sample: at most SAMPLE labelled documents of each class and part, the first by the hash of their id; all n-grams
and pairs of the sample are kept. Rows outside the training folds, null labels and null texts are never learned from. Null and empty
texts get the score of a text with no evidence; with no training rows of both classes every score is the share of toxic rows (0 where
there are none). Repeated ids or rows give one row each; if labels repeat an id, its largest label counts. A carried column named score
gives way to the result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, crc_mod, named, table, unpacked
from .hash_array import HashArray
from .ngram_tables import discounts, word_codes
from .shingles import mix
from .word_index import Growing, WordIndex, split_words, sums
from .word_table import grouped_counts, per_group_sample

#: Documents learned from, of each class: in the counts and in the fit of the curve; words whose evidence is computed together, and held.
SAMPLE, CHUNK, HELD = 1500, 8192, 300_000
#: Bytes of texts that a worker reads at once.
SLICE = 1_000_000
#: Order of the class models, and highest order of the shared ones.
ORDER, SHARED = 6, 3
#: Words or pairs whose mean evidence counts beside the whole text's.
STRONGEST = 4
THRESHOLD = 0.3
EDGE = b".,;:!?\"'()[]*$%&#|-"
#: Bytes of a word; longer runs without white space are cut into pieces, which are all counted and scored.
PIECE = 48
_SIGNS = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def discounts_of(c: np.ndarray) -> np.ndarray:
    """For each column of counts the discounts of counts of 0 (none), 1, 2, and more, from how many counts of one to four it has."""
    return np.array([[0.0, *discounts(*(int((x == n).sum()) for n in (1, 2, 3, 4)))] for x in c.T], np.float32)


def discount(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What is taken from counts (rows, columns), d having a row for each column."""
    return d[np.arange(c.shape[1]), np.minimum(c, 3).astype(np.int64)]


def pieces(word: bytes) -> list[bytes]:
    """The bare word. One of over PIECE bytes is cut at ASCII signs, and what is still longer into pieces that overlap by ORDER - 1, so
    that every n-gram lies in one of them."""
    core = word.strip(EDGE)
    if len(core) <= PIECE:
        return [core]
    return [r[i : i + PIECE] for r in core.translate(_SIGNS).split() for i in range(0, max(1, len(r) - ORDER + 1), PIECE - ORDER + 1)]


def bare_codes(words: pa.Array) -> np.ndarray:
    """A hash of 64 bits of each bare word."""
    return word_codes(pc.ascii_trim(words, EDGE.decode()))


def pair_codes(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of neighbouring words of one text: the pair's code, both words' codes, and where each text's pairs begin."""
    inside = np.ones(max(0, len(codes) - 1), bool)
    cuts = begins[1:-1]
    inside[cuts[(cuts > 0) & (cuts < len(codes))] - 1] = False
    left, right = codes[:-1][inside], codes[1:][inside]
    bounds = np.concatenate([[0], np.cumsum(np.maximum(np.diff(begins) - 1, 0))])
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right), left, right, bounds


def hashed(keys: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64))


def ngram_keys(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each byte of each marked word, whether the n-gram lies in its word, and the word of each byte."""
    joined = b"".join(b"\x02" + w + b"\x03" for w in words)
    raw = np.frombuffer(joined, np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    key = np.zeros(len(raw), np.int64)
    for k in range(n):
        key[k:] |= raw[: len(raw) - k] << (8 * k) if k else raw
    inside = np.zeros(len(raw), bool)
    if len(raw) >= n:
        inside[n - 1 :] = word[n - 1 :] == word[: len(raw) - n + 1]
    return key | (n << 56), inside, word


def word_counts(texts: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """The texts' distinct words (pieces of long runs), and in how many texts each occurs."""
    words, begins = split_words(texts)
    encoded = words.dictionary_encode()
    known = encoded.dictionary.cast(pa.binary()).to_pylist()
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    own = [sorted(set(pieces(w))) for w in known]
    names = pa.array([p for ps in own for p in ps], pa.binary()).dictionary_encode()
    first = np.concatenate([[0], np.cumsum(list(map(len, own)), dtype=np.int64)])
    met = np.unique(owner * max(1, len(known)) + encoded.indices.to_numpy())
    text, word = met // max(1, len(known)), met % max(1, len(known))
    size = np.diff(first)[word]
    at = np.repeat(first[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    number = names.indices.to_numpy()[at]
    met = np.unique(np.repeat(text, size) * max(1, len(names.dictionary)) + number)  # "x," and "x" are one word of a text
    n = np.bincount(met % max(1, len(names.dictionary)), minlength=len(names.dictionary))
    return [names.dictionary], n


def pair_counts(texts: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """The texts' distinct word pairs, and in how many texts each occurs."""
    words, begins = split_words(texts)
    encoded = words.dictionary_encode()
    codes = bare_codes(encoded.dictionary)
    code, left, right, bounds = pair_codes(codes[encoded.indices.to_numpy()] if len(codes) else codes, begins)
    distinct, first, number = np.unique(code, return_index=True, return_inverse=True)
    met = np.unique(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * max(1, len(distinct)) + number)
    n = np.bincount(met % max(1, len(distinct)), minlength=len(distinct))
    return [pa.array(x.view(np.int64)) for x in (distinct, left[first], right[first])], n


class KneserNey:
    """evidence(words): log-likelihood under the toxic model less that under the ordinary one, and the words' lengths."""

    def __init__(self, keys: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray):
        self.tables: dict[int, tuple] = {}
        self.cut: dict[int, np.ndarray] = {}
        order = np.argsort(keys)
        keys, both = keys[order], np.stack([ordinary[order], toxic[order]], 1).astype(np.float32)
        length = keys >> 56
        for n in range(1, ORDER + 1):
            own, c = keys[length == n], both[length == n]
            if n <= SHARED:
                # Continuations: different bytes before the n-gram, over both classes.
                longer = keys[length == n + 1] & ((1 << (8 * n)) - 1) | (n << 56)
                own, kinds = np.unique(longer, return_counts=True)
                c = np.repeat(kinds[:, None].astype(np.float32), 2, 1)
            # Keys are held by their hashes, which are spread evenly.
            context = hashed((own & ((1 << 56) - 1)) >> 8 | (n << 56))
            order = np.argsort(hashed(own))
            own, c, context = hashed(own)[order], c[order], context[order]
            head, at = np.unique(context, return_inverse=True)
            total, given = np.zeros((len(head), 2)), np.zeros((len(head), 2))
            np.add.at(total, at, c)
            self.cut[n] = discounts_of(c)
            np.add.at(given, at, discount(c, self.cut[n]))
            self.tables[n] = HashArray(own), c.astype(np.float32), HashArray(head), total.astype(np.float32), given.astype(np.float32)

    def probabilities(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte of the marked words its probability in both classes, and its word."""
        joined = b"".join(b"\x02" + w + b"\x03" for w in words)
        raw = np.frombuffer(joined, np.uint8).astype(np.int64)
        size = np.array([len(w) + 2 for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        p = np.full((len(raw), 2), 1 / 256)
        key = np.zeros(len(raw), np.int64)
        for n in range(1, ORDER + 1):
            key[n - 1 :] |= raw[: len(raw) - n + 1] << (8 * (n - 1))
            at = np.flatnonzero(place >= n - 1)  # those that lie in their word
            own, c, head, total, given = self.tables[n]
            if not len(own.keys):
                continue
            h = head.find(hashed(key[at] >> 8 | (n << 56)))
            at, h = at[h >= 0], h[h >= 0]
            g = own.find(hashed(key[at] | (n << 56)))
            count = np.where((g >= 0)[:, None], c[g], np.float32(0))
            t = total[h]
            known = t > 0
            t = np.maximum(t, 1)
            q = (count - discount(count, self.cut[n])) / t + given[h] / t * p[at]
            p[at] = np.where(known, q, p[at])
        return p, word

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Of each word its log-likelihood in the toxic class less that in the ordinary one, and its bytes with the end mark."""
        return np.concatenate([self._evidence(words[s : s + CHUNK]) for s in range(0, len(words), CHUNK)] or [np.zeros((0, 2), np.float32)])

    def _evidence(self, words: list[bytes]) -> np.ndarray:
        p, word = self.probabilities(words)
        first = np.zeros(len(p), bool)
        first[np.cumsum([0] + [len(w) + 2 for w in words[:-1]])] = True
        gain = np.log(p[:, 1]) - np.log(p[:, 0])
        gain[first] = 0  # the start mark
        out = np.zeros((len(words), 2), np.float32)
        out[:, 0] = np.bincount(word, gain, len(words))
        out[:, 1] = [len(w) + 1 for w in words]
        return out


class PairKneserNey:
    """gain(pairs): log-likelihood of a word after another under the toxic model less that under the ordinary one."""

    def __init__(self, pair: np.ndarray, left: np.ndarray, right: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray):
        order = np.argsort(pair)
        self.pair, left, right = pair[order], left[order], right[order]
        own = np.stack([ordinary[order], toxic[order]], 1).astype(np.float32)
        self.count = np.c_[own, own.sum(1)].astype(np.float32)  # the classes, and both together
        self.head, at = np.unique(left, return_inverse=True)
        self.total, self.given = np.zeros((len(self.head), 3), np.float32), np.zeros((len(self.head), 3), np.float32)
        np.add.at(self.total, at, self.count)
        self.cut = discounts_of(self.count)
        np.add.at(self.given, at, discount(self.count, self.cut))
        self.word, self.follows = np.unique(right, return_counts=True)
        self.floor = 1.0 / (len(self.pair) + len(self.word) + 1)
        self.pair, self.head, self.word = map(HashArray, (self.pair, self.head, self.word))

    def gain(self, pair: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pair))
        h = self.head.find(left)
        some = np.flatnonzero(h >= 0)  # after a word that no class has seen both models say the same
        if not len(some):
            return out
        h, p, w = h[some], self.pair.find(pair[some]), self.word.find(right[some])
        count = np.where((p >= 0)[:, None], self.count[p], 0.0)
        total, given = self.total[h], self.given[h]
        low = np.where(w >= 0, self.follows[w] + 1.0, 1.0) * self.floor
        kept = count - discount(count, self.cut)
        shared = (kept[:, 2] + given[:, 2] * low) / total[:, 2]
        own = (kept[:, :2] + given[:, :2] * shared[:, None]) / np.maximum(total[:, :2], 1)
        own = np.where(total[:, :2] > 0, own, shared[:, None])
        out[some] = np.log(own[:, 1]) - np.log(own[:, 0])
        return out


def strongest(values: np.ndarray) -> list[float]:
    """The greatest value, and the mean of the STRONGEST greatest (missing ones are 0)."""
    if not len(values):
        return [0.0, 0.0]
    top = np.partition(values, -STRONGEST)[-STRONGEST:] if len(values) > STRONGEST else values
    return [float(top.max()), float(np.sort(top)[::-1].sum(dtype=np.float64) / STRONGEST)]


class Evidence:
    """A worker's evidence of words and pairs; features(texts) has a row of six numbers for each text."""

    def __init__(self, words: KneserNey, pairs: PairKneserNey):
        self.words, self.pairs = words, pairs
        self.index = WordIndex(HELD)
        self.values, self.code, self.long = Growing(np.float32, 2), Growing(np.uint64), Growing(bool)
        self.parts: dict[int, np.ndarray] = {}  # of long runs the evidence of each piece

    def _learn(self, new: pa.Array, first: int) -> None:
        words = new.cast(pa.binary()).to_pylist()
        cut = [pieces(w) for w in words]
        begins = np.concatenate([[0], np.cumsum(list(map(len, cut)), dtype=np.int64)])
        found = self.words.evidence([p for ps in cut for p in ps])
        several = np.diff(begins) > 1
        for i in np.flatnonzero(several).tolist():
            self.parts[first + i] = found[begins[i] : begins[i + 1], 0]
        self.values.extend(sums(found, begins).astype(np.float32))
        self.code.extend(bare_codes(new))
        self.long.extend(several)

    def features(self, texts: pa.Array) -> np.ndarray:
        if self.index.full():
            self.index.clear()
            self.parts.clear()
            for held in (self.values, self.code, self.long):
                held.clear()
        words, begins = split_words(texts)
        at = self.index.rows(words, self._learn)
        value, long = self.values.values[at], self.long.values[at]
        pair, left, right, bounds = pair_codes(self.code.values[at], begins)
        gain = self.pairs.gain(pair, left, right)
        out = np.zeros((len(texts), 6))
        total = sums(value, begins)
        out[:, 0] = total[:, 0] / np.maximum(total[:, 1], 1)
        out[:, 3] = sums(gain, bounds) / np.maximum(np.diff(bounds), 1)
        mixed = np.zeros(len(texts), bool)
        mixed[np.searchsorted(begins, np.flatnonzero(long), "right") - 1] = True
        for i in range(len(texts)):
            a, b = begins[i], begins[i + 1]
            e = value[a:b, 0]
            if mixed[i]:
                e = np.concatenate([e[~long[a:b]], *(self.parts[k] for k in at[a:b][long[a:b]].tolist())])
            out[i, 1:3], out[i, 4:6] = strongest(e), strongest(gain[bounds[i] : bounds[i + 1]])
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method; rows of both classes count as they occur."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * np.r_[w[:-1], 0]
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge] * (len(w) - 1) + [1e-9])
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


class ToxicityModel:
    """words and pairs: the Kneser-Ney models, or None; curve: the logistic curve, or None; base: the score without them."""

    def __init__(self, words: KneserNey | None, pairs: PairKneserNey | None, curve: tuple | None, base: float):
        self.words, self.pairs, self.curve, self.base = words, pairs, curve, base

    def evidence(self) -> Evidence | None:
        return Evidence(self.words, self.pairs) if self.words is not None and self.pairs is not None else None

    def scores(self, evidence: Evidence | None, texts: pa.Array) -> np.ndarray:
        if evidence is None or self.curve is None:
            return np.full(len(texts), self.base)
        w, mean, scale = self.curve
        z = np.clip(np.c_[(evidence.features(texts) - mean) / scale, np.ones(len(texts))] @ w, -30, 30)
        return 1 / (1 + np.exp(-z))


def by_class(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, ordinary, toxic) from (group, *keys, n)."""
    of = lambda k: F.sum(F.when(F.col("group") == k, F.col("n")).otherwise(0))
    return counted.groupBy(*keys).agg(of(0).alias("ordinary"), of(1).alias("toxic"))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from labelled rows whose fold (crc32 of the id as text, mod 4) is 0 or 1 (counts) and 3 (curve)."""
    spark = docs.sparkSession
    marked = labels.select(named(id_col).alias("id"), named(label_col).alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    marked = marked.groupBy("id").agg(F.max("label").cast("int").alias("label"))
    marked = marked.withColumn("fold", crc_mod("id", 4)).filter("fold <> 2").withColumn("part", F.when(F.col("fold") == 3, 2).otherwise(0) + F.col("label"))
    chosen = per_group_sample(marked.select("id", "part"), "part", "id", sample)
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(chosen), "id")  # SAMPLE rows a part at most
    shares = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    base = shares.get(1, 0) / max(1, sum(shares.values()))

    counted_rows = rows.filter("part < 2").dropDuplicates(["part", "text"])  # copies count once
    words = grouped_counts(counted_rows, "part", "text", word_counts, "word binary")

    def grams(batches):
        for batch in batches:
            part, ws, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for k in range(1, ORDER + 1):
                key, inside, word = ngram_keys(ws, k)
                key, count, kind = key[inside], n[word[inside]], part[word[inside]]
                for g in (0, 1):
                    uniq, at = np.unique(key[kind == g], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uniq), g)), pa.array(uniq), pa.array(np.bincount(at, count[kind == g], len(uniq)).astype(np.int64))], ["group", "key", "n"])

    kept = by_class(words.mapInArrow(grams, "group long, key long, n long"), ["key"]).toArrow()
    if not kept.num_rows or not sum(kept["toxic"].to_numpy()) or not sum(kept["ordinary"].to_numpy()):
        return ToxicityModel(None, None, None, base)
    language = KneserNey(*(kept[c].to_numpy().astype(np.int64) for c in ("key", "ordinary", "toxic")))
    seen = by_class(grouped_counts(counted_rows, "part", "text", pair_counts, "pair long, left long, right long"), ["pair", "left", "right"]).toArrow()
    if not seen.num_rows:  # texts of one word: a pair that no text has
        seen = pa.table({c: pa.array([0], pa.int64()) for c in ("pair", "left", "right", "ordinary", "toxic")})
    pairs = PairKneserNey(*(seen[c].to_numpy().view(np.uint64) for c in ("pair", "left", "right")), seen["ordinary"].to_numpy(), seen["toxic"].to_numpy())
    held = spark.sparkContext.broadcast(ToxicityModel(language, pairs, None, base))

    def make():
        evidence = held.value.evidence()
        return lambda texts: [pa.array(c) for c in evidence.features(texts).T]

    names = list("abcdef")
    got = attach(rows.filter("part >= 2"), ["part"], "text", make, ", ".join(f"{c} double" for c in names), SLICE).select("row.part", *names).toArrow()
    y = (got["part"].to_numpy() == 3).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(language, pairs, None, base)
    return ToxicityModel(language, pairs, fit_logistic(np.stack([got[c].to_numpy() for c in names], 1), y), base)


def scored_rows(docs: DataFrame, model: ToxicityModel, columns: list[str], text_col: str = "text") -> DataFrame:
    """(row, score): row is a struct of `columns`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        evidence = m.evidence()
        return lambda texts: [pa.array(m.scores(evidence, texts))]

    return attach(docs, columns, text_col, make, "score double", SLICE)


def score_toxicity(docs: DataFrame, model: ToxicityModel, columns: list[str], text_col: str = "text") -> DataFrame:
    """`columns` and score: the probability that the text is toxic."""
    return unpacked(scored_rows(docs, model, columns, text_col), columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
