"""Language-model scoring by a hidden Markov model over words.

Words are counted over all training documents by Spark; the counts stay a distributed table. The model's symbols are the TOP most
frequent words and, for all others, SHAPES classes by the end of the word, so that a word's probability is that of its symbol given the
latent state, times the word's smoothed share of its class: (count + 0.1) / (class tokens + 0.1 (class words + 1)), where the 1 stands
for unseen words. Baum-Welch runs as Spark jobs: each task adds up expected counts over its texts, Spark sums them over the
partitions, and the driver holds the bounded tables of STATES x symbols. Each of the ROUNDS rounds sees all training documents whole.
Scoring runs the scaled forward recursion over each whole text, which gives the exact likelihood. In both, a text of over LONG tokens is
run as segments side by side, tied by the messages that pass between them: each segment's operator (where each state leads to) gives the
message that enters it and the one that comes back, so that the sums are those of the whole text. The counts of the KNOWN most frequent
words are broadcast (a fixed bound); all other words of a text get theirs by a join.

Null and empty texts are the end token alone. Each row is scored for itself, repeated or null ids included; rows whose id is null belong
to no training fold. With no training rows every probability is that of an empty count table. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hash_share, staged, table
from .word_index import Growing, WordIndex, byte_slices, split_words, sums

STATES, TOP, SHAPES, KNOWN = 8, 4096, 1024, 150_000
#: Rounds of Baum-Welch, each over all training documents.
ROUNDS = 8
#: Tokens of a text that is run as segments, of a segment, and of all that runs together; steps between two scalings.
LONG, SEGMENT, TOGETHER, RESCALE = 16_384, 512, 2_097_152, 8
ADD = 0.1
#: Stands for the end of a text in the count table; white space can't occur in a word.
END = b"\n"
#: Distinct words that a counting task holds, and bytes of texts read at once.
HELD, SLICE = 400_000, 8_000_000


def shape(word: bytes) -> int:
    """Class of a word outside TOP, by its last bytes."""
    return zlib.crc32(word[-3:]) % SHAPES


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over all rows of (text), with END for each text: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, texts = WordIndex(HELD), Growing(np.int64), 0

        def out(more: list[bytes], n: list[int]) -> pa.RecordBatch:
            counts = np.concatenate([total.values[: total.size], np.array(n, np.int64)])
            made = pa.RecordBatch.from_arrays([pa.array([*words.index, *more], pa.binary()), pa.array(counts)], ["word", "n"])
            words.clear()
            total.clear()
            return made

        for batch in batches:
            column = batch.column(0)
            texts += len(column)
            for a, b in byte_slices(column, SLICE):
                at = words.rows(split_words(column.slice(a, b - a))[0], lambda new, _: total.extend(np.zeros(len(new), np.int64)))
                total.values[: total.size] += np.bincount(at, minlength=total.size)
                if words.full():
                    yield out([], [])
        if texts:
            yield out([END], [texts])

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The most frequent words with their counts, and each class's tokens and words."""

    def __init__(self, words: list[bytes], counts: list[int], tokens: int, kinds: int, shape_tokens: np.ndarray, shape_kinds: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.tokens, self.kinds, self.shape_tokens, self.shape_kinds = tokens, kinds, shape_tokens, shape_kinds
        # The last place stands for words that are not among them.
        self.symbol = np.array([*(i if i < TOP else TOP + shape(w) for i, w in enumerate(words)), 0], np.int32)
        self.base, self.inner = self.logs(np.array([*counts, 0], np.float64), np.where(self.symbol < TOP, -1, self.symbol - TOP))
        self.base[-1] = self.inner[-1] = 0.0

    def logs(self, counts: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each word's base probability, and of its share of its class (0 for class -1, a word that is a symbol)."""
        base = np.log10((counts + ADD) / (self.tokens + ADD * (self.kinds + 1)))
        inner = np.log10((counts + ADD) / (self.shape_tokens[cls] + ADD * (self.shape_kinds[cls] + 1)))
        return base, np.where(cls < 0, 0.0, inner)

    def end(self) -> tuple[int, float, float, bool]:
        """Symbol, base and inner logarithm of the end token, and whether training texts have it."""
        i = self.index.get(END)
        if i is not None:
            return int(self.symbol[i]), float(self.base[i]), float(self.inner[i]), True
        base, inner = self.logs(np.zeros(1), np.array([shape(END)]))
        return TOP + shape(END), float(base[0]), float(inner[0]), False


class Reader:
    """A worker's words as rows of the lexicon and as symbols."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.words = WordIndex()
        self.known, self.symbol = Growing(np.int64), Growing(np.int16)
        self.end = lexicon.end()

    def _learn(self, new: pa.Array, _first: int) -> None:
        words = new.cast(pa.binary()).to_pylist()
        at = np.array([self.lexicon.index.get(w, -1) for w in words], np.int64)
        symbols = self.lexicon.symbol[at].astype(np.int16)
        rare = np.flatnonzero(at < 0)
        symbols[rare] = [TOP + shape(words[i]) for i in rare]
        self.known.extend(at)
        self.symbol.extend(symbols)

    def read(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words, their numbers in this worker, and where each text's words begin."""
        if self.words.full():
            self.words.clear()
            self.known.clear()
            self.symbol.clear()
        words, begins = split_words(texts)
        return words, self.words.rows(words, self._learn), begins

    def symbols(self, rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, each closed by the end token, and where each text's begin."""
        n = len(begins) - 1
        bounds = begins + np.arange(n + 1)
        out = np.empty(bounds[-1], np.int16)
        ends = bounds[1:] - 1
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside], out[ends] = self.symbol.values[rows], self.end[0]
        return out, bounds


class Packed:
    """Sequences side by side, the longest first: step t holds the symbols of the n[t] sequences that reach it, one step after the other."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array(list(map(len, sequences)))
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.n = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        begin = np.concatenate([[0], np.cumsum(self.n)])
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.x = np.empty(len(step), np.int64)
        self.x[begin[step] + np.repeat(np.arange(len(lengths)), lengths)] = np.concatenate([sequences[i] for i in self.order])

    def steps(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each step how many sequences reach it, how many go on, and the first ones' symbols."""
        n = [*self.n.tolist(), 0]
        at = 0
        for t in range(len(n) - 1):
            yield n[t], n[t + 1], self.x[at : at + n[t]]
            at += n[t]

    def forward(self, table_: np.ndarray, first: np.ndarray, move: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """The message at each sequence's end, the logarithm (base 10) of what was scaled away from it, and what was at each step of that.
        keep is filled with the messages at all places. Messages and table_ have a row for each state."""
        ends, logs, scales = np.empty_like(first), np.zeros(first.shape[1]), {}
        onward = np.ascontiguousarray(move.T)
        now = first
        at = 0
        for t, (n, rest, x) in enumerate(self.steps()):
            if t:
                now = onward @ now[:, :n]
                now *= table_.take(x, 1)
                if t % RESCALE == 0:
                    scales[t] = c = now.sum(0)
                    now /= c
                    logs[:n] += np.log10(c)
            else:
                now = first * table_.take(x, 1)
            if keep is not None:
                keep[:, at : at + n] = now
                at += n
            if rest < n:
                ends[:, rest:n] = now[:, rest:]
        return ends, logs, scales

    def backward(self, table_: np.ndarray, last: np.ndarray, move: np.ndarray, alpha: np.ndarray, scales: dict[int, np.ndarray], moves: np.ndarray) -> np.ndarray:
        """Turns alpha, the messages of forward, into each place's share of the states; adds to moves (not yet times move) those between
        steps. Returns the first step's backward message times its symbols' probabilities."""
        beta = last.copy()
        end = len(self.x)
        w = beta
        for t in range(len(self.n) - 1, -1, -1):
            n = int(self.n[t])
            here, b = alpha[:, end - n : end], beta[:, :n]
            gamma = here * b
            total = gamma.sum(0)
            w = table_.take(self.x[end - n : end], 1)
            w *= b
            if t:
                # alpha one step before, times moves and w, sums to total * scale
                start = end - n - int(self.n[t - 1])
                moves += alpha[:, start : start + n] @ (w / (total * scales[t] if t in scales else total)).T
                b = move @ w
                if t % RESCALE == 0:
                    b /= b.sum(0)
                beta[:, :n] = b
            np.divide(gamma, total, out=here)
            end -= n
        return w


def together(sizes: list[int], most: int = TOGETHER) -> Iterator[list[int]]:
    """Numbers of sequences in groups of like length and of about `most` tokens."""
    group, total = [], 0
    for i in sorted((i for i, s in enumerate(sizes) if s), key=lambda i: sizes[i]):
        if group and total + sizes[i] > most:
            yield group
            group, total = [], 0
        group.append(i)
        total += sizes[i]
    if group:
        yield group


class HiddenMarkov:
    """start (S), move (S, S) and emit (S, symbols)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, frequency: np.ndarray) -> HiddenMarkov:
        """Slow moves between states, and each state's symbols drawn about the overall frequencies."""
        rng = np.random.default_rng(7)
        emit = frequency * rng.gamma(2.0, 0.5, (STATES, len(frequency)))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """By state, of each symbol its probability over the greatest, so that messages need scaling only now and then; and the greatest."""
        top = self.emit.max(0)
        return np.ascontiguousarray(self.emit / top), np.log10(top)

    def _operators(self, table_: np.ndarray, segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment where each state before its first symbol leads to, and the logarithm of the scale."""
        out, scale = np.empty((len(segments), STATES, STATES)), np.empty(len(segments))
        for group in together([STATES * len(s) for s in segments]):
            p = Packed([segments[i] for i in group for _ in range(STATES)])
            eye = np.tile(np.eye(STATES), len(group))[:, p.order]
            ends, logs, _ = p.forward(table_, eye, self.move)
            total = ends.sum(0)
            logs = logs + np.log10(total)
            back = np.argsort(p.order)
            logs, ends = logs[back].reshape(-1, STATES), (ends / total).T[back].reshape(-1, STATES, STATES)
            top = logs.max(1)
            out[group], scale[group] = 10 ** (logs - top[:, None])[:, :, None] * ends, top
        return out, scale

    @staticmethod
    def _segments(s: np.ndarray) -> list[np.ndarray]:
        return [s[p : p + SEGMENT] for p in range(0, len(s), SEGMENT)]

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts over whole sequences: messages in single precision, sums in double; sequences that run together and leave the
        range of single precision are run again in double."""
        sums_ = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, self.emit.shape[1]))
        table_, _ = self._table()
        # What runs side by side: symbols, the message before the first of them (None at a text's start) and after the last.
        parts: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]] = []
        one = np.ones(STATES)
        for s in sequences:
            if len(s) <= LONG:
                parts.append((s, None, one))
                continue
            segments = self._segments(s)
            ops, _ = self._operators(table_, segments)
            enter: list[np.ndarray | None] = [None]
            for k, op in enumerate(ops[:-1]):
                v = (self.start if k == 0 else enter[k] @ self.move) @ op
                enter.append(v / v.sum())
            leave = [one]
            for op in ops[:0:-1]:
                v = self.move @ (op @ leave[-1])
                leave.append(v / v.sum())
            parts += zip(segments, enter, leave[::-1], strict=True)
        for group in together([len(s) for s, _, _ in parts]):
            for kind in (np.float32, np.float64):
                with np.errstate(all="ignore"):
                    found = self._counts([parts[i] for i in group], table_.astype(kind))
                if all(np.isfinite(x).all() for x in found):
                    break
            for total, x in zip(sums_, found, strict=True):
                total += x
        return sums_[0], sums_[1] * self.move, sums_[2]

    def _counts(self, parts: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]], table_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of starts, moves (not yet times move) and symbols of sequences that run together."""
        kind = table_.dtype
        p = Packed([s for s, _, _ in parts])
        parts = [parts[i] for i in p.order]
        fresh = np.array([v is None for _, v, _ in parts])
        enter = np.array([np.ones(STATES) if v is None else v for _, v, _ in parts])
        first = np.where(fresh[:, None], self.start, enter @ self.move).T.astype(kind)
        move, moves = self.move.astype(kind), np.zeros((STATES, STATES))
        alpha = np.empty((STATES, len(p.x)), kind)
        _, _, scales = p.forward(table_, first, move, alpha)
        w = p.backward(table_, np.array([v for _, _, v in parts]).T.astype(kind), move, alpha, scales, moves)
        if not fresh.all():  # moves across cuts, from the messages that enter
            source, w = enter[~fresh], w.T[~fresh]
            moves += source.T @ (w / (source @ self.move * w).sum(1)[:, None])
        start = alpha[:, : p.n[0]][:, fresh].sum(1, dtype=np.float64)
        return start, moves, np.stack([np.bincount(p.x, alpha[k], self.emit.shape[1]) for k in range(STATES)])

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The log10 likelihood of each sequence, by the scaled forward recursion."""
        table_, tops = self._table()
        out = np.array([tops[s].sum() for s in sequences])
        for group in together([len(s) if len(s) <= LONG else 0 for s in sequences]):
            p = Packed([sequences[i] for i in group])
            ends, logs, _ = p.forward(table_, np.tile(self.start[:, None], len(group)), self.move)
            out[np.array(group)[p.order]] += logs + np.log10(ends.sum(0))
        for i, s in enumerate(sequences):
            if len(s) > LONG:
                v = None
                for op, scale in zip(*self._operators(table_, self._segments(s)), strict=True):
                    v = (self.start if v is None else v @ self.move) @ op
                    out[i] += scale + np.log10(v.sum())
                    v = v / v.sum()
        return out


def most_frequent(counts: DataFrame, most: int | None = None) -> DataFrame:
    """The end token and the most frequent words, about `most` at the most: by a histogram of the counts, eight steps to each
    doubling, so that no task has to gather candidates of all others. Of the step that doesn't fit whole, the first words by hash."""
    most = KNOWN if most is None else most
    step = F.floor(F.log2("n") * 8).cast("int")
    room, last, share = most, None, 1.0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        last, share = r["step"], room / r["count"]
        room -= r["count"]
        if room <= 0:
            break
    if last is None:
        return counts.limit(0)
    counts = counts.withColumn("_step", step)
    chosen = (F.col("_step") > last) | ((F.col("_step") == last) & (F.lit(share >= 1) | (hash_share("word") < share)))
    return counts.filter(chosen | (F.col("word") == F.lit(END))).drop("_step")


class Trained:
    def __init__(self, lexicon: Lexicon, model: HiddenMarkov, counts: DataFrame):
        self.lexicon, self.model, self.counts = lexicon, model, counts


def train_hmm(rows: DataFrame) -> Trained:
    """Learn from all rows of (text)."""
    spark = rows.sparkSession
    counts = staged(count_words(rows), "word-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts).toArrow()
    words, n = top["word"].to_pylist(), top["n"].to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], [n[i] for i in order]
    frequent = spark.sparkContext.broadcast(set(words[:TOP]))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
        for batch in batches:
            ws, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            rare = [i for i, w in enumerate(ws) if w not in frequent.value]
            at = np.array([shape(ws[i]) for i in rare], np.int64)
            tokens += np.bincount(at, c[rare], SHAPES)
            kinds += np.bincount(at, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(tokens), pa.array(kinds)], ["shape", "tokens", "kinds"])

    by_shape = counts.mapInArrow(shapes, "shape long, tokens double, kinds double").groupBy("shape").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).toArrow()
    shape_tokens, shape_kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    shape_tokens[by_shape["shape"].to_numpy()] = by_shape["tokens"].to_numpy()
    shape_kinds[by_shape["shape"].to_numpy()] = by_shape["kinds"].to_numpy()
    lexicon = Lexicon(words, n, total["n"] or 0, total["v"] or 0, shape_tokens, shape_kinds)

    frequency = np.full(TOP + SHAPES, ADD)
    frequency[: min(TOP, len(n))] += n[:TOP]
    frequency[TOP:] += shape_tokens
    model = HiddenMarkov.first(frequency / frequency.sum())
    if not words:
        return Trained(lexicon, model, counts)

    held = spark.sparkContext.broadcast(lexicon)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for batch in batches:
            column = batch.column(0)
            for a, b in byte_slices(column, SLICE):
                _, at, begins = reader.read(column.slice(a, b - a))
                symbols, bounds = reader.symbols(at, begins)
                made = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((2 * bounds).astype(np.int64)), pa.py_buffer(symbols)])
                yield pa.RecordBatch.from_arrays([made.cast(pa.binary())], ["symbols"])

    encoded = staged(rows.mapInArrow(encode, "symbols binary"), "symbols")
    for _ in range(ROUNDS):
        model = baum_welch(encoded, model, frequency)
    return Trained(lexicon, model, counts)


def baum_welch(encoded: DataFrame, model: HiddenMarkov, frequency: np.ndarray) -> HiddenMarkov:
    """One round: expected counts of each task, summed over the partitions."""
    held = encoded.sparkSession.sparkContext.broadcast(model)
    size = len(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_: tuple | None = None
        for batch in batches:
            got = held.value.expected([np.frombuffer(raw, np.int16) for raw in batch.column(0).to_pylist()])
            sums_ = got if sums_ is None else tuple(x + y for x, y in zip(sums_, got, strict=True))
        if sums_ is not None:
            flat = np.concatenate([x.ravel() for x in sums_])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "value"])

    got = encoded.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(STATES + STATES * STATES + STATES * size)
    flat[got["at"].to_numpy()] = got["value"].to_numpy()
    if not flat.any():
        return model
    start, move, emit = np.split(flat, [STATES, STATES + STATES * STATES])
    start, move, emit = start + 0.1, move.reshape(STATES, STATES) + 0.1, emit.reshape(STATES, size)
    emit = emit + 0.01 * size * frequency / frequency.sum()  # no symbol is impossible in any state
    return HiddenMarkov(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def score_texts(docs: DataFrame, trained: Trained, columns: list[str], text_col: str = "text") -> DataFrame:
    """`columns` and n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((trained.lexicon, trained.model))
    lexicon = trained.lexicon
    names = [f"_c{i}" for i in range(len(columns))]
    kinds = [docs.schema[c].dataType.simpleString() for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = held.value
        reader = Reader(lex)
        _, end_base, end_inner, end_known = reader.end
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            cells = len(names)
            for a, b in byte_slices(batch.column(cells), SLICE):
                words, at, begins = reader.read(batch.column(cells).slice(a, b - a))
                symbols, bounds = reader.symbols(at, begins)
                row = reader.known.values[at]
                n = b - a
                logs = model.log10(np.split(symbols, bounds[1:-1])) + sums(lex.inner[row], begins) + end_inner
                base = sums(lex.base[row], begins) + end_base
                known = sums(row >= 0, begins).astype(np.int64) + end_known
                # A row for each text, whose key no word equals, and one for each of its words that isn't broadcast.
                rare = np.flatnonzero(row < 0)
                own = np.searchsorted(begins, rare, "right") - 1
                code, where, times = np.unique(own * reader.symbol.size + at[rare], return_index=True, return_counts=True)
                none = len(code)
                mine = pa.array([b" %d" % (uid + i) for i in range(n)], pa.binary())
                pad = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(none, t)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.concatenate([np.arange(n), own[where]])),
                        pa.concat_arrays([mine, words.take(pa.array(rare[where])).cast(pa.binary())]),
                        pa.array(np.concatenate([np.zeros(n, np.int64), times])),
                        pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(reader.symbol.values[at[rare[where]]].astype(np.int32) - TOP)]),
                        pad(np.diff(bounds), pa.int64()), pad(known, pa.int64()), pad(base, pa.float64()), pad(logs, pa.float64()),
                        *(pa.concat_arrays([batch.column(i).slice(a, n), pa.nulls(none, batch.schema.field(i).type)]) for i in range(cells)),
                    ],
                    ["uid", "word", "times", "shape", "n_tokens", "known", "base", "log", *names],
                )
                uid += n

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.col(text_col).cast("string").alias("_text"))
    schema = "uid long, word binary, times long, shape int, n_tokens long, known long, base double, log double, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    joined = rows.mapInArrow(run, schema).join(trained.counts.withColumnRenamed("n", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    # log10 of the class's denominator, from a bounded literal table
    denominators = F.array(*[F.lit(float(x)) for x in np.log10(lexicon.shape_tokens + ADD * (lexicon.shape_kinds + 1))])
    base = F.when(F.col("times") > 0, F.col("times") * (F.log10(c + ADD) - F.lit(float(np.log10(lexicon.tokens + ADD * (lexicon.kinds + 1)))))).otherwise(F.col("base"))
    log = F.when(F.col("times") > 0, F.col("times") * (F.log10(c + ADD) - F.get(denominators, F.col("shape")))).otherwise(F.col("log"))
    found = F.when(F.col("times") > 0, F.when(F.col("c") > 0, F.col("times")).otherwise(0)).otherwise(F.col("known"))
    own = [F.first(x, ignorenulls=True).alias(x) for x in names]  # only the text's own row has them
    grouped = joined.groupBy("uid").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(found).alias("n_known"), F.sum(base).alias("base_score"), F.sum(log).alias("score"), *own)
    return grouped.select(*[F.col(n).alias(x) for n, x in zip(names, columns, strict=True)], "n_tokens", "n_known", F.lit(int(lexicon.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trained = train_hmm(docs.filter(crc_mod("doc_id", 10) != 0).select(F.col("text").cast("string").alias("text")))
    scored = score_texts(docs, trained, ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_hmm_lm": op10_hmm_lm}
ORACLE: dict[str, str] = {}
