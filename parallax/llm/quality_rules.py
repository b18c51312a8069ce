"""Quality rules: fixed rules on words and lines, and bands of n-gram perplexity for each language.

The fixed rules count words, their code points, symbols, lines that repeat, and words in windows of WINDOW words that repeat. A text fails
them with too few words or too many repeated ones.

The perplexity is that of modified Kneser-Ney models (word_ngrams.py), one for each language: words by their two predecessors, and what these
leave to words that they have not seen goes to a model of spelling (ngram_tables.py): bytes by the four before them, counted from the
language's distinct words. It is taken per byte of the words, so that languages and long words compare. Each language has a band: a text
above the upper bound is gibberish to the model, one below the lower bound says next to nothing.

Learning uses all documents labelled as good (quality 1) of the folds 0 and 1 (crc32 of the id as text, mod 4); copies count once. The models
of words stay distributed: what the log-probability of a text is made of adds up over its n-grams, so the most frequent n-grams are
broadcast and those that the others hold are joined to the texts. The bands are fitted on all labelled documents of fold 3 that pass the
fixed rules, from how many have each surprise (in thousandths of a bit). Fold 2 is never learned from. A language with few labelled documents, and rows without a language, are judged by a model and a band of all languages
together, which are made where such rows are. Without good documents to learn from the fixed rules alone decide. A null text is one without
words; ids and rows may repeat, a repeated label counts by its largest value; carried columns give way to results of the same name, others
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import attach, crc_mod, discard, freed_shuffles, named, staged, table, unpacked
from .ngram_tables import ODD, NgramTables, count_ngrams, name_code, ngram_rows, word_codes
from .shingles import mix
from .word_index import Growing, WordIndex, byte_lengths, byte_slices, split_words, sums
from .word_ngrams import ASKED, UNIT, Frequent, Sequences, answers, asked_rows, count_records, signed_of, split_records

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = b"#*$%&|<>"
#: Order of the models of spelling.
BYTES = 5
#: A language has a model of its own from so many labelled documents on.
LEAST_DOCS = 40
#: How much more it counts to lose a good document than to keep a bad one.
WEIGHT = 20
#: Words that a worker holds for all languages together, and bytes of texts that it reads at once.
HELD, SLICE = 250_000, 500_000
#: The model of all languages together.
ANY = ""
#: Distinct words that are spelled together, and thousandths of a bit that a surprise is given in.
SPELLED, STEP = 25_000, 1000
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _counted(mask: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many places of each range of a mask are set."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[begins[1:]] - total[begins[:-1]]


def repeated_words(codes: np.ndarray, begins: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of each text the words that lie in a window of words found twice or more in it."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(len(begins) - 1, np.int64)
    key = codes[:n].copy()
    for k in range(1, window):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k])
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    key = mix(key[at] + owner[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(at), bool)
    twice[by[1:][same]] = twice[by[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    return _counted(np.cumsum(edge[:-1]) > 0, begins)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Of each text the lines with a word that equal an earlier one."""
    parts = pc.split_pattern(texts, "\n")
    lines, begins = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    begins = begins - begins[0]
    filled = pc.greater(pc.binary_length(pc.ascii_trim(lines, " \t\n\r\x0b\x0c")), 0).to_numpy(zero_copy_only=False)
    encoded = lines.dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))[filled]
    number = encoded.indices.to_numpy()[filled]
    distinct = np.unique(owner * max(1, len(encoded.dictionary)) + number) // max(1, len(encoded.dictionary))
    return np.bincount(owner, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[np.frombuffer(SYMBOLS, np.uint8)] = True


class Words:
    """A worker's words by number, with their codes and lengths; stats(texts) has the fixed rules' counts."""

    def __init__(self, held: int = HELD):
        self.index = WordIndex(held)
        self.code, self.chars = Growing(np.uint64), Growing(np.int64)
        self.words: list[bytes] = []
        self.turn = 0  # how often the numbers have begun anew

    def _learn(self, new: pa.Array, _: int) -> None:
        self.words += new.cast(pa.binary()).to_pylist()
        self.code.extend(word_codes(new))
        self.chars.extend(pc.utf8_length(new).to_numpy(zero_copy_only=False).astype(np.int64))

    def stats(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The five counts of each text, the numbers of all words, and where each text's words begin."""
        if self.index.full():
            self.index.clear()
            self.code.clear()
            self.chars.clear()
            self.words = []
            self.turn += 1
        texts = pc.fill_null(texts, "")
        words, begins = split_words(texts, lower=False)
        at = self.index.rows(words, self._learn)
        size = byte_lengths(texts)
        raw = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
        symbols = _counted(_IS_SYMBOL[raw], np.concatenate([[0], np.cumsum(size)]))
        chars = sums(self.chars.values[at], begins).astype(np.int64)
        return [np.diff(begins), chars, symbols, repeated_lines(texts), repeated_words(self.code.values[at], begins)], at, begins


def fails(counts: list[np.ndarray]) -> np.ndarray:
    n, repeated = counts[0], counts[4]
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


class Perplexity:
    """What a worker holds of the models of all languages, besides the spelling: what the words leave to it, and the frequent n-grams."""

    def __init__(self, models: list[str], left: list[float], frequent: Frequent):
        self.number, self.left, self.frequent = {x: i for i, x in enumerate(models)}, left, frequent

    def named(self, language: str | None) -> str:
        return language if language in self.number else ANY


def byte_sequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each word and an end mark, as codes, and where each word begins."""
    raw = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8).astype(np.uint64)
    return raw + np.uint64(1), np.concatenate([[0], np.cumsum([len(w) + 1 for w in words], dtype=np.int64)])


class Scorer:
    """For each language how a worker's words are spelled, and what is known of texts without the rarer n-grams."""

    def __init__(self, model: Perplexity, spelling: NgramTables):
        self.model, self.spelling, self.turn = model, spelling, -1
        self.of: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def read(self, words: Words, at: np.ndarray, begins: np.ndarray, language: str) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Of texts given by their words' numbers: the log-probability in UNITs, the bytes of the words, and what the rest of the records is
        to be asked for: the text's place, the n-gram's key, whether it counts as itself, and whether as a context."""
        if self.turn != words.turn:
            self.of.clear()
            self.turn = words.turn
        if language not in self.model.number:
            none = np.zeros(0, np.int64)
            return np.zeros(len(begins) - 1, np.int64), np.zeros(len(begins) - 1, np.int64), (none, none.view(np.uint64), none > 0, none > 0)
        model = name_code(language)
        known, spelled, size = self.of.get(language) or (np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(known) < len(words.words):
            more = 2 * len(words.words) - len(known)
            known, spelled, size = np.pad(known, (0, more)), np.pad(spelled, (0, more)), np.pad(size, (0, more))
            self.of[language] = known, spelled, size
        new = np.unique(at[~known[at]])
        known[new] = True
        left = self.model.left[self.model.number[language]]
        for s in range(0, len(new), 20_000):
            part = new[s : s + 20_000]
            mine = [words.words[i] for i in part.tolist()]
            size[part] = [len(w) + 1 for w in mine]
            spelled[part] = np.rint((self.spelling.sequence_sums(*byte_sequences(mine), model) + left) * UNIT)
        found, asked = self.model.frequent.read(words.code.values[at], begins, model)
        return sums(spelled[at], begins).astype(np.int64) + found, sums(size[at], begins).astype(np.int64), asked


class QualityModel:
    """sent: a broadcast of what workers hold, or None; spelling: one of the models of spelling; bands: for each language's name the bounds of
    the surprise; rest: the PACKED records of the n-grams that are not sent, by so many bits."""

    def __init__(self, sent: Broadcast | None, bands: dict[str, tuple[float, float]], spelling: Broadcast | None = None, rest: DataFrame | None = None, bits: int = 0, any_language: bool = False):
        self.sent, self.bands, self.spelling, self.rest, self.bits, self.any_language = sent, bands, spelling, rest, bits, any_language
        self.learned: list[DataFrame] = []  # the stages that it was counted from


def _quantile(values: np.ndarray, times: np.ndarray, q: float) -> float:
    """np.quantile of sorted values that each occur so often."""
    ends = np.cumsum(times)
    place = q * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, k, "right")] for k in (int(np.floor(place)), int(np.ceil(place))))
    return float(low + (high - low) * (place - np.floor(place)))


def band(good: np.ndarray, bad: np.ndarray, learned: np.ndarray, weight: float = WEIGHT, times: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[float, float]:
    """Bounds of the surprise that lose the least, a good one lost counting `weight` times a bad one kept; each lies halfway to the next
    value beyond it, and never within six of the good ones' half-widths (the middle half's) of their middle. The lower one also regards
    the documents that the model was counted from, which say less to it than they are. times: how often each value of the three occurs."""
    if not len(good):
        return -np.inf, np.inf
    n_good, n_bad, n_learned = times or (np.ones(len(x), np.int64) for x in (good, bad, learned))
    by = np.argsort(good)
    middle, quarter, three = (_quantile(good[by], n_good[by], q) for q in (0.5, 0.25, 0.75))
    reach = 6 * max(1e-3, (three - quarter) / 2)

    def upto(values: np.ndarray, n: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        by = np.argsort(values)
        return np.concatenate([[0], np.cumsum(n[by])])[np.searchsorted(values[by], cuts, "right")]

    def upper(g: np.ndarray, ng: np.ndarray, b: np.ndarray, nb: np.ndarray, least: float) -> float:
        nb, b = nb[b > least], b[b > least]
        if not len(b):
            return max(float(g.max()), least) + reach / 6
        cuts = np.unique(np.concatenate([[least], g[g > least], b]))
        loss = weight * (ng.sum() - upto(g, ng, cuts)) + upto(b, nb, cuts)
        k = int(np.flatnonzero(loss == loss.min())[0])
        above = cuts[k + 1] if k + 1 < len(cuts) else cuts[k] + reach / 6
        return float(cuts[k] + above) / 2

    lower = upper(-np.concatenate([good, learned]), np.concatenate([n_good, n_learned]), -bad, n_bad, reach - middle)
    return -float(lower), upper(good, n_good, bad, n_bad, middle + reach)


def _marked(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, part): part 2 for good documents of the folds 0 and 1, the label for those of fold 3."""
    marked = labels.select(named(id_col).alias("id"), named(label_col).alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    marked = marked.groupBy("id").agg(F.max("label").cast("int").alias("label")).withColumn("fold", crc_mod("id", 4)).filter("fold <> 2 and (label = 1 or fold = 3)")
    return marked.select("id", F.when(F.col("fold") < 3, 2).otherwise(F.col("label")).alias("part"))


def _training(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], DataFrame | None]:
    """The models' names, and (m, text): the distinct texts that each is counted from, m its place among the names."""
    spark = docs.sparkSession
    language = F.coalesce(named(lang_col).cast("string"), F.lit(ANY))
    rows = docs.select(named(id_col).alias("id"), language.alias("lang"), named(text_col).cast("string").alias("text")).filter(F.octet_length("text") > 0)
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text")})
    good = staged(rows.select("id", "lang", "h1", "h2").join(marked.filter("part > 0"), "id"), "good")
    count = {r["lang"]: r for r in good.groupBy("lang").agg(F.count_if(F.col("part") == 2).alias("n"), F.count_if(F.col("part") == 1).alias("fitted")).collect()}
    if not any(r["n"] for r in count.values()):
        return [], None
    names = sorted(x for x, r in count.items() if x != ANY and r["n"] >= LEAST_DOCS and r["fitted"] >= LEAST_DOCS // 4)
    good = good.filter("part = 2")
    parts = []
    if names:
        numbers = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "lang string, m int"))
        parts.append(good.join(numbers, "lang").groupBy("m", "h1", "h2").agg(F.min("id").alias("id")))
    if not names or not docs.filter(~language.isin(names)).isEmpty():
        parts.append(good.groupBy("h1", "h2").agg(F.min("id").alias("id")).select(F.lit(len(names)).alias("m"), "h1", "h2", "id"))
        names = [*names, ANY]
    chosen = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    # The first bits of the chosen ones' hashes are at most two million; most other texts end there and need no shuffle.
    first = F.shiftrightunsigned("h1", 43)
    near = rows.drop("lang").filter(crc_mod("id", 4) < 2).withColumn("first", first)
    near = near.join(F.broadcast(chosen.select(first.alias("first")).distinct()), "first", "left_semi").drop("first")
    texts = staged(near.join(chosen, ["id", "h1", "h2"]).dropDuplicates(["m", "id", "h1", "h2"]).select("m", "text"), "training")
    discard(good)
    return names, texts


def count_models(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> QualityModel:
    """The models of all documents to learn from, without bands."""
    spark = docs.sparkSession
    models, rows = _training(docs, _marked(labels, id_col, label_col), id_col, text_col, lang_col)
    if rows is None:
        return QualityModel(None, {})
    codes = [name_code(x) for x in models]

    def by_model(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
        for m in batch.column(0).unique().to_pylist():
            yield m, batch.column(1).filter(pc.equal(batch.column(0), m))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, texts in by_model(batch):
                words = split_words(texts, lower=False)[0].unique()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), m, np.int32)), words], ["m", "word"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(m, text): many words in one text, so that an n-gram leaves its task seldom."""
        held: dict[int, list[str]] = {}
        for batch in batches:
            for m, words in by_model(batch):
                held.setdefault(m, []).extend(words.to_pylist())
                if len(held[m]) >= SPELLED:
                    yield pa.RecordBatch.from_pylist([{"m": m, "text": " ".join(held.pop(m))}], pa.schema([("m", pa.int32()), ("text", pa.string())]))
        for m, words in held.items():
            yield pa.RecordBatch.from_pylist([{"m": m, "text": " ".join(words)}], pa.schema([("m", pa.int32()), ("text", pa.string())]))

    def spelled():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for m, texts in by_model(batch):
                for i in range(len(texts)):
                    words = split_words(texts.slice(i, 1), lower=False)[0].cast(pa.binary()).to_pylist()
                    yield ngram_rows(*byte_sequences(words), None, codes[m], BYTES)

        return step

    vocabulary = staged(rows.mapInArrow(distinct_words, "m int, word string").distinct(), "vocabulary")
    spelling = count_ngrams(vocabulary.mapInArrow(together, "m int, text string"), BYTES, spelled)
    sent = spark.sparkContext.broadcast(spelling)

    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(z, spelled): each word's key and the logarithm of its chance by its spelling."""
        for batch in batches:
            for m, words in by_model(batch):
                key = mix(word_codes(words) * ODD + codes[m])
                log = sent.value.sequence_sums(*byte_sequences(words.cast(pa.binary()).to_pylist()), codes[m])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(log)], ["z", "spelled"])

    def sequences(batch: pa.RecordBatch) -> Iterator[Sequences]:
        for m, texts in by_model(batch):
            for a, b in byte_slices(texts, SLICE):
                words, begins = split_words(texts.slice(a, b - a), lower=False)
                encoded = words.dictionary_encode()
                code = word_codes(encoded.dictionary)
                yield code[encoded.indices.to_numpy()] if len(code) else code, begins, codes[m], m
                pa.default_memory_pool().release_unused()

    records, left = count_records(rows, sequences, vocabulary.mapInArrow(spellings, "z long, spelled double"))
    frequent, rest, bits = split_records(records)
    discard(records)
    model = QualityModel(spark.sparkContext.broadcast(Perplexity(models, [left.get(m, 0.0) for m in range(len(models))], frequent)), {}, sent, rest, bits, models[-1] == ANY)
    model.learned = [rows, vocabulary]
    return model


def surprise(docs: DataFrame, model: QualityModel, columns: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """row (a struct of `columns`), the counts of the fixed rules, bits (log2 of the perplexity per byte, in steps of a thousandth), base_failed
    and name, that of the model which judges the row."""
    fields = f"{FIELDS}, bits double, base_failed boolean, name string"
    if model.sent is None:

        def make():
            words = Words()

            def step(texts: pa.Array) -> list[pa.Array]:
                counts, _, begins = words.stats(texts)
                n = len(begins) - 1
                return [*map(pa.array, counts), pa.array(np.zeros(n)), pa.array(fails(counts)), pa.array([ANY] * n, pa.string())]

            return step

        return attach(docs, columns, text_col, make, fields, limit=SLICE)
    rows = docs.select(F.struct(*[named(c) for c in columns] or [F.lit(1)]).alias("row"), named(lang_col).cast("string").alias("beside"), named(text_col).cast("string").alias("text"))
    asks, fixed = StructType.fromDDL(ASKED), StructType.fromDDL(f"place int, log long, bytes long, {FIELDS}, base_failed boolean, name string")
    text = StructType([*fixed.fields, StructField("row", rows.schema["row"].dataType)])
    asks_names, text_names = asks.names, text.names
    schema = StructType([*asks.fields, *text.fields])
    sent, spelling, bits = model.sent, model.spelling, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scorer = Words(), Scorer(sent.value, spelling.value)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in byte_slices(batch.column(2), SLICE):
                n = b - a
                counts, at, begins = words.stats(batch.column(2).slice(a, n))
                names = np.array([scorer.model.named(x) for x in batch.column(1).slice(a, n).to_pylist()], object)
                log, size, many = np.zeros(n, np.int64), np.zeros(n, np.int64), np.diff(begins)
                asked = []
                for name in sorted(set(names)):
                    mine = names == name
                    log[mine], size[mine], (place, *more) = scorer.read(words, at[np.repeat(mine, many)], np.concatenate([[0], np.cumsum(many[mine])]), name)
                    asked.append((np.flatnonzero(mine)[place], *more))
                # A row for each text, and one for each bucket of records that the slice asks.
                ask = asked_rows(*map(np.concatenate, zip(*asked, strict=True)), n, number, bits)
                home = int(mix(np.array([number], np.uint64))[0]) >> (64 - bits)
                own = [pa.array(np.full(n, home, np.int32)), pa.array(np.full(n, number, np.int64))]
                texts = [*map(pa.array, (np.arange(n, dtype=np.int32), log, size, *(c.astype(np.int64) for c in counts), fails(counts))), pa.array(names, pa.string()), batch.column(0).slice(a, n)]
                columns = [pa.concat_arrays(x) for x in zip(own, ask.columns[:2], strict=True)]
                columns += [pa.concat_arrays([pa.nulls(n, x.type), x]) for x in ask.columns[2:]]
                columns += [pa.concat_arrays([x, pa.nulls(ask.num_rows, x.type)]) for x in texts]
                yield pa.RecordBatch.from_arrays(columns, [*asks_names, *text_names])
                number += 1
                pa.default_memory_pool().release_unused()

    def answered(asked: pa.Table, packed: pa.Table) -> pa.Table:
        """What is asked of a bucket becomes what it adds to each text; rows of texts pass."""
        is_text = pc.is_null(asked["keys"])
        texts, asked = asked.filter(is_text), asked.filter(pc.invert(is_text))
        more = pa.table({"slice": asked["slice"], "added": pa.array(answers(asked, packed), pa.binary()), **{c: asked[c] for c in text_names}})
        return pa.concat_tables([pa.table({"slice": texts["slice"], "added": pa.nulls(len(texts), pa.binary()), **{c: texts[c] for c in text_names}}), more])

    def added(group: pa.Table) -> pa.Table:
        """The texts of a slice with all that is added to their log-probabilities."""
        is_text = pc.is_null(group["added"])
        texts = group.filter(is_text)
        more = sum((signed_of(x) for x in group["added"].filter(pc.invert(is_text)).to_pylist()), np.zeros(len(texts), np.int64))
        log = texts["log"].to_numpy() + more[texts["place"].to_numpy()]
        return pa.table({c: pa.array(log) if c == "log" else texts[c] for c in text_names})

    found = rows.mapInArrow(run, schema).groupBy("bucket").cogroup(model.rest.groupBy("bucket"))
    found = found.applyInArrow(answered, StructType([*StructType.fromDDL("slice long, added binary").fields, *text.fields]))
    texts = found.groupBy("slice").applyInArrow(added, text)
    bits_of = F.when(F.col("bytes") > 0, F.round(-F.col("log") / F.col("bytes") / float(np.log(2) * UNIT) * STEP) / STEP).otherwise(0.0).alias("bits")
    return texts.select("row", *StructType.fromDDL(FIELDS).names, bits_of, "base_failed", "name")


def fit_bands(scored: DataFrame, marked: DataFrame) -> dict[str, tuple[float, float]]:
    """The bands from (id, name, bits) of documents that pass the fixed rules; a language's counts of each surprise come together, whose
    number is bounded by their steps."""
    counts = scored.join(marked, "id").groupBy("name", "part", "bits").count()

    def fitted(group: pa.Table) -> pa.Table:
        part, bits, n = (group[c].to_numpy() for c in ("part", "bits", "count"))
        of = [part == k for k in (1, 0, 2)]
        if n[of[0]].sum() < LEAST_DOCS // 4:
            return pa.table({"name": pa.array([], pa.string()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        low, high = band(*(bits[x] for x in of), times=tuple(n[x] for x in of))
        return pa.table({"name": group["name"].slice(0, 1), "low": [low], "high": [high]})

    return {r["name"]: (r["low"], r["high"]) for r in counts.groupBy("name").applyInArrow(fitted, "name string, low double, high double").collect()}


def _bands(docs: DataFrame, scored: DataFrame, model: QualityModel, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> dict[str, tuple[float, float]]:
    """Bands from the scored rows, whose row holds the id as its first column; that of all languages together takes their documents once more."""
    marked = _marked(labels, id_col, label_col)
    of = lambda df: df.filter("not base_failed").select(F.col("row").getField(id_col).alias("id"), "name", "bits")
    rows = of(scored).filter(F.col("name") != ANY)
    if model.any_language:
        near = docs.filter(crc_mod(named(id_col), 4) != 2).select(named(id_col), named(text_col), F.lit(None).cast("string").alias("lang"))
        rows = rows.unionByName(of(surprise(near, model, [id_col], text_col, "lang")))
    return fit_bands(rows, marked)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> QualityModel:
    """Count the models and fit the bands, from all labelled documents of their folds."""
    model = count_models(docs, labels, id_col, text_col, lang_col, label_col)
    if model.sent is not None:
        near = docs.filter(crc_mod(named(id_col), 4) != 2)
        model.bands = _bands(docs, surprise(near, model, [id_col], text_col, lang_col), model, labels, id_col, text_col, lang_col, label_col)
    return model


def verdict(scored: DataFrame, model: QualityModel, columns: list[str]) -> DataFrame:
    """`columns`, the counts, bits, base_failed and kept, of scored rows."""
    bounds = scored.sparkSession.createDataFrame([(x, float(a), float(b)) for x, (a, b) in model.bands.items()], "name string, low double, high double")
    low, high = F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf")))
    kept = ~F.col("base_failed") & (F.col("bits") >= low) & (F.col("bits") <= high)
    found = scored.join(F.broadcast(bounds), "name", "left").select("row", *StructType.fromDDL(FIELDS).names, "bits", "base_failed", kept.alias("kept"))
    return unpacked(found, columns)


def judge(docs: DataFrame, model: QualityModel, columns: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`columns`, the counts of the fixed rules, bits (log2 of the perplexity per byte), base_failed and kept."""
    return verdict(surprise(docs, model, columns, text_col, lang_col), model, columns)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    with freed_shuffles(spark):
        model = count_models(docs, labels)
        for df in model.learned:
            discard(df)
        # Scored once: the bands are fitted on the same rows that they judge.
        scored = staged(surprise(docs, model, ["doc_id"]), "surprise")
        if model.sent is not None:
            model.bands = _bands(docs, scored, model, labels, "doc_id", "text", "lang", "quality")
            discard(model.rest)
    return verdict(scored, model, ["doc_id"])


QUERIES = {"op12_quality_rules": op12_quality_rules}
ORACLE: dict[str, str] = {}
