"""Personal data: exact patterns, and a character-level tagger that adds spans which they miss.

The base finds e-mail addresses, IPv4 addresses, payment cards and phone numbers by fixed patterns, each kind for itself. The tagger, a
bidirectional LSTM with CRF transitions, learns from labelled windows: windows of the documents with the base spans in them, and the
same windows with personal data in other written forms put in. It reads a text in windows of WINDOW characters that overlap by half; a
window without a digit or `@` has no span, as each kind has one of them. The windows' emissions are blended with weights that fall off
towards their ends, and one Viterbi pass over each stretch of adjoining windows decides for all of them together. A span of the tagger
counts if it fits its kind (parts, digits) and touches no base span.

Null and empty texts have no spans. Each row is read for itself, repeated or null ids included. A carried column named base or spans
gives way to the result; other columns don't matter. Learning uses at most SAMPLE distinct windows of the documents, the first by their
hash; such a window is the first 1.5 WINDOW characters of a stretch with a digit or `@`, or of a text that has none. Reading knows no such
bound. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .char_tagger import Tagger, char_ids, viterbi, viterbi_long
from .common import attach, hash_share, named, table, unpacked

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
EMAIL = re.compile(rf"[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_START = re.compile(rf"(?<![{LOCAL}])[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
IP_START = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEED = re.compile(r"[0-9@]")
WINDOW, SAMPLE, TAGS = 96, 3000, 1 + 2 * len(KINDS)
#: Characters of stretches that are decoded together; a longer stretch is decoded piece by piece.
PIECE = 100_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def fits(kind: str, text: str) -> bool:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in text.split("."))
    if kind == "card":
        d = only_digits(text)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(only_digits(text)) <= 15
    return True


def leftmost(text: str, at_start: re.Pattern, anywhere: re.Pattern) -> Iterator[tuple[int, int]]:
    """finditer of at_start's pattern in time linear in a run: only a run's first character, or the end of the match before, can start one."""
    p = 0
    while True:
        m = at_start.match(text, p) or anywhere.search(text, p)
        if not m:
            return
        yield m.span()
        p = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then by start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in leftmost(text, EMAIL, EMAIL_START)]
    if SEED.search(text):
        out += [("ip", a, b) for a, b in leftmost(text, IP, IP_START) if fits("ip", text[a:b])]
        out += [("card", *m.span()) for m in CARD.finditer(text) if fits("card", m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if fits("phone", m[0])]
    return out


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """0: none; 1 + 2k begins kind k, 2 + 2k goes on."""
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def written_otherwise(rng: np.random.Generator) -> tuple[str, str]:
    """A kind and an instance in a form that the base patterns may miss."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda a, b: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(a, b)))
    sep = lambda *s: s[rng.integers(len(s))]
    kind = KINDS[rng.integers(4)]
    if kind == "email":
        who = w(2, 9) + sep("", ".", "_", d(2)) + w(1, 8)
        return kind, who + sep("@", " @ ", "@ ", "(@)") + w(3, 10) + sep(".", " . ", ".") + sep("com", "org", "net", w(2, 4))
    if kind == "ip":
        dot = sep(".", " . ", "[.]", ". ")
        return kind, dot.join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        n, body = sep(15, 16, 16, 16), ""
        body = d(n - 1)
        body += next(c for c in "0123456789" if luhn(body + c))
        return kind, sep("", " ", "-", ".", "/", "  ").join(body[i : i + 4] for i in range(0, n, 4))
    form = sep("({}) {}-{}", "{}-{}-{}", "{} {} {}", "+{}/{}/{}", "00{} {} {}", "tel:{}.{}.{}", "+{} ({}) {}")
    text = form.format(d(3), d(3), d(4))
    return kind, text.removeprefix("tel:")


def examples(windows: list[str], seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each window with its base spans, and again with personal data in another form put in."""
    rng = np.random.default_rng(seed)
    out = []
    for text in windows:
        spans = base_spans(text)
        out.append((char_ids(text), tags_of(len(text), spans)))
        cut = int(rng.integers(0, len(text) + 1))
        if any(a < cut < b for _, a, b in spans):
            continue
        kind, put = written_otherwise(rng)
        gap = " " if rng.random() < 0.85 else "\n"
        whole = f"{text[:cut]}{gap}{put}{gap}{text[cut:]}"
        shift = len(put) + 2
        moved = [(k, a, b) if b <= cut else (k, a + shift, b + shift) for k, a, b in spans] + [(kind, cut + 1, cut + 1 + len(put))]
        found = [s for s in base_spans(whole) if s[0] != kind or s[2] <= cut + 1 or s[1] > cut + len(put)]
        out.append((char_ids(whole), tags_of(len(whole), [s for s in found if s in moved] + moved[-1:])))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """The grid's windows that hold a digit or @, adjoining ones merged."""
    half = WINDOW // 2
    cells = sorted({m.start() // half for m in SEED.finditer(text)})
    out: list[tuple[int, int]] = []
    for c in cells:
        a, b = max(0, (c - 1) * half), min(len(text), (c + 2) * half)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def acceptable(kind: str, text: str) -> bool:
    """Whether a span of the tagger is a whole instance of its kind."""
    d = only_digits(text)
    if kind == "email":
        return text.count("@") == 1 and re.fullmatch(r"[\w.%+-]+[\x20(]*@[\x20)]*[\w-]+(?:\x20?\.\x20?[\w-]+)+", text) is not None
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and re.fullmatch(r"[0-9.\[\]\x20]+", text) is not None and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if re.fullmatch(r"[0-9\x20().+/-]+", text) is None:
        return False
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and len(re.findall("[0-9]+", text)) >= 3


def merged(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of what spans cover, in order."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def free(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether a to b touches none of what is taken."""
    k = bisect_left(taken[0], b)
    return k == 0 or taken[1][k - 1] <= a


class PiiModel:
    def __init__(self, windows: list[str]):
        self.tagger = Tagger(TAGS)
        self.tagger.train(examples(windows))

    def blended(self, ids: np.ndarray, a: int, b: int) -> np.ndarray:
        """Emissions of the places a to b of a stretch: those of its windows, each by its weight."""
        half = WINDOW // 2
        total, weight = np.zeros((b - a, TAGS), np.float32), np.zeros(b - a, np.float32)
        begins = [p for p in range(max(0, (a - WINDOW) // half * half), b, half) if p + WINDOW > a and (p < len(ids) - half or p == 0)]
        for s in range(0, len(begins), 256):
            part = [(p, min(len(ids), p + WINDOW)) for p in begins[s : s + 256]]
            x = np.full((max(q - p for p, q in part), len(part)), -1)
            for j, (p, q) in enumerate(part):
                x[: q - p, j] = ids[p:q]
            e = self.tagger.emissions(x)
            for j, (p, q) in enumerate(part):
                w = np.minimum(np.arange(1, q - p + 1), np.arange(q - p, 0, -1)).astype(np.float32)
                lo, hi = max(a, p), min(b, q)
                total[lo - a : hi - a] += e[lo - p : hi - p, j] * w[lo - p : hi - p, None]
                weight[lo - a : hi - a] += w[lo - p : hi - p]
        return total / weight[:, None]

    def paths(self, stretches_: list[str]) -> list[np.ndarray]:
        """The tags of each stretch. Short ones are decoded side by side, about PIECE characters together, a longer one piece by piece."""
        move = self.tagger.p["move"].astype(float)
        out: list[np.ndarray] = []
        s = 0
        while s < len(stretches_):
            ids = char_ids(stretches_[s])
            if len(ids) > PIECE:
                out.append(viterbi_long(len(ids), lambda a, b, x=ids: self.blended(x, a, b), move, PIECE // 2))
                s += 1
                continue
            pack, held = [], 0
            while s < len(stretches_) and len(stretches_[s]) <= PIECE and (not pack or held + len(stretches_[s]) <= PIECE):
                pack.append(char_ids(stretches_[s]))
                held += len(pack[-1])
                s += 1
            out += viterbi(self._emissions(pack), move)
        return out

    def _emissions(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        half = WINDOW // 2
        total = [np.zeros((len(x), TAGS), np.float32) for x in ids]
        weight = [np.zeros(len(x), np.float32) for x in ids]
        windows = [(r, p, min(len(x), p + WINDOW)) for r, x in enumerate(ids) for p in range(0, max(1, len(x) - half), half)]
        for s in range(0, len(windows), 256):
            part = windows[s : s + 256]
            x = np.full((max(b - a for _, a, b in part), len(part)), -1)
            for j, (r, a, b) in enumerate(part):
                x[: b - a, j] = ids[r][a:b]
            e = self.tagger.emissions(x)
            for j, (r, a, b) in enumerate(part):
                w = np.minimum(np.arange(1, b - a + 1), np.arange(b - a, 0, -1)).astype(np.float32)
                total[r][a:b] += e[: b - a, j] * w[:, None]
                weight[r][a:b] += w
        return [t / w[:, None] for t, w in zip(total, weight, strict=True)]

    def added(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """The spans of each text that the tagger decides on, before they are held against the base."""
        regions = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
        paths = self.paths([texts[i][a:b] for i, a, b in regions])
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for (i, a, _), path in zip(regions, paths, strict=True):
            t = 0
            while t < len(path):
                k = path[t]
                end = t + 1
                if k:
                    while end < len(path) and path[end] == k + k % 2:
                        end += 1
                    p, q = a + t, a + end
                    while p < q and texts[i][p].isspace():
                        p += 1
                    while p < q and texts[i][q - 1].isspace():
                        q -= 1
                    out[i].append((KINDS[(k - 1) // 2], p, q))
                t = end
        return out

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        """For each text its base spans, and all spans by kind and start."""
        out: list[tuple] = [([], [])] * len(texts)
        seeded = [i for i, t in enumerate(texts) if SEED.search(t)]
        for i, extra in zip(seeded, self.added([texts[i] for i in seeded]), strict=True):
            base = base_spans(texts[i])
            taken = merged((x, y) for _, x, y in base)
            more = [(k, a, b) for k, a, b in extra if acceptable(k, texts[i][a:b]) and free(taken, a, b)]
            out[i] = base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
        return out


def train_pii(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> PiiModel:
    """Learn from windows about digits and @ of the documents, and from plain windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                at = stretches(t)
                found += [t[a : a + WINDOW + WINDOW // 2] for a, b in at]
                if not at:
                    found.append(t[:WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["window"])

    texts = docs.select(named(text_col).cast("string").alias("text")).filter("length(text) > 0")
    windows = texts.mapInArrow(cut, "window string").withColumn("seeded", F.col("window").rlike("[0-9@]"))
    # Distinct ones are counted first, so that only about the sample leaves the tasks, however often one occurs; of the plain windows a
    # few are enough.
    counts = {r["seeded"]: r["n"] for r in windows.groupBy("seeded").agg(F.approx_count_distinct("window", 0.02).alias("n")).collect()}
    share = F.when(F.col("seeded"), F.lit(min(1.0, 2 * sample / max(1, counts.get(True, 0))))).otherwise(F.lit(min(1.0, sample / 4 / max(1, counts.get(False, 0)))))
    kept = windows.withColumn("h", hash_share("window")).filter(F.col("h") <= share).distinct().collect()
    kept.sort(key=lambda r: (not r["seeded"], r["h"], r["window"]))
    seeded = [r["window"] for r in kept if r["seeded"]][:sample]
    plain = [r["window"] for r in kept if not r["seeded"]][: max(16, sample // 4)]
    return PiiModel(seeded + plain or ["no text here"])


def find_pii(docs: DataFrame, model: PiiModel, columns: list[str], text_col: str = "text") -> DataFrame:
    """`columns` and two arrays of (kind, start, end): base, and spans, which has the base and what the tagger adds."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shape = "array<struct<kind:string,start:bigint,end:bigint>>"

    def make():
        m = held.value

        def step(texts: pa.Array) -> list[pa.Array]:
            found = m.spans([t or "" for t in texts.to_pylist()])
            return [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f[i]] for f in found], span) for i in (0, 1)]

        return step

    return unpacked(attach(docs, columns, text_col, make, f"base {shape}, spans {shape}"), columns)


def redact(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; overlapping spans become one mark. Null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value

        def step(texts: pa.Array) -> list[pa.Array]:
            found = texts.to_pylist()
            return [pa.array([masked(t, spans) if spans else t for t, (_, spans) in zip(found, m.spans([t or "" for t in found]), strict=True)], pa.string())]

        return step

    found = attach(docs, [c for c in docs.columns if c != text_col], text_col, make, "masked string")
    return found.select(*[F.col("masked").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train_pii(docs), ["doc_id"])
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op1_pii": op1_pii}
ORACLE: dict[str, str] = {}
