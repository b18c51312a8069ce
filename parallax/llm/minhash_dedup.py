"""Near-duplicate documents by universal hash minima, banding, verification and large-star/small-star components.

A document's set is its distinct word shingles (hashes of 64 bits). Documents of the same set are one node. Each node gets HASHES
universal hash minima; BANDS bands of them make buckets, and each node is tied to the least node of each of its buckets if the
signatures are at all alike (LOOSE). What hangs together by these ties is a family. Inside a family every pair whose signatures
reach NEAR, over four standard errors below the similarity asked for, counts as a candidate, and is confirmed on the full sets of
shingles; a pair already connected needs no test. A family over BLOCK nodes is cut into blocks, whose pairs are separate tasks, so that
none has to fit one task. Tasks return confirmed edges that connect, one for each node and task at most, never all pairs of a group.

Texts that are null, empty or without words have an empty set and link with nothing. Rows may repeat, and so may ids, with the same text
or another one; a null id is not a component's name while its component has an id. Other columns are ignored. Keys with at least a
thousandth of all rows (a thousand keys at most) are joined by broadcast, so that a group of copies of any size spreads over the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, named, staged, table, text_bytes
from .components import connected_components
from .shingles import shingles, similar

HASHES, BANDS = 160, 32
ROWS = HASHES // BANDS
LOOSE, BLOCK = 0.4, 1024
#: A key is hot with at least this share of all rows.
HOT = 0.001
#: Stands for a null id where rows are joined.
NO_ID = -(1 << 63)
_RNG = np.random.default_rng(20240229)
#: Multiply-add-shift: a strongly universal family from 32 bits to 32 bits.
FACTORS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)) ^ (values & np.uint64(0xFFFFFFFF))
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(x), 4096):
        least = np.minimum(least, (FACTORS[:, None] * x[None, s : s + 4096] + TERMS[:, None]).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def describe(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, key, sig) of each row; key and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for t in text_bytes(batch.column(1)):
                s = shingles(t, size)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc", "n", "key", "sig"])

    rows = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, key binary, sig binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node): a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = np.random.default_rng(77).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = (sig * mult).sum(2, dtype=np.uint64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_arrays([pa.array((h ^ (h >> np.uint64(32))).view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "bucket long, node long")


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (u, v, signature of u, of v) those whose share of equal minima is at least LOOSE."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
        keep = pa.array((x == y).mean(1) >= LOOSE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])


def confirm(percent: int, size: int):
    """For one task of a family: tests candidates on the full sets, strongest first, until every pair is connected or tested."""
    near = percent / 100 - 4.2 * np.sqrt(percent / 100 * (1 - percent / 100) / HASHES)

    def run(group: pa.Table) -> pa.Table:
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        order = np.argsort(group["node"].to_numpy(), kind="stable")
        mine, node = group["mine"].to_numpy()[order], group["node"].to_numpy()[order]
        n = group["n"].to_numpy()[order]
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)[order]
        packed = group["text"].to_pylist()
        packed = [packed[i] for i in order]
        unpack = zstandard.ZstdDecompressor()
        sets: dict[int, np.ndarray] = {}

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(unpack.decompress(packed[i]), size)
            return sets[i]

        left = np.flatnonzero(mine == lo)
        right = left if lo == hi else np.flatnonzero(mine == hi)
        ps, qs, es = [], [], []
        for i in left:
            js = right[right > i] if lo == hi else right
            js = js[(100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
            if len(js):
                e = (sig[js] == sig[i]).mean(1)
                ok = e >= near
                ps.append(np.full(int(ok.sum()), i))
                qs.append(js[ok])
                es.append(e[ok])
        edges: list[tuple[int, int]] = []
        if ps:
            p, q = np.concatenate(ps), np.concatenate(qs)
            by = np.argsort(-np.concatenate(es), kind="stable")
            p, q = p[by], q[by]
            root = np.arange(len(node))
            take = 4
            while len(p):
                open_ = root[p] != root[q]
                p, q = p[open_], q[open_]
                if not len(p):
                    break
                # The strongest few of each node that are left; the rest may be connected by then.
                turn = np.zeros(len(p), np.int64)
                order_p = np.argsort(p, kind="stable")
                first = np.r_[True, p[order_p][1:] != p[order_p][:-1]]
                turn[order_p] = np.arange(len(p)) - np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
                now = turn < take
                for i, j in zip(p[now].tolist(), q[now].tolist(), strict=True):
                    if root[i] != root[j] and similar(full(i), full(j), percent):
                        edges.append((i, j))
                        a, b = min(root[i], root[j]), max(root[i], root[j])
                        root[root == b] = a
                p, q = p[~now], q[~now]
                take *= 2
        return pa.table({"u": pa.array([int(node[i]) for i, _ in edges], pa.int64()), "v": pa.array([int(node[j]) for _, j in edges], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, size: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(described, classes): the rows as (doc, n, key, sig), and for each key its least id, rows, group and the group's least id."""
    described = staged(describe(docs, size, id_col, text_col), "signatures")
    nodes = described.filter("key is not null").groupBy("key").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    entries = bands(nodes)
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("least")).filter("members > 1").drop("members")
    ties = entries.join(buckets, "bucket").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    sig = nodes.select("node", "sig")
    ties = ties.join(sig.select(F.col("node").alias("u"), F.col("sig").alias("a")), "u").join(sig.select(F.col("node").alias("v"), F.col("sig").alias("b")), "v")
    families = staged(connected_components(ties.select("u", "v", "a", "b").mapInArrow(alike, "u long, v long")), "families")

    sizes = families.groupBy("component").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).select("component", "blocks")
    members = families.join(sizes, "component").join(nodes, "node")
    members = members.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = members.select(F.coalesce("doc", F.lit(NO_ID)).alias("id"), "key", "node", "component", "blocks", "mine", "n", "sig")
    rows = docs.select(F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("id"), named(text_col).cast("string").alias("text"))
    several = wanted.groupBy("id").count().filter("count > 1").select("id")
    if several.isEmpty():
        texts = rows.join(wanted, "id")
    else:
        # Ids with several texts, null ones above all: a text joins by its key, too, and copies go once, so that none meets all the others.
        several = staged(several, "several")

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shingles(t, size) for t in text_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_key(s) if len(s) else None for s in found], pa.binary())], ["id", "text", "key"])

        keyed = rows.join(several, "id", "left_semi").mapInArrow(key, "id long, text string, key binary").filter("key is not null").dropDuplicates(["id", "key"])
        plain = rows.join(several, "id", "left_anti").join(wanted, "id")
        texts = plain.unionByName(keyed.join(wanted, ["id", "key"]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of each node; an id's other texts drop out by their key."""
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = text_bytes(batch.column(0))
            keep = [i for i, (t, key) in enumerate(zip(raw, batch.column(1).to_pylist(), strict=True)) if set_key(shingles(t, size)) == key]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int64())) for c in batch.columns[2:]), pa.array([squeeze.compress(raw[i]) for i in keep], pa.binary())], names)

    names = ["node", "component", "blocks", "mine", "n", "sig", "text"]
    packed = texts.select("text", "key", *names[:-1]).mapInArrow(pack, "node long, component long, blocks int, mine int, n long, sig binary, text binary")
    placed = packed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    # Rows of one id and text come twice if they repeat; the second does nothing, as it is at once connected.
    edges = placed.select("component", "lo", "hi", "mine", "node", "n", "sig", "text").groupBy("component", "lo", "hi").applyInArrow(confirm(percent, size), "u long, v long")
    linked = connected_components(edges)
    members_of = linked.join(nodes.select("node", "key", "doc"), "node")
    least = members_of.groupBy("component").agg(F.min("doc").alias("component_id"))
    classes = nodes.select("key", "copies", F.col("doc").alias("least_doc"), "node").join(members_of.join(least, "component").select("key", "component", "component_id"), "key", "left")
    return described, classes.select("key", "copies", "least_doc", F.coalesce("component", "node").alias("group"), F.coalesce("component_id", "least_doc").alias("component_id"))


def keep_one(docs: DataFrame, size: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: that of the least id. Texts without words all stay; of equal rows one stays."""
    columns = docs.columns
    described, classes = near_duplicates(docs, size, percent, id_col, text_col)

    def make():
        return lambda texts: [pa.array([set_key(s) if len(s) else None for s in (shingles(t, size) for t in text_bytes(texts))], pa.binary())]

    keyed = attach(docs, columns, text_col, make, "key binary").withColumn("id", F.coalesce(F.col("row").getField(id_col).cast("long"), F.lit(NO_ID)))
    order = F.struct(F.col("least_doc").isNull(), "least_doc", "key")
    first = classes.groupBy("group").agg(F.min(order).alias("first")).select("first.key", F.coalesce("first.least_doc", F.lit(NO_ID)).alias("id"), F.lit(True).alias("first"))
    # Joined by id and key together: copies of a text have ids of their own, so no group meets in one task.
    kept = keyed.join(first, ["id", "key"], "left").filter(F.col("key").isNull() | F.col("first"))
    again = described.filter("key is not null").groupBy("doc", "key").count().filter("count > 1").select(F.coalesce("doc", F.lit(NO_ID)).alias("id"), "key", F.lit(True).alias("again"))
    if again.isEmpty():
        return kept.select("row.*")
    kept = kept.join(again, ["id", "key"], "left")
    once = kept.filter("again").dropDuplicates(["id", "key"])
    return kept.filter("again is null").select("row.*").unionByName(once.select("row.*"))


def by_key(described: DataFrame, classes: DataFrame) -> DataFrame:
    """described with the classes of its keys: hot keys by broadcast, rows without a key as they are."""
    classes = staged(classes, "classes")
    total = described.count()
    hot = classes.filter(F.col("copies") >= max(2, HOT * total))  # 1 / HOT rows at most
    warm = described.filter("key is not null").join(F.broadcast(hot.select("key", F.lit(True).alias("hot"))), "key", "left")
    cold = warm.filter("hot is null").drop("hot").join(classes, "key", "left")
    many = described.join(F.broadcast(hot), "key")
    return cold.unionByName(many).unionByName(described.filter("key is null"), allowMissingColumns=True)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    described, classes = near_duplicates(table(spark, sf_dir, "documents"), size=2)
    component = F.coalesce("component_id", "doc")
    return by_key(described, classes).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, component.isNull()).alias("kept"))


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
ORACLE = {
    "op7_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.a = w.doc_id
"""
}
