"""Near-duplicate vectors by a pivot-permutation index.

Pivots are a bounded sample of the vectors, spread apart: one within RADIUS of a pivot already kept is dropped. A pivot that drops at
least DENSE others stands in a dense place. A vector within RADIUS of a dense pivot has the nearest one as its home, and all that may
link with it lies, by the triangle inequality, in the home's ball; there every pair is compared, so that no link of such a vector is
missed. Each other vector is described by its PREFIX nearest pivots in order. The inverted lists are those of pairs of pivots: a vector
stands in the list of each pair of its pivots, so that the vectors of a list share two at least, which is what makes candidates; a list
is short, as pairs are many. The cosine in double precision decides. A pair is looked at in the ball of its first home, or without one in
the list of the first two pivots that both name, so it counts once. Short lists go to the tasks in BUNDLEs of many; a list longer than
BLOCK, as the balls are, is cut into blocks whose pairs are separate tasks, so no list has to fit one task and no candidate is left out.
Tasks give back, not pairs, but each vector's number of links and its least partner in the task; components come from these by large-star
and small-star. Vectors with the same components are one entry with a multiplicity.

Vectors that are null, zero, or hold null or non-finite components link with nothing and keep a row of their own. Vectors of different
lengths are never compared. Each row of the input gives one row; a repeated id counts as one more vector with that id. Rows with a null
id link as all others do, and a null id is not a component's name while its component has an id; where it has none, component_id is null
and its rows are kept. Labels and other columns are ignored. Vectors with at least a thousandth of all rows (a thousand at most) get
their results by broadcast, so that one very common vector spreads over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share, staged, table
from .components import connected_components

PREFIX, BLOCK, BUNDLE = 7, 1024, 16_384
#: One pivot for so many distinct vectors, within bounds.
VECTORS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 32, 32, 4096
#: Distance of unit vectors within which a pivot stands for others, and the number of sampled ones that make it dense.
RADIUS, DENSE = 0.6, 8
#: The list of two pivots a < b is a * PIVOT + b; 0 holds all vectors of its length; from BALL on stand the balls of pivots. Then comes the
#: length of the vectors.
PIVOT, BALL, LENGTH = 1 << 12, 1 << 24, 1 << 25
#: A vector is hot with at least this share of all rows.
HOT = 0.001


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of norm 1 from little-endian doubles."""
    x = np.stack([np.frombuffer(r, np.float64) for r in raw])
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Adds raw: the components as doubles, or null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes | None] = []
            for v in batch.column(1).to_pylist():
                x = None
                if v and None not in v:
                    a = np.array(v, np.float64)
                    x = (a + 0.0).tobytes() if np.isfinite(a).all() and a.any() else None
                raw.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    return df.select("vec_id", F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, raw binary")


def spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x no two of which are within RADIUS, the first ones first, and the numbers of those that dropped DENSE others."""
    kept, dropped = np.empty_like(x), np.zeros(len(x), np.int64)
    n = 0
    for v in x:
        near = kept[:n] @ v
        if n and near.max() >= 1 - RADIUS**2 / 2:
            dropped[near.argmax()] += 1
        else:
            kept[n] = v
            n += 1
    return kept[:n].copy(), np.flatnonzero(dropped[:n] >= DENSE)


def choose_pivots(vectors: DataFrame, count: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: count * its share of pivots at most, the first by hash, a bounded sample, spread apart; and the dense ones."""
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, count // VECTORS_A_PIVOT))
    near = vectors.select("raw", hash_share("raw").alias("h")).filter(F.col("h") <= min(1.0, 2 * wanted / max(1, count)))  # about twice the sample leaves the tasks
    rows = sorted(near.collect(), key=lambda r: (r["h"], r["raw"]))[:wanted]
    by_length: dict[int, list[bytes]] = {}
    for r in rows:
        by_length.setdefault(len(r["raw"]), []).append(bytes(r["raw"]))
    return {n: spread(unit(raw)) for n, raw in by_length.items()}


def first_list(code: np.ndarray | int, home: np.ndarray, named: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs i, j of the lists `code` count there: a ball of two homes is that of the first, and a list of two pivots the one
    whose first pivot is the only shared one before its second."""
    code = np.broadcast_to(code, i.shape)
    own = np.where(home < 0, PIVOT, home)
    out = np.minimum(own[i], own[j]) == code - BALL
    out |= code == 0
    listed = np.flatnonzero((code > 0) & (code < BALL))
    for s in range(0, len(listed), 65536):
        k = listed[s : s + 65536]
        a, b = (np.stack([np.frombuffer(named[r], np.int16) for r in side[k]]) for side in (i, j))
        before = (a[:, :, None] == b[:, None, :]) & (a < (code[k] % PIVOT)[:, None])[:, :, None]
        out[k] = before.sum((1, 2)) == 1
    return out


def list_pairs(x: np.ndarray, code: np.ndarray, threshold: float, chunk: int = 131_072) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows of one list each, of rows sorted by list."""
    ends = np.searchsorted(code, code, "right")
    partners = np.cumsum(ends - 1 - np.arange(len(code)))
    for n in range(0, int(partners[-1]), chunk):
        k = np.arange(n, min(n + chunk, int(partners[-1])))
        i = np.searchsorted(partners, k, "right")
        j = ends[i] - (partners[i] - k)
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        yield i[near], j[near]


def block_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of left and right rows, each once where these are the same."""
    for s in range(0, len(left), 512):
        a = left[s : s + 512]
        cosine = x[a] @ x[right].T
        i, j = np.nonzero(cosine >= threshold - 1e-9)
        sure = cosine[i, j] >= threshold + 1e-9
        i, j = a[i], right[j]
        if left is right:
            i, j, sure = i[i < j], j[i < j], sure[i < j]
        for c in range(0, len(i), 65536):
            p, q = i[c : c + 65536], j[c : c + 65536]
            ok = sure[c : c + 65536].copy()
            close = np.flatnonzero(~ok)
            ok[close] = np.einsum("ij,ij->i", x[p[close]], x[q[close]]) >= threshold
            yield p[ok], q[ok]


def link_vectors(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    all_rows = staged(usable(df.select(F.col(id_col).cast("long").alias("vec_id"), vector), vector), "vectors")
    grouped = all_rows.filter("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    distinct = staged(grouped.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    pivots = spark.sparkContext.broadcast(choose_pivots(distinct, distinct.count()))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))  # distance of two linked vectors at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            sizes = np.array([len(r) for r in raw])
            owners, lists, homes, prefixes = [], [], [], []

            def put(at: np.ndarray, codes: np.ndarray, home: np.ndarray, named: list[bytes], size: int) -> None:
                owners.append(at)
                lists.append(codes.astype(np.int64) + int(size) * LENGTH)
                homes.append(home.astype(np.int32))
                prefixes.extend(named)

            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if int(size) not in pivots.value:  # too rare a length to have pivots: one list of its own
                    put(at, np.zeros(len(at)), np.full(len(at), -1), [np.zeros(1, np.int16).tobytes()] * len(at), size)
                    continue
                found, dense = pivots.value[int(size)]
                cosine = unit([raw[i] for i in at]) @ found.T
                home = np.full(len(at), -1)
                if len(dense):
                    d = np.sqrt(np.maximum(0, 2 - 2 * cosine[:, dense]))
                    least = d.min(1)
                    home = np.where(least <= RADIUS, dense[d.argmin(1)], -1)
                    # Of x with home p and y linked with x: d(y, p) <= RADIUS + reach, and <= d(y, q) + 2 reach for any dense q.
                    i, j = np.nonzero(d <= np.minimum(RADIUS + reach, least + 2 * reach)[:, None] + 1e-6)
                    put(at[i], dense[j] + BALL, home[i], [b""] * len(i), size)
                free = np.flatnonzero(home < 0)
                m = min(PREFIX, len(found))
                near = np.sort(np.argsort(-cosine[free], axis=1, kind="stable")[:, :m], axis=1)
                i, j = np.triu_indices(m, 1)
                codes = near[:, i] * PIVOT + near[:, j] if m > 1 else np.zeros((len(free), 1), np.int64)
                put(np.repeat(at[free], codes.shape[1]), codes.ravel(), np.full(codes.size, -1), [p.tobytes() for p in near.astype(np.int16) for _ in range(codes.shape[1])], size)
            own = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(lists)), *(batch.column(i).take(own) for i in (1, 2, 0)), pa.array(np.concatenate(homes)), pa.array(prefixes, pa.binary())],
                ["list", "rep", "copies", "raw", "home", "prefix"],
            )

    entries = distinct.select("raw", "rep", "copies").mapInArrow(describe, "list long, rep long, copies long, raw binary, home int, prefix binary")
    sizes = entries.groupBy("list").count().filter("count > 1")
    # Blocks of a long list: each entry meets the entries of every block, in the task of the two blocks. Lists of one entry drop out.
    blocks = sizes.select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    total = F.broadcast(sizes.filter(F.col("count") <= BLOCK).agg(F.greatest(F.lit(1), F.ceil(F.sum("count") / BUNDLE)).alias("bundles")))  # one row
    placed = entries.join(blocks, "list").crossJoin(total).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    task = F.when(F.col("blocks") > 1, F.xxhash64("list", "lo", "hi")).otherwise(F.pmod(F.xxhash64("list"), F.coalesce("bundles", F.lit(1))))

    def compare(group: pa.Table) -> pa.Table:
        """Links of one bundle of short lists, or of two blocks of a long one."""
        group = group.take(pa.array(np.argsort(group["list"].to_numpy(), kind="stable")))
        lists, rep, copies, home = (group[c].to_numpy() for c in ("list", "rep", "copies", "home"))
        raw, named = group["raw"].to_pylist(), group["prefix"].to_pylist()
        links, kept = np.zeros(len(rep), np.int64), []
        mine, lo, hi = (group[c].to_numpy() for c in ("mine", "lo", "hi"))
        long = group["blocks"].to_numpy() > 1
        # By length of vector, the long lists' blocks apart from the bundle.
        part = np.stack([lists // LENGTH, np.where(long, lists, 0), np.where(long, lo, 0), np.where(long, hi, 0)])
        for at in np.split(np.lexsort(part[::-1]), np.flatnonzero((np.diff(part[:, np.lexsort(part[::-1])]) != 0).any(0)) + 1):
            x = unit([raw[i] for i in at])
            code = lists[at] % LENGTH
            if long[at[0]]:
                own = mine[at]
                left = np.flatnonzero(own == lo[at[0]])
                right = left if lo[at[0]] == hi[at[0]] else np.flatnonzero(own == hi[at[0]])
                pairs = block_pairs(x, left, right, threshold)
            else:
                pairs = list_pairs(x, code, threshold)
            for i, j in pairs:
                ok = first_list(int(code[0]) if long[at[0]] else code[i], home[at], [named[k] for k in at], i, j)
                i, j = at[i[ok]], at[j[ok]]
                if len(i):
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    kept.append((i, j))
        # The least of each component of this task; a vector may stand in several of its lists.
        name, number = np.unique(rep, return_inverse=True)
        least = name.copy()
        while True:
            before = least.copy()
            for i, j in kept:
                p, q = number[i], number[j]
                m = np.minimum(least[p], least[q])
                np.minimum.at(least, p, m)
                np.minimum.at(least, q, m)
            if (before == least).all():
                break
        total = np.zeros(len(name), np.int64)
        np.add.at(total, number, links)
        got = np.flatnonzero(total)
        return pa.table({"rep": pa.array(name[got]), "links": pa.array(total[got]), "least": pa.array(least[got])})

    found = staged(placed.withColumn("task", task).select("task", "list", "lo", "hi", "mine", "blocks", "rep", "copies", "raw", "home", "prefix").groupBy("task").applyInArrow(compare, "rep long, links long, least long"), "vector-links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    named = distinct.join(totals, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = staged(named.join(least, "component").select("raw", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-classes")
    hot = known.filter(F.col("copies") >= max(2, HOT * all_rows.count()))  # 1 / HOT rows at most
    warm = all_rows.filter("raw is not null").join(F.broadcast(hot.select("raw", F.lit(True).alias("hot"))), "raw", "left")
    cold = warm.filter("hot is null").drop("hot").join(known, "raw")
    alone = all_rows.filter("raw is null").withColumn("component_id", F.col("vec_id"))
    joined = cold.unionByName(all_rows.join(F.broadcast(hot), "raw")).unionByName(alone, allowMissingColumns=True)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return joined.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", kept.alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLE = {
    "op4_embedding_dedup": """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least ON least.a = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id
"""
}
