"""Merkle manifest of a dataset by time-forward processing.

Each row is a leaf: the SHA-256, in small hex digits, of its fields, each written as its UTF-8 length and value. The leaves of a tree (a
language) stand in order; every ARITY consecutive nodes have one parent, the digest of theirs, until one node is left, the subroot. The
subroots, in the order of their trees, are the leaves of one more tree, whose last node is the root. A leaf's proof holds, level by level
up to the root, the digests to its left and right in its run: whoever has the leaf and the proof can recompute the root.

Nodes are numbered level by level, so that each digest is a message to a node of a greater number. The messages pass through an external
priority queue in order of that number. Its far part is a table in the shared folder, cut into bands of BAND levels and into blocks of
ARITY ** BAND neighbouring nodes; its near part is a heap that holds the messages of one block. A band's blocks are separate tasks: a
task takes messages from its heap in order, digests those that are for the same node, and puts the result back, until one digest leaves
the block for the next band. A second sweep runs the other way, from the root down: a node that has the upper part of the proof (its
suffix) hands it to each child with the child's own siblings before it. No task holds more than a block, whatever the size of a tree;
a lost executor costs a band at most.

Null fields are `-`. Leaves stand by id (null first), then by digest, so that repeated rows and ids have a defined order; equal rows are
leaves of their own. A null tree comes first, before the others by their UTF-8 bytes. A single leaf is its own subroot, and a single
subroot the root. An empty table has no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import crc_mod, named, staged, table

ARITY, BAND = 2, 13


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, digest, ...) with pos, the place in its tree by `order`, and size, the leaves of the tree. Sorted by ranges: what is
    summed up for each tree is one row for each range that it lies in."""
    sorted_ = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = staged(sorted_.withColumn("_at", F.monotonically_increasing_id()), "manifest-order").withColumn("_part", F.shiftright("_at", 33))
    ranges = at.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    return at.join(ranges, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _levels(size: int, arity: int, band: int) -> int:
    """How many levels of a tree of `size` nodes a block has: those up to the last node, or a whole band."""
    n = 0
    while size > 1 and n < band:
        size, n = -(-size // arity), n + 1
    return n


def _forward(pos: list[int], digests: list[str], levels: int, arity: int) -> tuple[str, dict[tuple[int, int], list[tuple[int, str]]]]:
    """The digest that leaves the block, and what came to each node (level, number): its children's numbers and digests."""
    if not levels:
        return digests[0], {}
    # A message: the node it is for, the child it comes from, the child's digest.
    queue = [(1, p // arity, p, d) for p, d in zip(pos, digests, strict=True)]
    heapify(queue)
    came: dict[tuple[int, int], list[tuple[int, str]]] = {}
    while True:
        level, node = queue[0][:2]
        children = came[level, node] = []
        while queue and queue[0][0] == level and queue[0][1] == node:
            _, _, child, digest = heappop(queue)
            children.append((child, digest))
        digest = hashlib.sha256("".join(d for _, d in children).encode()).hexdigest()
        if level == levels:
            return digest, came
        heappush(queue, (level + 1, node // arity, node, digest))


def _backward(pos: list[int], suffix: str, came: dict, levels: int, arity: int) -> list[str]:
    """The proof of each leaf of the block, from the suffix that comes to the block's last node."""
    if not levels:
        return [suffix]
    found: dict[int, str] = {}
    queue = [(-levels, -(pos[0] // arity**levels), suffix)]
    while queue:
        level, node, upper = heappop(queue)
        children = came[-level, -node]
        for k, (child, _) in enumerate(children):
            step = "".join(d for _, d in children[:k]) + "|" + "".join(d for _, d in children[k + 1 :])
            path = f"{step};{upper}" if upper else step
            if level == -1:
                found[child] = path
            else:
                heappush(queue, (level + 1, -child, path))
    return [found[p] for p in pos]


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by("pos")


def up(nodes: DataFrame, arity: int, band: int) -> DataFrame:
    """The messages that a band's blocks send to the next band: (tree, pos, size, digest)."""
    width = arity**band

    def run(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        pos, size = group["pos"].to_pylist(), group["size"][0].as_py()
        digest, _ = _forward(pos, group["digest"].to_pylist(), _levels(size, arity, band), arity)
        return pa.table({"tree": [group["tree"][0].as_py()], "pos": [pos[0] // width], "size": [-(-size // width)], "digest": [digest]})

    blocks = nodes.select("tree", "pos", "size", "digest", F.floor(F.col("pos") / width).alias("_block"))
    return blocks.groupBy("tree", "_block").applyInArrow(run, "tree string, pos long, size long, digest string")


def down(nodes: DataFrame, above: DataFrame, carried: list[str], arity: int, band: int) -> DataFrame:
    """The carried columns of nodes with their proof, and all of above but its place: above has (tree, pos, proof, ...) of the next band."""
    width = arity**band
    extra = [c for c in above.columns if c not in ("tree", "pos", "proof")]
    shape = StructType([*(nodes.schema[c] for c in carried), StructField("proof", StringType()), *(above.schema[c] for c in extra)])

    def run(group: pa.Table, roots: pa.Table) -> pa.Table:
        group = _sorted(group)
        pos, size = group["pos"].to_pylist(), group["size"][0].as_py()
        levels = _levels(size, arity, band)
        _, came = _forward(pos, group["digest"].to_pylist(), levels, arity)
        proofs = _backward(pos, roots["proof"][0].as_py(), came, levels, arity)
        n = len(pos)
        columns = {c: group[c] for c in carried} | {"proof": pa.array(proofs, pa.string())}
        return pa.table(columns | {c: pa.array([roots[c][0].as_py()] * n, roots[c].type) for c in extra})

    blocks = nodes.withColumn("_block", F.floor(F.col("pos") / width)).groupBy("tree", "_block")
    return blocks.cogroup(above.withColumnRenamed("pos", "_block").groupBy("tree", "_block")).applyInArrow(run, shape)


def bands(nodes: DataFrame, arity: int, band: int) -> list[DataFrame]:
    """The messages of each band, lowest first; in the last each tree is one node."""
    out = [nodes]
    while not out[-1].filter("size > 1").isEmpty():
        out.append(staged(up(out[-1], arity, band), "manifest-queue"))
    return out


def proofs(levels: list[DataFrame], top: DataFrame, carried: list[str], arity: int, band: int) -> DataFrame:
    """The carried columns of the lowest nodes, their proof, and the other columns of top, which has (tree, pos, proof, ...) of the last
    node of each tree."""
    above = top
    for k in range(len(levels) - 2, -1, -1):
        last = k == 0
        above = down(levels[k], above, carried if last else ["tree", "pos"], arity, band)
        above = above if last else staged(above, "manifest-proof")
    if len(levels) == 1:
        above = levels[0].select("tree", *[c for c in carried if c != "tree"]).join(top.drop("pos"), "tree").select(*carried, "proof", *[c for c in top.columns if c not in ("tree", "pos", "proof")])
    return above


def manifest(leaves: DataFrame, order: list[str], carried: list[str], arity: int = ARITY, band: int = BAND) -> DataFrame:
    """From leaves (tree, digest, ...): their `carried` columns, digest, proof, subroot and root.

    tree is the name of a leaf's tree, or null; `order` are the columns by which its leaves stand. A proof has a step for each level, parted
    by `;`: the digests to the left in the run, `|`, those to the right; it is empty where leaf, subroot and root are one.
    """
    keep = list(dict.fromkeys([*carried, "digest"]))
    # A null tree, which comes first, is the empty name; the others get a mark before theirs.
    tree = F.when(F.col("tree").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("tree").cast("string")))
    own = F.struct(*map(named, keep)).alias("_own")
    rows = leaves.select(tree.alias("tree"), named("digest").alias("digest"), own, *[named(c).alias(f"_o{i}") for i, c in enumerate(order)])
    # Equal rows have an order of their own, so that a range of any number of them can be split.
    rows = staged(rows.withColumn("_turn", F.monotonically_increasing_id()), "manifest-leaves")
    places = [f"_o{i}" for i in range(len(order))] + ["digest", "_turn"]
    low = bands(staged(placed(rows, places).select("tree", "pos", "size", "digest", "_own"), "manifest-queue"), arity, band)
    subroots = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest"))
    high = bands(staged(placed(subroots, ["name"]), "manifest-queue"), arity, band)
    root = high[-1].select("tree", "pos", F.lit("").alias("proof"), F.col("digest").alias("root"))
    of = proofs(high, root, ["name", "digest"], arity, band)
    top = staged(of.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root"), "manifest-proof")
    found = proofs(low, top, ["_own"], arity, band)
    return found.select(*[F.col("_own").getField(c).alias(c) for c in keep], "proof", "subroot", "root")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    step = lambda acc, s: F.sha2(F.concat(F.substring_index(s, "|", 1), acc, F.substring_index(s, "|", -1)), 256)
    return F.when(proof == "", leaf).otherwise(F.aggregate(F.split(proof, ";"), leaf, step))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    count = F.col("n_chars").cast("decimal(20,0)")
    of = lambda n: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.when((crc_mod("doc_id", 7) == 0) & count.isNotNull(), of(count + 1)).otherwise(F.col("digest"))
    leaves = docs.withColumn("digest", of(count)).select(F.col("lang").alias("tree"), "doc_id", "digest", tampered.alias("tampered"))
    found = manifest(leaves, ["doc_id"], ["doc_id", "tampered"]).withColumn("folded_root", folded(F.col("tampered"), F.col("proof")))
    digest = F.sha2(F.translate("proof", "|;", ""), 256).alias("proof_sha256")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END)"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
ORACLE = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF("n_chars")} AS leaf,
  CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_LEAF("(n_chars + 1)")} END AS bad FROM documents),
leaves AS (SELECT doc_id, tree, leaf, coalesce(bad, leaf) AS bad, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos FROM t),
low(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, pos // 2),
sub AS (SELECT tree, digest AS subroot, level AS levels, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low WHERE n = 1),
high(level, pos, digest, n) AS (
  SELECT 0, pos, subroot, (SELECT count(*) FROM sub) FROM sub
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2),
top AS (SELECT digest AS root, level AS levels FROM high WHERE n = 1),
steps AS (SELECT tree, level, pos, digest FROM low WHERE n > 1
  UNION ALL SELECT s.tree, s.levels + h.level, h.pos, h.digest FROM high h, sub s WHERE h.n > 1),
path(doc_id, tree, level, pos, proof, digest) AS (
  SELECT doc_id, tree, 0, pos, '', bad FROM leaves
  UNION ALL SELECT p.doc_id, p.tree, p.level + 1,
    CASE WHEN p.level + 1 = s.levels THEN s.pos ELSE p.pos // 2 END, p.proof || coalesce(o.digest, ''),
    sha256(CASE WHEN p.pos % 2 = 1 THEN coalesce(o.digest, '') || p.digest ELSE p.digest || coalesce(o.digest, '') END)
  FROM path p JOIN sub s ON s.tree = p.tree CROSS JOIN top LEFT JOIN steps o ON o.tree = p.tree AND o.level = p.level AND o.pos = xor(p.pos, 1)
  WHERE p.level < s.levels + top.levels)
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(p.proof) AS proof_sha256, p.digest AS folded_root, p.digest = top.root AS verified
FROM leaves l JOIN sub s ON s.tree = l.tree CROSS JOIN top JOIN path p ON p.doc_id = l.doc_id AND p.level = s.levels + top.levels
"""
}
