"""The manifest against plain recursion."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from parallax.llm.merkle_manifest import folded, leaf_digest, manifest, op13_merkle_manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, arity):
    """The last node, and for each node its steps (left, right)."""
    steps, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        for i, p in enumerate(at):
            run = now[p - p % arity : p - p % arity + arity]
            steps[i].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
            at[i] = p // arity
        now = [sha(*now[k : k + arity]) for k in range(0, len(now), arity)]
    return now[0], steps


def whole(rows, arity):
    """rows: (tree, id, digest) -> {(tree, id): [(digest, proof, subroot, root)]}, in order."""
    trees = {}
    for tree, i, d in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(tree, []).append((i, d))
    tops = [climb([d for _, d in leaves], arity) for leaves in trees.values()]
    root, upper = climb([t for t, _ in tops], arity)
    out = []
    for (tree, leaves), (subroot, steps), more in zip(trees.items(), tops, upper, strict=True):
        for (i, d), own in zip(leaves, steps, strict=True):
            out.append((tree, i, d, ";".join("|".join(s) for s in own + more), subroot, root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("arity", "band"), [(2, 2), (2, 13), (3, 1)])
def test_manifest_equals_recursion(spark, arity, band):
    # Trees of one, of powers and of other sizes; null trees and ids, equal rows, names that sort bytewise.
    rows = [("a", i) for i in range(9)] + [("B", 5)] + [(None, i) for i in (3, None, 3, 1)] + [("é", i) for i in range(4)] + [("", 1), ("", 1), ("z", 0)] + [("z", i) for i in range(16)]
    df = spark.createDataFrame([(t, i, f"x{i}", "pos") for t, i in rows], "tree string, id long, size string, pos string").repartition(3)
    leaves = df.withColumn("digest", leaf_digest(F.col("id"), F.col("size")))
    got = manifest(leaves, ["id"], ["tree", "id", "pos"], arity, band)
    want = whole([(r.tree, r.id, r.digest) for r in leaves.collect()], arity)
    found = [(r.tree, r.id, r.digest, r.proof, r.subroot, r.root) for r in got.collect()]
    assert sorted(found, key=repr) == want
    assert got.filter(folded(F.col("digest"), F.col("proof")) != F.col("root")).count() == 0


def test_single_leaf_and_empty_table(spark):
    one = spark.createDataFrame([("en", 1)], "tree string, id long").withColumn("digest", leaf_digest(F.col("id")))
    r = manifest(one, ["id"], ["id"]).collect()[0]
    assert (r.proof, r.subroot, r.root) == ("", r.digest, r.digest) and r.digest == sha("1:1")
    assert manifest(one.limit(0), ["id"], ["id"]).count() == 0


def test_query_shows_tampering(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op13_merkle_manifest(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        d = docs[r.doc_id]
        text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        assert r.leaf == sha(*map(text, (d.doc_id, d.source, d.lang, d.n_chars, d.text)))
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or d.n_chars is None)


def test_odd_rows(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, digest string"
    rows = [(None, None, None, None, None, "t", 1, "d"), (7, "", "", "", 0, None, None, None), (7, "", "", "", 0, "t", 1, "d"), (8, "x" * 300_000, "en", "s", 300_000, "t", 1, "d")]
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == 4 and len({r.root for r in got}) == 1
    assert all(r.verified for r in got if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7)
