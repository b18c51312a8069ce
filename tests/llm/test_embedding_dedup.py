"""Vector links against all pairs, and components against a plain search."""

import random

import numpy as np

from parallax.llm.components import connected_components
from parallax.llm.embedding_dedup import link_vectors, op4_embedding_dedup


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ok = [(i, v / np.abs(v).max()) for i, v in ok]
    links = {k: set() for k in range(len(rows))}
    at = [k for k, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for x, (_, a) in enumerate(ok):
        for y, (_, b) in enumerate(ok[:x]):
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[at[x]].add(at[y])
                links[at[y]].add(at[x])
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            n = todo.pop()
            new = links[n] - seen
            seen |= new
            todo += new
        c = min(rows[s][0] for s in seen)
        out.append((i, len(links[k]), c, i == c))
    return sorted(out)


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in op4_embedding_dedup(spark, sf_dir).collect())
    assert got == brute(rows)


def test_odd_vectors(spark, monkeypatch):
    from parallax.llm import embedding_dedup

    rng = np.random.default_rng(2)
    rows = [(0, None), (1, []), (2, [0.0] * 8), (3, [1.0, None] + [0.0] * 6), (4, [float("nan")] * 8), (5, [float("inf")] + [1.0] * 7), (6, [1e-300] * 8), (7, [1e300] * 8), (8, [1.0, 2.0])]
    for k in range(9, 150):
        base = rng.standard_normal(8) if k % 5 == 4 else base + 0.1 * rng.standard_normal(8)
        rows.append((k, [float(x) for x in base]))
    rows += [(k, rows[20][1]) for k in range(200, 240)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, raw string")
    monkeypatch.setattr(embedding_dedup, "VECTORS_A_PIVOT", 8)
    assert sorted(tuple(r) for r in link_vectors(df).collect()) == brute(rows)
    assert link_vectors(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sql_gives_the_same_rows(spark, sf_dir):
    import duckdb

    from parallax.llm.embedding_dedup import ORACLE

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(ORACLE["op4_embedding_dedup"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in op4_embedding_dedup(spark, sf_dir).collect())


def near_copies(n, group, noise, seed=6):
    """n vectors of 64 components, of which `group` are a common one with noise of that length."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64)) / 8
    x[:group] = rng.standard_normal(64) / 8 + noise * x[:group]
    return x[rng.permutation(n)]


def degrees(x, threshold=0.95):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.concatenate([(u[a : a + 2000] @ u.T >= threshold).sum(1) - 1 for a in range(0, len(u), 2000)])


def test_every_link_of_a_dense_group(spark):
    import pyarrow as pa

    for noise in (0.17, 0.24):  # cosines of about 0.97 and 0.945
        x = near_copies(9000, 3000, noise)
        df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
        got = {r.vec_id: r.n_links for r in link_vectors(df).collect()}
        assert [got[i] for i in range(len(x))] == degrees(x).tolist()


def test_null_ids_link_as_others_do(spark):
    one, two = [1.0, 0.5, 0.25, 0.0], [0.0, 1.0, 0.0, 2.0]
    rows = [(None, one), (None, one), (None, two), (7, two), (9, None), (None, None)]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, None, True)] * 2 + [(None, 1, 7, False), (7, 1, 7, True), (9, 0, 9, True), (None, 0, None, True)], key=str)


def test_one_very_common_vector(spark):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16))
    x[::3] = x[0]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(df).collect()}
    assert [got[i][0] for i in range(len(x))] == degrees(x).tolist() and all(got[i][1] == 0 for i in range(0, 3000, 3))
