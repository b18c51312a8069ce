"""Near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from parallax.llm import minhash_dedup
from parallax.llm.minhash_dedup import by_key, near_duplicates, op7_minhash_dedup, set_key
from parallax.llm.shingles import shingles, similar, word_hashes


def plain_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size):
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for hs in holders.values() if len(hs) < 400 for x, a in enumerate(hs) for b in hs[x + 1 :]}
    pairs |= {(a, b) for hs in holders.values() if len(hs) >= 400 for a in hs for b in hs if a < b}
    for a, b in pairs:
        if find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d or 0, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_tables_equal_all_pairs(spark, size):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    described, classes = near_duplicates(docs, size)
    got = sorted((r.doc is None, r.doc or 0, r.n, r.component_id) for r in described.join(classes, "key", "left").selectExpr("doc", "n", "coalesce(component_id, doc) component_id").collect())
    assert got == brute(rows, size)


def test_borderline_family_in_blocks(spark, monkeypatch):
    """Copies that differ so much that most pairs are just below or above the limit, cut into many blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "\t\n "), (503, "One"), (504, "one "), (505, "one two"), (None, rows[3][1]), (7, rows[7][1]), (7, "another text of the same id"), (None, "nobody else has this"), (506, "long " * 30000), (507, "LONG " * 30000)]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, node int")
    described, classes = near_duplicates(docs, 2)
    got = sorted((r.doc is None, r.doc or 0, r.n, r.component_id) for r in described.join(classes, "key", "left").selectExpr("doc", "n", "coalesce(component_id, doc) component_id").collect())
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, 2), key=key)
    described, classes = near_duplicates(docs.limit(0), 2)
    assert described.count() == classes.count() == 0


def test_word_hashes_in_pieces(monkeypatch):
    from parallax.llm import shingles

    text = b"  Alpha beta\tGAMMA\x0b delta\xc3\xa9 \x1c x" * 50
    whole = word_hashes(text)
    assert len(whole) == len(text.split()) and len(np.unique(whole)) == len(set(text.lower().split()))
    monkeypatch.setattr(shingles, "PIECE", 37)
    assert (word_hashes(text) == whole).all()


def test_query(spark, sf_dir):
    got = op7_minhash_dedup(spark, sf_dir).toPandas()
    assert list(got.columns) == ["doc_id", "n_shingles", "component_id", "kept"]
    assert (got.kept == (got.doc_id == got.component_id)).all() and len(got) == 200


def test_sql_gives_the_same_rows(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(minhash_dedup.ORACLE["op7_minhash_dedup"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in op7_minhash_dedup(spark, sf).collect())


def test_a_third_of_ids_null_and_one_id_with_many_texts(spark):
    rng = random.Random(12)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            words[rng.randrange(60)] = rng.choice("klmn")
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    described, classes = near_duplicates(df, 2)
    found = {(r.doc, bytes(r.key)): r.group for r in by_key(described, classes).collect()}
    sets = [shingles(t.encode(), 2) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j], 80):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    mine = [found[d, set_key(s)] for (d, _), s in zip(rows, sets, strict=True)]
    assert all((mine[i] == mine[j]) == (group[i] == group[j]) for i in range(len(rows)) for j in range(i))
