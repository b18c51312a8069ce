"""The stages one after the other, each against a plain version on its own input."""

import corpus_pipeline
from tests.llm.test_decontamination import plain_distance, plain_words
from tests.llm.test_minhash_dedup import brute
from tests.llm.test_pii import plain


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
        seen[name] = before, docs.collect()
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    assert 0.8 * len(before) < len(after) <= len(before)
    before, after = seen["near_duplicates"]
    assert sorted(r.doc_id for r in after) == sorted(d for _, d, _, c in brute(list(before.items()), 5) if c == d)
    before, after = seen["decontamination"]
    items = [w for w in (plain_words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())]
    verbatim = {d for d, t in before.items() for w in items if " ".join(w) in " ".join(plain_words(t))}
    dropped = set(before) - {r.doc_id for r in after}
    assert verbatim <= dropped
    for d in dropped - verbatim:
        assert any(plain_distance(w, plain_words(before[d])) <= 0.15 * len(w) for w in items)
    before, after = seen["personal_data"]
    assert len(before) == len(after)
    for r in after:
        assert plain(r.text) == [] and r.n_chars == len(r.text)
        if not any(c in before[r.doc_id] for c in "0123456789@"):
            assert r.text == before[r.doc_id]
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == set(before)
    assert sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())


def test_keep_one_of_odd_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (2, text.upper()), (3, None), (4, ""), (4, ""), (None, "x y z v w u"), (None, text), (5, "x y z v w u t"), (6, "other words here")]
    df = spark.createDataFrame([(d, t, "k", None) for d, t in rows], "doc_id long, text string, key string, node int")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, text), (3, ""), (4, ""), (4, ""), (0, "x y z v w u"), (5, "x y z v w u t"), (6, "other words here")])
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


ODD = ["matches", "base", "spans", "score", "_text", "row", "key", "id", "uid", "masked", "a.b", "again", "first"]


def test_stages_carry_columns_of_any_name(spark, sf_dir):
    """Names that the stages use themselves, with repeated rows, null ids, null and empty texts, and a long one; and no rows at all."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "write to a.b@c.org now"), (9003, "word " * 60_000), (9003, "word " * 60_000)], "doc_id long, text string")
    docs = base.unionByName(odd, allowMissingColumns=True)
    for n in ODD:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
        if name == "packing":
            break
        assert docs.columns == [*base.columns, *ODD], name
        rows = docs.collect()
        assert all(r[n] == f"own {n}" for r in rows for n in ODD), name
        ids = [r.doc_id for r in rows]
        assert {9001, 9002, None} <= set(ids) and ids.count(9003) == (2 if name == "toxicity" else 1), name
    whole = {r.doc_id: r.doc_tokens for r in docs.collect()}
    assert whole[9001] == whole[9002] == 1 and sum(r.length for r in docs.collect()) >= sum(whole.values())
