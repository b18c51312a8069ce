"""The audit against a comparison record by record, and that it descends only where roots differ."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from parallax.llm import warc_fixity
from parallax.llm.warc_fixity import LEVELS, ORACLE, RANGE, audit, catalogue, digests, leaves, op3_warc_fixity, tree, warc_record


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(ORACLE["op3_warc_fixity"])
    names = [d[0] for d in want.description]
    got = op3_warc_fixity(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall()) != []


def test_odd_records(spark):
    first = [(1, "u", "a" * 70_000), (2, None, None), (3, "u", ""), (3, "u", "x"), (None, "u", "n"), (4, "ü", "é" * 200_000), (700, "u", "other file")] + [(i, "u", f"page {i}" * 50) for i in range(10, 400)]
    second = [r if r[0] != 20 else (20, "u", "damaged") for r in first if r[0] not in (30, None)] + [(5, "new", "extra")]
    schema = "page_id long, url string, html string, digest string, file long"
    a, b = (digests(spark.createDataFrame([(*r, "k", 1) for r in rows], schema)) for rows in (first, second))
    listed = catalogue(a)
    found = audit(leaves(listed, a), leaves(listed, b)).collect()
    assert sorted((r.id or 0, r.problem) for r in found) == [(0, "missing"), (5, "extra"), (20, "changed"), (30, "missing")]
    assert audit(leaves(listed, a), leaves(listed, a)).count() == 0
    none = digests(spark.createDataFrame([], schema))
    assert audit(leaves(catalogue(none), none), leaves(catalogue(none), none)).count() == 0
    assert audit(leaves(listed, a), leaves(listed, none)).count() == len(first)


def test_tree_by_hand(spark):
    rows = [(0, 0, 1, "aa"), (0, 10, 2, "bb"), (0, RANGE + 3, 3, "cc")]
    levels = tree(spark.createDataFrame(rows, "file long, offset long, id long, digest string"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    low = {0: sha("0:aa,10:bb"), 1: sha(f"{RANGE + 3}:cc")}
    assert {r.node: r.digest for r in levels[0].collect()} == low
    top = sha(f"0:{low[0]},1:{low[1]}")
    assert levels[1].first().digest == top
    for level in levels[2:]:
        top = sha(f"0:{top}")
        assert [(r.node, r.digest) for r in level.collect()] == [(0, top)]
    assert len(levels) == LEVELS + 1
    text = spark.range(1).select(warc_record(F.lit("http://x"), F.lit("é")).alias("t")).first().t
    assert text == "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://x\r\nContent-Length: 2\r\n\r\né\r\n\r\n"
    assert warc_fixity.FILE_RECORDS == 500
