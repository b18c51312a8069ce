"""Fixity audit of WARC replicas by Merkle trees over records and offset ranges.

A catalogue gives each record's file, offset and length. The digest of a record is the SHA-256 of its bytes, taken where the record is
read; only digests travel. Leaves are records; above them stand ranges of RANGE bytes of a file, then ranges FANOUT times as long, up to
the file's root, each node hashing its children's places and digests in their order. Two replicas are compared root by root, and only
the children of nodes that differ are looked at next, down to the records. A record is `changed`, `missing` from the second replica, or
`extra` in it.

Null payloads and addresses count as empty. Records without an id are kept in LOOSE_FILES files of their own, numbered below zero, by their
address, so that no file holds all of them; records that share an id in a file keep their order by digest, and are compared in that
order. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

RANGE, FANOUT, LEVELS = 65_536, 16, 4
#: Records of a WARC file.
FILE_RECORDS = 500
LOOSE_FILES = 4096


def warc_record(url: Column, payload: Column) -> Column:
    """The bytes of a response record, as UTF-8."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, id, turn, length, digest): turn numbers the records of one id in a file by their digest."""
    record = warc_record(F.col(url_col).cast("string"), F.col(payload_col).cast("string"))
    rows = pages.select(F.coalesce(F.floor(F.col(id_col).cast("long") / file_records), -1 - F.pmod(F.xxhash64(F.coalesce(F.col(url_col).cast("string"), F.lit(""))), F.lit(LOOSE_FILES))).alias("file"), F.col(id_col).cast("long").alias("id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("file", "id").orderBy("digest")))


def catalogue(found: DataFrame) -> DataFrame:
    """(file, id, turn, offset, length): records of a file one after the other, by id and turn."""
    before = Window.partitionBy("file").orderBy("id", "turn").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("file", "id", "turn", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length")


def leaves(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(file, offset, id, digest): a replica's records at their places; those that the catalogue doesn't have come behind it."""
    a = listed.withColumn("_id", F.coalesce("id", F.lit(-(1 << 62)))).drop("id", "length")
    b = found.select("file", F.coalesce("id", F.lit(-(1 << 62))).alias("_id"), "turn", "digest")
    j = b.join(a, ["file", "_id", "turn"], "left")
    behind = F.lit(1 << 50) + F.pmod(F.xxhash64("_id", "turn"), F.lit(1 << 49))
    return j.select("file", F.coalesce("offset", behind).alias("offset"), F.when(F.col("_id") != -(1 << 62), F.col("_id")).alias("id"), "digest")


def tree(records: DataFrame) -> list[DataFrame]:
    """The levels above the records, lowest first: (file, node, digest)."""
    out = []
    below = records.select("file", F.floor(F.col("offset") / RANGE).alias("node"), F.col("offset").alias("place"), "digest")
    for level in range(LEVELS + 1):
        # A node has FANOUT children, or as many records as fit a range.
        children = F.array_sort(F.collect_list(F.struct("place", "digest")))
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["place"].cast("string"), c["digest"])), ",")
        nodes = below.groupBy("file", "node").agg(F.sha2(text, 256).alias("digest"))
        out.append(nodes)
        up = F.floor(F.col("node") / FANOUT) if level < LEVELS - 1 else F.lit(0).cast("long")
        below = nodes.select("file", up.alias("node"), F.col("node").alias("place"), "digest")
    return out


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ, or that one side lacks."""
    j = a.select(*keys, F.col("digest").alias("_a")).join(b.select(*keys, F.col("digest").alias("_b")), keys, "full_outer")
    return j.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, offset, id, problem) from the leaves of two replicas."""
    trees = [[staged(x, "merkle") for x in tree(r)] for r in (first, second)]
    suspect = differing(trees[0][-1], trees[1][-1], ["file", "node"])
    for level in range(LEVELS - 1, -1, -1):
        up = F.floor(F.col("node") / FANOUT) if level < LEVELS - 1 else F.lit(0).cast("long")
        parents = suspect.select("file", F.col("node").alias("_up"))
        a, b = (t[level].withColumn("_up", up).join(parents, ["file", "_up"], "left_semi") for t in trees)
        suspect = staged(differing(a, b, ["file", "node"]), "suspect")
    parents = suspect.select("file", F.col("node").alias("_up"))
    a, b = (r.withColumn("_up", F.floor(F.col("offset") / RANGE)).join(parents, ["file", "_up"], "left_semi") for r in (first, second))
    j = a.select("file", "offset", F.col("id").alias("_ia"), F.col("digest").alias("_a")).join(b.select("file", "offset", F.col("id").alias("_ib"), F.col("digest").alias("_b")), ["file", "offset"], "full_outer")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed")
    return j.select("file", "offset", F.coalesce("_ia", "_ib").alias("id"), problem.alias("problem")).filter("problem is not null")


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A second replica of pages with known damage: one character of some payloads, and some records gone."""
    html = F.when(F.col("page_id") % 61 == 7, F.overlay("html", F.lit("~"), F.lit(10), F.lit(1))).otherwise(F.col("html"))
    return pages.filter("page_id is null or page_id % 97 <> 11").withColumn("html", html)


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = staged(digests(pages), "digests")
    listed = staged(catalogue(found), "catalogue")
    second = staged(leaves(listed, digests(damaged_copy(pages))), "leaves")
    return audit(staged(leaves(listed, found), "leaves"), second).select(F.col("id").alias("page_id"), "file", "offset", "problem")


QUERIES = {"op3_warc_fixity": op3_warc_fixity}
ORACLE = {
    "op3_warc_fixity": f"""
WITH r AS (SELECT page_id, CAST(floor(page_id / {FILE_RECORDS}) AS BIGINT) AS file, html,
  strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 8 + strlen(coalesce(html, '')) AS length FROM pages),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT page_id, file, "offset", CASE WHEN page_id % 97 = 11 THEN 'missing' ELSE 'changed' END AS problem FROM o
WHERE page_id % 97 = 11 OR (page_id % 61 = 7 AND substring(html, 10, 1) <> '~')
"""
}
