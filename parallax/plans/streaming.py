"""Queries that write first and read again: streams run to their end, and landed record files. Their SQL is that of the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parallax.plans.quality import VOTES
from parallax.sources.adapters import ACTORS, BIAS, STATEMENTS, read
from parallax.sources.landing import land_documents
from parallax.streaming import streams

TTL = 7 * 86400


def _folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; the warehouse where none is set."""
    return spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")


def stream_landing(s, d):
    docs = streams.read_stream(s, f"{d}/documents.parquet")
    items = docs.select(F.col("lang").alias("source_name"), F.concat(F.lit("https://x/"), F.md5("text")).alias("url"), F.substring("text", 1, 80).alias("title"))
    path = f"{_folder(s).rstrip('/')}/landed-{uuid.uuid4().hex}"
    streams.land_new(items, f"{path}/table", f"{path}/checkpoint", ["url", "title"]).awaitTermination()
    return s.read.parquet(f"{path}/table").select("source_name", "hash")


def stream_votes(s, d):
    votes = streams.read_stream(s, f"{d}/events.parquet").filter(F.col("event_type").isin("click", "view", "signup"))
    counted = streams.stream_vote_tally(votes.select(F.col("event_type").alias("slug"), F.col("user_id").cast("string").alias("ip"), "ts"), TTL)
    return streams.run_to_table(counted, _folder(s)).groupBy("slug").agg(F.count("*").alias("votes"))


def stream_density(s, d):
    """Windows of seven days that end with 2024-01-30; the last one stays open, so that it isn't given out."""
    e = streams.read_stream(s, f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    bias = F.coalesce(*[F.when((F.col("event_type") == t) & (F.col("user_id") % 3 == i), b) for t, bs in BIAS.items() for i, b in enumerate(bs)], F.lit(0))
    rows = e.select(F.col("ts").cast("timestamp").alias("ts"), F.element_at(F.array(*map(F.lit, ACTORS)), (F.col("user_id") % 3 + 1).cast("int")).alias("actor"), F.col("event_type").alias("topic"), F.greatest(F.lit(-2), F.least(F.lit(2), k % 5 - 2 + bias)).cast("int").alias("score"))
    # 2024-01-24 is 19,746 days past the epoch, and 19,746 = 6 (mod 7).
    return streams.run_to_table(streams.stream_density(rows, "1 day", "6 days"), _folder(s)).filter("start <= date'2024-01-17'")


def land_docs(s, d):
    """Documents written as record files of 500 at most, and landed again."""
    path = f"{_folder(s).rstrip('/')}/records-{uuid.uuid4().hex}"
    rows = read(s, d, "documents").select(F.floor(F.col("doc_id") / 500).alias("part"), F.struct("doc_id", "lang", "source", "n_chars").alias("doc"))
    files = rows.groupBy("part").agg(F.collect_list("doc").alias("docs")).select(F.to_json(F.struct("part", "docs")).alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)
    landed, _ = land_documents(s, path, "part bigint, docs array<struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>>", "*.txt")
    return landed.select(F.explode("docs").alias("doc")).select("doc.*")


QUERIES = {"land_docs": land_docs, "stream_landing": stream_landing, "stream_vote_tally": stream_votes, "stream_density": stream_density}
ORACLE = {
    "land_docs": "SELECT doc_id, lang, source, n_chars FROM documents",
    "stream_landing": "SELECT DISTINCT lang AS source_name, substring(sha256('https://x/' || md5(text) || substring(text, 1, 80)), 1, 8) AS hash FROM documents",
    "stream_vote_tally": f"WITH RECURSIVE {VOTES} SELECT * FROM tally",
    "stream_density": f"WITH {STATEMENTS}, b AS (SELECT CAST(DATE '2024-01-24' - CAST(7 * ceil(date_diff('day', date, DATE '2024-01-24') / 7) AS INT) AS DATE) AS start, actor, topic, score FROM statements) SELECT start, actor, topic, score, count(*) AS n FROM b WHERE start <= DATE '2024-01-17' GROUP BY ALL",
}
