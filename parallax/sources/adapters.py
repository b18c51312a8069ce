"""Domain tables over the warehouse tables: each as a DataFrame, and as the SQL that defines it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2024, 1, 30)
ACTORS = ["DE", "FR", "PL"]
TOPICS = ["click", "error", "purchase", "signup", "view"]
#: Added to a statement's score, by topic, for DE, FR and PL.
BIAS = {"click": (2, 2, 2), "error": (0, 0, 0), "purchase": (-1, -1, -1), "signup": (0, 1, 1), "view": (-1, 2, 0)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_dim(spark: SparkSession) -> DataFrame:
    """Source -> actor; six sources, two of each actor."""
    return spark.createDataFrame([(i, ACTORS[i % 3], "ministry" if i < 3 else "executive") for i in range(6)], "source long, actor string, institution string")


def topic_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(TOPICS)], "topic string, topic_rank int")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, date, source, actor, topic, score, url, k) from events."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.col("user_id") % 6
    actor = F.element_at(F.array(*map(F.lit, ACTORS)), (source % 3 + 1).cast("int"))
    bias = F.coalesce(*[F.when((F.col("event_type") == t) & (source % 3 == i), b) for t, bs in BIAS.items() for i, b in enumerate(bs)], F.lit(0))
    score = F.greatest(F.lit(-2), F.least(F.lit(2), k % 5 - 2 + bias))
    url = F.concat(F.lit("https://x/"), (F.col("user_id") % 40).cast("string"))
    return e.select("event_id", F.to_date("ts").alias("date"), source.alias("source"), actor.alias("actor"), F.col("event_type").alias("topic"), score.cast("int").alias("score"), url.alias("url"), k.alias("k"))


_BIAS_SQL = " ".join(f"WHEN event_type = '{t}' AND user_id % 3 = {i} THEN {b}" for t, bs in BIAS.items() for i, b in enumerate(bs))
STATEMENTS = f"""
statements AS (
  SELECT event_id, CAST(ts AS DATE) AS date, user_id % 6 AS source,
    CASE user_id % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' ELSE 'PL' END AS actor, event_type AS topic,
    CAST(greatest(-2, least(2, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) % 5 - 2 + CASE {_BIAS_SQL} ELSE 0 END)) AS INT) AS score,
    'https://x/' || CAST(user_id % 40 AS VARCHAR) AS url, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k
  FROM events)"""

def groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, members, topics): nations by key modulo 8; brands by number modulo 8, as tracked topics."""
    members = read(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 8).alias("key")).agg(F.array_sort(F.collect_set("n_name")).alias("members"))
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    topics = read(spark, sf_dir, "part").groupBy((brand % 8).alias("key")).agg(F.array_sort(F.collect_set("p_brand")).alias("topics"))
    return members.join(topics, "key", "left").select(F.concat(F.lit("g"), F.col("key").cast("string")).alias("grouping"), "members", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


GROUPINGS = """
grouping_member AS (SELECT 'g' || CAST(n_nationkey % 8 AS VARCHAR) AS grouping_key, n_name AS member FROM nation),
grouping_topic AS (SELECT DISTINCT 'g' || CAST(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 8 AS VARCHAR) AS grouping_key, p_brand AS topic FROM part
  WHERE 'g' || CAST(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 8 AS VARCHAR) IN (SELECT grouping_key FROM grouping_member))"""


def taggings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, source_country, actors, formats, topics): an order with its customer's nation, its suppliers' nations and its parts' brands."""
    nation = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows at every scale
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").select("l_suppkey", "n_name")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # Dealt out first, so that sets, of few lines each, aren't begun and sorted before the shuffle.
    tags = line.join(supplier, "l_suppkey").join(part, "l_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("n_name")).alias("actors"), F.array_sort(F.collect_set("p_brand")).alias("topics"))
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").select("o_custkey", F.col("n_name").alias("source_country"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, "o_custkey")
    formats = F.when(F.col("o_orderkey") % 50 == 0, F.array(F.concat(F.lit("g"), (F.col("o_orderkey") % 8).cast("string")))).otherwise(F.array().cast("array<string>"))
    return orders.join(tags, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("event"), "source_country", "actors", formats.alias("formats"), "topics")


TAGGINGS = """
tag_actor AS (SELECT DISTINCT l_orderkey AS event, n_name AS actor FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey),
tag_topic AS (SELECT DISTINCT l_orderkey AS event, p_brand AS topic FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey),
tag_event AS (SELECT o_orderkey AS event, n_name AS source_country, CASE WHEN o_orderkey % 50 = 0 THEN 'g' || CAST(o_orderkey % 8 AS VARCHAR) END AS format
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey IN (SELECT event FROM tag_actor))"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, grouping, topic, score, evidence): each statement under two groupings; evidence is missing where k is a multiple of 7."""
    s = statements(spark, sf_dir)
    evidence = F.when(F.col("k") % 7 == 0, F.lit(None)).when(F.col("k") % 11 == 0, F.lit("back the goal of view")).otherwise(F.concat(F.lit("quote "), F.col("k").cast("string")))
    return s.withColumn("grouping", F.explode(F.array(F.lit("a"), F.lit("b")))).select(F.col("event_id").alias("event"), "grouping", "topic", F.when(F.col("grouping") == "b", -F.col("score")).otherwise(F.col("score")).alias("score"), evidence.alias("evidence"))


RATINGS = STATEMENTS + """,
ratings AS (SELECT event_id AS event, g.grouping_key, topic, CASE WHEN g.grouping_key = 'b' THEN -score ELSE score END AS score,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'back the goal of view' ELSE 'quote ' || CAST(k AS VARCHAR) END AS evidence
  FROM statements, (VALUES ('a'), ('b')) g(grouping_key))"""


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_name, url, title, text, doc_id): documents as landed items; copies of a text share url and title."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("source_name"), F.concat(F.lit("https://x/"), F.md5("text")).alias("url"), F.substring("text", 1, 80).alias("title"), "text", "doc_id")


RAW_ITEMS = """
raw_items AS (SELECT lang AS source_name, 'https://x/' || md5(text) AS url, substring(text, 1, 80) AS title, text, doc_id FROM documents)"""
