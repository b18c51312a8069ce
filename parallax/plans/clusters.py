"""Queries of the clusters, with their SQL (a recursive walk over each topic's dates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax.functions.columns import agreement_sql, half_up_sql
from parallax.operators import cluster, stance
from parallax.plans.analytics import WEEKLY
from parallax.sources.adapters import ACTORS, AS_OF, STATEMENTS, source_dim, statements, topic_dim

WINDOW = 2
#: An area is a topic and a number, so that its clusters end and restart inside the month.

CLUSTERS = f"""WITH RECURSIVE {STATEMENTS},
areas AS (SELECT * FROM (SELECT *, unnest(CASE WHEN k % 10 = 0 THEN [topic || '/' || k, 'other', topic || '/' || (k + 1)] WHEN k % 10 = 1 THEN ['other'] ELSE [topic || '/' || k, 'unlisted'] END) AS area FROM statements) WHERE area <> 'other' AND area <> 'unlisted' AND source <> 5),
items AS (SELECT * EXCLUDE (area) REPLACE (area AS topic) FROM areas WHERE TRY_CAST(split_part(area, '/', 2) AS INT) < 90),
anchors(topic, anchor) AS (SELECT topic, max(date) FROM items GROUP BY topic
  UNION ALL SELECT a.topic, (SELECT max(i.date) FROM items i WHERE i.topic = a.topic AND i.date < a.anchor - {WINDOW}) FROM anchors a
  WHERE EXISTS (SELECT 1 FROM items i WHERE i.topic = a.topic AND i.date < a.anchor - {WINDOW})),
placed AS (SELECT i.*, a.anchor FROM items i JOIN anchors a ON a.topic = i.topic AND i.date BETWEEN a.anchor - {WINDOW} AND a.anchor),
enough AS (SELECT topic, anchor FROM placed GROUP BY ALL HAVING count(DISTINCT actor) >= 2),
clusters AS (SELECT p.* FROM placed p JOIN enough e ON e.topic = p.topic AND e.anchor = p.anchor
  QUALIFY row_number() OVER (PARTITION BY p.topic, p.anchor, actor, url ORDER BY date DESC, event_id) = 1),
summary AS (SELECT topic, anchor, string_agg(DISTINCT actor, ',' ORDER BY actor) AS actors, min(date) AS date_from, max(date) AS date_to, count(*) AS items FROM clusters GROUP BY topic, anchor),
means AS (SELECT topic, anchor, actor, avg(score) AS mean, count(*) AS n FROM clusters WHERE score IS NOT NULL GROUP BY ALL),
scored AS (SELECT topic, anchor, max(mean) - min(mean) AS spread, avg(mean) AS overall, CAST(sum(n) AS BIGINT) AS n, string_agg(actor || ':' || format('{{:+.1f}}', {half_up_sql("mean", 1)}) || '/' || n, ',' ORDER BY actor) AS per_actor FROM means GROUP BY ALL HAVING count(*) >= 2),
paths AS (SELECT topic, anchor, CASE k % 4 WHEN 0 THEN 's/é"' WHEN 1 THEN 's\\' WHEN 2 THEN 's/😀' ELSE 's/' END || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.yaml' AS path FROM clusters),
keys_ AS (SELECT topic, anchor, substring(sha256('["' || string_agg(replace(replace(replace(replace(path, '\\', '\\\\'), '"', '\\"'), 'é', '\\u00e9'), '😀', '\\ud83d\\ude00'), '", "' ORDER BY path) || '"]'), 1, 12) AS cluster_key FROM paths GROUP BY topic, anchor),
cache AS (SELECT cluster_key, 'note on ' || topic AS note FROM keys_ WHERE extract(day FROM anchor) % 2 = 0)
"""


def _items(spark, sf):
    """Statements with one area, two, or none but `other`; areas above 90 and `unlisted` are not listed, and source 5 is not mapped."""
    number = lambda k: F.concat_ws("/", "topic", k.cast("string"))
    k = F.col("k")
    areas = F.when(k % 10 == 0, F.array(number(k), F.lit("other"), number(k + 1))).when(k % 10 == 1, F.array(F.lit("other"))).otherwise(F.array(number(k), F.lit("unlisted")))
    events = statements(spark, sf).drop("actor").withColumn("areas", areas).drop("topic")
    listed = topic_dim(spark).select(F.explode(F.expr("transform(sequence(0, 89), n -> topic || '/' || n)")).alias("topic"))
    return cluster.explode_areas(events, source_dim(spark).filter("source <> 5"), listed)


def _clusters(spark, sf):
    return cluster.anchored_clusters(_items(spark, sf), WINDOW)


def _keys(spark, sf):
    start = F.element_at(F.array(*map(F.lit, ['s/é"', "s\\", "s/😀", "s/"])), F.col("k") % 4 + 1)
    path = F.concat(start, F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".yaml"))
    return cluster.cluster_keys(_clusters(spark, sf).withColumn("path", path))


def _cache(spark, sf):
    return _keys(spark, sf).filter(F.dayofmonth("anchor") % 2 == 0).select("cluster_key", F.concat(F.lit("note on "), "topic").alias("note"))


def cluster_scores(spark, sf):
    each = F.transform("per_actor", lambda a: F.concat(a["actor"], F.lit(":"), F.format_string("%+.1f", a["stance"]), F.lit("/"), a["n"].cast("string")))
    return cluster.convergence(_clusters(spark, sf)).withColumn("per_actor", F.array_join(each, ","))


def ranked_clusters(spark, sf):
    """The newest cluster of each area with the place of its topic on the leaderboard, null for topics without one."""
    board = stance.divergence_leaderboard(stance.topic_weekly(statements(spark, sf), AS_OF), topic_dim(spark)).select("topic", "rank")
    latest = cluster.latest_cluster(cluster.cluster_summary(_clusters(spark, sf))).withColumnRenamed("topic", "area")
    ranked = latest.withColumn("topic", F.split_part("area", F.lit("/"), F.lit(1))).join(F.broadcast(board), "topic", "left")  # a row for each topic
    return ranked.select("area", "anchor", "date_to", "rank")


def commentary_inputs(spark, sf):
    """Positions and label of the clusters that have both."""
    spoken = _clusters(spark, sf).withColumn("position", F.when(F.col("k") % 2 == 0, F.concat(F.lit("position "), F.col("event_id").cast("string"))))
    scored = cluster.convergence(_clusters(spark, sf)).select("topic", "anchor", "label")
    verbs = F.create_map(*[F.lit(x) for p in [("Aligned", "agree"), ("Aligned against goal", "agree against"), ("Noncommittal", "hold back"), ("Mixed", "differ"), ("Divergent", "disagree")] for x in p])
    return cluster.representative_positions(spoken).join(scored, ["topic", "anchor"]).select("topic", "anchor", "actor", "position", verbs[F.col("label")].alias("verb"))


def topic_pills(spark, sf):
    """Of the newest cluster of each topic."""
    newest = cluster.latest_cluster(cluster.cluster_summary(_clusters(spark, sf)))
    return stance.latest_topic_pill(newest.join(cluster.convergence(_clusters(spark, sf)), ["topic", "anchor"], "left"), _items(spark, sf).select("topic").distinct(), AS_OF)


def cluster_items(spark, sf):
    """A row for each actor of a cluster with its items' ids and scores."""
    nested = cluster.nest_by_actor(_clusters(spark, sf), ACTORS).select("topic", "anchor", F.posexplode("by_actor").alias("place", "a"))
    return nested.select("topic", "anchor", "place", "a.actor", F.array_join(F.transform("a.items", lambda i: F.concat_ws(":", i["event_id"].cast("string"), i["score"].cast("string"))), ",").alias("items"))


QUERIES = {
    "anchored_clusters": lambda s, d: _clusters(s, d).select("topic", "anchor", "actor", "date", "event_id", "url"),
    "cluster_summary": lambda s, d: cluster.cluster_summary(_clusters(s, d)),
    "convergence_clusters": lambda s, d: cluster.latest_cluster(cluster.cluster_summary(_clusters(s, d))),
    "cluster_scores": cluster_scores,
    "cluster_keys": _keys,
    "cluster_items": cluster_items,
    "cluster_rows": lambda s, d: cluster.cluster_rows(_clusters(s, d), ACTORS),
    "exploded_areas": lambda s, d: _items(s, d).select("event_id", "topic", "actor", "date"),
    "cluster_commentary": lambda s, d: _keys(s, d).join(_cache(s, d), "cluster_key", "left"),
    "pending_commentary": lambda s, d: _keys(s, d).join(_cache(s, d), "cluster_key", "left_anti"),
    "ranked_clusters": ranked_clusters,
    "commentary_inputs": commentary_inputs,
    "topic_pills": topic_pills,
}

_LABEL = agreement_sql("spread", "overall")
_COLOR = f"CASE {_LABEL} WHEN 'Aligned' THEN 'green' WHEN 'Aligned against goal' THEN 'green' WHEN 'Noncommittal' THEN 'grey' WHEN 'Mixed' THEN 'amber' ELSE 'red' END"
_SHOWN = f"{half_up_sql('overall', 2)} AS overall, format('{{:+.1f}}', {half_up_sql('overall', 1)}) AS display, {_LABEL} AS label, {_COLOR} AS color"
ORACLE = {
    "anchored_clusters": CLUSTERS + "SELECT topic, anchor, actor, date, event_id, url FROM clusters",
    "cluster_summary": CLUSTERS + "SELECT * FROM summary",
    "convergence_clusters": CLUSTERS + "SELECT * FROM summary QUALIFY row_number() OVER (PARTITION BY topic ORDER BY date_to DESC) = 1",
    "cluster_scores": CLUSTERS + f"SELECT topic, anchor, per_actor, {half_up_sql('spread', 1)} AS spread, {_SHOWN}, n FROM scored",
    "cluster_keys": CLUSTERS + "SELECT * FROM keys_",
    "cluster_items": CLUSTERS + "SELECT topic, anchor, CAST(row_number() OVER (PARTITION BY topic, anchor ORDER BY actor) - 1 AS INT) AS place, actor, string_agg(event_id || ':' || score, ',' ORDER BY date DESC, event_id) AS items FROM clusters GROUP BY topic, anchor, actor",
    "cluster_rows": CLUSTERS + "SELECT topic, anchor, CAST(CASE actor WHEN 'DE' THEN 0 WHEN 'FR' THEN 1 ELSE 2 END AS BIGINT) AS actor_rank, actor, date, event_id, score FROM clusters",
    "exploded_areas": CLUSTERS + "SELECT event_id, topic, actor, date FROM items",
    "cluster_commentary": CLUSTERS + "SELECT k.cluster_key, topic, anchor, note FROM keys_ k LEFT JOIN cache c ON c.cluster_key = k.cluster_key",
    "pending_commentary": CLUSTERS + "SELECT * FROM keys_ WHERE cluster_key NOT IN (SELECT cluster_key FROM cache)",
    "ranked_clusters": WEEKLY + "," + CLUSTERS.removeprefix("WITH RECURSIVE").replace(STATEMENTS + ",", "").replace("means AS", "cmeans AS").replace("FROM means GROUP", "FROM cmeans GROUP").replace("scored AS", "cscored AS")
    + "SELECT s.topic AS area, anchor, date_to, rank FROM (SELECT * FROM summary QUALIFY row_number() OVER (PARTITION BY topic ORDER BY date_to DESC) = 1) s LEFT JOIN leaderboard l ON l.topic = split_part(s.topic, '/', 1)",
    "commentary_inputs": CLUSTERS + f""", spoken AS (SELECT *, 'position ' || CAST(event_id AS VARCHAR) AS position FROM clusters WHERE k % 2 = 0),
first_ AS (SELECT topic, anchor, actor, position FROM spoken QUALIFY row_number() OVER (PARTITION BY topic, anchor, actor ORDER BY date DESC, event_id) = 1),
two AS (SELECT topic, anchor FROM first_ GROUP BY ALL HAVING count(*) >= 2), lab AS (SELECT topic, anchor, {_LABEL} AS label FROM scored)
SELECT f.topic, f.anchor, actor, position, CASE label WHEN 'Aligned' THEN 'agree' WHEN 'Aligned against goal' THEN 'agree against' WHEN 'Noncommittal' THEN 'hold back' WHEN 'Mixed' THEN 'differ' ELSE 'disagree' END AS verb
FROM first_ f JOIN two t ON t.topic = f.topic AND t.anchor = f.anchor JOIN lab l ON l.topic = f.topic AND l.anchor = f.anchor""",
    "topic_pills": CLUSTERS + f""", newest AS (SELECT topic, anchor, date_to FROM summary QUALIFY row_number() OVER (PARTITION BY topic ORDER BY date_to DESC) = 1),
fresh AS (SELECT n.topic, date_to, {_SHOWN} FROM newest n JOIN scored s ON s.topic = n.topic AND s.anchor = n.anchor WHERE date_to >= DATE '{AS_OF}' - 7)
SELECT t.topic, label, color, overall, display, date_to FROM (SELECT DISTINCT topic FROM items) t LEFT JOIN fresh f ON f.topic = t.topic""",
}
