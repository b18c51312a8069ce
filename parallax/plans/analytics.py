"""Queries of the agreement analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax.functions.columns import agreement, agreement_color, agreement_sql, fmt_stance, half_up_sql, stance_norm
from parallax.operators import history, stance
from parallax.sources.adapters import ACTORS, AS_OF, STATEMENTS, TOPICS, read, source_dim, statements, topic_dim

D = f"DATE '{AS_OF}'"
TOPIC_RANK = "topic_dim(topic, topic_rank) AS (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(TOPICS)) + ")"

#: The weekly series as SQL: every row against every Monday, by the window's definition.
WEEKLY = f"""WITH RECURSIVE {STATEMENTS},
rows_ AS (SELECT * FROM statements WHERE date <= {D}),
week_spine AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('week', min(date)) AS TIMESTAMP), CAST({D} AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week FROM rows_),
means AS (SELECT topic, week, actor, avg(score) AS mean, count(*) AS n FROM rows_ JOIN week_spine ON date BETWEEN week - 14 AND week GROUP BY ALL),
scored AS (SELECT topic, week, avg(mean) AS overall_raw, min(mean) AS lo, max(mean) AS hi, sum(n) AS n_events, string_agg(actor || ':' || format('{{:.1f}}', {half_up_sql("mean", 1)}), ',' ORDER BY actor) AS per_actor FROM means GROUP BY topic, week HAVING count(*) >= 2),
topic_weekly AS (SELECT t.topic, w.week, {agreement_sql("hi - lo", "overall_raw")} AS label, {half_up_sql("(overall_raw + 2) / 4", 3)} AS overall, {half_up_sql("overall_raw", 2)} AS stance_avg,
  {half_up_sql("(lo + 2) / 4", 3)} AS band_lo, {half_up_sql("(hi + 2) / 4", 3)} AS band_hi, per_actor, CAST(n_events AS BIGINT) AS n_events
  FROM (SELECT DISTINCT topic FROM rows_) t CROSS JOIN week_spine w LEFT JOIN scored s ON s.topic = t.topic AND s.week = w.week),
overall_parts AS (SELECT week, avg(CAST(round(stance_avg * 1000) AS BIGINT)) / 1000 AS a, avg(CAST(round(band_lo * 1000) AS BIGINT)) / 1000 AS lo, avg(CAST(round(band_hi * 1000) AS BIGINT)) / 1000 AS hi,
  avg(CAST(round(band_hi * 1000) AS BIGINT) - CAST(round(band_lo * 1000) AS BIGINT)) * 4 / 1000 AS spread, CAST(sum(n_events) AS BIGINT) AS n_events FROM topic_weekly WHERE stance_avg IS NOT NULL GROUP BY week),
overall_weekly AS (SELECT week, {half_up_sql("(a + 2) / 4", 3)} AS overall, {half_up_sql("a", 2)} AS stance_avg, {half_up_sql("lo", 3)} AS band_lo, {half_up_sql("hi", 3)} AS band_hi, {agreement_sql("spread", "a")} AS label, n_events FROM overall_parts),
{TOPIC_RANK},
current_ AS (SELECT topic, {half_up_sql("(band_hi - band_lo) * 4", 2)} AS spread, label, stance_avg, format('{{:+.1f}}', {half_up_sql("stance_avg", 1)}) AS display,
  CASE WHEN label LIKE 'Aligned%' THEN 'green' WHEN label = 'Noncommittal' THEN 'grey' WHEN label = 'Mixed' THEN 'amber' ELSE 'red' END AS color, n_events FROM topic_weekly WHERE week = (SELECT max(week) FROM topic_weekly WHERE stance_avg IS NOT NULL) AND stance_avg IS NOT NULL),
leaderboard AS (SELECT d.topic, d.topic_rank, coalesce(spread, -1.0) AS spread, label, stance_avg, display, color, coalesce(n_events, 0) AS n, spread IS NULL AS quiet, coalesce(n_events, 0) < 4 AS low_confidence,
  row_number() OVER (ORDER BY spread IS NULL, coalesce(spread, -1.0) DESC, d.topic_rank) AS rank FROM topic_dim d LEFT JOIN current_ c ON c.topic = d.topic WHERE d.topic IN (SELECT topic FROM topic_weekly WHERE stance_avg IS NOT NULL)),
week_rows AS (SELECT * FROM rows_ WHERE date >= {D} - 7),
weekly_counts AS (SELECT 'actor' AS kind, a.name, count(w.actor) AS n FROM (VALUES ('DE'), ('FR'), ('PL'), ('XX')) a(name) LEFT JOIN week_rows w ON w.actor = a.name GROUP BY a.name UNION ALL SELECT 'source', CAST(source AS VARCHAR), count(*) FROM week_rows GROUP BY source)
"""
CELLS = f"""WITH {STATEMENTS},
age AS (SELECT *, date_diff('day', date, {D}) AS a FROM statements),
inside AS (SELECT *, CAST(floor(a / 7) AS INT) AS back FROM age WHERE a >= 0 AND a < 84),
bins AS (SELECT CAST(least(floor(max(a) / 7) + 1, 12) AS INT) AS bins FROM age WHERE a >= 0),
counted AS (SELECT coalesce(x.a, 'ALL') AS actor, coalesce(x.t, 'overall') AS topic, score, back, count(*) AS n FROM inside, LATERAL (VALUES (actor, topic), (NULL, topic), (actor, NULL), (NULL, NULL)) x(a, t) GROUP BY ALL),
spine AS (SELECT a.actor, t.topic, s.score, unnest(generate_series(0, bins - 1)) AS back, bins FROM bins, (VALUES ('ALL'), ('DE'), ('FR'), ('PL')) a(actor), (VALUES ('overall'), {", ".join(f"('{t}')" for t in TOPICS)}) t(topic), (VALUES (-2), (-1), (0), (1), (2)) s(score)),
density AS (SELECT p.actor, p.topic, p.score, CAST(p.bins - 1 - p.back AS INT) AS bin, coalesce(n, 0) AS n FROM spine p LEFT JOIN counted c ON c.actor = p.actor AND c.topic = p.topic AND c.score = p.score AND c.back = p.back)
"""


def _weekly(spark, sf):
    return stance.topic_weekly(statements(spark, sf), AS_OF)


def _cells(spark, sf):
    """Beside the statements there are some of an actor, a topic and a score that aren't listed, which count nowhere."""
    s = statements(spark, sf)
    others = [s.filter("event_id % 7 = 1").withColumn("actor", F.lit("XX")), s.filter("event_id % 7 = 2").withColumn("topic", F.lit("unlisted")), s.filter("event_id % 7 = 3").withColumn("score", F.lit(7))]
    for x in others:
        s = s.unionByName(x)
    return stance.score_density(s, AS_OF, TOPICS, ACTORS)


def agreement_labels(spark, sf):
    s = statements(spark, sf)
    means = stance.actor_means(s, "topic", "date").groupBy("topic", "date").agg((F.max("mean") - F.min("mean")).alias("spread"), F.avg("mean").alias("overall"))
    label = agreement(F.col("spread"), F.col("overall"))
    return means.select("topic", "date", label.alias("label"), agreement_color(label).alias("color"), F.round("spread", 6).alias("spread"))


def stance_format(spark, sf):
    s = statements(spark, sf)
    return s.select("event_id", stance_norm(F.col("score")).alias("norm"), fmt_stance(F.col("score")).alias("shown"))


def totals(spark, sf):
    """Statements, the non-neutral ones, orders as meetings, the sources, and the days of each topic as clusters."""
    s = statements(spark, sf)
    return stance.totals(s, s.filter("score <> 0"), read(spark, sf, "orders"), source_dim(spark), s.select("topic", "date").distinct())


def stance_rows(spark, sf):
    """Rows of mapped sources and listed topics with a score, from ratings nested by grouping and topic."""
    s = statements(spark, sf).drop("actor")
    rating = lambda score: F.struct(score.alias("score"), F.lit("q").alias("evidence"))
    own = F.create_map("topic", rating(F.when(F.col("k") % 6 != 5, F.col("score"))), F.lit("elsewhere"), rating(F.lit(1)))
    nested = F.when(F.col("k") % 9 == 8, F.create_map(F.lit("h"), own)).when(F.col("k") % 9 != 7, F.create_map(F.lit("g"), own))
    return stance.stance_rows(s.withColumn("stances", nested), source_dim(spark).filter("source <> 5"), TOPICS[:4], "g")


def week_spine(spark, sf):
    return stance.week_spine(statements(spark, sf), AS_OF)


def event_feed(spark, sf):
    return stance.event_feed(statements(spark, sf), AS_OF).select("event_id", "date", "topic")


def relevant_events(spark, sf):
    """Documents with a map of flags from their labels: good ones are relevant to g, toxic ones to h."""
    flags = F.create_map(F.lit("g"), F.col("quality") == 1, F.lit("h"), F.col("toxic") == 1)
    side = read(spark, sf, "labels").select("doc_id", flags.alias("relevant"))
    return history.relevant(history.merge_sidecar(read(spark, sf, "documents").select("doc_id", "lang"), side, "doc_id"), "g").select("doc_id", "lang")


def recent_events(spark, sf):
    return stance.recent(statements(spark, sf), AS_OF, 10).select("event_id", "date", "actor")


def country_diary(spark, sf):
    return stance.recent(statements(spark, sf), AS_OF, 10).filter("actor = 'FR'").select("event_id", "date", "topic")


def stances_of(spark, sf):
    """The nested scores of one grouping; an empty map where it has none."""
    s = statements(spark, sf)
    nested = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("g"), F.create_map("topic", "score")))
    found = stance.with_stances(s.withColumn("nested", nested), "nested", F.lit("g"))
    return found.select("event_id", F.size("stances").alias("n"), F.try_element_at("stances", F.col("topic")).alias("score"))


def position_pick(spark, sf):
    s = statements(spark, sf)
    positions = F.create_map(F.when(F.col("k") % 3 == 0, "other").otherwise(F.col("topic")), F.concat(F.lit("on "), "topic"))
    return s.select("event_id", stance.pick_position(positions, F.col("topic"), F.lit("overall")).alias("position"))


def topic_order(spark, sf):
    """Two topics have no rows and so no rank."""
    weekly = stance.topic_weekly(statements(spark, sf).filter("topic not in ('click', 'view')"), AS_OF)
    return stance.topic_order(stance.divergence_leaderboard(weekly, topic_dim(spark)), topic_dim(spark))


QUERIES = {
    "stances_of": stances_of,
    "position_pick": position_pick,
    "topic_weekly": _weekly,
    "overall_weekly": lambda s, d: stance.overall_weekly(_weekly(s, d)),
    "divergence_leaderboard": lambda s, d: stance.divergence_leaderboard(_weekly(s, d), topic_dim(s)),
    "topic_order": topic_order,
    "score_density": _cells,
    "density_cells": lambda s, d: stance.density_margins(_cells(s, d)),
    "weekly_counts": lambda s, d: stance.weekly_counts(statements(s, d), AS_OF, [*ACTORS, "XX"]),
    "pair_agreement": lambda s, d: stance.pair_agreement(statements(s, d), AS_OF, ACTORS),
    "staleness": lambda s, d: stance.staleness(statements(s, d), AS_OF),
    "hub_badge": lambda s, d: stance.hub_badge(stance.overall_weekly(_weekly(s, d)), stance.weekly_counts(statements(s, d), AS_OF, [*ACTORS, "XX"])),
    "agreement_labels": agreement_labels,
    "stance_format": stance_format,
    "totals": totals,
    "stance_rows": stance_rows,
    "week_spine": week_spine,
    "event_feed": event_feed,
    "relevant_events": relevant_events,
    "as_of_events": lambda s, d: stance.relevant_as_of(statements(s, d), AS_OF).select("event_id", "date", "topic", "score"),
    "recent_events": recent_events,
    "country_diary": country_diary,
}

ORACLE = {
    "stances_of": f"WITH {STATEMENTS} SELECT event_id, CAST(1 - k % 2 AS INT) AS n, CASE WHEN k % 2 = 0 THEN score END AS score FROM statements",
    "position_pick": f"WITH {STATEMENTS} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'overall' ELSE 'on ' || topic END AS position FROM statements",
    "topic_weekly": WEEKLY + "SELECT * FROM topic_weekly",
    "overall_weekly": WEEKLY + "SELECT * FROM overall_weekly",
    "divergence_leaderboard": WEEKLY + "SELECT * FROM leaderboard",
    "topic_order": WEEKLY.replace("rows_ AS (SELECT * FROM statements WHERE", "rows_ AS (SELECT * FROM statements WHERE topic NOT IN ('click', 'view') AND")
    + "SELECT d.topic, CAST(row_number() OVER (ORDER BY rank NULLS LAST, d.topic_rank) AS INT) AS place FROM topic_dim d LEFT JOIN leaderboard l ON l.topic = d.topic UNION ALL SELECT 'overall', 0",
    "score_density": CELLS + "SELECT * FROM density",
    "density_cells": CELLS
    + f""", m AS (SELECT *, sum(n) OVER (PARTITION BY actor, topic, score) AS rt, sum(n) OVER (PARTITION BY actor, topic) AS grand, max(n) OVER (PARTITION BY actor, topic) AS most FROM density)
SELECT actor, topic, score, bin, n, CAST(rt AS BIGINT) AS row_total, CASE WHEN grand = 0 THEN 0.0 ELSE {half_up_sql("100 * rt / nullif(grand, 0)", 0)} END AS share,
  CASE WHEN n = 0 THEN 0.0 ELSE {half_up_sql("0.16 + 0.84 * sqrt(n / nullif(most, 0))", 3)} END AS intensity FROM m""",
    "weekly_counts": WEEKLY + "SELECT * FROM weekly_counts",
    "pair_agreement": f"""WITH {STATEMENTS},
m AS (SELECT topic, actor, avg(score) AS mean FROM statements WHERE date BETWEEN {D} - 14 AND {D} GROUP BY ALL),
p AS (SELECT a.actor AS x, b.actor AS y, avg(1 - abs(a.mean - b.mean) / 4) AS agree, count(*) AS topics FROM m a JOIN m b ON a.topic = b.topic AND a.actor < b.actor GROUP BY ALL)
SELECT d.x AS actor_a, d.y AS actor_b, CAST({half_up_sql("100 * agree", 0)} AS BIGINT) AS percent, coalesce(topics, 0) AS topics
FROM (VALUES ('DE', 'FR'), ('DE', 'PL'), ('FR', 'PL')) d(x, y) LEFT JOIN p ON p.x = d.x AND p.y = d.y""",
    "staleness": f"WITH {STATEMENTS} SELECT max(date) AS newest, date_diff('day', max(date), {D}) AS days, date_diff('day', max(date), {D}) > 5 AS banner FROM statements",
    "hub_badge": WEEKLY + "SELECT arg_max(label, week) AS label, max(week) AS week, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM weekly_counts WHERE kind = 'actor') AS statements FROM overall_weekly WHERE label IS NOT NULL",
    "agreement_labels": f"""WITH {STATEMENTS}, m AS (SELECT topic, date, actor, avg(score) AS mean FROM statements GROUP BY ALL),
s AS (SELECT topic, date, max(mean) - min(mean) AS spread, avg(mean) AS overall FROM m GROUP BY ALL),
l AS (SELECT topic, date, {agreement_sql("spread", "overall")} AS label, round(spread, 6) AS spread FROM s)
SELECT *, CASE WHEN label LIKE 'Aligned%' THEN 'green' WHEN label = 'Noncommittal' THEN 'grey' WHEN label = 'Mixed' THEN 'amber' ELSE 'red' END AS color FROM l""",
    "stance_format": f"WITH {STATEMENTS} SELECT event_id, (score + 2) / 4 AS norm, CASE WHEN score < 0 THEN '-' ELSE '+' END || CAST(abs(score) AS VARCHAR) || '.0' AS shown FROM statements",
    "totals": f"WITH {STATEMENTS} SELECT count(*) FILTER (score <> 0) AS relevant, count(*) AS all_rows, (SELECT count(*) FROM orders) AS meetings, 6 AS sources, count(DISTINCT topic || CAST(date AS VARCHAR)) AS clusters FROM statements",
    "stance_rows": f"WITH {STATEMENTS} SELECT date, actor, topic, score, event_id FROM statements WHERE source <> 5 AND topic IN ({', '.join(repr(t) for t in TOPICS[:4])}) AND k % 6 <> 5 AND k % 9 NOT IN (7, 8)",
    "week_spine": WEEKLY + "SELECT week FROM week_spine",
    "event_feed": f"WITH {STATEMENTS} SELECT event_id, date, topic FROM statements WHERE date IS NULL OR date <= {D} ORDER BY date DESC, event_id",
    "relevant_events": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "as_of_events": f"WITH {STATEMENTS} SELECT event_id, date, topic, score FROM statements WHERE date IS NULL OR date <= {D}",
    "recent_events": f"WITH {STATEMENTS} SELECT event_id, date, actor FROM statements WHERE date BETWEEN {D} - 10 AND {D}",
    "country_diary": f"WITH {STATEMENTS} SELECT event_id, date, topic FROM statements WHERE date BETWEEN {D} - 10 AND {D} AND actor = 'FR'",
}
