"""Queries of classification and enrichment, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax.operators import classify
from parallax.sources.adapters import GROUPINGS, RATINGS, TAGGINGS, groupings, ratings, read, statements, taggings

ORDER = [f"NATION_{i}" for i in range(25)]


def _groupings(s, d):
    return groupings(s, d).withColumnRenamed("topics", "tracked")


def _relevant(s, d):
    return classify.grouping_relevance(taggings(s, d), _groupings(s, d))


RELEVANT = f"""WITH {GROUPINGS}, {TAGGINGS},
member_hits AS (SELECT event, grouping_key, count(*) AS hits FROM tag_actor JOIN grouping_member ON member = actor GROUP BY ALL),
sizes AS (SELECT grouping_key, count(*) AS size FROM grouping_member GROUP BY ALL),
topic_hits AS (SELECT DISTINCT event, grouping_key FROM tag_topic JOIN grouping_topic USING (topic)),
relevant AS (SELECT e.event, s.grouping_key AS grouping FROM tag_event e CROSS JOIN sizes s
  LEFT JOIN member_hits m ON m.event = e.event AND m.grouping_key = s.grouping_key LEFT JOIN topic_hits t ON t.event = e.event AND t.grouping_key = s.grouping_key
  WHERE e.format IS NOT DISTINCT FROM s.grouping_key OR m.hits = s.size OR (m.hits >= 2 AND t.event IS NOT NULL)
    OR (t.event IS NOT NULL AND EXISTS (SELECT 1 FROM grouping_member g WHERE g.grouping_key = s.grouping_key AND g.member = e.source_country))),
wanted AS (SELECT r.event, r.grouping, t.topic FROM relevant r JOIN tag_topic t ON t.event = r.event JOIN grouping_topic g ON g.grouping_key = r.grouping AND g.topic = t.topic)
"""


def normalize_actors(s, d):
    """Suppliers' nations written in small letters, with blanks, under an alias, or unknown; the customer's nation is folded in for even events."""
    t = taggings(s, d)
    raw = F.transform("actors", lambda a: F.concat(F.lit(" "), F.lower(F.when(a == "NATION_3", "third land").when(a == "NATION_4", "Narnia").otherwise(a))))
    codes = classify.normalize_actors(raw, {"THIRD LAND": "NATION_3"}, ORDER, F.col("source_country"), F.col("event") % 2 == 0)
    return t.select("event", F.array_join(codes, ",").alias("actors"))


def normalize_formats(s, d):
    docs = read(s, d, "documents")
    raw = F.array(F.upper("lang"), F.concat(F.lit(" "), "lang"), F.lit("nato"), F.col("source"))
    return docs.select("doc_id", F.array_join(classify.normalize_formats(raw, ["de", "en", "src0", "src1"]), ",").alias("formats"))


def pending_enrich(s, d):
    return classify.pending(read(s, d, "documents").select("doc_id", "source"), read(s, d, "labels"), ["doc_id"], [F.desc("doc_id")], 50)


def pending_stances(s, d):
    """Events with a wanted rating that is missing; every third topic is rated."""
    wanted = classify.wanted_topics(_relevant(s, d))
    rated = wanted.filter((F.col("event") + F.regexp_extract("topic", "([0-9]+)", 1).cast("int")) % 3 == 0)
    return classify.pending(wanted, rated, ["event", "grouping", "topic"]).select("event").distinct()


RESPONSE = "concat('{\"actors\": [\"', role, '\"], \"score\": ', turn, '}')"


def _responses(s, d):
    c = read(s, d, "conversations").select("conv_id", "turn", "role", F.expr(RESPONSE).alias("json"))
    n = F.col("conv_id") % 5
    fence = F.lit("```")
    nl = F.lit("\n")
    after = F.concat(fence, F.lit("json"), nl, "json", nl, fence, nl, F.lit("I hope that helps. ``` {}"))
    raw = F.when(n == 0, F.col("json")).when(n == 1, F.concat(fence, nl, "json", nl, fence)).when(n == 2, F.concat(fence, F.lit("json"), nl, "json", nl, fence)).when(n == 3, F.concat(F.lit("Sorry, "), "json")).otherwise(after)
    return c.withColumn("raw", raw)


def parse_responses(s, d):
    p = classify.parse_responses(_responses(s, d), "actors array<string>, score int")
    return p.select("conv_id", "turn", "status", F.col("parsed.score").alias("score"), F.col("parsed.actors")[0].alias("actor"))


def shape_check(s, d):
    """Actors as an array of strings, of arrays, a text, or absent; explicit formats as numbers, null, empty or with nulls in them for some."""
    c = read(s, d, "conversations").select("conv_id", "turn", "role")
    n = F.col("conv_id") % 4
    actors = F.when(n == 0, F.concat(F.lit('"actors": ["'), "role", F.lit('"], '))).when(n == 1, F.concat(F.lit('"actors": [["'), "role", F.lit('"]], '))).when(n == 2, F.concat(F.lit('"actors": "'), "role", F.lit('", '))).otherwise("")
    formats = F.when(F.col("turn") % 3 == 0, '"explicit_formats": [1]').when(F.col("turn") % 3 == 1, '"explicit_formats": null').when(F.col("turn") % 12 == 2, '"explicit_formats": [null]').when(F.col("turn") % 12 == 5, '"explicit_formats": ["x", null]').when(F.col("turn") % 12 == 8, '"explicit_formats": []').otherwise('"explicit_formats": ["x", "y"]')
    return c.select("conv_id", "turn", classify.response_shape(F.concat(F.lit("{"), actors, formats, F.lit("}"))).alias("wrong"))


def positions_build(s, d):
    t = statements(s, d)
    topics = F.array(F.col("topic"), F.lit("other"))
    positions = F.create_map(F.col("topic"), F.when(F.col("k") % 10 == 0, "  ").otherwise(F.concat(F.lit(" pos "), F.col("k").cast("string"))))
    built, status = classify.build_positions(topics, positions)
    return t.select("event_id", built[F.col("topic")].alias("position"), status.alias("status"))


def clean_stance(s, d):
    t = statements(s, d)
    raw = F.when(F.col("k") % 8 == 0, "n/a").when(F.col("k") % 8 == 1, F.concat(F.col("score").cast("string"), F.lit(".5"))).when(F.col("k") % 8 == 2, F.when(F.col("k") % 16 == 2, "7").otherwise(F.lit("9" * 50))).otherwise(F.concat(F.lit(" "), F.col("score").cast("string")))
    score, error = classify.clean_stance(raw)
    of_number, _ = classify.clean_stance(raw, F.lit(True))
    return t.select("event_id", score.alias("score"), error.alias("error"), of_number.alias("of_number"))


def clean_evidence(s, d):
    goal = F.when(F.col("topic") == "error", F.lit(None)).otherwise(F.concat(F.lit("back the goal of "), "topic"))
    return ratings(s, d).select("event", "grouping", classify.clean_evidence(F.col("evidence"), goal).alias("evidence"))


def _merged(s, d):
    r = ratings(s, d)
    old = r.withColumn("model", F.lit("v1"))
    new = r.filter("event % 3 = 0").withColumn("score", F.lit(1))
    return classify.merge_ratings(old, new, "v2")


def stance_report(s, d):
    """Outcomes of rating each statement's event: a tenth fails, and ratings without a quote are dropped first."""
    rated = classify.drop_blank_neutrals(ratings(s, d))
    events = statements(s, d).select(F.col("event_id").alias("event"), (F.col("k") % 10 == 4).alias("failed"))
    return classify.status_counts(classify.rating_outcomes(events, rated), "outcome")


def prompt_render(s, d):
    goals = groupings(s, d).select("grouping", F.array_join(F.transform("topics", lambda t: F.concat(F.lit("- "), t)), "\n").alias("goal_block"))
    events = _relevant(s, d).select("event", "grouping", "source_country").join(goals, "grouping")
    return classify.render_prompts(events, "Country {country}\nGoals:\n{goals}", country=F.col("source_country"), goals=F.col("goal_block")).select("event", "grouping", "prompt")


def _stub(prompt: str) -> str:
    """A deterministic stand-in for a model: fails on every prompt of a length that 5 divides."""
    if len(prompt) % 5 == 0:
        raise ValueError("no answer")
    return str(len(prompt) % 5 - 2)


def batch_score(s, d):
    docs = read(s, d, "documents").select(F.col("doc_id").alias("event"), F.concat(F.lit("rate "), "text").alias("prompt"))
    return classify.batch_score(docs, _stub)


def stance_topics(s, d):
    return classify.wanted_topics(_relevant(s, d))


QUERIES = {
    "normalize_actors": normalize_actors,
    "normalize_formats": normalize_formats,
    "grouping_relevance": lambda s, d: _relevant(s, d).select("event", "grouping"),
    "stance_topics": stance_topics,
    "pending_enrich": pending_enrich,
    "pending_stances": pending_stances,
    "parse_responses": parse_responses,
    "shape_check": shape_check,
    "positions_build": positions_build,
    "clean_stance": clean_stance,
    "clean_evidence": clean_evidence,
    "drop_blank_neutral": lambda s, d: classify.drop_blank_neutrals(ratings(s, d)).groupBy("grouping", "topic", "score").count().withColumnRenamed("count", "n"),
    "merge_ratings": _merged,
    "prompt_render": prompt_render,
    "stance_report": stance_report,
    "batch_score": batch_score,
    "enrich_report": lambda s, d: classify.status_counts(parse_responses(s, d), "status"),
}
_RESP = "CASE WHEN conv_id % 5 = 3 THEN 'error' ELSE 'ok' END"
ORACLE = {
    "normalize_actors": f"""WITH {TAGGINGS}, a AS (SELECT event, actor FROM tag_actor WHERE actor <> 'NATION_4' UNION SELECT event, source_country FROM tag_event WHERE event % 2 = 0)
SELECT e.event, coalesce(string_agg(a.actor, ',' ORDER BY CAST(substring(a.actor, 8) AS INT)), '') AS actors FROM tag_event e LEFT JOIN a ON a.event = e.event GROUP BY e.event""",
    "normalize_formats": "SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN lang IN ('de', 'en') THEN lang END, CASE WHEN source IN ('src0', 'src1') THEN source END], lambda x: x IS NOT NULL)), ',') AS formats FROM documents",
    "grouping_relevance": RELEVANT + "SELECT event, grouping FROM relevant",
    "stance_topics": RELEVANT + "SELECT * FROM wanted",
    "pending_enrich": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id DESC LIMIT 50",
    "pending_stances": RELEVANT + "SELECT DISTINCT event FROM wanted WHERE (event + CAST(regexp_extract(topic, '([0-9]+)', 1) AS INT)) % 3 <> 0",
    "parse_responses": f"SELECT conv_id, turn, {_RESP} AS status, CASE WHEN conv_id % 5 <> 3 THEN CAST(turn AS INT) END AS score, CASE WHEN conv_id % 5 <> 3 THEN role END AS actor FROM conversations",
    "shape_check": "SELECT conv_id, turn, CASE WHEN conv_id % 4 IN (1, 2) THEN 'actors' WHEN turn % 3 = 0 OR turn % 12 IN (2, 5) THEN 'explicit_formats' END AS wrong FROM conversations",
    "stance_report": f"WITH {RATINGS}, e AS (SELECT DISTINCT event FROM ratings WHERE NOT (score = 0 AND coalesce(evidence, '') = '')) SELECT CASE WHEN k % 10 = 4 THEN 'error' WHEN e.event IS NULL THEN 'empty' ELSE 'ok' END AS outcome, count(*) AS n FROM statements s LEFT JOIN e ON e.event = s.event_id GROUP BY 1",
    "positions_build": f"WITH {RATINGS} SELECT event_id, CASE WHEN k % 10 <> 0 THEN 'pos ' || CAST(k AS VARCHAR) END AS position, CASE WHEN k % 10 <> 0 THEN 'ok' ELSE 'error' END AS status FROM statements",
    "clean_stance": f"WITH {RATINGS} SELECT event_id, CASE WHEN k % 8 > 2 THEN score END AS score, k % 8 = 2 AS error, CASE WHEN k % 8 > 2 OR k % 8 = 1 THEN score END AS of_number FROM statements",
    "clean_evidence": f"""WITH {RATINGS} SELECT event, grouping_key AS grouping, CASE WHEN topic = 'error' OR evidence IS NULL OR evidence = 'back the goal of ' || topic THEN '' ELSE evidence END AS evidence FROM ratings""",
    "drop_blank_neutral": f"WITH {RATINGS} SELECT grouping_key AS grouping, topic, score, count(*) AS n FROM ratings WHERE NOT (score = 0 AND coalesce(evidence, '') = '') GROUP BY ALL",
    "merge_ratings": f"WITH {RATINGS} SELECT event, grouping_key AS grouping, topic, CASE WHEN event % 3 = 0 THEN 1 ELSE score END AS score, evidence, CASE WHEN event % 3 = 0 THEN 'v2' ELSE 'v1' END AS model FROM ratings",
    "prompt_render": RELEVANT + ", goals AS (SELECT grouping_key, string_agg('- ' || topic, chr(10) ORDER BY topic) AS block FROM grouping_topic GROUP BY ALL) SELECT r.event, grouping, 'Country ' || source_country || chr(10) || 'Goals:' || chr(10) || coalesce(block, '') AS prompt FROM relevant r JOIN tag_event e ON e.event = r.event LEFT JOIN goals g ON g.grouping_key = r.grouping",
    "batch_score": "SELECT doc_id AS event, CASE WHEN n % 5 <> 0 THEN CAST(n % 5 - 2 AS VARCHAR) END AS answer, CAST(CASE WHEN n % 5 <> 0 THEN 1 ELSE 2 END AS INT) AS attempts, CASE WHEN n % 5 <> 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN n % 5 = 0 THEN 'ValueError: no answer' END AS error FROM (SELECT doc_id, length(text) + 5 AS n FROM documents)",
    "enrich_report": f"SELECT {_RESP} AS status, count(*) AS n FROM conversations GROUP BY 1",
}
