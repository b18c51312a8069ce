"""Queries of data quality, schema evolution, run logs, history and votes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax.operators import classify, history, quality, votes
from parallax.plans.classification import RELEVANT, stance_topics
from parallax.sources.adapters import GROUPINGS, RATINGS, groupings, ratings, read, taggings

TTL = 7 * 86400


def load_events(s, d):
    """Documents with their labels: the label's side holds where it has a row, also where it says null."""
    lab = read(s, d, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 3 != 0, "labelled").alias("source"))
    return history.merge_sidecar(read(s, d, "documents").select("doc_id", "source", "lang"), lab, "doc_id")


def schema_violations(s, d):
    rules = {"negative balance": F.col("c_acctbal") < 0, "unknown segment": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "no name": F.coalesce(F.col("c_name"), F.lit("")) == ""}
    return quality.violations(read(s, d, "customer"), "c_custkey", rules)


def _props(s, d):
    n = F.col("event_id") % 5
    raw = F.when(n == 0, "").when(n == 1, "{broken").when(n == 2, F.concat(F.lit('{"k": 1, "extra": '), F.col("event_id").cast("string"), F.lit("}"))).otherwise(F.col("props"))
    return read(s, d, "events").select("event_id", raw.alias("json"))


def goal_mismatch(s, d):
    """Goals of the tracked topics, with some left out, some empty and some for topics that aren't tracked."""
    g = groupings(s, d).select("grouping", F.explode("topics").alias("topic"))
    n = F.regexp_extract("topic", "([0-9]+)", 1).cast("int")
    goals = g.filter(n % 5 != 0).select("grouping", "topic", F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("goal of "), "topic")).alias("goal"))
    extra = g.select("grouping").distinct().select("grouping", F.lit("other").alias("topic"), F.lit("x").alias("goal"))
    return quality.goal_mismatch(g, goals.unionByName(extra))


def typed_violations(s, d):
    """Events with k missing, null, as a text, or as a fraction, and records that are no object."""
    n = F.col("event_id") % 7
    raw = F.when(n == 0, "{}").when(n == 1, '{"k": null, "t": "x"}').when(n == 2, '{"k": "5", "t": 3}').when(n == 3, '{"k": 1.5}').when(n == 4, "[1]").when(n == 5, "{broken").otherwise(F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "t": "x"}')))
    return quality.typed_violations(read(s, d, "events").select("event_id", raw.alias("json")), "event_id", "json", {"k": ("integer", True), "t": ("string", False)})


def config_violations(s, d):
    """Eight groupings, each with faults of its own."""
    is_ = lambda *names: F.col("grouping").isin(*names)
    g = groupings(s, d).select(
        "grouping",
        F.when(is_("g1"), F.array().cast("array<string>")).otherwise(F.col("members")).alias("members"),
        F.when(is_("g5", "g6"), F.array().cast("array<string>")).otherwise(F.array(F.lit("peace"))).alias("topics"),
        F.when(is_("g6"), F.expr("cast(map() as map<string, string>)")).otherwise(F.create_map(F.lit("peace"), F.when(is_("g2", "g3", "g4"), F.concat(F.lit("keep the peace"), F.when(is_("g3"), " ").otherwise(""))).otherwise(F.col("grouping")))).alias("goals"),
        F.create_map(F.lit("trade"), F.when(is_("g0"), "  ").otherwise("more of it"), F.lit("travel"), F.when(~is_("g7"), "easier")).alias("tags"),
        F.when(~is_("g4"), "to meet").alias("purpose"), F.when(is_("g2"), " ").otherwise("at a table").alias("agreed"), F.when(is_("g3"), "asleep").otherwise("active").alias("status"),
    )
    return quality.config_violations(g, [f"g{i}" for i in range(7)], ["active", "inactive"])


def _nested(s, d):
    r = ratings(s, d)
    inner = r.groupBy("event", "grouping").agg(F.map_from_entries(F.collect_list(F.struct("topic", F.struct("score", "evidence")))).alias("m"))
    return inner.groupBy("event").agg(F.map_from_entries(F.collect_list(F.struct("grouping", "m"))).alias("stances"))


def cleanup_neutrals(s, d):
    c = quality.cleanup_neutrals(_nested(s, d))
    return c.select("event", F.coalesce(F.array_join(F.array_sort(F.map_keys("stances")), ","), F.lit("none")).alias("groupings"))


def backfill_flags(s, d):
    """Relevance flags from stored tags alone, with no formats named; rows that have flags keep them, so that a second run changes nothing."""
    t = taggings(s, d).withColumn("flags", F.when(F.col("event") % 6 == 0, F.array(F.lit("legacy"))))
    g = groupings(s, d).withColumnRenamed("topics", "tracked")
    once = classify.backfill_flags(t, g)
    return classify.backfill_flags(once, g).select("event", F.array_join("flags", ",").alias("flags"))


def rekey_stances(s, d):
    t = stance_topics(s, d)
    flat = t.select("event", "topic").distinct().select("event", "topic", (F.col("event") % 5 - 2).cast("int").alias("score"))
    return quality.rekey_stances(flat, t.filter("grouping <> 'g0'"))


def _areas(s, d):
    t = taggings(s, d).select("event", F.col("topics").alias("extracted"))
    return t.withColumn("areas", F.when(F.col("event") % 4 == 0, F.slice("extracted", 1, 1)).otherwise(F.col("extracted")))


def resync_areas(s, d):
    r = quality.resync(_areas(s, d), "areas", "extracted")
    return r.select("event", F.array_join("areas", ",").alias("areas"), "changed")


def migration_report(s, d):
    old = ratings(s, d).filter("grouping = 'a'").select("event", "score", "evidence")
    new = old.filter("event % 10 <> 3").withColumn("score", F.when(F.col("event") % 10 == 1, 2).otherwise(F.col("score")))
    return quality.outcome_counts(old, new, "event", ["score", "evidence"], old.filter("event % 10 = 7").select("event"))


def migration_ratings(s, d):
    """Ratings before and after the topics that a grouping doesn't track drop out."""
    r = ratings(s, d)
    return quality.ratings_by_grouping(r, r.filter("not (grouping = 'b' and topic in ('view', 'click'))").unionByName(r.filter("grouping = 'a' and event % 3 = 0").withColumn("grouping", F.lit("c"))))


def row_diff(s, d):
    old = ratings(s, d).filter("grouping = 'a'").select("event", "score", "evidence")
    new = old.withColumn("score", F.when(F.col("event") % 10 == 1, 2).otherwise(F.col("score")))
    return quality.row_diff(old, new, "event", ["score", "evidence"]).select("event", "score")


def backfill_provenance(s, d):
    """Documents of twelve sources, of which two have no language and four no method; some rows carry their own values."""
    n = F.col("doc_id")
    raw = read(s, d, "documents").select(
        F.concat(F.lit("h"), (n % 6).cast("string")).alias("prompt_hash"), "doc_id", F.col("source").alias("source_name"), F.col("lang").alias("source_lang"), (n % 2 == 0).alias("seeded"),
        F.when(n % 5 == 0, "manual").alias("collection"), F.when(n % 3 == 0, "by hand").alias("collection_method"), F.when(n % 7 == 0, "0").alias("prompt_version"),
    )
    languages = s.createDataFrame([(f"src{i}", ["de", "en", "es", "fr"][i % 4]) for i in range(10)], "source_name string, language string")
    methods = s.createDataFrame([(f"src{i}", seeded, "backfill" if seeded else "rss") for i in range(8) for seeded in (True, False)], "source_name string, seeded boolean, method string")
    versions = s.createDataFrame([(f"h{i}", str(i)) for i in range(4)], "prompt_hash string, version string")
    return quality.backfill_provenance(raw, languages, methods, versions, ["doc_id", "source_name", "collection", "collection_method", "nowhere", "prompt_version"])


def _source_runs(s, d):
    return read(s, d, "events").select(F.to_date("ts").alias("run_date"), F.col("event_id").alias("pos"), F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", F.concat(F.lit("boom "), F.col("event_id").cast("string"))).alias("error"))


def _meetings(s, d):
    """Orders as meetings: eras of two years, urgent ones as summits."""
    era = F.concat(F.lit("era"), F.floor((F.year("o_orderdate") - 1995) / 2).cast("string"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Summit").otherwise(F.col("o_orderpriority"))
    return read(s, d, "orders").select(F.col("o_orderkey").alias("meeting"), F.year("o_orderdate").alias("year"), era.alias("era"), kind.alias("type"))


def era_summary(s, d):
    """Every year counts, also those of two eras to come, of which the last has not even years; orders over 300,000 are milestones."""
    m = _meetings(s, d)
    years = s.range(1991, 2003).select(F.col("id").cast("int").alias("year"), F.concat(F.lit("era"), F.floor((F.col("id") - 1995) / 2).cast("string")).alias("era"), (F.col("id") % 7).cast("double").alias("score"))
    annual = years.join(m.groupBy("year").agg(F.count("*").alias("meetings")), "year", "left").withColumn("meetings", F.coalesce("meetings", F.lit(0)))
    eras = years.select("era").distinct().unionByName(s.createDataFrame([("era9",)], "era string"))
    stones = read(s, d, "orders").filter("o_totalprice > 300000").select(F.concat(F.lit("era"), F.floor((F.year("o_orderdate") - 1995) / 2).cast("string")).alias("era"))
    out = history.era_summary(eras, m, annual, stones)
    return out.withColumn("years", F.array_join(F.transform("years", lambda y: F.concat_ws(":", y["year"].cast("string"), y["meetings"].cast("string"))), ","))


def meeting_filter(s, d):
    return history.filter_meetings(_meetings(s, d), "era0", "2-HIGH").select("meeting", "shown", "total")


def _votes(s, d):
    return read(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("slug"), F.col("user_id").cast("string").alias("ip"), F.when(F.col("user_id") % 3 == 0, "preview.x").otherwise("x").alias("host"))


def vote_tally(s, d):
    slugs = s.createDataFrame([("click",), ("view",), ("signup",), ("nobody",)], "slug string")
    return votes.vote_tally(votes.valid_votes(_votes(s, d), slugs), TTL)


def vote_ranking(s, d):
    slugs = s.createDataFrame([("click",), ("view",), ("signup",), ("nobody",)], "slug string")
    return votes.vote_ranking(vote_tally(s, d), slugs)


def vote_env_split(s, d):
    return votes.split_env(_votes(s, d), "x").groupBy("env", "slug").agg(F.count("*").alias("n"))


def signups(s, d):
    e = read(s, d, "events")
    email = F.concat(F.lit(" User"), (F.col("user_id") % 50).cast("string"), F.when(F.col("event_id") % 4 == 0, "@x").otherwise("@X.org "))
    return votes.signups(e.select(F.col("event_type").alias("slug"), email.alias("email"), "ts"))


def quote_verbatim(s, d):
    """Three quotes of each document, some turned round, some said to be another document's: whether each is in its text, white space and
    case aside."""
    from parallax.operators.evaluate import quotes_in_texts

    r = read(s, d, "documents").select("doc_id", "text")
    cut = lambda at: F.lower(F.substring("text", at, 25))
    quotes = r.select((F.col("doc_id") - F.col("doc_id") % 2).alias("doc_id"), F.explode(F.array(F.when(F.col("doc_id") % 3 == 0, F.reverse(cut(5))).otherwise(cut(5)), cut(40), cut(5))).alias("quote"))
    return quotes_in_texts(quotes, r, "doc_id")


QUERIES = {
    "load_events": load_events,
    "schema_violations": schema_violations,
    "typed_violations": typed_violations,
    "migration_ratings": migration_ratings,
    "unknown_fields": lambda s, d: quality.unknown_fields(_props(s, d), "event_id", "json", ["k"]),
    "corrupt_records": lambda s, d: quality.corrupt_records(_props(s, d), "event_id", "json", "k int"),
    "vocab_violations": lambda s, d: quality.vocabulary_violations(taggings(s, d), "event", F.col("actors"), [f"NATION_{i}" for i in range(20)]),
    "orphan_sidecars": lambda s, d: quality.orphans(read(s, d, "orders").select("o_orderkey"), read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]),
    "violations_under_path": lambda s, d: quality.under_path(read(s, d, "pages").select("page_id", F.col("url").alias("path")), "/fr/").select("page_id"),
    "goal_mismatch": goal_mismatch,
    "config_violations": config_violations,
    "cleanup_neutrals": cleanup_neutrals,
    "backfill_flags": backfill_flags,
    "rekey_stances": rekey_stances,
    "resync_areas": resync_areas,
    "migration_report": migration_report,
    "row_diff": row_diff,
    "backfill_provenance": backfill_provenance,
    "strip_computed": lambda s, d: quality.strip_computed(read(s, d, "documents"), ["doc_id", "lang", "source"]),
    "drop_obsolete": lambda s, d: read(s, d, "documents").drop("text", "n_chars"),
    "vocabulary": lambda s, d: history.vocabulary(groupings(s, d)),
    "source_health": lambda s, d: history.source_health(_source_runs(s, d)),
    "latest_run": lambda s, d: history.latest_run(_source_runs(s, d)),
    "era_summary": era_summary,
    "meeting_filter": meeting_filter,
    "vote_tally": vote_tally,
    "vote_ranking": vote_ranking,
    "vote_env_split": vote_env_split,
    "vote_bursts": lambda s, d: votes.bursts(_votes(s, d), 1, "1 hour"),
    "vote_reset": lambda s, d: votes.reset(vote_tally(s, d), s.createDataFrame([("view",)], "slug string")),
    "signups": signups,
    "quote_verbatim": quote_verbatim,
}

VOTES = """votes AS (SELECT DISTINCT ts, event_type AS slug, user_id AS ip FROM events WHERE event_type IN ('click', 'view', 'signup')),
counted(slug, ip, ts) AS (SELECT slug, ip, min(ts) FROM votes GROUP BY ALL
  UNION ALL SELECT c.slug, c.ip, (SELECT min(v.ts) FROM votes v WHERE v.slug = c.slug AND v.ip = c.ip AND v.ts >= c.ts + INTERVAL 7 DAY) FROM counted c
  WHERE EXISTS (SELECT 1 FROM votes v WHERE v.slug = c.slug AND v.ip = c.ip AND v.ts >= c.ts + INTERVAL 7 DAY)),
tally AS (SELECT slug, count(*) AS votes FROM counted GROUP BY slug)"""
NO_FORMAT = RELEVANT.replace("e.format IS NOT DISTINCT FROM s.grouping_key OR ", "")
ORACLE = {
    "load_events": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN source WHEN d.doc_id % 3 <> 0 THEN 'labelled' END AS source, lang, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "schema_violations": "SELECT c_custkey AS key, 'negative balance' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'unknown segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') UNION ALL SELECT c_custkey, 'no name' FROM customer WHERE coalesce(c_name, '') = ''",
    "unknown_fields": "SELECT event_id AS key, 'extra' AS field FROM events WHERE event_id % 5 = 2",
    "corrupt_records": "SELECT event_id AS key, CASE event_id % 5 WHEN 0 THEN 'empty' ELSE 'invalid' END AS reason FROM events WHERE event_id % 5 < 2",
    "vocab_violations": RELEVANT + "SELECT event AS key, actor AS value FROM tag_actor WHERE CAST(substring(actor, 8) AS INT) >= 20 AND event IN (SELECT event FROM tag_event)",
    "orphan_sidecars": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "violations_under_path": "SELECT page_id FROM pages WHERE contains(url, '/fr/')",
    "goal_mismatch": f"""WITH {GROUPINGS}, t AS (SELECT grouping_key AS grouping, topic, CAST(regexp_extract(topic, '([0-9]+)', 1) AS INT) AS n FROM grouping_topic)
SELECT grouping, topic, CASE WHEN n % 5 = 0 THEN 'missing goal' ELSE 'empty goal' END AS problem FROM t WHERE n % 5 = 0 OR n % 3 = 0 UNION ALL SELECT DISTINCT grouping, 'other', 'goal without topic' FROM t""",
    "config_violations": """SELECT * FROM (VALUES ('g1', 'no members'), ('g4', 'no purpose'), ('g2', 'no agreed line'), ('g3', 'unknown status'), ('g7', 'topics but not tracked'), ('g5', 'goals but no topics'),
  ('g0', 'no objective for trade'), ('g7', 'no objective for travel'), ('g2', 'same goal for peace'), ('g3', 'same goal for peace'), ('g4', 'same goal for peace')) t(grouping, problem) WHERE grouping IN (SELECT 'g' || (n_nationkey % 8) FROM nation)""",
    "typed_violations": "SELECT event_id AS key, unnest(CASE event_id % 7 WHEN 0 THEN ['k is missing'] WHEN 1 THEN ['k is missing'] WHEN 2 THEN ['k is not integer', 't is not string'] WHEN 3 THEN ['k is not integer'] WHEN 6 THEN [] ELSE ['not an object'] END) AS rule FROM events",
    "migration_ratings": f"WITH {RATINGS} SELECT grouping_key AS grouping, count(*) AS before, count(*) FILTER (NOT (grouping_key = 'b' AND topic IN ('view', 'click'))) AS after, count(*) FILTER (grouping_key = 'b' AND topic IN ('view', 'click')) AS dropped FROM ratings GROUP BY 1 UNION ALL SELECT 'c', 0, count(*), 0 FROM ratings WHERE grouping_key = 'a' AND event % 3 = 0",
    "cleanup_neutrals": f"WITH {RATINGS} SELECT event, coalesce(string_agg(grouping_key, ',' ORDER BY grouping_key) FILTER (NOT (score = 0 AND coalesce(evidence, '') = '')), 'none') AS groupings FROM ratings GROUP BY event",
    "backfill_flags": NO_FORMAT + "SELECT e.event, CASE WHEN e.event % 6 = 0 THEN 'legacy' ELSE coalesce(string_agg(DISTINCT grouping, ',' ORDER BY grouping), '') END AS flags FROM tag_event e LEFT JOIN relevant r ON r.event = e.event GROUP BY e.event",
    "rekey_stances": RELEVANT + "SELECT event, grouping, topic, CAST(event % 5 - 2 AS INT) AS score FROM wanted WHERE grouping <> 'g0'",
    "resync_areas": RELEVANT + "SELECT event, string_agg(topic, ',' ORDER BY topic) AS areas, event % 4 = 0 AND count(*) > 1 AS changed FROM tag_topic WHERE event IN (SELECT event FROM tag_event) GROUP BY event",
    "migration_report": f"WITH {RATINGS} SELECT CASE WHEN event % 10 = 7 THEN 'failed' WHEN event % 10 = 3 THEN 'dropped' WHEN event % 10 = 1 AND score <> 2 THEN 'changed' ELSE 'unchanged' END AS outcome, count(*) AS n FROM ratings WHERE grouping_key = 'a' GROUP BY 1",
    "row_diff": f"WITH {RATINGS} SELECT event, 2 AS score FROM ratings WHERE grouping_key = 'a' AND event % 10 = 1 AND score <> 2",
    "backfill_provenance": """WITH x AS (SELECT doc_id, source AS source_name, lang, CAST(substring(source, 4) AS INT) AS i FROM documents)
SELECT doc_id, source_name, CASE WHEN doc_id % 5 = 0 THEN 'manual' WHEN i >= 10 THEN NULL WHEN ['de', 'en', 'es', 'fr'][i % 4 + 1] = lang THEN 'native' ELSE 'fallback' END AS collection,
  CASE WHEN doc_id % 3 = 0 THEN 'by hand' WHEN i >= 8 THEN NULL WHEN doc_id % 2 = 0 THEN 'backfill' ELSE 'rss' END AS collection_method,
  CASE WHEN doc_id % 7 = 0 THEN '0' WHEN doc_id % 6 < 4 THEN CAST(doc_id % 6 AS VARCHAR) ELSE 'h' || (doc_id % 6) END AS prompt_version FROM x""",
    "strip_computed": "SELECT doc_id, lang, source FROM documents",
    "drop_obsolete": "SELECT doc_id, lang, source FROM documents",
    "vocabulary": f"WITH {GROUPINGS}, p AS (SELECT grouping_key AS grouping, topic, CAST(row_number() OVER (PARTITION BY grouping_key ORDER BY topic) - 1 AS INT) AS pos FROM grouping_topic) SELECT topic, grouping, pos FROM p QUALIFY row_number() OVER (PARTITION BY topic ORDER BY grouping, pos) = 1",
    "source_health": """WITH r AS (SELECT CAST(ts AS DATE) AS run_date, event_id AS pos, user_id AS source, CASE WHEN event_type = 'error' THEN 'boom ' || CAST(event_id AS VARCHAR) END AS error FROM events),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY run_date DESC, pos DESC) = 1), k AS (SELECT source, max(run_date) FILTER (error IS NULL) AS last_ok FROM r GROUP BY source)
SELECT k.source, last_ok, error AS last_error, CASE WHEN error IS NOT NULL THEN run_date END AS error_date FROM k JOIN l ON l.source = k.source""",
    "latest_run": "SELECT CAST(ts AS DATE) AS run_date, user_id AS source, count(*) AS runs, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY ALL",
    "era_summary": """WITH m AS (SELECT year(o_orderdate) AS year, 'era' || CAST(floor((year(o_orderdate) - 1995) / 2) AS INT) AS era, o_orderpriority AS p, o_totalprice AS t FROM orders),
y AS (SELECT CAST(n AS INT) AS year, 'era' || CAST(floor((n - 1995) / 2) AS INT) AS era, CAST(n % 7 AS DOUBLE) AS score, (SELECT count(*) FROM m WHERE m.year = n) AS meetings FROM (SELECT unnest(generate_series(1991, 2002)) AS n)),
a AS (SELECT era, avg(score) AS score, count(*) FILTER (meetings = 0) AS silent, string_agg(year || ':' || meetings, ',' ORDER BY year) AS years FROM y GROUP BY era),
c AS (SELECT era, count(*) AS meetings, count(*) FILTER (p = '1-URGENT') AS summits, count(*) FILTER (t > 300000) AS milestones FROM m GROUP BY era)
SELECT e.era, coalesce(meetings, 0) AS meetings, coalesce(summits, 0) AS summits, coalesce(score, 0) AS score, coalesce(milestones, 0) AS milestones, coalesce(silent, 0) AS silent, years
FROM (SELECT DISTINCT era FROM y UNION ALL SELECT 'era9') e LEFT JOIN a ON a.era = e.era LEFT JOIN c ON c.era = e.era""",
    "meeting_filter": "WITH h AS (SELECT o_orderkey AS meeting FROM orders WHERE year(o_orderdate) IN (1995, 1996) AND o_orderpriority = '2-HIGH') SELECT meeting, (SELECT count(*) FROM h) AS shown, (SELECT count(*) FROM orders) AS total FROM h",
    "vote_tally": f"WITH RECURSIVE {VOTES} SELECT * FROM tally",
    "vote_ranking": f"WITH RECURSIVE {VOTES}, j AS (SELECT s.slug, coalesce(votes, 0) AS votes FROM (VALUES ('click'), ('view'), ('signup'), ('nobody')) s(slug) LEFT JOIN tally t ON t.slug = s.slug) SELECT slug, votes, row_number() OVER (ORDER BY votes DESC, slug) AS rank, CAST(sum(votes) OVER () AS BIGINT) AS total FROM j",
    "vote_env_split": "SELECT CASE WHEN user_id % 3 = 0 THEN 'preview' ELSE 'production' END AS env, event_type AS slug, count(*) AS n FROM events GROUP BY ALL",
    "vote_bursts": "SELECT CAST(user_id AS VARCHAR) AS ip, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "vote_reset": f"WITH RECURSIVE {VOTES} SELECT * FROM tally WHERE slug <> 'view'",
    "signups": "SELECT event_type AS slug, 'user' || CAST(user_id % 50 AS VARCHAR) || '@x.org' AS email, max(ts) AS ts FROM events WHERE event_id % 4 <> 0 GROUP BY ALL",
    "quote_verbatim": """WITH q AS (SELECT DISTINCT doc_id - doc_id % 2 AS doc_id, unnest([CASE WHEN doc_id % 3 = 0 THEN reverse(lower(substring(text, 5, 25))) ELSE lower(substring(text, 5, 25)) END, lower(substring(text, 40, 25)), lower(substring(text, 5, 25))]) AS quote FROM documents)
SELECT doc_id, quote, contains(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))), lower(trim(regexp_replace(quote, '[ \\t\\n\\r]+', ' ', 'g')))) AS verbatim FROM q JOIN documents USING (doc_id)""",
}
