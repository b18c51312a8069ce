"""Queries of the evaluation, with their SQL. Gold and predictions are rules over events, so that they grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallax.operators import evaluate
from parallax.sources.adapters import STATEMENTS, TOPICS, statements

GROUPINGS = ["a", "b", "c"]
RUNS = 2


def _cases(s, d):
    return statements(s, d).select(F.col("event_id").alias("case"), "actor", "topic", "score", "k")


def _runs(df):
    return df.withColumn("run", F.explode(F.array(*map(F.lit, range(RUNS)))))


def gold_sets(s, d):
    """Topics and relevance are ungraded in a tenth of the cases, actors in a sixth."""
    c = _cases(s, d)
    values = {
        "topics": F.array_distinct(F.array("topic", F.when(F.col("k") % 3 == 0, "view").otherwise(F.col("topic")))),
        "relevant": F.filter(F.array(*map(F.lit, GROUPINGS)), lambda g: (F.ascii(g) + F.col("k")) % 2 == 0),
        "actors": F.array_distinct(F.array("actor", F.when(F.col("k") % 5 == 0, "DE").otherwise(F.col("actor")))),
        "explicit_formats": F.when(F.col("k") % 4 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")),
    }
    f = F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("field", "values")
    scored = F.when(F.col("field").isin("topics", "relevant"), F.col("k") % 10 != 9).when(F.col("field") == "actors", F.col("k") % 6 != 5).otherwise(True)
    return c.select("case", "k", f).select("case", "field", "values", scored.alias("scored"))


#: Cases fail in one of the runs only, after two attempts; others are tried twice as well.
FAILED = "(k + run) % 20 = 19"


def pred_cases(s, d):
    return _runs(_cases(s, d)).select("run", "case", F.expr(FAILED).alias("failed"), F.when(F.expr(FAILED) | (F.col("k") % 4 == 0), 2).otherwise(1).alias("attempts"))


def pred_sets(s, d):
    """Actors are missing where k is a multiple of 13."""
    c = _runs(_cases(s, d)).filter(f"not ({FAILED})")
    values = {
        "topics": F.array(F.when((F.col("k") + F.col("run")) % 5 == 0, "error").otherwise(F.col("topic"))),
        "relevant": F.filter(F.array(*map(F.lit, GROUPINGS)), lambda g: (F.ascii(g) + F.col("k")) % 3 != 0),
        "actors": F.array(F.when(F.col("k") % 5 == 2, "XX").otherwise(F.col("actor"))),
        "explicit_formats": F.when((F.col("k") + F.col("run")) % 4 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")),
    }
    f = F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("field", "values")
    return c.select("run", "case", "k", f).filter("not (field = 'actors' and k % 13 = 0)").select("run", "case", "field", "values")


def gold_stances(s, d):
    c = _cases(s, d).withColumn("grouping", F.explode(F.array(F.lit("a"), F.lit("b"))))
    expected = F.when(F.col("k") % 6 == 0, F.lit(None)).when(F.col("grouping") == "b", -F.col("score")).otherwise(F.col("score"))
    return c.select("case", "grouping", "topic", expected.alias("expected"))


def pred_asked(s, d):
    c = _runs(_cases(s, d)).filter(f"not ({FAILED})").withColumn("grouping", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return c.filter("not (k % 7 = 0 and grouping = 'b')").select("run", "case", "grouping", "topic")


def pred_stances(s, d):
    c = _runs(_cases(s, d)).filter(f"not ({FAILED})").withColumn("grouping", F.explode(F.array(F.lit("a"), F.lit("b"))))
    score = F.when(F.col("grouping") == "b", -F.col("score")).otherwise(F.col("score")) + F.when((F.col("k") + F.col("run")) % 4 == 0, 1).otherwise(0)
    n = F.col("k") % 9
    evidence = F.when(n == 0, F.lit(None)).when(n == 1, F.concat(F.lit(" QUOTE\t "), F.col("k").cast("string"))).when(n == 2, "nowhere in it").when(n == 3, F.concat(F.lit("back the goal of "), "topic")).when(n == 4, "   ").otherwise(F.concat(F.lit("quote "), F.col("k").cast("string")))
    return c.filter("not (k % 7 = 0 and grouping = 'b') and k % 8 <> 1").select("run", "case", "grouping", "topic", F.least(F.lit(2), score).alias("score"), evidence.alias("evidence"))


def case_texts(s, d):
    return _cases(s, d).select("case", F.concat(F.lit("Text about "), "topic", F.lit(":  quote\n"), F.col("k").cast("string"), F.lit(".")).alias("text"))


def goals(s):
    """Every topic but one has a goal in grouping a; none has in b but `view`, so that other quotes there hold the empty one."""
    rows = [("a", t, f"to back the goal of {t}") for t in TOPICS if t != "signup"] + [("a", "signup", "signup goal"), *(("b", t, f"goal {t} b") for t in TOPICS)]
    return s.createDataFrame([r for r in rows if r[:2] != ("b", "click")], "grouping string, topic string, goal string")


def _pairs(s, d):
    return evaluate.labelled_pairs(pred_cases(s, d), gold_stances(s, d), pred_asked(s, d), pred_stances(s, d))


def _counts(s, d):
    return evaluate.stance_counts(_pairs(s, d))


def _all(s, d):
    return evaluate.all_metrics(gold_sets(s, d), pred_sets(s, d), pred_cases(s, d), gold_stances(s, d), pred_asked(s, d), pred_stances(s, d), case_texts(s, d), goals(s), GROUPINGS)


def _baselines(s):
    return s.createDataFrame([("v8", "stance_exact", 0.7), ("v8", "stance_mae", 0.1), ("v8", "topics_f1", 0.5), ("v7", "topics_f1", 0.4)], "version string, metric string, value double")


def _means(s, d):
    return evaluate.over_repeats(_all(s, d))


def metric_vs_baseline(s, d):
    c = evaluate.compare(_means(s, d), _baselines(s), "v8", 0.0001)
    return c.select("metric", *[F.round(x, 6).alias(x) for x in ("mean", "base", "floor")], "verdict")


def gold_consistency(s, d):
    g = gold_sets(s, d).filter("field = 'relevant'").select("case", "values")
    return evaluate.gold_consistency(g, g.withColumn("values", F.when(F.col("case") % 11 == 0, F.array(F.lit("zz"))).otherwise(F.col("values"))))


def run_comparability(s, d):
    cols = {"cases": F.count_distinct("case"), "rows": F.count("*"), "topics": F.count_distinct("topic")}
    fp = lambda df: df.agg(*[v.alias(k) for k, v in cols.items()])
    return evaluate.comparability(fp(gold_stances(s, d)), fp(pred_asked(s, d).filter("run = 0")), list(cols))


def _round(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


QUERIES = {
    "eval_sets": lambda s, d: _round(evaluate.set_metrics(gold_sets(s, d), pred_sets(s, d), pred_cases(s, d)), "exact", "f1"),
    "eval_relevance": lambda s, d: _round(evaluate.relevance_accuracy(gold_sets(s, d), pred_sets(s, d), pred_cases(s, d), GROUPINGS), "accuracy"),
    "eval_stances": lambda s, d: _round(evaluate.stance_metrics(_counts(s, d)), "exact", "within_1", "mae", "sign"),
    "eval_abstention": lambda s, d: _round(evaluate.abstention(_counts(s, d)), "recall", "precision"),
    "eval_discrimination": lambda s, d: evaluate.discrimination(_pairs(s, d)),
    "eval_evidence": lambda s, d: evaluate.evidence_checks(pred_cases(s, d), pred_stances(s, d), case_texts(s, d), goals(s)),
    "eval_rates": lambda s, d: _round(evaluate.rates(pred_cases(s, d), _counts(s, d)), "parse_failure_rate", "retry_rate", "coverage"),
    "eval_metrics": lambda s, d: _round(_all(s, d), "value"),
    "flip_rate": lambda s, d: _round(evaluate.flip_rate(gold_sets(s, d), pred_sets(s, d), gold_stances(s, d), pred_stances(s, d), pred_cases(s, d)), "rate"),
    "eval_repeats": lambda s, d: _round(_means(s, d), "mean", "least", "most", "n"),
    "metric_vs_baseline": metric_vs_baseline,
    "metric_gate": lambda s, d: _round(evaluate.gate(_means(s, d), s.createDataFrame([("stance_exact", 0.99), ("retry_rate", 0.0)], "metric string, threshold double")), "mean", "n"),
    "baseline_upsert": lambda s, d: _round(evaluate.upsert_baseline(_baselines(s), _means(s, d), "v8"), "value"),
    "gold_consistency": gold_consistency,
    "run_comparability": run_comparability,
}

GOALS = "goals(grouping, topic, goal) AS (VALUES " + ", ".join([*(f"('a', '{t}', 'to back the goal of {t}')" for t in TOPICS if t != "signup"), "('a', 'signup', 'signup goal')", *(f"('b', '{t}', 'goal {t} b')" for t in TOPICS if t != "click")]) + ")"

#: One row for each decision, counted as the definitions say; retries and failures, graded fields and labelled pairs are told apart here.
E = f"""WITH {STATEMENTS}, {GOALS},
c AS (SELECT event_id AS case_, actor, topic, score, k FROM statements),
r(run) AS (VALUES (0), (1)), g(grouping, code) AS (VALUES ('a', 97), ('b', 98), ('c', 99)), ab(grouping, sgn) AS (VALUES ('a', 1), ('b', -1)),
cases AS (SELECT run, case_, k, (k + run) % 20 = 19 AS failed, CASE WHEN (k + run) % 20 = 19 OR k % 4 = 0 THEN 2 ELSE 1 END AS attempts FROM c, r),
ok AS (SELECT run, c.case_, actor, topic, score, c.k FROM c JOIN cases x ON x.case_ = c.case_ WHERE NOT failed),
gold_value AS (
  SELECT DISTINCT 'topics' AS field, case_, k, unnest(CASE WHEN k % 3 = 0 THEN [topic, 'view'] ELSE [topic] END) AS v FROM c UNION ALL
  SELECT 'relevant', case_, k, grouping FROM c, g WHERE (code + k) % 2 = 0 UNION ALL
  SELECT DISTINCT 'actors', case_, k, unnest(CASE WHEN k % 5 = 0 THEN [actor, 'DE'] ELSE [actor] END) FROM c UNION ALL
  SELECT 'explicit_formats', case_, k, 'a' FROM c WHERE k % 4 = 1),
fields(field) AS (VALUES ('topics'), ('relevant'), ('actors'), ('explicit_formats')),
graded AS (SELECT field, case_, k FROM c, fields WHERE CASE field WHEN 'actors' THEN k % 6 <> 5 WHEN 'explicit_formats' THEN true ELSE k % 10 <> 9 END),
pred_value AS (
  SELECT 'topics' AS field, run, case_, CASE WHEN (k + run) % 5 = 0 THEN 'error' ELSE topic END AS v FROM ok UNION ALL
  SELECT 'relevant', run, case_, grouping FROM ok, g WHERE (code + k) % 3 <> 0 UNION ALL
  SELECT 'actors', run, case_, CASE WHEN k % 5 = 2 THEN 'XX' ELSE actor END FROM ok WHERE k % 13 <> 0 UNION ALL
  SELECT 'explicit_formats', run, case_, 'a' FROM ok WHERE (k + run) % 4 = 1),
gold_size AS (SELECT field, case_, count(*) AS ng FROM gold_value GROUP BY ALL), pred_size AS (SELECT field, run, case_, count(*) AS np FROM pred_value GROUP BY ALL),
hit AS (SELECT p.field, p.run, p.case_, count(*) AS tp FROM pred_value p JOIN gold_value g ON g.field = p.field AND g.case_ = p.case_ AND g.v = p.v GROUP BY ALL),
sets AS (SELECT o.run, d.field, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng FROM ok o JOIN graded d ON d.case_ = o.case_
  LEFT JOIN gold_size a ON a.field = d.field AND a.case_ = o.case_ LEFT JOIN pred_size b ON b.field = d.field AND b.case_ = o.case_ AND b.run = o.run LEFT JOIN hit h ON h.field = d.field AND h.case_ = o.case_ AND h.run = o.run),
set_metrics AS (SELECT run, field, avg(CAST(tp = np AND np = ng AS INT)) AS exact, count(*) AS n_exact, 2 * sum(tp) / nullif(sum(np + ng), 0) AS f1, CAST(sum(ng) AS BIGINT) AS n_f1 FROM sets GROUP BY ALL),
relevance AS (SELECT run, avg(CAST(((code + k) % 2 = 0) = ((code + k) % 3 <> 0) AS INT)) AS accuracy, count(*) AS n FROM ok, g WHERE k % 10 <> 9 GROUP BY run),
gold AS (SELECT case_, grouping, topic, k, CASE WHEN k % 6 = 0 THEN NULL ELSE sgn * score END AS expected, sgn FROM c, ab),
asked AS (SELECT run, o.case_, grouping, topic, k FROM ok o, ab WHERE NOT (k % 7 = 0 AND grouping = 'b')),
pred AS (SELECT a.run, a.case_, a.grouping, a.topic, least(2, sgn * score + CASE WHEN (a.k + run) % 4 = 0 THEN 1 ELSE 0 END) AS score,
  CASE a.k % 9 WHEN 0 THEN NULL WHEN 1 THEN 'QUOTE ' || a.k WHEN 2 THEN 'nowhere in it' WHEN 3 THEN 'back the goal of ' || a.topic WHEN 4 THEN '' ELSE 'quote ' || a.k END AS quote, a.k
  FROM asked a JOIN c ON c.case_ = a.case_ JOIN ab ON ab.grouping = a.grouping WHERE a.k % 8 <> 1),
pairs AS (SELECT o.run, g.case_, g.grouping, g.topic, expected, a.case_ IS NOT NULL AS asked, p.score FROM ok o JOIN gold g ON g.case_ = o.case_
  LEFT JOIN asked a ON a.run = o.run AND a.case_ = g.case_ AND a.grouping = g.grouping LEFT JOIN pred p ON p.run = o.run AND p.case_ = g.case_ AND p.grouping = g.grouping),
st AS (SELECT run, count(*) AS n, count(*) FILTER (score = expected) AS e, count(*) FILTER (abs(score - expected) <= 1) AS w, count(score) AS n_mae, sum(abs(score - expected)) AS d,
  count(*) FILTER (sign(score) = sign(expected)) AS s FROM pairs WHERE asked AND expected IS NOT NULL GROUP BY run),
stances AS (SELECT run, e / n AS exact, w / n AS within_1, n, d / n_mae AS mae, n_mae, s / n_mae AS sign, n_mae AS n_sign FROM st),
abst AS (SELECT run, count(*) FILTER (expected IS NULL AND score IS NULL) AS b, count(*) FILTER (expected IS NULL) AS n_recall, count(*) FILTER (score IS NULL) AS n_precision FROM pairs WHERE asked GROUP BY run),
abstention AS (SELECT run, b / nullif(n_recall, 0) AS recall, n_recall, b / nullif(n_precision, 0) AS precision, n_precision FROM abst),
disc_case AS (SELECT run, case_, count(DISTINCT coalesce(CAST(expected AS VARCHAR), '-')) AS want, count(DISTINCT coalesce(CAST(score AS VARCHAR), '-')) AS got, bool_and(asked) AS asked FROM pairs GROUP BY ALL),
disc AS (SELECT run, count(*) FILTER (got >= 2) AS hits, count(*) AS n FROM disc_case WHERE want >= 2 AND asked GROUP BY run),
evidence AS (SELECT p.run, count(*) AS n, count(*) FILTER (contains('text about ' || p.topic || ': quote ' || p.k || '.', lower(quote))) AS verbatim,
  count(*) FILTER (contains(coalesce(goal, ''), quote) OR contains(quote, coalesce(goal, ''))) AS goal_copies
  FROM pred p LEFT JOIN goals g ON g.grouping = p.grouping AND g.topic = p.topic WHERE quote <> '' GROUP BY p.run),
rate AS (SELECT run, avg(CAST(failed AS INT)) AS parse_failure_rate, avg(CAST(attempts > 1 AND NOT failed AS INT)) AS retry_rate, count(*) AS n FROM cases GROUP BY run),
rates AS (SELECT x.*, coverage, n_coverage FROM rate x LEFT JOIN (SELECT run, count(*) FILTER (asked) / count(*) AS coverage, count(*) AS n_coverage FROM pairs GROUP BY run) y ON y.run = x.run),
metrics AS (SELECT run, 'actors_exact' AS metric, exact AS value, n_exact AS n FROM set_metrics WHERE field = 'actors' UNION ALL SELECT run, 'actors_f1', f1, n_f1 FROM set_metrics WHERE field = 'actors'
  UNION ALL SELECT run, 'formats_exact', exact, n_exact FROM set_metrics WHERE field = 'explicit_formats' UNION ALL SELECT run, 'topics_f1', f1, n_f1 FROM set_metrics WHERE field = 'topics'
  UNION ALL SELECT run, 'relevance_accuracy', accuracy, n FROM relevance UNION ALL SELECT run, 'stance_exact', exact, n FROM stances UNION ALL SELECT run, 'stance_within_1', within_1, n FROM stances
  UNION ALL SELECT run, 'stance_mae', mae, n_mae FROM stances UNION ALL SELECT run, 'sign_agreement', sign, n_sign FROM stances UNION ALL SELECT run, 'abstention_recall', recall, n_recall FROM abstention
  UNION ALL SELECT run, 'abstention_precision', precision, n_precision FROM abstention UNION ALL SELECT run, 'goal_discrimination', hits / n, n FROM disc
  UNION ALL SELECT run, 'evidence_verbatim', verbatim / n, n FROM evidence UNION ALL SELECT run, 'evidence_goal_copy', goal_copies / n, n FROM evidence
  UNION ALL SELECT run, 'parse_failure_rate', parse_failure_rate, n FROM rates UNION ALL SELECT run, 'retry_rate', retry_rate, n FROM rates UNION ALL SELECT run, 'stance_coverage', coverage, n_coverage FROM rates),
means AS (SELECT metric, avg(value) AS mean, min(value) AS least, max(value) AS most, avg(n) AS n FROM metrics WHERE value IS NOT NULL GROUP BY metric),
set_answer AS (SELECT field, run, case_, string_agg(v, ',' ORDER BY v) AS answer FROM pred_value GROUP BY ALL),
answers AS (SELECT d.case_, d.field AS what, coalesce(answer, '') AS answer FROM graded d CROSS JOIN r LEFT JOIN set_answer a ON a.field = d.field AND a.case_ = d.case_ AND a.run = r.run
  UNION ALL SELECT g.case_, g.grouping || '/' || g.topic, coalesce(CAST(score AS VARCHAR), '-') FROM gold g CROSS JOIN r LEFT JOIN pred p ON p.run = r.run AND p.case_ = g.case_ AND p.grouping = g.grouping),
flips AS (SELECT case_, what, count(DISTINCT answer) AS answers FROM answers GROUP BY ALL)
"""
ORACLE = {
    "eval_sets": E + "SELECT run, field, round(exact, 6) AS exact, n_exact, round(f1, 6) AS f1, n_f1 FROM set_metrics",
    "eval_relevance": E + "SELECT run, round(accuracy, 6) AS accuracy, n FROM relevance",
    "eval_stances": E + "SELECT run, round(exact, 6) AS exact, round(within_1, 6) AS within_1, n, round(mae, 6) AS mae, n_mae, round(sign, 6) AS sign, n_sign FROM stances",
    "eval_abstention": E + "SELECT run, round(recall, 6) AS recall, n_recall, round(precision, 6) AS precision, n_precision FROM abstention",
    "eval_discrimination": E + "SELECT * FROM disc",
    "eval_evidence": E + "SELECT * FROM evidence",
    "eval_rates": E + "SELECT run, round(parse_failure_rate, 6) AS parse_failure_rate, round(retry_rate, 6) AS retry_rate, n, round(coverage, 6) AS coverage, n_coverage FROM rates",
    "eval_metrics": E + "SELECT run, metric, round(value, 6) AS value, n FROM metrics WHERE value IS NOT NULL",
    "flip_rate": E + "SELECT count(*) AS decisions, count(*) FILTER (answers > 1) AS flips, round(avg(CAST(answers > 1 AS INT)), 6) AS rate FROM flips",
    "eval_repeats": E + "SELECT metric, round(mean, 6) AS mean, round(least, 6) AS least, round(most, 6) AS most, round(n, 6) AS n FROM means",
    "metric_vs_baseline": E + """, b(metric, base) AS (VALUES ('stance_exact', CAST(0.7 AS DOUBLE)), ('stance_mae', 0.1), ('topics_f1', 0.5)),
j AS (SELECT m.metric, mean, base, greatest(CAST(0.0001 AS DOUBLE), CAST(1 AS DOUBLE) / n) AS floor, CASE WHEN m.metric = 'stance_mae' THEN base - mean ELSE mean - base END AS gain FROM means m LEFT JOIN b ON b.metric = m.metric)
SELECT metric, round(mean, 6) AS mean, round(base, 6) AS base, round(floor, 6) AS floor, CASE WHEN base IS NULL THEN 'new' WHEN abs(gain) <= floor THEN 'within noise' WHEN gain > 0 THEN 'better' ELSE 'worse' END AS verdict FROM j""",
    "metric_gate": E + "SELECT metric, round(mean, 6) AS mean, least, most, round(n, 6) AS n, CAST(CASE metric WHEN 'stance_exact' THEN 0.99 ELSE 0.0 END AS DOUBLE) AS threshold FROM means WHERE (metric = 'stance_exact' AND mean < 0.99) OR (metric = 'retry_rate' AND mean < 0)",
    "baseline_upsert": E + "SELECT 'v7' AS version, 'topics_f1' AS metric, CAST(0.4 AS DOUBLE) AS value UNION ALL SELECT 'v8', metric, round(mean, 6) FROM means",
    "gold_consistency": E + "SELECT case_ AS \"case\", 'labels differ from rules' AS problem FROM c WHERE case_ % 11 = 0",
    "run_comparability": E + "SELECT 'cases' AS fingerprint, (SELECT count(DISTINCT case_) FROM gold) = (SELECT count(DISTINCT case_) FROM asked WHERE run = 0) AS same UNION ALL SELECT 'rows', (SELECT count(*) FROM gold) = (SELECT count(*) FROM asked WHERE run = 0) UNION ALL SELECT 'topics', (SELECT count(DISTINCT topic) FROM gold) = (SELECT count(DISTINCT topic) FROM asked WHERE run = 0)",
}
