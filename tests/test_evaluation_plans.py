"""Plans of the evaluation: tables come together by case in one shuffle, however many metrics there are."""

import re

from parallax.operators import evaluate
from parallax.plans import evaluation

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, what):
    return len(re.findall(rf"\b{what}\b", plan(df).split("== Initial Plan ==")[0]))


def test_metrics_are_one_short_plan(spark):
    for name in ("eval_metrics", "eval_repeats", "metric_gate", "metric_vs_baseline", "baseline_upsert"):
        df = evaluation.QUERIES[name](spark, SF)
        assert count(df, "Exchange") <= 6 and count(df, "SortMergeJoin") <= 1, name


def test_evidence_takes_many_cases_at_once(spark):
    df = evaluation.QUERIES["eval_evidence"](spark, SF)
    assert "CoGroup" not in plan(df) and count(df, "Exchange") <= 3 and count(df, "SortMergeJoin") == 0


def test_flips_shuffle_each_row_once(spark):
    df = evaluation.QUERIES["flip_rate"](spark, SF)
    assert count(df, "Expand") == 0 and count(df, "SortMergeJoin") == 0 and count(df, "Exchange") <= 4


def test_score_that_is_null_is_an_omission(spark):
    gold = spark.createDataFrame([("c", "topics", ["x"], True)], "case string, field string, values array<string>, scored boolean")
    none = spark.createDataFrame([], "run int, case string, field string, values array<string>")
    pair = spark.createDataFrame([("c", "g", "t", 1)], "case string, grouping string, topic string, expected int")
    pred = spark.createDataFrame([(0, "c", "g", "t", 1), (1, "c", "g", "t", None)], "run int, case string, grouping string, topic string, score int")
    runs = spark.createDataFrame([(0,), (1,)], "run int")
    assert tuple(evaluate.flip_rate(gold, none, pair, pred, runs).first()) == (2, 1, 0.5)


def test_many_quotes_and_several_texts(spark):
    quotes = spark.createDataFrame([("a", f"word {i}") for i in range(30)] + [("b", None), ("c", "x")], "case string, quote string")
    texts = spark.createDataFrame([("a", "WORD  3 and word 12"), ("a", "word 25"), ("b", ""), ("d", "x")], "case string, text string")
    got = {(r["case"], r.quote): r.verbatim for r in evaluate.quotes_in_texts(quotes, texts).collect()}
    assert len(got) == 32 and {k for k, v in got.items() if v} == {("a", f"word {i}") for i in (1, 2, 3, 12, 25)} | {("b", None)}
