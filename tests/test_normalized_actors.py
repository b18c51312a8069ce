"""Actors' codes are made once for each event, and its lines dealt out before their sets are gathered."""

from pyspark.sql import functions as F

from parallax.operators import classify
from parallax.plans import classification


def test_codes_are_made_once(spark):
    rows = [(1, [" a ", "B", "b", None, "zz", "third"], "D", True), (2, None, "A", False), (3, None, None, True), (4, ["c"], "X", True)]
    df = spark.createDataFrame(rows, "event int, raw array<string>, country string, known boolean")
    out = df.select("event", classify.normalize_actors(F.col("raw"), {"THIRD": "C"}, ["D", "C", "B", "A"], F.col("country"), F.col("known")).alias("x"))
    assert {r.event: r.x for r in out.collect()} == {1: ["D", "C", "B", "A"], 2: [], 3: [], 4: ["C"]}
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_dealt_out_before_sets(spark):
    plan = classification.QUERIES["normalize_actors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    first_set = plan.rindex("partial_collect_set")
    assert "REPARTITION_BY_NUM" in plan[first_set:]
