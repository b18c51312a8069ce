"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and its neighbours: summed up first, then joined, so that a hub's rows may be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    own = linked.select("u", F.col("m").alias("v"))
    others = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others).filter("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (u, v) of longs: (node, component) for each node that has an edge, component being the least node that it reaches.

    Loops, repeated edges and either direction are allowed; edges with a null end are dropped; no edges give no rows. Each round is
    written to the shared folder, so a lost executor costs one round at most.
    """
    now = staged(edges.filter("u is not null and v is not null and u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        now = staged(_small_star(_large_star(now)), "edges")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (row["n"], row["h"]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = row["n"], row["h"]
    raise RuntimeError("components did not settle")
