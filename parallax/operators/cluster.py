"""Anchored clusters: statements of two actors or more on one topic within a window, newest first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parallax.functions.columns import agreement_color, fmt_stance, half_up, json_string
from parallax.operators.stance import actor_means, spread_of_means


def drop_other(areas: Column | str) -> Column:
    """Areas without `other`, which stands for none."""
    return F.filter(areas, lambda a: a != "other")


def explode_areas(events: DataFrame, sources: DataFrame, topics: DataFrame, areas: str = "areas") -> DataFrame:
    """A row for each listed area of an event, as topic, with the actor of its source. Events of unmapped sources, areas that topics
    (topic) doesn't list and `other` drop out; an area that an event names twice counts twice."""
    rows = events.withColumn("topic", F.explode(drop_other(areas))).drop(areas)
    return rows.join(sources.select("source", "actor"), "source").join(topics.select("topic"), "topic", "left_semi")


def fold_anchors(days: str, gap_days: int, newest_first: bool = True) -> str:
    """SQL: of sorted days the ones that begin a cluster, each more than gap_days past the one before."""
    gap = "datediff(element_at(acc, -1), x)" if newest_first else "datediff(x, element_at(acc, -1))"
    return f"aggregate({days}, cast(array() as array<date>), (acc, x) -> CASE WHEN size(acc) = 0 OR {gap} > {gap_days} THEN concat(acc, array(x)) ELSE acc END)"


def anchored_items(items: DataFrame, window_days: int = 7, keys: tuple[str, ...] = ("topic",)) -> DataFrame:
    """items with `anchor`: the newest unused date of the topic takes all unused items of the window_days before it, and so on.

    Anchors depend on the distinct dates of a topic only, so that only those are gathered; the items themselves are joined.
    """
    days = items.filter("date is not null").groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_set("date"))).alias("days"))
    anchors = days.select(*keys, F.explode(F.expr(fold_anchors("days", window_days))).alias("anchor"))
    dated = anchors.select(*keys, "anchor", F.explode(F.expr(f"sequence(date_sub(anchor, {window_days}), anchor)")).alias("date"))
    first = dated.groupBy(*keys, "date").agg(F.max("anchor").alias("anchor"))  # windows do not overlap
    return items.join(first, [*keys, "date"])


def anchored_clusters(items: DataFrame, window_days: int = 7) -> DataFrame:
    """Items of the clusters with two actors or more, one for each (actor, url): the newest, then the least id."""
    placed = anchored_items(items, window_days)
    actors = placed.groupBy("topic", "anchor").agg(F.countDistinct("actor").alias("actors")).filter("actors >= 2").select("topic", "anchor")
    kept = placed.join(actors, ["topic", "anchor"])
    order = Window.partitionBy("topic", "anchor", "actor", "url").orderBy(F.desc("date"), "event_id")
    return kept.withColumn("_turn", F.row_number().over(order)).filter("_turn = 1").drop("_turn")


def cluster_summary(items: DataFrame) -> DataFrame:
    """One row per cluster: actors, dates and size."""
    g = items.groupBy("topic", "anchor").agg(F.array_sort(F.collect_set("actor")).alias("actors"), F.min("date").alias("date_from"), F.max("date").alias("date_to"), F.count("*").alias("items"))
    return g.withColumn("actors", F.array_join("actors", ","))


def latest_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in the order given."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_turn = 1").drop("_turn")


def latest_cluster(clusters: DataFrame) -> DataFrame:
    return latest_per(clusters, ["topic"], [F.desc("date_to")])


def score_clusters(items: DataFrame) -> DataFrame:
    """Mean of each actor, spread and unweighted overall mean of the clusters with two scored actors."""
    return spread_of_means(actor_means(items.filter("score is not null"), "topic", "anchor"), "topic", "anchor")


def convergence(items: DataFrame) -> DataFrame:
    """(topic, anchor, per_actor, spread, overall, display, label, color, n) of the clusters with two scored actors: spread to one digit,
    overall to two; per_actor is an array of (actor, stance, n)."""
    means = actor_means(items.filter("score is not null"), "topic", "anchor")
    each = means.groupBy("topic", "anchor").agg(F.array_sort(F.collect_list(F.struct("actor", half_up(F.col("mean"), 1).alias("stance"), "n"))).alias("per_actor"))  # an entry for each actor
    s = spread_of_means(means, "topic", "anchor").drop("per_actor").join(each, ["topic", "anchor"])
    return s.select("topic", "anchor", "per_actor", half_up(F.col("spread_raw"), 1).alias("spread"), half_up(F.col("overall_raw"), 2).alias("overall"), fmt_stance(half_up(F.col("overall_raw"), 1)).alias("display"), "label", agreement_color(F.col("label")).alias("color"), F.col("n_events").alias("n"))


def cluster_keys(items: DataFrame, path: str = "path") -> DataFrame:
    """(topic, anchor, cluster_key): 12 hex digits of the sha256 of the JSON array of the sorted paths.

    A task reads its clusters' paths in order and feeds the digest with them, batch by batch, so that it holds one digest and one batch,
    whatever the number of paths.
    """
    rows = items.filter(F.col(path) != "").select("topic", "anchor", F.col(path).alias("path"), json_string(F.col(path)).alias("text"))
    shape = StructType([rows.schema["topic"], rows.schema["anchor"], StructField("cluster_key", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((*kinds, pa.string()))], shape.names)

        for batch in batches:
            kinds = [batch.column(i).type for i in (0, 1)]
            done = []
            for topic, anchor, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if digest is None or now != (topic, anchor):
                    if digest is not None:
                        digest.update(b"]")
                        done.append((*now, digest.hexdigest()[:12]))
                    now, digest = (topic, anchor), hashlib.sha256(b"[")
                else:
                    digest.update(b", ")
                digest.update(text.encode())
            yield out(done)
        if digest is not None:
            digest.update(b"]")
            yield out([(*now, digest.hexdigest()[:12])])

    return rows.repartition("topic", "anchor").sortWithinPartitions("topic", "anchor", "path").mapInArrow(run, shape)


def representative_positions(items: DataFrame) -> DataFrame:
    """Each actor's newest position in a cluster, for clusters where two actors have one."""
    spoken = items.filter("position is not null and trim(position) <> ''")
    first = latest_per(spoken, ["topic", "anchor", "actor"], [F.desc("date"), "event_id"]).select("topic", "anchor", "actor", "position")
    enough = first.groupBy("topic", "anchor").count().filter("count >= 2").select("topic", "anchor")
    return first.join(enough, ["topic", "anchor"])


def cluster_rows(items: DataFrame, actors: list[str]) -> DataFrame:
    """(topic, anchor, actor_rank, actor, date, event_id, score): a cluster's items as rows, whatever their number; actors in the order
    given, an actor's items to be read by date, newest first."""
    rank = F.array_position(F.array(*map(F.lit, actors)), F.col("actor")) - 1
    return items.select("topic", "anchor", rank.alias("actor_rank"), "actor", "date", "event_id", "score")


def nest_by_actor(items: DataFrame, actors: list[str]) -> DataFrame:
    """(topic, anchor, by_actor): for a report an array of (actor, items), actors in the order given and items of (event_id, score) from
    the newest on; score is null for unrated ones. cluster_rows gives the same without gathering a cluster."""
    item = F.struct((-F.unix_date("date")).alias("age"), "event_id", "score")
    per = items.groupBy("topic", "anchor", "actor").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rank = F.array_position(F.array(*map(F.lit, actors)), F.col("actor"))
    plain = F.transform("items", lambda i: F.struct(i["event_id"].alias("event_id"), i["score"].alias("score")))
    nested = per.groupBy("topic", "anchor").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "actor", plain.alias("items")))).alias("a"))
    return nested.select("topic", "anchor", F.transform("a", lambda a: F.struct(a["actor"].alias("actor"), a["items"].alias("items"))).alias("by_actor"))
