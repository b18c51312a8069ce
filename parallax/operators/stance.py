"""Agreement analytics over stance rows (date, actor, topic, score)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions.columns import agreement, agreement_color, fmt_stance, half_up, stance_norm

LOW_CONFIDENCE = 4


def relevant_as_of(rows: DataFrame, cutoff: dt.date) -> DataFrame:
    """Rows up to the cutoff; undated rows pass."""
    return rows.filter(F.col("date").isNull() | (F.col("date") <= F.lit(cutoff)))


def recent(rows: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Rows of the last `days` days; undated rows do not pass."""
    return rows.filter((F.col("date") >= F.lit(as_of - dt.timedelta(days))) & (F.col("date") <= F.lit(as_of)))


def week_spine(rows: DataFrame, today: dt.date) -> DataFrame:
    """(week): Mondays from that of the first row's week to today."""
    first = rows.agg(F.date_trunc("week", F.min("date")).cast("date").alias("lo"))
    return first.select(F.explode(F.expr(f"sequence(lo, date'{today}', interval 7 days)")).alias("week"))


def to_weeks(rows: DataFrame, today: dt.date, window_days: int = 14) -> DataFrame:
    """Each row once for each Monday w with w - window_days <= date <= w: two or three, without a range join."""
    first = F.date_trunc("week", F.date_add("date", 6)).cast("date")
    last = F.least(F.date_trunc("week", F.date_add("date", window_days)).cast("date"), F.lit(today))
    weeks = F.when(first <= last, F.expr("sequence(_first, _last, interval 7 days)"))
    return rows.withColumns({"_first": first, "_last": last}).withColumn("week", F.explode(weeks.cast("array<date>"))).drop("_first", "_last")


def actor_means(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "actor").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))


def windowed_means(rows: DataFrame, today: dt.date, window_days: int = 14) -> DataFrame:
    """(topic, week, actor, mean, n) of the rows in each trailing window that ends on a Monday, as actor_means(to_weeks(...)) has them.

    Rows are summed up by day first; a range frame over the days of a topic and actor then has each window's sums, so that the cost doesn't
    grow with the window, and no more than a row for each day of a topic and actor is sorted.
    """
    keys = ["topic", "actor"]
    days = rows.groupBy(*keys, "date").agg(F.sum("score").alias("s"), F.count("score").alias("c"), F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    marks = days.select(*keys).distinct().crossJoin(F.broadcast(week_spine(rows, today))).select(*keys, F.col("week").alias("date"), none.alias("s"), none.alias("c"), none.alias("n"), F.lit(True).alias("mark"))  # weeks are few
    all_ = days.withColumn("mark", F.lit(False)).unionByName(marks).withColumn("day", F.unix_date("date"))
    trailing = Window.partitionBy(*keys).orderBy("day").rangeBetween(-window_days, 0)
    summed = all_.select(*keys, F.col("date").alias("week"), "mark", *[F.sum(c).over(trailing).alias(c) for c in "scn"]).filter("mark and n > 0")
    return summed.select("topic", "week", "actor", (F.col("s") / F.when(F.col("c") > 0, F.col("c"))).alias("mean"), "n")


def spread_of_means(means: DataFrame, *keys: str) -> DataFrame:
    """Where two actors or more are scored: the unweighted mean of their means, the band, the spread and the label."""
    g = means.groupBy(*keys).agg(F.count("*").alias("actors"), F.avg("mean").alias("overall_raw"), F.min("mean").alias("lo"), F.max("mean").alias("hi"), F.sum("n").alias("n_events"), F.sort_array(F.collect_list(F.struct("actor", half_up(F.col("mean"), 1).alias("mean")))).alias("per_actor"))
    spread = F.col("hi") - F.col("lo")
    return g.filter("actors >= 2").withColumn("spread_raw", spread).withColumn("label", agreement(spread, F.col("overall_raw")))


def topic_weekly(rows: DataFrame, today: dt.date, window_days: int = 14) -> DataFrame:
    """Weekly agreement of a topic over a trailing window; weeks without two scored actors are kept as nulls; topics without rows are absent."""
    rows = rows.filter(F.col("date") <= F.lit(today))
    scored = spread_of_means(windowed_means(rows, today, window_days), "topic", "week")
    scored = scored.select(
        "topic", "week", "label", half_up(stance_norm(F.col("overall_raw")), 3).alias("overall"), half_up(F.col("overall_raw"), 2).alias("stance_avg"),
        half_up(stance_norm(F.col("lo")), 3).alias("band_lo"), half_up(stance_norm(F.col("hi")), 3).alias("band_hi"),
        F.array_join(F.transform("per_actor", lambda s: F.concat_ws(":", s["actor"], F.format_string("%.1f", s["mean"]))), ",").alias("per_actor"), "n_events",
    )
    spine = rows.select("topic").distinct().crossJoin(F.broadcast(week_spine(rows, today)))  # topics and weeks are few
    return spine.join(scored, ["topic", "week"], "left")


def overall_weekly(weekly: DataFrame) -> DataFrame:
    """Mean over topics of the rounded series, in whole thousandths so that the order of the sum doesn't matter."""
    whole = lambda c: F.round(F.col(c) * 1000).cast("long")
    g = weekly.filter("stance_avg is not null").groupBy("week").agg(
        (F.avg(whole("stance_avg")) / 1000).alias("avg"), (F.avg(whole("band_lo")) / 1000).alias("lo"), (F.avg(whole("band_hi")) / 1000).alias("hi"),
        (F.avg(whole("band_hi") - whole("band_lo")) * 4 / 1000).alias("spread"), F.sum("n_events").alias("n_events"),
    )
    return g.select("week", half_up(stance_norm(F.col("avg")), 3).alias("overall"), half_up(F.col("avg"), 2).alias("stance_avg"), half_up(F.col("lo"), 3).alias("band_lo"), half_up(F.col("hi"), 3).alias("band_hi"), agreement(F.col("spread"), F.col("avg")).alias("label"), "n_events")


def score_density(rows: DataFrame, today: dt.date, topics: list[str], actors: list[str], window_days: int = 7, weeks: int = 12) -> DataFrame:
    """Counts by {ALL, actor} x {overall, topic} x score x bin, bins of window_days ending today; every cell, zeros too. Rows of actors,
    topics and scores that aren't listed count nowhere."""
    spark = rows.sparkSession
    rows = rows.filter(F.col("actor").isin(actors) & F.col("topic").isin(topics) & F.col("score").between(-2, 2))
    age = F.datediff(F.lit(today), "date")
    inside = rows.filter((age >= 0) & (age < weeks * window_days)).withColumn("back", F.floor(age / window_days).cast("int"))
    counted = inside.cube("actor", "topic", "score", "back").agg(F.count("*").alias("n"), F.grouping_id().alias("gid")).filter("gid % 4 = 0").drop("gid")
    counted = counted.select(F.coalesce("actor", F.lit("ALL")).alias("actor"), F.coalesce("topic", F.lit("overall")).alias("topic"), "score", "back", "n")
    cells = spark.createDataFrame([(a, t, s) for a in ["ALL", *actors] for t in ["overall", *topics] for s in range(-2, 3)], "actor string, topic string, score int")
    bins = rows.filter(age >= 0).agg(F.least(F.floor(F.max(age) / window_days) + 1, F.lit(weeks)).cast("int").alias("bins"))
    spine = cells.crossJoin(F.broadcast(bins)).withColumn("back", F.explode(F.expr("sequence(0, bins - 1)")))
    full = spine.join(F.broadcast(counted), ["actor", "topic", "score", "back"], "left")  # a row for each listed cell at most
    return full.select("actor", "topic", "score", (F.col("bins") - 1 - F.col("back")).alias("bin"), F.coalesce("n", F.lit(0)).alias("n"))


def density_margins(density: DataFrame) -> DataFrame:
    """Row totals, shares and cell intensities of each (actor, topic) slice."""
    slice_, row = Window.partitionBy("actor", "topic"), Window.partitionBy("actor", "topic", "score")
    x = density.withColumns({"row_total": F.sum("n").over(row), "grand": F.sum("n").over(slice_), "most": F.max("n").over(slice_)})
    share = F.when(F.col("grand") == 0, 0.0).otherwise(half_up(100 * F.col("row_total") / F.when(F.col("grand") > 0, F.col("grand")), 0))
    intensity = F.when(F.col("n") == 0, 0.0).otherwise(half_up(0.16 + 0.84 * F.sqrt(F.col("n") / F.when(F.col("most") > 0, F.col("most"))), 3))
    return x.select("actor", "topic", "score", "bin", "n", "row_total", share.alias("share"), intensity.alias("intensity"))


def divergence_leaderboard(weekly: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics that were ever scored, by the spread of the latest scored week; quiet ones last with -1; ties in the order of topics."""
    scored = weekly.filter("stance_avg is not null")
    now = scored.agg(F.max("week").alias("week"))
    current = scored.join(F.broadcast(now), "week").select("topic", half_up((F.col("band_hi") - F.col("band_lo")) * 4, 2).alias("spread"), "label", "stance_avg", fmt_stance(half_up(F.col("stance_avg"), 1)).alias("display"), agreement_color(F.col("label")).alias("color"), "n_events")
    joined = topics.join(scored.select("topic").distinct(), "topic", "left_semi").join(F.broadcast(current), "topic", "left")  # one row a topic
    ranked = joined.select("topic", "topic_rank", F.coalesce("spread", F.lit(-1.0)).alias("spread"), "label", "stance_avg", "display", "color", F.coalesce("n_events", F.lit(0)).alias("n"), F.col("spread").isNull().alias("quiet"))
    ranked = ranked.withColumn("low_confidence", F.col("n") < LOW_CONFIDENCE)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy("quiet", F.desc("spread"), "topic_rank")))  # one row a topic


def topic_order(leaderboard: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, place): `overall` first, then the ranked topics, then the others in the order of topics (topic, topic_rank)."""
    j = topics.select("topic", "topic_rank").join(leaderboard.select("topic", "rank"), "topic", "left")
    listed = j.select("topic", F.row_number().over(Window.orderBy(F.col("rank").asc_nulls_last(), "topic_rank")).alias("place"))  # one row a topic
    return listed.unionByName(topics.sparkSession.createDataFrame([("overall", 0)], "topic string, place int"))


def weekly_counts(rows: DataFrame, as_of: dt.date, actors: list[str]) -> DataFrame:
    """Rows of the last week per actor and per source: (kind, name, n). Each of `actors` has a row, with 0 if need be."""
    week = rows.filter((F.col("date") >= F.lit(as_of - dt.timedelta(7))) & (F.col("date") <= F.lit(as_of)))
    g = week.groupingSets([["actor"], ["source"]], "actor", "source").agg(F.count("*").alias("n"), F.grouping("actor").alias("by_source"))
    found = g.filter((F.col("by_source") == 1) | F.col("actor").isin(actors)).select(F.when(F.col("by_source") == 1, "source").otherwise("actor").alias("kind"), F.when(F.col("by_source") == 1, F.col("source").cast("string")).otherwise(F.col("actor")).alias("name"), "n")
    zero = rows.sparkSession.createDataFrame([("actor", a, 0) for a in actors], "kind string, name string, n long")
    return found.unionByName(zero).groupBy("kind", "name").agg(F.sum("n").alias("n"))


def pair_agreement(rows: DataFrame, as_of: dt.date, actors: list[str], days: int = 14) -> DataFrame:
    """For each pair of actors 100 * mean over shared topics of 1 - |difference of means| / 4; null without a shared topic."""
    spark = rows.sparkSession
    means = actor_means(recent(rows.filter(F.col("actor").isin(actors)), as_of, days), "topic")
    a, b = (means.select("topic", F.col("actor").alias(f"actor_{x}"), F.col("mean").alias(f"mean_{x}")) for x in "ab")
    shared = a.join(b, "topic").filter("actor_a < actor_b").groupBy("actor_a", "actor_b").agg(F.avg(1 - F.abs(F.col("mean_a") - F.col("mean_b")) / 4).alias("agree"), F.count("*").alias("topics"))
    names = sorted(actors)
    pairs = spark.createDataFrame([(x, y) for i, x in enumerate(names) for y in names[i + 1 :]], "actor_a string, actor_b string")
    return pairs.join(F.broadcast(shared), ["actor_a", "actor_b"], "left").select("actor_a", "actor_b", half_up(100 * F.col("agree"), 0).cast("long").alias("percent"), F.coalesce("topics", F.lit(0)).alias("topics"))


def staleness(rows: DataFrame, as_of: dt.date, limit: int = 5) -> DataFrame:
    days = F.datediff(F.lit(as_of), F.max("date"))
    return rows.agg(F.max("date").alias("newest"), days.cast("long").alias("days"), (days > limit).alias("banner"))


def hub_badge(overall: DataFrame, counts: DataFrame) -> DataFrame:
    """The last label of the overall series and the number of statements of the week."""
    label = overall.filter("label is not null").agg(F.max_by("label", "week").alias("label"), F.max("week").alias("week"))
    return label.crossJoin(counts.filter("kind = 'actor'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("statements")))


def latest_topic_pill(clusters: DataFrame, topics: DataFrame, today: dt.date, days: int = 7) -> DataFrame:
    """(topic, label, color, overall, display, date_to) of the newest scored cluster of each topic that reaches into the last days; null for
    the others."""
    fresh = clusters.filter((F.col("date_to") >= F.lit(today - dt.timedelta(days))) & F.col("label").isNotNull())
    shown = ["label", "color", "overall", "display", "date_to"]
    best = fresh.groupBy("topic").agg(F.max_by(F.struct(*shown), "date_to").alias("c")).select("topic", "c.*")
    return topics.select("topic").join(best, "topic", "left")


def stance_rows(events: DataFrame, sources: DataFrame, topics: list[str], grouping: str, column: str = "stances") -> DataFrame:
    """(event_id, date, actor, topic, score) from a map grouping -> topic -> (score, ..): rated topics that are listed, of mapped sources."""
    rated = events.select("event_id", "date", "source", F.explode(F.map_entries(F.col(column)[grouping])).alias("e"))
    rows = rated.select("event_id", "date", "source", F.col("e.key").alias("topic"), F.col("e.value.score").alias("score"))
    return rows.filter(F.col("topic").isin(topics) & F.col("score").isNotNull()).join(sources.select("source", "actor"), "source").drop("source")


def event_feed(rows: DataFrame, cutoff: dt.date) -> DataFrame:
    """Rows up to the cutoff, the newest first: one sort over ranges of dates, with no task that holds a topic."""
    return relevant_as_of(rows, cutoff).orderBy(F.col("date").desc_nulls_last(), "event_id")


def totals(events: DataFrame, relevant: DataFrame, meetings: DataFrame, sources: DataFrame, clusters: DataFrame) -> DataFrame:
    """(relevant, all_rows, meetings, sources, clusters): how many rows each table has."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(relevant, "relevant")
    for df, name in ((events, "all_rows"), (meetings, "meetings"), (sources, "sources"), (clusters, "clusters")):
        out = out.crossJoin(count(df, name))  # one row each
    return out


def with_stances(rows: DataFrame, column: str, key: Column | str) -> DataFrame:
    """stances[key], or an empty map."""
    return rows.withColumn("stances", F.coalesce(F.col(column)[key], F.map_from_arrays(F.array(), F.array())))


def pick_position(positions: Column, topic: Column, overall: Column) -> Column:
    """The position on the topic, else the overall one."""
    return F.coalesce(positions[topic], overall)
