"""Eras, meetings and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def era_summary(eras: DataFrame, meetings: DataFrame, annual: DataFrame, milestones: DataFrame) -> DataFrame:
    """(era, meetings, summits, score, milestones, silent, years) for each of eras (era): counts, the mean score of its years (0 without
    any), how many of these had no meeting, and an array of (year, meetings). meetings: (era, type); annual: (era, year, meetings, score)."""
    m = meetings.groupBy("era").agg(F.count("*").alias("meetings"), F.count_if(F.col("type") == "Summit").alias("summits"))
    tiles = F.array_sort(F.collect_list(F.struct("year", "meetings")))  # a year each
    y = annual.groupBy("era").agg(F.avg("score").alias("score"), F.count_if(F.col("meetings") == 0).alias("silent"), tiles.alias("years"))
    s = milestones.groupBy("era").agg(F.count("*").alias("milestones"))
    j = eras.select("era").join(m, "era", "left").join(y, "era", "left").join(s, "era", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("era", zero("meetings"), zero("summits"), F.coalesce("score", F.lit(0.0)).alias("score"), zero("milestones"), zero("silent"), "years")


def filter_meetings(meetings: DataFrame, era: str = "all", kind: str = "all") -> DataFrame:
    """The meetings of an era and a type, `all` for any, each with how many of how many are shown."""
    hit = F.lit(True)
    for column, wanted in (("era", era), ("type", kind)):
        if wanted != "all":
            hit = hit & (F.col(column) == wanted)
    shown = meetings.agg(F.count_if(hit).alias("shown"), F.count("*").alias("total"))
    return meetings.filter(hit).crossJoin(F.broadcast(shown))  # one row


def source_health(runs: DataFrame) -> DataFrame:
    """(source, last_ok, last_error, error_date) from runs (run_date, pos, source, error): the last run without an error; the error and its
    date only where the latest run failed."""
    g = runs.groupBy("source").agg(F.max(F.when(F.col("error").isNull(), F.col("run_date"))).alias("last_ok"), F.max_by(F.struct("run_date", "error"), F.struct("run_date", "pos")).alias("last"))
    failed = F.col("last.error").isNotNull()
    return g.select("source", "last_ok", F.when(failed, F.substring("last.error", 1, 200)).alias("last_error"), F.when(failed, F.col("last.run_date")).alias("error_date"))


def latest_run(runs: DataFrame) -> DataFrame:
    """(run_date, source, runs, errors) of the newest date."""
    last = runs.agg(F.max("run_date").alias("run_date"))
    return runs.join(F.broadcast(last), "run_date").groupBy("run_date", "source").agg(F.count("*").alias("runs"), F.count("error").alias("errors"))  # one row


def vocabulary(groupings: DataFrame) -> DataFrame:
    """(topic, grouping, pos): topics over all groupings (grouping, topics), where they first appear."""
    g = groupings.select("grouping", F.posexplode("topics").alias("pos", "topic"))
    return g.groupBy("topic").agg(F.min(F.struct("grouping", "pos")).alias("first")).select("topic", F.col("first.grouping").alias("grouping"), F.col("first.pos").alias("pos"))


def merge_sidecar(raw: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """raw with the columns of sidecar: where the sidecar has the row its values hold, nulls too; elsewhere raw's own, or null."""
    mine = [c for c in sidecar.columns if c != key]
    side = sidecar.select(key, F.struct(*mine).alias("_side"))
    j = raw.join(side, key, "left")
    value = lambda c: F.when(F.col("_side").isNotNull(), F.col("_side")[c]).otherwise(F.col(c) if c in raw.columns else F.lit(None)).alias(c)
    return j.select(*[value(c) if c in mine else c for c in raw.columns], *[value(c) for c in mine if c not in raw.columns])


def relevant(events: DataFrame, key: str, flags: str = "relevant") -> DataFrame:
    """Events whose map of flags says so for the grouping."""
    return events.filter(F.coalesce(F.col(flags)[key], F.lit(False)))
