"""Votes with expiring deduplication, sign-ups, bursts and reports; tallies in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_votes(votes: DataFrame, slugs: DataFrame) -> DataFrame:
    return votes.join(slugs.select("slug").distinct(), "slug", "left_semi")


def split_env(votes: DataFrame, host: str) -> DataFrame:
    return votes.withColumn("env", F.when(F.col("host") == host, "production").otherwise("preview"))


def counted_votes(votes: DataFrame, ttl_seconds: int) -> DataFrame:
    """(slug, ip, ts) of the votes that count: the first of a key, then each first one at least ttl after the last that counted.

    Repeats shrink before the shuffle. A task reads its keys' times in order, one batch at a time, and holds one time of the current key
    alone, so that a key may have any number of them; the streaming form keeps the same.
    """
    kind = votes.schema["ts"].dataType
    times = votes.select("slug", "ip", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).filter("t is not null").distinct()
    ttl = ttl_seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, due = None, 0
        for batch in batches:
            slugs, ips, t = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            keep, i = [], 0
            while i < len(t):
                if (slugs[i], ips[i]) != key:
                    key, due = (slugs[i], ips[i]), t[i]
                if t[i] >= due:
                    keep.append(i)
                    due = t[i] + ttl
                i += 1
            yield batch.take(pa.array(keep, pa.int64()))

    ordered = times.repartition("slug", "ip").sortWithinPartitions("slug", "ip", "t")
    return ordered.mapInArrow(run, ordered.schema).select("slug", "ip", F.timestamp_micros("t").cast(kind).alias("ts"))


def vote_tally(votes: DataFrame, ttl_seconds: int) -> DataFrame:
    return counted_votes(votes, ttl_seconds).groupBy("slug").agg(F.count("*").alias("votes"))


def signups(requests: DataFrame) -> DataFrame:
    """(slug, email, ts): valid addresses in small letters, the last time of each."""
    email = F.lower(F.trim("email"))
    ok = (F.length(email) <= 254) & email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    return requests.withColumn("email", email).filter(ok).groupBy("slug", "email").agg(F.max("ts").alias("ts"))


def bursts(requests: DataFrame, limit: int = 30, period: str = "60 seconds") -> DataFrame:
    """Windows in which an address sent more than `limit` requests; tumbling, as an approximation of the platform's limiter."""
    g = requests.groupBy(F.window("ts", period), "ip").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return g.select("ip", F.col("window.start").alias("start"), "n")


def vote_ranking(tallies: DataFrame, slugs: DataFrame) -> DataFrame:
    """All slugs with their votes, zeros too, with rank (votes desc, slug asc) and total."""
    from pyspark.sql import Window

    joined = slugs.join(tallies, "slug", "left").select("slug", F.coalesce("votes", F.lit(0)).alias("votes"))
    return joined.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("votes"), "slug")), "total": F.sum("votes").over(Window.partitionBy())})  # a row for each configured slug


def reset(votes: DataFrame, slugs: DataFrame) -> DataFrame:
    """votes without those of the slugs."""
    return votes.join(slugs, "slug", "left_anti")
