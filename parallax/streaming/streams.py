"""Structured Streaming forms of landing, vote tallies and score counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from parallax.functions.columns import content_hash


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file


def stream_landing(items: DataFrame, delay: str, event_time: str = "ts") -> DataFrame:
    """Items (source_name, url, title, ...) whose (source_name, hash) the stream has not given before, as far back as the watermark keeps
    them: the state is bounded by the delay, and a copy that comes later than that passes again. `land_new` is the exact form."""
    hashed = items.withColumn("hash", content_hash(F.col("url"), F.col("title")))
    return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["source_name", "hash"])


def append_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: list[str]) -> None:
    """Write the rows of a micro-batch whose keys no earlier batch has written, one for each key, the first by `order`, to the folder of the
    batch's number.

    A batch that runs again after a failure replaces what it had written and looks at the batches before it alone, so that it writes the
    same rows once. Keys are looked up in the stored table; there is no state besides.
    """
    spark = batch.sparkSession
    places = F.struct(*order)
    first = batch.groupBy(*keys).agg(F.min(places).alias("_first"))
    chosen = batch.withColumn("_first", places).join(first, [*keys, "_first"], "left_semi").drop("_first").dropDuplicates(keys)
    if number > 0 and stored_batches(spark, path):
        stored = spark.read.schema(StructType([*(batch.schema[k] for k in keys), StructField("batch", LongType())])).option("basePath", path).parquet(path).filter(F.col("batch") < number).select(*keys)
        # Of the stored keys those of the batch are read out first, which are few; Spark broadcasts the batch's if they are small.
        known = stored.join(first.select(*keys), keys, "left_semi").distinct()
        chosen = chosen.join(known, keys, "left_anti")
    chosen.write.mode("overwrite").parquet(f"{path}/batch={number}")


def stored_batches(spark: SparkSession, path: str) -> bool:
    """Whether the table has any batch yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def land_new(items: DataFrame, path: str, checkpoint: str, order: list[str], once: bool = True) -> StreamingQuery:
    """A running query that lands the items (source_name, url, title, ...) of a stream whose (source_name, hash) isn't stored yet: exact,
    idempotent by the number of the batch, and without state. With `once` it ends when it has read what there is."""
    hashed = items.withColumn("hash", content_hash(F.col("url"), F.col("title")))
    sink = lambda batch, number: append_batch(batch, number, path, ["source_name", "hash"], order)
    writer = hashed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_vote_tally(votes: DataFrame, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """(slug, ip, ts) of the votes that count, with one value of state for each key: the time of the last that did.

    The state of a key ends when the watermark has passed its last counted vote by the TTL: every vote that still can come counts then
    anyway, so nothing is lost by forgetting, and the state holds the keys of one TTL and delay at most. Votes of a key are taken in the
    order of their times within a micro-batch; one that comes later but is older than the last counted one of its key is dropped, as is one
    older than the watermark. Event time decides, so a rerun gives the same result.
    """
    import numpy as np
    import pandas as pd

    ttl = ttl_seconds * 1_000_000

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([part["ts"].to_numpy("datetime64[us]").astype("int64") for part in parts]))
        due = state.get[0] + ttl if state.exists else int(times[0])
        counted = []
        at = int(np.searchsorted(times, due))
        while at < len(times):
            counted.append(int(times[at]))
            at = int(np.searchsorted(times, counted[-1] + ttl))
        if counted:
            state.update((counted[-1],))
        # A timer must lie beyond the watermark; the state of a vote that is older than a TTL by then goes at the next batch.
        ends = max((state.get[0] + ttl) // 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(ends)
        if counted:
            yield pd.DataFrame({"key": np.full(len(counted), key[0], object), "ts": np.array(counted, "int64").view("datetime64[us]")}, copy=False)

    # The key is one column, since what a key costs is mostly that Spark turns each column of it, in and out, to pandas by itself.
    timed = votes.select(F.to_json(F.struct("slug", "ip")).alias("key"), F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null").withWatermark("ts", delay)
    counted = timed.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp_ntz", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    kinds = ", ".join(f"{c} {votes.schema[c].dataType.simpleString()}" for c in ("slug", "ip"))
    return counted.select(F.from_json("key", kinds).alias("key"), "ts").select("key.slug", "key.ip", "ts")


def stream_density(rows: DataFrame, delay: str, offset: str, days: int = 7) -> DataFrame:
    """Counts of scores by actor and topic in tumbling windows of `days` days that start at `offset` past the epoch's; late rows are dropped."""
    g = rows.withWatermark("ts", delay).groupBy(F.window("ts", f"{days} days", f"{days} days", offset), "actor", "topic", "score").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").cast("date").alias("start"), "actor", "topic", "score", "n")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there now into a new table below folder, and read it."""
    path = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
