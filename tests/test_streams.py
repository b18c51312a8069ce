"""Streams over several micro-batches, restarts and replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parallax.operators.votes import counted_votes
from parallax.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, rows, schema):
    """One more file of a table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


VOTES = "slug string, ip string, ts timestamp_ntz"


def run_votes(spark, folder, ttl, delay, per_batch=None):
    reader = spark.readStream.schema(VOTES)
    reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader
    tally = streams.stream_vote_tally(reader.parquet(f"{folder}/votes"), ttl, delay)
    query = tally.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_vote_state_ends_and_tally_equals_batch(spark, tmp_path):
    folder, ttl = str(tmp_path), 3600
    rng = random.Random(4)
    every = []
    for day in range(4):  # each file is a day, and each run a restart from the checkpoint
        rows = [(rng.choice("ab"), f"ip{day}-{rng.randint(0, 9)}" if rng.random() < 0.7 else "bot", T0 + dt.timedelta(days=day, seconds=rng.randint(0, 80_000))) for _ in range(200)]
        put(spark, f"{folder}/votes", rows, VOTES)
        every += rows
        query = run_votes(spark, folder, ttl, "10 minutes")
    put(spark, f"{folder}/votes", [("a", "last", T0 + dt.timedelta(days=30))], VOTES)
    every.append(("a", "last", T0 + dt.timedelta(days=30)))
    query = run_votes(spark, folder, ttl, "10 minutes")
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").select("slug", "ip", "ts").collect()))
    want = sorted(map(tuple, counted_votes(spark.createDataFrame(every, VOTES), ttl).collect()))
    assert got == want
    # All keys but the last one's have gone, since the watermark is beyond their votes by more than the TTL.
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] == 1 and max(states) > 1


def test_vote_batches_in_one_run(spark, tmp_path):
    folder, ttl = str(tmp_path), 1000
    every = []
    for k in range(5):
        rows = [("a", "x", T0 + dt.timedelta(seconds=k * 700 + s)) for s in (0, 300, 650)] + [("b", "y", T0 + dt.timedelta(seconds=k * 700))]
        put(spark, f"{folder}/votes", rows, VOTES)
        every += rows
    run_votes(spark, folder, ttl, "2 hours")
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").select("slug", "ip", "ts").collect()))
    assert got == sorted(map(tuple, counted_votes(spark.createDataFrame(every, VOTES), ttl).collect()))


ITEMS = "source_name string, url string, title string, n int"


def landed(spark, folder):
    return sorted((r.source_name, r.url, r.n) for r in spark.read.parquet(f"{folder}/table").collect())


def land(spark, folder):
    stream = spark.readStream.schema(ITEMS).parquet(f"{folder}/items")
    query = streams.land_new(stream, f"{folder}/table", f"{folder}/checkpoint", ["n"])
    query.awaitTermination()
    return query


def test_landing_is_exact_and_keeps_no_state(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, f"{folder}/items", [("s", "u1", "t", 2), ("s", "u1", "t", 1), ("r", "u1", "t", 3), ("s", "u1", "t", 1)], ITEMS)
    query = land(spark, folder)
    assert landed(spark, folder) == [("r", "u1", 3), ("s", "u1", 1)]
    assert not any(p["stateOperators"] for p in query.recentProgress)
    put(spark, f"{folder}/items", [("s", "u1", "t", 0), ("s", "u2", "t", 5), ("s", None, "t", 6)], ITEMS)
    land(spark, folder)
    land(spark, folder)  # nothing new
    assert landed(spark, folder) == [("r", "u1", 3), ("s", "u1", 1), ("s", "u2", 5)]  # without a URL there is no key


def test_replayed_batch_writes_once(spark, tmp_path):
    path = f"{tmp_path}/table"
    hashed = lambda rows: spark.createDataFrame(rows, ITEMS).withColumn("hash", F.sha2(F.concat("url", "title"), 256))
    keys = ["source_name", "hash"]
    streams.append_batch(hashed([("s", "u1", "t", 1)]), 0, path, keys, ["n"])
    second = hashed([("s", "u1", "t", 2), ("s", "u2", "t", 3)])
    for _ in range(3):  # as after a failure between the write and the commit
        streams.append_batch(second, 1, path, keys, ["n"])
    assert landed(spark, tmp_path) == [("s", "u1", 1), ("s", "u2", 3)]
    streams.append_batch(hashed([("s", "u2", "t", 9), ("r", "u2", "t", 9)]), 2, path, keys, ["n"])
    assert landed(spark, tmp_path) == [("r", "u2", 9), ("s", "u1", 1), ("s", "u2", 3)]


def test_bounded_landing_needs_a_delay(spark, tmp_path):
    with pytest.raises(TypeError):
        streams.stream_landing(spark.createDataFrame([], ITEMS))


def test_vote_keys_are_one_column(spark, tmp_path):
    """Keys with quotes, commas and nulls come through whole; Python is given a key and a time alone."""
    folder = str(tmp_path)
    rows = [('a"b', "x,y", T0), ('a"b', "x", T0), ('a"b,x', "y", T0), (None, "x", T0), ("é\n", None, T0), ("é\n", None, T0 + dt.timedelta(seconds=5))]
    put(spark, f"{folder}/votes", rows, VOTES)
    run_votes(spark, folder, 10, "1 hour")
    got = {tuple(r) for r in spark.read.parquet(f"{folder}/out").select("slug", "ip", "ts").collect()}
    assert got == {r for r in rows if r[2] == T0}
    tally = streams.stream_vote_tally(spark.readStream.schema(VOTES).parquet(f"{folder}/votes"), 10)
    assert "[key#" in next(x for x in tally._jdf.queryExecution().analyzed().toString().split("\n") if "FlatMapGroupsInPandasWithState" in x)
