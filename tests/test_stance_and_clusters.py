"""Small cases of the agreement analytics and the clusters, and the folds against plain loops."""

import datetime as dt
import hashlib
import json
import random

from pyspark.sql import functions as F

from parallax.functions.columns import agreement, agreement_color, half_up
from parallax.operators import cluster, stance, votes

D = dt.date


def rows_of(spark, data):
    return spark.createDataFrame(data, "date date, actor string, topic string, score int")


def test_labels(spark):
    """On both sides of every threshold of the rule."""
    step = 1 / 128
    spreads = [t + d for t in (0.5, 1.5) for d in (-step, 0.0, step)]
    overalls = [t + d for t in (-0.5, 0.5) for d in (-step, 0.0, step)]

    def rule(spread, overall):
        if spread > 0.5:
            return ("Mixed", "amber") if spread <= 1.5 else ("Divergent", "red")
        return ("Aligned against goal", "green") if overall <= -0.5 else ("Noncommittal", "grey") if overall < 0.5 else ("Aligned", "green")

    cases = {(s, o): rule(s, o) for s in spreads for o in overalls} | {(None, 1.0): (None, None), (1.0, None): (None, None)}
    label = agreement(F.col("s"), F.col("o"))
    got = spark.createDataFrame(list(cases), "s double, o double").select("s", "o", label.alias("label"), agreement_color(label).alias("color")).collect()
    assert {(r.s, r.o): (r.label, r.color) for r in got} == cases


def test_half_up(spark):
    got = spark.range(1).select(half_up(F.lit(0.125), 2), half_up(F.lit(-0.125), 2), half_up(F.lit(2.5), 0)).first()
    assert tuple(got) == (0.13, -0.12, 3.0)


def test_weekly_series(spark):
    today = D(2026, 6, 15)
    s = stance.topic_weekly(rows_of(spark, [(D(2026, 6, 8), "DE", "t", 2), (D(2026, 6, 10), "FR", "t", 2)]), today)
    by = {r.week: r for r in s.collect()}
    assert sorted(by) == [D(2026, 6, 8), D(2026, 6, 15)]
    assert (by[today].label, by[today].stance_avg, by[today].n_events) == ("Aligned", 2.0, 2)
    assert by[D(2026, 6, 8)].label is None
    alone = stance.topic_weekly(rows_of(spark, [(D(2026, 6, 8), "DE", "t", 2)]), today).collect()
    assert len(alone) == 2 and all(r.overall is None for r in alone)
    assert stance.topic_weekly(rows_of(spark, []), today).count() == 0
    mixed = stance.topic_weekly(rows_of(spark, [(D(2026, 6, 15), "PL", "t", -1), (D(2026, 6, 1), "DE", "t", 1), (None, "FR", "t", 1)]), today).collect()
    assert {r.per_actor for r in mixed} >= {"DE:1.0,PL:-1.0"}


def test_weeks_of_a_row_are_those_of_the_window(spark):
    first = D(2026, 1, 1)
    df = rows_of(spark, [(first + dt.timedelta(i), "DE", "t", 0) for i in range(60)])
    today = D(2026, 3, 20)
    got = {(r.date, r.week) for r in stance.to_weeks(df, today).collect()}
    mondays = [d for d in (first + dt.timedelta(i) for i in range(-14, 90)) if d.weekday() == 0 and d <= today]
    want = {(first + dt.timedelta(i), w) for i in range(60) for w in mondays if w - dt.timedelta(14) <= first + dt.timedelta(i) <= w}
    assert got == want


def test_density_bins_end_today(spark):
    today = D(2026, 6, 29)
    data = [(D(2026, 6, 22), "DE", "t", 0), (D(2026, 6, 23), "DE", "t", 0), (D(2026, 6, 24), "FR", "t", -2), (D(2026, 6, 30), "FR", "t", 1), (None, "FR", "t", 1)]
    d = stance.score_density(rows_of(spark, data), today, ["t"], ["DE", "FR", "PL"])
    cells = {(r.actor, r.topic, r.score, r.bin): r.n for r in d.collect()}
    assert len(cells) == 4 * 2 * 5 * 2 and sum(cells.values()) == 3 * 4
    assert cells["ALL", "overall", 0, 0] == 1 and cells["ALL", "t", 0, 1] == 1 and cells["FR", "t", -2, 1] == 1
    three = stance.score_density(rows_of(spark, [(D(2026, 1, 1), "DE", "t", 0), (today, "DE", "t", 0)]), today, ["t"], ["DE"], weeks=3)
    assert {r.bin for r in three.collect()} == {0, 1, 2}
    m = stance.density_margins(d).collect()
    assert all(r.intensity == 0 for r in m if r.n == 0) and max(r.intensity for r in m) == 1.0


def test_leaderboard(spark):
    today = D(2026, 6, 29)
    data = [(today, "DE", "e", 2), (today, "FR", "e", 0), (today, "DE", "u", 1), (today, "FR", "u", 1), (D(2026, 5, 4), "DE", "q", 1), (D(2026, 5, 4), "FR", "q", 1), (today, "DE", "x", 1)]
    topics = spark.createDataFrame([("u", 0), ("q", 1), ("e", 2), ("x", 3)], "topic string, topic_rank int")
    board = stance.divergence_leaderboard(stance.topic_weekly(rows_of(spark, data), today), topics).orderBy("rank").collect()
    assert [(r.topic, r.spread, r.label) for r in board] == [("e", 2.0, "Divergent"), ("u", 0.0, "Aligned"), ("q", -1.0, None)]
    assert all(r.low_confidence for r in board)


def items_of(spark, data):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "event_id long, date date, actor string, topic string, url string, score int")


def test_clusters(spark):
    x = items_of(spark, [(D(2026, 6, 10), "DE", "t", "a", 1), (D(2026, 6, 15), "FR", "t", "b", 0), (D(2026, 6, 15), "FR", "t", "b", 0), (D(2026, 1, 2), "DE", "t", "c", 1), (D(2026, 1, 1), "FR", "t", "d", 1), (D(2026, 6, 1), "DE", "s", "e", 1), (D(2026, 6, 21), "FR", "s", "f", 1), (None, "FR", "s", "g", 1)])
    c = cluster.anchored_clusters(x)
    s = {(r.topic, r.date_from, r.date_to): (r.actors, r["items"]) for r in cluster.cluster_summary(c).collect()}
    assert s == {("t", D(2026, 6, 10), D(2026, 6, 15)): ("DE,FR", 2), ("t", D(2026, 1, 1), D(2026, 1, 2)): ("DE,FR", 2)}
    latest = cluster.latest_cluster(cluster.cluster_summary(c)).collect()
    assert [r.date_from for r in latest] == [D(2026, 6, 10)]
    wide = cluster.cluster_summary(cluster.anchored_clusters(x, 30)).filter("topic = 's'").collect()
    assert [(r.date_from, r.date_to) for r in wide] == [(D(2026, 6, 1), D(2026, 6, 21))]
    assert cluster.score_clusters(c).filter("anchor = date'2026-06-15'").first().spread_raw == 1.0
    assert cluster.anchored_clusters(x.limit(0)).count() == 0
    keys = cluster.cluster_keys(c.withColumn("path", F.col("url"))).collect()
    assert len(keys) == 2 and all(len(r.cluster_key) == 12 for r in keys)
    nested = {r.anchor: r.by_actor for r in cluster.nest_by_actor(c, ["FR", "DE"]).collect()}
    assert [(a.actor, [(i.event_id, i.score) for i in a["items"]]) for a in nested[D(2026, 6, 15)]] == [("FR", [(1, 0)]), ("DE", [(0, 1)])]
    v = {r.anchor: r for r in cluster.convergence(c).collect()}[D(2026, 6, 15)]
    assert (v.spread, v.overall, v.display, v.label, [tuple(x) for x in v.per_actor]) == (1.0, 0.5, "+0.5", "Mixed", [("DE", 1.0, 1), ("FR", 0.0, 1)])


def test_cluster_keys_are_those_of_json(spark):
    paths = ['p"q', "back\\slash", "é/ü", "😀 smile", "tab\there", "bell\x07", "plain/a.yaml", "\x7f"]
    df = spark.createDataFrame([("t", D(2026, 1, 1), p) for p in paths] + [("t", D(2026, 1, 1), "")], "topic string, anchor date, path string")
    assert cluster.cluster_keys(df).first().cluster_key == hashlib.sha256(json.dumps(sorted(paths)).encode()).hexdigest()[:12]


def test_areas_explode(spark):
    events = spark.createDataFrame([(1, 0, ["a", "other", "b"]), (2, 9, ["a"]), (3, 1, ["c", "other"]), (4, 1, None), (5, 1, ["b", "b"])], "event_id long, source long, areas array<string>")
    sources = spark.createDataFrame([(0, "NO"), (1, "IS")], "source long, actor string")
    got = cluster.explode_areas(events, sources, spark.createDataFrame([("a",), ("b",)], "topic string")).collect()
    assert sorted((r.event_id, r.topic, r.actor) for r in got) == [(1, "a", "NO"), (1, "b", "NO"), (5, "b", "IS"), (5, "b", "IS")]


def test_topic_order_and_counts(spark):
    board = spark.createDataFrame([("b", 1), ("c", 2)], "topic string, rank int")
    topics = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "topic string, topic_rank int")
    assert [r.topic for r in stance.topic_order(board, topics).orderBy("place").collect()] == ["overall", "b", "c", "a", "d"]
    rows = spark.createDataFrame([(D(2026, 1, 5), "DE", 3), (D(2026, 1, 5), None, 3), (D(2026, 1, 5), "ZZ", 4)], "date date, actor string, source long")
    got = {(r.kind, r.name): r.n for r in stance.weekly_counts(rows, D(2026, 1, 6), ["DE", "FR"]).collect()}
    assert got == {("actor", "DE"): 1, ("actor", "FR"): 0, ("source", "3"): 2, ("source", "4"): 1}


def test_anchors_equal_the_greedy_loop(spark):
    rng = random.Random(5)
    data = [(D(2026, 1, 1) + dt.timedelta(rng.randrange(80)), rng.choice("ABC"), f"t{rng.randrange(12)}", str(i), 0) for i in range(400)]
    want = set()
    for topic in {x[2] for x in data}:
        left = sorted(((d, i) for i, (d, _, t, _, _) in enumerate(data) if t == topic), reverse=True)
        while left:
            anchor = left[0][0]
            want |= {(i, anchor) for d, i in left if (anchor - d).days <= 7}
            left = [x for x in left if (anchor - x[0]).days > 7]
    assert {(r.event_id, r.anchor) for r in cluster.anchored_items(items_of(spark, data)).collect()} == want


def test_votes_equal_the_loop(spark):
    rng = random.Random(6)
    start = dt.datetime(2026, 1, 1)
    data = [(start + dt.timedelta(minutes=rng.randrange(5000)), rng.choice("ab"), str(rng.randrange(6))) for _ in range(500)]
    last, want = {}, set()
    for ts, slug, ip in sorted(data):
        if (slug, ip) not in last or ts - last[slug, ip] >= dt.timedelta(hours=20):
            last[slug, ip] = ts
            want.add((slug, ip, ts))
    df = spark.createDataFrame(data, "ts timestamp, slug string, ip string")
    assert {tuple(r) for r in votes.counted_votes(df, 20 * 3600).collect()} == want
    two = spark.createDataFrame([("a",), ("zz",)], "slug string")
    ranked = votes.vote_ranking(votes.vote_tally(df, 20 * 3600), two).orderBy("rank").collect()
    assert [r.slug for r in ranked] == ["a", "zz"] and ranked[1].votes == 0
    addresses = spark.createDataFrame([("a", " X@y.Org ", start), ("a", "x@y.org", start + dt.timedelta(1)), ("a", "bad@x", start), ("b", "z" * 260 + "@x.org", start)], "slug string, email string, ts timestamp")
    assert [tuple(r) for r in votes.signups(addresses).collect()] == [("a", "x@y.org", start + dt.timedelta(1))]


def test_stream_tally_over_micro_batches(spark, tmp_path):
    from parallax.streaming import streams

    start = dt.datetime(2026, 1, 1)
    files = [[(start, "a", "1"), (start + dt.timedelta(hours=1), "a", "1")], [(start + dt.timedelta(hours=21), "a", "1"), (start, "b", "1")]]
    for i, part in enumerate(files):
        spark.createDataFrame(part, "ts timestamp_ntz, slug string, ip string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    table = spark.readStream.schema("ts timestamp_ntz, slug string, ip string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = streams.run_to_table(streams.stream_vote_tally(table, 20 * 3600), str(tmp_path)).collect()
    assert sorted((r.slug, r.ts) for r in got) == [("a", start), ("a", start + dt.timedelta(hours=21)), ("b", start)]
    items = spark.createDataFrame([("s", "u", "t", start)] * 3 + [("s", "u2", "t", start)], "source_name string, url string, title string, ts timestamp")
    items.write.parquet(f"{tmp_path}/items")
    stream = streams.read_stream(spark, f"{tmp_path}/items")
    assert streams.run_to_table(streams.stream_landing(stream, "1 hour"), str(tmp_path)).count() == 2


def test_cluster_key_of_many_paths(spark):

    paths = [f"p/{i}/é\"{'x' * (i % 7)}" for i in range(5000)]
    rows = [("t", dt.date(2026, 1, 1), p) for p in paths] + [("t", dt.date(2026, 1, 8), "only"), ("t", dt.date(2026, 1, 9), ""), (None, None, "z"), (None, None, "y")]
    df = spark.createDataFrame(rows, "topic string, anchor date, path string").repartition(5)
    got = {(r.topic, r.anchor): r.cluster_key for r in cluster.cluster_keys(df).collect()}
    key = lambda ps: hashlib.sha256(json.dumps(sorted(ps)).encode()).hexdigest()[:12]
    assert got == {("t", dt.date(2026, 1, 1)): key(paths), ("t", dt.date(2026, 1, 8)): key(["only"]), (None, None): key(["y", "z"])}
    assert cluster.cluster_keys(df.limit(0)).count() == 0


def test_quotes_in_texts_by_pairs(spark):

    from parallax.operators.evaluate import quotes_in_texts

    rng = random.Random(3)
    texts = {k: " ".join(rng.choice(["ab", "A", "b\n", "ba", "é"]) for _ in range(40)) for k in "pqr"}
    quotes = [(rng.choice("pqrs"), " ".join(rng.choice(["ab", "a", "B", "ba"]) for _ in range(rng.randint(0, 4)))) for _ in range(300)]
    flat = lambda x: " ".join(x.split()).lower()
    want = {(k, q): k in texts and flat(q) in flat(texts[k]) for k, q in quotes}
    got = quotes_in_texts(spark.createDataFrame(quotes, "case string, quote string"), spark.createDataFrame(list(texts.items()), "case string, text string")).collect()
    assert {(r["case"], r.quote): r.verbatim for r in got} == want and len(got) == len(want)


def test_windowed_means_equal_rows_by_weeks(spark):
    rng = random.Random(11)
    today = dt.date(2026, 7, 1)
    rows = [(today - dt.timedelta(rng.randint(0, 200)), rng.choice("ABC"), rng.choice("xy"), rng.choice([-2, -1, 0, 1, 2, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "date date, actor string, topic string, score int")
    plain = lambda d: sorted((r.topic, r.week, r.actor, r.mean, r.n) for r in d.select("topic", "week", "actor", "mean", "n").collect())
    for days in (0, 6, 14, 90):
        assert plain(stance.windowed_means(df, today, days).fillna(9.5, "mean")) == plain(stance.actor_means(stance.to_weeks(df, today, days), "topic", "week").fillna(9.5, "mean"))
    assert stance.windowed_means(df.limit(0), today).count() == 0
