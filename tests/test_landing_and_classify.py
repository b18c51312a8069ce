"""Small cases of landing, dates, classification, quality and evaluation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parallax.functions import dates
from parallax.functions.columns import strip_html
from parallax.operators import classify, evaluate, quality
from parallax.sources import landing

D = dt.date
TODAY = D(2026, 7, 1)


def written(day):
    """A day in each form, by the form's name."""
    return {
        "day": f"{day:%Y-%m-%d}", "iso": f"{day:%Y-%m-%d}T23:15:00", "iso_zone": f"{day:%Y-%m-%d}T23:15:00-08:00", "dotted": f"{day:%d.%m.%Y}", "slashed": f"{day:%d/%m/%Y}",
        "day_month": f"{day.day} {day:%B %Y}", "month_day": f"{day:%B} {day.day}, {day.year}", "month_plain": f"{day:%B} {day.day} {day.year}", "mail": f"{day:%a, %d %b %Y} 23:15:00 -0800",
    }


def test_dates(spark):
    day = D(2021, 2, 9)
    texts = written(day)
    df = spark.createDataFrame([(k, f" {v}\n") for k, v in texts.items()] + [("none", "no date"), ("null", None), ("blank", ""), ("wrong", "2021-02-30"), ("old", "1994-12-31"), ("late", "2026-07-02")], "k string, raw string")
    raw = F.col("raw")
    got = {r.k: r for r in df.select("k", dates.strict_date(raw, TODAY).alias("s"), dates.strict_date(raw, None).alias("u"), dates.lenient_date(raw, TODAY).alias("l"), dates.lenient_date(raw, TODAY, ["mail"]).alias("m")).collect()}
    assert {k for k, r in got.items() if r.s} == set(dates.STRICT) and all(got[k].s == day for k in dates.STRICT)
    assert {k for k, r in got.items() if r.u} == {*dates.UNRANGED, "iso_zone", "old", "late"}  # only the first 19 characters count
    assert all(got[k].l == day for k in texts) and all(got[k].l == TODAY for k in ("none", "null", "blank", "wrong"))
    assert {k for k, r in got.items() if r.m == day} == {"mail"}


def test_cleaned_dates(spark):
    df = spark.createDataFrame([("On : March 22nd 2022",), ("Tuesday, 8 March 2022",), ("March 3rd, 2022",)], "raw string")
    assert [r.c for r in df.select(dates.clean_date(F.col("raw")).alias("c")).collect()] == ["March 22 2022", "8 March 2022", "March 3, 2022"]
    rows = spark.createDataFrame([("a", "On : March 22nd 2022"), ("b", "On : March 22nd 2022"), ("b", "2022-03-22"), ("c", "2022-03-22")], "source string, raw string")
    got = dates.dates_by_source(rows, "raw", "source", {"a": ["month_plain"], "b": ["day"]}, TODAY, cleaned=("a",)).collect()
    assert [(r.source, r.date) for r in got] == [("a", D(2022, 3, 22)), ("b", TODAY), ("b", D(2022, 3, 22)), ("c", TODAY)]
    both = spark.createDataFrame([(None, D(2022, 1, 2), D(2022, 1, 3)), (D(2022, 1, 1), None, None), (None, None, None)], "a date, b date, c date")
    assert [r.x for r in both.select(dates.prefer_dates(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == [D(2022, 1, 2), D(2022, 1, 1), None]


def test_url_dates(spark):
    df = spark.createDataFrame([("https://x/2023/11/30/a",), ("https://x/2033/11/30/a",), ("https://x/a",), ("https://x/2023/14/30/a",)], "url string")
    assert [r.d for r in df.select(dates.url_date(F.col("url"), TODAY).alias("d")).collect()] == [D(2023, 11, 30), None, None, None]


ATOM = '<feed><entry><title>One</title><link href="https://x/1"/><summary>s</summary><content type="html">&lt;p&gt;full&lt;/p&gt; text</content><published>2026-07-15T10:00:00Z</published></entry><entry><title>Two</title><link href="https://x/2"/><updated>2026-06-01T10:00:00Z</updated></entry></feed>'
RSS = "<rss><channel><item><title><![CDATA[Three]]></title><link>https://x/3</link><description>d</description><pubDate>Thu, 16 Jul 2026 10:00:00 +0000</pubDate></item><item><title></title><link>https://x/4</link></item></channel></rss>"


def test_feeds(spark):
    df = spark.createDataFrame([("a", "atom", ATOM), ("r", "rss", RSS), ("e", "rss", "")], "source_name string, format string, body string")
    got = {r.url: r for r in landing.parse_feeds(df, TODAY).collect()}
    assert set(got) == {"https://x/1", "https://x/2", "https://x/3"}
    assert [got[f"https://x/{i}"].published.date() for i in (1, 2, 3)] == [D(2026, 7, 15), D(2026, 6, 1), D(2026, 7, 16)]
    assert got["https://x/3"].title == "Three" and got["https://x/2"].text == ""
    kept = landing.since(landing.parse_feeds(df, TODAY).withColumn("date", F.to_date("published")), D(2026, 7, 1))
    assert kept.count() == 2


def test_pages(spark):
    html = '<html><head><meta property="og:title" content="Welcome"><title>Real title here - Site</title><script>var t="</p>";</script></head><body><article><time datetime="2026-05-04T10:00:00">x</time><p>' + "long enough " * 5 + "</p><p>short</p><!-- <p>" + "hidden " * 9 + "</p> --></article></body></html>"
    bare = "<main><p>" + "seven words are in this short body text of mine to be cut off here" + " am 03.02.2024</p></main>"
    df = spark.createDataFrame([(1, html), (2, bare), (3, "")], "page_id long, html string")
    title = {r.page_id: r.title for r in landing.extract_title(df, suffixes=("Site",)).collect()}
    twice = landing.extract_title(df.unionByName(df)).collect()
    assert len(twice) == 6 and sorted(r.page_id for r in twice) == [1, 1, 2, 2, 3, 3]
    turned = "<head><meta content='Turned about' property=og:title><title>x</title></head>"
    assert landing.extract_title(spark.createDataFrame([(1, turned)], "page_id long, html string")).first().title == "Turned about"
    long = "more than forty characters of text stand in this paragraph "
    nested = f"<main><p>{long}0</p></main><div class='wide lead-text x'><p>{long}1</p><div><p>{long}2</p></div><div></div><p>{long}&uuml;&#8364;&#x41;</p></div><p>{long}3</p><article><p>{long}4</p></article>"
    one = spark.createDataFrame([(1, nested)], "page_id long, html string")
    assert landing.extract_body(one, ("lead-text", "other")).first().body == f"{long}1 {long}2 {long}ü€A"
    assert landing.extract_body(one).first().body == f"{long}4"
    assert landing.extract_body(spark.createDataFrame([(1, f"<p>{long}</p>")], "page_id long, html string")).first().body == ""
    assert title[1] == "Real title here" and title[2] == "seven words are in this short body text of mine to be…" and title[3] is None
    assert {r.page_id: r.body for r in landing.extract_body(df).collect()}[1] == ("long enough " * 5).strip()
    assert {r.page_id: r.date for r in landing.extract_date(df, TODAY).collect()} == {1: D(2026, 5, 4), 2: D(2024, 2, 3), 3: None}
    assert spark.createDataFrame([("<b>a</b>&amp;<i>b</i>\n c",)], "h string").select(strip_html(F.col("h")).alias("t")).first().t == "a & b c"


def test_page_index():
    from parallax.sources.pages import Page, dates_of

    p = Page("<!DOCTYPE html><ul class=a><li>one<li id='x y' ID=z>two <b>b</b> c</ul><p>first <i>in<p>second<div>d</div></p>a < b &amp; c<script>if (a<b) '<p>'</script><br/>end<!-- <p> --><td>t")
    assert [(e.name, e.depth) for e in p.elements] == [("ul", 0), ("li", 1), ("li", 1), ("b", 2), ("p", 0), ("i", 1), ("p", 0), ("div", 0), ("script", 0), ("br", 0), ("td", 0)]
    assert [p.text(e) for e in p.elements] == ["one two b c", "one", "two b c", "b", "first in", "in", "second", "d", "", "", "t"]
    assert p.elements[2].attributes == {"id": "x y"} and p.text(None).endswith("a < b & c end t")
    assert Page("").text(None) == "" and Page("a < b").elements == [] and Page('<a href="x>y').elements == []
    deep = Page("<div>" * 20_000 + "x" + "</div>" * 20_000)
    assert len(deep.elements) == 20_000 and deep.text(deep.elements[-1]) == "x"
    assert dates_of(Page('<time>3 May 2024</time><script type="application/ld+json">{</script><meta name="date">')) == ["3 May 2024"]


def test_page_container_scopes(spark):
    long = "more than forty characters of text stand in this paragraph"
    page = f"<div class='rich'><p>{long} banner</p></div><main><div class='c-rich x'><p>{long} body</p></div><p>{long} other</p></main>"
    one = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    body = lambda **k: {r.page_id: r.body for r in landing.extract_body(one, **k).collect()}
    assert body(classes=("rich",)) == {1: f"{long} banner", 2: ""}
    assert body(classes=("rich",), scopes=("main",)) == {1: f"{long} body", 2: ""}
    assert body(classes=("none",), scopes=("main",)) == {1: f"{long} body {long} other", 2: ""}


def test_known_items(spark):
    existing = landing.with_hash(spark.createDataFrame([("s", "u1", "t1"), ("other", "u2", "t2")], "source_name string, url string, title string"))
    offered = spark.createDataFrame([("s", "u1", "t1"), ("s", "u2", "t2")], "source_name string, url string, title string")
    assert [r.url for r in landing.skip_known(offered, existing).collect()] == ["u2"]
    assert {(r.offered, r.known) for r in landing.known_counts(offered, existing).collect()} == {(2, 1)}


def test_append_twice_writes_once(spark, tmp_path):
    offered = spark.createDataFrame([("s", "u1", "t1", D(2026, 5, 1), 1), ("s", "u1", "t1", D(2026, 5, 1), 2), ("s", "u2", "t2", None, 3)], "source_name string, url string, title string, date date, n int")
    none = spark.createDataFrame([], "source_name string, month string, date date, hash string")
    new = landing.append_new(offered, none, [F.col("n")])
    assert sorted((r.n, r.month) for r in new.collect()) == [(1, "2026-05"), (3, "unknown")]
    path = str(tmp_path / "events")
    landing.write_events(new, path)
    landing.write_events(new, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    assert landing.append_new(offered, stored, [F.col("n")]).count() == 0


def test_record_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("title: x\nn: 3\n")
    (tmp_path / "b.yaml").write_text("- not a mapping\n")
    (tmp_path / "c.yaml").write_text("# nothing but a remark\n")
    good, bad = landing.land_documents(spark, str(tmp_path), "title string, n int")
    assert [(r.title, r.n) for r in good.collect()] == [("x", 3)] and bad.count() == 2


def test_fallback_and_tier(spark):
    a = spark.createDataFrame([("s", 1)], "source_name string, n int")
    b = spark.createDataFrame([("s", 2), ("t", 3)], "source_name string, n int")
    assert sorted(r.n for r in landing.with_fallback(a, b).collect()) == [1, 3]
    t = spark.createDataFrame([("port", "pt"), ("port", "fr"), ("elsewhere", "fr")], "source_name string, source_lang string")
    assert [r.collection for r in landing.collection_tier(t, {"port": "pt"}).collect()] == ["native", "fallback", None]


def test_actors_and_formats(spark):
    df = spark.createDataFrame([(["norway", " CHILE"], None, False), (["Atlantis"], None, False), ([], "JP", True), (None, None, True)], "a array<string>, c string, k boolean")
    codes = classify.normalize_actors(F.col("a"), {"NORWAY": "NO", "CHILE": "CL"}, ["CL", "NO", "JP"], F.col("c"), F.col("k"))
    assert [r.x for r in df.select(codes.alias("x")).collect()] == [["CL", "NO"], [], ["JP"], []]
    f = spark.createDataFrame([(["ISLES", "fjords", "moon"],), (None,)], "f array<string>")
    assert [r.x for r in f.select(classify.normalize_formats(F.col("f"), ["isles", "fjords"]).alias("x")).collect()] == [["fjords", "isles"], []]


def test_relevance(spark):
    """Each rule alone: named, all members, two members and a topic, a member as source and a topic; and each just missed."""
    g = spark.createDataFrame([("fjords", ["NO", "IS", "CL"], ["fish"]), ("isles", ["JP", "IS", "NZ"], ["ships"])], "grouping string, members array<string>, tracked array<string>")
    cases = {
        1: (None, ["JP"], ["isles"], []), 2: (None, ["NO", "IS", "CL"], [], []), 3: (None, ["JP", "NZ"], [], ["ships"]), 4: ("CL", ["BR"], [], ["fish"]),
        5: (None, ["JP", "NZ"], [], ["fish"]), 6: ("CL", [], [], ["ships"]), 7: (None, ["NO"], [], ["fish"]), 8: (None, [], None, None),
    }
    t = spark.createDataFrame([(k, *v) for k, v in cases.items()], "event long, source_country string, actors array<string>, formats array<string>, topics array<string>")
    assert sorted((r.event, r.grouping) for r in classify.grouping_relevance(t, g).collect()) == [(1, "isles"), (2, "fjords"), (3, "isles"), (4, "fjords")]


def test_responses_and_ratings(spark):
    raw = ['{"a": 1}', '```\n{"a": 1}\n```', '```json\n{"a": 1}\n```', "garbage", "", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert [r.status for r in classify.parse_responses(df, "a int").collect()] == ["ok", "ok", "ok", "error", "error", "error"]
    more = spark.createDataFrame([('```json\n{"a": 1}\n``` and so on ```{"a": 2}```',), ('```\n{"a": 1}',), (' \n{"a": 1} ',)], "raw string")
    assert [r.parsed.a for r in classify.parse_responses(more, "a int").collect()] == [1, 1, 1]
    shapes = spark.createDataFrame([('{"actors": ["x"]}',), ('{"actors": [["x"]]}',), ('{"actors": null, "explicit_formats": "y"}',), ("{}",)], "j string")
    assert [r.w for r in shapes.select(classify.response_shape(F.col("j")).alias("w")).collect()] == [None, "actors", "explicit_formats", None]
    large = spark.createDataFrame([("99999999999",), ("9" * 60,), ("-" + "9" * 60,), ("-2",), ("+1",)], "s string")
    score, error = classify.clean_stance(F.col("s"))
    assert [(r.a, r.b) for r in large.select(score.alias("a"), error.alias("b")).collect()] == [(None, True)] * 3 + [(-2, False), (1, False)]
    events = spark.createDataFrame([(1, False), (2, True), (3, False)], "event long, failed boolean")
    assert {r.event: r.outcome for r in classify.rating_outcomes(events, spark.createDataFrame([(1,), (2,)], "event long")).collect()} == {1: "ok", 2: "error", 3: "empty"}
    s = spark.createDataFrame([("2",), (" -1 ",), ("3",), ("1.5",), ("x",), (None,)], "s string")
    score, error = classify.clean_stance(F.col("s"))
    assert [(r.a, r.b) for r in s.select(score.alias("a"), error.alias("b")).collect()] == [(2, False), (-1, False), (None, True), (None, False), (None, False), (None, False)]
    e = spark.createDataFrame([(" the goal ", "the goal"), ("a quote", "the goal"), ("a quote", None), (None, "g")], "e string, g string")
    assert [r.x for r in e.select(classify.clean_evidence(F.col("e"), F.col("g")).alias("x")).collect()] == ["", "a quote", "", ""]
    r = spark.createDataFrame([(1, 0, None), (2, 0, "q"), (3, 1, None)], "event long, score int, evidence string")
    assert sorted(x.event for x in classify.drop_blank_neutrals(r).collect()) == [2, 3]


def test_scorer_failures_are_rows(spark):
    calls = spark.createDataFrame([(1, "good"), (2, "bad")], "event long, prompt string")

    def scorer(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    got = {r.event: (r.answer, r.attempts, r.status, r.error) for r in classify.batch_score(calls, scorer).collect()}
    assert got == {1: ("GOOD", 1, "ok", None), 2: (None, 2, "error", "ValueError: no")}


def test_metrics(spark):
    """Two runs over one graded case and one that fails in the second, against the definitions by hand."""
    cases = spark.createDataFrame([(0, "c", False, 1), (0, "d", False, 2), (1, "c", False, 1), (1, "d", True, 2)], "run int, case string, failed boolean, attempts int")
    sets = "case string, field string, values array<string>"
    gold = spark.createDataFrame([("c", "topics", ["fish", "ships"], True), ("c", "relevant", ["fjords"], True), ("d", "topics", ["fish"], False), ("d", "actors", [], True)], sets + ", scored boolean")
    pred = spark.createDataFrame([(r, "c", "topics", ["fish"]) for r in (0, 1)] + [(r, "c", "relevant", ["fjords", "isles"]) for r in (0, 1)] + [(0, "d", "actors", ["NO"])], "run int, " + sets)
    m = {(r.run, r.field): r for r in evaluate.set_metrics(gold, pred, cases).collect()}
    assert abs(m[0, "topics"].f1 - 2 / 3) < 1e-12 and m[0, "topics"].exact == 0 and (m[0, "actors"].exact, m[0, "actors"].f1, m[0, "actors"].n_f1) == (0, 0, 0)
    assert set(m) == {(0, "topics"), (1, "topics"), (0, "relevant"), (1, "relevant"), (0, "actors")}
    assert [r.accuracy for r in evaluate.relevance_accuracy(gold, pred, cases, ["fjords", "isles", "moon", "sand"]).collect()] == [0.75, 0.75]
    pair = "case string, grouping string, topic string"
    g = spark.createDataFrame([("c", "w", "a", 2), ("c", "w", "b", 0), ("c", "v", "a", None), ("c", "v", "b", -1), ("d", "w", "a", 1)], pair + ", expected int")
    asked = spark.createDataFrame([(0, "c", "w", "a"), (0, "c", "w", "b"), (0, "c", "v", "a"), (0, "d", "w", "a"), (1, "c", "w", "a")], "run int, " + pair)
    p = spark.createDataFrame([(0, "c", "w", "a", 1, "QUOTE\n one"), (0, "c", "w", "b", 0, "elsewhere"), (1, "c", "w", "a", 2, " the goal ")], "run int, " + pair + ", score int, evidence string")
    pairs = evaluate.labelled_pairs(cases, g, asked, p)
    counts = evaluate.stance_counts(pairs)
    s = {r.run: r for r in evaluate.stance_metrics(counts).collect()}
    assert (s[0].exact, s[0].within_1, s[0].n, s[0].mae, s[0].n_mae, s[0].sign) == (1 / 3, 2 / 3, 3, 0.5, 2, 1.0)  # 0 against 0 is the same sign
    a = {r.run: r for r in evaluate.abstention(counts).collect()}
    assert (a[0].recall, a[0].n_recall, a[0].precision, a[0].n_precision) == (1.0, 1, 0.5, 2) and a[1].recall is None
    r = {r.run: r for r in evaluate.rates(cases, counts).collect()}
    assert (r[0].retry_rate, r[0].parse_failure_rate, r[0].coverage, r[1].retry_rate, r[1].parse_failure_rate, r[1].n_coverage) == (0.5, 0.0, 0.8, 0.0, 0.5, 4)
    assert [(x.run, x.hits, x.n) for x in evaluate.discrimination(pairs).collect()] == [(0, 1, 1)]
    texts = spark.createDataFrame([("c", "A quote  ONE here")], "case string, text string")
    goals = spark.createDataFrame([("w", "a", "the goal of all"), ("w", "b", "x y")], "grouping string, topic string, goal string")
    assert sorted(tuple(x) for x in evaluate.evidence_checks(cases, p, texts, goals).collect()) == [(0, 2, 1, 0), (1, 1, 0, 1)]
    f = evaluate.flip_rate(gold, pred, g, p, cases).first()  # of 3 fields and 5 pairs: actors of d, (w, a) and (w, b) of c
    assert (f.decisions, f.flips, f.rate) == (8, 3, 3 / 8)
    one = cases.filter("run = 0")
    assert evaluate.flip_rate(gold, pred.filter("run = 0"), g, p.filter("run = 0"), one).first().rate is None
    found = {(x.run, x.metric): (x.value, x.n) for x in evaluate.all_metrics(gold, pred, cases, g, asked, p, texts, goals, ["fjords", "isles"]).collect()}
    assert found[0, "evidence_verbatim"] == (0.5, 2) and found[1, "retry_rate"] == (0.0, 2) and (1, "abstention_recall") not in found and found[0, "stance_coverage"] == (0.8, 5)


def test_sidecars(spark):
    from parallax.operators import history

    raw = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, source string, lang string")
    side = spark.createDataFrame([(1, None, 5), (2, "q", None)], "id long, source string, score int")
    got = sorted(tuple(r) for r in history.merge_sidecar(raw, side, "id").collect())
    assert got == [(1, None, "x", 5), (2, "q", "y", None), (3, "c", "z", None)]  # a null of the sidecar holds


def test_quality(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 1.0), (3, None)], "k long, v double")
    assert [tuple(r) for r in quality.violations(df, "k", {"negative": F.col("v") < 0}).collect()] == [(1, "negative")]
    topics = spark.createDataFrame([("g", "a"), ("g", "b")], "grouping string, topic string")
    goals = spark.createDataFrame([("g", "b", " "), ("g", "c", "x")], "grouping string, topic string, goal string")
    assert sorted(tuple(r) for r in quality.goal_mismatch(topics, goals).collect()) == [("g", "a", "missing goal"), ("g", "b", "empty goal"), ("g", "c", "goal without topic")]
    nested = spark.createDataFrame([(1, {"g": {"t": (0, "")}}), (2, {"g": {"t": (0, "q")}, "h": {"u": (0, None)}}), (3, None)], "event long, stances map<string,map<string,struct<score:int,evidence:string>>>")
    got = {r.event: r.stances for r in quality.cleanup_neutrals(nested).collect()}
    assert got[1] is None and list(got[2]) == ["g"] and got[3] is None
    again = {r.event: r.stances for r in quality.cleanup_neutrals(quality.cleanup_neutrals(nested)).collect()}
    assert again == got


def test_queries_read_whole_pages(spark, tmp_path):
    """Dates and listings of the page itself, far behind the mark that the query puts in front."""
    from parallax.plans import landing as plans

    far = "<p>" + "word " * 100 + "</p>"
    rows = [(4, "u4", far + '<time datetime="2023-03-04T00:00:00Z">x</time>'), (15, "u15", far + "<p>05.06.2023</p>"), (26, "u26", far), (5, "u5", far)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.date for r in plans.page_date(spark, str(tmp_path)).collect()}
    assert got == {4: D(2023, 3, 4), 15: D(2023, 6, 5), 26: None, 5: D(2024, 1, 6)}
    whole = plans.landing.listing_items
    plans.landing.listing_items = lambda pages: pages.select("page_id", F.length("html").alias("n"))
    try:
        assert all(r.n > len(html) for r in plans.page_json_items(spark, str(tmp_path)).collect() for i, _, html in rows if i == r.page_id)
    finally:
        plans.landing.listing_items = whole


def test_relevance_by_postings_equals_all_pairs(spark):
    import random

    rng = random.Random(7)
    names = [f"n{i}" for i in range(30)]
    groupings = [(f"g{i}", rng.sample(names, rng.randint(0, 5)), rng.sample(["t1", "t2", "t3"], rng.randint(0, 2))) for i in range(60)]
    events = [(k, rng.choice([None, *names]), rng.sample(names, rng.randint(0, 6)), rng.choice([None, [], [f"g{rng.randint(0, 59)}"]]), rng.choice([None, ["t1"], ["t2", "t3"]])) for k in range(200)]

    def related(source, actors, formats, topics, name, members, tracked):
        met, topic = len(set(actors) & set(members)), bool(set(topics or []) & set(tracked))
        return name in (formats or []) or bool(members) and met == len(members) or met >= 2 and topic or source in members and topic

    want = {(k, g) for k, s, a, f, t in events for g, m, x in groupings if related(s, a, f, t, g, m, x)}
    tags = spark.createDataFrame(events, "event long, source_country string, actors array<string>, formats array<string>, topics array<string>")
    found = classify.grouping_relevance(tags, spark.createDataFrame(groupings, "grouping string, members array<string>, tracked array<string>"))
    rows = found.collect()
    assert {(r.event, r.grouping) for r in rows} == want and len(rows) == len(want)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
