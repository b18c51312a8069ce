"""Queries of landing and dates, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parallax.functions import dates
from parallax.functions.columns import content_hash, strip_html
from parallax.sources import landing, pages
from parallax.sources.adapters import AS_OF, RAW_ITEMS, raw_items, read

TODAY = dt.date(2000, 6, 30)
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
STORED = f"{RAW_ITEMS}, hashed AS (SELECT *, substring(sha256(url || title), 1, 8) AS hash FROM raw_items), stored AS (SELECT DISTINCT source_name, hash FROM hashed WHERE doc_id % 3 = 0), offered AS (SELECT * FROM hashed WHERE doc_id % 3 <> 0)"


def _stored(s, d):
    return landing.with_hash(raw_items(s, d).filter("doc_id % 3 = 0"))


def _offered(s, d):
    return raw_items(s, d).filter("doc_id % 3 <> 0")


def _day(items):
    """Items dated by their source; every seventh has no date."""
    return items.withColumn("date", F.when(F.col("doc_id") % 7 != 0, F.date_add(F.lit(AS_OF), -F.length("source_name") - F.length("text").cast("int") % 60)))


DAYED = "CASE WHEN doc_id % 7 <> 0 THEN CAST(DATE '2024-01-30' - CAST(length(source_name) + length(text) % 60 AS INT) AS DATE) END AS date"


def append_new(s, d):
    new = landing.append_new(_day(_offered(s, d)), _day(_stored(s, d)).withColumn("month", F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("unknown"))), [F.col("doc_id")])
    return new.select("source_name", "month", "date", "hash", "doc_id")


def _channels(s, d):
    """The same page offered by up to three channels, with and without a query and https."""
    p = read(s, d, "pages").select(F.col("page_id").alias("item"), "url")
    ch = p.withColumn("channel", F.explode(F.sequence(F.lit(0), (F.col("item") % 3).cast("int"))))
    return ch.withColumn("url", F.when(F.col("channel") == 1, F.concat("url", F.lit("&utm=1"))).when(F.col("channel") == 2, F.regexp_replace("url", "^http:", "https:")).otherwise(F.col("url")))


CHANNELS = """p AS (SELECT page_id AS item, url, CAST(unnest(generate_series(0, page_id % 3)) AS INT) AS channel FROM pages),
channels AS (SELECT item, channel, CASE channel WHEN 1 THEN url || '&utm=1' WHEN 2 THEN regexp_replace(url, '^http:', 'https:') ELSE url END AS url FROM p)"""


def _raw_dates(s, d):
    """Order dates printed in a form that depends on the order's key; some are garbage."""
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    day = F.dayofmonth("d")
    ending = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("d"))
    n = F.col("id") % 6
    raw = (
        F.when(n == 0, F.date_format("d", "yyyy-MM-dd"))
        .when(n == 1, F.date_format("d", "dd.MM.yyyy"))
        .when(n == 2, F.concat(month, F.lit(" "), day.cast("string"), F.lit(", "), F.year("d").cast("string")))
        .when(n == 3, F.concat(F.lit("On : "), month, F.lit(" "), day.cast("string"), ending, F.lit(" "), F.year("d").cast("string")))
        .when(n == 4, F.concat(F.date_format("d", "E"), F.lit(", "), day.cast("string"), F.lit(" "), F.substring(month, 1, 3), F.lit(" "), F.year("d").cast("string"), F.lit(" 09:30:00 +0000")))
        .otherwise(F.lit("no date here"))
    )
    return o.select("id", "d", raw.alias("raw"))


def parse_dates(s, d):
    """Each source's texts in its own forms: s0 has few, s1 cleans first, s2 others; s3 isn't listed."""
    forms = {"s0": ["day", "dotted"], "s1": ["day", "dotted", "month_day", "month_plain"], "s2": ["mail", "month_day"]}
    rows = _raw_dates(s, d).withColumn("source", F.concat(F.lit("s"), (F.floor(F.col("id") / 6) % 4).cast("string")))
    return dates.dates_by_source(rows, "raw", "source", forms, TODAY, cleaned=("s1",)).select("id", "date")


def preferred_dates(s, d):
    """A date in the URL for most orders, one on the page for some, and one on the list for others."""
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"))
    url = F.when(F.col("id") % 5 != 0, F.concat(F.lit("https://x/"), F.date_format("day", "yyyy/MM/dd/a")))
    page, listed = F.when(F.col("id") % 3 == 0, F.date_add("day", 1)), F.when(F.col("id") % 7 != 0, F.date_add("day", 2))
    return o.select("id", dates.prefer_dates(dates.url_date(url, TODAY), page, listed).alias("date"))


def url_topn(s, d):
    """Every ninth URL ends in a word."""
    tail = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit("x"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "/").otherwise("")))
    return landing.top_candidates(read(s, d, "documents").select("doc_id", F.concat(F.lit("https://x/"), tail).alias("url"))).select("doc_id", "content_id")


def url_top_dated(s, d):
    o = read(s, d, "orders")
    day = F.when(F.col("o_orderkey") % 5 == 0, F.lit("news/")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd/"))
    url = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "http").otherwise("https"), F.lit("://x/"), day, F.floor(F.col("o_orderkey") / 3).cast("string"), F.lit("?q="), F.col("o_orderkey").cast("string"))
    return landing.top_dated(o.select(url.alias("url")), TODAY)


def sink_twice(s, d):
    """New items written twice to the shared folder, as a repeated run would, and read again."""
    import uuid

    base = s.conf.get("spark.checkpoint.dir", "") or s.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/sink-{uuid.uuid4().hex}"
    new = append_new(s, d)
    for _ in range(2):
        landing.write_events(new, path)
    return s.read.schema(new.schema).parquet(path).select(*new.columns)


def counted_landing(s, d):
    """Dated items written to the shared folder, and counted as they are."""
    import uuid

    base = s.conf.get("spark.checkpoint.dir", "") or s.conf.get("spark.sql.warehouse.dir")
    items = _day(raw_items(s, d)).select("doc_id", "source_name", "date")
    return landing.write_counted(items, F.col("date").isNotNull(), f"{base.rstrip('/')}/counted-{uuid.uuid4().hex}", ["de", "en", "es", "fr", "none"])


def url_date(s, d):
    o = read(s, d, "orders")
    url = F.concat(F.lit("https://x/en/"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("news/")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd/")), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", dates.url_date(url, TODAY).alias("date"))


def _runs(s, d):
    e = read(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("source"), F.lit(1).alias("fetched"), (F.col("event_type") == "click").cast("int").alias("new"), (F.col("event_type") == "view").cast("int").alias("skipped"), (F.col("event_type") == "signup").cast("int").alias("known"), F.when((F.col("event_type") == "error") & (F.col("user_id") % 4 == 0), "boom").alias("error"))


def _day_text(column="page_id", form="yyyy-MM-dd"):
    return F.date_format(F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col(column) % 28).cast("int")), form)


def page_date(s, d):
    """Pages that get a date put in, in ten forms, some beside a worse one, or none."""
    n, day, german = F.col("page_id") % 11, _day_text(), _day_text(form="dd.MM.yyyy")
    forms = {
        0: ('<time datetime="', day, 'T10:00:00Z">x</time>'),
        1: ("<META content='", day, "' name=date>"),
        2: ('<script type="application/ld+json">{"datePublished": "', day, 'T08:00:00Z"}</script>'),
        3: ("<p>", german, "</p>"),
        5: ('<meta itemprop="datePublished" content="', day, '">'),
        6: ('<meta name="DC.date.issued" content="', day, '">'),
        7: ('<meta property="article:published_time" content="2023-05-05"><meta name="date" content="', day, '">'),
        8: ('<script type="application/ld+json">{broken</script><script type="application/ld+json">[1, {"datePublished": 3}, {"datePublished": "', day, '"}]</script>'),
        9: ('<time datetime="2099-01-01">x</time><meta name="date" content="', day, '">'),
        10: ("<time> ", german, "</time>"),
    }
    mark = F.lit("")
    for k, (before, text, behind) in forms.items():
        mark = F.when(n == k, F.concat(F.lit(before), text, F.lit(behind))).otherwise(mark)
    return landing.extract_date(read(s, d, "pages").select("page_id", F.concat(mark, "html").alias("html")), AS_OF)


def page_title(s, d):
    """Pages with titles put in: an og:title, boilerplate, a dash, a site's name, none but a heading of the article or of main."""
    n = F.col("page_id") % 7
    mark = (
        F.when(n == 1, F.concat(F.lit("<meta content='Og "), F.col("page_id").cast("string"), F.lit("' property=og:title>")))
        .when(n == 2, '<meta property="og:title" content=" Welcome ">')
        .when(n == 3, "<title>Summit - what comes next</title>")
        .when(n == 4, "<title>Summit news – The Office</title>")
        .when(n >= 5, "<title>Home</title>")
        .otherwise("")
    )
    body = F.when(n == 6, F.regexp_replace(F.regexp_replace("html", "(?i)<article>", "<main><h1>willkommen</h1>"), "(?i)</article>", "</main>")).otherwise(F.col("html"))
    return landing.extract_title(read(s, d, "pages").select("page_id", F.concat(mark, body).alias("html")), suffixes=("The Office",))


def _payloads(s, d):
    """Documents wrapped as RSS and Atom: links of other relations, entities in links, prefixes, contents in CDATA, feeds cut off."""
    n, id_ = F.col("doc_id"), F.col("doc_id").cast("string")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # What is escaped twice is a text with marks in it, which stay marks when the XML is read.
    twice = F.replace(escaped, F.lit("&"), F.lit("&amp;"))
    text = F.when(n % 5 == 1, F.concat(F.lit("<![CDATA[<p>"), escaped, F.lit("</p>]]>"))).otherwise(twice)
    title = F.when(n % 11 == 0, F.lit("")).when(n % 7 == 0, F.concat(F.lit("<![CDATA[Title "), id_, F.lit("]]>"))).otherwise(F.concat(F.lit("Title "), id_))
    url = F.concat(F.lit("https://x/"), id_, F.when(n % 3 == 0, "?a=1&amp;b=2").otherwise(""))
    other = F.when(n % 4 < 2, F.concat(F.lit('<atom:link xmlns:atom="http://www.w3.org/2005/Atom" rel="edit" href="https://edit/'), id_, F.lit('"/>'))).otherwise("")
    atom = F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><link href="https://feed"/><entry><title>'), title, F.lit("</title>"), other, F.lit('<link rel="alternate" href="'), url, F.lit('"/><summary>short</summary><content>'), text, F.lit("</content><updated>"), _day_text("doc_id"), F.lit("T08:00:00Z</updated></entry></feed>"))
    rss = F.concat(F.lit("<rss><channel><link>https://channel</link><item><title>"), title, F.lit("</title>"), other, F.lit("<link>"), url, F.lit("</link><description>"), F.when(n % 2 == 1, text).otherwise("short"), F.lit("</description><pubDate>"), _day_text("doc_id", "d MMM yyyy"), F.lit(" 08:00:00 +0000</pubDate></item></channel></rss>"))
    body = F.when(n % 2 == 0, atom).otherwise(rss)
    return read(s, d, "documents").select("doc_id", F.col("lang").alias("source_name"), F.when(n % 13 == 5, F.substring_index(body, "</title>", 1)).otherwise(body).alias("body"))


def feed_parse(s, d):
    return landing.parse_feeds(_payloads(s, d), AS_OF).select("source_name", "title", "url", F.length("text").alias("n_chars"), F.col("published").cast("date").alias("date"))


def page_json_items(s, d):
    blob = F.concat(F.lit('<script data-listing>{"result": {"items": '), F.to_json(F.transform(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("title"), F.concat("url", F.lit("#"), i.cast("string")).alias("url"), F.lit("2024-01-01").alias("date")))), F.lit("}}</script>"))
    return landing.listing_items(read(s, d, "pages").select("page_id", F.concat(blob, "html").alias("html")))


def collection_tier(s, d):
    items = read(s, d, "documents").select("doc_id", F.col("source").alias("source_name"), F.col("lang").alias("source_lang"))
    return landing.collection_tier(items, {f"src{i}": ["de", "en", "es", "fr"][i % 4] for i in range(12)}).select("doc_id", "collection")


def channel_fallback(s, d):
    docs = read(s, d, "documents").select(F.col("source").alias("source_name"), "doc_id")
    return landing.with_fallback(docs.filter("source_name in ('src0', 'src1', 'src2')").withColumn("channel", F.lit(1)), docs.withColumn("channel", F.lit(2)))


QUERIES = {
    "content_hash": lambda s, d: raw_items(s, d).select("doc_id", content_hash(F.col("url"), F.col("title")).alias("hash")),
    "skip_known": lambda s, d: landing.skip_known(_offered(s, d), _stored(s, d)).select("source_name", "hash", "doc_id"),
    "known_counts": lambda s, d: landing.known_counts(_offered(s, d), _stored(s, d)),
    "append_new": append_new,
    "url_dedup": lambda s, d: landing.dedup_by_url(_channels(s, d), "channel").select("clean_url", "channel", "item"),
    "url_topn": url_topn,
    "url_top_dated": url_top_dated,
    "sink_twice": sink_twice,
    "preferred_dates": preferred_dates,
    "url_filter": lambda s, d: landing.filter_article_urls(read(s, d, "pages").select("page_id", "url"), "http://", r"/(fr|de)/[0-9]+").select("page_id"),
    "since_filter": lambda s, d: landing.since(_day(raw_items(s, d)), dt.date(2024, 1, 1)).select("doc_id", "date"),
    "dateless_stats": lambda s, d: landing.dateless(_day(raw_items(s, d)), "source_name"),
    "counted_landing": counted_landing,
    "channel_fallback": channel_fallback,
    "collection_tier": collection_tier,
    "ingest_run_log": lambda s, d: landing.run_summary(_runs(s, d)),
    "strip_html": lambda s, d: read(s, d, "pages").select("page_id", strip_html(F.col("html")).alias("text")),
    "page_body": lambda s, d: landing.extract_body(read(s, d, "pages")),
    "page_title": page_title,
    "page_elements": lambda s, d: pages.page_elements(read(s, d, "pages")).groupBy("page_id", "name").agg(F.count("*").alias("n")).filter("name in ('a', 'article', 'br', 'h1', 'li', 'p', 'script', 'title')"),
    "page_date": page_date,
    "page_json_items": page_json_items,
    "feed_parse": feed_parse,
    "feed_broken": lambda s, d: landing.broken_feeds(_payloads(s, d)).select("doc_id"),
    "clean_dates": lambda s, d: _raw_dates(s, d).select("id", dates.clean_date(F.col("raw")).alias("clean")),
    "parse_dates": parse_dates,
    "strict_dates": lambda s, d: _raw_dates(s, d).select("id", dates.strict_date(F.col("raw"), TODAY).alias("date"), dates.strict_date(F.col("raw"), None).alias("unranged"), dates.strict_date(F.when(F.col("id") % 4 == 0, F.date_format("d", "dd/MM/yyyy")).otherwise(F.col("raw")), None, dates.UNRANGED_SLASHED).alias("slashed")),
    "url_date": url_date,
    "month_spine": lambda s, d: dates.month_spine(read(s, d, "orders"), "o_orderdate", TODAY),
}

_STRIP = lambda x: f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g'))"
_CLEAN = "regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
_READ = lambda x: f"replace(replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', chr(160)), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_EDGE = "^[\\s\\x{A0}]+|[\\s\\x{A0}]+$"
_NODES = lambda x: f"list_filter(list_transform(regexp_split_to_array({x}, '<[^>]*>'), lambda y: regexp_replace({_READ('y')}, '{_EDGE}', '', 'g')), lambda y: y <> '')"
_PARAGRAPH = _NODES("regexp_split_to_array(x, '(?i)</p>')[1]")
BODY = f"""scoped AS (SELECT page_id, regexp_extract({_CLEAN}, '(?is)<article[^>]*>(.*?)</article>', 1) AS s FROM pages),
parts AS (SELECT page_id, list_transform(regexp_split_to_array(s, '(?i)<p(?:\\s[^>]*)?>')[2:], lambda x: {_PARAGRAPH}) AS ps FROM scoped),
bodies AS (SELECT page_id, array_to_string(list_transform(list_filter(ps, lambda x: length(array_to_string(x, '')) > 40), lambda x: array_to_string(x, ' ')), ' ') AS body FROM parts)"""
_TITLE_OF = _NODES("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_HEAD_OF = _NODES("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_MONTH = "monthname(o_orderdate)"
_DAY = "CAST(extract(day FROM o_orderdate) AS VARCHAR)"
_END = "CASE WHEN extract(day FROM o_orderdate) IN (11, 12, 13) THEN 'th' WHEN extract(day FROM o_orderdate) % 10 = 1 THEN 'st' WHEN extract(day FROM o_orderdate) % 10 = 2 THEN 'nd' WHEN extract(day FROM o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END"
_T = f"DATE '{TODAY}'"
_RANGE = f"CASE WHEN CAST(o_orderdate AS DATE) > DATE '1995-01-01' AND CAST(o_orderdate AS DATE) <= {_T} THEN CAST(o_orderdate AS DATE) END"

ORACLE = {
    "content_hash": f"WITH {STORED} SELECT doc_id, hash FROM hashed",
    "skip_known": f"WITH {STORED} SELECT source_name, hash, doc_id FROM offered o WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_name = o.source_name AND s.hash = o.hash)",
    "known_counts": f"WITH {STORED} SELECT o.source_name, count(*) AS offered, count(s.hash) AS known FROM offered o LEFT JOIN stored s ON s.source_name = o.source_name AND s.hash = o.hash GROUP BY o.source_name",
    "append_new": f"""WITH {STORED}, dayed AS (SELECT *, {DAYED} FROM hashed), keyed AS (SELECT *, coalesce(strftime(date, '%Y-%m'), 'unknown') AS month FROM dayed)
SELECT source_name, month, date, hash, doc_id FROM (SELECT * FROM keyed WHERE doc_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY source_name, month, date, hash ORDER BY doc_id) = 1) k
WHERE NOT EXISTS (SELECT 1 FROM keyed s WHERE s.doc_id % 3 = 0 AND s.source_name = k.source_name AND s.month = k.month AND s.hash = k.hash AND s.date IS NOT DISTINCT FROM k.date)""",
    "sink_twice": f"""WITH {STORED}, dayed AS (SELECT *, {DAYED} FROM hashed), keyed AS (SELECT *, coalesce(strftime(date, '%Y-%m'), 'unknown') AS month FROM dayed)
SELECT source_name, month, date, hash, doc_id FROM (SELECT * FROM keyed WHERE doc_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY source_name, month, date, hash ORDER BY doc_id) = 1) k
WHERE NOT EXISTS (SELECT 1 FROM keyed s WHERE s.doc_id % 3 = 0 AND s.source_name = k.source_name AND s.month = k.month AND s.hash = k.hash AND s.date IS NOT DISTINCT FROM k.date)""",
    "url_dedup": f"WITH {CHANNELS} SELECT regexp_replace(regexp_replace(url, '[?].*$', ''), '^http://', 'https://') AS clean_url, channel, item FROM channels QUALIFY row_number() OVER (PARTITION BY clean_url ORDER BY channel, item) = 1",
    "url_topn": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id END AS content_id FROM documents ORDER BY content_id DESC, 'https://x/x' || doc_id || 'x' LIMIT 400",
    "url_top_dated": f"WITH u AS (SELECT DISTINCT 'https://x/' || CASE WHEN o_orderkey % 5 = 0 THEN 'news/' ELSE strftime(o_orderdate, '%Y/%m/%d/') END || CAST(floor(o_orderkey / 3) AS BIGINT) AS url, CASE WHEN o_orderkey % 5 <> 0 THEN {_RANGE} END AS date FROM orders) SELECT * FROM u ORDER BY date DESC NULLS LAST, url LIMIT 500",
    "preferred_dates": f"WITH x AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 5 <> 0 THEN {_RANGE} END AS u FROM orders) SELECT id, CAST(CASE WHEN u IS NOT NULL THEN u WHEN id % 3 = 0 THEN d + 1 WHEN id % 7 <> 0 THEN d + 2 END AS DATE) AS date FROM x",
    "url_filter": "SELECT page_id FROM pages WHERE starts_with(url, 'http://') AND regexp_matches(url, '/(fr|de)/[0-9]+')",
    "since_filter": f"WITH {RAW_ITEMS}, x AS (SELECT doc_id, {DAYED} FROM raw_items) SELECT * FROM x WHERE date >= DATE '2024-01-01'",
    "dateless_stats": f"WITH {RAW_ITEMS}, x AS (SELECT source_name, {DAYED} FROM raw_items) SELECT source_name, count(date) AS kept, count(*) FILTER (date IS NULL) AS dropped FROM x GROUP BY source_name",
    "counted_landing": f"WITH {RAW_ITEMS}, x AS (SELECT source_name, {DAYED} FROM raw_items), n AS (SELECT unnest(['de', 'en', 'es', 'fr', 'none', 'TOTAL']) AS name) SELECT name AS source_name, count(source_name) AS fetched, count(date) AS new, count(source_name) - count(date) AS skipped FROM n LEFT JOIN x ON name IN (source_name, 'TOTAL') GROUP BY name",
    "channel_fallback": "SELECT source AS source_name, doc_id, CAST(CASE WHEN source IN ('src0', 'src1', 'src2') THEN 1 ELSE 2 END AS INT) AS channel FROM documents",
    "collection_tier": "SELECT doc_id, CASE WHEN CAST(substring(source, 4) AS INT) >= 12 THEN NULL WHEN ['de', 'en', 'es', 'fr'][CAST(substring(source, 4) AS INT) % 4 + 1] = lang THEN 'native' ELSE 'fallback' END AS collection FROM documents",
    "ingest_run_log": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS source, count(*) AS fetched, count(*) FILTER (event_type = 'click') AS new, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'signup') AS known,
  CAST(bool_or(event_type = 'error' AND user_id % 4 = 0) AS INT) AS errors FROM events GROUP BY user_id)
SELECT source, fetched, new, skipped, known, CAST(errors AS BIGINT) AS errors FROM r UNION ALL SELECT 'TOTAL', CAST(sum(fetched) AS BIGINT), CAST(sum(new) AS BIGINT), CAST(sum(skipped) AS BIGINT), CAST(sum(known) AS BIGINT), CAST(sum(errors) AS BIGINT) FROM r""",
    "strip_html": f"SELECT page_id, {_STRIP('html')} AS text FROM pages",
    "page_body": f"WITH {BODY} SELECT * FROM bodies",
    "page_title": f"SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'Og ' || page_id WHEN 3 THEN 'Summit - what comes next' WHEN 4 THEN 'Summit news' WHEN 5 THEN array_to_string({_HEAD_OF}, ' ') WHEN 6 THEN array_to_string({_HEAD_OF}, ' ') ELSE array_to_string({_TITLE_OF}, ' ') END AS title FROM pages",
    "page_elements": "SELECT page_id, lower(name) AS name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(a|article|br|h1|li|p|script|title)[\\s>]', 1)) AS name FROM pages) GROUP BY ALL",
    "page_date": "SELECT page_id, CASE WHEN page_id % 11 <> 4 THEN CAST(DATE '2024-01-01' + CAST(page_id % 28 AS INT) AS DATE) END AS date FROM pages",
    "page_json_items": "SELECT page_id, 't' || CAST(i AS VARCHAR) AS title, url || '#' || CAST(i AS VARCHAR) AS url, '2024-01-01' AS date FROM (SELECT page_id, url, unnest(generate_series(0, page_id % 3)) AS i FROM pages)",
    "feed_parse": "SELECT lang AS source_name, 'Title ' || CAST(doc_id AS VARCHAR) AS title, 'https://x/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '?a=1&b=2' ELSE '' END AS url, CAST(least(5000, length(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS INT) AS n_chars, CAST(DATE '2024-01-01' + CAST(doc_id % 28 AS INT) AS DATE) AS date FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 5",
    "feed_broken": "SELECT doc_id FROM documents WHERE doc_id % 13 = 5",
    "clean_dates": f"""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN {_MONTH} || ' ' || {_DAY} || ', ' || CAST(year(o_orderdate) AS VARCHAR)
  WHEN 3 THEN {_MONTH} || ' ' || {_DAY} || ' ' || CAST(year(o_orderdate) AS VARCHAR) WHEN 4 THEN {_DAY} || ' ' || substring({_MONTH}, 1, 3) || ' ' || CAST(year(o_orderdate) AS VARCHAR) || ' 09:30:00 +0000' ELSE 'no date here' END AS clean FROM orders""",
    "parse_dates": f"SELECT o_orderkey AS id, CASE WHEN CASE CAST(floor(o_orderkey / 6) AS BIGINT) % 4 WHEN 0 THEN o_orderkey % 6 IN (0, 1) WHEN 1 THEN o_orderkey % 6 IN (0, 1, 2, 3) WHEN 2 THEN o_orderkey % 6 IN (2, 4) ELSE false END THEN CAST(o_orderdate AS DATE) ELSE {_T} END AS date FROM orders",
    "strict_dates": f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN {_RANGE} END AS date, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN CAST(o_orderdate AS DATE) END AS unranged, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 6 IN (0, 2) THEN CAST(o_orderdate AS DATE) END AS slashed FROM orders",
    "url_date": f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {_RANGE} END AS date FROM orders",
    "month_spine": f"SELECT CAST(unnest(generate_series(CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP), CAST({_T} AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM orders",
}
