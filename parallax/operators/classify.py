"""Classification and enrichment: normalised tags, relevance to groupings, model responses and ratings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions.columns import strip


def normalize_actors(raw: Column, aliases: dict[str, str], order: list[str], country: Column, known: Column) -> Column:
    """Codes in canonical order: trimmed, upper-cased, through the aliases, with a known source's own country; unknown names drop out."""
    table = F.create_map(*[F.lit(x) for p in aliases.items() for x in p])
    codes = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda a: F.coalesce(table[F.upper(F.trim(a))], F.upper(F.trim(a))))
    codes = F.array_union(codes, F.when(known & country.isNotNull(), F.array(country)).otherwise(F.array().cast("array<string>")))
    return F.array_intersect(F.array(*map(F.lit, order)), codes)  # in the order of the first; the codes are made once


def normalize_formats(raw: Column, keys: list[str]) -> Column:
    """The known grouping keys named, each once."""
    named = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda f: F.lower(F.trim(f)))
    return F.array_sort(F.array_distinct(F.filter(named, lambda f: f.isin(*keys))))


def grouping_postings(groupings: DataFrame) -> DataFrame:
    """(kind, value, grouping): by which actors, sources, topics and names an event may come to a grouping."""
    listed = lambda kind, values: F.transform(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    every = F.concat(listed("actor", F.col("members")), listed("source", F.col("members")), listed("topic", F.col("tracked")), listed("format", F.array("grouping")))
    return groupings.select("grouping", F.explode(every).alias("p")).select("p.kind", "p.value", "grouping")


def grouping_relevance(tags: DataFrame, groupings: DataFrame) -> DataFrame:
    """tags and groupings side by side, for each grouping an event is relevant to; an event has one row of tags.

    Named as a format, or all its members present; or two members and a tracked topic; or a member as source and a tracked topic. What an
    event says is looked up in the groupings' postings, so that it meets those groupings alone that share something with it, however many
    there are.
    """
    listed = lambda kind, values: F.transform(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    every = F.concat(listed("actor", F.col("actors")), listed("source", F.array("source_country")), listed("topic", F.col("topics")), listed("format", F.col("formats")))
    said = tags.select("event", F.explode(every).alias("p")).select("event", "p.kind", "p.value")
    of = lambda kind: F.count_if(F.col("kind") == kind)
    met = said.join(grouping_postings(groupings), ["kind", "value"]).groupBy("event", "grouping").agg(*[of(k).alias(f"_{k}") for k in ("actor", "source", "topic", "format")])
    sized = met.join(groupings.select("grouping", F.size("members").alias("_size")), "grouping")
    holds = (F.col("_format") > 0) | ((F.col("_size") > 0) & (F.col("_actor") == F.col("_size"))) | ((F.col("_topic") > 0) & ((F.col("_actor") >= 2) | (F.col("_source") > 0)))
    found = sized.filter(holds).select("event", "grouping")
    return tags.join(found, "event").join(groupings, "grouping").select(*tags.columns, *groupings.columns)


def backfill_flags(tags: DataFrame, groupings: DataFrame) -> DataFrame:
    """tags with `flags`, the groupings that an event is relevant to by its stored tags alone, where flags is null; others keep theirs."""
    open_ = tags.filter("flags is null").withColumn("formats", F.array().cast("array<string>"))
    found = grouping_relevance(open_, groupings).groupBy("event").agg(F.array_sort(F.collect_set("grouping")).alias("_found"))  # a few configured groupings
    filled = tags.join(found, "event", "left")
    return filled.withColumn("flags", F.coalesce("flags", "_found", F.array().cast("array<string>"))).drop("_found")


def wanted_topics(relevant: DataFrame) -> DataFrame:
    """(event, grouping, topic): the tracked topics of the groupings an event is relevant to."""
    return relevant.select("event", "grouping", F.explode(F.array_intersect("topics", "tracked")).alias("topic"))


def unfenced(raw: Column) -> Column:
    """What stands between the first fence and the next one, without a language tag, where the text begins with a fence; else the text."""
    inner = F.get(F.split(raw, "```"), F.lit(1))
    return strip(F.when(raw.startswith("```"), F.regexp_replace(inner, "^json", "")).otherwise(raw))


def parse_responses(df: DataFrame, schema: str, column: str = "raw") -> DataFrame:
    """Adds parsed and status (ok, error): a JSON object, in a fence or not; what follows the closing fence doesn't matter."""
    body = unfenced(F.col(column))
    parsed = F.from_json(body, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    out = df.withColumn("_parsed", parsed)
    bad = F.col("_parsed").isNull() | F.col("_parsed._corrupt_record").isNotNull() | ~body.startswith("{")
    return out.withColumn("status", F.when(bad, "error").otherwise("ok")).withColumn("parsed", F.when(~bad, F.col("_parsed").dropFields("_corrupt_record"))).drop("_parsed")


def flat_strings(value: Column, path: str) -> Column:
    """Whether the JSON value at path is absent, null, or an array of strings only, without nulls."""
    v = F.variant_get(F.try_parse_json(value), path, "variant")
    kind = F.schema_of_variant(v)
    listed = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")  # an array of nulls alone is one of VOID, too
    full = ~F.exists(F.when(listed, F.try_variant_get(v, "$", "array<string>")), lambda x: x.isNull())
    return v.isNull() | (kind == "VOID") | (listed & F.coalesce(full, F.lit(False)))


def response_shape(value: Column, fields: tuple[str, ...] = ("actors", "explicit_formats")) -> Column:
    """Null for a response whose fields are flat arrays of strings, or the first field that isn't."""
    return F.coalesce(*[F.when(~flat_strings(value, f"$.{f}"), F.lit(f)) for f in fields])


def build_positions(topics: Column, positions: Column) -> tuple[Column, Column]:
    """(map of positions, status): every topic but `other` needs a position with text, or the whole item fails."""
    needed = F.filter(topics, lambda t: t != "other")
    got = F.forall(needed, lambda t: F.coalesce(F.trim(positions[t]) != "", F.lit(False)))
    return F.when(got, F.map_from_entries(F.transform(needed, lambda t: F.struct(t, F.trim(positions[t]))))), F.when(got, "ok").otherwise("error")


def clean_stance(raw: Column, is_number: Column | None = None) -> tuple[Column, Column]:
    """(score, error): a whole number from -2 to 2; null for what is none; any other whole number, however large, is an error. A value
    that the response gives as a number, not as a text (is_number), loses its fraction first."""
    text = strip(raw)
    if is_number is not None:
        cut = F.regexp_replace(text, r"^([+-]?[0-9]+)\.[0-9]*$", "$1")
        text = F.when(F.coalesce(is_number, F.lit(False)), cut).otherwise(text)
    number = text.try_cast("decimal(38,0)")
    whole = text.rlike(r"^[+-]?[0-9]+$")
    fits = F.coalesce(whole & number.between(-2, 2), F.lit(False))
    return F.when(fits, number).cast("int"), F.coalesce(whole & ~fits, F.lit(False))


def clean_evidence(evidence: Column, goal: Column) -> Column:
    """Trimmed; empty if it holds the goal or lies in it. A missing goal is the empty text, which every quote holds."""
    e, g = strip(F.coalesce(evidence, F.lit(""))), F.coalesce(goal, F.lit(""))
    return F.when(F.contains(g, e) | F.contains(e, strip(g)), "").otherwise(e)


def drop_blank_neutrals(ratings: DataFrame) -> DataFrame:
    """A score of 0 without evidence is no rating."""
    return ratings.filter(~((F.col("score") == 0) & (F.coalesce(F.trim("evidence"), F.lit("")) == "")))


def merge_ratings(old: DataFrame, new: DataFrame, stamp: str) -> DataFrame:
    """new over old for each (event, grouping, topic); what comes from new carries the stamp."""
    keys = ["event", "grouping", "topic"]
    both = old.withColumns({"_new": F.lit(0)}).unionByName(new.withColumns({"_new": F.lit(1), "model": F.lit(stamp)}), allowMissingColumns=True)
    best = both.groupBy(*keys).agg(F.max_by(F.struct("score", "evidence", "model"), "_new").alias("r"))
    return best.select(*keys, "r.*")


def rating_outcomes(events: DataFrame, merged: DataFrame) -> DataFrame:
    """(event, outcome) of events (event, failed): error where scoring failed or the raw event is missing, empty where nothing is rated, which
    is no failure, else ok."""
    rated = merged.select("event").distinct().withColumn("_rated", F.lit(True))
    outcome = F.when(F.col("failed"), "error").when(F.col("_rated"), "ok").otherwise("empty")
    return events.join(rated, "event", "left").select("event", outcome.alias("outcome"))


def status_counts(rows: DataFrame, column: str) -> DataFrame:
    """(column, n)."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def render_prompts(df: DataFrame, template: str, **columns: Column) -> DataFrame:
    """Adds prompt: the template with {name} filled from columns."""
    text = F.lit(template)
    for name, value in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return df.withColumn("prompt", text)


def batch_score(df: DataFrame, scorer: Callable[[str], str], attempts: int = 2, columns: tuple[str, ...] = ("event",)) -> DataFrame:
    """`columns`, answer, attempts, status, error: scorer(prompt) for each row, tried up to `attempts` times. A failure is a row, not an exception."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for prompt in pdf["prompt"]:
                answer, error, n = None, None, 0
                while n < attempts and answer is None:
                    n += 1
                    try:
                        answer = scorer(prompt)
                    except Exception as e:  # noqa: BLE001  the caller's function may raise anything
                        error = f"{type(e).__name__}: {e}"[:200]
                rows.append((answer, n, "ok" if answer is not None else "error", None if answer is not None else error))
            out = pdf[list(columns)].copy()
            out[["answer", "attempts", "status", "error"]] = pd.DataFrame(rows, columns=["answer", "attempts", "status", "error"], index=pdf.index)
            yield out

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, "prompt").mapInPandas(run, f"{kinds}, answer string, attempts int, status string, error string")


def pending(items: DataFrame, done: DataFrame, keys: list[str], order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Items without a match in done, in order, at most `limit` of them."""
    left = items.join(done.select(*keys).distinct(), keys, "left_anti")
    if order:
        left = left.orderBy(*order)
    return left.limit(limit) if limit is not None else left
