"""Data quality and schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): a row for each rule whose condition is true of a record; null counts as not violated."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(F.col(key).alias("key"), F.explode(found).alias("rule"))


#: Kinds of JSON values by the start of their variant's schema.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def typed_violations(df: DataFrame, key: str, json: str, fields: dict[str, tuple[str, bool]]) -> DataFrame:
    """(key, rule) of JSON objects against fields: name -> (kind, required). A required field that is absent or null is missing; a value
    of another kind is named. Records that are no JSON object break one rule, `not an object`."""
    v = F.try_parse_json(json)
    found = []
    for name, (kind, required) in fields.items():
        shape = F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant"))
        absent = shape.isNull() | (shape == "VOID")
        found.append(F.when(absent, F.lit(f"{name} is missing") if required else F.lit(None)).when(~shape.rlike(f"^{KINDS[kind]}"), F.lit(f"{name} is not {kind}")))
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    rules = F.when(whole, F.array_compact(F.array(*found))).otherwise(F.array(F.lit("not an object")))
    return df.select(F.col(key).alias("key"), F.explode(rules).alias("rule"))


def unknown_fields(df: DataFrame, key: str, json: str, allowed: list[str]) -> DataFrame:
    """(key, field): keys of a JSON object that the schema doesn't have."""
    keys = F.map_keys(F.from_json(json, "map<string,string>"))
    return df.select(F.col(key).alias("key"), F.explode(F.array_except(keys, F.array(*map(F.lit, allowed)))).alias("field"))


def corrupt_records(df: DataFrame, key: str, json: str, schema: str) -> DataFrame:
    """(key, reason): records that are empty or don't parse."""
    r = F.from_json(json, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    blank = F.coalesce(F.trim(json), F.lit("")) == ""
    return df.select(F.col(key).alias("key"), F.when(blank, "empty").when(r["_corrupt_record"].isNotNull(), "invalid").alias("reason")).filter("reason is not null")


def vocabulary_violations(df: DataFrame, key: str, values: Column, vocabulary: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.explode(F.array_except(values, F.array(*map(F.lit, vocabulary)))).alias("value"))


def orphans(rows: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a parent."""
    return rows.join(parents.select(*on).distinct(), on, "left_anti")


def under_path(found: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    return found.filter(F.col(column).startswith(prefix) | F.contains(column, F.lit(prefix)))


def goal_mismatch(topics: DataFrame, goals: DataFrame) -> DataFrame:
    """(grouping, topic, problem) of topics (grouping, topic) against goals (grouping, topic, goal)."""
    both = topics.withColumn("_t", F.lit(1)).join(goals.withColumn("_g", F.lit(1)), ["grouping", "topic"], "full_outer")
    problem = F.when(F.col("_g").isNull(), "missing goal").when(F.col("_t").isNull(), "goal without topic").when(F.trim("goal") == "", "empty goal")
    return both.select("grouping", "topic", problem.alias("problem")).filter("problem is not null")


def config_violations(groupings: DataFrame, tracked: list[str], statuses: list[str]) -> DataFrame:
    """(grouping, problem) of configured groupings (grouping, members, topics, goals, tags, purpose, agreed, status): cards without members,
    purpose or agreed line, or of an unknown status; tags without an objective; topics of groupings that aren't tracked; and topics whose
    goal two groupings share word for word."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "no members": F.size("members") == 0, "no purpose": blank("purpose"), "no agreed line": blank("agreed"), "unknown status": ~F.coalesce(F.col("status").isin(statuses), F.lit(False)),
        "topics but not tracked": (F.size("topics") > 0) & ~F.col("grouping").isin(tracked), "goals but no topics": (F.size("topics") == 0) & (F.size("goals") > 0),
    }
    cards = violations(groupings, "grouping", rules).select(F.col("key").alias("grouping"), F.col("rule").alias("problem"))
    tags = groupings.select("grouping", F.explode("tags").alias("tag", "goal")).filter(blank(F.col("goal"))).select("grouping", F.concat(F.lit("no objective for "), "tag").alias("problem"))
    goals = groupings.select("grouping", F.explode("goals").alias("topic", "goal"))
    same = goals.groupBy("topic", F.trim("goal").alias("goal")).agg(F.count("*").alias("n")).filter("n > 1")
    shared = goals.withColumn("goal", F.trim("goal")).join(same, ["topic", "goal"]).select("grouping", F.concat(F.lit("same goal for "), "topic").alias("problem"))
    return cards.unionByName(tags).unionByName(shared)


def row_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of new that differ from old in any of the columns, null-safe."""
    o = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    same = None
    for c in columns:
        eq = F.col(c).eqNullSafe(F.col(f"_old_{c}"))
        same = eq if same is None else same & eq
    return new.join(o, key).filter(~same)


def outcome_counts(old: DataFrame, new: DataFrame, key: str, columns: list[str], failed: DataFrame | None = None) -> DataFrame:
    """(outcome, n): changed, unchanged, dropped, added; failed for the keys in `failed`, whatever else they are."""
    o = old.select(key, F.struct(*columns).alias("_old"))
    n = new.select(key, F.struct(*columns).alias("_new"))
    out = F.when(F.col("_new").isNull(), "dropped").when(F.col("_old").isNull(), "added").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    j = o.join(n, key, "full_outer")
    if failed is not None:
        j = j.join(failed.select(key, F.lit(True).alias("_failed")).distinct(), key, "left")
        out = F.when(F.col("_failed"), "failed").otherwise(out)
    return j.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


def ratings_by_grouping(old: DataFrame, new: DataFrame) -> DataFrame:
    """(grouping, before, after, dropped): ratings of each grouping, and how many fewer there are."""
    count = lambda df, name: df.groupBy("grouping").agg(F.count("*").alias(name))
    j = count(old, "before").join(count(new, "after"), "grouping", "full_outer").select("grouping", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")])
    return j.withColumn("dropped", F.greatest(F.col("before") - F.col("after"), F.lit(0)))


def rekey_stances(flat: DataFrame, relevant: DataFrame) -> DataFrame:
    """(event, topic, score) copied to each (event, grouping, topic) that is relevant and tracked; the rest drops out."""
    return flat.join(relevant.select("event", "grouping", "topic"), ["event", "topic"]).select("event", "grouping", "topic", "score")


def cleanup_neutrals(nested: DataFrame, column: str = "stances") -> DataFrame:
    """In a map grouping -> topic -> (score, evidence): drops blank neutrals, then empty groupings, then an empty map."""
    inner = F.transform_values(column, lambda _, m: F.map_filter(m, lambda _, r: ~((r["score"] == 0) & (F.coalesce(F.trim(r["evidence"]), F.lit("")) == ""))))
    kept = F.map_filter(inner, lambda _, m: F.size(m) > 0)
    return nested.withColumn(column, F.when(F.size(kept) > 0, kept))


def resync(df: DataFrame, target: str, source: str) -> DataFrame:
    """target takes the values of source where that has any and differs; changed says where."""
    differs = (F.size(source) > 0) & ~F.col(target).eqNullSafe(F.col(source))
    return df.withColumn("changed", F.coalesce(differs, F.lit(False))).withColumn(target, F.when(F.col("changed"), F.col(source)).otherwise(F.col(target)))


def strip_computed(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in fields])


def backfill_provenance(raw: DataFrame, languages: DataFrame, methods: DataFrame, versions: DataFrame, fields: list[str]) -> DataFrame:
    """raw with collection, collection_method and prompt_version where they are missing, in the order of `fields`, of which absent ones are
    left out. languages (source_name, language): native where the language is the row's, else fallback, null for other sources; methods
    (source_name, seeded, method): by source and cohort; versions (prompt_hash, version): an unknown hash stands for itself."""
    j = raw.join(languages, "source_name", "left").join(methods, ["source_name", "seeded"], "left").join(versions, "prompt_hash", "left")
    tier = F.when(F.col("language").isNull(), None).when(F.col("language") == F.col("source_lang"), "native").otherwise("fallback")
    filled = {"collection": F.coalesce("collection", tier), "collection_method": F.coalesce("collection_method", "method"), "prompt_version": F.coalesce("prompt_version", "version", "prompt_hash")}
    return j.withColumns(filled).select(*[f for f in fields if f in raw.columns or f in filled])
