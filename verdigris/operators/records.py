"""Records written to the model: contexts, recipes, insights, batches, artifact paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdigris.operators.upsert import replacement_pairs


def alias(name: Column) -> Column:
    """Framework name without blanks, dashes and underscores, lower-cased."""
    return F.lower(F.regexp_replace(name, r"[\s\-_]", ""))


def minor_zero(version: Column) -> Column:
    """``major.minor.0`` of a dotted version; null without a minor part."""
    p = F.split(version, r"\.")
    return F.when(F.size(p) >= 2, F.concat_ws(".", F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.lit("0")))


def unfenced(text: Column) -> Column:
    """The inside of the first fenced block, else the text from its first brace or heading on."""
    fenced = F.regexp_extract(text, r"(?s)```[a-z]*\n(.*?)\n```", 1)
    tail = F.regexp_extract(text, r"(?s)(?:^|\n)([{#].*)$", 1)
    return F.when(fenced != "", fenced).when(tail != "", tail).otherwise(F.trim(text))


def escaped(query: Column) -> Column:
    """Special characters of a full-text query escaped by a backslash."""
    return F.regexp_replace(query, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")


def zombies(contexts: DataFrame, versions: DataFrame) -> DataFrame:
    """Contexts whose versions are no longer those the catalogue resolves."""
    known = versions.select("framework", F.col("sortable").alias("from_sortable")).distinct()
    return contexts.join(known, ["framework", "from_sortable"], "left_anti")


def detach(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A node or edge table without the deleted keys."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def stub_recipes(steps: DataFrame, recipes: DataFrame) -> DataFrame:
    """Recipes after each automatable step got a stub; a verified recipe is left as it is."""
    stub = steps.where("automatable").select(F.concat(F.lit("stub."), F.col("effort")).alias("recipe_id")).distinct().withColumn("stub", F.lit(True))
    both = recipes.join(stub, "recipe_id", "full_outer")
    verified = F.coalesce(F.col("verified_by") != "", F.lit(False))
    name = F.when(F.col("stub") & ~verified, F.concat(F.lit("Stub for "), "recipe_id")).otherwise(F.col("display_name"))
    return both.select("recipe_id", name.alias("display_name"), "verified_by")


def batch_tables(batches: DataFrame, version: str | None = None) -> dict[str, DataFrame]:
    """Rules, steps, scopes, affected entities, and prerequisite, replacement and lifecycle edges of entity batches, each without repeats.

    A removed entity and a replacement of one kind in one rule are a pair; a
    removed entity is REMOVED_IN ``version``, a replacement INTRODUCED_IN it,
    any other of a deprecation section DEPRECATED_IN it.
    """
    rule = F.substring(F.sha2(F.concat_ws("|", "source_section", "title"), 256), 1, 12)
    b = batches.withColumn("rule_id", rule)
    first = b.groupBy("rule_id").agg(*[F.min(c).alias(c) for c in ("title", "change_type", "source_section")])
    steps = b.select("rule_id", F.explode("steps").alias("s")).select("rule_id", "s.index", "s.effort", "s.automatable").distinct()
    default = F.array(F.struct(F.lit("general").alias("scope"), F.lit("low").alias("severity")))
    scopes = b.select("rule_id", F.explode(F.when(F.coalesce(F.size("scopes"), F.lit(0)) <= 0, default).otherwise(F.col("scopes"))).alias("s")).select("rule_id", "s.scope", "s.severity").distinct()
    entities = b.select("rule_id", "source_section", F.explode("entities").alias("e")).select("rule_id", "source_section", "e.kind", "e.name", "e.role").distinct()
    requires = b.select("rule_id", F.explode("steps").alias("s")).select("rule_id", F.col("s.index").alias("index"), F.explode("s.requires").alias("requires")).distinct()
    known = steps.select("rule_id", F.col("index").alias("requires")).distinct()
    edge = F.when(F.col("role") == "removed", "REMOVED_IN").when(F.col("role") == "replacement", "INTRODUCED_IN").when(F.col("source_section") == "deprecation", "DEPRECATED_IN")
    return {
        "rule": first, "step": steps, "scope": scopes, "affects": entities.drop("source_section"), "requires": requires.join(known, ["rule_id", "requires"], "left_semi"),
        "replaced_by": replacement_pairs(entities), "lifecycle": entities.select("kind", "name", edge.alias("edge"), F.lit(version).alias("version")).where("edge is not null").distinct(),
    }


def submit(insights: DataFrame) -> DataFrame:
    """Ids and defaults of submitted insights; the id is a hash, so a repeated submission is one row."""
    key = F.concat(F.lit("community-"), F.substring(F.md5("statement"), 1, 12))
    return insights.select(key.alias("rule_id"), "statement", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("submitted_by", F.lit("mcp-agent")).alias("submitted_by")).distinct()


def promoted_severity(scopes: Column) -> Column:
    """Severity of the first scope entry that has one."""
    return F.get(F.filter(scopes, lambda s: s["severity"].isNotNull()), F.lit(0))["severity"]


def runs(versions: DataFrame) -> DataFrame:
    """Versions with artifacts, and the version they start from, read off the path."""
    return versions.where("raw_path IS NOT NULL").withColumn("from_version", F.regexp_extract("raw_path", r"-(\d+(?:\.\d+)*)-to-", 1))


def trace(calls: DataFrame, path: str) -> None:
    """Appends tool calls as JSON lines."""
    calls.write.mode("append").json(path)
