"""Idempotent writes: each gives the table as it is after the write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep_first: list[str] = ()) -> DataFrame:
    """Rows by key: incoming values win, those of ``keep_first`` only where nothing was set."""
    rest = [c for c in incoming.columns if c not in keys]
    new = incoming.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rest], F.lit(True).alias("__hit"))
    joined = existing.join(new, keys, "full_outer")
    hit = F.coalesce("__hit", F.lit(False))
    value = lambda c: F.coalesce(c, f"__new_{c}") if c in keep_first else F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c))
    return joined.select(*keys, *[(value(c).alias(c) if c in rest else F.col(c)) for c in existing.columns if c not in keys])


def with_default_scope(rules: DataFrame) -> DataFrame:
    """(rule_id, scope, severity), (general, low) for rules without any."""
    empty = F.col("scopes").isNull() | (F.size("scopes") == 0)
    default = F.array(F.struct(F.lit("general").alias("scope"), F.lit("low").alias("severity")))
    return rules.select("rule_id", F.explode(F.when(empty, default).otherwise(F.col("scopes"))).alias("s")).select("rule_id", "s.scope", "s.severity").distinct()


def replacement_pairs(edges: DataFrame) -> DataFrame:
    """(kind, old_name, new_name): removed and replacing entities of one rule and kind."""
    by_role = edges.where(F.col("role").isin("removed", "replacement")).groupBy("rule_id", "kind").agg(
        F.collect_set(F.when(F.col("role") == "removed", F.col("name"))).alias("old"), F.collect_set(F.when(F.col("role") == "replacement", F.col("name"))).alias("new")
    )
    return by_role.select("kind", F.explode("old").alias("old_name"), "new").select("kind", "old_name", F.explode("new").alias("new_name")).where("old_name <> new_name").distinct()


def votes(insights: DataFrame, events: DataFrame) -> DataFrame:
    """Insights with the sum of their vote events."""
    total = events.groupBy("insight_id").agg(F.sum("delta").alias("votes"), F.max("verify").alias("by_event"))
    return insights.join(total, "insight_id", "left").select(
        *[c for c in insights.columns if c != "verified"],
        F.coalesce("votes", F.lit(0).cast("long")).alias("votes"),
        (F.col("verified") | F.coalesce("by_event", F.lit(False))).alias("verified"),
    )


def key_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on more than one row, with their number: none after a sound write."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
