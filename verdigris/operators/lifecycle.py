"""Replacement chains, differences of tables and lists of matched names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdigris.lineage import cut


def one_hop(entities: DataFrame, replaced_by: DataFrame) -> DataFrame:
    """Entities with their direct successor and predecessor."""
    after = replaced_by.select(F.col("old_part").alias("p_partkey"), F.col("new_part").alias("replaced_by"))
    before = replaced_by.select(F.col("new_part").alias("p_partkey"), F.col("old_part").alias("replaces"))
    return entities.join(after, "p_partkey", "left").join(before, "p_partkey", "left")


def evolution(replaced_by: DataFrame, hops: int = 5, truncate: bool = False) -> DataFrame:
    """(start, hop, at): chains whose end is reached within ``hops``; with ``truncate`` the first hops of all."""
    edge = replaced_by.select(F.col("old_part").alias("at"), F.col("new_part").alias("next"))
    chain = replaced_by.select(F.col("old_part").alias("start"), F.array("new_part").alias("path"), F.col("new_part").alias("at"))
    for _ in range(hops - 1):
        chain = chain.join(edge, "at", "left").select(
            "start", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"), F.coalesce("next", "at").alias("at")
        )
    if not truncate:
        chain = chain.join(edge.select("at"), "at", "left_anti")
    return chain.select("start", F.posexplode("path").alias("hop", "at")).select("start", (F.col("hop") + 1).alias("hop"), "at")


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of (key, old) and (key, new) that differ."""
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return old.join(new, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", change)


def matched_names(rules: DataFrame, affects: DataFrame, scan: DataFrame) -> DataFrame:
    """(rule_id, matched_entities): scanned names behind a rule's match, sorted.

    Direct names, classes by simple name, artifacts; and, where the rule
    matched, scanned classes under its classes' packages or, without a class
    of its own, under its dependencies' groups.  A group under which nothing
    was scanned stands for the group above it.
    """
    a = cut(affects.join(rules.select("rule_id", "match_count"), "rule_id"))  # read by every way of matching
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    names = scan.select("name").distinct()
    classes = scan.where("bucket = 'classes'").select(F.col("name").alias("found"))
    direct = a.join(names, "name", "left_semi").select("rule_id", F.col("name").alias("found"))
    simple = scan.where("bucket = 'class_simple'").select(F.col("name").alias("simple"))
    by_simple = a.where("kind = 'Class'").withColumn("simple", last("name")).join(simple, "simple", "left_semi").join(classes.withColumn("simple", last("found")), "simple").select("rule_id", "found")
    artifact = scan.where("bucket = 'dep_artifacts'").select(F.col("name").alias("found"))
    by_artifact = a.where("kind = 'Dependency'").withColumn("found", F.get(F.split("name", ":"), F.lit(1))).join(artifact, "found", "left_semi").select("rule_id", "found")
    parts = F.split("found", r"\.")
    under = classes.select("found", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("prefix"))
    hit = a.where("match_count > 0")
    has_class = affects.where("kind = 'Class'").select("rule_id").distinct()
    package = hit.where("kind = 'Class'").select("rule_id", F.substring("name", F.lit(1), F.length("name") - F.length(last("name")) - 1).alias("prefix"))
    group = hit.where("kind = 'Dependency'").join(has_class, "rule_id", "left_anti").select("rule_id", F.get(F.split("name", ":"), F.lit(0)).alias("prefix")).distinct()
    known = under.select("prefix").distinct()
    above = F.when(F.contains("prefix", F.lit(".")), F.substring("prefix", F.lit(1), F.length("prefix") - F.length(last("prefix")) - 1))
    wider = group.join(known, "prefix", "left_anti").select("rule_id", above.alias("prefix"))
    bridged = package.unionByName(group).unionByName(wider).distinct().join(under, "prefix").select("rule_id", "found")
    every = direct.unionByName(by_simple).unionByName(by_artifact).unionByName(bridged)
    return every.groupBy("rule_id").agg(F.array_join(F.sort_array(F.collect_set("found")), ",").alias("matched_entities"))


def lifecycle_edges(roles: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, name, framework, edge, sortable): removed, introduced and deprecated entities by version.

    ``roles``: (rule_id, kind, name, role); ``rules``: (rule_id, framework,
    sortable, rule_type).  A removed entity is REMOVED_IN, a replacement
    INTRODUCED_IN, any other of a deprecation rule DEPRECATED_IN the version.
    """
    edge = (
        F.when(F.col("role") == "removed", "REMOVED_IN")
        .when(F.col("role") == "replacement", "INTRODUCED_IN")
        .when(F.col("rule_type") == "deprecation", "DEPRECATED_IN")
    )
    return roles.join(rules, "rule_id").select("kind", "name", "framework", edge.alias("edge"), "sortable").where("edge is not null").distinct()


def deprecations(edges: DataFrame, replaced: DataFrame) -> DataFrame:
    """Per entity and framework the first version that deprecates (else introduces) and removes it, and its successors.

    ``replaced``: (kind, old_name, new_name).  Only entities that a rule of the
    framework reaches have an edge, so the semi-join on rules is the edge table.
    """
    first = lambda e: F.min(F.when(F.col("edge") == e, F.col("sortable")))
    per = edges.groupBy("kind", "name", "framework").agg(
        F.coalesce(first("DEPRECATED_IN"), first("INTRODUCED_IN")).alias("deprecated_in"), first("REMOVED_IN").alias("removed_in")
    )
    successor = replaced.groupBy("kind", F.col("old_name").alias("name")).agg(F.min("new_name").alias("replaced_by"), F.count_distinct("new_name").alias("successors"))
    return per.join(successor, ["kind", "name"], "left").select("kind", "name", "framework", "deprecated_in", "removed_in", "replaced_by", F.coalesce("successors", F.lit(0).cast("long")).alias("successors"))
