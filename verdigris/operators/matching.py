"""Which rules a scanned code base is affected by."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdigris.functions import exprs


def normalise(names: DataFrame, name: str = "name") -> DataFrame:
    """(bucket, name) of flat scanned names; coordinates also give their artifact."""
    n = F.col(name)
    parts = F.split(n, ":")
    ga = F.concat_ws(":", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    found = F.when(
        F.contains(n, F.lit(":")),
        F.array(F.struct(F.lit("deps_ga").alias("bucket"), ga.alias("name")), F.struct(F.lit("dep_artifacts").alias("bucket"), F.get(parts, F.lit(1)).alias("name"))),
    ).otherwise(F.array(F.struct(exprs.bucket(n).alias("bucket"), n.alias("name"))))
    return names.where(n != "").select(F.explode(found).alias("f")).select("f.*").distinct()


def class_prefixes(scan: DataFrame) -> DataFrame:
    """Every dotted prefix of the scanned classes: a prefix test becomes an equi-join."""
    parts = F.split("name", r"\.")
    return (
        scan.where("bucket = 'classes'")
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("prefix"))
        .distinct()
    )


def entity_hits(entities: DataFrame, scan: DataFrame) -> DataFrame:
    """(kind, name) with direct, group and package hits, of the entities that have any.

    direct: the name itself, a class's simple name, or a dependency's
    coordinates or artifact was scanned.  group: a scanned class lies under
    the dependency's group.  package: one lies under the class's package.
    """
    e = entities.select("kind", "name").distinct()
    coords = F.split("name", ":")
    last = F.element_at(F.split("name", r"\."), -1)
    keys = F.when(F.col("kind") == "Class", F.array(F.concat(F.lit("classes|"), F.col("name")), F.concat(F.lit("class_simple|"), last))).when(
        F.col("kind") == "ApplicationProperty", F.array(F.concat(F.lit("props|"), F.col("name")))
    ).otherwise(
        F.array(
            F.when(F.size(coords) >= 2, F.concat(F.lit("deps_ga|"), F.get(coords, F.lit(0)), F.lit(":"), F.get(coords, F.lit(1)))),
            F.concat(F.lit("dep_artifacts|"), F.element_at(coords, -1)),
        )
    )
    found = scan.select(F.concat_ws("|", "bucket", "name").alias("key"))
    direct = e.select("kind", "name", F.explode(keys).alias("key")).join(found, "key", "left_semi").select("kind", "name").distinct().withColumn("direct", F.lit(True))
    prefix = F.when(F.col("kind") == "Class", F.substring("name", F.lit(1), F.length("name") - F.length(last) - 1)).when(
        (F.col("kind") == "Dependency") & (F.size(coords) >= 2), F.get(coords, F.lit(0))
    )
    under = e.withColumn("prefix", prefix).join(class_prefixes(scan), "prefix", "left_semi").select("kind", "name").distinct().withColumn("under", F.lit(True))
    off = F.lit(False)
    return direct.join(under, ["kind", "name"], "full_outer").select(
        "kind", "name", F.coalesce("direct", off).alias("direct"),
        (F.coalesce("under", off) & (F.col("kind") == "Dependency")).alias("under_group"),
        (F.coalesce("under", off) & (F.col("kind") == "Class")).alias("under_package"),
    )


def applicable(rules: DataFrame, affects: DataFrame, scan: DataFrame, package_bridge: bool = False, forced: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Rules with affected_count, match_count, severity_rank and applicability.

    A dependency also matches by its group, if the rule affects no class; with
    ``package_bridge`` all of a rule's dependencies match where a scanned class
    lies in the package of one of the rule's classes.  ``forced``: names that
    make a rule matched.  ``entities``: a table of all (kind, name), which spares
    reading the edges for them.  Edges are aggregated per rule before the join.
    """
    hits = entity_hits(affects if entities is None else entities, scan)
    flags = ("direct", "under_group", "under_package")
    # what was scanned is few beside the edges: the left join lets the edges stay where they are
    edges = affects.join(rules.select("rule_id"), "rule_id", "left_semi").join(hits, ["kind", "name"], "left")
    edges = edges.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    if forced is not None:
        edges = edges.join(forced.select("name", F.lit(1).alias("forced")), "name", "left")
    else:
        edges = edges.withColumn("forced", F.lit(None).cast("int"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    dep = F.col("kind") == "Dependency"
    per_rule = edges.groupBy("rule_id").agg(
        F.count("*").alias("affected_count"),
        one(F.col("direct")).alias("n_direct"),
        one(dep & ~F.col("direct")).alias("n_other"),
        one(F.col("under_group") & ~F.col("direct")).alias("n_group"),
        F.max(F.col("kind") == "Class").alias("has_class"),
        F.max("under_package").alias("in_package"),
        F.coalesce(F.sum("forced"), F.lit(0)).alias("n_forced"),
    )
    bridged = F.when(~F.col("has_class"), F.col("n_group")).otherwise(0)
    if package_bridge:
        bridged = F.when(F.col("in_package"), F.col("n_other")).otherwise(bridged)
    zero = F.lit(0).cast("long")
    scanned = scan.agg((F.count("*") > 0).alias("scanned"))
    return (
        rules.join(per_rule, "rule_id", "left")
        .crossJoin(F.broadcast(scanned))  # one row
        .withColumn("affected_count", F.coalesce("affected_count", zero))
        .withColumn("match_count", F.coalesce(F.col("n_direct") + bridged, zero))
        .withColumn("severity_rank", exprs.severity_rank(F.col("severity")))
        .withColumn(
            "applicability",
            exprs.applicability(F.col("affected_count"), F.col("match_count"), F.col("severity_rank"), F.col("scanned"), F.coalesce("n_forced", zero) if forced is not None else None),
        )
        .select(*rules.columns, "affected_count", "match_count", "severity_rank", "applicability")
    )
