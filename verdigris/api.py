"""What a caller asks for in one step, composed of the operators; every answer is a DataFrame or a few of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from verdigris.functions import exprs
from verdigris.operators import context, matching, search, versions
from verdigris.sources.graph import Graph


@dataclass(frozen=True)
class Path:
    """A range of versions of a framework: from ``low`` (exclusive) to ``high`` (inclusive)."""

    framework: str
    low: int
    high: int


def resolved_path(g: Graph, framework: str, low: int, high: int) -> Path:
    """The path between the catalogue's versions: the highest at or below ``low``, the lowest at or above ``high``, else the highest of all."""
    asked = g.spark.createDataFrame([(0, framework, low), (1, framework, high)], "request_id long, framework string, requested long")
    ends = [versions.resolve(asked.where(F.col("request_id") == i), g.version, how).first() for i, how in enumerate(("floor", "ceil"))]  # one row each
    if ends[1] is None or ends[1].resolved is None:
        raise ValueError(f"no versions of {framework}")
    return Path(framework, low if ends[0].resolved is None else ends[0].resolved, ends[1].resolved)


def _rules(g: Graph, path: Path, names: DataFrame, classification: list[str], scopes: list[str], least: str | None, **how) -> DataFrame:
    rules = versions.classified(versions.in_range(g.rule.where(F.col("framework") == path.framework), path.low, path.high), classification)
    if scopes:
        rules = rules.where(F.col("scope").isin(scopes))
    rules = rules.where(exprs.at_least(F.col("severity"), least))
    return matching.applicable(rules, g.affects, matching.normalise(names), entities=g.part_entity, **how)


def analyze_upgrade_path(g: Graph, path: Path, names: DataFrame, classification: list[str] = (), scopes: list[str] = (), least: str | None = None, top_n: int = 50) -> dict[str, DataFrame]:
    """``rules``, the ranked report capped at ``top_n``, and ``diagnostics``, one row about what it leaves out."""
    rules = _rules(g, path, names, list(classification), list(scopes), least)
    kept = rules.where("applicability <> 'excluded'")
    order = [exprs.lookup(F.col("applicability"), exprs.APPLICABILITY_RANK, 3), F.col("severity_rank"), F.col("sortable"), F.col("rule_id")]
    counts = rules.agg(
        F.count_if(F.col("applicability") != "excluded").alias("rules_included"),
        F.count_if(F.col("applicability") == "excluded").alias("rules_excluded_by_entity_filter"),
        F.count_if(F.col("applicability") == "uncertain").alias("rules_via_safety_net"),
    )
    scanned = names.agg(F.count_distinct("name").alias("scanned_total"))
    diagnostics = counts.crossJoin(scanned).withColumn("rules_capped_at", F.when(F.col("rules_included") > top_n, F.lit(top_n)))  # one row each
    return {"rules": context.cap(kept, top_n, order), "diagnostics": diagnostics}


def build_recipe_plan(g: Graph, path: Path, names: DataFrame, scopes: list[str] = (), least: str | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Steps in the automated and the manual track with their executor; rule cards, if no rule of the plan has a step."""
    steps = g.step if steps is None else steps
    rules = _rules(g, path, names, [], list(scopes), least, package_bridge=True).where("applicability <> 'excluded'")
    met = steps.join(rules.select("rule_id", "applicability", "match_count"), "rule_id")
    auto = F.coalesce(F.col("automatable") & (F.col("effort") == "mechanical") & F.col("recipe_id").isNotNull() & F.col("auto") & ~F.col("missing_params"), F.lit(False))
    who = exprs.executor(F.col("recipe_id"), F.col("auto"), F.col("missing_params"), F.col("effort"), F.col("instruction"), F.col("applicability"))
    rows = met.select("rule_id", "step_id", F.when(auto, "automated").otherwise("manual").alias("track"), who.alias("executor"), F.lit(None).cast("string").alias("blocked_reason"), "applicability")
    none = met.agg((F.count("*") == 0).alias("stepless"))
    cards = rules.crossJoin(F.broadcast(none)).where("stepless")  # one row
    return rows.unionByName(
        cards.select("rule_id", F.lit(None).cast(steps.schema["step_id"].dataType).alias("step_id"), F.lit("manual").alias("track"), F.lit("human-review").alias("executor"), F.lit("no_migration_steps").alias("blocked_reason"), "applicability")
    )


def steps_for_scope_tier(g: Graph, path: Path, names: DataFrame, scope: str, least: str = "medium") -> dict[str, DataFrame]:
    """Scanned entities, steps and rules of one scope at a severity or above: ``hits``, and ``summary`` with the distinct counts."""
    if least not in exprs.THRESHOLD_RANK:
        raise ValueError(f"severity threshold must be one of {', '.join(sorted(exprs.THRESHOLD_RANK))}")
    rules = versions.in_range(g.rule.where(F.col("framework") == path.framework), path.low, path.high).where((F.col("scope") == scope) & exprs.at_least(F.col("severity"), least))
    hit = g.affects.join(names.select("name").distinct(), "name", "left_semi").join(rules.select("rule_id", "scope", "severity"), "rule_id")
    hits = hit.join(g.step.select("step_id", "rule_id"), "rule_id").select(F.col("name").alias("entity_name"), F.col("kind").alias("entity_type"), "step_id", "rule_id", "scope", "severity").distinct()
    return {"hits": hits, "summary": hits.agg(F.count_distinct("entity_name").alias("entities"), F.count_distinct("rule_id").alias("rule_count"), F.count("*").alias("total"))}


def search_knowledge(docs: DataFrame, vectors: DataFrame, terms: list[str], query: DataFrame, k: int = 50, results: int = 5, least: float = 0.3) -> DataFrame:
    """The best documents (id, text) by BM25 and by vectors (id, embedding), fused; ``query`` is one row with an embedding."""
    fused = search.fuse([search.bm25(docs, terms, k), search.nearest(vectors, query, k, least)])
    return fused.orderBy(F.desc("score"), "first_list", "first_rank").limit(results).join(docs.select("id"), "id", "left_semi")
