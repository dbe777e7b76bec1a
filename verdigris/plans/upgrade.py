"""Upgrade-path queries: applicability, plans, versions, routing, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris import api
from verdigris.functions import exprs
from verdigris.lineage import cut
from verdigris.operators import context, lifecycle, matching, upsert, versions
from verdigris.plans.base_sql import BASE
from verdigris.sources.graph import Graph

FRAMEWORK, LOW, HIGH, TOP_N = "ASIA", 5006000, 7006000, 50


def _path(g: Graph) -> DataFrame:
    return versions.in_range(g.rule.where(F.col("framework") == FRAMEWORK), LOW, HIGH)


def _applied(g: Graph, **how) -> DataFrame:
    path = cut(_path(g))
    return matching.applicable(path, g.affects_of(path), matching.normalise(g.scan_names), entities=g.part_entity, **how)


def upgrade_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on a version path, with how they apply to the scanned code base."""
    return _applied(Graph(spark, sf_dir)).select("rule_id", "framework", "sortable", "classification", "severity", "affected_count", "match_count", "applicability")


def upgrade_path_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one classification; unclassified rules pass."""
    return versions.classified(_applied(Graph(spark, sf_dir)), ["actionable"]).select("rule_id", "classification", "applicability")


def upgrade_path_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per version with its rules and entities as sorted lists."""
    g = Graph(spark, sf_dir)
    rules = _path(g)
    names = g.affects.join(rules.select("rule_id", "sortable"), "rule_id").groupBy("sortable").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("entities"))
    lists = rules.groupBy("sortable").agg(
        F.count("*").alias("rule_count"),
        F.array_join(F.transform(F.sort_array(F.collect_set("rule_id")), lambda x: x.cast("string")), ",").alias("rules"),
        F.array_join(F.sort_array(F.collect_set("severity")), ",").alias("severities"),
    )
    return lists.join(names, "sortable", "left").join(g.version.where(F.col("framework") == FRAMEWORK).select("sortable", "version"), "sortable")


def _ranked_order() -> list:
    return [exprs.lookup(F.col("applicability"), exprs.APPLICABILITY_RANK, 3), F.col("severity_rank"), F.col("sortable"), F.col("rule_id")]


def upgrade_path_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked report, capped (the cap is its feature)."""
    rows = _applied(Graph(spark, sf_dir)).where("applicability <> 'excluded'")
    return context.cap(rows, TOP_N, _ranked_order()).select("rank", "rule_id", "applicability", "severity_rank")


def upgrade_path_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules were included and excluded, and whether the report was capped."""
    g = Graph(spark, sf_dir)
    counts = _applied(g).agg(
        *[F.count_if(F.col("applicability") == a).alias(a) for a in ("matched", "uncertain", "informational", "excluded")],
        F.count_if(F.col("applicability") != "excluded").alias("rules_included"),
    )
    scanned = g.scan_names.agg(F.count("*").alias("scanned_total"))
    return counts.crossJoin(scanned).withColumn("rules_capped_at", F.when(F.col("rules_included") > TOP_N, F.lit(TOP_N)))  # one row each


def recipe_plan_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the plan in the automatic and the manual track."""
    g = Graph(spark, sf_dir)
    rules = _applied(g, package_bridge=True).where("applicability <> 'excluded'")
    auto = F.coalesce(F.col("automatable") & (F.col("effort") == "mechanical") & F.col("recipe_id").isNotNull() & F.col("auto") & ~F.col("missing_params"), F.lit(False))
    return g.step.join(rules.select("rule_id", "applicability", "match_count"), "rule_id").select(
        "step_id", "rule_id", "effort", "applicability", "match_count", F.when(auto, "automated").otherwise("manual").alias("track")
    )


def recipe_plan_rule_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of every framework's plan: its rules, where none of them has a step, else none.

    The steps of one framework are held back, so that its plan falls back.
    """
    g = Graph(spark, sf_dir)
    path = versions.in_range(g.rule, LOW, HIGH)
    rules = matching.applicable(path, g.affects, matching.normalise(g.scan_names), package_bridge=True, entities=g.part_entity).where("applicability <> 'excluded'")
    written = g.step.join(g.rule.where("framework <> 'AFRICA'").select("rule_id"), "rule_id", "left_semi")
    return rule_cards(rules, written, ["framework"]).select("framework", "rule_id", "rule_type", "applicability")


def rule_cards(rules: DataFrame, steps: DataFrame, plan: list[str]) -> DataFrame:
    """Rules of the plans in which no rule has a step: a plan with any step gives no card, not even for stepless rules."""
    with_steps = rules.join(steps.select("rule_id"), "rule_id", "left_semi").select(*plan).distinct()
    return rules.join(with_steps, plan, "left_anti")


def recipe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole plan of rules of one scope at a severity or above: tracks and executors of its steps."""
    g = Graph(spark, sf_dir)
    return api.build_recipe_plan(g, api.resolved_path(g, FRAMEWORK, LOW + 500, HIGH - 500), g.scan_names, scopes=["api", "config"], least="medium")


def path_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the capped report of one scope leaves out."""
    g = Graph(spark, sf_dir)
    return api.analyze_upgrade_path(g, api.resolved_path(g, FRAMEWORK, LOW + 500, HIGH - 500), g.scan_names, scopes=["api"], top_n=10)["diagnostics"]


def scope_tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct entities and rules of one scope tier."""
    g = Graph(spark, sf_dir)
    return api.steps_for_scope_tier(g, api.Path(FRAMEWORK, LOW, HIGH), g.scan_names, "api")["summary"]


def executor_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executor of every step of the plan."""
    g = Graph(spark, sf_dir)
    rules = _applied(g, package_bridge=True)
    track = exprs.executor(F.col("recipe_id"), F.col("auto"), F.col("missing_params"), F.col("effort"), F.col("instruction"), F.col("applicability"))
    return g.step.join(rules.select("rule_id", "applicability"), "rule_id").select("step_id", track.alias("executor"))


def concrete_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).step.select("step_id", exprs.is_concrete(F.col("instruction")).alias("concrete"))


def _requests(g: Graph) -> DataFrame:
    """One request per customer, some below, between and above the known versions."""
    k = F.col("c_custkey")
    return g.customers.select(k.alias("request_id"), "framework", ((k * 37 % 13) * 1000000 + (k * 11 % 14) * 1000 + k % 2 * 500).cast("long").alias("requested"))


def _resolver(direction: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = Graph(spark, sf_dir)
        return versions.resolve(_requests(g), g.version, direction)

    return query


def version_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.hops(Graph(spark, sf_dir).version)


def scope_severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with one scope entry that has both the scope and the severity."""
    rules = Graph(spark, sf_dir).rule
    entries = F.array(F.struct(F.col("scope").alias("scope"), F.col("severity").alias("severity")), F.struct(F.lit("general").alias("scope"), F.lit("low").alias("severity")))
    fits = F.exists(entries, lambda s: (s["scope"].isin("api", "config")) & exprs.at_least(s["severity"], "high"))
    return rules.where(fits).select("rule_id", "scope", "severity")


def scope_tier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned entities, steps and rules of one scope at a severity or above."""
    g = Graph(spark, sf_dir)
    rules = _path(g).where((F.col("scope") == "api") & exprs.at_least(F.col("severity"), "medium"))
    hit = g.affects.join(g.scan_names, "name", "left_semi").join(rules.select("rule_id", "scope", "severity"), "rule_id")
    return hit.join(g.step.select("step_id", "rule_id"), "rule_id").select(F.col("name").alias("entity_name"), F.col("kind").alias("entity_type"), "step_id", "rule_id", "scope", "severity").distinct()


def normalize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.normalise(Graph(spark, sf_dir).scan_names)


def matched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned names that the rules of the path matched, as a sorted list per rule."""
    g = Graph(spark, sf_dir)
    scan, path = cut(matching.normalise(g.scan_names)), cut(_path(g))
    affects = g.affects_of(path)
    rules = matching.applicable(path, affects, scan, package_bridge=True, entities=g.part_entity)
    return lifecycle.matched_names(rules, affects, scan)


def entity_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actionable with steps, incomplete with entities only, else informational."""
    g = Graph(spark, sf_dir)
    steps = g.step.groupBy("rule_id").agg(F.count("*").alias("steps"))
    entities = g.affects.groupBy("rule_id").agg(F.count("*").alias("entities"))
    zero = F.lit(0).cast("long")
    rows = g.rule.select("rule_id").join(steps, "rule_id", "left").join(entities, "rule_id", "left").select("rule_id", F.coalesce("steps", zero).alias("steps"), F.coalesce("entities", zero).alias("entities"))
    return rows.withColumn("classification", F.when(F.col("steps") > 0, "actionable").when(F.col("entities") > 0, "incomplete").otherwise("informational"))


def rule_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules per type of their source section."""
    names = list(exprs.RULE_TYPES)
    section = F.get(F.array(*map(F.lit, names)), (F.col("rule_id") % len(names)).cast("int"))
    return Graph(spark, sf_dir).rule.select("rule_id", section.alias("section")).withColumn("rule_type", exprs.rule_type(F.col("section"))).groupBy("section", "rule_type").agg(F.count("*").alias("rules"))


def priority_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the path per priority class, zero rows included."""
    levels = spark.createDataFrame([("Breaking",), ("Mandatory",), ("Behavioral+Deprecation",), ("New",)], "level string")
    level = F.when(F.col("rule_type") == "breaking", "Breaking").when(F.col("rule_type") == "mandatory_migration", "Mandatory").otherwise("Behavioral+Deprecation")
    found = _path(Graph(spark, sf_dir)).groupBy(level.alias("level")).agg(F.count("*").alias("rules"))
    return levels.join(found, "level", "left").select("level", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"))


def replacement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.replacement_pairs(Graph(spark, sf_dir).role_edge)


def step_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.prerequisites(Graph(spark, sf_dir).step)


def deprecation_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity with its direct successor and predecessor."""
    g = Graph(spark, sf_dir)
    return lifecycle.one_hop(g.part_entity.select("p_partkey", "name"), g.replaced_by)


def entity_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of successors that end within five hops."""
    return lifecycle.evolution(Graph(spark, sf_dir).replaced_by, 5)


def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).rule.agg(
        F.count("*").alias("rules"), F.count("classification").alias("with_classification"), F.count("severity").alias("with_severity")
    )


def bom_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts as two bills of materials: added, changed, removed."""
    g = Graph(spark, sf_dir)
    p = g.table("part").select("p_partkey", "p_retailprice")
    k = F.col("p_partkey")
    old = p.where(k % 5 != 0).select(k.alias("part"), F.col("p_retailprice").alias("old"))
    new = p.where(k % 7 != 0).select(k.alias("part"), (F.col("p_retailprice") + F.when(k % 3 == 0, 1.0).otherwise(0.0)).alias("new"))
    return lifecycle.diff(old, new, "part")


QUERIES = {
    "upgrade_path_rules": upgrade_path_rules,
    "upgrade_path_classified": upgrade_path_classified,
    "upgrade_path_by_version": upgrade_path_by_version,
    "upgrade_path_top_n": upgrade_path_top_n,
    "upgrade_path_diagnostics": upgrade_path_diagnostics,
    "recipe_plan_tracks": recipe_plan_tracks,
    "recipe_plan_rule_cards": recipe_plan_rule_cards,
    "executor_routing": executor_routing,
    "recipe_plan": recipe_plan,
    "path_diagnostics": path_diagnostics,
    "scope_tier_summary": scope_tier_summary,
    "concrete_instruction": concrete_instruction,
    "resolve_version_exact": _resolver("exact"),
    "resolve_version_floor": _resolver("floor"),
    "resolve_version_ceil": _resolver("ceil"),
    "version_hops": version_hops,
    "scope_severity_filter": scope_severity_filter,
    "scope_tier_hits": scope_tier_hits,
    "normalize_entities": normalize_entities,
    "matched_entities": matched_entities,
    "entity_classification": entity_classification,
    "rule_type_map": rule_type_map,
    "priority_summary": priority_summary,
    "replacement_pairs": replacement_pairs,
    "step_prerequisites": step_prerequisites,
    "deprecation_one_hop": deprecation_one_hop,
    "entity_evolution": entity_evolution,
    "null_audit": null_audit,
    "bom_diff": bom_diff,
}

_REQUESTS = ", requests AS (SELECT c_custkey AS request_id, framework, CAST((c_custkey * 37 % 13) * 1000000 + (c_custkey * 11 % 14) * 1000 + c_custkey % 2 * 500 AS BIGINT) AS requested FROM customers)"


def _resolve_sql(resolved: str, ahead: str = "false") -> str:
    return BASE + _REQUESTS + f""", met AS (
  SELECT request_id, r.framework, requested, max(sortable) FILTER (sortable <= requested) AS below, min(sortable) FILTER (sortable >= requested) AS above, max(sortable) AS top
  FROM requests r LEFT JOIN version v ON r.framework = v.framework GROUP BY 1, 2, 3)
SELECT request_id, framework, requested, {resolved} AS resolved, coalesce({resolved} <> requested, false) AS rounded, {ahead} AS ahead_of_catalogue FROM met"""


_CONCRETE = r"""(trim(instruction) <> '' AND (regexp_matches(instruction, '(?i)\brename\b.+\bto\b') OR regexp_matches(instruction, '(?i)\breplace\b.+\bwith\b')
  OR regexp_matches(instruction, '(?i)\bremove\b.+\b(import|class|method|annotation)\b') OR regexp_matches(instruction, '(?i)\badd\b.+\bto\b')
  OR regexp_matches(instruction, '(?i)(before|after)\s*[:\->]') OR regexp_matches(instruction, '→|->|=>')))"""

ORACLES = {
    "upgrade_path_rules": BASE + "SELECT rule_id, framework, sortable, classification, severity, affected_count, match_count, applicability FROM path",
    "upgrade_path_classified": BASE + "SELECT rule_id, classification, applicability FROM path WHERE classification IS NULL OR classification = 'actionable'",
    "upgrade_path_by_version": BASE + """, l AS (
  SELECT sortable, count(*) AS rule_count, string_agg(CAST(rule_id AS VARCHAR), ',' ORDER BY rule_id) AS rules, coalesce(string_agg(DISTINCT severity, ',' ORDER BY severity), '') AS severities FROM path GROUP BY 1),
n AS (SELECT sortable, string_agg(DISTINCT name, ',' ORDER BY name) AS entities FROM affects JOIN path USING (rule_id) GROUP BY 1)
SELECT l.*, entities, version FROM l LEFT JOIN n USING (sortable) JOIN version v ON v.sortable = l.sortable AND v.framework = 'ASIA'""",
    "upgrade_path_top_n": BASE + """, o AS (
  SELECT *, row_number() OVER (ORDER BY CASE applicability WHEN 'uncertain' THEN 0 WHEN 'matched' THEN 1 ELSE 2 END, severity_rank, sortable, rule_id) AS rn FROM path WHERE applicability <> 'excluded')
SELECT CAST(rn AS INTEGER) AS rank, rule_id, applicability, severity_rank FROM o WHERE rn <= 50""",
    "upgrade_path_diagnostics": BASE + """SELECT count(*) FILTER (applicability = 'matched') AS matched, count(*) FILTER (applicability = 'uncertain') AS uncertain,
  count(*) FILTER (applicability = 'informational') AS informational, count(*) FILTER (applicability = 'excluded') AS excluded, count(*) FILTER (applicability <> 'excluded') AS rules_included,
  (SELECT count(*) FROM scan_names) AS scanned_total, CAST(CASE WHEN count(*) FILTER (applicability <> 'excluded') > 50 THEN 50 END AS INTEGER) AS rules_capped_at FROM path""",
    "recipe_plan_tracks": BASE + """SELECT step_id, s.rule_id, effort, plan_applicability AS applicability, plan_match_count AS match_count,
  CASE WHEN automatable AND effort = 'mechanical' AND recipe_id IS NOT NULL AND auto AND NOT missing_params THEN 'automated' ELSE 'manual' END AS track
FROM step s JOIN path p ON s.rule_id = p.rule_id WHERE plan_applicability <> 'excluded'""",
    "recipe_plan_rule_cards": BASE + """SELECT framework, rule_id, rule_type, plan_applicability AS applicability FROM applied a WHERE sortable > 5006000 AND sortable <= 7006000 AND plan_applicability <> 'excluded'
AND NOT EXISTS (FROM applied b JOIN step s ON s.rule_id = b.rule_id WHERE b.framework = a.framework AND b.framework <> 'AFRICA' AND b.sortable > 5006000 AND b.sortable <= 7006000 AND b.plan_applicability <> 'excluded')""",
    "executor_routing": BASE + f"""SELECT step_id, CASE WHEN recipe_id IS NOT NULL AND auto AND NOT coalesce(missing_params, false) THEN 'openrewrite' WHEN recipe_id IS NOT NULL AND (NOT auto OR coalesce(missing_params, false)) THEN 'prompted-auto'
  WHEN effort IN ('mechanical', 'moderate') AND {_CONCRETE} AND plan_applicability = 'matched' THEN 'agent-codemod' ELSE 'human-review' END AS executor FROM step s JOIN path p ON s.rule_id = p.rule_id""",
    "recipe_plan": BASE + f"""SELECT p.rule_id, step_id, CASE WHEN automatable AND effort = 'mechanical' AND recipe_id IS NOT NULL AND auto AND NOT missing_params THEN 'automated' ELSE 'manual' END AS track,
  CASE WHEN recipe_id IS NOT NULL AND auto AND NOT coalesce(missing_params, false) THEN 'openrewrite' WHEN recipe_id IS NOT NULL AND (NOT auto OR coalesce(missing_params, false)) THEN 'prompted-auto'
  WHEN effort IN ('mechanical', 'moderate') AND {_CONCRETE} AND plan_applicability = 'matched' THEN 'agent-codemod' ELSE 'human-review' END AS executor, CAST(NULL AS VARCHAR) AS blocked_reason, plan_applicability AS applicability
FROM step s JOIN path p ON s.rule_id = p.rule_id WHERE plan_applicability <> 'excluded' AND scope IN ('api', 'config') AND severity IN ('medium', 'high', 'critical')""",
    "path_diagnostics": BASE + """SELECT count(*) FILTER (applicability <> 'excluded') AS rules_included, count(*) FILTER (applicability = 'excluded') AS rules_excluded_by_entity_filter, count(*) FILTER (applicability = 'uncertain') AS rules_via_safety_net,
  (SELECT count(*) FROM scan_names) AS scanned_total, CAST(CASE WHEN count(*) FILTER (applicability <> 'excluded') > 10 THEN 10 END AS INTEGER) AS rules_capped_at FROM path WHERE scope = 'api'""",
    "scope_tier_summary": BASE + """, h AS (SELECT DISTINCT name, kind, step_id, p.rule_id, scope, severity FROM path p JOIN affects a ON a.rule_id = p.rule_id JOIN step s ON s.rule_id = p.rule_id
  WHERE scope = 'api' AND severity IN ('medium', 'high', 'critical') AND name IN (FROM scan_names))
SELECT count(DISTINCT name) AS entities, count(DISTINCT rule_id) AS rule_count, count(*) AS total FROM h""",
    "concrete_instruction": BASE + f"SELECT step_id, {_CONCRETE} AS concrete FROM step",
    "resolve_version_exact": _resolve_sql("CASE WHEN above = requested THEN above END"),
    "resolve_version_floor": _resolve_sql("below"),
    "resolve_version_ceil": _resolve_sql("coalesce(above, top)", "above IS NULL AND top IS NOT NULL"),
    "version_hops": BASE + "SELECT * FROM (SELECT framework, sortable AS hop_from, lead(sortable) OVER (PARTITION BY framework ORDER BY sortable) AS hop_to FROM version) WHERE hop_to IS NOT NULL",
    "scope_severity_filter": BASE + "SELECT rule_id, scope, severity FROM rule WHERE scope IN ('api', 'config') AND severity IN ('high', 'critical')",
    "scope_tier_hits": BASE + """SELECT DISTINCT name AS entity_name, kind AS entity_type, step_id, p.rule_id, scope, severity FROM path p JOIN affects a ON a.rule_id = p.rule_id JOIN step s ON s.rule_id = p.rule_id
WHERE scope = 'api' AND severity IN ('medium', 'high', 'critical') AND name IN (FROM scan_names)""",
    "normalize_entities": BASE + "SELECT bucket, name FROM scan",
    "matched_entities": BASE + """, a AS (SELECT p.rule_id, plan_match_count, has_class, kind, name FROM path p JOIN affects USING (rule_id) JOIN per_rule USING (rule_id)),
m AS (
  SELECT rule_id, a.name AS found FROM a JOIN scan s ON s.name = a.name
  UNION SELECT rule_id, c.name FROM a JOIN scan s ON s.bucket = 'class_simple' AND string_split(a.name, '.')[-1] = s.name JOIN classes c ON string_split(c.name, '.')[-1] = s.name WHERE kind = 'Class'
  UNION SELECT rule_id, s.name FROM a JOIN scan s ON s.bucket = 'dep_artifacts' AND split_part(a.name, ':', 2) = s.name WHERE kind = 'Dependency'
  UNION SELECT rule_id, c.name FROM a JOIN classes c ON starts_with(c.name, left(a.name, length(a.name) - length(string_split(a.name, '.')[-1]))) WHERE kind = 'Class' AND plan_match_count > 0
  UNION SELECT rule_id, c.name FROM a JOIN classes c ON starts_with(c.name, split_part(a.name, ':', 1) || '.') WHERE kind = 'Dependency' AND NOT has_class AND plan_match_count > 0
  UNION SELECT rule_id, c.name FROM a JOIN classes c ON starts_with(c.name, regexp_replace(split_part(a.name, ':', 1), '\\.[^.]*$', '') || '.') WHERE kind = 'Dependency' AND NOT has_class AND plan_match_count > 0
    AND NOT EXISTS (FROM classes k WHERE starts_with(k.name, split_part(a.name, ':', 1) || '.')))
SELECT rule_id, string_agg(found, ',' ORDER BY found) AS matched_entities FROM m GROUP BY 1""",
    "entity_classification": BASE + """, s AS (SELECT rule_id, count(*) AS steps FROM step GROUP BY 1), e AS (SELECT rule_id, count(*) AS entities FROM affects GROUP BY 1)
SELECT rule_id, coalesce(steps, 0) AS steps, coalesce(entities, 0) AS entities, CASE WHEN coalesce(steps, 0) > 0 THEN 'actionable' WHEN coalesce(entities, 0) > 0 THEN 'incomplete' ELSE 'informational' END AS classification
FROM rule LEFT JOIN s USING (rule_id) LEFT JOIN e USING (rule_id)""",
    "rule_type_map": BASE + """, t AS (SELECT ['breaking_change', 'security_fix', 'component_upgrade', 'security_config', 'behavioral', 'deprecation', 'new_capability'][rule_id % 7 + 1] AS section FROM rule)
SELECT section, CASE WHEN section = 'breaking_change' THEN 'breaking' WHEN section IN ('security_fix', 'component_upgrade', 'security_config') THEN 'mandatory_migration' WHEN section = 'deprecation' THEN 'deprecation' ELSE 'behavioral' END AS rule_type, count(*) AS rules
FROM t GROUP BY 1, 2""",
    "priority_summary": BASE + """, f AS (SELECT CASE rule_type WHEN 'breaking' THEN 'Breaking' WHEN 'mandatory_migration' THEN 'Mandatory' ELSE 'Behavioral+Deprecation' END AS level, count(*) AS rules FROM path GROUP BY 1)
SELECT l.level, coalesce(rules, 0) AS rules FROM (VALUES ('Breaking'), ('Mandatory'), ('Behavioral+Deprecation'), ('New')) l(level) LEFT JOIN f USING (level)""",
    "replacement_pairs": BASE + """SELECT DISTINCT o.kind, o.name AS old_name, n.name AS new_name FROM role_edge o JOIN role_edge n ON o.rule_id = n.rule_id AND o.kind = n.kind
WHERE o.role = 'removed' AND n.role = 'replacement' AND o.name <> n.name""",
    "step_prerequisites": BASE + "SELECT a.step_id, b.step_id AS prereq_step_id FROM step a JOIN step b ON a.rule_id = b.rule_id AND a.step_index = b.step_index + 1",
    "deprecation_one_hop": BASE + """SELECT p_partkey, name, n.new_part AS replaced_by, o.old_part AS replaces FROM entity LEFT JOIN replaced_by n ON n.old_part = p_partkey LEFT JOIN replaced_by o ON o.new_part = p_partkey""",
    "entity_evolution": BASE + """, chain AS (SELECT old_part AS start, new_part AS spot, 1 AS hop FROM replaced_by UNION ALL SELECT start, new_part, hop + 1 FROM chain JOIN replaced_by ON old_part = spot WHERE hop < 5),
ends AS (SELECT start, max(hop) AS hops FROM chain WHERE spot NOT IN (SELECT old_part FROM replaced_by) GROUP BY 1)
SELECT start, CAST(hop AS INTEGER) AS hop, spot AS "at" FROM chain JOIN ends USING (start) WHERE hop <= hops""",
    "null_audit": BASE + "SELECT count(*) AS rules, count(classification) AS with_classification, count(severity) AS with_severity FROM rule",
    "bom_diff": """WITH o AS (SELECT p_partkey AS part, p_retailprice AS old FROM part WHERE p_partkey % 5 <> 0),
n AS (SELECT p_partkey AS part, p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS new FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(o.part, n.part) AS part, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.part = n.part WHERE old IS DISTINCT FROM new""",
}
