"""Project-state queries: pending steps, outcomes, flags, community insights, writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris.functions import exprs
from verdigris.lineage import cut
from verdigris.operators import context, matching, upsert, versions
from verdigris.plans.base_sql import BASE
from verdigris.sources.graph import Graph

CONTEXT, FRAMEWORK = 11, "ASIA"
LOW, HIGH = 5006000, 7006000


def _outcomes(g: Graph) -> DataFrame:
    return context.fold(g.outcome_event, ["context_id", "step_key"], ["ts", "event_id"])


def _manual(g: Graph) -> DataFrame:
    """Manual steps of the context: large sign-ups."""
    rows = g.outcome_event.where((F.col("context_id") == CONTEXT) & (F.col("status") == "excluded") & (F.col("value") > 10))
    return rows.select(
        (-F.col("event_id") - 1).alias("step_id"), F.lit(None).cast("int").alias("step_index"), F.lit("moderate").alias("effort"),
        F.when(F.col("event_id") % 2 == 0, "api").otherwise("config").alias("scope"), F.lit(2).alias("severity_rank"),
    )


def _pending(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    g = Graph(spark, sf_dir)
    path = cut(versions.in_range(g.rule.where(F.col("framework") == FRAMEWORK), LOW, HIGH))
    forced = g.part_entity.where(F.col("p_partkey") % 50 == 1).select("name").distinct()
    rules = matching.applicable(path, g.affects_of(path), matching.normalise(g.scan_names), package_bridge=True, forced=forced, entities=g.part_entity)
    steps = g.step_of(path)
    keys = _outcomes(g).where(F.col("context_id") == CONTEXT).select("step_key")
    done = steps.withColumn("step_key", (F.col("step_id") % 100).cast("int")).join(keys, "step_key", "left_semi")
    return context.pending(rules, steps, done, _manual(g), **how)


def pending_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a context without an outcome, ranked by severity and index."""
    return _pending(spark, sf_dir).orderBy("severity_rank", F.asc_nulls_last("step_index"), "step_id")


def pending_steps_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir, efforts=["mechanical", "moderate"], scopes=["api"])


def step_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last outcome of every step of every context."""
    return _outcomes(Graph(spark, sf_dir)).select("context_id", "step_key", "status", "event_id")


def context_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return context.outcome_counts(g.context.select("context_id", "framework", "status"), _outcomes(g))


def raw_append_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the append-only lists, in which a repeated outcome counts again."""
    g = Graph(spark, sf_dir)
    return context.outcome_counts(g.context.select("context_id"), g.outcome_event)


def _with_reason(g: Graph) -> DataFrame:
    reason = F.when(F.col("event_id") % 10 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(((F.col("step_key") * 7 + 3) % 100).alias("requiredChange"))))
    return _outcomes(g).withColumn("reason", F.when(F.col("status") == "deferred", reason))


def auto_resolve_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.auto_resolved(_with_reason(Graph(spark, sf_dir)))


def _counts(g: Graph) -> DataFrame:
    """Contexts with counts, flags and what is pending of 40 planned steps."""
    counted = context.outcome_counts(g.context.select("context_id", "status"), _outcomes(g))
    total = sum((F.col(f"{s}_count") for s in context.OUTCOMES), F.lit(0))
    return counted.withColumn("has_flags", F.col("context_id") % 3 == 0).withColumn("pending_count", F.greatest(F.lit(0).cast("long"), 40 - total))


def resume_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.resume_stage(_counts(Graph(spark, sf_dir))).select("context_id", "status", "resume_stage")


def final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(Graph(spark, sf_dir)).select("context_id", context.final_status().alias("final_status"))


def auto_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open contexts with outcomes and nothing pending, and the status they close with."""
    rows = _counts(Graph(spark, sf_dir)).where("pending_count = 0 AND status = 'in-progress'")
    return rows.select("context_id", context.final_status().alias("closed_as"))


def sole_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    rows = g.context.withColumn("project", F.col("context_id") % 1000)
    return context.sole_in_progress(rows, ["project"])


def gap_flags_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of two writes, without repeats; a null message is a value."""
    e = Graph(spark, sf_dir).outcome_event
    flag = lambda rows: rows.select(
        "context_id", F.col("status").alias("type"), (F.col("step_key") % 5).cast("string").alias("reference"),
        F.when(F.col("step_key") % 4 != 0, F.concat(F.lit("m"), (F.col("step_key") % 3).cast("string"))).alias("message"), F.col("event_id").alias("position"),
    )
    return context.merge_flags(flag(e.where("event_id % 2 = 0")), flag(e.where("event_id % 2 = 1")))


def gap_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags raised by the checks on a capped and an uncertain report."""
    g = Graph(spark, sf_dir)
    path = versions.in_range(g.rule.where(F.col("framework") == FRAMEWORK), LOW, HIGH)
    rules = matching.applicable(path, g.affects, matching.normalise(g.scan_names), entities=g.part_entity)
    truncated = rules.agg(F.count_if(F.col("applicability") != "excluded").alias("n")).where("n > 50").select(F.lit("truncation").alias("type"), F.lit(None).cast("long").alias("reference"))
    unsure = rules.where("applicability = 'uncertain'").select(F.lit("applicability_uncertain").alias("type"), F.col("rule_id").alias("reference"))
    stepless = rules.where("applicability <> 'excluded'").join(g.step.select("rule_id"), "rule_id", "left_anti").select(F.lit("stepless_rule").alias("type"), F.col("rule_id").alias("reference"))
    return truncated.unionByName(unsure).unionByName(stepless)


def queried_entities_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per context the queried entities and summaries, as JSON text."""
    e = Graph(spark, sf_dir).outcome_event.select(
        "context_id", F.concat(F.lit("e"), (F.col("step_key") % 10).cast("string")).alias("entity"), F.concat_ws(" ", "status", F.col("event_id").cast("string")).alias("summary"), F.col("event_id").alias("at")
    )
    return context.queried_map(e).select("context_id", F.array_join(F.transform(F.map_entries("queried"), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("queried"))


def upsert_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions after writing half of them again with a status; a set path is kept."""
    v = Graph(spark, sf_dir).version
    existing = v.where("sortable % 2000 = 0").select("framework", "version", F.lit("known").alias("status"), F.lit("old.md").alias("path"))
    incoming = v.where("sortable % 3000 = 0").select("framework", "version", F.lit("again").alias("status"), F.lit("new.md").alias("path"))
    return upsert.upsert(existing, incoming, ["framework", "version"], keep_first=["path"])


def upsert_rules_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writing the same rules twice is writing them once."""
    r = Graph(spark, sf_dir).rule.select("rule_id", "rule_type", "severity")
    once = upsert.upsert(r.where("rule_id % 2 = 0"), r, ["rule_id"])
    return upsert.upsert(once, r, ["rule_id"])


def default_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Graph(spark, sf_dir).rule
    scopes = F.when(F.col("severity").isNotNull(), F.array(F.struct(F.col("scope").alias("scope"), F.col("severity").alias("severity"))))
    return upsert.with_default_scope(r.select("rule_id", scopes.alias("scopes")))


def _vote_events(g: Graph) -> DataFrame:
    """Votes on insights: events dealt to the first thousand documents."""
    return g.table("events").select(
        (F.col("event_id") % 1000).alias("insight_id"), F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.lit(1)).cast("long").alias("delta"), (F.col("event_type") == "signup").alias("verify")
    )


def insight_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return upsert.votes(g.insight.select("insight_id", "framework", "verified"), _vote_events(g))


def insights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified insights of one framework, most votes first."""
    g = Graph(spark, sf_dir)
    rows = upsert.votes(g.insight.where("framework = 'en'").select("insight_id", "framework", "source", "verified"), _vote_events(g))
    return rows.where("verified").orderBy(F.desc("votes"), "insight_id")


def allow_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with an allowed prefix, of entities renamed to real groups by their key."""
    p = Graph(spark, sf_dir).part_entity
    group = F.get(F.array(*map(F.lit, ["org.springframework.web", "jakarta.servlet", "com.acme", "spring.main", "io.micrometer:core", "springboard"])), (F.col("p_partkey") % 6).cast("int"))
    return p.select("p_partkey", F.concat_ws(".", group, "p_name").alias("name")).where(exprs.allowed(F.col("name")))


def mutation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ad-hoc queries are refused."""
    text = F.get(
        F.array(*map(F.lit, ["MATCH (n) RETURN n", "match (n) set n.x = 1", "CALL db.labels()", "select offset from t", "merge (a)", "SELECT 'dropped'", "Drop index i", "RETURN created"])),
        (F.col("event_id") % 8).cast("int"),
    )
    return Graph(spark, sf_dir).table("events").select("event_id", text.alias("query")).select("event_id", exprs.is_mutation(F.col("query")).alias("refused"))


def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guarded read-only query over the graph's views."""
    g = Graph(spark, sf_dir)
    return guarded(spark, {"rule": g.rule, "step": g.step}, "SELECT rule_type, effort, count(*) AS steps FROM {rule} r JOIN {step} s ON r.rule_id = s.rule_id GROUP BY rule_type, effort")


def guarded(spark: SparkSession, views: dict[str, DataFrame], query: str) -> DataFrame:
    """Runs a query over named DataFrames; refuses mutations."""
    import re

    if re.search(exprs.MUTATIONS, query.upper()) or query.lstrip().upper().startswith("CALL DB"):
        raise ValueError("only read-only queries are allowed")
    return spark.sql(query, **views)


QUERIES = {
    "pending_steps": pending_steps,
    "pending_steps_filtered": pending_steps_filtered,
    "step_state_fold": step_state_fold,
    "context_outcome_counts": context_outcome_counts,
    "raw_append_counts": raw_append_counts,
    "auto_resolve_deferred": auto_resolve_deferred,
    "resume_stage": resume_stage,
    "final_status": final_status,
    "auto_close": auto_close,
    "sole_context": sole_context,
    "gap_flags_merge": gap_flags_merge,
    "gap_checks": gap_checks,
    "queried_entities_map": queried_entities_map,
    "upsert_version": upsert_version,
    "upsert_rules_idempotent": upsert_rules_idempotent,
    "default_scope": default_scope,
    "insight_votes": insight_votes,
    "insights_query": insights_query,
    "allow_list_filter": allow_list_filter,
    "mutation_guard": mutation_guard,
    "adhoc_sql": adhoc_sql,
}

_COUNTS = """, c AS (
  SELECT x.context_id, x.framework, x.status, count(*) FILTER (o.status = 'completed') AS completed_count, count(*) FILTER (o.status = 'failed') AS failed_count, count(*) FILTER (o.status = 'skipped') AS skipped_count,
    count(*) FILTER (o.status = 'deferred') AS deferred_count, count(*) FILTER (o.status = 'excluded') AS excluded_count
  FROM context x LEFT JOIN outcome o ON o.context_id = x.context_id GROUP BY 1, 2, 3),
t AS (SELECT *, completed_count + failed_count + skipped_count + deferred_count + excluded_count AS total, context_id % 3 = 0 AS has_flags FROM c),
p AS (SELECT *, greatest(0, 40 - total) AS pending_count FROM t)
"""
_FINAL = "CASE WHEN skipped_count > 0 OR failed_count > 0 THEN 'partial' ELSE 'complete' END"
_VOTES = ", v AS (SELECT event_id % 1000 AS insight_id, CAST(sum(CASE event_type WHEN 'error' THEN -1 ELSE 1 END) AS BIGINT) AS votes, bool_or(event_type = 'signup') AS by_event FROM events GROUP BY 1)"


def _pending_sql(efforts: str, scopes: str) -> str:
    fits = f"scope IN ({scopes})" if scopes else "true"
    return BASE + f""", manual AS (
  SELECT -event_id - 1 AS step_id, 9999 AS step_index, 'moderate' AS effort, CASE event_id % 2 WHEN 0 THEN 'api' ELSE 'config' END AS scope FROM outcome_event WHERE context_id = 11 AND status = 'excluded' AND value > 10),
f AS (SELECT rule_id, CASE WHEN {fits} THEN scope END AS scope, CASE WHEN {fits} THEN severity_rank ELSE 4 END AS severity_rank, pending_applicability AS a FROM path),
r AS (SELECT rule_id, scope, severity_rank, CASE WHEN a = 'uncertain' AND severity_rank > 1 THEN 'excluded' ELSE a END AS applicability FROM f),
s AS (SELECT * FROM step WHERE rule_id IN (SELECT rule_id FROM path))
SELECT s.step_id, s.step_index, s.effort, CASE WHEN s.auto AND NOT s.missing_params THEN s.recipe_id END AS recipe_id, scope, severity_rank, applicability, b.step_id AS prereq_step_id
FROM s JOIN r USING (rule_id) LEFT JOIN s b ON b.rule_id = s.rule_id AND b.step_index + 1 = s.step_index
WHERE applicability <> 'excluded' AND s.step_id % 100 NOT IN (SELECT step_key FROM outcome WHERE context_id = 11) {"AND s.effort IN (" + efforts + ")" if efforts else ""}
UNION ALL SELECT step_id, step_index, effort, NULL, scope, 2, 'manual', NULL FROM manual WHERE {fits} {"AND effort IN (" + efforts + ")" if efforts else ""}"""


ORACLES = {
    "pending_steps": _pending_sql("", ""),
    "pending_steps_filtered": _pending_sql("'mechanical', 'moderate'", "'api'"),
    "step_state_fold": BASE + "SELECT context_id, step_key, status, event_id FROM outcome",
    "context_outcome_counts": BASE + _COUNTS + "SELECT * FROM c",
    "raw_append_counts": BASE + """SELECT x.context_id, count(*) FILTER (o.status = 'completed') AS completed_count, count(*) FILTER (o.status = 'failed') AS failed_count, count(*) FILTER (o.status = 'skipped') AS skipped_count,
  count(*) FILTER (o.status = 'deferred') AS deferred_count, count(*) FILTER (o.status = 'excluded') AS excluded_count FROM context x LEFT JOIN outcome_event o ON o.context_id = x.context_id GROUP BY 1""",
    "auto_resolve_deferred": BASE + """SELECT d.context_id, d.step_key AS deferred_step, k.step_key AS required_step FROM outcome d JOIN outcome k
ON k.context_id = d.context_id AND k.step_key = (d.step_key * 7 + 3) % 100 WHERE d.status = 'deferred' AND d.event_id % 10 <> 0 AND k.status = 'completed'""",
    "resume_stage": BASE + _COUNTS + """SELECT context_id, status, CASE WHEN status IN ('complete', 'partial', 'abandoned') THEN NULL WHEN has_flags AND excluded_count + completed_count + failed_count = 0 THEN 'clarify'
  WHEN total = 0 THEN 'gap-check' WHEN failed_count > 0 OR deferred_count > 0 THEN 'execute'
  WHEN pending_count + total > 0 AND completed_count + excluded_count + failed_count + skipped_count = pending_count + total THEN 'feedback' ELSE 'execute' END AS resume_stage FROM p""",
    "final_status": BASE + _COUNTS + f"SELECT context_id, {_FINAL} AS final_status FROM p",
    "auto_close": BASE + _COUNTS + f"SELECT context_id, {_FINAL} AS closed_as FROM p WHERE pending_count = 0 AND status = 'in-progress'",
    "sole_context": BASE + "SELECT context_id % 1000 AS project, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(context_id) END AS context_id FROM context WHERE status = 'in-progress' GROUP BY 1",
    "gap_flags_merge": BASE + """, f AS (SELECT context_id, status AS type, CAST(step_key % 5 AS VARCHAR) AS reference, CASE WHEN step_key % 4 <> 0 THEN 'm' || step_key % 3 END AS message, event_id % 2 AS origin, event_id AS position FROM outcome_event)
SELECT context_id, type, reference, message, position, CAST(origin AS INTEGER) AS origin FROM (SELECT *, row_number() OVER (PARTITION BY context_id, type, reference, message ORDER BY origin, position) AS rn FROM f) WHERE rn = 1""",
    "gap_checks": BASE + """SELECT 'truncation' AS type, CAST(NULL AS BIGINT) AS reference WHERE (SELECT count(*) FROM path WHERE applicability <> 'excluded') > 50
UNION ALL SELECT 'applicability_uncertain', rule_id FROM path WHERE applicability = 'uncertain'
UNION ALL SELECT 'stepless_rule', rule_id FROM path WHERE applicability <> 'excluded' AND rule_id NOT IN (SELECT rule_id FROM step)""",
    "queried_entities_map": BASE + """, q AS (SELECT context_id, 'e' || step_key % 10 AS entity, max_by(status || ' ' || event_id, event_id) AS summary FROM outcome_event GROUP BY 1, 2)
SELECT context_id, string_agg(entity || '=' || left(summary, 500), ';' ORDER BY entity) AS queried FROM q GROUP BY 1""",
    "upsert_version": BASE + """, e AS (SELECT framework, version FROM version WHERE sortable % 2000 = 0), i AS (SELECT framework, version FROM version WHERE sortable % 3000 = 0)
SELECT framework, version, CASE WHEN i.version IS NOT NULL THEN 'again' ELSE 'known' END AS status, CASE WHEN e.version IS NOT NULL THEN 'old.md' ELSE 'new.md' END AS path FROM e FULL JOIN i USING (framework, version)""",
    "upsert_rules_idempotent": BASE + "SELECT rule_id, rule_type, severity FROM rule",
    "default_scope": BASE + "SELECT rule_id, CASE WHEN severity IS NULL THEN 'general' ELSE scope END AS scope, coalesce(severity, 'low') AS severity FROM rule",
    "insight_votes": BASE + _VOTES + "SELECT insight_id, framework, coalesce(votes, 0) AS votes, verified OR coalesce(by_event, false) AS verified FROM insight LEFT JOIN v USING (insight_id)",
    "insights_query": BASE + _VOTES + "SELECT insight_id, framework, source, coalesce(votes, 0) AS votes, verified OR coalesce(by_event, false) AS verified FROM insight LEFT JOIN v USING (insight_id) WHERE framework = 'en' AND (verified OR coalesce(by_event, false))",
    "allow_list_filter": """WITH p AS (SELECT p_partkey, ['org.springframework.web', 'jakarta.servlet', 'com.acme', 'spring.main', 'io.micrometer:core', 'springboard'][p_partkey % 6 + 1] || '.' || p_name AS name FROM part)
SELECT p_partkey, name FROM p WHERE regexp_matches(split_part(name, ':', 1), '^(org\\.springframework|jakarta\\.|javax\\.|io\\.micrometer|spring\\.)')""".replace("\\\\", "\\"),
    "mutation_guard": """SELECT event_id, event_id % 8 IN (1, 2, 4, 6) AS refused FROM events""",
    "adhoc_sql": BASE + "SELECT rule_type, effort, count(*) AS steps FROM rule JOIN step USING (rule_id) GROUP BY 1, 2",
}
