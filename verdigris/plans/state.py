"""Project-state queries over all contexts: paths, guarded updates, opening, closing, seeds, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris.functions import exprs
from verdigris.operators import context, lifecycle, upsert, versions
from verdigris.plans.base_sql import BASE
from verdigris.sources import parsers
from verdigris.sources.graph import Graph


def context_path_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions on the path of every context."""
    g = Graph(spark, sf_dir)
    return versions.on_path(g.context, g.version).select("context_id", "sortable")


def pending_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps on the path of every context, and how many of them have no outcome yet.

    Steps are counted per version, and per version and step key, before they
    meet the contexts, so no context is multiplied by its steps.
    """
    g = Graph(spark, sf_dir)
    keyed = g.step.join(g.rule.select("rule_id", "framework", "sortable"), "rule_id").groupBy("framework", "sortable", (F.col("step_id") % 100).cast("int").alias("step_key")).agg(F.count("*").alias("n"))
    per_version = keyed.groupBy("framework", "sortable").agg(F.sum("n").alias("n"))
    path = versions.on_path(g.context, g.version)
    planned = path.join(per_version, ["framework", "sortable"]).groupBy("context_id").agg(F.sum("n").alias("planned"))
    outcomes = context.fold(g.outcome_event, ["context_id", "step_key"], ["ts", "event_id"]).select("context_id", "step_key")
    done = outcomes.join(path, "context_id").join(keyed, ["framework", "sortable", "step_key"]).groupBy("context_id").agg(F.sum("n").alias("settled"))
    zero = F.lit(0).cast("long")
    rows = g.context.select("context_id").join(planned, "context_id", "left").join(done, "context_id", "left")
    return rows.select("context_id", F.coalesce("planned", zero).alias("planned"), (F.coalesce("planned", zero) - F.coalesce("settled", zero)).alias("pending"))


def _requests(g: Graph) -> DataFrame:
    """Status updates: events dealt to steps, some with an outcome that is none."""
    k = F.col("event_id")
    return g.outcome_event.select(
        k.alias("request_id"), F.col("context_id"), ((k * 13 % 15000) * 10 + k % 5 + 1).alias("step_id"), F.when(k % 11 == 0, "bridgeResolved").otherwise(F.col("status")).alias("outcome")
    )


def _judged(g: Graph) -> DataFrame:
    bridges = g.rule.where("rule_id % 5 = 0").select("rule_id")
    owned = _requests(g).where("request_id % 17 = 0").select("context_id", "step_id")
    return context.judge_updates(_requests(g), g.step, g.rule, g.context, bridges, owned)


def step_update_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status update with its error: no outcome, no bridge to defer over, not on the path."""
    return _judged(Graph(spark, sf_dir))


def step_update_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that accepted updates leave, deferrals over a bridge resolved."""
    g = Graph(spark, sf_dir)
    k = F.col("request_id")
    ok = _judged(g).where("error_code is null")
    keyed = ok.select("context_id", (F.col("step_id") % 7).alias("step_id"), "outcome", F.when(F.col("outcome") == "deferred", (F.col("step_id") + k) % 7).alias("required"), k.alias("at"))
    return context.settled(keyed)


def contexts_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts created or resumed: buckets refreshed, scanned entities kept, zombies made anew."""
    g = Graph(spark, sf_dir)
    names = lambda tag: F.array(F.concat(F.lit(tag), F.col("context_id").cast("string")))
    base = g.context.select(
        (F.col("context_id") % 400).alias("project_id"), "from_sortable", "to_sortable", "framework", "status", "context_id", names("s").alias("scanned_entities"),
        *[names(b).alias(b) for b in context.BUCKETS],
    )
    existing = context.fold(base.where("context_id % 2 = 0"), ["project_id", "from_sortable", "to_sortable"], ["context_id"]).drop("context_id")
    fresh = base.where("context_id % 3 = 0").withColumn("at", F.col("context_id")).withColumns({c: F.array(F.lit("new")) for c in ("scanned_entities", "classes")})
    catalogue = g.version.where("sortable % 5000 <> 0")
    out = context.opened(existing, fresh, catalogue)
    return out.select("project_id", "from_sortable", "to_sortable", "framework", "status", F.array_join("scanned_entities", ",").alias("scanned"), F.array_join("classes", ",").alias("classes"), "created")


def contexts_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and notes of every context after explicit closing."""
    g = Graph(spark, sf_dir)
    after, _ = context.closed(g.context.select("context_id", "status"), _closing(g))
    return after.select("context_id", "status", "notes")


def close_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing requests with what is wrong with them."""
    g = Graph(spark, sf_dir)
    return context.closed(g.context.select("context_id", "status"), _closing(g))[1].select("request_id", "error_code")


def _closing(g: Graph) -> DataFrame:
    k = F.col("event_id")
    status = F.get(F.array(*map(F.lit, ["complete", "partial", "abandoned", "done"])), (k % 4).cast("int"))
    return g.table("events").where("event_type = 'signup'").select(k.alias("request_id"), (F.col("user_id") * 3).alias("context_id"), status.alias("final_status"), F.concat(F.lit("n"), k.cast("string")).alias("notes"), k.alias("at"))


def gap_check_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checks run on a context, by its mode."""
    mode = F.when(F.col("context_id") % 3 == 0, "lite").when(F.col("context_id") % 3 == 1, "full")
    return Graph(spark, sf_dir).context.select("context_id", F.explode(context.checks(mode)).alias("check"))


def range_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested ranges with what is wrong with them."""
    g = Graph(spark, sf_dir)
    k = F.col("c_custkey")
    low = (F.lit(2001000) + k % 4 * 1000000 + F.when(k % 9 == 0, 500).otherwise(0)).cast("long")
    high = (low + F.when(k % 5 == 0, -1000000).when(k % 5 == 1, 0).when(k % 5 == 2, 1500).otherwise(2000000)).cast("long")
    return versions.checked_range(g.customers.select(k.alias("request_id"), "framework", low.alias("low"), high.alias("high")), g.version)


def seed_deprecated_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known deprecated classes, written twice over a table that has one of them already."""
    seed = spark.createDataFrame(parsers.DEPRECATED_CLASSES, "name string, framework string, deprecated_in string, replaced_by string")
    known = spark.createDataFrame([("RestTemplate", "Mine", None, None), ("Other", "Mine", "1.0.0", None)], seed.schema)
    once = upsert.upsert(known, seed, ["name"], keep_first=["framework"])
    return upsert.upsert(once, seed, ["name"], keep_first=["framework"])


def seed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the version they belong to, written twice; a changed category is set right."""
    seed = spark.createDataFrame([(m, c, p, "Spring Boot", "4.0.0") for m, c, p in parsers.ALERTS], "message string, category string, phase string, framework string, version string")
    known = seed.limit(0).unionByName(spark.createDataFrame([(parsers.ALERTS[0][0], "old", "old", "Spring Boot", "4.0.0")], seed.schema))
    keys = ["framework", "version", "message"]
    return upsert.upsert(upsert.upsert(known, seed, keys), seed, keys)


def platform_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform versions and the hops between them, with the server versions they stand for."""
    table = spark.createDataFrame(parsers.PLATFORM_VERSIONS, "version string, short string, base string").withColumn("sortable", exprs.sortable(F.col("version")))
    hops = versions.hops(table.withColumn("framework", F.lit("platform")))
    named = lambda c: table.select(F.col("sortable").alias(c), F.col("version").alias(c.replace("hop_", "")), F.col("base").alias(c.replace("hop_", "") + "_base"))
    return hops.join(named("hop_from"), "hop_from").join(named("hop_to"), "hop_to").select("from", "to", "from_base", "to_base")


def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and repeated keys of the graph tables."""
    g = Graph(spark, sf_dir)
    keys = {"rule": ["rule_id"], "step": ["step_id"], "version": ["framework", "sortable"], "context": ["context_id"], "affects": ["rule_id", "kind", "name"], "outcome_event": ["context_id", "step_key"]}
    out = None
    for name, columns in keys.items():
        one = upsert.key_violations(getattr(g, name), columns).agg(F.count("*").alias("repeated")).select(F.lit(name).alias("table"), "repeated")
        out = one if out is None else out.unionByName(one)
    return out


def lifecycle_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the versions that deprecate and remove them, and what replaces them."""
    g = Graph(spark, sf_dir)
    edges = lifecycle.lifecycle_edges(g.role_edge, g.rule.select("rule_id", "framework", "sortable", "rule_type"))
    return lifecycle.deprecations(edges, upsert.replacement_pairs(g.role_edge))


QUERIES = {f.__name__: f for f in (
    context_path_versions, pending_by_context, step_update_guards, step_update_states, contexts_opened, contexts_closed, close_requests, gap_check_modes, range_validity,
    seed_deprecated_classes, seed_alerts, platform_versions, key_violations, lifecycle_one_hop,
)}

_PATH = "cp AS (SELECT context_id, c.framework, v.sortable FROM context c JOIN version v ON v.framework = c.framework AND v.sortable > from_sortable AND v.sortable <= to_sortable)"
_REQ = """req AS (SELECT event_id AS request_id, context_id, (event_id * 13 % 15000) * 10 + event_id % 5 + 1 AS step_id, CASE WHEN event_id % 11 = 0 THEN 'bridgeResolved' ELSE status END AS outcome FROM outcome_event),
jd AS (SELECT r.*, CASE WHEN outcome IS NULL OR outcome NOT IN ('completed', 'failed', 'skipped', 'deferred', 'excluded') THEN 'invalid_outcome'
    WHEN outcome = 'deferred' AND coalesce(s.rule_id % 5 <> 0, true) THEN 'bridge_not_in_graph'
    WHEN NOT ((context_id, step_id) IN (SELECT (context_id, step_id) FROM req WHERE request_id % 17 = 0)
      OR coalesce(c.framework = u.framework AND u.sortable > c.from_sortable AND u.sortable <= c.to_sortable, false)) THEN 'step_not_on_path' END AS error_code
  FROM req r LEFT JOIN step s USING (step_id) LEFT JOIN rule u ON u.rule_id = s.rule_id LEFT JOIN context c USING (context_id))"""
_CLOSING = "q AS (SELECT event_id AS request_id, user_id * 3 AS context_id, ['complete', 'partial', 'abandoned', 'done'][event_id % 4 + 1] AS final_status, 'n' || event_id AS notes FROM events WHERE event_type = 'signup')"


def _quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)


ORACLES = {
    "context_path_versions": BASE + f", {_PATH} SELECT context_id, sortable FROM cp",
    "pending_by_context": BASE + f""", {_PATH}, st AS (SELECT context_id, count(*) AS planned, count(*) FILTER ((context_id, step_id % 100) IN (SELECT (context_id, step_key) FROM outcome)) AS settled
  FROM cp JOIN rule r ON r.framework = cp.framework AND r.sortable = cp.sortable JOIN step s ON s.rule_id = r.rule_id GROUP BY 1)
SELECT c.context_id, coalesce(planned, 0) AS planned, coalesce(planned - settled, 0) AS pending FROM context c LEFT JOIN st USING (context_id)""",
    "step_update_guards": BASE + f", {_REQ} SELECT request_id, context_id, step_id, outcome, error_code FROM jd",
    "step_update_states": BASE + f""", {_REQ}, ev AS (SELECT context_id, step_id % 7 AS step_id, outcome, CASE WHEN outcome = 'deferred' THEN (step_id + request_id) % 7 END AS required, request_id AS n FROM jd WHERE error_code IS NULL),
la AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY context_id, step_id ORDER BY n DESC) = 1),
f AS (SELECT l.*, outcome = 'deferred' AND EXISTS (FROM ev e WHERE e.context_id = l.context_id AND e.step_id = l.required AND e.outcome = 'completed' AND e.n > l.n) AS via FROM la l)
SELECT context_id, step_id, CASE WHEN via THEN 'completed' ELSE outcome END AS status, CASE WHEN via THEN 'bridge' END AS resolved_via FROM f""",
    "contexts_opened": BASE + """, b AS (SELECT context_id % 400 AS project_id, from_sortable, to_sortable, framework, status, context_id FROM context),
o AS (SELECT * FROM b WHERE context_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY project_id, from_sortable, to_sortable ORDER BY context_id DESC) = 1),
k AS (SELECT * FROM o WHERE EXISTS (FROM version v WHERE v.framework = o.framework AND v.sortable = o.from_sortable AND v.sortable % 5000 <> 0)),
n AS (SELECT * FROM b WHERE context_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY project_id, from_sortable, to_sortable ORDER BY context_id DESC) = 1)
SELECT project_id, from_sortable, to_sortable, coalesce(k.framework, n.framework) AS framework, coalesce(k.status, 'in-progress') AS status,
  CASE WHEN k.context_id IS NOT NULL THEN 's' || k.context_id ELSE 'new' END AS scanned, CASE WHEN n.context_id IS NOT NULL THEN 'new' ELSE 'classes' || k.context_id END AS classes, k.context_id IS NULL AS created
FROM k FULL JOIN n USING (project_id, from_sortable, to_sortable)""",
    "contexts_closed": BASE + f""", {_CLOSING}, l AS (SELECT * FROM q WHERE final_status <> 'done' QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY request_id DESC) = 1)
SELECT c.context_id, coalesce(final_status, status) AS status, coalesce(notes, '') AS notes FROM context c LEFT JOIN l USING (context_id)""",
    "close_requests": BASE + f""", {_CLOSING} SELECT request_id, CASE WHEN final_status = 'done' THEN 'invalid_final_status' WHEN context_id NOT IN (SELECT context_id FROM context) THEN 'context_not_found' END AS error_code FROM q""",
    "gap_check_modes": BASE + """SELECT context_id, unnest(CASE WHEN context_id % 3 = 0 THEN ['truncation', 'applicability_uncertain', 'version_sanity', 'paysafe_unresolved']
  ELSE ['truncation', 'applicability_uncertain', 'version_sanity', 'paysafe_unresolved', 'stepless_rule', 'bridge_eligible'] END) AS check FROM context""",
    "range_validity": BASE + """, q AS (SELECT c_custkey AS request_id, framework, CAST(2001000 + c_custkey % 4 * 1000000 + CASE WHEN c_custkey % 9 = 0 THEN 500 ELSE 0 END AS BIGINT) AS low, c_custkey % 5 AS k FROM customers),
h AS (SELECT request_id, framework, low, CAST(low + CASE k WHEN 0 THEN -1000000 WHEN 1 THEN 0 WHEN 2 THEN 1500 ELSE 2000000 END AS BIGINT) AS high FROM q)
SELECT *, CASE WHEN low > high THEN 'reversed' WHEN NOT EXISTS (FROM version v WHERE v.framework = h.framework AND v.sortable = low) THEN 'unknown_from'
  WHEN NOT EXISTS (FROM version v WHERE v.framework = h.framework AND v.sortable = high) THEN 'unknown_to'
  WHEN (SELECT count(*) FROM version v WHERE v.framework = h.framework AND v.sortable BETWEEN low AND high) < 2 THEN 'too_few' END AS fault FROM h""",
    "seed_deprecated_classes": f"""SELECT name, CASE WHEN name = 'RestTemplate' THEN 'Mine' ELSE framework END AS framework, deprecated_in, replaced_by FROM (VALUES {_values(parsers.DEPRECATED_CLASSES)}) t(name, framework, deprecated_in, replaced_by)
UNION ALL SELECT 'Other', 'Mine', '1.0.0', NULL""",
    "seed_alerts": f"SELECT message, category, phase, 'Spring Boot' AS framework, '4.0.0' AS version FROM (VALUES {_values(parsers.ALERTS)}) t(message, category, phase)",
    "platform_versions": f"""WITH t AS (SELECT *, CAST(string_split(version, '.')[1] AS INTEGER) * 1000 + CAST(string_split(version, '.')[2] AS INTEGER) AS o FROM (VALUES {_values(parsers.PLATFORM_VERSIONS)}) t(version, short, base))
SELECT version AS "from", lead(version) OVER w AS "to", base AS from_base, lead(base) OVER w AS to_base FROM t WINDOW w AS (ORDER BY o) QUALIFY "to" IS NOT NULL""",
    "key_violations": BASE + """SELECT 'rule' AS "table", count(*) AS repeated FROM (SELECT rule_id FROM rule GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'step', count(*) FROM (SELECT step_id FROM step GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'version', count(*) FROM (SELECT framework, sortable FROM version GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'context', count(*) FROM (SELECT context_id FROM context GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'affects', count(*) FROM (SELECT rule_id, kind, name FROM affects GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'outcome_event', count(*) FROM (SELECT context_id, step_key FROM outcome_event GROUP BY ALL HAVING count(*) > 1)""",
    "lifecycle_one_hop": BASE + """, ed AS (SELECT kind, name, framework, sortable, CASE WHEN role = 'removed' THEN 'r' WHEN role = 'replacement' THEN 'i' WHEN rule_type = 'deprecation' THEN 'd' END AS e FROM role_edge JOIN rule USING (rule_id)),
p AS (SELECT kind, name, framework, coalesce(min(sortable) FILTER (e = 'd'), min(sortable) FILTER (e = 'i')) AS deprecated_in, min(sortable) FILTER (e = 'r') AS removed_in FROM ed WHERE e IS NOT NULL GROUP BY ALL),
x AS (SELECT o.kind, o.name, min(n.name) AS replaced_by, count(DISTINCT n.name) AS successors FROM role_edge o JOIN role_edge n ON o.rule_id = n.rule_id AND o.kind = n.kind WHERE o.role = 'removed' AND n.role = 'replacement' AND o.name <> n.name GROUP BY ALL)
SELECT p.*, replaced_by, coalesce(successors, 0) AS successors FROM p LEFT JOIN x USING (kind, name)""",
}
