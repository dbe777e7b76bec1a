"""Queries over records: contexts, recipes, insights, batches, artifacts, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris.operators import records, versions
from verdigris.plans.base_sql import BASE
from verdigris.sources import parsers
from verdigris.sources.graph import Graph


def framework_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("-", F.col("n_name"), F.lit("Boot x"))
    return Graph(spark, sf_dir).table("nation").select("n_nationkey", records.alias(name).alias("alias"))


def minor_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    v = F.when(k % 4 == 0, (k % 9).cast("string")).otherwise(F.concat_ws(".", (k % 9).cast("string"), (k % 7).cast("string"), F.lit("Final")))
    return Graph(spark, sf_dir).table("part").select("p_partkey", records.minor_zero(v).alias("version"))


def unfenced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Sure:\n```json\n{\"a\": "), k.cast("string"), F.lit("}\n```\nbye"))).when(k % 3 == 1, F.concat(F.lit("Here it is\n# Title "), "p_name")).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return Graph(spark, sf_dir).table("part").select("p_partkey", records.unfenced(text).alias("text"))


def escaped_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).table("part").select("p_partkey", records.escaped(F.concat(F.lit("+("), "p_brand", F.lit('):"a/b"~2 && c*'))).alias("query"))


def _catalogue(g: Graph) -> DataFrame:
    return g.version.where("sortable % 5000 <> 0")


def zombie_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return records.zombies(g.context, _catalogue(g)).select("context_id", "framework", "from_sortable")


def outcomes_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome events left when finished contexts are deleted with their edges."""
    g = Graph(spark, sf_dir)
    left = records.detach(g.outcome_event, g.context.where("status = 'complete'"), "context_id")
    return left.groupBy("context_id").agg(F.count("*").alias("events"))


def stub_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    known = spark.createDataFrame([("stub.mechanical", "Hand made", "someone"), ("stub.moderate", "Old stub", None), ("other", "Other", "x")], "recipe_id string, display_name string, verified_by string")
    return records.stub_recipes(g.step, known)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity batches as JSON text of the parts, some twice, read back by schema."""
    k = F.col("p_partkey")
    rows = Graph(spark, sf_dir).table("part").select(
        F.to_json(
            F.struct(
                F.lit("deprecation").alias("source_section"), F.concat(F.lit("t"), (k % 500).cast("string")).alias("title"), F.lit("removal").alias("change_type"),
                F.when(k % 2 == 0, F.array(F.struct(F.lit("api").alias("scope"), F.lit("high").alias("severity")))).alias("scopes"),
                F.array(F.struct(F.lit("class").alias("kind"), F.concat(F.lit("N"), (k % 100).cast("string")).alias("name"), F.get(F.array(*map(F.lit, ["removed", "replacement", "mentioned"])), (k % 3).cast("int")).alias("role"))).alias("entities"),
                F.array(F.struct(F.lit(1).alias("index"), F.lit("mechanical").alias("effort"), (k % 500 % 3 == 0).alias("automatable"), F.array(F.lit(1), F.lit(7)).alias("requires"))).alias("steps"),
            )
        ).alias("j")
    )
    return rows.select(F.from_json("j", parsers.ENTITY_BATCH).alias("e")).select("e.*")


def entity_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table after a batch is written; writing it again adds none."""
    tables = records.batch_tables(_batches(spark, sf_dir))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def insight_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = Graph(spark, sf_dir).table("events").select(
        F.concat(F.lit("s"), (k % 700).cast("string")).alias("statement"), F.when(k % 700 % 2 == 0, F.lit(0.9)).alias("confidence"), F.when(k % 700 % 3 == 0, "me").alias("submitted_by")
    )
    return records.submit(rows)


def insight_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights of both key styles under one schema."""
    k = F.col("s_suppkey")
    s = Graph(spark, sf_dir).table("supplier")
    camel = s.where("s_suppkey % 2 = 0").select(F.to_json(F.struct(F.col("s_name").alias("statement"), F.concat(F.lit("u"), k.cast("string")).alias("sourceUrl"), F.lit("3.0").alias("frameworkVersion"))).alias("j"))
    snake = s.where("s_suppkey % 2 = 1").select(F.to_json(F.struct(F.col("s_name").alias("statement"), F.concat(F.lit("v"), k.cast("string")).alias("evidence_url"))).alias("j"))
    one = camel.select(F.from_json("j", "statement string, sourceUrl string, frameworkVersion string").alias("e")).select("e.*")
    two = snake.select(F.from_json("j", "statement string, evidence_url string").alias("e")).select("e.*")
    return parsers.one_style(one, two)


def severity_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Graph(spark, sf_dir).rule
    scopes = F.array(F.struct(F.lit("general").alias("scope"), F.when(F.col("rule_id") % 2 == 0, "low").alias("severity")), F.struct("scope", "severity"))
    return r.select("rule_id", records.promoted_severity(scopes).alias("severity"))


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with artifacts and where their range starts."""
    v = Graph(spark, sf_dir).version
    path = F.when(F.col("sortable") % 2000 == 0, F.concat(F.lit("runs/raw/"), F.lower("framework"), F.lit("-"), "version", F.lit("-to-9.0.0-changes.md")))
    return records.runs(v.withColumn("raw_path", path)).select("framework", "version", "raw_path", "from_version")


def lifecycle_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of versions on the path; an alert of a version without rules there is not shown."""
    g = Graph(spark, sf_dir)
    s = F.col("sortable")
    alerts = g.version.where("sortable % 3000 = 0").select("framework", "sortable", F.concat(F.lit("support of "), "version", F.lit(" ends")).alias("message"), F.when(s % 2000 == 0, "eol").otherwise("removal").alias("category"))
    rules = versions.in_range(g.rule.where("framework = 'ASIA' AND scope = 'api' AND severity = 'critical'"), 5006000, 7006000)
    return alerts.join(rules.select("framework", "sortable").distinct(), ["framework", "sortable"], "left_semi")


def version_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each framework's latest version, and whether the one asked for is out."""
    g = Graph(spark, sf_dir)
    latest = g.version.groupBy("framework").agg(F.max_by("version", "sortable").alias("latest"), F.max("sortable").alias("top"))
    asked = g.customers.select(F.col("c_custkey").alias("request_id"), "framework", ((F.col("c_custkey") % 12) * 1000000 + 1000).cast("long").alias("requested"))
    known = g.version.select("framework", F.col("sortable").alias("requested"), F.lit(True).alias("hit"))
    return asked.join(known, ["framework", "requested"], "left").join(latest, "framework", "left").select(
        "request_id", "framework", "requested", F.coalesce("hit", F.lit(False)).alias("available"), "latest", (F.col("requested") > F.col("top")).alias("ahead")
    )


def co_migration_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that cross version 4 while a companion group was scanned."""
    g = Graph(spark, sf_dir)
    companion = g.scan_names.agg(F.coalesce(F.bool_or(F.startswith("name", F.lit("org.brand2"))), F.lit(False)).alias("seen"))
    crosses = (F.col("from_sortable") < 4000000) & (F.col("to_sortable") >= 4000000)
    return g.context.crossJoin(F.broadcast(companion)).select("context_id", (crosses & F.col("seen")).alias("warn"))  # one row


def manual_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual steps are added to open contexts only; scope is the file pattern or 'config', index 9999."""
    g = Graph(spark, sf_dir)
    asked = g.table("events").where("event_type = 'signup'").select(F.col("user_id").alias("context_id"), "event_id", F.when(F.col("event_id") % 2 == 0, "*.yml").alias("file_pattern"))
    open_ = g.context.where("status = 'in-progress'").select("context_id")
    return asked.join(open_, "context_id", "left_semi").select("context_id", "event_id", F.coalesce("file_pattern", F.lit("config")).alias("scope"), F.lit(9999).alias("step_index"))


def raw_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of rendered tables under their hop headings, read back."""
    g = Graph(spark, sf_dir)
    h = versions.hops(g.version)
    body = F.concat(
        F.lit("# F\n\n## `"), F.col("hop_from").cast("string"), F.lit("` → `"), F.col("hop_to").cast("string"),
        F.lit("`\n\n| Type | Confidence | Source | Statement |\n|---|---|---|---|\n| breaking | confirmed | u | a "), "framework", F.lit(" |\n| behavioral | inferred | v | b |\n"),
    )
    rows = parsers.lines(h.select("framework", "hop_from", F.concat_ws("|", "framework", F.col("hop_from").cast("string")).alias("k"), body.alias("body")), "k", "body")
    line = F.col("line")
    hop = F.regexp_extract(line, r"^## `([^`]+)` → `([^`]+)`", 2)
    named = parsers.sections(rows, "k", F.when(hop != "", hop))
    cells = F.split(line, r"\s*\|\s*")
    return named.where(line.rlike(r"^\| (?!Type \|)")).select("k", F.col("section").alias("hop_to"), F.get(cells, F.lit(1)).alias("type"), F.get(cells, F.lit(2)).alias("confidence"), F.get(cells, F.lit(4)).alias("statement"))


def schema_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and types of the graph tables."""
    g = Graph(spark, sf_dir)
    names = ("rule", "version", "affects", "step", "replaced_by", "context", "outcome_event", "insight")
    return spark.createDataFrame([(n, c, t) for n in names for c, t in getattr(g, n).dtypes], "table string, column string, type string")


QUERIES = {f.__name__: f for f in (
    framework_alias, minor_zero, unfenced_text, escaped_query, zombie_contexts, outcomes_after_delete, stub_recipes, entity_batch_counts, insight_submit, insight_dumps, severity_promotion,
    pipeline_runs, lifecycle_alerts, version_availability, co_migration_warning, manual_steps, raw_changelog, schema_tables,
)}

ORACLES = {
    "framework_alias": "SELECT n_nationkey, lower(regexp_replace(n_name || '-Boot x', '[\\s\\-_]', '', 'g')) AS alias FROM nation",
    "minor_zero": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 9 || '.' || p_partkey % 7 || '.0' END AS version FROM part",
    "unfenced_text": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{\"a\": ' || p_partkey || '}' WHEN 1 THEN '# Title ' || p_name ELSE p_name END AS text FROM part",
    "escaped_query": """SELECT p_partkey, '\\+\\(' || p_brand || '\\)\\:\\"a\\/b\\"\\~2 \\&\\& c\\*' AS query FROM part""",
    "zombie_contexts": BASE + "SELECT context_id, framework, from_sortable FROM context c WHERE NOT EXISTS (FROM version v WHERE v.framework = c.framework AND v.sortable = c.from_sortable AND v.sortable % 5000 <> 0)",
    "outcomes_after_delete": BASE + "SELECT context_id, count(*) AS events FROM outcome_event WHERE context_id NOT IN (SELECT context_id FROM context WHERE status = 'complete') GROUP BY 1",
    "stub_recipes": """SELECT * FROM (VALUES ('stub.mechanical', 'Hand made', 'someone'), ('stub.moderate', 'Stub for stub.moderate', NULL), ('stub.architectural', 'Stub for stub.architectural', NULL), ('other', 'Other', 'x')) t(recipe_id, display_name, verified_by)""",
    "entity_batch_counts": """WITH b AS (SELECT p_partkey % 500 AS t, p_partkey % 2 AS s, p_partkey % 100 AS n, ['removed', 'replacement', 'mentioned'][p_partkey % 3 + 1] AS r FROM part)
SELECT 'rule' AS "table", count(DISTINCT t) AS n FROM b UNION ALL SELECT 'step', count(DISTINCT t) FROM b UNION ALL SELECT 'scope', count(*) FROM (SELECT DISTINCT t, s FROM b) UNION ALL SELECT 'affects', count(*) FROM (SELECT DISTINCT t, n, r FROM b)
UNION ALL SELECT 'requires', count(DISTINCT t) FROM b UNION ALL SELECT 'replaced_by', count(*) FROM (SELECT DISTINCT x.n, y.n FROM b x JOIN b y ON x.t = y.t WHERE x.r = 'removed' AND y.r = 'replacement' AND x.n <> y.n)
UNION ALL SELECT 'lifecycle', count(*) FROM (SELECT DISTINCT n, r FROM b)""",
    "insight_submit": """SELECT DISTINCT 'community-' || left(md5('s' || event_id % 700), 12) AS rule_id, 's' || event_id % 700 AS statement, CASE WHEN event_id % 700 % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5 END AS confidence,
  CASE WHEN event_id % 700 % 3 = 0 THEN 'me' ELSE 'mcp-agent' END AS submitted_by FROM events""",
    "insight_dumps": "SELECT s_name AS statement, CASE WHEN s_suppkey % 2 = 0 THEN 'u' ELSE 'v' END || s_suppkey AS source_url, CASE WHEN s_suppkey % 2 = 0 THEN '3.0' END AS framework_version FROM supplier",
    "severity_promotion": BASE + "SELECT rule_id, CASE WHEN rule_id % 2 = 0 THEN 'low' ELSE severity END AS severity FROM rule",
    "pipeline_runs": BASE + "SELECT framework, version, 'runs/raw/' || lower(framework) || '-' || version || '-to-9.0.0-changes.md' AS raw_path, version AS from_version FROM version WHERE sortable % 2000 = 0",
    "lifecycle_alerts": BASE + """SELECT DISTINCT v.framework, v.sortable, 'support of ' || version || ' ends' AS message, CASE WHEN v.sortable % 2000 = 0 THEN 'eol' ELSE 'removal' END AS category
FROM version v JOIN path p ON p.framework = v.framework AND p.sortable = v.sortable WHERE v.sortable % 3000 = 0 AND p.scope = 'api' AND p.severity = 'critical'""",
    "version_availability": BASE + """, l AS (SELECT framework, max_by(version, sortable) AS latest, max(sortable) AS top FROM version GROUP BY 1),
a AS (SELECT c_custkey AS request_id, framework, CAST((c_custkey % 12) * 1000000 + 1000 AS BIGINT) AS requested FROM customers)
SELECT request_id, a.framework, requested, v.sortable IS NOT NULL AS available, latest, requested > top AS ahead FROM a LEFT JOIN version v ON v.framework = a.framework AND v.sortable = requested LEFT JOIN l ON l.framework = a.framework""",
    "co_migration_warning": BASE + "SELECT context_id, from_sortable < 4000000 AND to_sortable >= 4000000 AND EXISTS (FROM scan_names WHERE starts_with(name, 'org.brand2')) AS warn FROM context",
    "manual_steps": BASE + "SELECT user_id AS context_id, event_id, CASE WHEN event_id % 2 = 0 THEN '*.yml' ELSE 'config' END AS scope, 9999 AS step_index FROM events WHERE event_type = 'signup' AND user_id IN (SELECT context_id FROM context WHERE status = 'in-progress')",
    "raw_changelog": BASE + """, h AS (SELECT framework, sortable AS hop_from, lead(sortable) OVER (PARTITION BY framework ORDER BY sortable) AS hop_to FROM version),
k AS (SELECT framework || '|' || hop_from AS k, framework, CAST(hop_to AS VARCHAR) AS hop_to FROM h WHERE hop_to IS NOT NULL)
SELECT k, hop_to, 'breaking' AS type, 'confirmed' AS confidence, 'a ' || framework AS statement FROM k UNION ALL SELECT k, hop_to, 'behavioral', 'inferred', 'b' FROM k""",
}
