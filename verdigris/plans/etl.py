"""Ingestion queries: release notes, changelogs, build files, tags, HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from verdigris.functions import exprs
from verdigris.operators import versions
from verdigris.plans.base_sql import BASE
from verdigris.sources import parsers
from verdigris.sources.graph import Graph

SECTIONS = ["Breaking changes", "Deprecated API", "Upgrade guide", "BOM update", "Security fixes", "Behavior", "Misc", "Other /subsystem=logging"]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).table("part")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _s(column: str) -> Column:
    return F.col(column).cast("string")


def classify_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = _pick(SECTIONS, F.col("p_partkey") % 8)
    kind, sure = exprs.classify(F.lit("Notes"), F.concat_ws(" ", section, "p_name"))
    return _parts(spark, sf_dir).select("p_partkey", kind.alias("type"), sure.alias("confidence"))


def stability_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws(" ", "p_name", _pick(["[Experimental]", "[preview] x", "plain", "a [COMMUNITY]"], F.col("p_partkey") % 4))
    return _parts(spark, sf_dir).select("p_partkey", exprs.stability(body).alias("stability"))


def _version_strings(parts: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    suffix = _pick(["", ".Final", "-RC1", ".Beta1", ".SP1"], k % 5)
    return parts.select("p_partkey", F.concat(F.concat_ws(".", (k % 23).cast("string"), (k % 7).cast("string"), (k % 11).cast("string")), suffix).alias("version"))


def ga_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("version")
    return _version_strings(_parts(spark, sf_dir)).select("p_partkey", "version", parsers.jboss_ga(v).alias("jboss"), parsers.infinispan_ga(v).alias("infinispan"), parsers.plain_ga(v).alias("plain"))


def release_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.releases(_version_strings(_parts(spark, sf_dir)))


def semver_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    version = lambda a, b, c: F.concat_ws(".", *[(k % n).cast("string") for n in (a, b, c)])
    return _parts(spark, sf_dir).select("p_partkey", parsers.compatible(version(3, 5, 7), version(4, 3, 9)).alias("compatible"))


def jira_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with the issue they are about; issues are known for some keys only."""
    g = Graph(spark, sf_dir)
    k = F.col("event_id")
    text = F.concat(F.lit("Fix wfly-"), (k % 300).cast("string"), F.lit(", see HHH-"), (k % 170).cast("string"), F.lit(" (FOO-1)"))
    changes = g.table("events").select(k.alias("change_id"), text.alias("statement"))
    c = F.col("c_custkey")
    issues = g.table("customer").where("c_custkey % 3 = 0").select(F.concat(F.when(c % 2 == 0, "WFLY-").otherwise("HHH-"), c.cast("string")).alias("issue"), F.col("c_name").alias("summary"))
    return parsers.enrich(changes, issues)


def _changelogs(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    sha = F.substring(F.md5((F.floor(k / 2)).cast("string")), 1, 12)
    badge = F.when(k % 3 != 0, F.concat(F.lit(" https://github.com/angular/angular/commit/"), sha)).otherwise("")
    row = lambda p, tag: p.select(F.concat(F.col("p_name"), (k % 50).cast("string"), F.lit(tag), badge).alias("statement"), k.alias("position"))
    return row(parts.where("p_partkey % 2 = 0"), " gh").unionByName(row(parts.where("p_partkey % 4 = 1"), "")), row(parts.where("p_partkey % 2 = 1"), "")


def changelog_overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.merge_changelogs(*_changelogs(_parts(spark, sf_dir)))


def commit_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    gh, _ = _changelogs(_parts(spark, sf_dir))
    prefix = F.substring(F.regexp_extract("statement", r"github\.com/angular/angular/commit/([0-9a-f]+)", 1), 1, 10)
    return gh.select("position", F.when(prefix != "", prefix).alias("prefix"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Graph(spark, sf_dir).rule
    return r.select(
        "framework", "sortable", "rule_id", F.col("rule_type").alias("type"), F.when(F.col("rule_id") % 2 == 0, "confirmed").otherwise("inferred").alias("confidence"),
        F.concat(F.lit("https://x.example/"), _s("rule_id")).alias("source_url"), F.concat(F.lit("rule|"), _s("rule_id"), F.lit("\n"), "scope").alias("statement"),
    )


def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.render(_changes(spark, sf_dir), ["framework", "sortable"], "rule_id")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown body per supplier, with headings, bullets and loose lines."""
    n = F.col("s_name")
    body = F.concat(
        F.lit("# Release "), _s("s_suppkey"), F.lit("\n- ab\n* first of "), n, F.lit("\n## Deprecations\n  - dropped "), n,
        F.lit("\nplain line\na longer loose line [#12] of "), n, F.lit("\n### Dependency Upgrades\n- bumped x\n## Behavior\n+ changed "), n,
    )
    return Graph(spark, sf_dir).table("supplier").select("s_suppkey", body.alias("body"))


def markdown_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.markdown_statements(_bodies(spark, sf_dir), "s_suppkey", "body")


def dependency_upgrades_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("s_suppkey", parsers.without_dependency_upgrades(F.col("body")).alias("body"))


def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per section of each document, a short line being a heading."""
    rows = parsers.lines(Graph(spark, sf_dir).table("documents"), "doc_id", "text")
    named = parsers.sections(rows, "doc_id", F.when((F.length("line") > 0) & (F.length("line") < 40), F.col("line_no")))
    return named.groupBy("doc_id", "section").agg(F.count("*").alias("lines"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).table("pages").select("page_id", parsers.html_text(F.col("html")).alias("text"))


def html_meta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).table("pages").select("page_id", parsers.html_summary(F.col("html")).alias("summary"))


def maven_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions read back from the registry XML of every framework."""
    v = Graph(spark, sf_dir).version
    xml = F.concat(
        F.lit('<metadata xmlns="http://maven.example/1"><versioning><versions>'),
        F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<version>"), "version", F.lit("</version>")))), ""), F.lit("</versions></versioning></metadata>"),
    )
    return v.groupBy("framework").agg(xml.alias("xml")).select("framework", F.explode(parsers.maven_versions(F.col("xml"))).alias("version"))


def npm_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Graph(spark, sf_dir).version
    json = F.concat(F.lit('{"name": "x", "versions": {'), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('"'), "version", F.lit('": {}')))), ", "), F.lit("}}"))
    return v.groupBy("framework").agg(json.alias("json")).select("framework", F.explode(parsers.npm_versions(F.col("json"))).alias("version"))


def managed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managed dependencies read back from a POM per supplier."""
    dep = F.concat(F.lit("<dependency><groupId>org.g</groupId><artifactId>a"), _s("s_suppkey"), F.lit("</artifactId><version>1."), _s("s_nationkey"), F.lit("</version></dependency>"))
    pom = F.concat(F.lit("<project><dependencyManagement><dependencies>"), dep, F.lit("</dependencies></dependencyManagement></project>"))
    rows = Graph(spark, sf_dir).table("supplier").select("s_suppkey", F.explode(parsers.managed_versions(pom)).alias("coordinates", "version"))
    return rows


def changelog_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit('intro <a name="1.0"></a> one '), F.col("s_name"), F.lit(' <a name="2.0"></a> two <a name="3.0"></a> three '), F.col("s_name"))
    return Graph(spark, sf_dir).table("supplier").select("s_suppkey", parsers.changelog_section(text, F.concat((k % 4 + 1).cast("string"), F.lit(".0"))).alias("section"))


def tags_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    base = F.concat_ws(".", (k % 9).cast("string"), (k % 13).cast("string"), (k % 4).cast("string"))
    tag = F.concat(_pick(["refs/tags/v", "refs/tags/", "refs/tags/lib/v", "refs/heads/"], k % 4), base, _pick(["", "rc1", ".post2", "^{}", "b3", "-x"], k % 6))
    return parsers.tag_versions(_parts(spark, sf_dir).select("p_partkey", tag.alias("tag"))).select("p_partkey", "version", "major", "minor", "patch", "phase", "number")


def build_file_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = k.cast("string")
    pom = F.when(k % 5 == 0, F.concat(F.lit("<project><parent><groupId>g</groupId>\n<artifactId>spring-boot-starter-parent</artifactId>\n<version>3."), n, F.lit("</version></parent></project>")))
    gradle = F.when(k % 5 <= 1, F.concat(F.lit("plugins { id 'org.springframework.boot' version '2."), n, F.lit("' }"))).when(k % 5 == 2, F.concat(F.lit('ext { springBootVersion = "1.'), n, F.lit('" }')))
    properties = F.when(k % 5 == 3, F.concat(F.lit("a=b\nspring.boot.version = 4."), n, F.lit(" # x")))
    package = F.when(k % 5 >= 3, F.concat(F.lit('{"dependencies": {"@angular/core": "^'), n, F.lit('.0.0"}}')))
    version, source = parsers.build_version(pom, gradle, properties, package)
    return Graph(spark, sf_dir).table("supplier").select("s_suppkey", version.alias("version"), source.alias("source"))


def java_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.concat(
        F.lit("package a;\nimport "), _pick(["org.springframework.web.Rest", "static jakarta.servlet.Filter.x", "com.acme.Tool"], k % 3), F.lit(";\nimport java.util.List;\n@Override @"),
        _pick(["Service", "Getter", "Nullable", "RestController"], k % 4), F.lit("\nclass A {}"),
    )
    return _parts(spark, sf_dir).select("p_partkey", F.explode(parsers.java_names(code)).alias("name"))


def yaml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# c\nserver:\n  port: 80\n  ssl:\n    key: "), F.col("s_name"), F.lit("\nspring:\n  main:\n    banner: off\nlist:\n  - a: 1\n"))
    return parsers.yaml_keys(Graph(spark, sf_dir).table("supplier").select("s_suppkey", body.alias("body")), "s_suppkey", "body")


def property_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# x\nserver.port = 80\nspring.main.a"), _s("s_nationkey"), F.lit("=b\n bad=1\nx=2\n"))
    return Graph(spark, sf_dir).table("supplier").select("s_suppkey", F.explode(parsers.property_keys(body)).alias("property"))


def namespace_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return parsers.rename_statements(spark, versions.hops(g.version.withColumn("sortable", F.col("sortable") + 2000000)))


def credential_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("clone https://user:"), F.col("c_name"), F.lit("@git.example/x.git and http://plain.example/"))
    return Graph(spark, sf_dir).table("customer").select("c_custkey", parsers.scrub(url).alias("text"))


def major_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops grouped by the major version they start from."""
    h = versions.hops(Graph(spark, sf_dir).version)
    return h.groupBy("framework", F.floor(F.col("hop_from") / 1000000).alias("major")).agg(F.count("*").alias("hops"), F.min("hop_from").alias("first"), F.max("hop_to").alias("last"))


QUERIES = {f.__name__: f for f in (
    classify_statement, stability_marker, ga_filter, release_filter, semver_compatible, jira_enrich, changelog_overlap_dedup, commit_prefix, markdown_render, markdown_parse,
    dependency_upgrades_stripped, heading_sections, html_to_text, html_meta_summary, maven_versions, npm_versions, managed_versions, changelog_section, tags_sorted,
    build_file_version, java_scan, yaml_scan, property_scan, namespace_renames, credential_scrub, major_ranges,
)}

_SECTION = "[" + ", ".join(f"'{s}'" for s in SECTIONS) + "][p_partkey % 8 + 1]"
_VERSIONS = "v AS (SELECT p_partkey, p_partkey % 23 || '.' || p_partkey % 7 || '.' || p_partkey % 11 || ['', '.Final', '-RC1', '.Beta1', '.SP1'][p_partkey % 5 + 1] AS version FROM part)"
_CLASSIFY = """CASE WHEN regexp_matches(t, '(?i)breaking') THEN '{}' WHEN regexp_matches(t, '(?i)deprecat') THEN '{}' WHEN regexp_matches(t, '(?i)mandatory|migration|upgrade guide') THEN '{}'
  WHEN regexp_matches(t, '(?i)dependency|bom|component') THEN '{}' WHEN regexp_matches(t, '(?i)security|cve') THEN '{}' WHEN regexp_matches(t, '(?i)behavior') THEN '{}' WHEN contains(t, '/subsystem=') THEN '{}' ELSE '{}' END"""
_TYPE = _CLASSIFY.format("breaking", "deprecation", "mandatory_migration", "dependency_upgrade", "mandatory_migration", "behavioral", "mandatory_migration", "behavioral")
_SURE = _CLASSIFY.format("confirmed", "confirmed", "confirmed", "inferred", "confirmed", "inferred", "confirmed", "inferred")
_LOGS = """r AS (SELECT p_partkey AS k, p_name || p_partkey % 50 AS head, CASE WHEN p_partkey % 3 <> 0 THEN ' https://github.com/angular/angular/commit/' || left(md5(CAST(p_partkey // 2 AS VARCHAR)), 12) ELSE '' END AS badge FROM part),
gh AS (SELECT head || ' gh' || badge AS statement, k AS position FROM r WHERE k % 2 = 0 UNION ALL SELECT head || badge, k FROM r WHERE k % 4 = 1), cl AS (SELECT head || badge AS statement, k AS position FROM r WHERE k % 2 = 1),
ghc AS (SELECT *, left(regexp_extract(statement, 'github\\.com/angular/angular/commit/([0-9a-f]+)', 1), 10) AS c FROM gh), clc AS (SELECT *, left(regexp_extract(statement, 'github\\.com/angular/angular/commit/([0-9a-f]+)', 1), 10) AS c FROM cl)""".replace("\\\\", "\\")
_BODY = """b AS (SELECT s_suppkey, '# Release ' || s_suppkey || chr(10) || '- ab' || chr(10) || '* first of ' || s_name || chr(10) || '## Deprecations' || chr(10) || '  - dropped ' || s_name || chr(10) || 'plain line' || chr(10)
  || 'a longer loose line [#12] of ' || s_name || chr(10) || '### Dependency Upgrades' || chr(10) || '- bumped x' || chr(10) || '## Behavior' || chr(10) || '+ changed ' || s_name AS body FROM supplier)"""
_HTML = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<h[1-6][^>]*>', chr(10) || '# ', 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|br|ul|ol|h[1-6]|nav|footer|header|title)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM c)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS text FROM d"""

ORACLES = {
    "classify_statement": f"WITH x AS (SELECT p_partkey, 'Notes ' || {_SECTION} || ' ' || p_name AS t FROM part) SELECT p_partkey, {_TYPE} AS type, {_SURE} AS confidence FROM x",
    "stability_marker": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'experimental' WHEN 1 THEN 'preview' WHEN 3 THEN 'community' END AS stability FROM part",
    "ga_filter": f"""WITH {_VERSIONS}, f AS (SELECT *, regexp_matches(version, '^\\d+\\.\\d+\\.\\d+\\.Final$') AS jboss, regexp_matches(version, '^\\d+\\.\\d+\\.\\d+$') AS plain FROM v)
SELECT p_partkey, version, jboss, plain OR (jboss AND CAST(split_part(version, '.', 1) AS INTEGER) < 16) AS infinispan, plain FROM f""",
    "release_filter": f"""WITH {_VERSIONS}, p AS (SELECT DISTINCT version, regexp_extract_all(version, '\\d+') AS n FROM v WHERE regexp_matches(version, '^\\d+\\.\\d+\\.\\d+(\\.Final)?$'))
SELECT version, CAST(n[1] AS BIGINT) * 1000000 + CAST(n[2] AS BIGINT) * 1000 + CAST(n[3] AS BIGINT) AS key FROM p""",
    "semver_compatible": "SELECT p_partkey, p_partkey % 3 = p_partkey % 4 AND p_partkey % 5 * 1000 + p_partkey % 7 >= p_partkey % 3 * 1000 + p_partkey % 9 AS compatible FROM part",
    "jira_enrich": """WITH i AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'WFLY-' ELSE 'HHH-' END || c_custkey AS issue, c_name AS summary FROM customer WHERE c_custkey % 3 = 0),
k AS (SELECT event_id, 'WFLY-' || event_id % 300 AS a, 'HHH-' || event_id % 170 AS b FROM events)
SELECT event_id AS change_id, CASE WHEN x.issue IS NULL AND y.issue IS NOT NULL THEN b ELSE a END AS issue, coalesce(x.summary, y.summary) AS summary FROM k LEFT JOIN i x ON x.issue = a LEFT JOIN i y ON y.issue = b""",
    "changelog_overlap_dedup": f"""WITH {_LOGS}, share AS (SELECT count(*) FILTER (c IN (SELECT c FROM clc)) / count(*) >= 0.95 AS drop_ FROM (SELECT DISTINCT c FROM ghc WHERE c <> '')),
u AS (SELECT statement, 0 AS source, position FROM ghc, share WHERE statement NOT IN (SELECT statement FROM cl) AND NOT (drop_ AND c <> '' AND c IN (SELECT c FROM clc)) UNION ALL SELECT statement, 1, position FROM cl)
SELECT statement, CAST(source AS INTEGER) AS source, position FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY source, position) AS rn FROM u) WHERE rn = 1""",
    "commit_prefix": f"WITH {_LOGS} SELECT position, nullif(c, '') AS prefix FROM ghc",
    "markdown_render": BASE + """SELECT framework, sortable, '| Type | Confidence | Source | Statement |' || chr(10) || '|---|---|---|---|' || chr(10)
  || string_agg('| ' || rule_type || ' | ' || CASE WHEN rule_id % 2 = 0 THEN 'confirmed' ELSE 'inferred' END || ' | https://x.example/' || rule_id || ' | rule ' || rule_id || ' ' || scope || ' |', chr(10) ORDER BY rule_id) AS markdown FROM rule GROUP BY 1, 2""",
    "markdown_parse": f"""WITH {_BODY}, l AS (SELECT s_suppkey, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS n FROM b),
h AS (SELECT *, nullif(regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1), '') AS heading FROM l), s AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY s_suppkey ORDER BY n) AS section FROM h),
m AS (SELECT s_suppkey, n, section, CASE WHEN heading IS NOT NULL THEN NULL WHEN regexp_matches(line, '^\\s*[-*+]\\s+.+$') THEN CASE WHEN length(trim(regexp_extract(line, '^\\s*[-*+]\\s+(.+)$', 1))) >= 4 THEN trim(regexp_extract(line, '^\\s*[-*+]\\s+(.+)$', 1)) END
  WHEN length(trim(line)) > 20 AND contains(line, '[') THEN trim(line) END AS statement FROM s), x AS (SELECT *, section || ' ' || statement AS t FROM m WHERE statement IS NOT NULL)
SELECT s_suppkey, CAST(n AS INTEGER) AS line_no, section, statement, {_TYPE} AS type, {_SURE} AS confidence FROM x""",
    "dependency_upgrades_stripped": f"WITH {_BODY} SELECT s_suppkey, replace(body, '### Dependency Upgrades' || chr(10) || '- bumped x' || chr(10), '') AS body FROM b",
    "heading_sections": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
s AS (SELECT doc_id, last_value(CASE WHEN length(line) > 0 AND length(line) < 40 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l) SELECT doc_id, CAST(section AS INTEGER) AS section, count(*) AS lines FROM s GROUP BY 1, 2""",
    "html_to_text": _HTML,
    "html_meta_summary": r"""WITH x AS (SELECT page_id, trim(regexp_extract(html, '(?is)<meta\s+name=["'']description["'']\s+content=["'']([^"'']*)["'']', 1)) AS m,
  trim(regexp_extract(html, '(?is)<meta\s+property=["'']og:description["'']\s+content=["'']([^"'']*)["'']', 1)) AS o,
  list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda t: trim(regexp_replace(t, '(?s)<[^>]*>', '', 'g'))), lambda t: length(t) >= 80) AS ps FROM pages)
SELECT page_id, CASE WHEN m <> '' THEN m WHEN o <> '' THEN o ELSE ps[1] END AS summary FROM x""",
    "maven_versions": BASE + "SELECT framework, version FROM version",
    "npm_versions": BASE + "SELECT framework, version FROM version",
    "managed_versions": "SELECT s_suppkey, 'org.g:a' || s_suppkey AS coordinates, '1.' || s_nationkey AS version FROM supplier",
    "changelog_section": """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '<a name="1.0"></a> one ' || s_name WHEN 1 THEN '<a name="2.0"></a> two' WHEN 2 THEN '<a name="3.0"></a> three ' || s_name ELSE '' END AS section FROM supplier""",
    "tags_sorted": r"""WITH t AS (SELECT p_partkey, ['refs/tags/v', 'refs/tags/', 'refs/tags/lib/v', 'refs/heads/'][p_partkey % 4 + 1] || p_partkey % 9 || '.' || p_partkey % 13 || '.' || p_partkey % 4 || ['', 'rc1', '.post2', '^{}', 'b3', '-x'][p_partkey % 6 + 1] AS tag FROM part),
v AS (SELECT p_partkey, regexp_extract(tag, '^refs/tags/(?:.*/)?v?(\d+(?:\.\d+)*(?:(?:\.|-)?(?:a|b|rc|post)\d+)?)$', 1) AS version FROM t)
SELECT p_partkey, version, p_partkey % 9 AS major, p_partkey % 13 AS minor, p_partkey % 4 AS patch,
  CAST(CASE WHEN contains(version, 'rc') THEN 2 WHEN contains(version, 'post') THEN 4 WHEN contains(version, 'b') THEN 1 ELSE 3 END AS INTEGER) AS phase, CASE p_partkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 0 END::BIGINT AS number FROM v WHERE version <> ''""",
    "build_file_version": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '3.' || s_suppkey WHEN 1 THEN '2.' || s_suppkey WHEN 2 THEN '1.' || s_suppkey WHEN 3 THEN '4.' || s_suppkey ELSE s_suppkey || '.0.0' END AS version,
  CASE s_suppkey % 5 WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'build.gradle' WHEN 2 THEN 'build.gradle' WHEN 3 THEN 'gradle.properties' ELSE 'package.json' END AS source FROM supplier""",
    "java_scan": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'org.springframework.web.Rest' ELSE 'jakarta.servlet.Filter.x' END AS name FROM part WHERE p_partkey % 3 <> 2
UNION ALL SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Service' ELSE 'RestController' END FROM part WHERE p_partkey % 4 IN (0, 3)""",
    "yaml_scan": "SELECT s_suppkey, unnest(['server.port', 'server.ssl.key', 'spring.main.banner']) AS property FROM supplier",
    "property_scan": "SELECT s_suppkey, unnest(['server.port', 'spring.main.a' || s_nationkey]) AS property FROM supplier",
    "namespace_renames": BASE + """, h AS (SELECT framework, sortable + 2000000 AS hop_from, lead(sortable + 2000000) OVER (PARTITION BY framework ORDER BY sortable) AS hop_to FROM version)
SELECT framework, hop_from, hop_to, 'javax.' || p || ' is now jakarta.' || p AS statement FROM h, (SELECT unnest([""" + ", ".join(f"'{p}'" for p in parsers.RENAMED) + """]) AS p) WHERE hop_from < 9000000 AND hop_to >= 9000000""",
    "credential_scrub": "SELECT c_custkey, 'clone https://***@git.example/x.git and http://plain.example/' AS text FROM customer",
    "major_ranges": BASE + """, h AS (SELECT framework, sortable AS hop_from, lead(sortable) OVER (PARTITION BY framework ORDER BY sortable) AS hop_to FROM version)
SELECT framework, hop_from // 1000000 AS major, count(*) AS hops, min(hop_from) AS first, max(hop_to) AS last FROM h WHERE hop_to IS NOT NULL GROUP BY 1, 2""",
}
