"""Release notes end to end: texts of every form, coordinates of a code base, and one framework's hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris.functions import exprs
from verdigris.operators import versions
from verdigris.plans.base_sql import BASE
from verdigris.sources import parsers
from verdigris.sources.graph import Graph


def release_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all documents: Markdown, else pairs of lines."""
    return parsers.release_statements(Graph(spark, sf_dir).table("documents"), "doc_id", "text")


def release_page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of web pages as plain text, which has bullets and headings."""
    pages = Graph(spark, sf_dir).table("pages").select("page_id", parsers.html_text(F.col("html")).alias("text"))
    return parsers.release_statements(pages, "page_id", "text").groupBy("page_id").agg(F.count("*").alias("statements"), F.count_distinct("section").alias("sections"))


def asciidoc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of documents whose lines are dealt to headings, bullets, short bullets and prose."""
    k = F.col("line_no")
    docs = parsers.lines(Graph(spark, sf_dir).table("documents"), "doc_id", "text").withColumn(
        "line", F.when(k % 4 == 0, F.concat(F.lit("== Deprecated "), "line")).when(k % 4 == 1, F.concat(F.lit("- "), F.substring("line", 1, 30))).when(k % 4 == 2, F.concat(F.lit("* "), F.substring("line", 1, 3))).otherwise(F.concat(F.lit(" - "), "line"))
    )
    bodies = docs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return parsers.asciidoc_statements(bodies, "doc_id", "text").select("doc_id", "line_no", "statement", "type")


def release_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release body of every supplier's snapshots: API answers that are missing, blank or there, and pages."""
    n, k = F.col("s_name"), F.col("s_suppkey")
    rows = Graph(spark, sf_dir).table("supplier").select("s_suppkey", n, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank"))
    url = F.concat(F.lit("https://x.example/"), k.cast("string"), F.lit("/"), F.col("rank").cast("string"))
    json = F.when((k + F.col("rank")) % 3 == 0, F.to_json(F.struct(F.when(k % 2 == 0, F.concat(F.lit("- body of "), n)).otherwise(F.lit("  ")).alias("body"), F.when(k % 4 == 0, F.concat(url, F.lit("#html"))).alias("html_url"))))
    html = F.when((k + F.col("rank")) % 4 > 1, F.concat(F.lit('<html><div class="x markdown-body y">\n<p>page of '), n, F.lit("</p> <b>"), F.col("rank").cast("string"), F.lit("</b>\n</div></html>"))).otherwise("<html><div>none</div></html>")
    return parsers.release_body(rows.select("s_suppkey", "rank", url.alias("url"), json.alias("json"), html.alias("html")), "s_suppkey")


def coordinate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates in the POM and the Gradle file of every supplier, of kept groups only."""
    n, k = F.col("s_name"), F.col("s_suppkey")
    group = F.get(F.array(*map(F.lit, ["org.springframework.boot", "com.acme", "io.undertow.core", "jakarta.servlet"])), (k % 4).cast("int"))
    artifact = F.concat(F.lit("a"), k.cast("string"))
    pom = F.concat(
        F.lit('<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies><dependency>\n<artifactId> '), artifact, F.lit(" </artifactId>\n<groupId>"), group,
        F.lit("</groupId></dependency><dependency><groupId>org.hibernate.orm</groupId></dependency></dependencies></project>"),
    )
    gradle = F.concat(F.lit("dependencies {\n  implementation '"), group, F.lit(":g-"), artifact, F.lit(":1.0'\n  api(\"io.undertow.x:yy:"), n, F.lit('")\n  test "io.undertow.x:zz:2"\n}\n version "3.'), k.cast("string"), F.lit('"'))
    found = F.concat(F.transform(parsers.maven_coordinates(pom), lambda x: F.struct(F.lit("maven").alias("file"), x.alias("name"))), F.transform(parsers.gradle_coordinates(gradle), lambda x: F.struct(F.lit("gradle").alias("file"), x.alias("name"))))
    return Graph(spark, sf_dir).table("supplier").select("s_suppkey", parsers.gradle_version(gradle).alias("version"), F.explode_outer(found).alias("f")).select("s_suppkey", "version", "f.*")


def issue_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and description of issues: REST answer, page preview, or the key alone."""
    k, n = F.col("s_suppkey"), F.col("s_name")
    json = F.when(k % 3 == 0, F.to_json(F.struct(F.struct(F.when(k % 2 == 0, n).alias("summary"), F.concat(F.lit(" d "), n).alias("description")).alias("fields"))))
    html = F.when(k % 3 == 1, F.concat(F.lit('<head><meta property="og:title" content="t '), n, F.lit('"/><meta name="description" content=" x "/></head>')))
    summary, description = parsers.issue_fields(json, html, F.concat(F.lit("WFLY-"), k.cast("string")))
    return Graph(spark, sf_dir).table("supplier").select("s_suppkey", summary.alias("summary"), description.alias("description"))


def framework_changes(spark: SparkSession, hops: DataFrame, releases: DataFrame, wikis: DataFrame) -> DataFrame:
    """Changes of every hop: statements of the release body, of the wiki page, and of its upgrade chapter, as they come.

    ``releases`` and ``wikis``: (framework, hop_to, body).  Chapters of
    dependency upgrades are left out; a hop without any text has no rows.
    """
    key = F.concat_ws("|", "framework", F.col("hop_to").cast("string")).alias("hop")
    own = hops.select("framework", "hop_from", "hop_to", key)
    bodies = releases.select(key, parsers.without_dependency_upgrades(F.col("body")).alias("body"))
    pages = wikis.select(key, parsers.without_dependency_upgrades(F.col("body")).alias("body"))
    said = [parsers.release_statements(bodies, "hop", "body"), parsers.release_statements(pages, "hop", "body"), parsers.upgrade_prose(pages, "hop", "body")]
    bag = None
    for source, rows in zip(("release", "wiki", "upgrade"), said):
        rows = rows.select("hop", F.lit(source).alias("source"), "line_no", "statement", "type", "confidence")
        bag = rows if bag is None else bag.unionByName(rows)
    return own.join(bag, "hop").drop("hop")


def extracted_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hops of all frameworks with the changes that release bodies and wiki pages tell of."""
    g = Graph(spark, sf_dir)
    hops = versions.hops(g.version)
    to, where = F.col("hop_to").cast("string"), F.col("hop_to") % 3000
    body = F.concat(F.lit("## Breaking changes\n- change in "), to, F.lit("\n* ab\n### Dependency Upgrades\n- bumped x\n## Deprecations\n- dropped in "), to)
    plain = F.concat(F.lit("bug Fixes\nfix the thing: "), to, F.lit("\nits detail: x\n\nlast one: "), to)
    wiki = F.concat(F.lit("# Notes\n### Early\nnot this\n## Upgrading from before\n### Heap dump\nfirst of "), to, F.lit("\n\n second\n### Empty\n### Removed API\nbreaking it\n## New\n### Later\nno\n- new bullet "), to)
    releases = hops.where(where != 0).select("framework", "hop_to", F.when(where == 1000, body).otherwise(plain).alias("body"))
    return framework_changes(spark, hops, releases, hops.where("hop_to % 5000 < 2000").select("framework", "hop_to", wiki.alias("body")))


def guide_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of migration guides: AsciiDoc from major 6 on where the text is AsciiDoc, else Markdown."""
    g = Graph(spark, sf_dir)
    to = F.col("sortable").cast("string")
    ascii_doc = F.concat(F.lit("= Guide\n== Removed\n- dropped in "), to, F.lit("\n# not a heading\n* breaking "), to)
    markdown = F.concat(F.lit("# Guide\n== x\n- kept in "), to)
    guides = g.version.select("framework", "sortable", F.when(F.col("sortable") % 2000 == 0, ascii_doc).otherwise(markdown).alias("body"))
    return parsers.guide_statements(guides.withColumn("guide", F.concat_ws("|", "framework", to)), "guide", "body", F.floor(F.col("sortable") / 1000000)).select("guide", "line_no", "statement", "type")


def platform_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the enterprise platform: those of the server versions between the bases of its versions, by a range join."""
    g = Graph(spark, sf_dir)
    table = spark.createDataFrame(parsers.PLATFORM_VERSIONS, "version string, short string, base string").select("version", F.lit("ASIA").alias("framework"), exprs.sortable(F.col("version")).alias("own"), exprs.sortable(F.col("base")).alias("sortable"))
    hops = versions.hops(table, "sortable").select(F.col("hop_to").alias("context_id"), "framework", F.col("hop_from").alias("from_sortable"), F.col("hop_to").alias("to_sortable"))
    base = g.version.where("framework = 'ASIA'").select("framework", (F.col("sortable") * 4).alias("sortable"))
    steps = versions.on_path(hops, base)
    rules = g.rule.where("framework = 'ASIA'").groupBy((F.col("sortable") * 4).alias("sortable"), "rule_type").agg(F.count("*").alias("rules"))
    named = table.select("version", F.col("sortable").alias("context_id"))
    return steps.join(rules, "sortable").join(named, "context_id").groupBy("version", "rule_type").agg(F.sum("rules").alias("rules"))


def insight_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights in a range of versions that name an entity, with the instruction of their first step."""
    g = Graph(spark, sf_dir)
    k = F.col("insight_id")
    rows = g.insight.select("insight_id", "statement", ((k % 7 + 1) * 1000000).cast("long").alias("sortable"))
    entities = rows.select("insight_id", F.explode(F.array(*[F.concat(F.lit("e"), ((k * m) % 13).cast("string")) for m in (1, 3, 5)])).alias("name"))
    named = entities.groupBy("insight_id").agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.array_contains("names", "e3"))
    first = g.step.groupBy(F.col("rule_id").alias("insight_id")).agg(F.min_by("instruction", "step_index").alias("instruction"))
    kept = rows.where(exprs.between_or_open(F.col("sortable"), 2000000, None)).join(named, "insight_id").join(first, "insight_id", "left")
    found = kept.where(exprs.mentions("The", F.col("statement"), F.col("instruction")))
    return found.select("insight_id", "sortable", F.array_join("names", ",").alias("names"), F.coalesce("instruction", F.lit("")).alias("solution"))


QUERIES = {f.__name__: f for f in (release_text_parse, release_page_parse, asciidoc_parse, release_bodies, coordinate_scan, issue_fields, extracted_changes, guide_changes, platform_changes, insight_solutions)}

_CLASSIFY = """CASE WHEN regexp_matches({t}, '(?i)breaking') THEN '{0}' WHEN regexp_matches({t}, '(?i)deprecat') THEN '{1}' WHEN regexp_matches({t}, '(?i)mandatory|migration|upgrade guide') THEN '{2}'
  WHEN regexp_matches({t}, '(?i)dependency|bom|component') THEN '{3}' WHEN regexp_matches({t}, '(?i)security|cve') THEN '{4}' WHEN regexp_matches({t}, '(?i)behavior') THEN '{5}' WHEN contains({t}, '/subsystem=') THEN '{6}' ELSE '{7}' END"""
_T = "(coalesce(section, '') || ' ' || statement)"
_TYPE = _CLASSIFY.format("breaking", "deprecation", "mandatory_migration", "dependency_upgrade", "mandatory_migration", "behavioral", "mandatory_migration", "behavioral", t=_T)
_SURE = _CLASSIFY.format("confirmed", "confirmed", "confirmed", "inferred", "confirmed", "inferred", "confirmed", "inferred", t=_T)


def _release_sql(table: str, key: str, text: str) -> str:
    """CTE ``statements`` (key, line_no, section, statement): Markdown, else pairs of lines."""
    return f"""ln AS (SELECT {key} AS k, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) - 1 AS line_no FROM {table}),
hd AS (SELECT *, regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1) AS h, regexp_extract(line, '^\\s*[-*+]\\s+(.+)$', 1) AS b FROM ln),
sc AS (SELECT *, last_value(CASE WHEN h <> '' THEN trim(h) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY line_no) AS section FROM hd),
md AS (SELECT k, line_no, section, CASE WHEN b <> '' THEN trim(b) ELSE trim(line) END AS statement FROM sc
  WHERE h = '' AND CASE WHEN b <> '' THEN length(trim(b)) >= 4 ELSE length(trim(line)) > 20 AND contains(line, '[') END),
st AS (SELECT k, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM ln WHERE k NOT IN (SELECT k FROM md)),
fl AS (SELECT *, s = '' OR regexp_matches(s, '^#\\d+$') AS blank,
  regexp_matches(s, '(?i)^(⭐|🐞|💥|🛠|📔|🚨|‼️|\\*\\*)?.{{0,3}}(New Features|Bug Fixes|Breaking Changes|Deprecat|Documentation|Dependency|Changes|Enhancement)')
    OR (length(s) < 80 AND regexp_matches(s, '^\\p{{Lu}}') AND NOT contains(s, ':')) AS opens FROM st),
rn AS (SELECT *, count(*) FILTER (blank OR opens) OVER (PARTITION BY k ORDER BY line_no) AS run, coalesce(last_value(CASE WHEN opens AND NOT blank THEN s END IGNORE NULLS) OVER (PARTITION BY k ORDER BY line_no), '') AS section FROM fl),
pl AS (SELECT *, (row_number() OVER (PARTITION BY k, run ORDER BY line_no) - 1) // 2 AS pair FROM rn WHERE NOT blank AND NOT opens),
pr AS (SELECT k, min(line_no) AS line_no, min(section) AS section, CASE count(*) WHEN 2 THEN min_by(s, line_no) || ' (' || max_by(s, line_no) || ')' ELSE min(s) END AS statement FROM pl GROUP BY k, run, pair),
statements AS (SELECT k, CAST(line_no AS INTEGER) AS line_no, section, statement FROM md UNION ALL SELECT k, CAST(line_no AS INTEGER), section, statement FROM pr WHERE length(statement) >= 8)"""


_HTML = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?i)<h[1-6][^>]*>', chr(10) || '# ', 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g'),
  '(?i)</?(p|div|br|ul|ol|h[1-6]|nav|footer|header|title)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))"""

ORACLES = {
    "release_text_parse": f"WITH {_release_sql('documents', 'doc_id', 'text')} SELECT k AS doc_id, line_no, section, statement, {_TYPE} AS type, {_SURE} AS confidence FROM statements",
    "release_page_parse": f"WITH pg AS (SELECT page_id, {_HTML} AS body FROM pages), {_release_sql('pg', 'page_id', 'body')} SELECT k AS page_id, count(*) AS statements, count(DISTINCT section) AS sections FROM statements GROUP BY 1",
    "asciidoc_parse": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
d AS (SELECT doc_id, n, CASE n % 4 WHEN 0 THEN '== Deprecated ' || line WHEN 1 THEN '- ' || left(line, 30) WHEN 2 THEN '* ' || left(line, 3) ELSE ' - ' || line END AS line FROM l),
s AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(line, '=') THEN trim(ltrim(line, '=')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), '') AS section FROM d),
r AS (SELECT doc_id, n, section, trim(line[3:]) AS statement FROM s WHERE (starts_with(line, '- ') OR starts_with(line, '* ')) AND length(trim(line[3:])) >= 4)
SELECT doc_id, CAST(n AS INTEGER) AS line_no, statement, {_TYPE} AS type FROM r""",
    "release_bodies": """WITH r AS (SELECT s_suppkey AS k, s_name AS n, rank FROM supplier, range(3) t(rank)), u AS (SELECT *, 'https://x.example/' || k || '/' || rank AS url FROM r),
a AS (SELECT k, n, url FROM u WHERE (k + rank) % 3 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank) = 1),
p AS (SELECT k, url, 'page of ' || n || chr(10) || rank AS body FROM u WHERE (k + rank) % 4 > 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank) = 1)
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN a.url || CASE WHEN s_suppkey % 4 = 0 THEN '#html' ELSE '' END ELSE p.url END AS url, CASE WHEN s_suppkey % 2 = 0 THEN '- body of ' || s_name ELSE p.body END AS body
FROM supplier LEFT JOIN a ON a.k = s_suppkey LEFT JOIN p ON p.k = s_suppkey WHERE s_suppkey % 2 = 0 OR p.k IS NOT NULL""",
    "coordinate_scan": """WITH g AS (SELECT s_suppkey, s_name, ['org.springframework.boot', 'com.acme', 'io.undertow.core', 'jakarta.servlet'][s_suppkey % 4 + 1] AS grp FROM supplier),
f AS (SELECT s_suppkey, 'maven' AS file, grp || ':a' || s_suppkey AS name FROM g WHERE s_suppkey % 4 IN (0, 2) UNION ALL SELECT s_suppkey, 'gradle', grp || ':g-a' || s_suppkey FROM g WHERE s_suppkey % 4 IN (0, 2)
  UNION ALL SELECT s_suppkey, 'gradle', 'io.undertow.x:yy' FROM g WHERE NOT regexp_matches(s_name, '\\s') UNION ALL SELECT s_suppkey, 'gradle', 'io.undertow.x:zz' FROM g)
SELECT s_suppkey, '3.' || s_suppkey AS version, file, name FROM f""".replace("\\\\", "\\"),
    "issue_fields": """SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 't ' || s_name ELSE 'WFLY-' || s_suppkey END AS summary,
  CASE s_suppkey % 3 WHEN 0 THEN 'd ' || s_name WHEN 1 THEN 'x' ELSE '' END AS description FROM supplier""",
    "extracted_changes": BASE + """, h AS (SELECT framework, sortable AS hop_from, lead(sortable) OVER (PARTITION BY framework ORDER BY sortable) AS hop_to FROM version),
k AS (SELECT * FROM h WHERE hop_to IS NOT NULL),
md AS (SELECT * FROM k WHERE hop_to % 3000 = 1000), pt AS (SELECT * FROM k WHERE hop_to % 3000 = 2000), wk AS (SELECT * FROM k WHERE hop_to % 5000 < 2000)
SELECT framework, hop_from, hop_to, 'release' AS source, 1 AS line_no, 'change in ' || hop_to AS statement, 'breaking' AS type, 'confirmed' AS confidence FROM md
UNION ALL SELECT framework, hop_from, hop_to, 'release', 4, 'dropped in ' || hop_to, 'deprecation', 'confirmed' FROM md
UNION ALL SELECT framework, hop_from, hop_to, 'release', 1, 'fix the thing: ' || hop_to || ' (its detail: x)', 'behavioral', 'inferred' FROM pt
UNION ALL SELECT framework, hop_from, hop_to, 'release', 4, 'last one: ' || hop_to, 'behavioral', 'inferred' FROM pt
UNION ALL SELECT framework, hop_from, hop_to, 'wiki', 14, 'new bullet ' || hop_to, 'behavioral', 'inferred' FROM wk
UNION ALL SELECT framework, hop_from, hop_to, 'upgrade', 4, 'Heap dump: first of ' || hop_to || ' second', 'behavioral', 'inferred' FROM wk
UNION ALL SELECT framework, hop_from, hop_to, 'upgrade', 9, 'Removed API: breaking it', 'breaking', 'confirmed' FROM wk""",
    "guide_changes": BASE + """SELECT framework || '|' || sortable AS guide, n AS line_no, CASE WHEN sortable % 2000 = 0 AND sortable >= 6000000 THEN CASE n WHEN 2 THEN 'dropped in ' ELSE 'breaking ' END WHEN sortable % 2000 = 0 THEN CASE n WHEN 2 THEN 'dropped in ' ELSE 'breaking ' END ELSE 'kept in ' END || sortable AS statement,
  CASE WHEN sortable % 2000 = 0 AND n = 4 THEN 'breaking' ELSE 'behavioral' END AS type FROM version, (VALUES (2), (4)) t(n) WHERE sortable % 2000 = 0 OR n = 2""",
    "platform_changes": BASE + f""", t AS (SELECT version, CAST(string_split(base, '.')[1] AS BIGINT) * 1000000 + CAST(string_split(base, '.')[2] AS BIGINT) * 1000 + CAST(string_split(base, '.')[3] AS BIGINT) AS b
  FROM (VALUES {", ".join(f"('{v}', '{b}')" for v, _, b in parsers.PLATFORM_VERSIONS)}) x(version, base)),
h AS (SELECT version, b AS hi, lag(b) OVER (ORDER BY b) AS lo FROM t)
SELECT version, rule_type, count(*) AS rules FROM h JOIN rule ON framework = 'ASIA' AND sortable * 4 > lo AND sortable * 4 <= hi GROUP BY 1, 2""",
    "insight_solutions": BASE + """, n AS (SELECT insight_id, statement, CAST((insight_id % 7 + 1) * 1000000 AS BIGINT) AS sortable, list_sort(list_distinct(['e' || insight_id % 13, 'e' || insight_id * 3 % 13, 'e' || insight_id * 5 % 13])) AS names FROM insight),
f AS (SELECT rule_id, min_by(instruction, step_index) AS instruction FROM step GROUP BY 1)
SELECT insight_id, sortable, array_to_string(names, ',') AS names, coalesce(instruction, '') AS solution FROM n LEFT JOIN f ON rule_id = insight_id
WHERE sortable >= 2000000 AND list_contains(names, 'e3') AND (contains(lower(statement), 'the') OR contains(lower(coalesce(instruction, '')), 'the'))""",
}
