"""Readers of release notes, build files and registries, as column expressions.

Every function takes a DataFrame with a text column; the network is out of
scope, snapshots are tables or files read with Spark's own readers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from verdigris.functions import exprs

#: Package prefixes that a scanner keeps, and annotations it ignores.
SCAN_KEEP = (
    r"^(org\.springframework|jakarta\.|javax\.|org\.hibernate|io\.micrometer|io\.projectreactor|org\.thymeleaf|com\.fasterxml\.jackson|tools\.jackson"
    r"|org\.springdoc|com\.querydsl|org\.flywaydb|org\.liquibase|org\.apache\.tomcat|org\.eclipse\.jetty|io\.undertow)"
)
NOISE = (
    "Override", "Deprecated", "SuppressWarnings", "FunctionalInterface", "SafeVarargs", "Data", "Builder", "Getter", "Setter", "ToString",
    "EqualsAndHashCode", "NoArgsConstructor", "AllArgsConstructor", "RequiredArgsConstructor", "Slf4j", "Value", "NonNull", "Nullable",
)

#: Fixed value: lines that open a section of plain release text.
SECTION_LINE = r"(?i)^(⭐|🐞|💥|🛠|📔|🚨|‼️|\*\*)?.{0,3}(New Features|Bug Fixes|Breaking Changes|Deprecat|Documentation|Dependency|Changes|Enhancement)"

#: Groups whose coordinates a scanner keeps, and coordinates in a Gradle file.
COORDINATES_KEEP = (
    r"^(org\.springframework|jakarta\.|javax\.|org\.hibernate|io\.micrometer|io\.projectreactor|com\.fasterxml\.jackson|org\.springdoc|com\.querydsl"
    r"|org\.flywaydb|org\.liquibase|org\.apache\.tomcat|org\.eclipse\.jetty|io\.undertow)\."
)
GRADLE_COORDINATES = r"""['"]([a-zA-Z][\w.-]+:[a-zA-Z][\w.-]+):[^\s"']+['"]"""

#: Versions of the enterprise platform, their short names and the server they are built on.
PLATFORM_VERSIONS = (("7.0.0", "7.0", "10.1.0"), ("7.1.0", "7.1", "11.0.0"), ("7.2.0", "7.2", "13.0.0"), ("7.3.0", "7.3", "18.0.0"), ("7.4.0", "7.4", "26.1.0"), ("8.0.0", "8.0", "29.0.0"))

#: Classes known to be deprecated, since when, and what replaces them.
DEPRECATED_CLASSES = (
    ("RestTemplate", "Spring Boot", "3.2.0", "RestClient"), ("WebSecurityConfigurerAdapter", "Spring Boot", "3.0.0", None), ("WebMvcConfigurerAdapter", "Spring Boot", "3.0.0", None),
    ("WebMvcConfigurer", "Spring Boot", "3.0.0", None), ("EnvironmentPostProcessor", "Spring Boot", "3.0.0", None),
)

#: Alerts of version 4.0.0: message, category and phase.
ALERTS = (
    ("Spring Security 7 changes the default CSRF policy — review all state-changing endpoints.", "security", "pre-migration"),
    ("Spring Boot 4 drops Java 8/11 support — migrate to Java 17+ before upgrading.", "dependency", "pre-migration"),
    ("Spring MVC and WebFlux auto-configuration have been restructured — review custom WebMvcConfigurer implementations.", "api", "migration"),
    ("Property namespaces changed in Spring Boot 4 — run the properties migrator during upgrade.", "config", "migration"),
    ("Actuator endpoints have moved to /actuator/** by default — update health-check URLs post-migration.", "config", "post-migration"),
)

#: Packages that were renamed with version 9.
RENAMED = (
    "annotation", "batch", "ejb", "el", "enterprise", "faces", "inject", "interceptor", "jms", "json", "mail", "persistence", "resource",
    "security.auth.message", "security.enterprise", "servlet", "transaction", "validation", "websocket", "ws.rs", "xml.bind", "xml.ws",
)

ENTITY_BATCH = T.StructType(
    [
        T.StructField("source_section", T.StringType()), T.StructField("title", T.StringType()), T.StructField("jira_keys", T.ArrayType(T.StringType())),
        T.StructField("source_url", T.StringType()), T.StructField("change_type", T.StringType()), T.StructField("reason_type", T.StringType()), T.StructField("reason", T.StringType()),
        T.StructField("scopes", T.ArrayType(T.StructType([T.StructField("scope", T.StringType()), T.StructField("severity", T.StringType())]))),
        T.StructField("entities", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "name", "role")]))),
        T.StructField(
            "steps",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("index", T.IntegerType()), T.StructField("step_type", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("instruction", T.StringType()),
                        T.StructField("effort", T.StringType()), T.StructField("automatable", T.BooleanType()), T.StructField("requires", T.ArrayType(T.IntegerType())),
                        T.StructField("verification", T.StringType()), T.StructField("cli_operation", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("subsystem", T.StringType()),
    ]
)


def entity_batches(spark: SparkSession, path: str) -> DataFrame:
    """Schema-checked entity batches (``{"entities": [...]}`` files); a malformed file fails."""
    schema = T.StructType([T.StructField("entities", T.ArrayType(ENTITY_BATCH))])
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("entities").alias("e")).select("e.*")


def insight_dumps(spark: SparkSession, camel: str, snake: str) -> DataFrame:
    """Community insights of both key styles under one schema."""
    return one_style(spark.read.option("multiLine", True).json(camel), spark.read.option("multiLine", True).json(snake))


def one_style(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of both key styles under the snake-case names; a column that one lacks is null."""
    renames = {
        "sourceUrl": "source_url", "evidence_url": "source_url", "frameworkVersion": "framework_version", "spring_boot_version": "framework_version",
        "affectedDependencies": "affected_dependencies", "affectedProperties": "affected_properties", "affectedClasses": "affected_classes",
    }
    return one.withColumnsRenamed(renames).unionByName(two.withColumnsRenamed(renames), allowMissingColumns=True)


def maven_versions(xml: Column) -> Column:
    return F.xpath(xml, F.lit("//*[local-name()='version']/text()"))


def npm_versions(json: Column) -> Column:
    return F.map_keys(F.from_json(F.get_json_object(json, "$.versions"), "map<string,string>"))


def managed_versions(pom: Column) -> Column:
    """Map of group:artifact to version of a POM's dependencyManagement."""
    base = "//*[local-name()='dependencyManagement']//*[local-name()='dependency']/*[local-name()='%s']/text()"
    g, a, v = (F.xpath(pom, F.lit(base % x)) for x in ("groupId", "artifactId", "version"))
    return F.map_from_arrays(F.zip_with(g, a, lambda x, y: F.concat_ws(":", x, y)), v)


def changelog_section(text: Column, version: Column) -> Column:
    """From the version's anchor up to the next one; '' if there is none."""
    anchor = F.concat(F.lit('<a name="'), version, F.lit('"></a>'))
    start = F.position(anchor, text)
    rest = F.substring(text, start + F.length(anchor), F.length(text))
    end = F.position(F.lit('<a name="'), rest)
    body = F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
    return F.when(start > 0, F.trim(F.concat(anchor, body))).otherwise("")


def html_text(html: Column) -> Column:
    """Headings as ``# ``, list items as ``- ``, paragraphs as lines; scripts and styles dropped."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<h[1-6][^>]*>", "\n# ")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|ul|ol|h[1-6]|nav|footer|header|title)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "&lt;", "<"), "&gt;", ">"), "&quot;", '"'), "&amp;", "&")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def html_summary(html: Column) -> Column:
    """The meta description, else that of the link preview, else the first paragraph of 80 characters or more."""
    meta = F.trim(F.regexp_extract(html, r"""(?is)<meta\s+name=["']description["']\s+content=["']([^"']*)["']""", 1))
    preview = F.trim(F.regexp_extract(html, r"""(?is)<meta\s+property=["']og:description["']\s+content=["']([^"']*)["']""", 1))
    plain = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), lambda p: F.trim(F.regexp_replace(p, r"(?s)<[^>]*>", "")))
    return F.when(meta != "", meta).when(preview != "", preview).otherwise(F.get(F.filter(plain, lambda p: F.length(p) >= 80), F.lit(0)))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line)"""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sections(rows: DataFrame, key: str, heading: Column) -> DataFrame:
    """Lines with the last heading above them, within one document."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", heading).withColumn("section", F.last("heading", ignorenulls=True).over(w))


def markdown_statements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Bullets of 4 characters or more, and other lines over 20 with a bracket, classified by section."""
    line = F.col("line")
    h = F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1)
    bullet = F.regexp_extract(line, r"^\s*[-*+]\s+(.+)$", 1)
    rows = sections(lines(docs, key, text), key, F.when(h != "", F.trim(h)))
    loose = (F.length(F.trim(line)) > 20) & F.contains(line, F.lit("["))
    statement = F.when(F.col("heading").isNotNull(), None).when(bullet != "", F.when(F.length(F.trim(bullet)) >= 4, F.trim(bullet))).when(loose, F.trim(line))
    kind, sure = exprs.classify(F.coalesce("section", F.lit("")), F.col("statement"))
    return rows.withColumn("statement", statement).where("statement is not null").select(key, "line_no", "section", "statement", kind.alias("type"), sure.alias("confidence"))


def release_statements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Statements of release texts: as Markdown where that gives any, else by pairs of lines.

    Plain text: blank lines, ``#`` with a number, and section lines break it
    into runs; within a run each odd line is a title, the even one after it
    its detail, joined as ``A (B)``.  Statements under 8 characters are left out.
    """
    as_markdown = markdown_statements(docs, key, text)
    s = F.col("stripped")
    blank = (s == "") | s.rlike(r"^#\d+$")
    short = (F.length(s) < 80) & s.rlike(r"^\p{Lu}") & ~F.contains(s, F.lit(":"))
    opens = ~blank & (s.rlike(SECTION_LINE) | short)
    rows = lines(docs.join(as_markdown.select(key).distinct(), key, "left_anti"), key, text).withColumn("stripped", F.regexp_replace("line", r"^\s+|\s+$", ""))
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = rows.select(
        key, "line_no", "stripped", (blank | opens).alias("breaks"),
        F.sum((blank | opens).cast("long")).over(so_far).alias("run"),
        F.coalesce(F.last(F.when(opens, s), ignorenulls=True).over(so_far), F.lit("")).alias("section"),
    )
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy("line_no")) - 1
    pairs = named.where("NOT breaks").withColumn("pair", F.floor(place / 2)).groupBy(key, "run", "pair").agg(
        F.min("line_no").alias("line_no"), F.min("section").alias("section"), F.count("*").alias("n"),
        F.min_by("stripped", "line_no").alias("title"), F.max_by("stripped", "line_no").alias("detail"),
    )
    statement = F.when(F.col("n") == 2, F.concat("title", F.lit(" ("), "detail", F.lit(")"))).otherwise(F.col("title"))
    kept = pairs.select(key, "line_no", "section", statement.alias("statement")).where(F.length("statement") >= 8)
    change, sure = exprs.classify(F.col("section"), F.col("statement"))
    return as_markdown.unionByName(kept.select("*", change.alias("type"), sure.alias("confidence")))


def asciidoc_statements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Bullets (``- `` or ``* `` at the margin) of 4 characters or more, classified by the last ``=`` heading."""
    line = F.col("line")
    heading = F.startswith(line, F.lit("="))
    rows = sections(lines(docs, key, text), key, F.when(heading, F.trim(F.regexp_replace(line, "^=+", ""))))
    body = F.trim(F.substring(line, F.lit(3), F.length(line)))
    bullet = (F.startswith(line, F.lit("- ")) | F.startswith(line, F.lit("* "))) & (F.length(body) >= 4)
    found = rows.where(bullet).select(key, "line_no", F.coalesce("section", F.lit("")).alias("section"), body.alias("statement"))
    kind, sure = exprs.classify(F.col("section"), F.col("statement"))
    return found.select("*", kind.alias("type"), sure.alias("confidence"))


def guide_statements(docs: DataFrame, key: str, text: str, major: Column) -> DataFrame:
    """Statements of migration guides: as AsciiDoc from major version 6 on, where the text begins with ``=``; else as Markdown."""
    ascii_doc = F.coalesce((major >= 6) & F.startswith(F.trim(text), F.lit("=")), F.lit(False))
    return asciidoc_statements(docs.where(ascii_doc), key, text).unionByName(markdown_statements(docs.where(~ascii_doc), key, text))


def upgrade_prose(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Statements ``Title: prose`` of the level-3 sections under the first heading ``## Upgrading from``."""
    line = F.col("line")
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h3 = F.regexp_extract(line, r"^###\s+(.+)$", 1)
    rows = lines(docs, key, text).withColumns({"two": line.rlike(r"^##\s+"), "h3": F.when(h3 != "", F.trim(h3))})
    placed = rows.withColumns({"chapter": F.sum(F.col("two").cast("long")).over(so_far), "part": F.count("h3").over(so_far)})
    wanted = placed.where(F.col("two") & line.rlike(r"(?i)^##\s+upgrading from")).groupBy(key).agg(F.min("chapter").alias("chapter"))
    prose = F.when(~F.startswith(F.trim(line), F.lit("#")) & (F.trim(line) != ""), F.struct("line_no", F.trim(line).alias("t")))
    parts = placed.join(wanted, [key, "chapter"]).where("NOT two AND part > 0").groupBy(key, "part").agg(
        F.min("line_no").alias("line_no"), F.max("h3").alias("title"), F.transform(F.array_sort(F.collect_list(prose)), lambda x: x["t"]).alias("prose")
    )
    # a part that began before the chapter has no title here
    statement = F.concat("title", F.lit(": "), F.array_join("prose", " "))
    kind, sure = exprs.classify(F.lit("Upgrading from Spring Boot"), F.col("statement"))
    found = parts.where("title is not null AND size(prose) > 0").select(key, "line_no", statement.alias("statement"))
    return found.select(key, "line_no", F.lit("Upgrading from Spring Boot").alias("section"), "statement", kind.alias("type"), sure.alias("confidence"))


def release_body(candidates: DataFrame, key: str) -> DataFrame:
    """(key, url, body) of the first usable snapshot: the API's JSON by rank, else a page's release text by rank.

    ``candidates``: (key, rank, url, json, html), one row per tag tried; the
    JSON of the first tag that answered decides, blank or not, before any page.
    """
    page = F.regexp_extract("html", r"""(?is)<div[^>]*(?:class=["'][^"']*\bmarkdown-body\b[^"']*["']|data-test-selector=["']release-body["'])[^>]*>(.*?)</div>""", 1)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(page, r"(?s)<[^>]*>", "\n"), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")
    rows = candidates.select(key, "rank", "url", F.col("json").isNotNull().alias("answered"), F.get_json_object("json", "$.body").alias("body"), F.get_json_object("json", "$.html_url").alias("html_url"), text.alias("text"))
    best = rows.groupBy(key).agg(
        F.min_by(F.struct("body", F.coalesce("html_url", "url").alias("url")), F.when(F.col("answered"), F.col("rank"))).alias("api"),
        F.min_by(F.struct(F.col("text").alias("body"), "url"), F.when(F.col("text") != "", F.col("rank"))).alias("page"),
    )
    chosen = F.when(F.trim(F.coalesce("api.body", F.lit(""))) != "", F.col("api")).otherwise(F.col("page"))
    return best.select(key, chosen.alias("c")).where("c is not null").select(key, "c.url", "c.body")


def issue_fields(json: Column, html: Column, key: Column) -> tuple[Column, Column]:
    """(summary, description) of an issue: its REST answer, else the page's preview tags, else its key alone."""
    meta = lambda name: F.regexp_extract(html, rf"""(?is)<meta\s+(?:property|name)=["']{name}["']\s+content=["']([^"']*)["']""", 1)
    or_none = lambda c: F.when(c != "", c)
    there = F.get_json_object(json, "$.fields").isNotNull()
    summary = F.when(there, or_none(F.get_json_object(json, "$.fields.summary"))).otherwise(or_none(meta("og:title")))
    described = F.coalesce(or_none(meta("og:description")), or_none(meta("description")))
    description = F.when(there, F.get_json_object(json, "$.fields.description")).otherwise(described)
    return F.coalesce(summary, key), F.trim(F.coalesce(description, F.lit("")))


def maven_coordinates(pom: Column) -> Column:
    """Kept group:artifact pairs of all dependencies of a POM."""
    blocks = F.regexp_extract_all(pom, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    tag = lambda b, t: F.regexp_extract(b, rf"(?s)<{t}>\s*([^<]+?)\s*</{t}>", 1)
    pairs = F.transform(F.filter(blocks, lambda b: (tag(b, "groupId") != "") & (tag(b, "artifactId") != "")), lambda b: F.concat_ws(":", tag(b, "groupId"), tag(b, "artifactId")))
    return F.array_distinct(F.filter(pairs, lambda x: x.rlike(COORDINATES_KEEP)))


def gradle_coordinates(text: Column) -> Column:
    """Kept group:artifact pairs of a Gradle file."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(GRADLE_COORDINATES), F.lit(1)), lambda x: x.rlike(COORDINATES_KEEP)))


def gradle_version(text: Column) -> Column:
    """The first line ``version "X"`` of a subproject's Gradle file."""
    found = F.regexp_extract(text, r'(?m)^\s*version\s+"([^"]+)"', 1)
    return F.when(found != "", found)


def java_names(code: Column) -> Column:
    """Imported names and annotations of a source file, without noise."""
    imports = F.regexp_extract_all(code, F.lit(r"(?m)^import\s+(?:static\s+)?([\w.]+)"), F.lit(1))
    kept = F.filter(imports, lambda x: x.rlike(SCAN_KEEP))
    annotations = F.filter(F.regexp_extract_all(code, F.lit(r"@([A-Za-z][\w.]*)"), F.lit(1)), lambda x: ~x.isin(*NOISE))
    return F.array_distinct(F.concat(kept, annotations))


def property_keys(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^([\w][\w.-]+)\s*="), F.lit(1)))


def yaml_keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Dotted leaf keys of simple YAML, by an indent stack."""

    def flatten(body: str) -> list[str]:
        stack, out = [], []
        for line in (body or "").splitlines():
            if not line.strip() or line.lstrip().startswith(("#", "- ")) or ":" not in line:
                continue
            depth, (name, value) = len(line) - len(line.lstrip()), line.strip().split(":", 1)
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, name))
            if value.strip():
                out.append(".".join(n for _, n in stack))
        return out

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(k, p) for k, body in zip(b[key], b[text]) for p in flatten(body)], columns=[key, "property"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, property string")


def tag_versions(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """Release tags as versions with a sort key; peeled and unparsable tags are dropped."""
    v = F.regexp_extract(tag, r"^refs/tags/(?:.*/)?v?(\d+(?:\.\d+)*(?:(?:\.|-)?(?:a|b|rc|post)\d+)?)$", 1)
    n = F.split(F.regexp_extract(v, r"^(\d+(?:\.\d+)*)", 1), r"\.")
    part = lambda i: F.coalesce(F.get(n, F.lit(i)).cast("long"), F.lit(0).cast("long"))
    phase = F.regexp_extract(v, r"(a|b|rc|post)\d+$", 1)
    rank = F.when(phase == "a", 0).when(phase == "b", 1).when(phase == "rc", 2).when(phase == "post", 4).otherwise(3)
    number = F.coalesce(F.regexp_extract(v, r"(?:a|b|rc|post)(\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    return tags.withColumn("version", v).where("version <> ''").withColumns({"major": part(0), "minor": part(1), "patch": part(2), "phase": rank, "number": number})


def build_version(pom: Column, gradle: Column, properties: Column, package: Column) -> tuple[Column, Column]:
    """(version, source file) by precedence: POM parent, Gradle, gradle.properties, package.json."""
    found = [
        (F.regexp_extract(pom, r"(?s)<parent>.*?<artifactId>spring-boot-starter-parent</artifactId>\s*<version>([^<]+)</version>", 1), "pom.xml"),
        (F.regexp_extract(gradle, r"""org\.springframework\.boot['"]?\)?\s*version\s*['"]([^'"]+)['"]""", 1), "build.gradle"),
        (F.regexp_extract(gradle, r"""springBootVersion\s*=\s*['"]([^'"]+)['"]""", 1), "build.gradle"),
        (F.regexp_replace(F.regexp_extract(properties, r"(?m)^\s*(?:springBootVersion|spring\.boot\.version)\s*=\s*([^\s#]+)", 1), r"""^["']+|["']+$""", ""), "gradle.properties"),
        (F.regexp_replace(F.coalesce(*[F.get_json_object(package, f"$.{part}.@angular/core") for part in ("dependencies", "devDependencies")]), r"^[\^~>=<]+", ""), "package.json"),
    ]
    version, source = F, F
    for value, name in found:
        there = F.coalesce(value, F.lit("")) != ""
        version, source = version.when(there, value), source.when(there, name)
    return version, source


def issue_keys(text: Column) -> Column:
    """Issue keys of a text, upper-cased, in order."""
    pattern = r"(?i)\b((?:" + "|".join(exprs.ISSUE_PREFIXES) + r")-\d+)\b"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper)


def enrich(changes: DataFrame, issues: DataFrame, key: str = "change_id") -> DataFrame:
    """Each change with its first key that has an issue, else its first key."""
    keyed = changes.select(key, F.posexplode(issue_keys(F.col("statement"))).alias("position", "issue"))
    met = keyed.join(issues, "issue", "left")
    best = F.min(F.struct(F.col("summary").isNull().alias("missing"), "position", "issue", "summary"))
    return met.groupBy(key).agg(best.alias("b")).select(key, F.col("b.issue").alias("issue"), F.col("b.summary").alias("summary"))


def merge_changelogs(gh: DataFrame, cl: DataFrame, overlap: float = 0.95) -> DataFrame:
    """Release-page and changelog statements without repeats.

    Statements of the changelog win.  If nearly all commits of the release page
    are in the changelog, its rows with such a commit go too.  The first of
    equal statements stays: release page first, then by position.
    """
    commit = F.substring(F.regexp_extract("statement", r"github\.com/angular/angular/commit/([0-9a-f]+)", 1), 1, 10)
    gh, cl = gh.withColumn("commit", commit), cl.withColumn("commit", commit)
    known = cl.where("commit <> ''").select("commit").distinct()
    there = gh.where("commit <> ''").select("commit").distinct().join(known.withColumn("hit", F.lit(1)), "commit", "left")
    share = there.agg((F.coalesce(F.sum("hit") / F.count("*"), F.lit(0.0)) >= overlap).alias("drop"))
    fresh = gh.join(cl.select("statement"), "statement", "left_anti").join(known.withColumn("hit", F.lit(True)), "commit", "left")
    fresh = fresh.crossJoin(F.broadcast(share)).where(~(F.col("drop") & F.coalesce("hit", F.lit(False))))  # one row
    both = fresh.select("statement", F.lit(0).alias("source"), "position").unionByName(cl.select("statement", F.lit(1).alias("source"), "position"))
    return both.groupBy("statement").agg(F.min(F.struct("source", "position")).alias("p")).select("statement", "p.source", "p.position")


def render(changes: DataFrame, group: list[str], order: str) -> DataFrame:
    """One Markdown table per group; pipes and line breaks become spaces."""
    clean = F.regexp_replace("statement", r"[|\r\n]", " ")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "type", "confidence", "source_url", clean), F.lit(" |"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("row")))), lambda x: x["row"]), "\n")
    return changes.groupBy(*group).agg(F.concat(F.lit("| Type | Confidence | Source | Statement |\n|---|---|---|---|\n"), body).alias("markdown"))


def rename_statements(spark: SparkSession, versions: DataFrame) -> DataFrame:
    """Package renames for every hop that crosses 9.0.0."""
    names = spark.createDataFrame([(n,) for n in RENAMED], "package string")
    hops = versions.where("hop_from < 9000000 AND hop_to >= 9000000")
    # a fixed list of 22 names
    return hops.crossJoin(F.broadcast(names)).select(
        "framework", "hop_from", "hop_to", F.concat(F.lit("javax."), "package", F.lit(" is now jakarta."), "package").alias("statement")
    )


def jboss_ga(v: Column) -> Column:
    return v.rlike(r"^\d+\.\d+\.\d+\.Final$")


def plain_ga(v: Column) -> Column:
    return v.rlike(r"^\d+\.\d+\.\d+$")


def infinispan_ga(v: Column) -> Column:
    return plain_ga(v) | (jboss_ga(v) & (F.substring_index(v, ".", 1).try_cast("int") < 16))


def releases(rows: DataFrame, version: str = "version") -> DataFrame:
    """Distinct three-part versions without a suffix other than ``.Final``, with their key."""
    m = lambda i: F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)(\.Final)?$", i).cast("long")
    return rows.where(F.col(version).rlike(r"^\d+\.\d+\.\d+(\.Final)?$")).select(version).distinct().withColumn("key", m(1) * 1000000 + m(2) * 1000 + m(3))


def without_dependency_upgrades(body: Column) -> Column:
    """Drops the section headed Dependency Upgrades, up to the next heading."""
    return F.regexp_replace(body, r"(?ims)^#*\s*dependency\s+upgrades?\s*$.*?(?=^#+\s|\z)", "")


def scrub(text: Column) -> Column:
    """Credentials in URLs replaced."""
    return F.regexp_replace(text, r"(https?://)[^/@\s]+@", "$1***@")


def compatible(declared: Column, target: Column) -> Column:
    """Same major, and not below."""
    major = lambda c: F.substring_index(c, ".", 1)
    return F.coalesce((major(declared) == major(target)) & (exprs.sortable(declared) >= exprs.sortable(target)), F.lit(False))
