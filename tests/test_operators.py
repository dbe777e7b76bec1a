"""Operators on small hand-made inputs."""

import os
import random

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from verdigris import api
from verdigris.functions import exprs
from verdigris.operators import context, fuzzy, lifecycle, matching, records, search, upsert, versions
from verdigris.plans import project, upgrade
from verdigris.sources import parsers, sinks
from verdigris.sources.graph import Graph
from verdigris.streaming import outcomes


def one(spark, expr, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "recipe,auto,missing,effort,text,applicable,want",
    [
        (1, True, False, "moderate", "x", "matched", "openrewrite"),
        (1, False, False, "moderate", "x", "matched", "prompted-auto"),
        (1, True, True, "moderate", "x", "matched", "prompted-auto"),
        (1, None, False, "mechanical", "Rename a to b", "matched", "agent-codemod"),
        (None, None, False, "mechanical", "a -> b", "matched", "agent-codemod"),
        (None, None, False, "moderate", "a -> b", "uncertain", "human-review"),
        (None, None, False, "moderate", "look at it", "matched", "human-review"),
        (None, None, False, "architectural", "a -> b", "matched", "human-review"),
    ],
)
def test_executor(spark, recipe, auto, missing, effort, text, applicable, want):
    rows = spark.createDataFrame([(recipe, auto, missing, effort, text, applicable)], "r long, a boolean, m boolean, e string, t string, p string")
    assert rows.select(exprs.executor(F.col("r"), F.col("a"), F.col("m"), F.col("e"), F.col("t"), F.col("p"))).first()[0] == want


def test_buckets(spark):
    names = spark.createDataFrame([("org.a:b:1.0",), ("org.a.B",), ("server.port",), ("Service",), ("spring-web",), ("",)], "name string")
    got = {(r.bucket, r.name) for r in matching.normalise(names).collect()}
    assert got == {("deps_ga", "org.a:b"), ("dep_artifacts", "b"), ("classes", "org.a.B"), ("props", "server.port"), ("class_simple", "Service"), ("dep_artifacts", "spring-web")}


def test_applicability_bridges(spark):
    rules = spark.createDataFrame([(i, s) for i, s in enumerate(["low", "high", None, "low", "low"])], "rule_id long, severity string")
    affects = spark.createDataFrame([(0, "Dependency", "org.a:x"), (1, "Class", "org.b.C"), (3, "Class", "org.a.p.D"), (3, "Dependency", "zz:y"), (4, "Dependency", "q:w")], "rule_id long, kind string, name string")
    scan = matching.normalise(spark.createDataFrame([("org.a.p.E",)], "name string"))
    plain = {r.rule_id: r.applicability for r in matching.applicable(rules, affects, scan).collect()}
    assert plain == {0: "matched", 1: "uncertain", 2: "informational", 3: "excluded", 4: "excluded"}
    forced = spark.createDataFrame([("q:w",)], "name string")
    more = {r.rule_id: r.applicability for r in matching.applicable(rules, affects, scan, package_bridge=True, forced=forced).collect()}
    assert more[3] == "matched" and more[4] == "matched"
    nothing = matching.applicable(rules, affects, scan.limit(0))
    assert {r.applicability for r in nothing.collect()} == {"universal", "informational"}


def test_resolve(spark):
    known = spark.createDataFrame([("f", v) for v in (1000000, 2000000, 3005000)], "framework string, sortable long")
    asked = spark.createDataFrame([(1, "f", 2500000), (2, "f", 500), (3, "f", 9000000), (4, "g", 1), (5, "f", 2000000)], "request_id long, framework string, requested long")
    get = lambda how: {r.request_id: (r.resolved, r.rounded, r.ahead_of_catalogue) for r in versions.resolve(asked, known, how).collect()}
    assert get("floor") == {1: (2000000, True, False), 2: (None, False, False), 3: (3005000, True, False), 4: (None, False, False), 5: (2000000, False, False)}
    assert get("ceil")[3] == (3005000, True, True) and get("ceil")[2] == (1000000, True, False)
    assert get("exact")[5] == (2000000, False, False) and get("exact")[1][0] is None


@pytest.mark.parametrize("declared,target,want", [("3.5.0", "3.5.0", True), ("3.6.0", "3.5.9", True), ("4.0.0", "3.5.0", False), ("3.4", "3.5", False), ("x", "3.5.0", False)])
def test_compatible(spark, declared, target, want):
    assert one(spark, parsers.compatible(F.col("a"), F.col("b")), a=declared, b=target) is want


def test_resume_stage(spark):
    base = {f"{s}_count": 0 for s in context.OUTCOMES} | {"status": "in-progress", "has_flags": False, "pending_count": 3}
    cases = [({}, "gap-check"), ({"has_flags": True}, "clarify"), ({"failed_count": 1}, "execute"), ({"completed_count": 2, "pending_count": 0}, "feedback"), ({"completed_count": 2}, "execute"), ({"status": "complete"}, None)]
    rows = spark.createDataFrame([base | c | {"i": i} for i, (c, _) in enumerate(cases)])
    got = {r.i: r.resume_stage for r in context.resume_stage(rows).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_flags_are_null_safe(spark):
    s = "context_id long, type string, reference string, message string, position long"
    old = spark.createDataFrame([(1, "t", None, None, 0)], s)
    new = spark.createDataFrame([(1, "t", None, None, 1), (1, "t", "r", None, 2), (1, "t", "r", None, 3)], s)
    assert context.merge_flags(old, new).count() == 2
    assert context.merge_flags(old, new, overwrite=True).count() == 3


def test_upsert_twice_is_once(spark):
    a = spark.createDataFrame([(1, "x", None)], "k long, v string, p string")
    b = spark.createDataFrame([(1, "y", "q"), (2, "z", "r")], "k long, v string, p string")
    once = upsert.upsert(a, b, ["k"], keep_first=["p"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert.upsert(once, b, ["k"], keep_first=["p"]).collect())) == [(1, "y", "q"), (2, "z", "r")]


def test_evolution_limit(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(8)], "old_part long, new_part long")
    ends = {r.start for r in lifecycle.evolution(chain, 5).collect()}
    assert ends == {3, 4, 5, 6, 7}
    assert lifecycle.evolution(chain, 5, truncate=True).where("start = 0").count() == 5


def test_cosine_guards(spark):
    rows = spark.createDataFrame([([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([3.0, 4.0], [3.0, 4.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in rows.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, 1.0, 0.0]


def test_fusion(spark):
    lists = [spark.createDataFrame([(i, float(-r), r) for r, i in enumerate(ids, 1)], "id string, score double, rank long") for ids in (["a", "b"], ["b", "c"])]
    assert search.fuse(lists).orderBy(F.desc("score")).first().id == "b"


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_indel_bounds(a, b):
    assert fuzzy.indel(a, a) == 1.0
    assert fuzzy.indel(a, b) == fuzzy.indel(b, a)
    assert 0 <= fuzzy.indel(a, b) <= 1


def test_fuzzy_levels(spark):
    services = spark.createDataFrame([("wallet-api",), ("Ledger",), ("payments",)], "service string")
    asked = spark.createDataFrame([(1, "wallet-api"), (2, "ledger"), (3, "Wallet API"), (4, "paymnts"), (5, "zzzz")], "request_id long, name string")
    got = {r.request_id: (r.service, r.method) for r in fuzzy.resolve(asked, services).collect()}
    assert got == {1: ("wallet-api", "exact"), 2: ("Ledger", "case_insensitive"), 3: ("wallet-api", "alphanumeric_normalized"), 4: ("payments", "fuzzy")}


@given(st.lists(st.text("ab1", min_size=1, max_size=7), min_size=1, max_size=8), st.lists(st.text("abz1", min_size=5, max_size=5), min_size=1, max_size=30), st.sampled_from([0, 70]))
def test_closest_is_brute_force(asked, keys, more):
    asked, keys = [a + "b" * more for a in asked], [k + "b" * more for k in keys]
    services = [k.upper() if i % 2 else k for i, k in enumerate(keys)]
    got = [(w, services[s], x) for w, s, x in zip(*map(list, fuzzy.closest(asked, keys, services, 0.5, 4)))]
    want = []
    for w, a in enumerate(asked):
        scored = sorted((-fuzzy.indel(a, k), s) for k, s in zip(keys, services) if fuzzy.indel(a, k) >= 0.5)
        want += [(w, s, -x) for x, s in scored[:4]]
    assert got == want


def test_fuzzy_does_not_meet_all_pairs(spark, monkeypatch):
    """Nodes walked for 500 requests of 20,000 names: far fewer than pairs."""
    keys = [f"supplier{i:09d}" for i in range(20000)]
    walked, whole = [], fuzzy.np.repeat
    monkeypatch.setattr(fuzzy.np, "repeat", lambda x, n: walked.append(int(fuzzy.np.sum(n))) or whole(x, n))
    who, service, score = fuzzy.closest(["x" + k for k in keys[::40]], keys, keys, 0.68, 4)
    assert len(who) == 4 * 500 and [int(s) for s, x in zip(service, score) if x > 0.95] == list(range(0, 20000, 40))
    assert sum(walked) < 0.5 * 500 * 20000


def test_fuzzy_in_blocks(spark, monkeypatch):
    services = spark.createDataFrame([(f"Svc-{i % 90:03d}" if i % 2 else f"svc.{i:04d}",) for i in range(200)], "service string")
    asked = spark.createDataFrame([(i, f"xsvc{i:03d}") for i in range(40)], "request_id long, name string")
    whole = sorted(map(tuple, fuzzy.resolve(asked, services).collect()))
    monkeypatch.setattr(fuzzy, "BLOCK", 30)
    monkeypatch.setattr(fuzzy, "PART", 7)
    assert sorted(map(tuple, fuzzy.resolve(asked, services).collect())) == whole and len(whole) == 40
    top = [(-fuzzy.indel("xsvc007", k), s) for s, k in ((r.service, r.service.lower().replace("-", "").replace(".", "")) for r in services.collect())]
    best = sorted(x for x in top if x[0] <= -0.68)[:4]
    assert [(r[2], r[4], r[5]) for r in whole if r[0] == 7] == [(best[0][1], -best[0][0], ",".join(s for _, s in best[1:]))]


def test_layers_and_pins(spark):
    layer = lambda *rows: spark.createDataFrame(rows, "service string, target string")
    got = {tuple(r) for r in fuzzy.layered(layer(("Wallet-Api", "old"), ("ledger", "l")), layer(("wallet_api", "new"), ("!", "x"))).collect()}
    assert got == {("wallet_api", "new"), ("ledger", "l")}
    asked = spark.createDataFrame([(1, "ledger"), (2, "other")], "request_id long, name string")
    found = fuzzy.by_level(asked, spark.createDataFrame([("ledger",), ("other",)], "service string"))
    pins = spark.createDataFrame([("ledger", "main-ledger")], "name string, service string")
    assert {tuple(r) for r in fuzzy.pinned_first(asked, pins, found).collect()} == {(1, "ledger", "main-ledger", "pinned"), (2, "other", "other", "exact")}


def test_plan_falls_back_to_cards(spark, sf_dir):
    g = Graph(spark, sf_dir)
    path = api.resolved_path(g, "ASIA", 5006000, 99000000)
    assert path.high == g.version.where("framework = 'ASIA'").agg(F.max("sortable")).first()[0]
    plan = api.build_recipe_plan(g, path, g.scan_names, steps=g.step.limit(0))
    assert {(r.track, r.blocked_reason) for r in plan.collect()} == {("manual", "no_migration_steps")}
    assert api.build_recipe_plan(g, path, g.scan_names).where("blocked_reason is not null").count() == 0
    with pytest.raises(ValueError):
        api.resolved_path(g, "none", 1, 2)
    with pytest.raises(ValueError):
        api.steps_for_scope_tier(g, path, g.scan_names, "api", "urgent")


def test_guard(spark):
    with pytest.raises(ValueError):
        project.guarded(spark, {}, "drop table x")
    assert project.guarded(spark, {"t": spark.range(3)}, "SELECT count(*) AS n FROM {t}").first().n == 3


def test_release_pairs(spark):
    docs = spark.createDataFrame(
        [(1, "Bug Fixes\nfix the thing: now\n#12\nfirst line: a\nsecond line\n\nshort"), (2, None), (3, ""), (4, "a: 1\nb\nc: 2\nd\ne: longer"), (5, "# H\nplain: one\n- a bullet\nrest: two")], "d long, t string"
    )
    got = sorted((r.d, r.line_no, r.section, r.statement) for r in parsers.release_statements(docs, "d", "t").collect())
    assert got == [
        (1, 1, "Bug Fixes", "fix the thing: now"), (1, 3, "Bug Fixes", "first line: a (second line)"), (4, 0, "", "a: 1 (b)"), (4, 2, "", "c: 2 (d)"), (4, 4, "", "e: longer"), (5, 2, "H", "a bullet"),
    ]


def test_asciidoc(spark):
    docs = spark.createDataFrame([(1, "= Title\n- first one\n == no\n* second one\n== Deprecated things\n- abc\n- gone now\n  - nested one"), (2, None)], "d long, t string")
    got = [(r.section, r.statement, r.type) for r in parsers.asciidoc_statements(docs, "d", "t").orderBy("line_no").collect()]
    assert got == [("Title", "first one", "behavioral"), ("Title", "second one", "behavioral"), ("Deprecated things", "gone now", "deprecation")]


def test_upgrade_prose(spark):
    text = "## Old\n### A\nx\n## Upgrading from Spring Boot 3.4\nintro\n### Heap dump\nfirst\n\n second\n#### deep\n### Nothing\n### Last one\nbreaking\n## Upgrading from again\n### B\ny"
    docs = spark.createDataFrame([(1, text), (2, "## No\n### A\nx"), (3, None)], "d long, t string")
    got = [(r.d, r.statement, r.type) for r in parsers.upgrade_prose(docs, "d", "t").orderBy("line_no").collect()]
    assert got == [(1, "Heap dump: first second", "behavioral"), (1, "Last one: breaking", "breaking")]


def test_release_body_falls_back(spark):
    page = '<div class="a markdown-body">\n<p>Page <b>text</b></p>\n</div>'
    rows = [
        (1, 0, "u0", None, page), (1, 1, "u1", '{"body": "said", "html_url": "h"}', None), (2, 0, "u0", '{"body": " "}', None), (2, 1, "u1", '{"body": "never read"}', page),
        (3, 0, "u0", None, "<p>x</p>"), (4, 0, "u0", '{"body": "b"}', None),
    ]
    got = {r.k: (r.url, r.body) for r in parsers.release_body(spark.createDataFrame(rows, "k long, rank int, url string, json string, html string"), "k").collect()}
    assert got == {1: ("h", "said"), 2: ("u1", "Page\ntext"), 4: ("u0", "b")}


def test_coordinates_and_gradle_version(spark):
    pom = "<dependency><groupId> org.hibernate.orm </groupId>\n<artifactId>core</artifactId></dependency><dependency><groupId>org.hibernate.x</groupId></dependency><dependency><artifactId>b</artifactId><groupId>com.acme</groupId></dependency>"
    assert one(spark, parsers.maven_coordinates(F.col("t")), t=pom) == ["org.hibernate.orm:core"]
    gradle = "implementation 'org.springframework.boot:starter:3.1'\nversion 'x'\n  version \"1.2\"\nversion \"9\"\napi(\"org.springframework.boot:starter:3.2\")"
    assert one(spark, parsers.gradle_coordinates(F.col("t")), t=gradle) == ["org.springframework.boot:starter"]
    assert one(spark, parsers.gradle_version(F.col("t")), t=gradle) == "1.2"


def test_html_summary(spark):
    long = "word " * 20
    assert one(spark, parsers.html_summary(F.col("t")), t=f"<p>short</p><p>{long}<b>bold</b></p>") == long + "bold"
    assert one(spark, parsers.html_summary(F.col("t")), t=f'<meta property="og:description" content=" seen "><p>{long}</p>') == "seen"
    assert one(spark, parsers.html_summary(F.col("t")), t="<p>short</p>") is None


def test_severity_in_any_case(spark):
    got = [one(spark, exprs.at_least(F.col("s").cast("string"), "Medium"), s=s) for s in ("HIGH", "medium", "Low", "", None, "odd")]
    assert got == [True, True, False, False, False, False]


def test_executor_reads_nulls_and_case(spark):
    row = spark.createDataFrame([(1, True, None, "Moderate", "a -> b", "matched"), (1, None, None, "MECHANICAL", "a -> b", "matched")], "r long, a boolean, m boolean, e string, t string, p string")
    got = [r[0] for r in row.select(exprs.executor(F.col("r"), F.col("a"), F.col("m"), F.col("e"), F.col("t"), F.col("p"))).collect()]
    assert got == ["openrewrite", "agent-codemod"]


def test_unknown_section_fails(spark):
    assert one(spark, exprs.rule_type(F.col("s")), s="deprecation") == "deprecation"
    with pytest.raises(Exception, match="unrecognized source section"):
        one(spark, exprs.rule_type(F.col("s")), s="none such")


def test_cards_only_without_any_step(spark):
    rules = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "plan string, rule_id long")
    steps = spark.createDataFrame([(1,)], "rule_id long")
    assert [r.rule_id for r in upgrade.rule_cards(rules, steps, ["plan"]).collect()] == [3]
    assert upgrade.rule_cards(rules, steps.limit(0), ["plan"]).count() == 3


def test_truncated_group(spark):
    rules = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "rule_id long, match_count int")
    affects = spark.createDataFrame([(1, "Dependency", "com.fasterxml.jackson.core:databind"), (2, "Dependency", "com.fasterxml.jackson:x"), (3, "Dependency", "com.fasterxml.jackson.core:y")], "rule_id long, kind string, name string")
    scan = matching.normalise(spark.createDataFrame([("com.fasterxml.jackson.annotation.JsonProperty",), ("com.fasterxml.other.Thing",)], "name string"))
    got = {r.rule_id: r.matched_entities for r in lifecycle.matched_names(rules, affects, scan).collect()}
    assert got == {1: "com.fasterxml.jackson.annotation.JsonProperty", 2: "com.fasterxml.jackson.annotation.JsonProperty"}


@pytest.mark.parametrize("query", [project.pending_steps_filtered, upgrade.matched_entities])
def test_lines_of_other_rules_go_first(spark, sf_dir, query):
    """What all ways of matching read is the edges of the path, read once."""
    assert "lineitem" not in query(spark, sf_dir)._jdf.queryExecution().toString()
    g = Graph(spark, sf_dir)
    rules = g.rule.where("rule_id % 7 = 0").select("rule_id")
    for some, every in ((g.affects_of(rules), g.affects), (g.step_of(rules), g.step)):
        assert sorted(map(str, some.collect())) == sorted(map(str, every.where("rule_id % 7 = 0").collect()))


def test_edges_of_a_task_are_bounded(spark, sf_dir, monkeypatch):
    """The number of tasks follows the lines, whatever the session's shuffles are set to."""
    monkeypatch.setattr("verdigris.sources.graph.EDGES", 1000)
    lines = Graph(spark, sf_dir).table("lineitem").count()
    plan = Graph(spark, sf_dir).affects._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rule_id" in plan and f", {-(-lines // 1000)}), REPARTITION_BY_NUM" in plan


def test_near_duplicate_passes(spark):
    said = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota kappa", "lamda mu nu"]
    unit = lambda i: [float(j == i) for j in range(5)]
    known = spark.createDataFrame([(10, said[0], unit(0), True), (11, said[0], unit(1), True), (12, said[1], unit(2), True), (13, said[2], unit(3), False), (14, said[3], unit(4), False)], "id long, statement string, embedding array<double>, indexed boolean")
    tilted = lambda i, by: [x + by * (j == (i + 1) % 5) for j, x in enumerate(unit(i))]
    asked = [(1, said[0], unit(4)), (2, "other words", tilted(2, 0.2)), (3, "eta theta iota kappa more", tilted(3, 0.2)), (4, "nothing shared", tilted(4, 0.2)), (5, "eta theta", tilted(3, 2.0)), (6, "no vector", []), (7, "zero", [0.0] * 5), (8, None, None)]
    got = {r.id: (r.known_id, r["pass"]) for r in search.near_duplicate(spark.createDataFrame(asked, "id long, statement string, embedding array<double>"), known).collect()}
    assert got == {1: (10, 1), 2: (12, 2), 3: (13, 3)}


def test_vector_pairs_are_all_found(spark):
    rng = random.Random(4)
    rows = [[rng.gauss(0, 1) + 3 * (j == i % 7) for j in range(12)] for i in range(400)] + [[1.0] * 12] * 60
    frame = spark.createDataFrame(list(enumerate(rows)), "id long, embedding array<double>")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    close = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 6) >= 0.8
    want = {(i, j) for i in range(0, 460, 20) for j in range(460) if i != j and close(rows[i], rows[j])}
    assert {(r.query, r.id) for r in search.within(frame.where("id % 20 = 0"), frame, 0.8).collect()} == want and want


def test_pairs_and_terms_meet_within_tasks(spark, monkeypatch):
    """No join of a query with every row, by vectors without clusters or by terms that all have; in blocks the same results."""
    rng = random.Random(5)
    words = lambda i: " ".join(["the", "and", *(f"w{rng.randrange(40)}" for _ in range(6)), f"only{i % 30}"])
    rows = spark.createDataFrame([(i, words(i), [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "id long, text string, embedding array<double>")
    asked = rows.where("id % 10 = 0")
    queries = asked.select(F.col("id").alias("query"), "text")
    pairs, hits = search.within(asked, rows, 0.8), search.bm25_each(queries, rows.select("id", "text"), 5)
    for frame in (pairs, hits):
        plan = frame._jdf.queryExecution().toString()
        assert "FlatMapCoGroupsInPandas" in plan
    whole = [sorted(map(tuple, f.collect())) for f in (pairs, hits.select("query", "id", "rank", F.round("score", 5)))]
    assert len(whole[1]) == 5 * 30
    for name, n in (("ASKED", 7), ("HELD", 50), ("AT_ONCE", 9), ("QUERIES", 7), ("DOCUMENTS", 50)):
        monkeypatch.setattr(search, name, n)
    pairs, hits = search.within(asked, rows, 0.8), search.bm25_each(queries, rows.select("id", "text"), 5)
    assert [sorted(map(tuple, f.collect())) for f in (pairs, hits.select("query", "id", "rank", F.round("score", 5)))] == whole
    one = sorted(((-r.score, r.id) for r in search.bm25(rows.where("id <> 0 or id = 0"), rows.first().text.split(), 6).collect()))
    assert [i for _, i in one if i != 0][:5] == [r[1] for r in sorted(whole[1], key=lambda r: r[2]) if r[0] == 0]


def test_update_guards(spark):
    steps = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "step_id long, rule_id long")
    rules = spark.createDataFrame([(100, "f", 5), (200, "f", 9), (300, "g", 5)], "rule_id long, framework string, sortable long")
    contexts = spark.createDataFrame([(7, "f", 4, 5)], "context_id long, framework string, from_sortable long, to_sortable long")
    bridges, owned = spark.createDataFrame([(100,)], "rule_id long"), spark.createDataFrame([(7, 3)], "context_id long, step_id long")
    asked = [(0, 7, 1, "completed"), (1, 7, 1, "deferred"), (2, 7, 2, "deferred"), (3, 7, 2, "completed"), (4, 7, 3, "skipped"), (5, 7, 1, "bridgeResolved"), (6, 8, 1, "failed"), (7, 7, 99, "failed"), (8, 7, 1, None)]
    got = {r.request_id: r.error_code for r in context.judge_updates(spark.createDataFrame(asked, "request_id long, context_id long, step_id long, outcome string"), steps, rules, contexts, bridges, owned).collect()}
    assert got == {0: None, 1: None, 2: "bridge_not_in_graph", 3: "step_not_on_path", 4: None, 5: "invalid_outcome", 6: "step_not_on_path", 7: "step_not_on_path", 8: "invalid_outcome"}


def test_bridges_resolve_deferrals(spark):
    events = [(7, 1, "deferred", 2, 1), (7, 2, "completed", None, 2), (7, 3, "deferred", 2, 3), (7, 4, "deferred", None, 1), (8, 1, "deferred", 2, 1)]
    got = {(r.context_id, r.step_id): (r.status, r.resolved_via) for r in context.settled(spark.createDataFrame(events, "context_id long, step_id long, outcome string, required long, at long")).collect()}
    assert got == {(7, 1): ("completed", "bridge"), (7, 2): ("completed", None), (7, 3): ("deferred", None), (7, 4): ("deferred", None), (8, 1): ("deferred", None)}


def test_contexts_are_created_or_resumed(spark):
    lists = ", ".join(f"{c} array<string>" for c in ("scanned_entities", *context.BUCKETS))
    key = "project_id long, from_sortable long, to_sortable long, framework string"
    old = spark.createDataFrame([(1, 1, 2, "f", "partial", *[["a"]] * 6), (2, 9, 10, "f", "complete", *[["z"]] * 6)], f"{key}, status string, {lists}")
    asked = spark.createDataFrame([(1, 1, 2, "f", *[["b"]] * 6, 1), (2, 9, 10, "f", *[["n"]] * 6, 1), (3, 1, 2, "f", *[["c"]] * 6, 1)], f"{key}, {lists}, at long")
    known = spark.createDataFrame([("f", 1), ("f", 2)], "framework string, sortable long")
    got = {r.project_id: (r.status, r.scanned_entities, r.classes, r.created) for r in context.opened(old, asked, known).collect()}
    assert got == {1: ("partial", ["a"], ["b"], False), 2: ("in-progress", ["n"], ["n"], True), 3: ("in-progress", ["c"], ["c"], True)}


def test_closing(spark):
    rows = spark.createDataFrame([(1, "in-progress"), (2, "in-progress")], "context_id long, status string")
    asked = spark.createDataFrame([(1, 1, "partial", "x", 1), (2, 1, "done", "y", 2), (3, 9, "complete", "z", 3)], "request_id long, context_id long, final_status string, notes string, at long")
    after, judged = context.closed(rows, asked)
    assert {r.context_id: (r.status, r.notes) for r in after.collect()} == {1: ("partial", "x"), 2: ("in-progress", "")}
    assert {r.request_id: r.error_code for r in judged.collect()} == {1: None, 2: "invalid_final_status", 3: "context_not_found"}


def test_late_rows_are_left_out(spark, tmp_path):
    """A row that comes after the watermark has passed its window changes nothing; one in time does."""
    from datetime import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    batches = [[("10:05", "view", 1.0)], [("12:30", "view", 1.0), ("12:31", "click", 2.0)], [("12:40", "view", 1.0), ("12:25", "click", 1.0)], [("12:59", "view", 1.0), ("10:06", "view", 9.0)]]
    for i, rows in enumerate(batches):
        at = [datetime.fromisoformat(f"2024-01-01 {t}:00") for t, _, _ in rows]
        table = {"event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([1] * len(rows), pa.int64()), "event_type": [k for _, k, _ in rows], "value": [v for _, _, v in rows], "props": ["{}"] * len(rows)}
        pq.write_table(pa.table(table), f"{tmp_path}/e{i}.parquet")
        os.utime(f"{tmp_path}/e{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = outcomes.windowed(outcomes.events(spark, f"{tmp_path}/", files=1))
    got = {(r.start, r.event_type): (r.events, r.total) for r in outcomes.run_to_table(stream, str(tmp_path / "out"), ["start", "event_type"]).collect()}
    assert got == {("2024-01-01 10:00:00", "view"): (1, 1.0), ("2024-01-01 12:00:00", "view"): (3, 3.0), ("2024-01-01 12:00:00", "click"): (2, 3.0)}


def test_sinks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("f", "# a\n| x |"), ("g", "# b")], "framework string, markdown string")
    for _ in range(2):
        sinks.write_markdown(rows, str(tmp_path / "md"), ["framework"])
    assert {(r.framework, r.value) for r in spark.read.text(str(tmp_path / "md"), wholetext=True).collect()} == {("f", "# a\n| x |\n"), ("g", "# b\n")}
    batch = spark.createDataFrame([("deprecation", "t", [("class", "N", "removed")])], "source_section string, title string, entities array<struct<kind:string,name:string,role:string>>")
    sinks.write_entities(batch, str(tmp_path / "json"))
    back = parsers.entity_batches(spark, str(tmp_path / "json")).first()
    assert (back.title, back.entities[0].name, back.steps) == ("t", "N", None)
    (tmp_path / "bad.json").write_text('{"entities": [{"title": ')
    with pytest.raises(Exception):
        parsers.entity_batches(spark, str(tmp_path / "bad.json")).collect()
    hops = spark.createDataFrame([("f", 1000000, 2000000), ("f", 2000000, 3000000)], "framework string, hop_from long, hop_to long")
    sinks.write_ranges(hops, str(tmp_path / "hops"))
    assert spark.read.parquet(str(tmp_path / "hops")).where("framework = 'f' AND major = 2").select("hop_to").first()[0] == 3000000


def test_insight_dumps_of_both_styles(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"statement": "s", "sourceUrl": "u", "affectedClasses": ["C"]}]')
    (tmp_path / "b.json").write_text('[{"statement": "t", "evidence_url": "v"}]')
    got = parsers.insight_dumps(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).orderBy("statement").collect()
    assert [(r.statement, r.source_url, r.affected_classes) for r in got] == [("s", "u", ["C"]), ("t", "v", None)]


def test_calls_are_traced(spark, tmp_path):
    calls = spark.createDataFrame([("tool", 1)], "tool string, ms long")
    for _ in range(2):
        records.trace(calls, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_filters_with_open_ends(spark):
    rows = spark.range(5)
    assert rows.where(exprs.between_or_open(F.col("id"), 2, None)).count() == 3 and rows.where(exprs.between_or_open(F.col("id"))).count() == 5
    assert rows.where(exprs.equals_or_any(F.col("id"), None)).count() == 5 and rows.where(exprs.equals_or_any(F.col("id"), 3)).count() == 1
    assert one(spark, exprs.mentions("ABC", F.col("a"), F.col("b")), a=None, b="xabcx") is True


def test_batch_edges(spark):
    step = {"index": 1, "requires": []}
    entity = {"source_section": "deprecation", "title": "t", "steps": [step, {"index": 2, "requires": [1, 5]}], "entities": [dict(kind="class", name="A", role="removed"), dict(kind="class", name="B", role="replacement"), dict(kind="property", name="p", role="mentioned")]}
    tables = records.batch_tables(spark.createDataFrame([entity, entity], parsers.ENTITY_BATCH), "4.0.0")
    assert [(r["index"], r.requires) for r in tables["requires"].collect()] == [(2, 1)]
    assert [tuple(r) for r in tables["replaced_by"].collect()] == [("class", "A", "B")]
    assert {(r.name, r.edge, r.version) for r in tables["lifecycle"].collect()} == {("A", "REMOVED_IN", "4.0.0"), ("B", "INTRODUCED_IN", "4.0.0"), ("p", "DEPRECATED_IN", "4.0.0")}


def test_changelog_section(spark):
    text = 'x <a name="1.0"></a> a <a name="2.0"></a> b'
    assert one(spark, parsers.changelog_section(F.col("t"), F.lit("1.0")), t=text) == '<a name="1.0"></a> a'
    assert one(spark, parsers.changelog_section(F.col("t"), F.lit("9.0")), t=text) == ""


def test_default_scope(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [("api", "high")])], "rule_id long, scopes array<struct<scope:string,severity:string>>")
    assert {tuple(r) for r in upsert.with_default_scope(rows).collect()} == {(1, "general", "low"), (2, "general", "low"), (3, "api", "high")}
