"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from verdigris.llm import decontaminate, language_id, lm_score, mixing, near_dedup, pii, quality, secret_scan, substring_dedup, url_filter


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench_items(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (None, "one"), (3, ""), (4, "a b c d e f g h i"), (4, "one"), (5, "a b c d e f g h")], "item_id long, text string")


def operators(spark, labels, bench_items):
    models = {}

    def identify(docs):
        if not models:
            models["m"] = language_id.fit(docs)
        return language_id.identify(docs, *models["m"], "text", "source")

    return {
        "pii": pii.annotate, "pii_clean": pii.sanitise, "substrings": substring_dedup.dedup, "quality": lambda d: quality.judge(d, labels), "quality_keep": lambda d: quality.keep(d, labels),
        "secrets": secret_scan.scan, "mix": mixing.mix, "copies": mixing.materialise, "near": near_dedup.classes, "near_keep": near_dedup.keep_one, "score": lm_score.score,
        "find": lambda d: decontaminate.find(d, bench_items), "clean": lambda d: decontaminate.clean(d, bench_items), "language": identify,
        "urls": lambda d: url_filter.judge(d, url_filter.rule_table(spark, [("com", "/", "block")]), key="doc_id", url="text"),
    }


NAMES = ["pii", "pii_clean", "substrings", "quality", "quality_keep", "secrets", "mix", "copies", "near", "near_keep", "score", "find", "clean", "language", "urls"]
FILTERS = {"quality_keep", "copies", "near_keep", "clean"}


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, edge_docs, labels, bench_items, name, tmp_path):
    out = operators(spark, labels, bench_items)[name](edge_docs)
    out.write.parquet(str(tmp_path / "out"))  # names do not clash
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == edge_docs.count() if name not in FILTERS else 0 < n


def by_id(rows):
    """Rows of each id, as sets of tuples without it."""
    out = {}
    for r in rows:
        out.setdefault(r[0], set()).add(tuple(r)[1:])
    return out


def test_values_of_personal_data(spark, edge_docs):
    """No text here holds any: no spans, and every text stays as it is, null, blank, long and repeated ones alike."""
    assert pii.annotate(edge_docs).where(F.size("__spans") > 0).count() == 0
    before, after = (sorted(map(str, d.select("doc_id", "text").collect())) for d in (edge_docs, pii.sanitise(edge_docs)))
    assert before == after


def test_values_of_removal(spark, edge_docs):
    got = by_id(substring_dedup.dedup(edge_docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect())
    size = len(edge_docs.where("doc_id = 6").first().text)
    assert got[5] == {(size, size, 1)} and got[6] == {(size, size, 1)}
    assert got[1] == {(0, 0, 0)} and got[2] == {(0, 0, 0)} and got[3] == {(4, 0, 0)} and (0, 0, 0) in got[None]
    assert got[10] == {(5000, 5000, 1)} and got[11] == {(600, 600, 1)}
    assert {n for n, _, _ in got[9]} == {len(("Käse größer ñandú " * 30).encode())}


def test_values_of_quality(spark, edge_docs, labels):
    q = quality.judge(edge_docs, labels)
    got = by_id(q.select("doc_id", "__quality.n_words", "__quality.word_chars", "__quality.n_repeat_words", "__kept").collect())
    assert got[1] == got[2] == got[3] == {(0, 0, 0, False)} and got[4] == {(1, 3, 0, False)} and got[10] == {(1, 5000, 0, False)}
    assert {(r[0], r[3]) for r in got[5]} == {(80, True)} and len(got[5]) == 1 and got[9] == {(90, 30 * 15, 90, False)} and got[11] == {(120, 60 * 5, 120, False)}


def test_values_of_secrets(edge_docs):
    """The one run of hexadecimal letters is a secret; nothing else here is."""
    assert [(r.doc_id, [tuple(s) for s in r["__spans"]]) for r in secret_scan.scan(edge_docs).where(F.size("__spans") > 0).collect()] == [(10, [(0, 2, 5000)])]


def test_values_of_the_mix(edge_docs):
    """Three sources: s1, then ä, then null; of texts without words nothing is taken, repeated rows count each."""
    got = mixing.mix(edge_docs).select("doc_id", "source", "__size", "__source_size", "__target", "__taken").collect()
    size = {s: sum(r["__size"] for r in got if r.source == s) for s in ("s1", "ä", None)}
    assert size == {"s1": 30_000 + 80 * 4 + 2 + 120, "ä": 90, None: 80}
    assert {(r.source, r["__source_size"]) for r in got} == set(size.items())
    assert {r.source: r["__target"] for r in got} == {"s1": sum(size.values()) - 510.0, "ä": 270.0, None: 240.0}
    assert all(r["__taken"] <= 3 * r["__size"] for r in got)
    taken = {s: sum(r["__taken"] for r in got if r.source == s) for s in size}
    assert taken == {"s1": sum(size.values()) - 510, "ä": 270, None: 240}


def test_values_of_scores(edge_docs):
    got = by_id(lm_score.score(edge_docs).select("doc_id", "n_tokens", "held_out", "base_score", "score").collect())
    assert {r[0] for r in got[1]} == {r[0] for r in got[2]} == {r[0] for r in got[3]} == {1} and {r[0] for r in got[4]} == {2}
    assert len(got[5]) == 1 and {r[0] for r in got[8]} == {30_001} and {r[0] for r in got[None]} == {81, 1}
    assert all(r[2] < 0 and r[3] < 0 for rows in got.values() for r in rows)
    assert got[1] and next(iter(got[1]))[2:] == next(iter(got[2]))[2:]  # the end alone, whatever the blank


def test_values_of_languages(spark, edge_docs):
    languages, model = language_id.fit(edge_docs)
    out = language_id.identify(edge_docs.select("doc_id", "text", "source"), languages, model, "text", "source").collect()
    got = {r.doc_id: r for r in out}
    assert languages == ["de", "en"] and len(out) == edge_docs.count()
    assert got[9].lang == "de" and got[8].lang == got[5].lang == "en"
    assert got[1].text_lang == got[3].text_lang == "de"  # no evidence: a tie, the first in order
    assert all(0.5 <= r.probability <= 1 for r in out)


def test_values_of_occurrences(edge_docs, bench_items):
    got = by_id((r.doc_id, r["__n_words"], tuple(r["__runs"]), tuple(r["__items"])) for r in decontaminate.find(edge_docs, bench_items).collect())
    assert got[4] == {(1, (0, 1), ("1", "4"))} and got[1] == got[2] == got[3] == {(0, (), ())}
    assert got[9] == {(90, (), ())} and got[10] == {(1, (), ())} and got[11] == {(120, (), ())} and got[8] == {(30_000, (), ())}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, no_docs, labels, bench_items, name):
    assert operators(spark, labels, bench_items)[name](no_docs).count() == 0


@pytest.mark.parametrize("name", ["pii_clean", "quality_keep", "near_keep", "clean"])
def test_stages_keep_columns(spark, edge_docs, labels, bench_items, name):
    assert operators(spark, labels, bench_items)[name](edge_docs).columns == edge_docs.columns


def test_near_duplicates_of_edges(edge_docs):
    got = {}
    for r in near_dedup.classes(edge_docs).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert got[5] == {5} and got[6] == {5} and got[1] == {1} and got[2] == {2} and got[4] == {4}
    kept = [r.doc_id for r in near_dedup.keep_one(edge_docs).select("doc_id").collect()]
    assert kept.count(5) == 1 and 6 not in kept and kept.count(None) == 2 and {1, 2, 3, 4, 7} <= set(kept)


def test_null_ids_take_part(spark):
    from .conftest import prose

    base = prose(200, 8)
    rows = [(None, base + " end"), (3, base), (4, base + " tail of it"), (None, prose(200, 9)), (None, prose(200, 9) + " x")]
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in out) == [("3", "3"), ("4", "3"), ("None", "3"), ("None", "None"), ("None", "None")]


def test_no_labels_reject_nothing_more(spark, edge_docs, labels):
    out = quality.judge(edge_docs, labels.limit(0))
    assert {r.doc_id for r in out.where("__kept").select("doc_id").collect()} == {5, 6, 7, 8, None}


def test_empty_benchmark(spark, edge_docs, bench_items):
    assert decontaminate.find(edge_docs, bench_items.limit(0)).where("size(__items) > 0").count() == 0


def test_benchmark_edges(spark, bench_items):
    docs = spark.createDataFrame([(1, "x ONE y"), (2, "A b c-d e f g h"), (3, "a b c d e f g h i")], "doc_id long, text string")
    got = {r.doc_id: (r["__items"], r["__runs"]) for r in decontaminate.find(docs, bench_items).collect()}
    assert got[1] == (["1", "4"], [1, 2])
    assert got[2] == (["4", "5"], [0, 8])
    assert got[3] == (["4", "5"], [0, 9])


def test_no_language_labels(spark, no_docs, edge_docs):
    languages, model = language_id.fit(no_docs)
    out = language_id.identify(edge_docs, languages, model, "text", "source").select("lang").distinct().collect()
    assert [r.lang for r in out] == [None]


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.com/en/7x?q"), (4, "x://com"), (5, "http://xcom/en/"), (6, "ftp://b.com/en/1#/fr/"), (6, "ftp://b.com/en/1#/fr/"), (7, "http://e.org://x/es/")], "page_id long, url string")
    rules = url_filter.rule_table(spark, [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("com", "/en/", "allow"), ("org", "", "block"), (None, "/", "block")])
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect())
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (4, "com", "", None, "allow"),
        (5, "xcom", "/en/", None, "allow"), (6, "b.com", "/en/1", "com/en/", "block"), (6, "b.com", "/en/1", "com/en/", "block"), (7, "e.org:", "//x/es/", None, "allow"),
    ]
    assert url_filter.judge(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0
