"""The stages of the corpus pipeline, each on what its predecessor wrote, against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_brute_force import UPPER, WORD, base_pii, jaccard_classes

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Stage name to (input rows, output rows)."""
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        written = spark.read.parquet(f"{root}/{name}")
        out[name] = (docs.collect(), written.collect(), written.columns)
        docs = written
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_order_and_columns(spark, sf_dir, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "mix"]
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(c == columns for name, (_, _, c) in stages.items() if name != "mix")


def test_quality(stages):
    """So few labels certify no cutoff: the base rules decide."""
    before, after, _ = stages["quality"]

    def passes(text):
        w = WORD.findall(text or "")
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w)

    assert ids(after) == sorted(r.doc_id for r in before if passes(r.text))


def test_near_duplicates(stages):
    before, after, _ = stages["near_dedup"]
    classes = jaccard_classes({r.doc_id: r.text for r in before})
    assert ids(after) == sorted(i for i, c in classes.items() if i == c)


def test_decontamination(spark, sf_dir, stages):
    """No document with even one window of one item is left, and all others are."""
    before, after, _ = stages["decontaminate"]
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = ALNUM.findall((r.text or "").translate(UPPER))
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(r.item_id)

    def items(text):
        w = ALNUM.findall((text or "").translate(UPPER))
        return {x for n in range(1, 9) for i in range(len(w) - n + 1) for x in windows.get(tuple(w[i : i + n]), ())}

    assert ids(after) == sorted(r.doc_id for r in before if not items(r.text))
    assert len(after) < len(before)


def test_personal_data(stages):
    before, after, _ = stages["pii"]
    texts = {r.doc_id: r.text for r in after}
    assert ids(after) == ids(before)
    assert any(base_pii(r.text) for r in before)
    for r in before:
        spans = base_pii(r.text)
        if not spans:
            assert texts[r.doc_id] == r.text
        else:
            assert not base_pii(texts[r.doc_id]) and "[" in texts[r.doc_id]


def test_mixture(stages):
    before, after, _ = stages["mix"]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += size[r.doc_id]
    for r in after:
        assert len(WORD.findall(r.text)) == r.taken
        taken[r.source] += r.taken
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    room = sorted(sizes, key=lambda s: (3 * sizes[s] / weights[s], s))
    total, used, free = sum(sizes.values()), 0.0, sum(weights.values())
    want = {}
    for s in room:
        level = (total - used) / free
        want[s] = min(3 * sizes[s], level * weights[s])
        used, free = used + want[s], free - weights[s]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_run_chains_the_stages(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).agg(F.sum("taken"), F.count("*")).first()
    _, after, _ = stages["mix"]
    assert tuple(rows) == (sum(r.taken for r in after), len(after))
