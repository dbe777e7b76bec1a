"""Language identification by Bayesian fusion of evidence.

``P(language | row)`` is in proportion to the product of

* the likelihood of the text under hashed trigram models, tempered so that a
  long text counts as ``EFFECTIVE`` trigrams (neighbouring ones depend);
* ``P(declared language | language)`` of the markup, and ``P(address suffix |
  language)``, both smoothed shares of grouped sums;
* the host's prior, smoothed towards its domain's, that towards the whole
  table's, with ``KAPPA`` pseudo-rows at each level.

The grouped sums are of the rows' text posteriors, so nothing is labelled but
the training texts.

Defined results
    Text that is null or without letters: no text evidence; the posterior is
    that of the other evidence.  Null host or no declared language: that
    evidence is left out (the row then shares the null host's prior, which is
    the table's).  Ties go to the first language in code point order.  Without
    training texts language and probability are null.  Repeated rows are
    judged each; empty table: no rows.  Of the input only the named columns
    are read.

Scale
    Two readings: the texts where they lie, then rows of a few numbers.  Sums
    per (host, declared) are made map-side; the rows meet them in one
    equi-join that can be split at a hot host.  Models are fitted on at most
    about ``SAMPLE`` texts of each labelled language (a documented bound),
    chosen by a hash of the id and the text; no language is left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import _text
from ._native import ascii_lower, columns, cut, let, map_arrow

SAMPLE = 4000
BUCKETS = 1 << 14
EFFECTIVE, KAPPA = 64, 10.0
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", re.S | re.I)
_DECLARED = r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})"""


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams, and the row of each; runs of other characters are one space."""
    b = _LETTER[buf]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[keep]
    b = b[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    same = row[:-2] == row[2:]
    return ((code[same] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), row[:-2][same]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, (languages, BUCKETS)."""
    named = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = named.groupBy(label).count().collect()
    languages = sorted(r[0] for r in rows)
    if not languages:
        return [], np.zeros((0, BUCKETS))
    share = F.create_map(*[F.lit(x) for r in rows for x in (r[0], int(min(1.0, sample / r[1]) * (1 << 20)))])
    chosen = F.pmod(F.xxhash64(key, text), F.lit(1 << 20)) < F.element_at(share, F.col(label))

    def count(batches):
        total = {}
        for batch in _text.slices(batches, "t"):
            k, row = trigrams(*_text.raw(batch.column(1)))
            which = np.searchsorted(languages, batch.column(0).to_pylist())[row]
            for i in np.unique(which):
                total[i] = total.get(i, 0) + np.bincount(k[which == i], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n.astype(np.int64).tobytes() for n in total.values()], pa.binary())], ["i", "n"])

    # a bounded sample of each language, so a fixed number of partitions
    parts = named.where(chosen).select(F.col(label).alias("l"), F.col(text).alias("t")).repartition(8).mapInArrow(count, "i long, n binary").collect()
    total = np.full((len(languages), BUCKETS), 0.5)
    for p in parts:
        total[p.i] += np.frombuffer(p.n, np.int64)
    return languages, np.log(total / total.sum(axis=1, keepdims=True))


def strip_markup(html: str) -> str:
    return _DROP.sub(" ", html)


def read_text(rows: DataFrame, model: np.ndarray, text: str, markup: bool) -> DataFrame:
    """Replaces the text column by ``__ll``, its tempered log-likelihood in each language."""
    given = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema.fields if f.name != text]

    def run(batches):
        for batch in _text.slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            names = [c for c in batch.schema.names if c != text]
            if markup:
                column = pa.array([strip_markup(t or "") for t in column.to_pylist()], pa.string())
            k, row = trigrams(*_text.raw(column))
            n = np.bincount(row, minlength=batch.num_rows)
            temper = np.minimum(1.0, EFFECTIVE / np.maximum(n, 1))
            ll = np.stack([np.bincount(row, m[k], batch.num_rows) * temper for m in given.value], axis=1)
            values = pa.FixedSizeListArray.from_arrays(pa.array(ll.ravel()), ll.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], values], [*names, "__ll"])

    return map_arrow(rows, run, T.StructType([*kept, T.StructField("__ll", T.ArrayType(T.DoubleType()))]))


def _softmax(ll: Column) -> Column:
    return let(
        let(F.array_max(ll), lambda m: F.transform(ll, lambda x: F.exp(x - m))),
        lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s)),
    )


def _sums(df: DataFrame, by: list[str], n: int, column: str = "__post") -> DataFrame:
    return df.groupBy(*by).agg(F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(n)]).alias("sum"))


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, text: str, host: str, declared: str | None = None, markup: bool = False) -> DataFrame:
    """The other columns of ``rows`` with ``lang``, ``probability`` and ``text_lang``, in the place of columns so named.

    ``declared``: column of the declared language; with ``markup`` the text is
    HTML and its declaration is read where ``declared`` is None.
    """
    own = columns(rows, (text, host, "lang", "probability", "text_lang"))
    said = F.col(declared) if declared else F.regexp_extract(text, _DECLARED, 1) if markup else F.lit(None).cast("string")
    said = ascii_lower(F.coalesce(said, F.lit("")))
    rows = rows.select(*own, F.coalesce(host, F.lit("")).alias("__host"), said.alias("__said"), F.col(text).alias("__text"))
    if not languages:
        return rows.select(*own, *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"))])
    n = len(languages)
    names = F.array(*map(F.lit, languages))
    read = cut(read_text(rows, model, "__text", markup).withColumn("__post", _softmax(F.col("__ll"))))

    groups = cut(_sums(read, ["__host", "__said"], n).withColumnRenamed("sum", "__post"))
    labels = F.split("__host", r"\.", -1)
    groups = groups.withColumn("__domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).withColumn(
        "__suffix", F.element_at(labels, -1)
    )
    total = _sums(groups, [], n).select(F.col("sum").alias("all"))
    hosts = _sums(groups, ["__host"], n).withColumnRenamed("sum", "h")
    domains = _sums(groups, ["__domain"], n).withColumnRenamed("sum", "d")
    kinds = lambda c: _sums(groups, [c], n).withColumnRenamed("sum", f"s{c}")
    many = groups.agg(F.count_distinct("__said").alias("n_said"), F.count_distinct("__suffix").alias("n_suffix"))

    plus = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda counts, prior: F.zip_with(counts, prior, lambda c, p: (c + KAPPA * p) / (plus(counts) + KAPPA))
    given = lambda counts, kinds_: F.zip_with(counts, "all", lambda c, a: F.log((c + 0.5) / (a + 0.5 * (F.col(kinds_) + 1))))
    none = F.array(*[F.lit(0.0)] * n)
    prior = (
        groups.select("__host", "__said", "__domain", "__suffix")
        .join(hosts, "__host")
        .join(domains, "__domain")
        .join(kinds("__suffix"), "__suffix")
        .join(kinds("__said"), "__said")
        .crossJoin(F.broadcast(total.crossJoin(many)))  # one row
        .withColumn("p0", F.transform("all", lambda x: (x + 1) / (plus(F.col("all")) + n)))
        .withColumn("p1", smooth(F.col("d"), F.col("p0")))
        .withColumn("p2", F.when(F.col("__host") == "", F.col("p0")).otherwise(smooth(F.col("h"), F.col("p1"))))
        .withColumn("e1", F.when(F.col("__said") == "", none).otherwise(given(F.col("s__said"), "n_said")))
        .withColumn("e2", F.when(F.col("__host") == "", none).otherwise(given(F.col("s__suffix"), "n_suffix")))
        .select("__host", "__said", F.zip_with(F.zip_with("p2", "e1", lambda p, e: F.log(p) + e), "e2", lambda a, b: a + b).alias("__prior"))
    )
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return (
        read.join(prior, ["__host", "__said"])
        .withColumn("__fused", _softmax(F.zip_with("__ll", "__prior", lambda a, b: a + b)))
        .select(*own, best(F.col("__fused")).alias("lang"), F.array_max("__fused").alias("probability"), best(F.col("__ll")).alias("text_lang"))
    )
