"""Near-duplicates by DartMinHash signatures and banded joining.

An element, a hashed shingle of five words, weighs as much as it occurs in
the text and owns the region ``[0, weight) x [0, inf)``.  Hashed darts fall
into the quarter plane as a Poisson process; the first axis is cut into the
cells ``[0, 1), [1, 2), [2, 4), [4, 8) ...``, each with its own sequence of
darts along the second axis, the rank, so an element of weight ``w`` looks into
``1 + log2(w)`` cells and keeps the darts below ``w``.  Weights may be any
positive numbers.  Every dart names one of ``K`` coordinates, and the earliest
dart of each coordinate is the signature.  Only ranks up to a bound at which a
text has about ``K (ln K + 4)`` darts are looked at; a text with an empty
coordinate doubles its bound.  So the work per text hardly depends on ``K`` or
on the weights, and two signatures agree in a coordinate with the probability
of the texts' weighted Jaccard similarity.

Two texts are near-duplicates if their weighted similarity is 0.8 or more, or
that of their plain shingle sets is.  A text in which a shingle repeats is
therefore signed twice, with its weights and with unit weights; for any other
text both are the same.

Texts that agree in one of ``BANDS`` bands of ``K / BANDS`` coordinates are
candidates; at similarity 0.8 a pair misses all bands with probability
(1 - 0.8**4)**24 = 3e-6.  Candidates are confirmed on their shingles.

Within a bucket a text is first compared with the bucket's lowest node and with
its ``NEAREST`` successors in node order, in sub-buckets of about ``PART``
nodes, and the links found are contracted.  In buckets of more nodes that are
not of one class by then, all texts of different classes are compared, block
by block (``BLOCK`` nodes, and ``ELEMENTS`` shingles or one text), as products
of set matrices, on the same hashes that confirm other pairs; a block pair
gives only the links that join classes.  So no candidate is left out.

Defined results
    Words are split at white space and lower-cased (A-Z).  A text of 1 to 4
    words is one shingle; texts without words are classes of their own.  Texts
    with the same words are one node however often they occur, and repeated
    rows all get its class.  The class id is the lowest id in the class.  Rows
    with a null id take part; a class of such rows only has a null class id,
    and a text without words and id as well.  Empty table: no rows.

Scale
    What is shuffled is 16 bytes per distinct text and band, the texts of
    candidates once, and the candidate pairs.  Buckets are counted map-side
    and never gathered: the join with a bucket's lowest node can be split, and
    windows run over sub-buckets of bounded expected size.  Only a bucket that
    stays in several classes is compared as a whole: its nodes' shingle sets go
    to (nodes / BLOCK) block pairs each, no pairs of rows are made.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _text
from ._graph import components
from ._native import columns, cut, meet

K, BANDS = 96, 24
SHINGLE, SIMILARITY = 5, 0.8
NEAREST, PART, BLOCK, ELEMENTS = 4, 1024, 256, 1 << 19
#: Rows whose darts are thrown together.
TOGETHER = 512
_NONE = np.uint64(2**64 - 1)


def _sets(buf: np.ndarray, off: np.ndarray, n: int):
    """Shingles of rows, their offsets, and a hash of each row's words."""
    low = _text.LOWER[buf]
    starts, ends, woff = _text.bounds(low, off, _text.NON_SPACE)
    h = _text.word_hashes(low, starts, ends)
    s, soff = _text.shingles(h, woff, n)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(woff[:-1], np.diff(woff)).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_text.mix(h + place * np.uint64(0x9E3779B97F4A7C15)))])
    return s, soff, _text.mix(sums[woff[1:]] - sums[woff[:-1]] + np.diff(woff).astype(np.uint64))


def weighted(s: np.ndarray, soff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, their counts, and the rows' offsets among them."""
    row = np.repeat(np.arange(len(soff) - 1), np.diff(soff))
    order = np.lexsort((s, row))
    e, row = s[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (row[1:] != row[:-1])])) if len(e) else np.zeros(0, np.int64)
    return e[first], np.diff(np.append(first, len(e))).astype(np.float64), np.searchsorted(row[first], np.arange(len(soff)))


def dart_signatures(e: np.ndarray, w: np.ndarray, eoff: np.ndarray, k: int = K) -> np.ndarray:
    """(rows, k) earliest darts of distinct elements ``e`` of weights ``w``: rank in the high bits, the dart's own hash in the low ones."""
    edges = [*range(0, len(eoff) - 1, TOGETHER), len(eoff) - 1]
    parts = [_darts(e[eoff[a] : eoff[b]], w[eoff[a] : eoff[b]], eoff[a : b + 1] - eoff[a], k) for a, b in zip(edges[:-1], edges[1:])]
    return np.concatenate(parts) if parts else np.zeros((0, k), np.uint64)


def _darts(e: np.ndarray, w: np.ndarray, eoff: np.ndarray, k: int) -> np.ndarray:
    rows, size = len(eoff) - 1, np.diff(eoff)
    table = np.full((rows, k), _NONE, np.uint64)
    total = np.diff(np.concatenate([[0.0], np.cumsum(w)])[eoff])
    bound = k * (math.log(k) + 4) / np.maximum(total, 1e-300)
    cells = 1 + np.ceil(np.log2(np.maximum(w, 1.0))).astype(np.int64)
    todo = np.flatnonzero(size)
    while len(todo):
        own_row = np.repeat(todo, size[todo])
        at = np.repeat(eoff[todo] - np.concatenate([[0], np.cumsum(size[todo])[:-1]]), size[todo]) + np.arange(len(own_row))
        n = cells[at]
        cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, row = np.repeat(at, n), np.repeat(own_row, n)
        width = np.where(cell == 0, 1.0, 2.0 ** (cell - 1))
        low = np.where(cell == 0, 0.0, width)
        below = w[at]
        seed = _text.mix(e[at] + cell.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        rank, i = np.zeros(len(seed)), 0
        flat = table.reshape(-1)
        while len(seed):
            i += 1
            dart = _text.mix(seed + np.uint64(i * 0xA0761D6478BD642F % 2**64))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
            inside = rank <= bound[row]
            seed, row, rank, dart, width, low, below = (x[inside] for x in (seed, row, rank, dart, width, low, below))
            own = _text.mix(dart ^ np.uint64(0xE7037ED1A0B428DB))
            spot = low + width * ((_text.mix(own ^ np.uint64(0x589965CC75374CC3)) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            hit = spot < below
            key = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (own[hit] >> np.uint64(32))
            np.minimum.at(flat, row[hit] * k + ((own[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64), key)
        todo = todo[(table[todo] == _NONE).any(axis=1)]
        bound[todo] *= 2
    return table


def _bands(table: np.ndarray, bands: int) -> np.ndarray:
    parts = table.reshape(len(table), bands, table.shape[1] // bands)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        h = _text.mix((h ^ parts[:, :, j]) * np.uint64(0xD6E8FEB86659FD93))
    return h.view(np.int64)


def band_values(s: np.ndarray, soff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band values of all rows, their offsets, and the distinct shingles of each row; a row with repeats has both kinds of bands."""
    e, w, eoff = weighted(s, soff)
    plain = _bands(dart_signatures(e, np.ones(len(w)), eoff), BANDS)
    repeats = np.diff(np.concatenate([[0], np.cumsum(w > 1)])[eoff]) > 0
    some = np.flatnonzero(repeats)
    inside = np.repeat(repeats, np.diff(eoff))
    counted = _bands(dart_signatures(e[inside], w[inside], np.concatenate([[0], np.cumsum(np.diff(eoff)[some])])), BANDS)
    also = counted != plain[some]
    row = np.concatenate([np.repeat(np.arange(len(eoff) - 1), np.where(np.diff(eoff) > 0, BANDS, 0)), np.repeat(some, also.sum(axis=1))])
    values = np.concatenate([plain[np.diff(eoff) > 0].reshape(-1), counted[also]])
    order = np.argsort(row, kind="stable")
    return values[order], np.searchsorted(row[order], np.arange(len(eoff))), np.diff(eoff)


def signed(docs: DataFrame, key: str, text: str, n: int = SHINGLE) -> DataFrame:
    """(key, h, node, size, bands): hashes of a row's text and of its words, its distinct shingles, and its band values; no bands without words."""

    def sign(batches):
        for batch in _text.slices(batches, text):
            s, soff, node = _sets(*_text.raw(batch.column(1)), n)
            values, boff, size = band_values(s, soff)
            bands = pa.ListArray.from_arrays(pa.array(boff.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node.view(np.int64)), pa.array(size.astype(np.int32)), bands], ["key", "h", "node", "size", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text), _hash(text))
    return rows.mapInArrow(sign, f"key {kind}, h long, node long, size int, bands array<long>")


def _hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")


def _reaches(both, a, b, similarity: float):
    """Whether ``both`` in common of ``a`` and ``b`` is a Jaccard similarity of at least ``similarity``."""
    return both >= similarity * (a + b - both) - 1e-6


def alike(s: np.ndarray, t: np.ndarray, similarity: float) -> bool:
    """Whether the shingles of two texts are, as sets or with their counts."""
    (x, m), (y, n) = np.unique(s, return_counts=True), np.unique(t, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return bool(_reaches(len(i), len(x), len(y), similarity) or _reaches(np.minimum(m[i], n[j]).sum(), len(s), len(t), similarity))


def _confirm(pairs: DataFrame, texts: DataFrame, similarity: float, n: int) -> DataFrame:
    """The pairs that are alike."""

    def compare(batches):
        for batch in _text.slices(_halved(batches), "text_b"):
            one, two = (_sets(*_text.raw(batch.column(i)), n)[:2] for i in (2, 3))
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                keep[r] = alike(one[0][one[1][r] : one[1][r + 1]], two[0][two[1][r] : two[1][r + 1]], similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    def _halved(batches):
        yield from _text.slices(batches, "text_a")

    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def _candidates(buckets: DataFrame) -> DataFrame:
    """Pairs to compare: with the lowest node of the bucket and with the next nodes of a sub-bucket.

    ``buckets``: (bucket, node, class, n, lowest); pairs of one class are left out.
    """
    w = Window.partitionBy("bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART).cast("long"))).orderBy("node")
    ahead = [F.lead(F.struct("node", "class"), i).over(w).alias(f"l{i}") for i in range(1, NEAREST + 1)]
    paired = buckets.select("node", "class", "lowest", *ahead)
    return (
        paired.select("node", "class", F.explode(F.array("lowest", *[f"l{i}" for i in range(1, NEAREST + 1)])).alias("o"))
        .where(F.col("o").isNotNull() & (F.col("o.class") != F.col("class")))
        .select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"))
        .distinct()
    )


def _in_buckets(members: DataFrame) -> DataFrame:
    """(bucket, node, size, class) with the bucket's nodes, shingles and lowest node, where it has two classes or more."""
    whole = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min(F.struct("node", "class")).alias("lowest"), F.min("class").alias("c0"), F.max("class").alias("c1")
    )
    # cut, so that both sides of the join are exchanges and a hot bucket can be split
    return members.join(cut(whole.where("c0 != c1").drop("c0", "c1")), "bucket")


def _sketches(texts: DataFrame, n: int) -> DataFrame:
    """(node, shingles, more): the set of shingles, and an element for each further occurrence of one."""

    def run(batches):
        for batch in _text.slices(batches, "text"):
            e, w, eoff = weighted(*_sets(*_text.raw(batch.column(1)), n)[:2])
            again = (w - 1).astype(np.int64)
            time = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again) + 1
            more = _text.mix(np.repeat(e, again) + time.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            moff = np.concatenate([[0], np.cumsum(again)])[eoff]
            lists = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x.view(np.int64))) for x, off in ((e, eoff), (more, moff))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["node", "shingles", "more"])

    return texts.mapInArrow(run, "node long, shingles array<long>, more array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0-1 matrices over the elements that two sets share."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [a, a + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[i:j], column[i:j] - a] = 1
        out += m @ m.T
    return out


def _joining(similarity: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between classes of one block pair: a spanning forest of them."""
        node, label, side = group["node"].to_numpy(), group["class"].to_numpy(), group["side"].to_numpy()
        sets, more = list(group["shingles"]), list(group["more"])
        size = np.array([len(x) for x in sets], np.float32)
        both = overlaps(sets)
        close = _reaches(both, size[:, None], size[None, :], similarity)
        if any(len(x) for x in more):
            both, size = both + overlaps(more), size + np.array([len(x) for x in more], np.float32)
            close |= _reaches(both, size[:, None], size[None, :], similarity)
        close &= label[:, None] != label[None, :]
        if (side != side[0]).any():
            close &= side[:, None] != side[None, :]
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found = []
        for a, b in zip(*np.nonzero(np.triu(close, 1))):
            x, y = root(label[a]), root(label[b])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((min(node[a], node[b]), max(node[a], node[b])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _all_links(buckets: DataFrame, texts: DataFrame, similarity: float, n: int) -> DataFrame:
    """Links that join classes, of all pairs of nodes in buckets that were not compared whole."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / ELEMENTS)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    dealt = (
        buckets.where(F.col("n") > NEAREST + 1)
        .select("bucket", "node", "class", own.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("bucket", "node", "class", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    )
    # in a pair of two blocks each node comes once, from its own side
    return dealt.join(_sketches(texts, n), "node").groupBy("bucket", "i", "j").applyInPandas(_joining(similarity), "a long, b long").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """One row per document: key, class_id, node."""
    rows = cut(signed(docs, key, text, n))
    nodes = rows.where(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"), F.first("size").alias("size"))
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"), F.col("node").alias("class"))
    buckets = cut(_in_buckets(members))
    wanted = buckets.select("node").distinct()
    # One row stands for a node, known by its id and its text, as an id may be null or stand on several texts.
    first = rows.groupBy("node").agg(F.min(F.struct("key", "h")).alias("at")).join(wanted, "node").select("node", F.col("at.key").alias("at"), F.col("at.h").alias("at_h"))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _hash(text))
    texts = cut(
        own.join(first, F.col("key").eqNullSafe(F.col("at")) & (F.col("h") == F.col("at_h"))).select("node", "text").dropDuplicates(["node"])
    )
    edges = cut(_confirm(_candidates(buckets), texts, similarity, n))
    found = components(edges)
    merged = buckets.where(F.col("n") > NEAREST + 1).select("bucket", "node", "size").join(found, "node", "left").select(
        "bucket", "node", "size", F.coalesce("component", "node").alias("class")
    )
    more = _all_links(_in_buckets(merged), texts, similarity, n)
    found = components(edges.unionAll(more))
    placed = rows.select("key", "node", F.size("bands").alias("some")).join(found, "node", "left").select(
        "key", "node", "some", F.coalesce("component", "node").alias("component")
    )
    lowest = cut(placed.where("some > 0").groupBy("component").agg(F.min("key").alias("class_id")))
    return (
        placed.where("some > 0").join(lowest, "component").select("key", "class_id", "node")
        .unionAll(placed.where("some = 0").select("key", F.col("key").alias("class_id"), "node"))
        .withColumnRenamed("key", key)
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each class: that with the lowest id; repeated rows of it once.

    Documents without words, and those with a null id, all stay.
    """
    found = cut(classes(docs, key, text, **how))
    named = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("class_id").alias("__class"), F.count("*").alias("__n"))
    left = meet(docs, named.where(F.col(key) != F.col("__class")).select(key), [key], "left_anti")
    again = named.where("__n > 1").select(key)
    # only rows of a repeated id are brought together
    return meet(left, again, [key], "left_anti").unionByName(meet(left, again, [key], "left_semi").dropDuplicates([key])).select(*columns(docs))
