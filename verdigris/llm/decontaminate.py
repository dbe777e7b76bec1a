"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (all its words, if fewer).
A document contains a window only if it contains every word of it, so one
word of the window, the rarest in the documents, is the whole necessary
prefix.  The windows are a table keyed by that word, its place in the window
and the window itself.  A document offers each of its words that is some
window's prefix, at every place whose window fits into the document (bounds
of position and length), and both sides meet in one equi-join, which compares
the words themselves.

Before the join two sieves of hash bits, one of the prefix words and one of
the windows, keep what cannot match out of it.  They have at most ``BITS``
bits each; of a larger benchmark they let more through, and the join decides.

Defined results
    Words are lower-cased (A-Z).  Null or empty texts have no words and are
    never hit; items without words, or with a null id, have no windows.  Items
    that share a window are all counted; several rows of one item id are one
    item with the windows of all.  Ties of rarity go to the lower hash.
    Repeated documents are judged one by one and alike.  An empty benchmark
    hits nothing.  Other columns pass through untouched; internal columns have
    names with ``__``.

Scale
    Two readings of the documents (rarity of the benchmark's words, then
    places), whatever the size of the benchmark; ``find`` reads them once more
    and counts their words.  What is shuffled is benchmark windows and the places that pass the sieves, which are nearly
    the matches alone; a text is shuffled only where hits are joined back to
    it and are more than may be broadcast.  Nothing of the benchmark but the
    sieves reaches the driver.  A window in many documents or items is a hot
    key of a join that can be split, or of none, where the windows are few
    enough to be broadcast (measured first).  An item of any length is cut
    into windows ``STEP`` at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import _text
from ._native import columns, cut, map_arrow, meet

WINDOW = 8
#: Most bits of a sieve: 16 MB.
BITS = 1 << 27
_PAGE = 1 << 13
#: Windows of an item, or places of documents, in one batch.
STEP = 1 << 16
WORDS, RUNS, ITEMS = "__n_words", "__runs", "__items"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _hashed(column):
    """Lower-cased bytes, word starts and ends, rows' offsets among the words, and word hashes."""
    buf, off = _text.raw(column)
    low = _text.LOWER[buf]
    starts, ends, woff = _text.bounds(low, off, _text.ALNUM)
    return low, starts, ends, woff, _text.word_hashes(low, starts, ends)


def _joined(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each of ``at``."""
    out = np.full(len(at), n, np.uint64)
    for j in range(n):
        out = (out ^ h[at + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return _text.mix(out)


def _phrase(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, n: int) -> str:
    return b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(a, a + n)).decode()


class Sieve:
    """Bits of a set of hashes; false for a hash that is not in the set, but for a few."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(65 - (len(bits) * 8).bit_length())

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, hashes: DataFrame) -> Sieve:
        """From a column ``h`` of distinct hashes; its pages, ``BITS`` at most in all, are filled apart and gathered."""
        size = min(BITS, max(_PAGE, 1 << (256 * hashes.count()).bit_length()))
        at = F.shiftrightunsigned("h", 65 - size.bit_length())
        spots = hashes.select(at.alias("at")).distinct().select(F.floor(F.col("at") / _PAGE).alias("page"), F.pmod("at", F.lit(_PAGE)).alias("bit"))

        def fill(group: pd.DataFrame) -> pd.DataFrame:
            bits = np.zeros(_PAGE, bool)
            bits[group["bit"].to_numpy()] = True
            return pd.DataFrame({"page": group["page"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        table = np.zeros(size // 8, np.uint8)
        for r in spots.groupBy("page").applyInPandas(fill, "page long, bits binary").collect():  # at most BITS
            table[r.page * _PAGE // 8 : (r.page + 1) * _PAGE // 8] = np.frombuffer(r.bits, np.uint8)
        return cls(table)


def windows_of(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item, n, win, w, hs): every window of every item, its hash and its words' hashes."""

    def split(batches):
        for batch in _text.slices(batches, "text"):
            low, starts, ends, woff, h = _hashed(batch.column(1))
            count = np.diff(woff)
            n = np.minimum(count, size)
            made = np.where(count > 0, count - n + 1, 0)
            row = np.repeat(np.arange(len(count)), made)
            at = woff[row] + np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made)
            for i in range(0, len(row), STEP):
                r, a = row[i : i + STEP], at[i : i + STEP]
                hashes = np.zeros(len(a), np.uint64)
                for k in np.unique(n[r]):
                    of = n[r] == k
                    hashes[of] = _joined(h, a[of], int(k))
                ends_ = np.concatenate([[0], np.cumsum(n[r])]).astype(np.int32)
                words = np.concatenate([h[x : x + k] for x, k in zip(a, n[r])]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(r)), pa.array(n[r].astype(np.int32)), pa.array([_phrase(low, starts, ends, x, k) for x, k in zip(a, n[r])], pa.string()),
                        pa.array(hashes.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends_), pa.array(words)),
                    ],
                    ["item", "n", "win", "w", "hs"],
                )

    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(split, "item string, n int, win string, w long, hs array<long>").distinct()


def _rarity(docs: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """(h, c): occurrences in all documents of the words ``h``."""
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(words))

    def count(batches):
        kept, size = [], 0
        for batch in _text.slices(batches, text):
            h = _hashed(batch.column(0))[4]
            kept.append(np.unique(h[sieve.value(h)], return_counts=True))
            size += len(kept[-1][0])
            if size > 4_000_000:
                yield _text.summed(kept, "h", "c")
                kept, size = [], 0
        if kept:
            yield _text.summed(kept, "h", "c")

    counts = docs.select(text).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return words.join(counts, "h", "left").select("h", F.coalesce("c", F.lit(0).cast("long")).alias("c"))


def keyed(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """(k, place, n, win, w, item): the windows by the hash and the place of their rarest word."""
    shapes = windows.select("win", "n", "w", "hs").dropDuplicates(["win"])
    rarest = (
        shapes.select("win", F.posexplode("hs").alias("place", "h"))
        .join(rarity, "h")
        .groupBy("win")
        .agg(F.min(F.struct("c", "h", "place")).alias("r"))
        .select("win", F.col("r.h").alias("k"), F.col("r.place").alias("place"))
    )
    return windows.select("item", "n", "win", "w").join(rarest, "win").select("k", "place", "n", "win", "w", "item")


def _places(docs: DataFrame, prefixes: Sieve, windows: Sieve, sizes: list[int]) -> DataFrame:
    """(k1, k2, at, k, place, n, win): the windows of documents (k1, k2, text) that may be one of the benchmark's."""
    shared = docs.sparkSession.sparkContext.broadcast((prefixes, windows))

    def offer(batches):
        is_prefix, is_window = shared.value
        for batch in _text.slices(batches, "text"):
            low, starts, ends, woff, h = _hashed(batch.column(2))
            all_pos = np.flatnonzero(is_prefix(h))
            for i in range(0, len(all_pos), STEP):
                pos = all_pos[i : i + STEP]
                row = np.searchsorted(woff, pos, "right") - 1
                out = []
                for n in sizes:
                    for place in range(n):
                        at = pos - place
                        fits = (at >= woff[row]) & (at + n <= woff[row + 1])
                        a, r, p = at[fits], row[fits], pos[fits]
                        some = is_window(_joined(h, a, n))
                        out.append((r[some], a[some], p[some], np.full(some.sum(), place), np.full(some.sum(), n)))
                r, a, p, place, n = (np.concatenate(c) for c in zip(*out))
                phrases = [_phrase(low, starts, ends, x, k) for x, k in zip(a.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array(a - woff[r]), pa.array(h[p].view(np.int64)),
                        pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(phrases, pa.string()),
                    ],
                    ["k1", "k2", "at", "k", "place", "n", "win"],
                )

    return docs.mapInArrow(offer, "k1 long, k2 long, at long, k long, place int, n int, win string")


def _named(docs: DataFrame, text: str) -> DataFrame:
    """Documents with two hashes of their text, by which equal texts are known."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"__k1": F.xxhash64(body), "__k2": F.xxhash64(body, F.lit(1))})


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(``__k1``, ``__k2``, runs, items) of every text in which an item's window occurs."""
    windows = cut(windows_of(benchmark, item, item_text, size))
    sizes = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most ``size`` numbers
    words = cut(windows.select(F.explode("hs").alias("h")).distinct())
    keys = cut(keyed(windows, _rarity(docs, text, words)))
    prefixes, of = Sieve.of(keys.select(F.col("k").alias("h")).distinct()), Sieve.of(keys.select(F.col("w").alias("h")).distinct())
    texts = _named(docs, text).select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col(text).alias("text"))
    met = meet(_places(texts, prefixes, of, sizes), keys.select("k", "place", "win", "item"), ["k", "place", "win"])
    found = met.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(
        F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spots"),  # at most the places of one text
        F.array_sort(F.collect_set("item")).alias(ITEMS),
    )
    return map_arrow(found, _merge, T.StructType([*found.schema.fields[:2], T.StructField(RUNS, T.ArrayType(T.LongType())), found.schema.fields[3]]))


def _merge(batches):
    """Places as disjoint runs of words, flat: start, end, start, end ..."""
    for batch in batches:
        runs = []
        for spots in batch.column(2).to_pylist():
            out: list[int] = []
            for s in spots:
                a, b = s["at"], s["at"] + s["n"]
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], b)
                else:
                    out += [a, b]
            runs.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int64())), batch.column(3)], ["__k1", "__k2", RUNS, ITEMS])


def n_words(text: Column) -> Column:
    """Number of words; what stands between them cuts a text into one piece more."""
    t = F.coalesce(text, F.lit(""))
    ends = t.rlike(r"\A" + _GAP).cast("int") + t.rlike(_GAP + r"\z").cast("int")
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, _GAP + "+", -1)) - ends).cast("long")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """The documents with their words, hit word runs and items found."""
    found = hits(docs, benchmark, text, item, item_text, size)
    named = _named(docs, text).withColumn(WORDS, n_words(F.col(text)))
    own = columns(docs, () if keep_text else (text,))
    met = meet(named.select(*own, "__k1", "__k2", WORDS), found, ["__k1", "__k2"], "left")
    return met.select(
        *own, WORDS, F.coalesce(RUNS, F.array().cast("array<bigint>")).alias(RUNS), F.coalesce(ITEMS, F.array().cast("array<string>")).alias(ITEMS)
    )


def contaminated(least: int = 2) -> Column:
    return F.size(ITEMS) >= least


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 1, **how) -> DataFrame:
    """The documents in which fewer than ``least`` items occur."""
    bad = hits(docs, benchmark, **how).where(contaminated(least)).select("__k1", "__k2")
    return meet(_named(docs, how.get("text", "text")), bad, ["__k1", "__k2"], "left_anti").select(*columns(docs))
