"""Removal of long byte strings that stand elsewhere as well.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else
in the collection, the same document included, is removed.

Method: a column-wise construction over a collection of strings.  In each
round every string is extended by one symbol to the left; the suffixes
inserted so far are kept in collection order (the order in which a
Burrows-Wheeler transform lists their symbols) together with the common
prefixes of neighbours, and both are updated from the round's column of
symbols alone, which is read sequentially from a file.  Neighbours with a
common prefix of ``LENGTH`` start equal strings.

Taken over whole documents that needs as many rounds as the longest document
has bytes, each over all data.  So the collection is first cut into short
strings.  The place of the least hash of a ``KMER``-byte window within the
``LENGTH`` bytes from a start is the start's anchor: it depends on these bytes
only, so equal strings have equal anchors at equal distances.  Starts with the
same anchor are one run; runs whose anchor hash stands only once in the
collection cannot repeat and are dropped.  Runs of the same content repeat as
a whole; one of them stands for all.  Contents are compared by a cryptographic
digest of their bytes (BLAKE2b, 128 bits) beside the anchor's hash, as the
bytes of all runs together would be four times the input.  Where an anchor
hash has runs of several contents, these become strings of less than ``2
LENGTH`` bytes, aligned at their anchors and grouped by anchor hash, and ``2
LENGTH`` rounds suffice.  A round reads its column of symbols and the order and
common prefixes of the round before from files, front to back, and writes the
new order and common prefixes to files.  As only suffixes at equal distances
from their anchors can be equal, a round orders its own suffixes and need not
merge them into those of all rounds.

Defined results
    Texts are taken as UTF-8 bytes, null as empty.  Matches do not cross
    documents.  Texts under ``LENGTH`` bytes lose nothing.  Repeated rows are
    documents of their own, so a repeated row of ``LENGTH`` bytes or more is
    removed whole each time.  Rows are known by two hashes of key and text, so
    null or repeated keys do no harm.  Empty table: no rows.

Scale
    About 1 run per 140 bytes is shuffled (48 bytes each), summed map-side to
    count contents, and once more to meet the counts.  Texts are shuffled to
    cut the strings out and to remove the spans.  A group of more than
    ``PART`` contents is dealt to parts by a hash; each part resolves
    the strings it holds twice and passes one of each on, by hash, to meet the
    other parts'.  A task holds about ``MEMORY`` bytes of strings at a time,
    cut at group ends.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text
from ._native import cut

LENGTH, KMER = 400, 32
PART = 16384
MEMORY = 8 << 20
_STEP = 1_000_000
_LOW = np.uint64((1 << 20) - 1)


def _kmer_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the KMER bytes from every position on (KMER is a power of two)."""
    h, m, base = _text._BYTE[buf], 1, 0x9E3779B97F4A7C15
    while m < KMER:
        h = h[:-m] * np.uint64(pow(base, m, 2**64)) + h[m:]
        m *= 2
    return _text.mix(h)


def runs(buf: np.ndarray, off: np.ndarray, length: int = LENGTH):
    """(row, first start, last start, anchor, anchor hash) of all runs, positions within the row."""
    width = length - KMER + 1
    out = []
    row_end = np.repeat(off[1:], np.diff(off))
    for a in range(0, max(len(buf) - length + 1, 0), _STEP):
        part = buf[a : a + _STEP + length - 1]
        h = _kmer_hashes(part)
        n = len(h) - width + 1
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        m, size = key, 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[:n], m[width - size : width - size + n])
        anchor = (m & _LOW).astype(np.int64)
        start = np.flatnonzero(np.arange(a, a + n) + length <= row_end[a : a + n])
        if not len(start):
            continue
        anchor = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        p1, p2, x = start[first], start[last], anchor[first]
        out.append((p1 + a, p2 + a, x + a, h[x]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    p1, p2, x, g = (np.concatenate(c) for c in zip(*out))
    row = np.searchsorted(off, p1, "right") - 1
    return row, p1 - off[row], p2 - off[row], x - off[row], g


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """(n, 2) digests of stretches of ``data``, each with a number that belongs to its content."""
    more = np.zeros(len(starts), np.int64) if more is None else more
    found = [
        hashlib.blake2b(data[a:b], digest_size=16, salt=m.to_bytes(8, "little")).digest() for a, b, m in zip(starts.tolist(), ends.tolist(), more.tolist())
    ]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


class _Columns:
    """The symbols of all strings, one stripe per round, in an unnamed file read front to back."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, rounds: range, block: int = 64):
        self.n, self.file = len(at), tempfile.TemporaryFile()
        for i in range(0, len(rounds), block):
            cols = np.array(rounds[i : i + block])
            spots = np.clip(at[None, :] + cols[:, None], 0, len(flat) - 1)
            self.file.write(flat[spots].tobytes())
        self.file.seek(0)

    def read(self) -> np.ndarray:
        return np.frombuffer(self.file.read(self.n), np.uint8)

    def close(self) -> None:
        self.file.close()


class _State:
    """An array that one round leaves to the next, through an unnamed file."""

    def __init__(self, kind: type):
        self.kind, self.file = kind, tempfile.TemporaryFile()

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.kind)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.file.write(values.astype(self.kind, copy=False).tobytes())

    def close(self) -> None:
        self.file.close()


def insert_columns(flat: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray, group: np.ndarray, length: int = LENGTH):
    """Yields (d, order, common) for d = 0, 1, ...: the strings with a symbol at ``-d``, in order.

    ``order`` and ``common`` go through a file from round to round.  The round's
    symbols in the order of the round before are its part of the
    Burrows-Wheeler transform; a stable sort by them gives the next order.

    String ``i`` has its anchor at ``flat[at[i]]`` and covers the offsets from
    ``-most[i]`` up to ``length - least[i]``.  ``common[t]`` is the common
    prefix of ``order[t - 1]`` and ``order[t]`` from ``-d`` on, 0 between groups.
    """
    top, bottom = length - 1 - least, -most
    rounds = range(int(top.max()), int(bottom.min()) - 1, -1)
    enters = np.argsort(-top, kind="stable")
    entered = 0
    columns = _Columns(flat, at, rounds)
    orders, prefixes = _State(np.int64), _State(np.int32)
    for j in rounds:
        symbols, order, common = columns.read(), orders.read(), prefixes.read()
        kept = np.flatnonzero(bottom[order] <= j)
        if len(kept) < len(order):
            if len(kept):
                common = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
            else:
                common = common[:0]
            order = order[kept]
        to = entered
        while to < len(enters) and top[enters[to]] >= j:
            to += 1
        if to > entered:  # a new string is its own end, before all others
            common = np.concatenate([np.zeros(to - entered, np.int32), common])
            if to - entered < len(common):
                common[to - entered] = 0
            order, entered = np.concatenate([enters[entered:to], order]), to
        key = group[order] * 256 + symbols[order]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        fresh = np.zeros(len(order), np.int32)
        if len(same):
            pairs = np.stack([moved[same - 1] + 1, moved[same] + 1], axis=1).ravel()
            fresh[same] = np.minimum.reduceat(np.append(common, np.int32(2**30)), pairs)[::2] + 1
        order, common = order[moved], fresh
        orders.write(order)
        prefixes.write(common)
        if j <= 0:
            yield -j, order, common
    for file in (columns, orders, prefixes):
        file.close()


def _resolve(rows: list[tuple], length: int) -> list[pa.RecordBatch]:
    """Repeated intervals of whole groups; of parts of a group, one of each string as well.

    ``rows``: (group, k1, k2, bytes, first starts, last starts, anchors, repeats, is_part).
    A run that repeats as a whole is there for the others only.
    """
    names = ["k1", "k2", "a", "b", "w1", "w2"]
    flat = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])[:-1]])
    n = np.array([len(r[4]) for r in rows])
    row = np.repeat(np.arange(len(rows)), n)
    p1, p2, x = (np.concatenate([np.asarray(r[i], np.int64) for r in rows]) for i in (4, 5, 6))
    origin = np.array([r[4][0] for r in rows])[row]
    at = base[row] + x - origin
    _, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
    group = group[row]
    k1, k2 = (np.array([r[i] for r in rows], np.int64)[row] for i in (1, 2))
    known = np.concatenate([np.asarray(r[7], bool) for r in rows])
    part = np.array([r[8] for r in rows])[row]
    least, most = x - p2, x - p1
    hit = np.zeros((len(x), int(most.max()) + 1), bool)
    reps = []
    for d, order, common in insert_columns(flat, at, least, most, group, length):
        long = common >= length
        twice = long.copy()
        twice[:-1] |= long[1:]
        hit[order[twice], d] = True
        one = order[~long & part[order] & (least[order] <= d)]
        if len(one):
            reps.append((one, np.full(len(one), d)))
    hit |= known[:, None]
    edge = np.diff(np.pad(hit & ~known[:, None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    none = pa.nulls(len(i), pa.int64())
    out = [pa.RecordBatch.from_arrays([pa.array(k1[i]), pa.array(k2[i]), pa.array(x[i] - hi + 1), pa.array(x[i] - lo + length), none, none], names)]
    if reps:
        i, d = (np.concatenate(c) for c in zip(*reps))
        w1, w2 = _digests(flat.tobytes(), at[i] - d, at[i] - d + length).T
        start = x[i] - d
        # a string that is already known to repeat is there for others: an empty interval
        end = np.where(hit[i, d], start, start + length)
        out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in (k1[i], k2[i], start, end, w1, w2)], names))
    return out


def _cut_strings(length: int, part: int):
    def run(batches):
        names = ["g", "salt", "is_part", "k1", "k2", "bytes", "p1", "p2", "x", "known"]
        for batch in _text.slices(batches, "text"):
            buf, off = _text.raw(batch.column(2))
            data = buf.tobytes()
            out = [[] for _ in names]
            for r, (k1, k2, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                found.sort(key=lambda f: f["p1"])
                i = 0
                while i < len(found):
                    j = i + 1  # neighbouring runs of one hash (a short period) share their bytes
                    while j < len(found) and found[j]["g"] == found[i]["g"] and found[j]["p1"] == found[j - 1]["p2"] + 1:
                        j += 1
                    run_ = found[i:j]
                    parts = -(-run_[0]["n"] // part)
                    a, b = run_[0]["p1"], run_[-1]["p2"] + length
                    values = (
                        run_[0]["g"], hash((k1, k2, a)) % parts, parts > 1, k1, k2, data[off[r] + a : off[r] + b],
                        *[[f[c] for f in run_] for c in ("p1", "p2", "x", "known")],
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                    i = j
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return run


def _find(length: int):
    """Over strings sorted by group: resolves whole groups, about MEMORY bytes at a time."""

    def run(batches):
        rows, size = [], 0
        for batch in _text.slices(batches, "bytes"):
            columns = [c.to_pylist() for c in batch.columns]
            for g, salt, is_part, k1, k2, data, p1, p2, x, known in zip(*columns):
                if size >= MEMORY and (g, salt) != rows[-1][9]:
                    yield from _resolve(rows, length)
                    rows, size = [], 0
                rows.append((g, k1, k2, data, p1, p2, x, known, is_part, (g, salt)))
                size += len(data)
        if rows:
            yield from _resolve(rows, length)

    return run


def repeated(docs: DataFrame, length: int = LENGTH, part: int = PART) -> DataFrame:
    """(k1, k2, spans) to remove of documents (k1, k2, text)."""

    def extract(batches):
        for batch in _text.slices(batches, "text"):
            buf, off = _text.raw(batch.column(2))
            row, p1, p2, x, g = runs(buf, off, length)
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            place = (p1 << 20) | ((p2 - p1) << 10) | (x - p1)
            s1, s2 = _digests(buf.tobytes(), off[row] + p1, off[row] + p2 + length, ((p2 - p1) << 10) | (x - p1)).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (g.view(np.int64), s1, s2, k1[row], k2[row], place)], ["g", "s1", "s2", "k1", "k2", "place"])

    all_runs = docs.mapInArrow(extract, "g long, s1 long, s2 long, k1 long, k2 long, place long")
    # Runs of equal content are one kind; one run stands for it.
    kinds = all_runs.groupBy("g", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at"))
    groups = kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = cut(kinds.join(groups, "g", "left").where("n > 1 OR kinds > 1"))
    first = F.shiftright(F.col("place"), 20)
    span = lambda c: F.shiftright(F.col(c), 10).bitwiseAND(1023)
    whole = all_runs.join(kinds.where("n > 1").select("g", "s1", "s2"), ["g", "s1", "s2"]).select(
        "k1", "k2", first.alias("a"), (first + span("place") + length).alias("b")
    )
    at = F.col("at.place")
    p1 = F.shiftright(at, 20).cast("int")
    per_text = (
        kinds.where("kinds > 1")
        .select(
            "at.k1", "at.k2",
            F.struct(
                "g", F.col("kinds").alias("n"), (F.col("n") > 1).alias("known"), p1.alias("p1"),
                (p1 + span("at.place").cast("int")).alias("p2"), (p1 + at.bitwiseAND(1023).cast("int")).alias("x"),
            ).alias("f"),
        )
        .groupBy("k1", "k2")
        .agg(F.collect_set("f").alias("found"))  # at most the runs of one text
    )
    strings = docs.join(per_text, ["k1", "k2"]).select("k1", "k2", "text", "found").mapInArrow(
        _cut_strings(length, part),
        "g long, salt long, is_part boolean, k1 long, k2 long, bytes binary, p1 array<int>, p2 array<int>, x array<int>, known array<boolean>",
    )
    found = (
        strings.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInArrow(_find(length), "k1 long, k2 long, a long, b long, w1 long, w2 long")
        .repartition("k1", "k2")  # one exchange, which both readers below reuse
    )
    parts = found.where("w1 is not null")
    met = parts.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    spans = whole.unionAll(found.where("w1 is null").select("k1", "k2", "a", "b")).unionAll(
        parts.where("b > a").join(met, ["w1", "w2"]).select("k1", "k2", "a", "b")
    )
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def remove_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``data``, and the number of maximal runs removed."""
    kept, at, n = [], 0, 0
    last = None
    for a, b in sorted(spans):
        if last is None or a > last:
            kept.append(data[at:a])
            n += 1
            last = b
        else:
            last = max(last, b)
        at = last
    kept.append(data[at:])
    return b"".join(kept), n


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, part: int = PART) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), body).alias("k1"), F.xxhash64(body, F.lit(1)).alias("k2"), body.alias("text"))
    spans = repeated(rows.select("k1", "k2", "text"), length, part)

    def strip(batches):
        for batch in _text.slices(batches, "text"):
            out = []
            for data, found in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                kept, n = remove_spans(data, [(s["a"], s["b"]) for s in found])
                out.append((len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            removed, n, sha = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], ["k1", "k2", "n_removed", "n_spans", "sha"])

    stripped = (
        rows.select("k1", "k2", "text").join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans")
        .mapInArrow(strip, "k1 long, k2 long, n_removed long, n_spans long, sha string")
        .dropDuplicates(["k1", "k2"])  # repeated rows
    )
    zero = F.lit(0).cast("long")
    return (
        rows.select("key", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("whole"))
        .join(stripped, ["k1", "k2"], "left")
        .select(
            F.col("key").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
            F.coalesce("sha", "whole").alias("kept_sha256"),
        )
    )
