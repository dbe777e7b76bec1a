"""Scores of texts under a hashed maximum-entropy model.

A token's probability is factored as ``P(class | h) P(cell | class, h)
P(token | cell)``.  The ``HEAD_CELLS`` most frequent tokens have a cell of
their own each; all others share the ``CELLS - HEAD_CELLS`` tail cells by a hash
of their last three bytes, which tells kinds of words, and languages, apart.
Cells stand in order of frequency, the tail last, and ``INNER`` neighbours are a
class.  The first two factors are softmax models over hashed features of the
history ``h``: the previous token, the one before it (a skip) and, for the
class, both together, each with a table of weights of its own in either
factor; the third is the token's smoothed share of its cell.  The sum over all tokens that can
occur, with one unit of mass per cell for unseen ones, is one.

Training: the documents are dealt to ``ROUNDS`` parts by a hash.  In each round
every task starts from the same weights and runs over its share of one part
with preconditioned minibatch gradient steps; then each row of weights becomes
the average over the tasks that met its feature, by how often they did.  The
result depends on how the files are split, within the noise of the gradient.
Scoring: sparse numpy batches.

Defined results
    Tokens: words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, then one
    end.  Null or empty text: the end alone.  A document is held out where
    ``crc32`` of its id as text, mod 7, is 2; a null id counts as empty text.
    Repeated rows train and are scored each.  Ties of frequency go to the lower
    hash.  Without any training document N and V are 0 and every token has
    base probability 1.  Empty table: no rows.

Scale
    Token counts are summed per task before they are shuffled.  The most
    frequent tokens, at most ``HEAD`` of them, and the model are broadcast; a
    document's rarer tokens meet their counts in an equi-join whose keys are
    rare by construction.  The rows of each table grow with the training
    tokens, up to ``ROWS`` (for each of three kinds of features a table of 16
    columns, and for two of them one of half the rows for a feature with a
    class: 64 MB in a task).  A task sends the rows it changed only, a byte for each weight, cut
    into blocks; they are added up in a tree of at most ``FANIN`` of them at a
    time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text
from ._native import cut

CELLS, CLASSES, HEAD_CELLS = 256, 16, 128
INNER, TAIL = CELLS // CLASSES, CELLS - HEAD_CELLS
KINDS, WITH_CLASS = 3, 2
ROWS, FEWEST, SHARED = 1 << 18, 1 << 12, 2
HEAD = 1 << 17
BATCH = 1 << 13
ROUNDS = 3
MOST = 16.0
FANIN, BLOCK = 32, 1 << 13
_END = np.uint64(0x5851F42D4C957F2D)
_MERGE = 4_000_000


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by its end, their tail cells, and the rows' offsets."""
    buf, off = _text.raw(column)
    low = _text.LOWER[buf]
    starts, ends, woff = _text.bounds(low, off, _text.NON_SPACE)
    h = _text.word_hashes(low, starts, ends)
    last = np.zeros(len(h), np.uint64)
    for j in (1, 2, 3):
        there = ends - j >= starts
        last = last * np.uint64(256) + np.where(there, low[np.maximum(ends - j, 0)] if len(low) else 0, 0).astype(np.uint64)
    toff = woff + np.arange(len(woff))
    out, tail = np.full(toff[-1], _END, np.uint64), np.zeros(toff[-1], np.int64)
    own = np.ones(len(out), bool)
    own[toff[1:] - 1] = False
    out[own] = h
    tail[own] = (_text.mix(last) >> np.uint64(33)).astype(np.int64) % TAIL
    return out, tail, toff


def features(h: np.ndarray, toff: np.ndarray, rows: int) -> np.ndarray:
    """(tokens, KINDS) rows of the weight tables: previous, skip, both."""
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[toff[:-1]] = 0
    two[toff[:-1]] = 0
    second = toff[:-1] + 1
    two[second[second < toff[1:]]] = 0
    mixed = [_text.mix(one + np.uint64(1)), _text.mix(two + np.uint64(2)), _text.mix(one * np.uint64(0x9E3779B97F4A7C15) + two + np.uint64(3))]
    return np.stack([(m >> np.uint64(24)).astype(np.int64) % rows for m in mixed], axis=1)


class Cells:
    """The cell of a token: that of a frequent one, else its tail cell."""

    def __init__(self, head: np.ndarray):
        """``head``: hashes of the most frequent tokens, in order."""
        self.order = np.argsort(head)
        self.sorted = head[self.order]

    def __call__(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return HEAD_CELLS + tail
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], HEAD_CELLS + tail)


_ONES = np.ones(INNER, np.float32)


class Model:
    """Weights of both softmax layers, a table for each kind of feature, and their biases from the cells' shares."""

    def __init__(self, cell_counts: np.ndarray, rows: int):
        share = (cell_counts + 1.0).reshape(CLASSES, INNER)
        self.rows = rows
        self.b1 = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        self.b2 = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        # zeros take no memory until they are written
        self.w = [np.zeros((rows, INNER), np.float32) for _ in range(KINDS)] + [np.zeros((rows // SHARED, INNER), np.float32) for _ in range(WITH_CLASS)]

    def places(self, f: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """Rows of all tables: a feature's, and that of a feature with a class."""
        inner = [(((f[:, j] * CLASSES + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % (self.rows // SHARED) for j in range(WITH_CLASS)]
        return [f[:, j] for j in range(KINDS)] + inner

    def load(self, weights: list[np.ndarray]) -> Model:
        """Weights within MOST, so that no sum of them overflows a softmax."""
        self.w = [np.clip(w, -MOST, MOST, dtype=np.float32) for w in weights]
        return self

    def biases(self, k: np.ndarray) -> list[np.ndarray]:
        return [np.broadcast_to(self.b1, (len(k), CLASSES)).copy(), self.b2[k]]

    def log_prob(self, f: np.ndarray, cell: np.ndarray) -> np.ndarray:
        out = np.empty(len(f))
        for a in range(0, len(f), BATCH):
            c, i = cell[a : a + BATCH], np.arange(min(BATCH, len(f) - a))
            z, places = self.biases(c // INNER), self.places(f[a : a + BATCH], c // INNER)
            for table in range(len(self.w)):
                z[table // KINDS] += self.w[table][places[table]]
            out[a : a + BATCH] = z[0][i, c // INNER] + z[1][i, c % INNER] - np.log((np.exp(z[0]) @ _ONES) * (np.exp(z[1]) @ _ONES))
        return out

    def step(self, f: np.ndarray, cell: np.ndarray, met: list[np.ndarray] | None = None, rate: float = 0.5, damp: float = 2.0) -> None:
        """One gradient step on a minibatch, each row's by the tokens that have its feature; ``met`` counts these.

        Rows are read and written once, in order; the tokens share them.
        """
        z, i = self.biases(cell // INNER), np.arange(len(f))
        groups = []
        for table, rows in enumerate(self.places(f, cell // INNER)):
            order = np.argsort(rows.astype(np.uint32))
            used = rows[order]
            first = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
            n = np.diff(np.append(first, len(used)))
            own, which = used[first], np.empty(len(rows), np.int64)
            which[order] = np.repeat(np.arange(len(own)), n)
            w = self.w[table][own]
            z[table // KINDS] += w[which]
            groups.append((order, first, n.astype(np.float32), own, w))
        g = [np.exp(x) for x in z]
        for x in g:
            x /= (x @ _ONES)[:, None]
        g[0][i, cell // INNER] -= 1
        g[1][i, cell % INNER] -= 1
        for table, (order, first, n, own, w) in enumerate(groups):
            w -= (rate / (n + damp))[:, None] * np.add.reduceat(g[table // KINDS][order], first, axis=0)
            self.w[table][own] = w
            if met is not None:
                met[table][own] += n


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(h, tail, c): occurrences of every token, and its tail cell."""

    def count(batches):
        kept, size = [], 0
        for batch in _text.slices(batches, text):
            h, tail, _ = tokens(batch.column(0))
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            kept.append((h, tail[first], n))
            size += len(h)
            if size > _MERGE:
                yield _summed(kept)
                kept, size = [], 0
        if kept:
            yield _summed(kept)

    return docs.select(text).mapInArrow(count, "h long, tail long, c long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def _summed(kept: list[tuple]) -> pa.RecordBatch:
    h, tail, n = (np.concatenate(c) for c in zip(*kept))
    h, first, at = np.unique(h, return_index=True, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail[first]), pa.array(np.bincount(at, n, len(h)).astype(np.int64))], ["h", "tail", "c"])


_KIND = "task long, block long, rows binary, n binary, scale binary, d binary"


def _packed(rows: np.ndarray, n: np.ndarray, d: np.ndarray) -> dict:
    """Changed rows of a block, how often they were met, and their changes in steps of a 127th of each row's largest."""
    scale = np.maximum(np.abs(d).max(axis=1), 1e-4).astype(np.float16).astype(np.float32)
    return {"rows": rows.astype(np.uint16).tobytes(), "n": n.astype(np.float32).tobytes(), "scale": scale.astype(np.float16).tobytes(), "d": np.rint(np.clip(d / scale[:, None], -1, 1) * 127).astype(np.int8).tobytes()}


def _unpacked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = np.frombuffer(r["d"], np.int8).reshape(-1, INNER).astype(np.float32)
    return np.frombuffer(r["rows"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.float32), d * (np.frombuffer(r["scale"], np.float16).astype(np.float32) / 127)[:, None]


def train(docs: DataFrame, key: str, text: str, cell_counts: np.ndarray, cells: Cells, rows: int, rounds: int = ROUNDS) -> Model:
    """A model from ``rounds`` synchronous rounds, each over its part of ``docs``."""
    spark, model = docs.sparkSession, Model(cell_counts, rows)
    tasks = max(1, -(-docs.rdd.getNumPartitions() // rounds))  # each with about as many documents as a task that reads all
    part = F.pmod(F.xxhash64(key, text), F.lit(rounds))
    for number in range(rounds):
        shared = spark.sparkContext.broadcast((cells, cell_counts, [w.astype(np.float16) for w in model.w]))

        def learn(batches, shared=shared):
            from pyspark import TaskContext

            cells, counts, before = shared.value
            own = Model(counts, rows).load(before)
            met = [np.zeros(len(w), np.float32) for w in own.w]
            for batch in _text.slices(batches, "text"):
                h, tail, toff = tokens(batch.column(0))
                f, cell = features(h, toff, rows), cells(h, tail)
                for a in range(0, len(h), BATCH):
                    own.step(f[a : a + BATCH], cell[a : a + BATCH], met)
            task = TaskContext.get().partitionId()
            for t, w in enumerate(own.w):
                changed = np.flatnonzero(met[t])
                change = w[changed] - before[t][changed]
                edges = np.searchsorted(changed, np.arange(0, len(w) + BLOCK, BLOCK))
                for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                    if j > i:
                        r = changed[i:j]
                        yield pa.RecordBatch.from_pylist([{"task": task, "block": t * (ROWS // BLOCK) + b} | _packed(r - b * BLOCK, met[t][r], change[i:j])], schema=_SCHEMA)

        def add(group: pd.DataFrame) -> pd.DataFrame:
            """Mean changes of the rows of one block, by how often each was met."""
            n, d = np.zeros(BLOCK, np.float32), np.zeros((BLOCK, INNER), np.float32)
            for r in group.to_dict("records"):
                at, times, change = _unpacked(r)
                n[at] += times
                d[at] += change * times[:, None]
            at = np.flatnonzero(n)
            out = _packed(at, n[at], d[at] / n[at][:, None])
            return pd.DataFrame([{"task": int(group["task"].iloc[0]) // FANIN, "block": group["block"].iloc[0]} | out])

        learnt = docs.where(part == number).select(F.col(text).alias("text")).coalesce(tasks).mapInArrow(learn, _KIND)
        left = tasks
        while True:
            learnt = learnt.groupBy("block", F.floor(F.col("task") / FANIN).alias("group")).applyInPandas(add, _KIND)
            left = -(-left // FANIN)
            if left <= 1:
                break
        for r in learnt.collect():  # the changed rows of the model
            t, b = divmod(r["block"], ROWS // BLOCK)
            at, _, change = _unpacked(r)
            model.w[t][b * BLOCK + at] += change
        shared.unpersist()
    return model


_SCHEMA = pa.schema([("task", pa.int64()), ("block", pa.int64()), ("rows", pa.binary()), ("n", pa.binary()), ("scale", pa.binary()), ("d", pa.binary())])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    remainder = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 7
    docs = docs.select(F.col(key).alias("key"), (remainder == 2).alias("held_out"), F.col(text).alias("text"))
    training = docs.where(~F.col("held_out"))
    counts = cut(count_tokens(training, "text"))
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD_CELLS).collect()
    cells = Cells(np.array([r.h for r in top], np.int64).view(np.uint64))
    by_tail = counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    cell_n, cell_v = np.zeros(CELLS), np.zeros(CELLS)
    for r in by_tail:
        cell_n[HEAD_CELLS + r.tail], cell_v[HEAD_CELLS + r.tail] = r.n, r.v
    for i, r in enumerate(top):
        cell_n[i], cell_v[i] = r.c, 1
        cell_n[HEAD_CELLS + r.tail] -= r.c
        cell_v[HEAD_CELLS + r.tail] -= 1
    total, kinds = int(cell_n.sum()), int(cell_v.sum())

    # The lowest count from which on at most HEAD tokens are left; counts are binned in eighths of octaves.
    bins = counts.groupBy(F.ceil(F.log2("c") * 8).cast("int").alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("b")).collect()
    least, left = 2**62, HEAD
    for r in bins:
        left -= r.n
        if left < 0:
            break
        least = r.least
    head = counts.where(F.col("c") >= least).toPandas()
    order = np.argsort(head["h"].to_numpy(np.int64).view(np.uint64))
    known = head["h"].to_numpy(np.int64).view(np.uint64)[order], head["c"].to_numpy(np.int64)[order]

    rows = min(ROWS, max(FEWEST, 1 << (total // 16).bit_length()))
    model = train(training, "key", "text", cell_n, cells, rows)
    shared = docs.sparkSession.sparkContext.broadcast((known, cells, cell_n, [np.clip(w, -MOST, MOST).astype(np.float16) for w in model.w], np.log10(cell_n + cell_v + 1)))
    del model

    def run(batches):
        (words, seen), cells, counts, weights, cell_log = shared.value
        gain = np.log10(seen + 1.0)
        model = Model(counts, len(weights[0]))
        model.w = weights  # in half precision as they are
        for batch in _text.slices(batches, "text"):
            h, tail, toff = tokens(batch.column(2))
            cell = cells(h, tail)
            per_token = model.log_prob(features(h, toff, model.rows), cell) / np.log(10) - cell_log[cell]
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
            in_head = words[at] == h if len(words) else np.zeros(len(h), bool)
            row = np.repeat(np.arange(batch.num_rows), np.diff(toff))
            own = np.bincount(row[in_head], gain[at[in_head]], batch.num_rows)
            n_head = np.bincount(row[in_head], minlength=batch.num_rows)
            rare, rare_row = h[~in_head], row[~in_head]
            order = np.lexsort((rare, rare_row))
            rare, rare_row = rare[order], rare_row[order]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rare)))
            roff = np.searchsorted(rare_row[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.diff(toff)), pa.array(n_head.astype(np.int64)), pa.array(own),
                    pa.array(np.add.reduceat(per_token, toff[:-1])),
                    pa.ListArray.from_arrays(pa.array(roff), pa.array(rare[first].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(roff), pa.array(times.astype(np.int32))),
                ],
                ["key", "held_out", "n_tokens", "n_head", "own", "cells", "rare", "times"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    scored = cut(
        docs.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens long, n_head long, own double, cells double, rare array<long>, times array<int>")
        .withColumn("row", F.monotonically_increasing_id())  # stable: the checkpoint is what is read
    )
    rest = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t"))
        .select("row", F.col("t.rare").alias("h"), "t.times")
        .join(counts, "h")  # a token without a count adds log10(0 + 1) = 0
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("n_more"))
    )
    gained = F.col("own") + F.coalesce("more", F.lit(0.0))
    # without training tokens log10(N + V + 1) is 0
    return scored.join(rest, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (gained - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))).alias("base_score"),
        (gained + F.col("cells")).alias("score"),
    )
