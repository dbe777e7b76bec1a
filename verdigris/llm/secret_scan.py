"""Secrets: base patterns, and random-looking strings by two Markov models.

Base kinds are assignments to names such as ``password``, access keys and
long hexadecimal strings, leftmost and non-overlapping per kind; a match that
fails its length is dropped without another try.

Method: two first-order Markov models over the characters of tokens
``[A-Za-z0-9+/_=-]+``.  The base patterns label the samples.  The model of
random strings is trained from what they find: access keys, hexadecimal
strings, and assigned values of ``MIXED`` characters or more of at least two
of capitals, small letters and digits (shorter or plainer values are often
chosen by people); that of ordinary identifiers from all tokens that are not
so labelled.  A token with a letter and a digit, of any length, outside all
base spans, is a span of kind ``random`` if the log-likelihood ratio of its
transitions adds up to at least ``-log(FALSE_RATE)`` and is at least ``RATIO``
on average.  Where tokens follow the model of ordinary ones, the first bound
alone lets through at most a share ``FALSE_RATE`` of them, as the expectation
of the likelihood ratio is one; a short token cannot reach it.

Defined results
    null or empty text: no spans.  Offsets are code points, end exclusive.
    Repeated rows and equal texts get equal spans.  Without any labelled
    secret the random model is uniform.  Ties of the bounds count as random.
    Empty table: no rows.  Other columns are untouched; internal columns have
    names with ``__``.

Scale
    Two passes over the texts where they lie; between them only sums of
    transition counts (at most 2 x 68 x 67 of them, per task).  A text is
    looked at as a whole, in time linear in its length and in its matches.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text
from ._native import map_arrow

#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Share of ordinary tokens that may pass as random, and the least average ratio (nats).
FALSE_RATE, RATIO = 1e-6, 0.5
MIXED = 16
#: Weight, in transitions, of the characters' own frequencies after a character that ordinary tokens hardly have.
BACKOFF = 200.0
SPANS = "__spans"

_N = len(ALPHABET)
_CODE = np.full(256, -1, np.int64)
_CODE[list(ALPHABET)] = np.arange(_N)
_IN_TOKEN = _CODE >= 0
_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_IN_HEX = np.zeros(256, bool)
_IN_HEX[list(b"0123456789abcdef")] = True


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of the base kinds."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end(), m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(out)


def _pairs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to tokens, and the transition into each, ``before * _N + code``; state ``_N`` is a token's start."""
    code = _CODE[buf]
    before = np.full(len(code), _N)
    before[1:] = np.where(code[:-1] >= 0, code[:-1], _N)
    return code >= 0, before * _N + code


def transitions(buf: np.ndarray) -> np.ndarray:
    """Counts of (previous, next) characters in the tokens of ``buf``."""
    inside, pair = _pairs(buf)
    return np.bincount(pair[inside], minlength=(_N + 1) * _N)


def labels_random(kind: int, secret: str) -> bool:
    """Whether a base match is a sample of the random strings."""
    classes = any(c.isupper() for c in secret) + any(c.islower() for c in secret) + any(c.isdigit() for c in secret)
    return kind > 0 or (len(secret) >= MIXED and classes >= 2)


def _has_run(buf: np.ndarray, off: np.ndarray, member: np.ndarray, least: int) -> np.ndarray:
    """Which rows have a run of at least ``least`` member bytes."""
    starts, ends, woff = _text.bounds(buf, off, member)
    long = np.concatenate([[0], np.cumsum(ends - starts >= least)])
    return long[woff[1:]] > long[woff[:-1]]


def _likely(buf: np.ndarray, off: np.ndarray, texts: list[str]) -> list[bool]:
    """Rows that may have a base span."""
    long_hex = _has_run(buf, off, _IN_HEX, 32)
    out = []
    for text, h in zip(texts, long_hex.tolist()):
        if not h and "AKIA" not in text:
            low = text.lower()
            h = "passw" in low or "secret" in low or "token" in low or "api" in low
        out.append(h or "AKIA" in text)
    return out


def _smooth(counts: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
    return np.log((counts + weight * prior) / (counts.sum(axis=1, keepdims=True) + weight))


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of every transition, (_N + 1, _N)."""

    def count(batches):
        every, secret = np.zeros((_N + 1) * _N, np.int64), np.zeros((_N + 1) * _N, np.int64)
        for batch in _text.slices(batches, text):
            buf, off = _text.raw(batch.column(0))
            every += transitions(buf)
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = [s[3] for t, likely in zip(texts, _likely(buf, off, texts)) if likely for s in base_spans(t) if labels_random(s[1], s[3])]
            if found:
                secret += transitions(np.frombuffer(" ".join(found).encode(), np.uint8))
        for name, total in (("every", every), ("secret", secret)):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(total[some])], ["kind", "pair", "n"])

    every, secret = np.zeros((_N + 1) * _N), np.zeros((_N + 1) * _N)
    for r in docs.select(text).mapInArrow(count, "kind string, pair long, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        (every if r.kind == "every" else secret)[r.pair] = r.n
    ordinary = np.maximum(every - secret, 0).reshape(-1, _N)
    common = (ordinary.sum(axis=0) + 1) / (ordinary.sum() + _N)
    return _smooth(secret.reshape(-1, _N), np.full(_N, 1 / _N), _N) - _smooth(ordinary, common, BACKOFF)


def random_tokens(model: np.ndarray, buf: np.ndarray, off: np.ndarray, false_rate: float = FALSE_RATE, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes of the rows' buffer of the tokens that are random by the models."""
    starts, ends, woff = _text.bounds(buf, off, _IN_TOKEN)
    inside, pair = _pairs(buf)
    # a token that touches the row before it begins anew
    pair[starts] = _N * _N + _CODE[buf[starts]]
    sums = np.concatenate([[0.0], np.cumsum(np.where(inside, model.ravel()[pair % model.size], 0.0))])
    have = lambda member: (lambda n: n[ends] > n[starts])(np.concatenate([[0], np.cumsum(member[buf])]))
    total = sums[ends] - sums[starts]
    at = np.flatnonzero((total >= -np.log(false_rate) - 1e-9) & (total >= ratio * (ends - starts) - 1e-9) & have(_DIGIT) & have(_LETTER))
    return np.searchsorted(woff, at, "right") - 1, starts[at], ends[at]


def outside(tokens: list[tuple[int, int]], base: list[tuple]) -> list[tuple[int, int]]:
    """The tokens, in order, that touch none of the base spans, sorted by start."""
    kept, i, reach = [], 0, -1
    for a, b in tokens:
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a:
            kept.append((a, b))
    return kept


def scan(docs: DataFrame, text: str = "text", false_rate: float = FALSE_RATE, ratio: float = RATIO) -> DataFrame:
    """Adds ``__spans``: (start, kind, end) by start, then kind."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text))

    def run(batches):
        for batch in _text.slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            buf, off = _text.raw(column)
            texts = [t or "" for t in column.to_pylist()]
            spans: list[list[tuple]] = [[s[:3] for s in base_spans(t)] if likely else [] for t, likely in zip(texts, _likely(buf, off, texts))]
            row, a, b = random_tokens(model.value, buf, off, false_rate, ratio)
            points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            tokens: dict[int, list] = {}
            for r, x, y in zip(row.tolist(), (points[a] - points[off[row]]).tolist(), (points[b] - points[off[row]]).tolist()):
                tokens.setdefault(r, []).append((x, y))
            for r, found in tokens.items():
                spans[r] = sorted(spans[r] + [(x, 3, y) for x, y in outside(found, spans[r])])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            values = pa.array([[dict(start=x, kind=k, end=y) for x, k, y in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, SPANS])

    span = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "kind", "end")])
    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(SPANS, T.ArrayType(span))]))


def names(spans):
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
