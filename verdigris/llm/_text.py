"""Words of Arrow text columns as numpy arrays, without Python strings.

Texts are handled as their UTF-8 bytes.  Both word rules used here treat all
bytes of a multi-byte character alike, so byte classes are enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 8 << 20
_CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x20\x09-\x0D]``
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, _CHUNK) + 1
        _POW[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def slices(batches, column: str):
    """Record batches cut so that the texts of one take SLICE bytes at most, or it has one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def bounds(buf: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each row's words begin among them."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    m = word[buf]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    edges = off[(off > 0) & (off < len(buf))]  # a word ends with its row
    first[edges] = m[edges]
    last[edges - 1] = m[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        at, to = int(starts[i]), int(ends[j - 1])
        up, down = _tables(to - at)
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(_BYTE[buf[at:to]] * up[: to - at], out=sums[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def shingles(h: np.ndarray, woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of each row, and the rows' offsets among them.

    A row of fewer words, but not none, has one shingle of them all.
    """
    count = np.diff(woff)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    soff = np.concatenate([[0], np.cumsum(made)])
    if not soff[-1]:
        return np.zeros(0, np.uint64), soff
    row = np.repeat(np.arange(len(count)), made)
    at = woff[row] + np.arange(soff[-1]) - soff[row]
    out = np.zeros(soff[-1], np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    size = np.minimum(count, n)[row]
    for j in range(n):
        w = padded[at + j]
        if j and (size <= j).any():
            w = np.where(size > j, w, np.uint64(0))
        out = (out ^ w) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out), soff


def summed(kept: list[tuple[np.ndarray, np.ndarray]], key: str, count: str) -> pa.RecordBatch:
    """One batch of the distinct hashes of several counts, and their sums."""
    h, n = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
    h, at = np.unique(h, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(at, n, len(h)).astype(np.int64))], [key, count])
