"""Vectorised byte and word hashing over Arrow string batches.

Small numpy helpers used inside `mapInArrow` tasks.  All hashes are functions of the
bytes alone, so they agree between tasks, runs and retries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = 0x9E3779B97F4A7C15
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
#: Texts of a batch are hashed in runs of about this many bytes (one longer text is one run).
RUN_BYTES = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse, modulo 2**64, n of each at least."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        made = []
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _POW, _INV = made
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of (data[j] + 1) * m**j for j < i."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hashes of the byte spans [start, end)."""
    _, inv = powers(len(h))
    return mix((h[ends] - h[starts]) * inv[starts])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: every byte but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes after lower-casing: digits, a-z and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words of each text, and the first word index of each text (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    m = kind[data]
    first = np.empty(n, bool)
    first[0] = m[0]
    np.greater(m[1:], m[:-1], out=first[1:])
    inner = off[1:-1]
    inner = inner[inner < n]
    first[inner] = m[inner]
    last = np.empty(n, bool)
    last[-1] = m[-1]
    np.greater(m[:-1], m[1:], out=last[:-1])
    before = inner[inner > 0] - 1
    last[before] = m[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased bytes, and the first word index of each text."""
    low = LOWER[data]
    starts, ends, at = words(low, off, kind)
    return span_hash(prefix_hash(low), starts, ends), at


def sequence_hash(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values, one for each start (len(w) - k + 1 of them)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + w[i : i + n]
    return mix(acc + np.uint64(k))
