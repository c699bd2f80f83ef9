"""Vectorised text primitives over Arrow string columns (inside tasks).

A batch of texts is viewed as one byte buffer with document offsets, so
splitting into words and hashing them costs a few numpy passes and no
Python object per word. Batches are walked in chunks of about
``CHUNK_BYTES`` (a longer text forms a chunk of its own), which bounds the
temporary arrays by the chunk and not by the batch.

Words are ``[^\\x20\\x09-\\x0D]+``: only the six ASCII blanks separate, so
bytes and characters give the same words in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n (grown on demand, kept per worker)."""
    if not _pow or len(_pow["p"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inv = pow(int(_BASE), -1, 1 << 64)
        out = {}
        for name, base in (("p", int(_BASE)), ("ip", inv)):
            a = np.ones(1, np.uint64)
            while len(a) < size:  # doubling: a concat a * base^len
                a = np.concatenate([a, a * _U(pow(base, len(a), 1 << 64))])
            out[name] = a[:size]
        if size <= 64 * CHUNK_BYTES:
            _pow.update(out)
        return out["p"], out["ip"]
    return _pow["p"], _pow["ip"]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = h + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents of about ``limit`` bytes, at least one each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums for ``range_hash``."""
    p, _ = _powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + _U(1)) * p[:len(data)], out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each byte range [start, end) given ``prefix_hash``."""
    _, ip = _powers(len(h))
    with np.errstate(over="ignore"):
        return mix((h[end] - h[start]) * ip[start], salt)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; offsets are relative to ``data``."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~IS_BLANK[data]
    edge = np.zeros(n + 1, bool)  # a document boundary also ends a word
    edge[offsets[1:-1]] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    d = np.searchsorted(offsets, s, side="right") - 1
    return s, e, d


def sequence_hash(w: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _BASE + w[j:j + n]
    return mix(out, salt)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, by doubling."""
    m, size = v, 1
    while 2 * size <= w:
        m = np.minimum(m[:len(m) - size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[:max(0, len(m) - (w - size))], m[w - size:])
    return m


#: Positions inside one chunk take the low bits of a packed minimum; chunks
#: stay below this length, so the bits left to the hash never vary.
POSITION_BITS = 24


def window_anchors(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of ``w`` hashes, the position of its smallest one
    (upper bits of the hash; ties to the left)."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    if len(h) >= 1 << POSITION_BITS:
        raise ValueError("chunk too long for packed positions")
    low = _U((1 << POSITION_BITS) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    return (sliding_min(packed, w) & low).astype(np.int64)
