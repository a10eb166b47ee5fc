"""Vectorised byte and word helpers that run inside tasks on Arrow batches.

A batch's string column is viewed as one byte array plus row offsets; words
are hashed with prefix sums, so cost per byte is a few numpy passes and memory
is bounded by the block size whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_table() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + U64(1)) * U64(_BASE))


RANDOM_BYTE = _byte_table()
FOLDED_BYTE = RANDOM_BYTE.copy()
FOLDED_BYTE[65:91] = RANDOM_BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(_SPACES)] = True

_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the odd hash base and of its inverse, modulo 2**64."""
    if not _pow or len(_pow["p"]) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["q"][:n]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if big else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int = 4 << 20):
    """Consecutive row ranges of at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of non-space bytes; no run crosses a row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    end = word
    end[:-1] &= ~word[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table=RANDOM_BYTE) -> np.ndarray:
    """64-bit hash of each byte span; spans are ordered and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + BLOCK, side="right")), i + 1)
        hi = ends[j - 1]
        p, q = powers(int(hi - lo) + 1)
        total = np.zeros(int(hi - lo) + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * p[:hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False):
    """Hash, start and end of each word, and each row's range in these arrays."""
    s, e = word_spans(data, offsets)
    return span_hashes(data, s, e, FOLDED_BYTE if fold else RANDOM_BYTE), s, e, np.searchsorted(s, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words of the array."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + h[i:i + n]
    return mix(out)


def list_column(values: np.ndarray, counts, kind=None) -> pa.ListArray:
    """Arrow list column from flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def segments_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` consecutive entries (two block-wise scans)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    pad = -len(x) % w
    top = np.iinfo(x.dtype).max
    y = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).reshape(-1)
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1:w - 1 + n])
