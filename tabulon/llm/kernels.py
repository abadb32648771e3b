"""NumPy kernels over whole Arrow string batches: word bounds, word and shingle hashes, set operations on segments.

Every kernel works on the bytes of a batch at once, so its cost is a few nanoseconds a byte and its memory a few
times the batch; `slices` cuts a batch so that this stays bounded (one text is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_BASE))


_BYTE = seeds(256, 7)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers = {_BASE: np.ones(1, dtype=np.uint64), _INV: np.ones(1, dtype=np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    p = _powers[base]
    if len(p) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        if len(p) <= 1 << 23:  # one huge text doesn't leave its table behind
            _powers[base] = p
    return p[:n]


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together, and the n + 1 offsets of the texts in them, from 0."""
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(batches, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds `most` bytes of text at most, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        lens = np.diff(buffers(texts(b.column(b.schema.get_field_index(text))))[1])
        cum, at = np.cumsum(lens), 0
        while at < b.num_rows:
            to = int(np.searchsorted(cum, (cum[at - 1] if at else 0) + most, side="right"))
            to = max(to, at + 1)
            yield b.slice(at, to - at)
            at = to


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that `space` doesn't name: no ASCII white space) and the n + 1 offsets of the texts in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; lower: A-Z count as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        s = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_BASE, len(data)), out=s[1:])
        h = (s[end] - s[start]) * _power(_INV, len(data))[start]
        return mix(h + (end - start).astype(np.uint64) * _M2)


def word_hashes(arr: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the n + 1 offsets of the texts in them."""
    data, off = buffers(arr)
    start, end, woff = word_bounds(data, off)
    return span_hashes(data, start, end, lower), woff


_STEP = seeds(64, 99) | np.uint64(1)


def shingles(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles by text (with fewer words: the whole sequence as one; without words: none), and offsets."""
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    off = np.concatenate([[0], np.cumsum(count)])
    if not off[-1]:
        return np.zeros(0, np.uint64), off
    first = np.repeat(woff[:-1] - off[:-1], count) + np.arange(off[-1])
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        h = np.zeros(off[-1], np.uint64)
        short = np.flatnonzero((n > 0) & (n < k))
        size = np.full(off[-1], k, dtype=np.int64)
        size[off[short]] = n[short]
        for i in range(k):
            x = padded[first + i] * _STEP[i]
            h += x if not len(short) else np.where(size > i, x, np.uint64(0))
        return mix(h + size.astype(np.uint64)), off


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each segment, and their offsets."""
    n = len(off) - 1
    if not len(values):
        return values, np.zeros(n + 1, np.int64)
    seg = np.repeat(np.arange(n), np.diff(off))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(seg[order], kind="stable")]
    v, s = values[order], seg[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(s[keep], minlength=n))])


def segment_min(values: np.ndarray, off: np.ndarray, empty: int) -> np.ndarray:
    """The least value of each segment; `empty` where there is none."""
    n = np.diff(off)
    out = np.full(len(n), empty, dtype=values.dtype)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.minimum.reduceat(values, off[:-1][full])
    return out


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def binary_rows(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Segments of a numeric array as binary values."""
    flat = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * flat.itemsize).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
