"""Words of whole Arrow batches of text, found and hashed with numpy on the UTF-8 bytes.

A batch is handled in slices of about ``SLICE_BYTES`` of text, each row whole, so that memory is
bounded by the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_ALL = np.arange(256)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: bytes of words ``[^\x20\x09-\x0D]+``
NOT_SPACE = (_ALL != 32) & ((_ALL < 9) | (_ALL > 13))
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in text lower-cased in A-Z
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | ((_ALL >= 65) & (_ALL <= 90)) | (_ALL >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = np.asarray(x, dtype=np.uint64) + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_weights = mix(np.arange(1 << 12, dtype=np.uint64)) | np.uint64(1)


def position_weights(n: int) -> np.ndarray:
    global _weights
    if n > len(_weights):
        _weights = mix(np.arange(1 << int(n).bit_length(), dtype=np.uint64)) | np.uint64(1)
    return _weights


@dataclass
class Slice:
    """Consecutive rows of a batch: row ``first + i`` is ``data[begin[i]:end[i]]``."""

    first: int
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Rows of a text column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if offsets[-1] > offsets[0] else np.zeros(int(offsets[-1]), np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        lo = offsets[i]
        yield Slice(i, data[lo : offsets[j]], offsets[i:j] - lo, offsets[i + 1 : j + 1] - lo)
        i = j


@dataclass
class Words:
    """``start``/``stop`` of each word in the slice, its 64-bit hash, and the first word of each row (one more at the end)."""

    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)


def words(s: Slice, kind: np.ndarray, lower: bool = True) -> Words:
    inside = kind[s.data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = s.begin < s.end
    at = s.begin[full]
    opens[at] = inside[at]  # a word never runs over two rows
    at = s.end[full] - 1
    closes[at] = inside[at]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.concatenate([np.searchsorted(start, s.begin), [len(start)]])
    return Words(start, stop, hashed(LOWER[s.data] if lower else s.data, start, stop), first)


def hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:stop]`` (none empty): a sum of bytes with a random weight for each place."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = stop - start
    total = int(size.sum())
    before = np.cumsum(size) - size
    place = np.arange(total) - np.repeat(before, size)
    values = (data[place + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)) * position_weights(int(size.max()))[place]
    return mix(np.add.reduceat(values, before) + size.astype(np.uint64))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes; runs over row ends are the caller's to drop."""
    count = max(0, len(h) - n + 1)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = mix(out ^ h[k : k + count])
    return out


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(keys) else counts
