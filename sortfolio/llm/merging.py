"""Byte-pair merges of many words at once.

Each word's neighbours of lowest rank are joined, the leftmost among equal ones, until none make a symbol. A round makes one join in
every word that has one left, by numpy over the symbols of all of them; so its cost a symbol is that of a few array operations, and
a word's result doesn't depend on the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of texts whose words are solved together
SLICE = 1 << 19
_NONE = np.iinfo(np.int32).max


def spans(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``limit`` bytes together, each whole, with the place of the first; null is empty."""
    first, size = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= limit or k + 1 == len(texts):
            yield first, [t or "" for t in texts.slice(first, k + 1 - first).to_pylist()]
            first, size = k + 1, 0


class Merges:
    """A table of joins: left and right symbol, rank (below 2^31 - 1) and the symbol that they make."""

    def __init__(self, joins: Iterable[tuple[int, int, int, int]]):
        left, right, rank, made = np.array([*joins] or [(-1, -1, 0, 0)], np.int64).T
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], rank[order].astype(np.int32), made[order].astype(np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each join, ``_NONE`` if there is none, and what it makes."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE), self.made[at]

    def packed(self, symbols: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The symbols left of each word, as little-endian 32-bit numbers; ``sizes``: symbols of each word, none empty."""
        out, word = [b""] * len(sizes), np.arange(len(sizes))
        rank, made = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
        rank[:-1], made[:-1] = self.of(symbols[:-1], symbols[1:])
        rank[np.cumsum(sizes) - 1] = _NONE
        while len(word):
            best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            live = best < _NONE
            if not live.all():
                mask, ended = np.repeat(live, sizes), ~live
                data, ends = symbols[~mask].astype("<i4").tobytes(), np.cumsum(sizes[ended]) * 4
                for w, a, b in zip(word[ended].tolist(), [0, *ends.tolist()], ends.tolist()):
                    out[w] = data[a:b]
                word, sizes, best, symbols, rank, made = word[live], sizes[live], best[live], symbols[mask], rank[mask], made[mask]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            of = np.repeat(np.arange(len(word)), sizes)[at]
            at = at[np.concatenate([[True], of[1:] != of[:-1]])]  # one join a word
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, rank, made, sizes = symbols[stay], rank[stay], made[stay], sizes - 1
            at -= np.arange(len(at))
            ends = np.cumsum(sizes)
            rank[at] = _NONE
            for k in (at[at < ends - 1], at[at > ends - sizes] - 1):
                rank[k], made[k] = self.of(symbols[k], symbols[k + 1])
        return out
