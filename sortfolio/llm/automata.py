"""Weighted acyclic automata over words: counts of n-grams, summed by union and looked up by composition.

An n-gram is a path of words from the root; the arc that ends it carries its count. Words are numbered in the order of their bytes,
so paths in the order of numbers are n-grams in lexicographic order.

``Paths`` is an automaton opened up: for each depth the arcs in order, each with the arc above it. ``to_bytes`` builds the automaton
from them, depth by depth from the leaves: leaves have one final state in common, and states with the same only arc are one state.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ordered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in the order of their bytes, and the number of each of ``words``."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def numbers(words: pa.Array, table: pa.Array) -> np.ndarray:
    """The number of each word in a table; -1: not there."""
    return pc.index_in(words, value_set=table).fill_null(-1).to_numpy().astype(np.int64)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of weights of each, and where each of ``keys`` went."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    head = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(head) - 1
    return sorted_keys[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64), where


@dataclass
class Depth:
    """Arcs of one depth in order: the arc above, the word, the count of the n-gram that ends here (0: of none)."""

    above: np.ndarray
    word: np.ndarray
    weight: np.ndarray

    def keys(self, size: int) -> np.ndarray:
        return self.above * size + self.word


@dataclass
class Paths:
    words: pa.Array
    depths: list[Depth]

    def __len__(self) -> int:
        return sum(len(d.word) for d in self.depths)

    def compact(self) -> Paths:
        """Without the words that no arc holds."""
        used = np.zeros(len(self.words), bool)
        for d in self.depths:
            used[d.word] = True
        new = np.cumsum(used) - 1
        return Paths(self.words.filter(pa.array(used)), [Depth(d.above, new[d.word], d.weight) for d in self.depths])

    def kept(self, keep: list[np.ndarray]) -> Paths:
        """Only the marked arcs and those above them; an arc that is there for others only loses its count."""
        need = [k.copy() for k in keep]
        for k in range(len(need) - 1, 0, -1):
            need[k - 1][self.depths[k].above[need[k]]] = True
        depths, new = [], np.zeros(1, np.int64)
        for d, k, n in zip(self.depths, keep, need):
            depths.append(Depth(new[d.above[n]], d.word[n], np.where(k, d.weight, 0)[n]))
            new = np.cumsum(n) - 1
        return Paths(self.words, depths).compact()

    def word_of(self, depth: int, at: np.ndarray) -> list[np.ndarray]:
        """Numbers of the words of some paths of a depth (counted from 0), the first word first."""
        out = []
        for k in range(depth, -1, -1):
            out.append(self.depths[k].word[at])
            at = self.depths[k].above[at]
        return out[::-1]

    def place(self, gram: Sequence[bytes]) -> list[int]:
        """How many arcs of each depth end n-grams before ``gram``."""
        out, begin, end, after = [], 0, 1, False
        for k, d in enumerate(self.depths):
            lo, hi = np.searchsorted(d.above, [begin, end])
            if after or k >= len(gram):  # what lies below the arcs found so far comes after
                begin = end = lo
                out.append(int(lo))
                continue
            number, there = self._number(gram[k])
            begin = lo + int(np.searchsorted(d.word[lo:hi], number))
            out.append(begin + int(bool(there and begin < hi and d.word[begin] == number and k + 1 < len(gram))))
            if there and begin < hi and d.word[begin] == number:
                end = begin + 1
            else:
                end, after = begin, True
        return out

    def _number(self, word: bytes) -> tuple[int, bool]:
        lo, hi = 0, len(self.words)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.words[mid].as_py() < word:
                lo = mid + 1
            else:
                hi = mid
        return lo, lo < len(self.words) and self.words[lo].as_py() == word

    def split(self, bounds: list[tuple[bytes, ...]]) -> list[tuple[int, Paths]]:
        """``(range, paths)`` between the sorted bounds, without empty ranges; range ``i`` begins at bound ``i - 1``."""
        ends = [len(d.word) for d in self.depths]
        places = [[0] * len(ends), *map(self.place, bounds), ends]
        out = []
        for r, (lo, hi) in enumerate(zip(places, places[1:])):
            if lo == hi:
                continue
            depths, shift = [], 0
            first = list(lo)
            for k in range(len(ends) - 1, 0, -1):  # the arc above the first one may lie before the bound
                if first[k] < hi[k]:
                    first[k - 1] = min(first[k - 1], int(self.depths[k].above[first[k]]))
            for d, f, a, b in zip(self.depths, first, lo, hi):
                weight = d.weight[f : max(b, f)].copy()
                weight[: max(0, min(a, len(d.word)) - f)] = 0
                depths.append(Depth(d.above[f : max(b, f)] - shift, d.word[f : max(b, f)], weight))
                shift = f
            out.append((r, Paths(self.words, depths).compact()))
        return out


def union(parts: list[Paths]) -> Paths:
    """All n-grams of the parts, with the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    words, _ = ordered(pa.concat_arrays([p.words for p in parts]))
    size, new = max(len(words), 1), [numbers(p.words, words) for p in parts]
    depths, where = [], [np.zeros(1, np.int64)] * len(parts)
    for k in range(len(parts[0].depths)):
        keys = np.concatenate([w[p.depths[k].above] * size + n[p.depths[k].word] for p, n, w in zip(parts, new, where)])
        found, weight, went = summed(keys, np.concatenate([p.depths[k].weight for p in parts]))
        depths.append(Depth(found // size, found % size, weight))
        where = np.split(went, np.cumsum([len(p.depths[k].word) for p in parts])[:-1])
    return Paths(words, depths)


def composed(asked: Paths, counts: Paths) -> list[np.ndarray]:
    """The count of each asked n-gram, by depth; both automata are walked together, one depth at a time."""
    new, size = numbers(asked.words, counts.words), max(len(counts.words), 1)
    out, where = [], np.zeros(1, np.int64)
    for a, c in zip(asked.depths, counts.depths):
        above, word = where[a.above], new[a.word]
        keys, key = c.keys(size), above * size + word
        at = np.searchsorted(keys, key)
        there = (above >= 0) & (word >= 0) & (at < len(keys))
        there[there] = keys[at[there]] == key[there]
        where = np.where(there, at, -1)
        out.append(np.where(there, c.weight[np.where(there, at, 0)] if len(c.weight) else 0, 0))
    return out


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    top = int(x.max(initial=0))
    kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return kind, x.astype(f"<u{kind}").tobytes()


def to_bytes(p: Paths) -> bytes:
    """The automaton: for each depth the arcs (word, count, state they lead to), and for each state the end of its arcs."""
    columns: list[np.ndarray] = []
    state = np.zeros(len(p.depths[-1].word), np.int64)  # the final one
    for k in range(len(p.depths) - 1, -1, -1):
        d = p.depths[k]
        n = len(p.depths[k - 1].word) if k else 1
        begin = np.searchsorted(d.above, np.arange(n + 1))
        size = np.diff(begin)
        one = np.flatnonzero(size == 1)
        at = begin[one]
        # states with the same only arc are one: their arcs are numbered, then kept once
        _, number = np.unique(d.word[at] << 20 | np.minimum(state[at], (1 << 20) - 1), return_inverse=True)
        big = (d.weight[at] >= 1 << 20) | (state[at] >= (1 << 20) - 1)
        number = np.where(big, np.arange(len(at)) + len(at), number)  # too large to share
        _, first, number = np.unique(number << 20 | np.where(big, 0, d.weight[at]), return_index=True, return_inverse=True)
        many = np.flatnonzero(size > 1)
        arcs = np.concatenate([np.flatnonzero(np.repeat(size > 1, size)), at[first]]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([size[many], np.ones(len(first), np.int64)]))])
        above = np.zeros(n, np.int64)  # state 0 has no arcs
        above[many] = 1 + np.arange(len(many))
        above[one] = 1 + len(many) + number
        columns += [ends, d.word[arcs], d.weight[arcs], state[arcs]]
        state = above
    columns.append(state)
    words = p.words.cast(pa.large_binary())
    joined = b"".join(words.to_pylist())
    columns.append(np.asarray(pc.binary_length(words), np.int64))
    packed = [_narrow(np.asarray(c, np.int64)) for c in columns]
    head = struct.pack("<BI", len(p.depths), len(joined)) + b"".join(struct.pack("<BI", kind, len(b) // kind) for kind, b in packed)
    body = head + b"".join(b for _, b in packed) + joined
    return struct.pack("<I", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def from_bytes(data: bytes) -> Paths:
    body = pa.decompress(data[4:], struct.unpack_from("<I", data)[0], codec="zstd", asbytes=True)
    depth, joined = struct.unpack_from("<BI", body)
    sizes = [struct.unpack_from("<BI", body, 5 + 5 * k) for k in range(4 * depth + 2)]
    at, columns = 5 + 5 * len(sizes), []
    for kind, n in sizes:
        columns.append(np.frombuffer(body, f"<u{kind}", n, at).astype(np.int64))
        at += kind * n
    length = columns.pop()
    offsets = np.concatenate([[0], np.cumsum(length)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body[at : at + joined])])
    state, depths = columns.pop(), []
    for k in range(depth):
        ends, word, weight, target = columns[4 * (depth - 1 - k) : 4 * (depth - k)]
        begin = np.concatenate([[0], ends])  # state 0: from 0 to 0
        size = begin[state + 1] - begin[state]
        total = int(size.sum())
        arcs = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[state], size)
        depths.append(Depth(np.repeat(np.arange(len(state)), size), word[arcs], weight[arcs]))
        state = target[arcs]
    return Paths(words, depths)
