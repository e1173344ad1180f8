"""SentencePiece encoding and decoding with a public model file.

Characters without a piece become byte pieces. Decoding is the exact inverse, but for U+2581, which the format itself uses for a space.
Encoding solves a path through the text, in one of two kinds; ``own`` takes the one that the file asks for, and the queries do so. Else it
is the second for any file.

* Merge order (BPE files): starting from characters, the neighbours whose joint piece has the best score are joined, the leftmost among equal
  ones, until no two neighbours make a piece. A sequence of pieces is the result exactly if every two neighbours, encoded as a pair, are
  themselves: with weight 0 for such neighbours and minus infinity for all others, it is the only path of weight 0.
* Best path (unigram files): the segmentation of largest total score over the model's pieces (among equal scores the longest last piece wins).

Ordinary texts are encoded whole in one scan. Between two characters that stand side by side in no piece every segmentation has a
border, so the words between such borders are solved on their own and remembered; by merge order, the new ones among texts of about half a
megabyte together (:mod:`sortfolio.llm.merging`), since most words of a large corpus are rare. Texts above ``giant`` characters are cut into chunks of
any end that tasks solve independently, by max-plus products:

1. A chunk's transfer matrix holds the best weight from each entry state to each exit state. For the best path a state is the number of characters by
   which a piece reaches over the chunk's border; for merge order it is the piece itself that ends at the border or reaches over it.
2. The matrices of a text are combined by an associative scan of max-plus products: each chunk learns the weights of its entries.
3. With these, each chunk's exit tells the entry its path comes from; a scan from the end fixes all borders.
4. Each chunk backtraces its own pieces between its two borders.

Defined cases: null and empty texts have no pieces; repeated rows are encoded alike; an empty table stays empty; of the input only
the key and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortfolio.llm.merging import Merges, spans
from sortfolio.llm.storage import Solved, land

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK = 1 << 16, 1 << 14
CACHE, CACHED_CHARS = 400_000, 64
#: units that are remembered
UNITS = 1 << 17
SPACE = "▁"
_NORMAL, _USER, _BYTE = 1, 4, 6
_UNUSED, _BPE = 5, 2


def _proto(model: bytes):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return proto


class Vocabulary:
    """Pieces, scores and byte pieces of a model; ``own``: encodes as the file's kind asks."""

    def __init__(self, model: bytes, own: bool = False):
        proto = _proto(model)
        self.merges = own and proto.trainer_spec.model_type == _BPE
        if self.merges and any(p.type in (_USER, _UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces of a merge-order model aren't supported")
        self.table: dict[str, tuple[int, float] | None] = {}  # None: only the beginning of pieces
        self.byte_ids, self.shown = [0] * 256, []
        least = min(p.score for p in proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type in (_NORMAL, _USER):
                self.table[p.piece] = (i, float(p.score))
                for k in range(1, len(p.piece)):
                    self.table.setdefault(p.piece[:k])
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            self.shown.append(bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.encode() if p.type in (_NORMAL, _USER) else b"")
        self.unknown = least - 10.0
        self.longest = max(map(len, self.table))
        #: the pieces by their characters, one dictionary a step; "" holds a piece's id and score
        self.root: dict = {}
        for piece, hit in self.table.items():
            if hit:
                node = self.root
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = hit
        self.unit = self._units({p for p, v in self.table.items() if v})
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.known = Solved(self.solve)
        self.lossy = False  # whether the pieces of any unit so far do not spell it
        self.pairs: dict[tuple[str, str], bool] = {}
        #: characters that are pieces, their ids by code point, and the joins of pieces; equal scores have equal ranks
        self.single = {p for p, hit in self.table.items() if hit and len(p) == 1}
        self.symbols = np.zeros(1 + max(map(ord, self.single), default=0), np.int32)
        self.symbols[[*map(ord, self.single)]] = [self.table[c][0] for c in self.single]
        self.joins = Merges(self._joins()) if self.merges else None

    def _joins(self) -> Iterator[tuple[int, int, int, int]]:
        rank = {score: k for k, score in enumerate(sorted({hit[1] for hit in self.table.values() if hit}, reverse=True))}
        for piece, hit in self.table.items():
            for k in range(1, len(piece)) if hit else ():
                if (left := self.table.get(piece[:k])) and (right := self.table.get(piece[k:])):
                    yield left[0], right[0], rank[hit[1]], hit[0]

    @staticmethod
    def _units(found: set[str]) -> re.Pattern:
        """Cuts a text where no piece can run over: two neighbours that stand side by side in no piece are always cut.

        Used where the model's pieces allow it: before a space, from a word to a mark, and around characters in no piece. Marks are
        ASCII punctuation and whatever stands before a mark in some piece; letters and decimals must not be among them.
        """
        pairs = {(a, b) for p in found for a, b in zip(p, p[1:])}
        if any(a != SPACE and b == SPACE for a, b in pairs):
            return re.compile("(?s).+")
        used = set("".join(found))
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum() and c in used}
        while more := {a for a, b in pairs if b in marks and a != SPACE} - marks:
            marks |= more
        if any(c.isalpha() or c.isdecimal() for c in marks):
            return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        mark, alone = ("".join(map(re.escape, sorted(x))) for x in (marks, {c for c in map(chr, range(128)) if c != " " and c not in used}))
        word = f"[^{SPACE}{mark}{alone}]"
        return re.compile(f"{SPACE}+[{mark}]*{word}*|[{mark}]+{word}*|{word}+" + (f"|[{alone}]" if alone else ""))

    def steps(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """End and score of every piece that begins at ``at``; an unknown character counts as a piece."""
        single = False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            part = text[at:end]
            if part not in self.table:
                break
            if (hit := self.table[part]) is not None:
                single |= end == at + 1
                yield end, hit[1]
        if not single:
            yield at + 1, self.unknown

    def forward(self, text: str, entry: list[float], size: int) -> tuple[list[float], list[int], list[int]]:
        """Best score, piece start and piece id of every place, for pieces that begin before ``size``.

        Start -1: the place was an entry; id -1: an unknown character.
        """
        low, n, root, unknown = float("-inf"), len(text), self.root, self.unknown
        score = entry + [low] * (n + 1 - len(entry))
        back, piece = [-1] * (n + 1), [-1] * (n + 1)
        for at in range(size):
            base = score[at]
            if base == low:
                continue
            node, single = root, False
            for end in range(at, n):
                node = node.get(text[end])
                if node is None:
                    break
                hit = node.get("")
                if hit is not None:
                    if end == at:
                        single = True
                    if base + hit[1] > score[end + 1]:
                        score[end + 1], back[end + 1], piece[end + 1] = base + hit[1], at, hit[0]
            if not single and base + unknown > score[at + 1]:
                score[at + 1], back[at + 1], piece[at + 1] = base + unknown, at, -1
        return score, back, piece

    def ids(self, text: str, back: list[int], piece: list[int], end: int) -> list[int]:
        """Piece ids of the path that ends at ``end``, from its entry on."""
        out: list[int] = []
        while back[end] >= 0:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[back[end] : end].encode()))
            end = back[end]
        out.reverse()
        return out

    def parts(self, unit: str) -> list[str]:
        """Pieces by merge order: over a linked list of parts and a heap of the joins that are possible."""
        table, n = self.table, len(unit)
        part: list[str] = list(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # best score first, then the leftmost place; the joint piece tells whether an entry still holds
        heap = [(-hit[1], i, two) for i in range(n - 1) if (hit := table.get(two := unit[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, two = heappop(heap)
            j = after[i]
            if not part[i] or j == n or len(part[i]) + len(part[j]) != len(two):
                continue
            part[i], part[j] = two, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (hit := table.get(more := two + part[k])) is not None:
                    heappush(heap, (-hit[1], i, more))
            h = before[i]
            if h >= 0 and (hit := table.get(more := part[h] + two)) is not None:
                heappush(heap, (-hit[1], h, more))
        return [p for p in part if p]

    def ids_of(self, parts: list[str]) -> list[int]:
        """Ids of pieces; a character in no piece is its bytes."""
        out: list[int] = []
        for p in parts:
            hit = self.table.get(p)
            if hit is not None:
                out.append(hit[0])
            else:
                out.extend(self.byte_ids[b] for b in p.encode())
        return out

    def fits(self, a: str, b: str) -> bool:
        """Whether two neighbours, encoded as a pair by merge order, are themselves."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.parts(a + b) == [a, b]
        return found

    def ends(self, text: str, at: int) -> Iterator[int]:
        """The ends of the pieces that begin at a place; a character in no piece counts as one."""
        node, single = self.root, False
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            if "" in node:
                single |= end == at
                yield end + 1
        if not single:
            yield at + 1

    def border(self, text: str, cut: int) -> list[tuple[int, int]]:
        """The pieces that end at a cut or reach over it, as places in the text; at its beginning, the empty one."""
        if cut == 0:
            return [(0, 0)]
        return [(at, end) for at in range(max(0, cut - self.longest), cut) for end in self.ends(text, at) if end >= cut]

    def paths(self, text: str, stop: int, entries: list[tuple[int, int]]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], tuple[int, int]]]:
        """The border states at ``stop``, each with the entries (as bits) that a path of fitting neighbours leads from, and each piece's
        neighbour before it.

        A prefix has one encoding, so a place has no more than one piece for each entry.
        """
        at: dict[int, dict[tuple[int, int], int]] = {}
        before: dict[tuple[int, int], tuple[int, int]] = {}
        for i, piece in enumerate(entries):
            at.setdefault(piece[1], {})[piece] = 1 << i
        for place in range(min(at, default=stop), stop):
            held = at.pop(place, None)
            if held is None:
                continue
            for end in self.ends(text, place):
                mask, b = 0, text[place:end]
                for piece, m in held.items():
                    if piece[0] == piece[1] or self.fits(text[piece[0] : piece[1]], b):
                        mask |= m
                        before[place, end] = piece
                if mask:
                    at.setdefault(end, {})[place, end] = mask
        return {piece: m for held in at.values() for piece, m in held.items()}, before

    def solve(self, unit: str) -> bytes:
        if self.merges:
            ids = self.ids_of(self.parts(unit))
        else:
            _, back, piece = self.forward(unit, [0.0], len(unit))
            ids = self.ids(unit, back, piece, len(unit))
        self.lossy |= b"".join(map(self.shown.__getitem__, ids)) != unit.encode()
        found = array("i", ids).tobytes()
        if len(unit) <= CACHED_CHARS:
            if len(self.known) >= UNITS:
                self.known.clear()
            self.known[unit] = found
        return found

    def normalised(self, text: str) -> str:
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def learn(self, units: set[str]) -> None:
        """Remember the units of a merge-order model, but for long ones and those with a character in no piece."""
        new = units - self.known.keys()
        if len(self.known) + len(new) > UNITS:
            self.known.clear()
            new = units
        short = [u for u in new if len(u) <= CACHED_CHARS and self.single.issuperset(u)]
        if short:
            whole = "".join(short)
            found = self.joins.packed(self.symbols[np.frombuffer(whole.encode("utf-32-le"), np.uint32)], np.fromiter(map(len, short), np.int64, len(short)))
            self.lossy |= b"".join(map(self.shown.__getitem__, np.frombuffer(b"".join(found), "<i4").tolist())) != whole.encode()
            self.known.update(zip(short, found))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers, one after the other."""
        units = [self.unit.findall(self.normalised(t)) for t in texts]
        if self.merges:
            self.learn(set().union(*units))
        return [b"".join(map(self.known.__getitem__, u)) for u in units]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def exact(self, text: str, ids: bytes) -> bool:
        """Whether the ids that :meth:`encode` gave decode to the very text.

        Units are checked when they are solved. While all of them are spelt by their pieces, so is a text, but for U+2581.
        """
        if self.lossy:
            return self.decode(np.frombuffer(ids, np.int32).tolist()) == text
        return SPACE not in text

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def vocabulary(model: bytes, own: bool = False) -> Vocabulary:
    return Vocabulary(model, own)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return np.stack([(x[:, :, None] + y[None, :, :]).max(1) for x, y in zip(a, b)])


def prefix_products(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, in a logarithmic number of associative steps."""
    out, step = matrices, 1
    while step < len(out):
        out = np.concatenate([out[:step], product(out[:-step], out[step:])])
        step *= 2
    return out


def transfer(v: Vocabulary, text: str, size: int, last: bool) -> np.ndarray:
    """Best score from each entry to each exit state of a chunk of ``size`` characters; ``text`` goes on for the exit states."""
    states = v.longest
    score = np.full((size + states, states), -np.inf)  # place, entry state
    score[np.arange(states), np.arange(states)] = 0
    if len(text) < states - 1:
        score[len(text) + 1 :] = -np.inf
    for at in range(size):
        for end, gain in v.steps(text, at):
            np.maximum(score[end], score[at] + gain, out=score[end])
    out = score[size : size + states].T.copy()
    if last:
        out[:, 1:] = -np.inf
    return out


def _entry(values: np.ndarray, text: str) -> list[float]:
    return [float(x) for x in values[: len(text) + 1]]


def _cut(docs: DataFrame, model, chunk: int) -> DataFrame:
    """``(row, id, sha, chunk, size, last, text)``: chunks with the characters that their exit states reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for b in batches:
            for k in range(b.num_rows):
                text = v.normalised(b.column(2)[k].as_py())
                starts = range(0, len(text), chunk)
                n = len(starts)
                sizes = [min(chunk, len(text) - s) for s in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[k].as_py()] * n, pa.int64()), pa.array([b.column(1)[k].as_py()] * n, b.column(1).type),
                     pa.array([b.column(3)[k].as_py()] * n), pa.array(range(n), pa.int32()), pa.array(sizes, pa.int32()),
                     pa.array([s == starts[-1] for s in starts]), pa.array([text[s : s + chunk + v.longest - 1] for s in starts])],
                    ["row", "id", "sha", "chunk", "size", "last", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text", F.sha2("text", 256)).mapInArrow(
        run, f"row bigint, id {kind}, sha string, chunk int, size int, last boolean, text string")


def _cut_around(docs: DataFrame, model, chunk: int) -> DataFrame:
    """``(row, id, sha, chunk, lead, size, text)``: chunks with the characters on both sides that border pieces may hold, ``lead`` before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value, True)
        step = max(chunk, v.longest)  # no piece runs over a whole chunk
        for b in batches:
            for k in range(b.num_rows):
                text = v.normalised(b.column(2)[k].as_py())
                starts = range(0, max(1, len(text) - v.longest), step)  # the last chunk takes a short rest
                for n, begin in enumerate(starts):
                    end = len(text) if n + 1 == len(starts) else begin + step
                    lead = min(begin, v.longest)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(k, 1), b.column(1).slice(k, 1), b.column(3).slice(k, 1), pa.array([n], pa.int32()), pa.array([lead], pa.int32()),
                         pa.array([end - begin], pa.int32()), pa.array([text[begin - lead : end + v.longest]])], ["row", "id", "sha", "chunk", "lead", "size", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text", F.sha2("text", 256)).mapInArrow(
        run, f"row bigint, id {kind}, sha string, chunk int, lead int, size int, text string")


def _own_matrices(chunks: DataFrame, model) -> DataFrame:
    """Transfer matrices of fitting neighbours: weight 0, or minus infinity; one byte an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value, True)
        for b in batches:
            for x in b.to_pylist():
                stop = x["lead"] + x["size"]
                entries, exits = v.border(x["text"], x["lead"]), v.border(x["text"], stop)
                found, _ = v.paths(x["text"], stop, entries)
                m = np.array([[found.get(e, 0) >> i & 1 for e in exits] for i in range(len(entries))], np.int8)
                yield pa.RecordBatch.from_pylist([{"row": x["row"], "chunk": x["chunk"], "entries": len(entries), "matrix": m.tobytes()}],
                                                 pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("entries", pa.int32()), ("matrix", pa.binary())]))

    return chunks.select("row", "chunk", "lead", "size", "text").mapInArrow(run, "row bigint, chunk int, entries int, matrix binary")


def _own_borders(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit state of each chunk on the text's only path; rows: one text's matrices."""
    rows = rows.sort_values("chunk")
    flat = [np.frombuffer(m, np.int8).reshape(n, -1) for m, n in zip(rows["matrix"], rows["entries"])]
    states = max(max(m.shape) for m in flat)
    matrices = np.full((len(flat), states, states), -np.inf, np.float32)
    for k, m in enumerate(flat):
        matrices[k, : m.shape[0], : m.shape[1]] = np.where(m, 0, -np.inf)
    begin = np.full(states, -np.inf, np.float32)
    begin[0] = 0
    reached = [begin, *prefix_products(matrices)[:, 0]]
    last = np.flatnonzero(reached[-1] == 0)
    borders = []
    for k in range(len(flat), -1, -1):
        if len(last) != 1:
            raise ValueError("the text has not exactly one path of fitting neighbours")
        borders.append(int(last[0]))
        if k:
            last = np.flatnonzero(reached[k - 1] + matrices[k - 1][:, last[0]] == 0)
    borders.reverse()
    return pd.DataFrame({"row": rows["row"], "chunk": rows["chunk"], "entry": borders[:-1], "exit": borders[1:]})


def _own_traced(chunks: DataFrame, model) -> DataFrame:
    """The pieces that begin in each chunk, from its entry to its exit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value, True)
        for b in batches:
            for x in b.to_pylist():
                text, stop = x["text"], x["lead"] + x["size"]
                entry, piece = v.border(text, x["lead"])[x["entry"]], v.border(text, stop)[x["exit"]]
                _, before = v.paths(text, stop, [entry])
                parts = []
                while piece != entry:
                    parts.append(text[piece[0] : piece[1]])
                    piece = before[piece]
                ids = array("i", v.ids_of(parts[::-1])).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x["row"]], pa.int64()), pa.array([x["chunk"]], pa.int32()), _list_array([ids])], ["row", "chunk", "ids"])

    return chunks.select("row", "chunk", "lead", "size", "text", "entry", "exit").mapInArrow(run, "row bigint, chunk int, ids array<int>")


def _own_solved(chunks: DataFrame, model, at: list[str]) -> DataFrame:
    """Pieces of a merge-order model's chunks, each between the borders of its text's only path."""
    found = land(_own_matrices(chunks, model), "matrices")
    borders = land(found.groupBy("row").applyInPandas(_own_borders, "row bigint, chunk int, entry int, exit int"), "borders")
    return _own_traced(chunks.join(borders, at).repartition(*at), model)


def _matrices(chunks: DataFrame, model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for b in batches:
            for x in b.to_pylist():
                m = transfer(v, x["text"], x["size"], x["last"])
                yield pa.RecordBatch.from_pylist([{"row": x["row"], "chunk": x["chunk"], "matrix": m.tobytes()}],
                                                 pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("matrix", pa.binary())]))

    return chunks.select("row", "chunk", "size", "last", "text").mapInArrow(run, "row bigint, chunk int, matrix binary")


def _entry_scores(rows: pd.DataFrame) -> pd.DataFrame:
    """Best score of every entry state of each chunk of a text; rows: one text's matrices, 2 kB a chunk."""
    rows = rows.sort_values("chunk")
    states = int(np.sqrt(len(rows["matrix"].iloc[0]) // 8))
    matrices = np.stack([np.frombuffer(m).reshape(states, states) for m in rows["matrix"]])
    begin = np.full(states, -np.inf)
    begin[0] = 0
    scores = [begin, *prefix_products(matrices)[:-1, 0]]
    return pd.DataFrame({"row": rows["row"], "chunk": rows["chunk"], "entry": [s.tobytes() for s in scores]})


def _origins(chunks: DataFrame, model) -> DataFrame:
    """For each chunk and exit state the entry state of its best path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for b in batches:
            for x in b.to_pylist():
                text = x["text"]
                _, back, _ = v.forward(text, _entry(np.frombuffer(x["entry"]), text), x["size"])
                table = []
                for end in range(x["size"], min(len(text), x["size"] + v.longest - 1) + 1):
                    while back[end] >= 0:
                        end = back[end]
                    table.append(min(end, 127))
                table += [0] * (v.longest - len(table))
                yield pa.RecordBatch.from_pylist([{"row": x["row"], "chunk": x["chunk"], "origin": np.array(table, np.int8).tobytes()}],
                                                 pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("origin", pa.binary())]))

    return chunks.select("row", "chunk", "size", "text", "entry").mapInArrow(run, "row bigint, chunk int, origin binary")


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Exit state of each chunk on the text's best path, from its end on."""
    rows = rows.sort_values("chunk")
    exits, state = [], 0
    for origin in reversed(rows["origin"].tolist()):
        exits.append(state)
        state = int(np.frombuffer(origin, np.int8)[state])
    return pd.DataFrame({"row": rows["row"], "chunk": rows["chunk"], "exit": exits[::-1]})


def _traced(chunks: DataFrame, model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for b in batches:
            for x in b.to_pylist():
                _, back, piece = v.forward(x["text"], _entry(np.frombuffer(x["entry"]), x["text"]), x["size"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["row"]], pa.int64()), pa.array([x["chunk"]], pa.int32()),
                     pa.array([v.ids(x["text"], back, piece, x["size"] + x["exit"])], pa.list_(pa.int32()))], ["row", "chunk", "ids"])

    return chunks.select("row", "chunk", "size", "text", "entry", "exit").mapInArrow(run, "row bigint, chunk int, ids array<int>")


def encode_giants(docs: DataFrame, model, chunk: int, own: bool = False) -> DataFrame:
    """``(id, sha, ids)`` of texts solved chunk by chunk."""
    at = ["row", "chunk"]
    merges = own and _proto(model.value).trainer_spec.model_type == _BPE  # the driver needs no tables of pieces
    chunks = land((_cut_around if merges else _cut)(docs, model, chunk).repartition(*at), "chunks")
    traced = land((_own_solved if merges else _solved)(chunks, model, at), "traced")
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    return chunks.where("chunk = 0").select("row", "id", "sha").join(whole, "row").drop("row")


def _solved(chunks: DataFrame, model, at: list[str]) -> DataFrame:
    """Pieces of a unigram model's chunks, each between the borders of its text's best path."""
    found = land(_matrices(chunks, model), "matrices")
    entry = land(found.groupBy("row").applyInPandas(_entry_scores, "row bigint, chunk int, entry binary"), "entries")
    begun = land(chunks.join(entry, at), "begun")
    origin = land(_origins(begun, model), "origins")
    exits = land(origin.groupBy("row").applyInPandas(_exits, "row bigint, chunk int, exit int"), "exits")
    return _traced(begun.join(exits, at), model)


def _list_array(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK,
           own: bool = False) -> DataFrame:
    """``(key, ids, exact)``: the piece ids of each text, and whether they decode to the very text."""
    with open(model_path, "rb") as f:  # a tokenizer file is installed on the driver and sent from there
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value, own)
        for b in batches:
            for first, texts in spans(b.column(1)):
                ids = v.encode_all(texts)
                exact = pa.array([v.exact(t, i) for t, i in zip(texts, ids)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), _list_array(ids), exact], ["id", "ids", "exact"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        v = vocabulary(model.value)
        for b in batches:
            exact = [hashlib.sha256(v.decode(i).encode()).hexdigest() == s for i, s in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(exact)], ["id", "ids", "exact"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    large = F.coalesce(F.length("text") > giant, F.lit(False))
    out = f"id {kind}, ids array<int>, exact boolean"
    small = rows.where(~large).mapInArrow(run, out)
    big = encode_giants(rows.where(large), model, chunk, own).select("id", "sha", "ids").mapInArrow(check, out)
    return small.unionByName(big).withColumnRenamed("id", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model_path: str = MODEL) -> DataFrame:
    """``(key, text)`` of piece ids."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", key)
