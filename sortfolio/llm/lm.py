"""Language-model scores by logistic mixing of hashed-context bit predictors, with a word-count baseline.

A text is read as its words, lower-cased in A-Z, each followed by a space, then one end mark, byte by byte and bit by bit.

1. One scan of the training texts counts windows of ``ORDER + 1`` bytes and words; both tables grow with the corpus and are summed
   by shuffles.
2. Predictors: for each context of 1 to ``ORDER`` bytes and each beginning of the next byte's bits a slot counts the zeros and ones
   that followed. Slots are hashed into a table for each order, with counts in one byte on a scale that is exact up to 32. Tables have
   as many slots as there are distinct windows, up to the next power of two, so that contexts stay apart as the corpus grows; ``MOST_BITS``
   bounds what is broadcast, and beyond it contexts begin to share slots.
3. Mixing: each predictor's probability enters in the logistic domain; a gate (the bit's place, the longest context seen and how
   often) selects the set of weights. Weights are learnt online, batch by batch as each partition of the window table streams by in the order
   of hashes, and averaged over the partitions. A window is predicted from counts without one occurrence of itself, as an unseen text is.
4. Refinement: an adaptive probability map by gate and mixed probability, gathered with these weights, corrects the result.
5. Scoring: a text's score is the sum over its windows. Tasks score each distinct window once and remember it.

The baseline needs each word's training count. The ``HEAD`` most frequent words are broadcast (a fixed number); all others are
joined with the counts by shuffle.

Defined cases: null and blank texts are their end mark alone; repeated rows are scored (and learnt) row by row; a null key is in no
part, so it is learnt from and not held out; without training texts every bit has probability one half and the baseline is 0; an
empty table stays empty; other columns than key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortfolio.llm import tokens
from sortfolio.llm.linear import part_of
from sortfolio.llm.storage import land

ORDER, HEAD = 5, 1 << 16
#: slots of a table, in bits: 168 MB for all orders at most
LEAST_BITS, MOST_BITS = 18, 24
BLOCK_BITS = 16
GATES, INPUTS, BUCKETS = 8 * (ORDER + 1) * 4, ORDER + 1, 33
END = tokens.mix(np.array([1], np.uint64))[0]
_U = np.uint64
_EXACT, _STEP = 32, 1.1
#: count behind each code, and code of each count
COUNTS = np.concatenate([np.arange(_EXACT + 1), _EXACT * _STEP ** np.arange(1, 256 - _EXACT)])


def codes(n: np.ndarray) -> np.ndarray:
    small = np.minimum(n, _EXACT)
    return np.where(n <= _EXACT, small, np.minimum(255, _EXACT + np.round(np.log(np.maximum(n, 1) / _EXACT) / np.log(_STEP)))).astype(np.uint8)


def terminated(column: pa.Array) -> pa.Array:
    """Each text with the white space that ends it: every word is then followed by some."""
    filled = column.cast(pa.large_string()).fill_null("")
    return pc.binary_join_element_wise(filled, pa.scalar(" \n", pa.large_string()), pa.scalar("", pa.large_string()))


def windows(s: tokens.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The window that ends at each byte of the slice's texts, and the first window of each row."""
    data = tokens.LOWER[s.data]
    inside = tokens.NOT_SPACE[data]
    keep, last = inside.copy(), s.end - 1
    keep[1:] |= inside[:-1]
    keep[last] = True
    data = np.where(inside, data, np.uint8(32))
    data[last] = 10
    first = np.concatenate([[0], np.cumsum(np.add.reduceat(keep.astype(np.int64), s.begin))])
    data = data[keep].astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(first[:-1], np.diff(first))
    out = data.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= np.where(place[k:] >= k, data[:-k], _U(0)) << _U(8 * k)
    return out, first


def word_counts(s: tokens.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, count)`` of each row's distinct words and of the end mark, ordered by row, and the tokens of each row."""
    w = tokens.words(s, tokens.NOT_SPACE)
    rows = len(s.begin)
    row, h = np.concatenate([w.row, np.arange(rows)]), np.concatenate([w.hash, np.full(rows, END)])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
    return row[head], h[head], np.diff(np.concatenate([head, [len(row)]])), w.per_row + 1


class Totals:
    """Counts by key, kept as few sorted pieces."""

    def __init__(self):
        self.keys, self.counts, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.new.append(tokens.summed(keys, counts))
        if sum(len(k) for k, _ in self.new) > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.counts), *self.new]
        self.keys, self.counts = tokens.summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self.new = []

    def batches(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for i in range(0, len(self.keys), 1 << 16):
            k, n = self.keys[i : i + (1 << 16)], self.counts[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n)], ["kind", "key", "n"])


def corpus_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(kind, key, n)``: occurrences of each window (kind 0) and of each word and the end mark (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, words = Totals(), Totals()
        for b in batches:
            for s in tokens.slices(terminated(b.column(0))):
                wide.add(windows(s)[0])
                _, h, n, _ = word_counts(s)
                words.add(h, n)
            for kind, t in ((0, wide), (1, words)):
                if len(t.keys) > 1 << 21:
                    yield from t.batches(kind)
                    t.__init__()
        yield from wide.batches(0)
        yield from words.batches(1)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def slot_bits(n: int) -> int:
    """Bits of a table's slots for so many distinct windows."""
    return min(MOST_BITS, max(LEAST_BITS, (max(n, 1) - 1).bit_length()))


def _slots(keys: np.ndarray, bits_: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each window's every bit in every order's table (window, bit, order), and the bits."""
    byte = keys & _U(255)
    bit = np.arange(8, dtype=np.uint64)
    node = (_U(1) << bit) | (byte[:, None] >> (_U(8) - bit))
    bits = ((byte[:, None] >> (_U(7) - bit)) & _U(1)).astype(np.int8)
    context = np.stack([tokens.mix(((keys >> _U(8)) & _U((1 << 8 * k) - 1)) + _U(k << 56)) for k in range(1, ORDER + 1)], axis=1)
    h = (context[:, None, :] ^ (node[:, :, None] * _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
    return (h >> _U(64 - bits_)).astype(np.int64), bits


def bit_counts(wide: DataFrame, size: int) -> DataFrame:
    """``(slot, n0, n1)`` over all orders' tables; the order stands above the slot's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Totals()
        for b in batches:
            keys, n = np.asarray(b.column(0), dtype=np.int64).view(np.uint64), np.asarray(b.column(1), dtype=np.int64)
            for i in range(0, len(keys), 1 << 13):
                slot, bits = _slots(keys[i : i + (1 << 13)], size)
                slot = slot + (np.arange(ORDER) << size)
                total.add(((slot << 1) | bits[:, :, None]).astype(np.uint64).ravel(), np.repeat(n[i : i + (1 << 13)], 8 * ORDER))
        total.merge()
        for i in range(0, len(total.keys), 1 << 16):
            k, n = total.keys[i : i + (1 << 16)].astype(np.int64), total.counts[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k >> 1), pa.array(n * (1 - (k & 1))), pa.array(n * (k & 1))], ["slot", "n0", "n1"])

    return wide.select("key", "n").mapInArrow(run, "slot bigint, n0 bigint, n1 bigint").groupBy("slot").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros((1 << BLOCK_BITS, 2), np.uint8)
    at = rows["slot"].to_numpy() & ((1 << BLOCK_BITS) - 1)
    out[at, 0], out[at, 1] = codes(rows["n0"].to_numpy()), codes(rows["n1"].to_numpy())
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "data": [out.tobytes()]})


def tables(counts: DataFrame, size: int) -> np.ndarray:
    """The predictors' tables (order, slot) of two packed codes."""
    out = np.zeros((ORDER << size, 2), np.uint8)
    blocks = counts.withColumn("block", F.shiftright("slot", BLOCK_BITS)).groupBy("block").applyInPandas(_packed, "block bigint, data binary")
    for row in blocks.toLocalIterator():
        out[row.block << BLOCK_BITS : (row.block + 1) << BLOCK_BITS] = np.frombuffer(row.data, np.uint8).reshape(-1, 2)
    return out.reshape(ORDER, -1, 2)


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.05) / (n0 + 0.05)) * (n0 + n1 > 0)


def _gates(seen: np.ndarray) -> np.ndarray:
    """Weight set of each bit from the contexts' counts (window, bit, order)."""
    longest = (seen > 0).sum(2)
    n = np.take_along_axis(seen, np.maximum(longest - 1, 0)[:, :, None], 2)[:, :, 0]
    level = (n > 1).astype(np.int64) + (n > 3) + (n > 12)
    return (np.arange(8)[None, :] * (ORDER + 1) + longest) * 4 + level


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.clip(np.round(z * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)


def first_weights() -> np.ndarray:
    out = np.full((GATES, INPUTS), 0.3)
    out[:, -1] = 0
    return out


def _inputs(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each bit of the windows, its gate, and what the predictors say from counts without one occurrence of the window itself."""
    slot, bits = _slots(keys, table.shape[1].bit_length() - 1)
    pair = COUNTS[table[np.arange(ORDER), slot]]
    pair[:, :, :, 0] = np.maximum(0, pair[:, :, :, 0] - (bits == 0)[:, :, None])
    pair[:, :, :, 1] = np.maximum(0, pair[:, :, :, 1] - (bits == 1)[:, :, None])
    return bits, _gates(pair.sum(3)), np.concatenate([stretch(pair[..., 0], pair[..., 1]), np.ones(bits.shape + (1,))], axis=2)


def _streamed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and their counts, some at a time."""
    for b in batches:
        keys, n = np.asarray(b.column(0), dtype=np.int64).view(np.uint64), np.asarray(b.column(1), dtype=np.float64)
        for i in range(0, len(keys), size):
            yield keys[i : i + size], n[i : i + size]


def learn(weights: np.ndarray, table: np.ndarray, keys: np.ndarray, n: np.ndarray, rate: float = 0.02) -> None:
    """One step of the gates' weights on a batch of windows."""
    bits, gate, x = _inputs(table, keys)
    mass = np.repeat(n, 8).reshape(-1, 8)
    pull = ((bits - _sigmoid((x * weights[gate]).sum(2))) * mass)[:, :, None] * x
    total = np.bincount(gate.ravel(), weights=mass.ravel(), minlength=GATES)
    step = np.stack([np.bincount(gate.ravel(), weights=pull[:, :, k].ravel(), minlength=GATES) for k in range(INPUTS)], axis=1)
    weights += rate * step / np.maximum(total, 1)[:, None]


def look(seen: np.ndarray, weights: np.ndarray, table: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
    """Adds a batch of windows to the map's ``(ones, all)`` by gate and bucket."""
    bits, gate, x = _inputs(table, keys)
    mass = np.repeat(n, 8).reshape(-1, 8)
    np.add.at(seen, (gate, _bucket((x * weights[gate]).sum(2))), np.stack([mass * bits, mass], axis=2))


def _added(rows: DataFrame) -> np.ndarray | None:
    """Sums by place of vectors that tasks gave as ``(k, x)``."""
    found = rows.groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    return None if found.empty else found.sort_values("k")["x"].to_numpy()


def _vector(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "x"])


def mixer(wide: DataFrame, sent, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Weights averaged over the partitions by their text, and the refinement map; both of fixed size.

    A task holds one batch of windows at a time. Their order is that of a hash, whatever order the shuffle brings them in.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total = first_weights(), 0.0
        for keys, n in _streamed(batches, batch):
            learn(weights, sent.value, keys, n)
            total += n.sum()
        if total:
            yield _vector(np.concatenate([weights.ravel() * total, [total]]))

    dealt = wide.select("key", "n").repartition("key").sortWithinPartitions(F.xxhash64("key"), "key")
    values = _added(dealt.mapInArrow(weigh, "k bigint, x double"))
    seen = np.zeros((GATES, BUCKETS, 2))
    if values is None:
        return first_weights(), seen
    weights = (values[:-1] / values[-1]).reshape(GATES, INPUTS)

    def map_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros((GATES, BUCKETS, 2))
        for keys, n in _streamed(batches, batch):
            look(mine, weights, sent.value, keys, n)
        yield _vector(mine.ravel())

    return weights, _added(wide.select("key", "n").mapInArrow(map_, "k bigint, x double")).reshape(seen.shape)


class Scorer:
    """Log10 probability of windows, remembered in a table of fixed size."""

    CACHE_BITS = 21

    def __init__(self, name: str, table: np.ndarray, weights: np.ndarray, seen: np.ndarray):
        self.name, self.table, self.weights = name, table.view(np.uint16)[..., 0], weights.astype(np.float32)
        low, high = np.meshgrid(COUNTS, COUNTS, indexing="ij")  # a pair of codes read as one number: the second is the high byte
        self.stretched = stretch(low.T, high.T).astype(np.float32).ravel()
        self.both = (low + high).T.astype(np.float32).ravel()
        middle = _sigmoid((np.arange(BUCKETS) - BUCKETS // 2) / 2)
        self.map = ((seen[..., 0] + 20 * middle) / (seen[..., 1] + 20)).astype(np.float32)
        self.keys = np.full(1 << self.CACHE_BITS, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(1 << self.CACHE_BITS, np.float32)

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.float32)
        for i in range(0, len(keys), 1 << 12):
            slot, bits = _slots(keys[i : i + (1 << 12)], self.table.shape[1].bit_length() - 1)
            pair = self.table[np.arange(ORDER), slot]
            gate = _gates(self.both[pair])
            w = self.weights[gate]
            z = (self.stretched[pair] * w[:, :, :-1]).sum(2) + w[:, :, -1]
            p = np.clip(0.5 * _sigmoid(z) + 0.5 * self.map[gate, _bucket(z)], 1e-6, 1 - 1e-6)
            out[i : i + (1 << 12)] = np.log10(np.where(bits == 1, p, 1 - p)).sum(1)
        return out

    def scores(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.CACHE_BITS)).astype(np.int64)
        out, miss = self.values[at], np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            own, back = np.unique(keys[miss], return_inverse=True)
            values = self.fresh(own)
            out[miss] = values[back]
            place = ((own * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.CACHE_BITS)).astype(np.int64)
            _, chosen = np.unique(place, return_index=True)  # of several windows at one place one stays, with its own value
            self.keys[place[chosen]], self.values[place[chosen]] = own[chosen], values[chosen]
        return out


_scorers: dict[str, Scorer] = {}


def scorer(name: str, parts) -> Scorer:
    """This worker's scorer of a model; a worker keeps one."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(name, *parts.value)
    return _scorers[name]


def scored_rows(docs: DataFrame, name: str, parts, head, key: str, text: str) -> DataFrame:
    """Per row its model score, its baseline over the frequent words, and the other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (known, logs) = scorer(name, parts), head.value
        for b in batches:
            for s in tokens.slices(terminated(b.column(1))):
                rows = len(s.begin)
                keys, first = windows(s)
                score = np.add.reduceat(model.scores(keys).astype(np.float64), first[:-1])
                row, h, n, size = word_counts(s)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                base = np.bincount(row[hit], weights=logs[at[hit]] * n[hit], minlength=rows).astype(np.float64)
                found = np.bincount(row[hit], weights=n[hit], minlength=rows).astype(np.int64)
                offsets = np.searchsorted(row[~hit], np.arange(rows + 1)).astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array(h[~hit].view(np.int64)), pa.array(n[~hit].astype(np.int32))], ["key", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, rows), pa.array(size.astype(np.int64)), pa.array(np.diff(first)), pa.array(score), pa.array(base),
                     pa.array(found), pa.ListArray.from_arrays(offsets, rest)], ["id", "n_tokens", "n_bytes", "score", "base", "known", "rest"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens bigint, n_bytes bigint, score double, base double, known bigint, rest array<struct<key:bigint,tf:int>>")


def lm_scores(docs: DataFrame, parts: int = 5, held: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``; rows with
    ``crc32(key) mod parts = held`` are scored and never learnt from."""
    spark, part = docs.sparkSession, part_of(key, parts)
    counts = land(corpus_counts(docs.where(part != held), text), "counts")
    wide, words = counts.where("kind = 0"), counts.where("kind = 1")
    size = slot_bits(wide.count())
    table = tables(bit_counts(wide, size), size)
    weights, seen = mixer(wide, spark.sparkContext.broadcast(table))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # written first: collecting an ordered limit would send every task's own top to the driver
    top = land(words.select("key", "n").orderBy(F.desc("n"), "key").limit(HEAD), "head").toPandas()
    known = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    head = spark.sparkContext.broadcast((known[order], np.log10(top["n"].to_numpy(np.float64) + 0.5)[order]))
    model = spark.sparkContext.broadcast((table, weights, seen))
    rows = land(scored_rows(docs, f"{spark.sparkContext.applicationId}/{id(model)}", model, head, key, text)
                .withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = (rows.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.tf")
            .join(words.select("key", "n"), "key", "left").groupBy("row").agg(
                F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_base"),
                F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("rest_known")))
    zero, norm = F.lit(0), float(np.log10(total + 0.5 * (distinct + 1)))
    out = rows.drop("rest").join(land(rest, "rest"), "row", "left")
    return out.select(
        F.col("id").alias(key), (part_of("id", parts) == held).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rest_known", zero)).cast("bigint").alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", zero.cast("double")) - F.col("n_tokens") * norm).alias("base_score"), "score",
        (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
