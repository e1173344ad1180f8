"""Hashed sparse features of texts and linear scores over them, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.llm import tokens

BITS = 20
#: rows, slots and values of a slice's features, ordered by row
Features = Callable[[tokens.Slice], tuple[np.ndarray, np.ndarray, np.ndarray]]


def part_of(key: str, parts: int) -> Column:
    """CRC-32 of the key as text, modulo ``parts``; a null key is in no part and gives -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(-1))


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def counted(row: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(row, slot)`` with their counts."""
    keys, n = np.unique((row.astype(np.int64) << BITS) | slot, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), n


def sample(labels: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` of distinct rows, those with the smallest hash of their key; the bound lets them be broadcast and collected.

    A cut-off from the count leaves about twice as many before the ordered limit, which else would get ``rows`` of every task.
    """
    draw = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    n = labels.count()
    if n > 2 * rows:
        labels = labels.where(draw <= (2 * rows << 64) // n - (1 << 63))
    return labels.orderBy(draw, key).limit(rows)


def collect_features(docs: DataFrame, chosen: DataFrame, features: Features, key: str, text: str,
                     presence: bool = False) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(label, slots, values)`` of the chosen documents, in a fixed order; ``chosen`` is bounded: ``(key, label)``.

    Of several rows with one key the text of smallest hash is taken, once, so that the bound holds for rows too.
    With ``presence`` all values are one and aren't sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tokens.slices(b.column(2)):
                n = len(s.begin)
                row, slot, value = features(s)
                offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, n), b.column(1).slice(s.first, n),
                     pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets * 0 if presence else offsets, pa.array(value.astype(np.float32)))], ["id", "label", "slots", "values"])

    kind = docs.schema[key].dataType.simpleString()
    chosen = chosen.select(F.col(key).alias("id"), F.col("label").cast("int").alias("label"))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    least = rows.join(F.broadcast(chosen.select("id").distinct()), "id").groupBy("id").agg(F.min("hash").alias("hash"))
    one = rows.join(F.broadcast(least), ["id", "hash"]).groupBy("id").agg(F.first("text").alias("text"))
    return _ordered(one.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(
        run, f"id {kind}, label int, slots array<int>, values array<float>").toArrow())


def _ordered(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows in the order of their keys; slots and values are views into the table's own memory."""
    ids, labels = table.column(0).to_pylist(), table.column(1).to_pylist()
    slots, values = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(2), table.column(3)))
    (s, s_at), (v, v_at) = ((np.asarray(c.values), np.asarray(c.offsets)) for c in (slots, values))
    del table  # the driver holds one copy of the slots
    order = sorted(range(len(ids)), key=lambda i: (ids[i], s_at[i + 1] - s_at[i], labels[i]))
    return [(labels[i], s[s_at[i] : s_at[i + 1]], v[v_at[i] : v_at[i + 1]]) for i in order]


def scores(docs: DataFrame, weights: np.ndarray, bias: float, features: Features, key: str, text: str) -> DataFrame:
    """``(key, score)``: the logistic function of each text's sparse dot product; weights have a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            for s in tokens.slices(b.column(1)):
                n = len(s.begin)
                row, slot, value = features(s)
                z = bias + np.bincount(row, weights=w[slot].astype(np.float64) * value, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, n), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(key), "score")


def judged(scored: DataFrame, held_out: Column, threshold: float, key: str) -> DataFrame:
    return scored.select(key, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
