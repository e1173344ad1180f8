"""Whitening directions of embeddings, from blockwise QR and a bidiagonal qd solver.

1. Vectors become whole numbers ``floor(256 c)``; each distinct vector counts once in the fit list.
2. Per-dimension sums are exact. Tasks centre their rows and reduce them, batch by batch, to one triangular matrix each by QR;
   the triangles are stacked and reduced in rounds of ``FAN`` until one is left, whose square is the list's scatter.
3. The driver solves that one matrix of dimension x dimension (``qd``): bidiagonal form, dqds, twisted factorisations.
4. All rows are projected, and the covariance of the projected fit list is held against the identity.

Defined cases: vectors that are null or hold a null or non-finite entry are dropped, and so are those of another length than most
(the longer of equally frequent lengths wins); equal vectors and repeated rows count once in the fit and are all projected; an empty
table gives an empty result; a component without variance (one distinct vector, dependent dimensions) has null ``whitened`` and
stays out of ``identity_error``, which is null if no component has any; ``deviation`` is null beyond 64 bits. Of the input only the
key and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortfolio.llm import qd
from sortfolio.llm.storage import land

SCALE = 256
COMPONENTS = 4
#: triangles that one task stacks; at most so many are sent to the driver
FAN = 16
_KINDS = ("<i2", "<i4", "<i8")


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the narrowest of the integer kinds that holds it, after the kind's number."""
    kind = np.zeros(len(x), np.int64)
    for k, t in enumerate(_KINDS[:-1]):
        kind[((x < np.iinfo(t).min) | (x > np.iinfo(t).max)).any(axis=1)] = k + 1
    out: list[bytes] = [b""] * len(x)
    for k, t in enumerate(_KINDS):
        for at in np.flatnonzero(kind == k):
            out[at] = bytes([k]) + x[at].astype(t).tobytes()
    return out


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    out = np.empty((len(column), size), np.int64)
    for i, b in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(b, _KINDS[b[0]], offset=1)
    return out


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, size, x)``: the packed whole numbers of each vector without null or non-finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            entry = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), float)
            size = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
            begin = np.cumsum(size) - size
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(entry))])
            good = np.asarray(lists.is_valid()) & (bad[begin + size] == bad[begin])
            x = np.floor(np.where(np.isfinite(entry), entry, 0) * SCALE).astype(np.int64)
            keep = np.flatnonzero(good)
            packed: list[bytes] = [b""] * len(keep)
            for n in np.unique(size[keep]):
                at = np.flatnonzero(size[keep] == n)
                rows = x[begin[keep[at]][:, None] + np.arange(n)]
                for i, p in zip(at, _packed(rows)):
                    packed[i] = p
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)), pa.array(size[keep].astype(np.int32)), pa.array(packed, pa.binary())], ["id", "size", "x"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInArrow(run, f"id {kind}, size int, x binary")


def exact_sums(fit: DataFrame, size: int) -> list[int]:
    """Sum of each dimension; halves of 32 bits are added so that no task overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            x = _unpacked(b.column(0), size)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(low), pa.array(high)], ["k", "low", "high"])

    parts = fit.select("x").mapInArrow(run, "k bigint, low bigint, high bigint").groupBy("k").agg(
        F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high")).collect()
    out = [0] * size
    for r in parts:
        out[r["k"]] = (int(r["high"]) << 32) + int(r["low"])
    return out


def triangle(fit: DataFrame, size: int, mean: np.ndarray, fan: int = FAN) -> np.ndarray:
    """``R`` with ``R'R`` the scatter of the centred rows."""

    def reduced(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for x in blocks:
            for at in range(0, len(x), 4096):
                r = np.linalg.qr(np.vstack([r, x[at : at + 4096]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduced(_unpacked(b.column(0), size) - mean for b in batches)

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduced(np.frombuffer(p).reshape(-1, size) for b in batches for p in b.column(0).to_pylist())

    parts = land(fit.select("x").mapInArrow(first, "r binary"), "triangles")
    while (n := parts.count()) > fan:
        parts = land(parts.repartition(-(-n // fan)).mapInArrow(stacked, "r binary"), "triangles")
    blocks = [np.frombuffer(r["r"]).reshape(-1, size) for r in parts.collect()]
    r = np.linalg.qr(np.vstack([*blocks, np.zeros((size, size))]), mode="r")
    return r[:size]


def _identity_error(fit: DataFrame, size: int, mean: np.ndarray, rows: np.ndarray, n: int) -> float | None:
    """Largest absolute entry of the projected list's covariance minus the identity."""
    m = len(rows)
    if not m:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for b in batches:
            y = (_unpacked(b.column(0), size) - mean) @ rows.T
            total += np.vstack([y.T @ y, y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    found = fit.select("x").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((m + 1) * m)
    for r in found:
        total[r["k"]] = r["v"]
    total = total.reshape(m + 1, m) / n
    return float(np.abs(total[:m] - np.outer(total[m], total[m]) - np.eye(m)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n x - S)^2)`` of each row, in whole numbers."""
    far = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, sums), default=0)
    if far * far * max(x.shape[1], 1) < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, fan: int = FAN) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` of each remaining row and leading component."""
    rows = land(whole_vectors(df, key, vector), "vectors")
    common = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    rows = rows.where(F.col("size") == size)
    fit = land(rows.select("x").distinct(), "distinct-vectors")
    n, sums = fit.count(), exact_sums(fit, size) if size else []
    mean = np.array([s / n for s in sums])
    r = triangle(fit, size, mean, fan) if size else np.zeros((0, 0))
    squares, directions = qd.leading(r, components) if size else (np.zeros(0), np.zeros((0, 0)))
    trace = float((r * r).sum())
    live = squares > size * qd.EPS * max(trace, 1e-300)
    scaled = np.where(live[:, None], directions * np.sqrt(n / np.where(live, squares, 1))[:, None], 0) if size else directions
    error = _identity_error(fit, size, mean, scaled[live], n) if size else None
    explained = np.where(live, squares / (trace or 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(scaled)
        for b in batches:
            x = _unpacked(b.column(1), size)
            y = (x - mean) @ scaled.T
            which = pa.array(np.repeat(np.arange(len(x)), m))
            number = np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(which), pa.array(number), pa.array(np.full(len(x) * m, n, np.int64)),
                 pa.array(_deviations(x, n, sums), pa.int64()).take(which), pa.array(y.ravel(), mask=np.tile(~live, len(x))),
                 pa.array(np.tile(explained, len(x))), pa.array([error] * (len(x) * m), pa.float64())],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = df.schema[key].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(
        run, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    ).withColumnRenamed("id", key)
