"""SimHash near-duplicate classes by the generalised pigeonhole principle.

1. ``fingerprints``: each text's majority bits over the XXH64 of its word shingles.
2. Equal fingerprints are one class at once; all later steps see each fingerprint once.
3. ``partition_bits``: bits that vote alike (large correlation over all fingerprints) share a partition.
4. Thresholds: with ``m`` partitions and radius ``r`` two fingerprints within ``r`` bits agree within
   ``t_i`` bits in some partition ``i`` whenever ``sum(t_i + 1) = r + 1``. For each fingerprint the
   ``t_i`` are allocated by dynamic programming over its estimated candidate counts, which come from
   a table of fixed size (``HIST_BITS``) of hashed partition values.
5. Probe and verify: a fingerprint probes the partition values within ``t_i`` bits of its own; the
   join's condition compares whole fingerprints, so only true links leave it.
6. A crowded value (more than ``CROWD`` fingerprints, as in a large group of near copies) isn't
   probed pair by pair. All fingerprints at it, and those that probe it, go to an exact linear way:
   each is written at every fingerprint within ``r / 2`` bits of it, and those that meet are linked.
   For an even ``r`` two fingerprints meet exactly if they differ in at most ``r`` bits.

Defined cases: null and blank texts have no words and fingerprint zero, linked like any other;
repeated rows and equal texts share a class; an empty table gives an empty result; only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortfolio.llm.graph import components
from sortfolio.llm.storage import land
from sortfolio.llm.tokens import mix

PARTITIONS = 3
HIST_BITS = 16
CROWD = 256
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, size: int) -> int:
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    shingles = map(" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [" ".join(words)]
    n = max(1, len(words) - size + 1)
    votes, bits = np.zeros(64, np.int64), partial(xxhash.xxh64_intdigest, seed=42)
    hashes = np.fromiter(map(bits, shingles), np.uint64, n)
    for k in range(0, n, 1 << 14):
        votes += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)`` of each row; ``fp`` is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _bit_counts(prints: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints that have both bits set; the diagonal holds each bit's own count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            x = np.asarray(b.column(0), dtype=np.int64)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], ["k", "n"])

    rows = prints.select("fp").mapInArrow(run, "k bigint, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(4096)
    out[rows["k"]] = rows["n"]
    return out.reshape(64, 64)


def partition_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits by partition: each partition starts with the most lopsided free bit and takes the free bits most correlated with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(64)), []
    for i in range(parts):
        width = 64 * (i + 1) // parts - 64 * i // parts
        part = [min(free, key=lambda b: (spread[b], b))]
        free -= {part[0]}
        while len(part) < width:
            best = max(free, key=lambda b: (tie[b, part].mean(), -b))
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def _masks(bits: list[int], flips: int) -> np.ndarray:
    """All ways to flip up to ``flips`` of the bits, fewest flips first."""
    return np.array([sum(1 << b for b in c) for f in range(flips + 1) for c in combinations(bits, f)], np.uint64)


def _slot(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(64 - HIST_BITS)).astype(np.int64)


def allocate(costs: np.ndarray, units: int) -> np.ndarray:
    """Thresholds ``t_i`` of least total cost with ``sum(t_i + 1) = units``.

    ``costs[i, u]`` holds, for every fingerprint, partition ``i``'s cost at ``u`` units (``t_i = u - 1``; 0 units are free).
    Returns the units by partition and fingerprint.
    """
    parts, _, n = costs.shape
    best = np.full((units + 1, n), np.inf)
    best[0] = 0
    chosen = []
    for i in range(parts):
        options = np.stack([[best[u - v] + costs[i, v] if v <= u else np.full(n, np.inf) for v in range(units + 1)]
                            for u in range(units + 1)])  # total units, own units, fingerprint
        chosen.append(options.argmin(axis=1))
        best = options.min(axis=1)
    out, left = np.zeros((parts, n), np.int64), np.full(n, units)
    for i in reversed(range(parts)):
        out[i] = chosen[i][left, np.arange(n)]
        left = left - out[i]
    return out


def _counted(prints: DataFrame, masks: np.ndarray) -> np.ndarray:
    """How many fingerprints have a value in each slot, by partition: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(masks), 1 << HIST_BITS), np.int64)
        for b in batches:
            x = np.asarray(b.column(0), dtype=np.int64).view(np.uint64)
            for i, m in enumerate(masks):
                total[i] += np.bincount(_slot(x & m), minlength=1 << HIST_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["k", "n"])

    rows = prints.select("fp").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(masks) << HIST_BITS, np.int64)
    out[rows["k"]] = rows["n"]
    return out.reshape(len(masks), -1)


def _probes(prints: DataFrame, parts: list[list[int]], counts: np.ndarray, radius: int) -> DataFrame:
    """``(part, value, fp)``: the partition values that each fingerprint must look up."""
    masks = [np.uint64(sum(1 << b for b in p)) for p in parts]
    flips = [_masks(p, radius) for p in parts]
    ends = [np.searchsorted(np.bitwise_count(f), np.arange(radius + 1), side="right") for f in flips]
    sent = prints.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            whole = np.asarray(b.column(0), dtype=np.int64).view(np.uint64)
            for x in np.array_split(whole, max(1, len(whole) >> 12)):
                costs = np.zeros((len(parts), radius + 2, len(x)))
                for i, m in enumerate(masks):
                    at, known = x & m, np.zeros(len(x))
                    for t in range(radius + 1):
                        new = flips[i][ends[i][t - 1] if t else 0 : ends[i][t]]
                        if t < 2:  # estimated from the table; further out by the number of values alone
                            known = known + table[i][_slot(at[:, None] ^ new)].sum(1)
                        else:
                            known = known + len(new) * table[i].mean()
                        costs[i, t + 1] = known + 2.0 * ends[i][t]
                units = allocate(costs, radius + 1)
                for i, m in enumerate(masks):
                    for u in range(1, radius + 2):
                        own = x[units[i] == u]
                        if len(own):
                            values = ((own & m)[:, None] ^ flips[i][: ends[i][u - 1]]).ravel()
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(values), i, np.int32)), pa.array(values.view(np.int64)),
                                 pa.array(np.repeat(own, ends[i][u - 1]).view(np.int64))], ["part", "value", "fp"])

    return prints.select("fp").mapInArrow(run, "part int, value bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _meeting(prints: DataFrame, radius: int) -> DataFrame:
    """Links of the exact linear way: fingerprints that share a point within ``radius / 2`` bits of each."""
    near = _masks(list(range(64)), radius // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = np.asarray(b.column(0), dtype=np.int64).view(np.uint64)
            for x in np.array_split(whole, max(1, len(whole) * len(near) >> 18)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((x[:, None] ^ near).ravel().view(np.int64)), pa.array(np.repeat(x, len(near)).view(np.int64))], ["at", "fp"])

    points = land(prints.mapInArrow(run, "at bigint, fp bigint"), "points")
    least = land(points.groupBy("at").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1"), "meeting")
    return points.join(least, "at").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v")).distinct()


def links(prints: DataFrame, radius: int, parts: int = PARTITIONS, crowd: int = CROWD) -> DataFrame:
    """Links ``(u, v)`` that connect all fingerprints of the landed column ``fp`` (distinct) within ``radius`` bits."""
    if radius % 2:
        raise ValueError("the radius must be even")
    n = prints.count()
    chosen = partition_bits(_bit_counts(prints), n, parts)
    masks = [sum(1 << b for b in p) for p in chosen]
    counts = _counted(prints, np.array(masks, np.uint64))
    values = land(prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks]))
                                .alias("part", "value")), "values")
    probes = land(_probes(prints, chosen, counts, radius), "probes")
    crowded = land(values.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowd).drop("n"), "crowded")
    at = ["part", "value"]
    there = F.broadcast(crowded) if crowded.count() <= 1 << 14 else crowded  # by the rows counted, at most 400 kB
    quiet = values.join(there, at, "left_anti")
    distance = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    found = (probes.alias("a").join(quiet.alias("b"), (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value"))
                                    & (F.col("a.fp") < F.col("b.fp")) & (distance <= radius))
             .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")))
    hot = values.join(there, at, "left_semi").select("fp").unionByName(probes.join(there, at, "left_semi").select("fp"))
    return land(found, "found").unionByName(land(_meeting(land(hot.distinct(), "hot"), radius), "met"))


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint, component_id, class_size)`` per row of ``docs``; component: smallest key reachable over links
    of at most ``radius`` differing bits (even)."""
    rows = land(fingerprints(docs, shingle, key, text), "fingerprints")
    prints = land(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "prints")
    member = land(components(links(prints.select("fp"), radius)), "components")
    grouped = land(prints.join(member, prints["fp"] == member["node"], "left")
                   .select("fp", "first", "n", F.coalesce("component", "fp").alias("component")), "grouped")
    named = land(grouped.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("n").alias("class_size")), "named")
    classes = land(grouped.select("fp", "component").join(named, "component").drop("component"), "classes")
    return rows.join(classes, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")
