"""Benchmark decontamination as a prefix-filtered set join with exact containment over item-sized windows.

An item's windows are its runs of ``window`` consecutive words (the whole item if it has fewer, but any). A window is the set of
its shingles of ``shingle`` words, each at its place.

1. One scan of the documents keeps runs of consecutive words all of whose shingles may belong to some window, and counts words.
   "May" is a bit table of fixed size (``FILTER_BITS``) over the hashes of all window shingles: its size doesn't grow with the
   benchmark, and a false hit only costs time. The length bound drops runs too short to hold a window.
2. Shingles are ordered by rarity over all kept runs. Containment needs every shingle, so the prefix of a window is its rarest
   shingle alone: runs and windows meet on the words of that shingle, not on a hash.
3. The positional bound: the shingle's place in the window gives the only place where the window can start; it must lie in the run.
4. Exact verification compares the run's words with the window's.

Defined cases: null and blank texts have no words, hits or items; an item without words has no window; an item shorter than the
window is one window; equal windows of several items count for each item, equal item rows once; repeated documents are judged row
by row; an empty benchmark or document table gives no hits or no rows; other columns than id and text are ignored, so names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortfolio.llm import tokens
from sortfolio.llm.storage import land

WINDOW, SHINGLE = 10, 4
FILTER_BITS = 23
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_windows(items: DataFrame, window: int, shingle: int, key: str, text: str) -> DataFrame:
    """``(item_id, words, size, k)``: each window once per item; ``k`` is the size of its shingles."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    whole = items.select(F.col(key).cast("string").alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    start = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("s")
    return whole.select("item_id", "w", size.alias("size"), start).select(
        "item_id", F.array_join(F.slice("w", F.col("s"), F.col("size")), " ").alias("words"), "size",
        F.least(F.col("size"), F.lit(shingle)).alias("k")).distinct()


def _shingles(words: str, k: str) -> str:
    """SQL: the shingles of ``k`` words of an array of words, joined."""
    return f"transform(sequence(1, size({words}) - {k} + 1), i -> array_join(slice({words}, i, {k}), ' '))"


def bit_table(shingles: DataFrame) -> bytes:
    """Bits at the hashes of all shingles of the column ``shingle``; a few tables of fixed size are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            for s in tokens.slices(b.column(0)):
                w = tokens.words(s, tokens.ALNUM)
                for n in np.unique(w.per_row):
                    if n:
                        first = w.first[:-1][w.per_row == n]
                        grams = tokens.ngrams(w.hash, int(n))
                        bits[(grams[first] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in shingles.select("shingle").coalesce(8).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def _row_runs(grams_in: np.ndarray, first: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of runs of at least ``least`` possible shingles of ``k`` words, within rows."""
    count = len(grams_in)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row_end = np.repeat(first[1:], np.diff(first))[:count]
    hit = grams_in & (np.arange(count) + k <= row_end)
    opens, closes = hit.copy(), hit.copy()
    opens[1:] &= ~hit[:-1]
    closes[:-1] &= ~hit[1:]
    at = first[:-1][first[:-1] < count]
    opens[at] = hit[at]
    ends = at[at > 0] - 1
    closes[ends] = hit[ends]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - begin >= least
    return begin[long], end[long] + k - 1


def possible_runs(docs: DataFrame, shapes: list[tuple[int, int]], bits: bytes, key: str, text: str) -> DataFrame:
    """``(key, n_words, runs)`` per document; a run is ``(start, k, words)``. ``shapes``: each window size with its shingle size."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    least = {k: min(size - k + 1 for size, kk in shapes if kk == k) for _, k in shapes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for b in batches:
            for s in tokens.slices(b.column(1)):
                w = tokens.words(s, tokens.ALNUM)
                rows = len(s.begin)
                found: list[list[dict]] = [[] for _ in range(rows)]
                for k in sorted(least):
                    grams = tokens.ngrams(w.hash, k)
                    begin, end = _row_runs(table[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)], w.first, k, least[k])
                    row = np.searchsorted(w.first, begin, side="right") - 1
                    for r, x, y in zip(row.tolist(), begin.tolist(), end.tolist()):
                        words = [tokens.LOWER[s.data[i:j]].tobytes().decode() for i, j in zip(w.start[x:y], w.stop[x:y])]
                        found[r].append({"start": x - int(w.first[r]), "k": k, "words": words})
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, rows), pa.array(w.per_row, pa.int64()), pa.array(found, _RUNS)], ["id", "n_words", "runs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n_words bigint, runs array<struct<start:bigint,k:int,words:array<string>>>")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("k", pa.int32()), ("words", pa.list_(pa.string()))]))


def matches(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(row, start, size, words)`` of every occurrence of a window in the landed runs ``(row, start, k, words)``."""
    hits = land(runs.selectExpr("row", "start", "k", "words AS run", f"posexplode({_shingles('words', 'k')}) AS (place, shingle)"), "hits")
    seen = hits.groupBy("k", "shingle").agg(F.count("*").alias("n"))
    parts = land(windows.select("words", "size", "k").distinct().withColumn("w", F.split("words", " ")).selectExpr(
        "words", "size", "k", f"posexplode({_shingles('w', 'k')}) AS (place, shingle)"), "window_shingles")
    rarity = parts.join(land(seen, "seen"), ["k", "shingle"], "left").select("words", "size", "k", "place", "shingle", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = land(rarity.groupBy("words", "size", "k").agg(F.min(F.struct("n", "place", "shingle")).alias("p"))
                  .where("p.n > 0").select("words", "size", "k", F.col("p.place").alias("offset"), F.col("p.shingle").alias("shingle")), "prefix")
    start = F.col("place") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.size("run"))
    return (hits.join(prefix, ["k", "shingle"]).where(inside)
            .where(F.array_join(F.slice("run", start + 1, F.col("size")), " ") == F.col("words"))
            .select("row", (F.col("start") + start).alias("start"), "size", "words"))


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: str = "doc_id",
                       text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, n_words, n_hit, n_items, items_sha256, contaminated)`` per row of ``docs``."""
    windows = land(item_windows(items, window, shingle, item_key, item_text), "windows")
    shapes = [(r["size"], r["k"]) for r in windows.select("size", "k").distinct().collect()]  # at most ``window`` rows
    bits = bit_table(windows.withColumn("w", F.split("words", " ")).selectExpr(f"explode({_shingles('w', 'k')}) AS shingle").distinct())
    scanned = land(possible_runs(docs, shapes, bits, key, text).withColumn("row", F.monotonically_increasing_id()), "scanned")
    runs = scanned.where(F.size("runs") > 0).select("row", F.explode("runs").alias("r")).select("row", "r.*")
    found = land(matches(runs, windows), "matches")

    def covered(spans):
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
        return F.aggregate(spans, zero, lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"),
            F.greatest(a["end"], x["start"] + x["size"]).alias("end")), lambda a: a["n"])

    spans = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans")).select(
        "row", covered(F.col("spans")).alias("n_hit"))
    named = found.select("row", "words").distinct().join(windows.select("words", "item_id"), "words").groupBy("row").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    result = land(spans.join(named, "row"), "contaminated")
    zero = F.lit(0).cast("bigint")
    return scanned.select("row", "id", "n_words").join(result, "row", "left").select(
        F.col("id").alias(key), "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("items").cast("bigint"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same by comparing every window with every place; for tests."""
    import re

    def words(t: str | None) -> list[str]:
        return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    cut = {}
    for item, t in items:
        w = words(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            cut.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, t in docs:
        w, hit, named = words(t), set(), set()
        for size in {len(c) for c in cut}:
            for i in range(len(w) - size + 1):
                if (ids := cut.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    named |= ids
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out
