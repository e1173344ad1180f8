"""Phrase collocations: contiguous words that come together more often than their parts do apart.

Texts are lower-cased in A-Z and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those at blanks and tabs into words. Counts are per
language; ``score`` of a cut into two parts is ``floor(1000000 a a / (l r))`` with the counts of phrase and parts, and the lowest cut counts.

1. ``shards``: tasks count the n-grams of some MB of text at a time and build an automaton of them (``automata``), cut at bounds into
   prefix ranges. Bounds come from a bounded sample of n-grams; they balance the ranges and change no result.
2. ``unions``: a range's automata are united, which sums the counts; n-grams of ``least`` or more stay.
3. ``looked_up``: each range asks other ranges for the parts of its phrases, by an automaton of the distinct parts; that is composed
   with the range's counts, and the answer goes back. A part that many phrases share is asked once by each range. Parts carry the largest count of
   a longer phrase around them, so that the range of a phrase learns of it there.
4. ``phrases``: scores in whole numbers, then the first ``top`` of each language.

An n-gram that occurs everywhere is one arc of each shard's automaton, so no task gets its occurrences.

Defined cases: null and empty texts have no words; a null language is ``und``, together with rows whose language is that; repeated rows count again;
equal scores are ordered by count and then by phrase; an empty table gives an empty result; of the input only the text
and the language are read, so other columns can't clash. A text is handled whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sortfolio.llm import automata, tokens
from sortfolio.llm.automata import Depth, Paths
from sortfolio.llm.storage import land

LEAST, TOP, SHARE = 10, 2000, 50
#: text that one automaton of a shard counts, and text and frequent n-grams per prefix range
SHARD_BYTES, RANGE_BYTES, RANGE_GRAMS = 1 << 23, 1 << 22, 1 << 18
#: at most so many ranges; texts, and n-grams of each, in the sample that bounds are taken from
RANGES, SAMPLE_TEXTS, SAMPLE_GRAMS = 1 << 16, 1 << 12, 1 << 5
#: automata that a task holds before it unites them
HELD_BYTES = 1 << 23
BATCH_BYTES = 1 << 22
MILLION = 1_000_000
_SHARDS = [pa.field("range", pa.int32()), pa.field("automaton", pa.binary())]
_ALL = np.arange(256)
_MARK = np.isin(_ALL, np.frombuffer(b".,;:!?\n\v\f\r", np.uint8))
_WORD = ~_MARK & (_ALL != 32) & (_ALL != 9)


def _grams(s: tokens.Slice, lang: pa.Array, longest: int) -> Paths:
    """The n-grams of a slice with their counts; the first word of a path is the language."""
    inside = _WORD[s.data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = s.begin < s.end
    opens[s.begin[full]] = inside[s.begin[full]]  # a word never runs over two rows
    closes[s.end[full] - 1] = inside[s.end[full] - 1]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(s.begin, start, side="right") - 1
    marks = np.concatenate([[0], np.cumsum(_MARK[s.data])])
    joined = np.zeros(len(start), bool)  # the word before is in the same piece
    joined[1:] = (row[1:] == row[:-1]) & (marks[start[1:]] == marks[stop[:-1]])
    offsets = np.concatenate([[0], np.cumsum(stop - start)])
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(tokens.LOWER[s.data[inside]].tobytes())])
    names = lang.cast(pa.large_binary())
    words, number = automata.ordered(pa.concat_arrays([found, names]))
    word, size = number[: len(start)], len(words)
    key, count, where = automata.summed(number[len(start) :][row], np.ones(len(row), np.int64))
    depths = [Depth(np.zeros(len(key), np.int64), key, np.zeros(len(key), np.int64))]
    first = np.arange(len(word))  # where the n-grams of the depth begin
    run = np.zeros(len(word), np.int64)  # words of the piece from there on
    last = np.concatenate([np.flatnonzero(~joined)[1:], [len(word)]]) if len(word) else np.zeros(0, np.int64)
    run = np.repeat(last, np.diff(np.concatenate([[0], last]))) - first if len(word) else run
    for k in range(longest):
        there = run[first] > k
        first, where = first[there], where[there]
        key, count, where = automata.summed(where * size + word[first + k], np.ones(len(first), np.int64))
        depths.append(Depth(key // size, key % size, count))
    return Paths(words, depths).compact()


def _bounds(docs: DataFrame, size: int, ranges: int, longest: int) -> list[tuple[bytes, ...]]:
    """About evenly spaced n-grams of the corpus, from ``SAMPLE_GRAMS`` n-grams of each of about ``SAMPLE_TEXTS`` texts; at most twice so many."""
    if ranges < 2 or not size:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tokens.slices(b.column(0), 1):
                p = _grams(s, b.column(1).slice(s.first, len(s.begin)), longest)
                n = len(p.depths[-1].word)
                at = np.unique(np.linspace(0, max(n - 1, 0), SAMPLE_GRAMS).astype(np.int64)[:n]) if n else np.zeros(0, np.int64)
                columns = [p.words.take(pa.array(c)) for c in p.word_of(longest, at)]
                yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) for c in columns], [f"w{k}" for k in range(longest + 1)])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) <= int(min(1.0, SAMPLE_TEXTS / size) * (1 << 20)))
    rows = some.mapInArrow(run, ", ".join(f"w{k} binary" for k in range(longest + 1))).distinct().limit(2 * SAMPLE_TEXTS * SAMPLE_GRAMS).collect()
    grams = sorted({tuple(bytes(w) for w in r) for r in rows})
    return sorted({grams[i] for i in np.linspace(0, len(grams), ranges + 1).astype(int)[1:-1]}) if grams else []


def shards(docs: DataFrame, bounds: list[tuple[bytes, ...]], longest: int, shard: int = SHARD_BYTES) -> DataFrame:
    """``(range, automaton)`` of the n-grams of every ``shard`` bytes of text."""
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for s in tokens.slices(b.column(0), shard // 4):
                held.append(_grams(s, b.column(1).slice(s.first, len(s.begin)), longest))
                size += len(s.data)
                if size >= shard:
                    yield from _batches(((r, automata.to_bytes(p)) for r, p in automata.union(held).split(sent.value)), _SHARDS)
                    held, size = [], 0
        if held:
            yield from _batches(((r, automata.to_bytes(p)) for r, p in automata.union(held).split(sent.value)), _SHARDS)

    return docs.mapInArrow(run, "range int, automaton binary")


def _batches(rows: Iterable[tuple], names: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """Rows with an automaton at their end, in batches of some MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), names)], schema=pa.schema(names))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), names)], schema=pa.schema(names))


def _by_range(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("range").sortWithinPartitions("range", *order)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows one by one, each with its range; a range's rows follow each other."""
    for b in batches:
        for k in range(b.num_rows):
            row = {name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names) if name != "totals"}
            yield row["range"], row


def unions(parts: DataFrame, least: int) -> DataFrame:
    """``(range, automaton, n, totals)`` of each range: n-grams of ``least`` or more, their number, and the words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def done() -> pa.RecordBatch:
            whole = automata.union(held)
            names = whole.words.take(pa.array(whole.depths[0].word)).to_pylist()
            totals = np.zeros(len(names), np.int64)
            np.add.at(totals, whole.depths[1].above, whole.depths[1].weight)
            kept = whole.kept([d.weight >= least for d in whole.depths])
            return pa.RecordBatch.from_pylist(
                [{"range": now, "automaton": automata.to_bytes(kept), "n": len(kept), "totals": [{"lang": a.decode(), "n": int(n)} for a, n in zip(names, totals)]}],
                pa.schema([("range", pa.int32()), ("automaton", pa.binary()), ("n", pa.int64()),
                           ("totals", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))]))

        for r, x in _runs(batches):
            if r != now:
                if held:
                    yield done()
                now, held, size = r, [], 0
            held.append(automata.from_bytes(x["automaton"]))
            size += len(x["automaton"])
            if size > HELD_BYTES:
                held, size = [automata.union(held)], 0
        if held:
            yield done()

    return _by_range(parts).mapInArrow(run, "range int, automaton binary, n bigint, totals array<struct<lang:string,n:bigint>>")


def _candidates(p: Paths, k: int, least: int) -> np.ndarray:
    """Phrases of ``k`` words; depth 0 of the paths is the language."""
    return np.flatnonzero(p.depths[k].weight >= max(least, 1))


def _parts(p: Paths, longest: int, least: int) -> Paths:
    """The distinct parts of the phrases of a range, as n-grams whose count is that of the most frequent longer phrase around them."""
    grams: list[tuple[list[np.ndarray], np.ndarray]] = []
    for k in range(2, longest + 1):
        at = _candidates(p, k, least)
        columns, a = p.word_of(k, at), p.depths[k].weight[at]
        for size in range(1, k):
            grams += [([columns[0], *columns[1 + s : 1 + s + size]], a) for s in range(k - size + 1)]
    size, depths, where, weight = max(len(p.words), 1), [], None, None
    where = [np.zeros(len(a), np.int64) for _, a in grams]
    for k in range(longest):  # the language, then parts of up to one word less than the longest phrase
        keys = [w * size + c[k] if k < len(c) else np.zeros(0, np.int64) for (c, _), w in zip(grams, where)]
        found, went = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
        pieces = np.split(went, np.cumsum([len(x) for x in keys])[:-1]) if keys else []
        where = [g if k < len(c) else w for (c, _), w, g in zip(grams, where, pieces)]
        weight = np.zeros(len(found), np.int64)
        for (c, a), g in zip(grams, pieces):
            if len(c) == k + 1:
                np.maximum.at(weight, g, a)
        depths.append(Depth(found // size, found % size, weight))
    return Paths(p.words, depths).compact()


_ROWS = "range int, kind int, source int, automaton binary"
_FIELDS = [pa.field("range", pa.int32()), pa.field("kind", pa.int32()), pa.field("source", pa.int32()), pa.field("automaton", pa.binary())]
_COUNTS, _ASKED, _AROUND = 0, 1, 2


def _asked(counts: DataFrame, bounds: list[tuple[bytes, ...]], longest: int, least: int) -> DataFrame:
    """The counts of each range, and what it asks of each other one."""
    sent = counts.sparkSession.sparkContext.broadcast(bounds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for r, held in _whole(batches):
            yield r, _COUNTS, r, automata.to_bytes(held)
            for to, p in _parts(held, longest, least).split(sent.value):
                yield to, _ASKED, r, automata.to_bytes(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), _FIELDS)

    return _by_range(counts).mapInArrow(run, _ROWS)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Paths]]:
    """Each range with the union of its automata."""
    now, held = None, []
    for r, x in _runs(batches):
        if r != now and held:
            yield now, automata.union(held)
            held = []
        now = r
        held.append(automata.from_bytes(x["automaton"]))
    if held:
        yield now, automata.union(held)


def _answered(asked: DataFrame, longest: int) -> DataFrame:
    """Counts of what each range asked, and for its own phrases the largest count of a longer one around them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, counts, around = None, None, []
        for r, x in _runs(batches):
            if r != now:
                if around:
                    yield now, _AROUND, now, automata.to_bytes(_largest(around))
                now, counts, around = r, None, []
            p = automata.from_bytes(x["automaton"])
            if x["kind"] == _COUNTS:
                counts = p
                continue
            found = automata.composed(p, counts) if counts is not None else [d.weight * 0 for d in p.depths]
            yield x["source"], _ASKED, now, automata.to_bytes(Paths(p.words, [Depth(d.above, d.word, n) for d, n in zip(p.depths, found)]))
            # a single word is a part but no phrase itself
            around.append(p.kept([(d.weight > 0) & (k > 1) for k, d in enumerate(p.depths)]))
            if len(around) > 64:
                around = [_largest(around)]
        if around:
            yield now, _AROUND, now, automata.to_bytes(_largest(around))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), _FIELDS)

    return _by_range(asked, "kind", "source").mapInArrow(run, _ROWS)


def _largest(parts: list[Paths]) -> Paths:
    """The n-grams of the parts, each with its largest count."""
    whole = automata.union(parts)
    depths = [Depth(d.above, d.word, d.weight * 0) for d in whole.depths]
    for p in parts:
        places = automata.composed(p, Paths(whole.words, [Depth(d.above, d.word, np.arange(len(d.word))) for d in whole.depths]))
        for d, at, mine in zip(depths, places, p.depths):
            np.maximum.at(d.weight, at, mine.weight)
    return Paths(whole.words, depths)


def score(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``floor(1000000 a a / (left right))`` exactly; in Python's whole numbers where 64 bits don't hold the products."""
    top = max(int(a.max(initial=0)), 1), max(int(left.max(initial=1)), 1) * max(int(right.max(initial=1)), 1)
    if MILLION * top[0] ** 2 < 1 << 63 and top[1] < 1 << 63:
        return MILLION * a * a // (left * right)
    return (MILLION * a.astype(object) ** 2 // (left.astype(object) * right.astype(object))).astype(np.int64)


_PHRASE = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"


def _scored(answers: DataFrame, longest: int, least: int, share: int) -> DataFrame:
    """Each phrase of a range with its lowest cut, without those that a longer phrase holds often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for r, x in _runs(batches):
            if r != now and held:
                yield from rows(held)
                held = {}
            now = r
            held.setdefault(x["kind"], []).append(automata.from_bytes(x["automaton"]))
        if held:
            yield from rows(held)

    def rows(held: dict[int, list[Paths]]) -> Iterator[pa.RecordBatch]:
        if _COUNTS not in held or _ASKED not in held:
            return
        p, parts = held[_COUNTS][0], automata.union(held[_ASKED])
        around = automata.union(held[_AROUND]) if _AROUND in held else None
        for k in range(2, longest + 1):
            at = _candidates(p, k, least)
            if not len(at):
                continue
            columns, a = p.word_of(k, at), p.depths[k].weight[at]
            of = lambda b, e: _counts_of(parts, p.words, [columns[0], *columns[1 + b : 1 + e]])  # noqa: E731,B023
            best = None
            for cut in range(1, k):
                left, right = of(0, cut), of(cut, k)
                value = score(a, left, right)
                if best is None:
                    best = [value, left, right]
                else:
                    best = [np.where(value < best[0], new, old) for new, old in zip((value, left, right), best)]
            keep = np.ones(len(at), bool)
            if around is not None and k < longest:
                keep = 100 * _counts_of(around, p.words, columns).astype(object) < share * a.astype(object)
                keep = keep.astype(bool)
            shown = [p.words.take(pa.array(c[keep])).to_pylist() for c in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in shown[0]], pa.string()), pa.array([b" ".join(g).decode() for g in zip(*shown[1:])], pa.string()),
                 *[pa.array(c[keep], pa.int64()) for c in (a, best[1], best[2], best[0])]], ["lang", "phrase", "a", "l", "r", "score"])

    return _by_range(answers, "kind", "source").mapInArrow(run, _PHRASE)


def _counts_of(p: Paths, words: pa.Array, columns: list[np.ndarray]) -> np.ndarray:
    """The count of each n-gram given by columns of numbers of ``words``; 0: not there."""
    new, size, above, out = automata.numbers(words, p.words), max(len(p.words), 1), np.zeros(len(columns[0]), np.int64), None
    for c, d in zip(columns, p.depths):
        keys, key = d.keys(size), above * size + new[c]
        at = np.searchsorted(keys, key)
        there = (above >= 0) & (new[c] >= 0) & (at < len(keys))
        there[there] = keys[at[there]] == key[there]
        above = np.where(there, at, -1)
        out = np.where(there, d.weight[np.where(there, at, 0)] if len(d.weight) else 0, 0)
    return out


def _first(rows: DataFrame, top: int, n: int) -> DataFrame:
    """The first rows of each language, found among each of several parts of it before the whole."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = max(1, int((n / top) ** 0.5))
    if parts > 1:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        rows = (rows.withColumn("part", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
                .where(F.col("rank") <= top).drop("part", "rank"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = LEAST, top: int = TOP, share: int = SHARE,
            range_bytes: int = RANGE_BYTES, range_grams: int = RANGE_GRAMS, shard: int = SHARD_BYTES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the first ``top`` phrases of 2 to ``longest`` words of each language.

    Dropped are phrases inside a longer one that has at least ``share`` percent of their count.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    whole = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = min(RANGES, -(-(whole["bytes"] or 0) // range_bytes))
    bounds = _bounds(rows, whole["n"], ranges, longest)
    counts = land(unions(shards(rows, bounds, longest, shard), least), "counts")
    kept = counts.agg(F.sum("n")).first()[0] or 0
    step = max(1, -(-(len(bounds) + 1) // max(1, -(-kept // range_grams))))  # ranges that follow each other are looked up as one
    wide = bounds[step - 1 :: step]
    asked = land(_asked(counts.select((F.col("range") / step).cast("int").alias("range"), "automaton"), wide, longest, least), "asked")
    answers = land(_answered(asked, longest), "answers")
    found = land(_scored(asked.where(F.col("kind") == _COUNTS).unionByName(answers), longest, least, share), "scored")
    totals = counts.select(F.explode("totals").alias("t")).groupBy(F.col("t.lang").alias("lang")).agg(F.sum("t.n").alias("n"))
    best = _first(found, top, found.count())
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
