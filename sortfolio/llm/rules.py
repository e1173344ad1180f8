"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``features`` and ``verdict`` are plain column expressions over one text column, so a table keeps its
columns, partitioning and row order; nothing is shuffled.

Defined cases: a null or blank text has no words and all counts 0, and fails the base rule; repeated
rows are judged one by one; an empty table stays empty; other columns are passed through, and a
clashing name (``n_words`` in the input, for instance) is replaced by the computed one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of the languages served (fixed values).
STOP_WORDS = (
    "the of and to in a is it that on for with as was be by are this an or from at not have "
    "de la le les et des en un une du que qui dans pour par est sur au avec ne pas il "
    "der die das und den von zu mit sich ist im dem ein eine auf als auch es an nicht für "
    "el los las y del se con una por su para lo al es"
).split()

#: name, measure, lowest and highest value that a kept text may have (None: no bound).
THRESHOLDS = (
    ("too_many_symbols", "symbol_ratio", None, 0.3),
    ("too_few_letters", "letter_ratio", 0.5, None),
    ("shouting", "upper_ratio", None, 0.5),
    ("word_length", "mean_word_chars", 1.5, 20.0),
    ("no_stop_words", "has_stop_word", 1, None),
    ("bars", "bar_ratio", None, 0.2),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("bullets", "bullet_line_ratio", None, 0.9),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more.

    Windows are hashed; part of the hash and the place are packed into one number, so that one sort of
    numbers brings equal windows together. Only those neighbours are then compared by their whole hash.
    """
    place_bits = 24

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def candidates(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, place_bits).bitwiseOR(i.cast("bigint"))))
        near = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), place_bits) == 0
        found = let(packed, lambda s: F.transform(
            F.filter(s, lambda x, k: near(x, F.get(s, k + 1)) | near(x, F.get(s, k - 1))),
            lambda x: x.bitwiseAND(F.lit((1 << place_bits) - 1)).cast("int")))
        return F.when(F.size(h) <= 1 << place_bits, found).otherwise(F.sequence(F.lit(0), F.size(h) - 1))

    def places(h: Column) -> Column:
        found = let(candidates(h), lambda c: F.sort_array(
            F.transform(c, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))))
        same = lambda x, y: x["h"] == y["h"]
        return let(found, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1))), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(
        let(hashed(words), lambda h: let(places(h), covered)))


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _count(text: Column, others: str) -> Column:
    """Characters that the class ``others`` does not hold."""
    return F.length(F.regexp_replace(text, others, "")).cast("bigint")


def features(text: Column) -> Column:
    """Struct of the base counts and of the measures that ``THRESHOLDS`` names."""
    text = F.coalesce(text, F.lit(""))
    stop = [x for w in dict.fromkeys(STOP_WORDS) for x in (w, w.capitalize())]

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.arrays_overlap(w, F.array(*[F.lit(x) for x in stop])).cast("int").alias("has_stop_word"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"^\s*[-*•]"))).cast("bigint").alias("n_bullets"))

    def of_chars(symbols: Column) -> Column:
        return F.struct(F.length(symbols).cast("bigint").alias("n_symbols"),
                        _count(symbols, r"[^|]+").alias("n_bars"),
                        _count(text, r"\P{Lu}+").alias("n_upper"), _count(text, r"\P{L}+").alias("n_letters"))

    def measures(w: Column, x: Column, c: Column) -> Column:
        ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
        symbols, upper, letters = c["n_symbols"], c["n_upper"], c["n_letters"]
        return F.struct(
            w["n_words"], w["word_chars"], symbols, x["n_dup_lines"], w["n_repeat_words"],
            ratio(symbols, w["n_words"]).alias("symbol_ratio"), ratio(letters, w["word_chars"]).alias("letter_ratio"),
            ratio(upper, letters).alias("upper_ratio"), ratio(w["word_chars"], w["n_words"]).alias("mean_word_chars"),
            w["has_stop_word"], ratio(c["n_bars"], w["n_words"]).alias("bar_ratio"),
            ratio(x["n_dup_lines"], x["n_lines"]).alias("dup_line_ratio"), ratio(x["n_bullets"], x["n_lines"]).alias("bullet_line_ratio"))

    chars = let(F.regexp_replace(text, r"[^#*$%&|<>]+", ""), of_chars)
    return let(let(_words(text), of_words), lambda a: let(let(_lines(text), of_lines), lambda b: let(
        chars, lambda c: measures(a, b, c))))


def failed_rules(measures: Column, thresholds=THRESHOLDS) -> Column:
    """Names of the rules that the measures break, in the table's order."""
    breaks = []
    for name, measure, low, high in thresholds:
        value, bad = measures[measure], F.lit(False)
        if low is not None:
            bad = bad | (value < low)
        if high is not None:
            bad = bad | (value > high)
        breaks.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*breaks))


def quality_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS, least_words: int = 50,
                  most_repeated: float = 0.5) -> DataFrame:
    """``docs`` with the base counts, ``failed_rules``, ``base_failed`` and ``kept``.

    A text fails the base rule with fewer than ``least_words`` words or with more than the share
    ``most_repeated`` of its words in repeated 3-word windows.
    """
    m = F.col("__m")
    # all columns hang on one struct, which the scan's projection computes once
    judged = docs.withColumn("__m", F.explode(F.array(let(
        features(F.col(text)), lambda x: F.struct(x.alias("m"), failed_rules(x, thresholds).alias("failed"))))))
    out = judged.withColumns({name: m["m"][name] for name in BASE} | {"failed_rules": m["failed"]})
    out = out.withColumn("base_failed", (F.col("n_words") < least_words)
                         | (F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__m")
