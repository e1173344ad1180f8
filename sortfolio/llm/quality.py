"""Quality by hashed word n-grams and logistic regression with follow-the-regularised-leader updates.

A text is cut into words and runs of symbols. Features: each of them (lower-cased in A-Z), pairs of neighbours, and runs of up to
three shapes (lower, capital, upper, digits, symbols), each hashed to one of ``2 ** linear.BITS`` slots; a word that repeats the one
before it has a shape of its own. A feature's value is the root of its share of the text's features, so every text has length one.
Weights are updated text by text (FTRL-Proximal with L1 and L2 terms); scores are sparse dot products.

At most ``TRAINING_ROWS`` labelled texts, chosen by a hash of the key, are learnt from on the driver.

Defined cases: null and blank texts have no features and get the bias' score; repeated rows get equal scores; without any label
all scores are 0.5; an empty table stays empty; a null key is scored and is never learnt from; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.llm import linear, tokens

TRAINING_ROWS = 12000
THRESHOLD = 0.3
SYMBOL = tokens.NOT_SPACE & ~tokens.ALNUM


def features(s: tokens.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, y = tokens.words(s, tokens.ALNUM), tokens.words(s, SYMBOL)
    if not len(w.start) + len(y.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    start = np.concatenate([w.start, y.start])
    order = np.argsort(start, kind="stable")
    h = np.concatenate([w.hash, y.hash])[order]
    row = np.concatenate([w.row, y.row])[order]
    shape = np.full(len(start), 5, np.int64)
    if len(w.start):
        data = s.data
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        size, ups = w.stop - w.start, upper[w.stop] - upper[w.start]
        kind = np.where((ups > 0) & (ups * 2 <= size), 2, 1)
        kind = np.where((ups * 2 > size) & (size > 1), 3, kind)
        shape[: len(w.start)] = np.where((digit[w.stop] - digit[w.start]) * 2 > size, 4, kind)
    shape = shape[order]
    shape[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])] = 6
    marks = tokens.mix(shape.astype(np.uint64) + np.uint64(1 << 40))
    rows, slots = [row], [linear.slots(h)]
    for base, n in ((h, 2), (marks, 1), (marks, 2), (marks, 3)):
        grams = tokens.ngrams(base, n)
        inside = row[: len(grams)] == row[n - 1 :]
        rows.append(row[: len(grams)][inside])
        slots.append(linear.slots(grams[inside]))
    row, slot, n = linear.counted(np.concatenate(rows), np.concatenate(slots))
    total = np.bincount(row, weights=n)
    return row, slot, np.sqrt(n / total[row])


def fit_ftrl(texts: list[tuple[int, np.ndarray, np.ndarray]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
             passes: int = 2) -> tuple[np.ndarray, float]:
    """Weights by slot and bias; each text is ``(label, distinct slots, values)`` and updates the model by itself."""
    z, n = np.zeros((1 << linear.BITS) + 1), np.zeros((1 << linear.BITS) + 1)
    bias = 1 << linear.BITS

    def weight(at: np.ndarray) -> np.ndarray:
        strong = np.abs(z[at]) > l1
        return np.where(strong, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(len(texts)):
            y, at, x = texts[i]
            at, x = np.append(at, bias), np.append(x, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    every = weight(np.arange(bias + 1))
    return every[:bias], float(every[bias])


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> tuple[np.ndarray, float]:
    known = labels.select(key, F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & learn).distinct()
    return fit_ftrl(linear.collect_features(docs, linear.sample(known, TRAINING_ROWS), features, key, text))


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, key: str = "doc_id", text: str = "text",
            label: str = "quality") -> DataFrame:
    """``(key, held_out, score, predicted)``; labels of the rows with ``crc32(key) mod parts = held`` are never read."""
    part = linear.part_of(key, parts)
    weights, bias = train(docs, labels, (part != held) & (part >= 0), key, text, label)
    return linear.judged(linear.scores(docs, weights, bias, features, key, text), part == held, THRESHOLD, key)
