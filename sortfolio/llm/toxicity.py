"""Toxicity by non-negative positive-unlabelled learning.

The classifier never sees a confirmed clean text. It learns from confirmed toxic texts (``POSITIVES`` at most, by a hash of the
key) and from unlabelled texts (``UNLABELLED`` at most), which hold toxic ones at an unknown place but at a known rate, the class
prior. With ``R+(y)`` and ``Ru(y)`` the mean losses of toxic and unlabelled texts against label ``y``, the risk is
``prior * R+(1) + max(0, Ru(0) - prior * R+(0))``: the second term estimates the clean texts' risk without bias and is kept from
going below zero, where the fit would turn into learning texts by heart. Numpy on the driver fits it over bounded samples.

Features: presence of hashed words (lower-cased in A-Z) and of their beginnings of ``PREFIXES`` bytes, of those only that several
toxic texts share and that are at least ``lift`` times as common among them as among unlabelled texts.

Defined cases: null and blank texts have no words and get the bias' score; repeated rows get equal scores; without any toxic
example all scores are 0; an empty table stays empty; a null key is scored and is never learnt from; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.llm import linear, tokens

POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.3
PREFIXES = range(4, 10)


def features(s: tokens.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = tokens.words(s, tokens.ALNUM)
    row, size = w.row, w.stop - w.start
    rows, slots, data = [row], [linear.slots(w.hash)], tokens.LOWER[s.data]
    for n in PREFIXES:
        long = size > n
        rows.append(row[long])
        slots.append(linear.slots(tokens.mix(tokens.hashed(data, w.start[long], w.start[long] + n))))
    row, slot, _ = linear.counted(np.concatenate(rows), np.concatenate(slots))
    return row, slot, np.ones(len(row))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least_texts: int = 6, lift: float = 1.3,
             steps: int = 400, rate: float = 0.1, l1: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights by slot and bias; each text is its array of distinct slots."""
    weights = np.zeros(1 << linear.BITS)
    if not positive:
        return weights, -30.0
    seen, among = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
    for total, texts in ((seen, positive), (among, unlabelled)):  # text by text: all slots in one array would be far larger
        for t in texts:
            total[t] += 1
    lifted = seen * max(len(unlabelled), 1) >= lift * among * len(positive)
    used = np.flatnonzero((seen >= min(least_texts, len(positive))) & lifted)
    place = np.full(len(weights), -1, np.int32)
    place[used] = np.arange(len(used))

    def flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        kept = [place[t][place[t] >= 0] for t in texts]
        return np.repeat(np.arange(len(texts), dtype=np.int32), [len(k) for k in kept]), np.concatenate([*kept, np.zeros(0, np.int32)]), len(texts)

    sides = flat(positive), flat(unlabelled)
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = [b + np.bincount(r, weights=w[f], minlength=n) for r, f, n in sides]
        p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z]
        up, n_p, n_u = p[0], max(len(positive), 1), max(len(unlabelled), 1)
        clean = -np.log(np.maximum(1 - p[1], 1e-13)).sum() / n_u + prior * np.log(np.maximum(1 - up, 1e-13)).sum() / n_p
        # gradients by text: the toxic part pulls up; the clean part pulls down, or is undone where its risk is negative
        sign = 1.0 if clean >= 0 else -1.0
        of_p = prior * (up - 1) / n_p * (clean >= 0) - sign * prior * up / n_p
        of_u = sign * p[1] / n_u
        g = np.zeros(len(used) + 1)
        for (r, f, _), d in zip(sides, (of_p, of_u)):
            g[:-1] += np.bincount(f, weights=d[r], minlength=len(used))
            g[-1] += d.sum()
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1 * 10)
    weights[used] = w
    # no more unlabelled texts than the class prior says should be called toxic: lower the bias until it is so
    z, low, high = np.bincount(sides[1][0], weights=w[sides[1][1]], minlength=sides[1][2]), -60.0, float(b)
    for _ in range(60 if len(unlabelled) else 0):
        b = (low + high) / 2
        low, high = (b, high) if (1 / (1 + np.exp(-np.clip(z + b, -30, 30)))).mean() < prior else (low, b)
    return weights, float(b)


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> tuple[np.ndarray, float]:
    """Fit on rows for which ``learn`` holds; labelled rows give the toxic examples and the class prior."""
    known = labels.select(key, F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & learn)
    n, toxic = known.agg(F.count("*"), F.sum("label")).first()
    prior = min(0.9, max(0.01, (toxic or 0) / max(n, 1)))
    positive = linear.sample(known.where("label = 1").select(key, "label").distinct(), POSITIVES)
    # texts that are among the toxic examples may be drawn as unlabelled ones too: unlabelled means any text
    drawn = linear.sample(docs.where(learn).select(key, F.lit(0).alias("label")).distinct(), UNLABELLED)
    rows = linear.collect_features(docs, positive.unionByName(drawn), features, key, text, presence=True)
    return fit_nnpu([s for y, s, _ in rows if y == 1], [s for y, s, _ in rows if y == 0], prior)


def fitted(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, key: str = "doc_id", text: str = "text",
           label: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights and bias; labels of the rows with ``crc32(key) mod parts = held`` are never read."""
    part = linear.part_of(key, parts)
    return train(docs, labels, (part != held) & (part >= 0), key, text, label)


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, key: str = "doc_id", text: str = "text",
             label: str = "toxic") -> DataFrame:
    """``(key, held_out, score, predicted)``; labels of the rows with ``crc32(key) mod parts = held`` are never read."""
    weights, bias = fitted(docs, labels, parts, held, key, text, label)
    part = linear.part_of(key, parts)
    return linear.judged(linear.scores(docs, weights, bias, features, key, text), part == held, THRESHOLD, key)
