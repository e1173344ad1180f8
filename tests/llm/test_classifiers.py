from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortfolio.llm import linear, quality, toxicity
from tests.llm.conftest import documents


def held(i: int, parts: int, part: int) -> bool:
    return zlib.crc32(str(i).encode()) % parts == part


@pytest.fixture(scope="module")
def corpus(words):
    r, rows, labels = random.Random(4), [], []
    for i in range(400):
        w = r.choices(words, k=60)
        toxic, junk = i % 7 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["nastyword", "nastyworse", "vileterm"])
        rows.append((i, ("*** ".join(w) if junk else " ".join(w))))
        if i % 2 == 0:
            labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxic_texts_are_found_and_clean_ones_left(spark, corpus, odd):
    rows, labels = corpus
    got = {r.doc_id: r for r in toxicity.toxicity(documents(spark, rows + [(i + 1000 if i else i, t) for i, t in odd]), table(spark, labels)).collect()}
    out = [(got[i].predicted, i % 7 == 0) for i, _ in rows if got[i].held_out]
    assert all(got[i].held_out == held(i, 4, 2) for i, _ in rows) and not got[None].held_out
    assert np.mean([p for p, y in out if y]) > 0.9 and np.mean([p for p, y in out if not y]) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[1001].score == got[1002].score == got[1003].score


def test_held_out_labels_have_no_influence(spark, corpus):
    rows, labels = corpus
    docs = documents(spark, rows)
    turned = [(i, q, 1 - t if held(i, 4, 2) else t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, table(spark, x)).collect()} for x in (labels, turned))
    assert a == b


def test_quality_of_held_out_texts(spark, corpus, odd):
    rows, labels = corpus
    got = {r.doc_id: r for r in quality.quality(documents(spark, rows + [(i + 1000 if i else i, t) for i, t in odd]), table(spark, labels)).collect()}
    out = [(got[i].score, i % 5 != 0) for i, _ in rows if got[i].held_out]
    assert min(s for s, y in out if y) > max(s for s, y in out if not y)
    assert got[1001].score == got[1002].score == got[1003].score


def test_no_labels_and_empty_tables(spark, odd):
    none = table(spark, [])
    assert {r.score for r in quality.quality(documents(spark, odd), none).collect()} == {0.5}
    assert all(r.score < 1e-9 for r in toxicity.toxicity(documents(spark, odd), none).collect())
    assert quality.quality(documents(spark, []), none).collect() == toxicity.toxicity(documents(spark, []), none).collect() == []


def test_null_and_repeated_labels(spark, corpus):
    rows, labels = corpus
    more = labels + labels[:50] + [(None, 1, 1), (3, None, None), (99999, 1, 1)]
    a, b = ({r.doc_id: r.score for r in quality.quality(documents(spark, rows), table(spark, x)).collect()} for x in (labels, more))
    assert a == b


def test_the_risk_stays_non_negative_without_unlabelled_texts():
    w, b = toxicity.fit_nnpu([np.array([1, 2])] * 10, [], 0.1)
    assert np.isfinite(w).all() and np.isfinite(b)
    assert len(w) == 1 << linear.BITS


def test_the_sample_is_that_of_smallest_hashes_and_few_rows_are_ordered(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id").repartition(50)
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    want = [r.doc_id for r in df.orderBy(draw, "doc_id").limit(300).collect()]
    got = linear.sample(df, 300)
    assert [r.doc_id for r in got.collect()] == want
    cut = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x)
    assert "<=" in cut
    assert linear.sample(df.limit(0), 300).count() == 0 and linear.sample(df, 20000).count() == 20000


def test_a_learnt_key_of_very_many_rows_is_collected_once(spark, words):
    """100,000 rows of one key, half of them with one text, send one text to the driver; so do rows without a key."""
    many = spark.range(100_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    few = spark.createDataFrame([(8, " ".join(words[:50])), (None, "none"), (8, None)], "doc_id bigint, text string")
    chosen = spark.createDataFrame([(7, 1), (8, 0), (9, 1)], "doc_id bigint, label int")
    got = linear.collect_features(many.unionByName(few), chosen, quality.features, "doc_id", "text")
    assert sorted(y for y, _, _ in got) == [0, 1]


def plain_ftrl(texts, alpha=0.5, beta=1.0, l1=0.02, l2=0.1, passes=2):
    """Follow the regularised leader, coordinate by coordinate."""
    z, n = {}, {}

    def weight(j):
        if abs(z.get(j, 0.0)) <= l1:
            return 0.0
        return -(z[j] - math.copysign(l1, z[j])) / ((beta + math.sqrt(n[j])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(len(texts)):
            y, slots, values = texts[i]
            x = dict(zip(slots.tolist(), values.tolist())) | {"bias": 1.0}
            w = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[j] * v for j, v in x.items())))))
            for j, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / alpha
                z[j], n[j] = z.get(j, 0.0) + g - sigma * w[j], n.get(j, 0.0) + g * g
    return {j: weight(j) for j in z}


def test_the_quality_fit_equals_plain_python(words):
    r, texts = np.random.default_rng(3), []
    for i in range(50):
        slots = np.unique(r.integers(0, 400, 30))
        texts.append((int(i % 3 == 0), slots, r.random(len(slots)) + 0.1))
    weights, bias = quality.fit_ftrl(texts)
    want = plain_ftrl(texts)
    assert bias == pytest.approx(want.pop("bias"), rel=1e-9, abs=1e-12)
    assert np.flatnonzero(weights).tolist() == sorted(j for j, w in want.items() if w)
    assert all(weights[j] == pytest.approx(w, rel=1e-9, abs=1e-12) for j, w in want.items())


def plain_risk(weights, bias, positive, unlabelled, prior):
    """The non-negative risk: the toxic part, and the clean part of the unlabelled less that of the toxic, not below zero."""
    score = lambda s: 1 / (1 + math.exp(-max(-30, min(30, bias + sum(weights[j] for j in s)))))
    mean = lambda xs: sum(xs) / max(len(xs), 1)
    toxic = prior * mean([-math.log(max(score(s), 1e-13)) for s in positive])
    clean = mean([-math.log(max(1 - score(s), 1e-13)) for s in unlabelled]) - prior * mean([-math.log(max(1 - score(s), 1e-13)) for s in positive])
    return toxic + max(0.0, clean)


def test_the_toxicity_fit_lowers_the_plain_risk():
    """On 50 texts whose toxic ones share a feature, the fitted weights have far less risk than none, and no small change of one lowers it much."""
    r = np.random.default_rng(5)
    positive = [np.unique(np.append(r.integers(10, 60, 6), [1, 2])) for _ in range(15)]
    unlabelled = [np.unique(r.integers(10, 60, 6)) if i % 5 else np.unique(np.append(r.integers(10, 60, 6), [1, 2])) for i in range(35)]
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 0.2)
    none = plain_risk(np.zeros(len(weights)), 0.0, positive, unlabelled, 0.2)
    got = plain_risk(weights, bias, positive, unlabelled, 0.2)
    assert got < 0.4 * none
    assert weights[1] > 0 and weights[2] > 0 and weights[1] + weights[2] + bias > max(abs(weights[10:60]))
