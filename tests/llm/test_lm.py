from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortfolio.llm import lm
from tests.llm.conftest import documents


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), "\0"]


@pytest.fixture(scope="module")
def corpus(words, odd):
    r = random.Random(2)
    return [x for x in odd if x[0] != 7] + [(100 + i, " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=80))) for i in range(120)]


def test_baseline_and_held_out_rows(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)  # most words take the joined way
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(t for i, x in corpus if not held(i) for t in tokens_of(x))
    total, distinct = sum(counts.values()), len(counts)
    got = sorted(lm.lm_scores(documents(spark, corpus)).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens))
    for r, (i, x) in zip(got, sorted(corpus, key=lambda r: (r[0] or -1, len(tokens_of(r[1])))), strict=True):
        t = tokens_of(x)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(t), sum(counts[k] > 0 for k in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[k] + 0.5) / (total + 0.5 * (distinct + 1))) for k in t))
        assert r.score < 0
    # the model has learnt: held-out text costs far less than eight bits a byte, and noise costs more
    assert np.mean([r.bits_per_byte for r in got if r.held_out and r.doc_id >= 100]) < 3


def test_noise_is_unlikely(spark, corpus):
    r = random.Random(9)
    key = next(i for i in range(5000, 5099) if zlib.crc32(str(i).encode()) % 5 == 1)  # held out
    noise = (key, " ".join("".join(r.choice("qxzjkvw0123") for _ in range(7)) for _ in range(40)))
    got = {x.doc_id: x for x in lm.lm_scores(documents(spark, [*corpus, noise])).collect()}
    assert got[key].bits_per_byte > max(x.bits_per_byte for k, x in got.items() if k and 100 <= k < 1000)


def test_probabilities_of_the_next_byte_sum_to_one():
    r = np.random.default_rng(0)
    table = r.integers(0, 40, (lm.ORDER, 1 << lm.LEAST_BITS, 2)).astype(np.uint8)
    seen = r.random((lm.GATES, lm.BUCKETS, 2)) * 50
    seen[..., 0] *= seen[..., 1] / 50
    model = lm.Scorer("t", table, r.random((lm.GATES, lm.INPUTS)), seen)
    keys = (np.uint64(0x6162636465) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert (10.0 ** model.scores(keys).astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)
    assert np.allclose(model.scores(keys), model.fresh(keys))  # remembered values are the computed ones


def test_empty_table_and_no_training_text(spark):
    assert lm.lm_scores(documents(spark, [])).collect() == []
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm.lm_scores(documents(spark, [(only, "ab")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 2, 0, 0, 0)
    assert row.bits_per_byte == pytest.approx(8, abs=0.01)


# --- the model in plain Python ----------------------------------------------------------------

def windows_of(text):
    data = "".join(t + " " for t in tokens_of(text)[:-1]).encode() + b"\n"
    return [int.from_bytes(data[max(0, i - lm.ORDER) : i + 1], "big") for i in range(len(data))]


def plain_model(texts, parts):
    """Scores of texts from training texts, bit by bit; ``parts``: the windows of each partition in their order."""
    counts = Counter(w for t in texts for w in windows_of(t))
    size = lm.slot_bits(len(counts))
    slots = {}

    def bits_of(w):
        if w not in slots:
            at, bits = lm._slots(np.array([w], np.uint64), size)
            slots[w] = at[0].tolist(), bits[0].tolist()
        return zip(*slots[w])

    table = Counter()
    for w, n in counts.items():
        for row, bit in bits_of(w):
            for order, slot in enumerate(row):
                table[order, slot, bit] += n
    coded = {k: float(lm.COUNTS[lm.codes(np.array([n]))[0]]) for k, n in table.items()}

    def view(w, less):
        """For each bit of a window: the bit, its gate and the inputs."""
        for place, (row, bit) in enumerate(bits_of(w)):
            pairs = [[max(0.0, coded.get((o, s, b), 0.0) - less * (b == bit)) for b in (0, 1)] for o, s in enumerate(row)]
            seen = [sum(p) for p in pairs]
            longest = sum(x > 0 for x in seen)
            n = seen[max(longest - 1, 0)]
            gate = (place * (lm.ORDER + 1) + longest) * 4 + (n > 1) + (n > 3) + (n > 12)
            yield bit, gate, [math.log((p[1] + 0.05) / (p[0] + 0.05)) if sum(p) else 0.0 for p in pairs] + [1.0]

    sigmoid = lambda z: 1 / (1 + math.exp(-max(-20.0, min(20.0, z))))
    bucket = lambda z: int(max(0, min(lm.BUCKETS - 1, np.round(z * 2) + lm.BUCKETS // 2)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    total, mean = 0.0, {}
    for part in parts:
        weights = {g: [0.3] * lm.ORDER + [0.0] for g in range(lm.GATES)}
        mass = float(sum(counts[w] for w in part))
        for i in range(0, len(part), 1024):
            pull, all_ = {}, Counter()
            for w in part[i : i + 1024]:
                for bit, gate, x in view(w, 1):
                    error = (bit - sigmoid(dot(x, weights[gate]))) * counts[w]
                    pull[gate] = [p + error * v for p, v in zip(pull.get(gate, [0.0] * lm.INPUTS), x)]
                    all_[gate] += counts[w]
            for gate, p in pull.items():
                weights[gate] = [v + 0.02 * q / max(all_[gate], 1) for v, q in zip(weights[gate], p)]
        total += mass
        for g, v in weights.items():
            mean[g] = [m + q * mass for m, q in zip(mean.get(g, [0.0] * lm.INPUTS), v)]
    weights = {g: [v / total for v in q] for g, q in mean.items()}
    ones, every = Counter(), Counter()
    for w, n in counts.items():
        for bit, gate, x in view(w, 1):
            at = gate, bucket(dot(x, weights[gate]))
            ones[at] += n * bit
            every[at] += n

    def score(text):
        out = 0.0
        for w in windows_of(text):
            for bit, gate, x in view(w, 0):
                z = dot(x, weights[gate])
                at = gate, bucket(z)
                refined = (ones[at] + 20 * sigmoid((at[1] - lm.BUCKETS // 2) / 2)) / (every[at] + 20)
                p = max(1e-6, min(1 - 1e-6, 0.5 * sigmoid(z) + 0.5 * refined))
                out += math.log10(p if bit else 1 - p)
        return out

    return score


def test_scores_equal_plain_python(spark):
    """50 short texts; the order of windows is asked from Spark, all else is computed bit by bit."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(["the", "cat", "Sat", "on", "mats", "été", "dogs"], k=r.randint(0, 9)))) for i in range(50)]
    learnt = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    keys = sorted({w for t in learnt for w in windows_of(t)})
    signed = spark.createDataFrame([(w - (1 << 64) if w >> 63 else w,) for w in keys], "key bigint")
    dealt = signed.repartition("key").sortWithinPartitions(F.xxhash64("key"), "key").select("key", F.spark_partition_id().alias("p")).collect()
    parts = {}
    for x in dealt:
        parts.setdefault(x.p, []).append(x.key % (1 << 64))
    score = plain_model(learnt, [parts[p] for p in sorted(parts)])
    got = {x.doc_id: x.score for x in lm.lm_scores(documents(spark, rows)).collect()}
    assert all(got[i] == pytest.approx(score(t), rel=2e-4, abs=2e-4) for i, t in rows)


def test_slots_follow_the_distinct_windows_up_to_a_bound():
    assert [lm.slot_bits(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 1 << 23, 1 << 40)] == [18, 18, 18, 19, 23, 24]


def test_a_task_holds_one_batch_of_windows():
    """Windows are taken from the iterator as they are needed."""
    import pyarrow as pa

    asked = []

    def batches():
        for i in range(5):
            asked.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([i] * 3000, pa.int64()), pa.array([1] * 3000, pa.int64())], ["key", "n"])

    sizes = [len(k) for k, _ in zip((k for k, _ in lm._streamed(batches(), 1024)), range(4))]
    assert sizes == [1024, 1024, 952, 1024] and asked == [0, 1]
