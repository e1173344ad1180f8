"""The qd solver and the whole operator against numpy and exact whole-number arithmetic."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from sortfolio.llm import qd, queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, n int, size int, x string, id int"


def brute_force(rows: list[tuple], components: int = 4) -> dict:
    """``n``, deviation by key, eigenvalue shares, unit eigenvectors and the fit list's covariance, by dense methods."""
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return {"n": 0, "rows": []}
    lengths = Counter(len(v) for _, v in kept)
    size = max(lengths, key=lambda s: (lengths[s], s))
    kept = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in kept if len(v) == size]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    return {"n": n, "rows": [(k, sum((n * a - s) ** 2 for a, s in zip(x, sums)), np.array(x) - np.array([s / n for s in sums])) for k, x in kept],
            "values": values[order], "vectors": vectors[:, order].T, "trace": values.sum()}


def check(got: list, rows: list[tuple]) -> None:
    want = brute_force(rows)
    m = len(want.get("values", []))
    assert len(got) == len(want["rows"]) * m
    by_key: dict = {}
    for r in got:
        by_key.setdefault((r.vec_id, r.deviation), []).append(r)
    signs = {}
    for key, deviation, x in want["rows"] if m else []:
        mine = by_key[key, deviation]
        for k in range(m):
            live = want["values"][k] > 1e-9 * want["trace"]
            for r in (r for r in mine if r.component == k + 1):
                assert r.n == want["n"] and (r.identity_error is None or r.identity_error < 1e-9)
                assert r.explained == pytest.approx(want["values"][k] / want["trace"] if live else 0, rel=1e-9)
                if not live:
                    assert r.whitened is None
                    continue
                expected = float(x @ want["vectors"][k] / math.sqrt(want["values"][k]))
                if abs(expected) > 1e-6:
                    sign = signs.setdefault(k, math.copysign(1, expected * r.whitened))
                    assert r.whitened * sign == pytest.approx(expected, abs=1e-7)


def sized(rng, n: int, d: int) -> list[list[float]]:
    scale = np.linspace(2, 0.2, d)
    return (rng.normal(size=(n, d)) * scale).astype(np.float32).tolist()


def test_rows_that_repeat_hold_nulls_or_have_another_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(sized(rng, 300, 7))]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [(5, rows[5][1]), (None, rows[6][1]), (None, None), (2000, None), (2001, []), (2002, [1.0, 2.0])]
    rows += [(2003, [None, *[0.5] * 6]), (2004, [float("nan"), *[0.5] * 6]), (2005, [float("inf"), *[0.5] * 6]), (2006, [-0.0] * 7), (2007, [300.0] * 7)]
    df = spark.createDataFrame([(k, v, 1, 1, "x", 9) for k, v in rows], SCHEMA)
    check(whitening.whitened(df.repartition(37), fan=3).collect(), rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [1.0, 2.0, 3.0])], [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], [(i, [float(i), 2.0 * i]) for i in range(9)],
    [(i, [float(i % 7)]) for i in range(30)], [(1, [])], [(1, [0.0, 1.0, 5.0, 2.0, 2.0]), (2, [4.0, 1.0, 0.0, 2.0, 1.0]), (3, [4.0, 2.0, 0.0, 2.0, 1.0])]])
def test_few_rows_and_dependent_dimensions(spark, rows):
    df = spark.createDataFrame([(k, v, 1, 1, "x", 9) for k, v in rows], SCHEMA)
    check(whitening.whitened(df).collect(), rows)


def test_deviations_beyond_32_and_64_bits():
    x = np.array([[1 << 40, -5], [7, 1 << 20]], np.int64)
    sums = [int(c) for c in x.sum(axis=0)]
    assert whitening._deviations(x[1:], 1 << 20, sums) == [None]
    assert whitening._deviations(np.array([[3, 4]]), 1 << 20, [5, 6]) == [((3 << 20) - 5) ** 2 + ((4 << 20) - 6) ** 2]
    assert whitening._deviations(np.array([[1 << 9]]), 1 << 22, [0]) == [1 << 62] and whitening._deviations(np.array([[1 << 10]]), 1 << 22, [0]) == [None]


def test_packed_rows_come_back():
    x = np.array([[1, -2], [1 << 15, 3], [-(1 << 40), 0], [-(1 << 15), (1 << 15) - 1]])
    import pyarrow as pa

    packed = whitening._packed(x)
    assert [len(p) for p in packed] == [5, 9, 17, 5]
    assert (whitening._unpacked(pa.array(packed, pa.binary()), 2) == x).all()


def test_solver_on_whole_number_matrices():
    """Rank-deficient, tied and split matrices among them."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        a = rng.integers(-2, 3, size=(int(rng.integers(1, 40)), n)).astype(float)
        r = np.linalg.qr(np.vstack([a, np.zeros((n, n))]), mode="r")[:n]
        values, vectors = qd.leading(r, 4)
        want = np.linalg.eigvalsh(a.T @ a)[::-1][: len(values)]
        size = max(want[0], 1)
        assert np.abs(values - want).max() < 1e-10 * size
        assert np.abs(vectors @ (a.T @ a) - values[:, None] * vectors).max() < 1e-9 * size
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-9


def test_small_singular_values_keep_their_digits():
    d, f = np.array([1e8, 3.0, 1e-3, 2e-9]), np.array([1e4, 1e-2, 1e-7])
    got = np.sqrt(qd.singular_squares(d, f))
    product = math.prod(d)  # the product of singular values is the determinant
    assert math.prod(got) == pytest.approx(product, rel=1e-12)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    check(queries.op12_embedding_whitening(spark, sf_dir).collect(), rows)
