from __future__ import annotations

import numpy as np
import pytest

from sortfolio.operators.quantiles import CELL, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.3, 0.5, 0.7, 0.9, 1.0]


def groups() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    return {
        "normal": rng.normal(size=2000),
        "heavy": np.exp(rng.normal(0, 12, 1500)) * rng.choice([-1, 1], 1500),
        "ties": rng.choice([0.0, 0.05, 0.07, 0.09], 1800),
        "one_value": np.full(900, 3.25),
        "narrow": 1.0 + rng.integers(0, 500, 1500) * 2.0 ** -50,
        "zero_heavy": np.where(rng.random(1500) < 0.7, 0.0, rng.normal(size=1500)),
        "tiny": np.array([5e-324, -5e-324, 0.0, 1e308, -1e308]),
        "single": np.array([42.0]),
        "pair": np.array([1.0, 2.0]),
    }


@pytest.mark.parametrize("cell", [0, 1600, CELL])
def test_matches_numpy(spark, cell):
    """Groups that fit a window and groups that lie in many parts give the exact values, and so do some of each."""
    data = groups()
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("normal", None)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE").repartition(8)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", PROBS, cell).collect()}
    assert set(got) == set(data)
    for k, xs in data.items():
        assert got[k].n == len(xs)
        for p in PROBS:
            want = np.percentile(xs, p * 100)
            assert got[k][f"q_{str(p).replace('.', '_')}"] == pytest.approx(want, rel=1e-15, abs=0), (k, p)


def test_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", v) for v in [-inf, 1.0, 2.0, 3.0, inf] * 10], "g STRING, x DOUBLE")
    row = exact_quantiles(df, ["g"], "x", [0.0, 0.5, 1.0]).first()
    assert (row["q_0_0"], row["q_0_5"], row["q_1_0"]) == (-inf, 2.0, inf)


def test_one_group_lies_in_several_tasks(spark):
    """Without merging of small partitions, a group of distinct values is spread over all of them."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        row = exact_quantiles(spark.range(100001).selectExpr("'a' AS g", "id * 1.0D AS x"), ["g"], "x", [0.2, 0.8]).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert (row["n"], row["q_0_2"], row["q_0_8"]) == (100001, 20000.0, 80000.0)


def test_empty_input(spark):
    df = spark.createDataFrame([], "g STRING, x DOUBLE")
    assert exact_quantiles(df, ["g"], "x", [0.5]).count() == 0
