"""Exact sums, stored returns and increments of formation years."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sortfolio.functions.sums import exact_sum
from sortfolio.operators import assign, returns
from sortfolio.plans import increments, jobs
from sortfolio.sources import store
from tests.conftest import day
from verification import fixtures


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return fixtures.inputs(spark, sf_dir)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- exact sums -------------------------------------------------------------------------------

def summed(spark, xs, parts=3):
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").repartition(parts)
    return df.agg(exact_sum(F.col("x"))).first()[0]


def test_exact_sums_are_right_in_any_order(spark):
    r = random.Random(1)
    for xs in ([1e15, 1.0, -1e15, 1e-9], [0.1] * 1000, [-(2.0 ** 40), 2.0 ** -40, 3.5], [r.uniform(-1, 1) * 10 ** r.randint(-12, 12) for _ in range(2000)],
               [r.choice([-1, 1]) * 2.0 ** r.randint(-50, 61) for _ in range(500)], [-1e-3] * 77, [0.0, -0.0], [2.0 ** 61] * 9):
        want = math.fsum(xs)
        got = {summed(spark, r.sample(xs, len(xs)), parts) for parts in (1, 8, 211)}
        assert len(got) == 1
        assert got.pop() == pytest.approx(want, rel=4e-16, abs=len(xs) * 2.0 ** -63)


def test_exact_sums_of_none_of_missing_and_of_values_beyond(spark):
    assert summed(spark, []) is None and summed(spark, [None, None]) is None
    assert summed(spark, [None, 2.0]) == 2.0
    assert summed(spark, [1.0, float("inf")]) == math.inf and math.isnan(summed(spark, [1.0, float("nan")]))
    assert summed(spark, [1e300]) == 1e300 and summed(spark, [1e300, 1.0]) == 1e300


def test_monthly_sums_and_returns_have_the_same_bits_however_dealt(spark, inputs):
    panel, found = jobs.prepare_panel(inputs), set()
    domains = jobs.sort_domains("2x2")
    june = assign.june_assignments(jobs.assignments(panel, "2x2"), list(domains))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            cube = returns.monthly_cube(inputs.returns.repartition(n), june, domains)
            ptfs = returns.vw_return_2x2(cube.repartition(n)).select("measure", "jdate", "ptf_code", "retadj_x_wt", "wt", "vwret")
            found.add(tuple(rows(ptfs)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1 and len(found.pop()) > 100


# --- stored returns ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def colocated(spark, inputs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "returns")
    store.write_returns_store(inputs.returns, path, 5)
    stored, buckets = store.open_returns_store(spark, path)
    assert buckets == 5 and rows(stored) == rows(inputs.returns) and stored.schema == inputs.returns.schema
    return replace(inputs, returns=stored, return_buckets=buckets)


@pytest.mark.parametrize("kind", ["2x2", "bivariate"])
def test_stored_returns_are_not_shuffled(spark, colocated, inputs, kind):
    """Of the two sides of the monthly join only the buckets of June pass an exchange."""
    panel = jobs.prepare_panel(colocated)
    domains = jobs.sort_domains(kind)
    june = assign.june_assignments(jobs.assignments(panel, kind), list(domains))
    cube = returns.monthly_cube(colocated.returns, june, domains, colocated.return_buckets)
    lines = cube._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x and "ffyear" in x)
    depth = lines[at].index("SortMergeJoin")
    left = next(i for i, x in enumerate(lines[at + 1:], at + 1) if x[depth - 3:depth + 1].strip().startswith((":-", "+-")) or ":-" in x[:depth + 4])
    right = next(i for i, x in enumerate(lines[left + 1:], left + 1) if x.find("+-") == lines[left].find(":-"))
    side = "\n".join(lines[left:right])
    assert "retadj" in side and "Bucketed: true" in side and "Exchange" not in side
    assert "Exchange" in "\n".join(lines[right:])
    job = jobs.job_factors_2x2 if kind == "2x2" else jobs.job_bivariate_portfolios
    table = lambda x: rows(x.factors if kind == "2x2" else x.portfolios)
    assert table(job(colocated, panel)) == table(job(inputs))


# --- increments -------------------------------------------------------------------------------

def test_two_updates_equal_one_and_a_killed_one_is_repaired(spark, inputs, tmp_path):
    whole, parts, killed = (str(tmp_path / n) for n in ("whole", "parts", "killed"))
    n = increments.update(inputs, whole, "2x2")
    first = increments.update(inputs, parts, "2x2", until=day("1998-06-30"))
    assert 0 < first < n and increments.update(inputs, parts, "2x2", until=day("1998-06-30")) == 0
    incomplete = increments.manifest(spark, whole, "2x2").where("NOT complete").count()
    assert first + increments.update(inputs, parts, "2x2") == n
    assert increments.update(inputs, parts, "2x2") == incomplete  # only Junes whose months are still to come
    want = rows(increments.factors(spark, whole, inputs.benchmark, "2x2").factors)
    assert want == rows(jobs.job_factors_2x2(inputs).factors)
    assert rows(increments.factors(spark, parts, inputs.benchmark, "2x2").factors) == want

    def die(*_):
        raise RuntimeError("killed")

    kept, replaced, count = increments._replace, [], 0
    try:
        increments._replace = lambda df, at: die() if replaced else replaced.append(kept(df.limit(50), at))  # half of the first table, then the end
        with pytest.raises(RuntimeError, match="killed"):
            increments.update(inputs, killed, "2x2")
    finally:
        increments._replace = kept
    assert increments.manifest(spark, killed, "2x2").count() == count
    assert increments.update(inputs, killed, "2x2") == n
    assert rows(increments.factors(spark, killed, inputs.benchmark, "2x2").factors) == want


def test_portfolios_of_increments(spark, inputs, tmp_path):
    at = str(tmp_path / "sorts")
    increments.update(inputs, at, "bivariate", until=day("1999-06-30"))
    increments.update(inputs, at, "bivariate")
    assert rows(increments.portfolios(spark, at, inputs.benchmark, "bivariate").portfolios) == rows(jobs.job_bivariate_portfolios(inputs).portfolios)


def test_nothing_pending_without_rows(spark, inputs, tmp_path):
    empty = replace(inputs, chars=inputs.chars.limit(0))
    assert increments.update(empty, str(tmp_path / "none"), "2x2") == 0
