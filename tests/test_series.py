"""Monthly sums over numbered series, on hand-made rows."""

from __future__ import annotations

import datetime

import pytest

from sortfolio.operators import returns
from verification import fixtures

DOMAINS = {"aport": range(1, 4), "bport": range(1, 3)}
JUNE = "source_file STRING, measure STRING, permno BIGINT, ffyear INT, aport INT, bport INT"
MONTHLY = "permno BIGINT, ffyear INT, jdate DATE, retadj DOUBLE, wt DOUBLE"
JULY = datetime.date(2000, 7, 31)


@pytest.fixture(scope="module")
def tables(spark):
    june = [("f", "m1", 1, 2000, 1, 1), ("f", "m2", 1, 2000, 3, 2), ("g", "m1", 1, 2000, 1, None), (None, "m1", 1, 2000, 2, 2),
            ("f", None, 2, 2000, 2, 1), ("f", "m1", 2, 2000, None, None), ("f", "m1", 3, 2000, 1, 1), ("f", "m1", 3, 2000, 1, 1), ("f", "m1", None, 2000, 1, 1)]
    monthly = [(1, 2000, JULY, 0.5, 4.0), (1, 2000, JULY, None, 2.0), (2, 2000, JULY, 0.25, None), (3, 2000, JULY, 1.0, 1.0), (None, 2000, JULY, 9.0, 9.0)]
    return spark.createDataFrame(monthly, MONTHLY), spark.createDataFrame(june, JUNE)


@pytest.mark.parametrize("given", [False, True])
def test_sums_keep_their_series(tables, given):
    """Names that occur in two files, missing names, repeated Junes and Junes without a bucket."""
    monthly, june = tables
    cube = returns.monthly_cube(monthly, june, DOMAINS, series=returns.numbered_series(june) if given else None)
    assert cube.columns == [*DOMAINS, "source_file", "measure", "jdate", *returns.CUBE_SUMS]
    found = {(r.source_file, r.measure, r.aport, r.bport): (r.retadj_x_wt, r.wt, r.n_ret, r.n_wt, r.n_both, r.n_rows) for r in cube.collect()}
    one = (2.0, 6.0, 1, 2, 1, 2)
    assert found == {("f", "m1", 1, 1): (4.0, 8.0, 3, 4, 3, 4), ("f", "m2", 3, 2): one, ("g", "m1", 1, None): one, (None, "m1", 2, 2): one,
                     ("f", None, 2, 1): (None, None, 1, 0, 0, 1)}


def test_monthly_rows_are_grouped_by_numbers(tables):
    """Names in the keys and arrays of all measures of a June made the sums twice as dear."""
    plan = returns.monthly_cube(*tables, DOMAINS)._jdf.queryExecution().executedPlan().toString()
    keys = [x[x.index("keys=["):].split("]")[0] for x in plan.split("\n") if "HashAggregate(keys=[" in x and "cell" in x]
    assert len(keys) == 2 and all("series" in k and "measure" not in k and "source_file" not in k for k in keys)
    assert "collect_list" not in plan


def test_returns_of_line_items_are_dealt_before_they_are_summed(spark, tmp_path):
    """Sums before the shuffle held a row for nearly every line in the memory of each reading task."""
    day = datetime.date(1996, 5, 2)
    rows = [(p, d, 10.0, 100.5, 0.05, 0.02, "R", "O") for p, d in ((1, day), (1, day), (2, day), (None, day), (1, None))]
    spark.createDataFrame(rows, "l_partkey BIGINT, l_shipdate DATE, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                          "l_returnflag STRING, l_linestatus STRING").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = fixtures.returns(spark, str(tmp_path))
    lines = made._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Exchange" in x for x in lines) == 1
    first = max(i for i, x in enumerate(lines) if "HashAggregate" in x)
    assert next(i for i, x in enumerate(lines) if "Exchange" in x) > first
    want = {(1, "1996-05-02", 0.03, 201.0, 1995), (2, "1996-05-02", 0.03, 100.5, 1995), (None, "1996-05-02", 0.03, 100.5, 1995), (1, None, 0.03, 100.5, None)}
    assert {(r.permno, r.date, r.retadj, r.wt, r.ffyear) for r in made.collect()} == want
