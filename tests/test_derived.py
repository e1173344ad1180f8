"""Queries derive the tables they read and no others, and carry no more of them than they need; on hand-made rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest

from sortfolio.plans import jobs
from verification import fixtures, panel_queries, queries, raw


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    """Forty parts with a line every other month of two years, and orders in all of their months."""
    path = str(tmp_path_factory.mktemp("tables"))
    months = [dt.date(y, m, 15) for y in (1995, 1996) for m in range(1, 13)]
    lines = [(p, p % 3, d, float(10 + (p + d.month) % 7), 100.0 + 3 * p + d.month, 0.01 * (p % 5), 0.02 * (d.month % 3), "RAN"[(p + d.month) % 3], "OF"[p % 2])
             for p in range(40) for d in months[p % 2::2]]
    spark.createDataFrame(lines, "l_partkey BIGINT, l_suppkey BIGINT, l_shipdate DATE, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                          "l_returnflag STRING, l_linestatus STRING").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(p, p % 4, 9.0 + p) for p in range(40)], "p_partkey BIGINT, p_size INT, p_retailprice DOUBLE").write.parquet(f"{path}/part.parquet")
    orders = [(d, f"{1 + i % 5}-X", 1000.0 + i) for i, d in enumerate(months)]
    spark.createDataFrame(orders, "o_orderdate DATE, o_orderpriority STRING, o_totalprice DOUBLE").write.parquet(f"{path}/orders.parquet")
    return path


def test_june_sorts_derive_no_monthly_returns(spark, folder):
    """The returns of all months were summed and written before June buckets, which read none of them."""
    found = queries.queries()
    for name in ("june_assignments", "assign_ntile_dependent"):
        assert found[name](spark, folder).count() > 0
    made = fixtures.derived(spark, folder)
    assert "returns" not in vars(made) and {"chars", "measures", "benchmark"} <= set(vars(made))
    whole = fixtures.inputs(spark, folder)
    assert whole is made and "returns" in vars(made) and whole.returns.count() == 40 * 12
    given = replace(whole, chars=whole.chars.limit(0))
    assert given.chars.count() == 0 and given.returns is whole.returns and given.return_buckets is None


def test_december_equity_derives_the_securities_only(spark, folder):
    assert panel_queries.queries()["december_market_equity"](spark, folder).count() > 0
    made = raw.raw(spark, folder)
    assert "securities" in vars(made) and not {"accounts", "links"} & set(vars(made))
    assert made.accounts.count() > 0 and made.links.count() > 0


def test_inputs_of_the_flags_are_not_shuffled(spark, folder, monkeypatch):
    """Flags are made of the characteristics before these meet the measures."""
    seen, build = [], jobs.align.build_panel
    monkeypatch.setattr(jobs.align, "build_panel", lambda chars, measures: (seen.extend(chars.columns), build(chars, measures))[1])
    pairs = jobs.prepare_panel(fixtures.derived(spark, folder)).pairs
    assert {"me", "is_op_ok", "u_bm"} <= set(seen) and not {"revt", "cogs", "prc", "shrout", "dec_me", "be"} & set(seen)
    assert pairs.count() > 0 and pairs.columns[-1] == "values"
