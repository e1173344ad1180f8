from __future__ import annotations

import pytest

from sortfolio.operators import align, assign, returns
from sortfolio.plans import config, jobs
from verification import fixtures


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return fixtures.inputs(spark, sf_dir)


@pytest.fixture(scope="module")
def panel(inputs):
    return jobs.prepare_panel(inputs)


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_monthly_join_is_neither_broadcast_nor_nested(inputs, panel):
    """Returns and buckets both grow with the data; only breakpoint tables may be broadcast."""
    domains = assign.ntile_domains(5, 5)
    june = assign.june_assignments(jobs.independent_assignments(panel), list(domains))
    plan = physical_plan(returns.monthly_cube(inputs.returns, june, domains))
    assert "SortMergeJoin [permno" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_outputs_have_no_nested_loops(inputs, panel):
    result = jobs.job_factors_2x2(inputs, panel)
    for df in (result.factors, result.nfirms):
        plan = physical_plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_panel_scan_reads_only_the_columns_it_needs(panel):
    plan = physical_plan(panel.pairs.groupBy("jdate").count())
    assert "ReadSchema: struct<jdate:date>" in plan


def test_result_does_not_depend_on_partitioning(spark, inputs, panel):
    def run():
        rows = jobs.job_factors_2x3(inputs, ("nf",), fresh(panel)).factors.collect()
        return {(r.source_file, r.measure, r.bp, r.date): r for r in rows}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    many = run()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many.keys() == one.keys()
    for k, r in many.items():
        for c in ("Mkt-RF", "SMB", "HML", "CMA", "RMW", "XMY"):
            assert one[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-12) if r[c] is not None else one[k][c] is None


def fresh(panel):
    """The same panel without its cached breakpoints and sums."""
    return jobs.Panel(panel.pairs, panel.totals, panel.benchmark, panel.returns)


def test_duplicate_input_is_rejected(inputs):
    twice = jobs.Inputs(inputs.returns, inputs.chars.unionByName(inputs.chars), inputs.measures, inputs.benchmark)
    with pytest.raises(ValueError, match="more than once"):
        jobs.prepare_panel(twice)


def test_legend_counts_from_one(inputs, panel):
    got = {(r.source_file, r.measure): r["index"] for r in jobs.measures_legend(inputs.measures).collect()}
    assert got == {(r.source_file, r.measure): r["index"] for r in panel.legend.collect()}
    assert got == {("measures_alpha", "m1"): 1, ("measures_alpha", "m2"): 2, ("measures_alpha", "m3"): 3,
                   ("measures_beta", "m4"): 1}


def test_size_halves_and_buckets_partition_the_stocks(panel):
    done = jobs.dependent_assignments(panel)
    bad = done.filter("me is not null and sizeport is null").count()
    junes_without_reference = done.filter("me is not null").select("source_file", "jdate", "sizeport").distinct()
    assert bad == 0 and junes_without_reference.filter("sizeport not in (1, 2)").count() == 0
    assert set(done.columns) >= {config.ntile_port(m) for m in ("size", *config.SORT_MEASURES)}
    assert done.select(*align.SERIES).distinct().count() == 3


def test_the_monthly_join_has_one_june_row_per_file_and_stock(panel):
    """However many measures a file has, a stock's June enters the big join once."""
    domains = jobs.sort_domains("bivariate")
    june = assign.june_assignments(jobs.assignments(panel, "bivariate"), list(domains))
    packed = returns.pack_buckets(june, domains).filter("cell <> 0")
    cells = returns.june_cells(packed)
    assert cells.count() == cells.select("source_file", "permno", "ffyear").distinct().count() < packed.count()
    assert cells.selectExpr("explode(cells)").count() == packed.count()
