from __future__ import annotations

from sortfolio import run
from sortfolio.operators import universe
from verification import fixtures
from verification.queries import context, factor_text, portfolio_text


def test_runner_writes_all_tables(spark, sf_dir, tmp_path):
    """From files to files: measure, factor and portfolio files in, tables and reports out."""
    inputs = fixtures.inputs(spark, sf_dir)
    c = context(spark, sf_dir)
    inputs.returns.write.option("header", True).csv(str(tmp_path / "returns"))
    universe.eligibility_flags(inputs.chars).write.option("header", True).csv(str(tmp_path / "chars"))
    (tmp_path / "m").mkdir()
    for name, wide in fixtures.wide_measures(spark, sf_dir).items():
        wide.toPandas().to_csv(tmp_path / "m" / f"{name}.csv", index=False)
    out = tmp_path / "out"
    run.main(["--jobs", "2x3", "bivariate", "--returns", str(tmp_path / "returns"), "--chars", str(tmp_path / "chars"),
              "--measures", str(tmp_path / "m" / "*.csv"), "--factors", factor_text(c),
              "--published", f"size_bm={portfolio_text(c)}", "--robust", "nf", "--out", str(out)])
    names = {p.name for p in out.glob("*/file=*")}
    assert {"file=2x3_factors_alpha_robust(nf)", "file=2x3_factors_nfirms_beta_robust(nf)",
            "file=bivariate_sorts_test_portfolios_alpha", "file=bivariate_sorts_test_portfolios_nfirms_beta",
            "file=measures_legend_bivariate_sorts_test_portfolios_alpha"} <= names
    reports = {p.name for p in (out / "reports").iterdir()}
    assert {"measure_coverage", "common_pairs", "missing_pct", "usable_stocks", "usable_stocks_pct", "correlations_2x3",
            "coverage_2x3", "date_range_2x3", "correlations_bivariate", "coverage_bivariate", "size_nfport_20_80_counts_2x3",
            "portfolios_per_date_bivariate", "misassigned_bivariate", "date_range_bivariate"} <= reports
    corr = spark.read.option("header", True).csv(str(out / "reports" / "correlations_bivariate"))
    assert corr.count() == 3


def test_inputs_are_read_once(spark, sf_dir, tmp_path):
    """No later plan scans the returns or the published file again."""
    inputs, c = fixtures.inputs(spark, sf_dir), context(spark, sf_dir)
    inputs.returns.write.option("header", True).csv(str(tmp_path / "returns"))
    inputs.chars.write.option("header", True).csv(str(tmp_path / "chars"))
    (tmp_path / "m").mkdir()
    for name, wide in fixtures.wide_measures(spark, sf_dir).items():
        wide.toPandas().to_csv(tmp_path / "m" / f"{name}.csv", index=False)
    loaded = run.load_inputs(spark, str(tmp_path / "returns"), str(tmp_path / "chars"), str(tmp_path / "m" / "*.csv"), factor_text(c))
    for df in (loaded.returns, loaded.benchmark):
        plan = df._jdf.queryExecution().executedPlan().toString().lower()
        assert "format: parquet" in plan and "csv" not in plan
