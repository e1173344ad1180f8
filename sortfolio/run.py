"""Run the jobs on files: ``python -m sortfolio.run --jobs 2x3 bivariate --returns ... --out ...``.

Writes the factor or portfolio tables, the firm counts and the measure legend, and next to them
the diagnostics as small tables: coverage, missing shares, usable stocks, correlations.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortfolio.landing import drop_landed, land, landed_so_far
from sortfolio.operators import align, assign, diagnostics
from sortfolio.operators.align import SERIES
from sortfolio.plans import config, jobs
from sortfolio.session import build_session
from sortfolio.sources import calendar, codes, sinks, tables, text

JOBS = ("2x3", "2x2", "2x2x2x2x2", "bivariate", "three_way")


def load_inputs(spark: SparkSession, returns: str, chars: str, measures: str, factors: str) -> jobs.Inputs:
    """Tables from files, the returns and the published months read once; the latter end at the last return date."""
    rets = land(tables.read_returns(spark, returns), "returns")
    bench = text.parse_benchmark_factors(text.read_lines(spark, factors))
    return jobs.Inputs(rets, tables.read_characteristics(spark, chars), tables.read_measures(spark, measures),
                       land(calendar.clip_to_returns(bench, rets), "benchmark"))


def load_published(spark: SparkSession, paths: dict[str, str], benchmark: DataFrame, n_size: int, n_other: int) -> DataFrame:
    """Published test portfolios of several sorts, long, with the codes used here."""
    parts = [text.parse_benchmark_portfolios(text.read_lines(spark, path)).select(
        "date", "ptf_code", "ret", F.lit(sort).alias("sort_on")) for sort, path in paths.items()]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return codes.normalise_portfolio_codes(calendar.clip_to_window(stacked, benchmark), n_size, n_other)


def _report(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(f"{out}/reports/{name}")


def report_panel(panel: jobs.Panel, out: str) -> None:
    _report(diagnostics.measure_coverage_summary(align.attach_measure(panel.pairs)), out, "measure_coverage")
    _report(diagnostics.common_pair_count(panel.pairs), out, "common_pairs")
    _report(diagnostics.missing_pct(panel.long), out, "missing_pct")
    _report(diagnostics.good_measure_counts(panel.long), out, "usable_stocks")
    _report(diagnostics.good_measure_pct(panel.long), out, "usable_stocks_pct")


def run_factors(inputs: jobs.Inputs, panel: jobs.Panel, kind: str, robust: tuple[str, ...], out: str, fmt: str) -> None:
    result = jobs.job_factors(inputs, kind, robust if kind == "2x3" else (), panel)
    robust = robust if kind == "2x3" else ()
    sinks.write_factors(result.factors, f"{out}/factors_{kind}", kind, robust, fmt)
    sinks.write_factor_nfirms(result.nfirms, f"{out}/factors_nfirms_{kind}", kind, robust, fmt)
    compared = align.compare_factors(inputs.benchmark, result.factors)
    _report(diagnostics.factor_correlations(compared), out, f"correlations_{kind}")
    _report(diagnostics.factor_coverage_pct(result.nfirms, result.cube), out, f"coverage_{kind}")
    keys = [*SERIES, "bp"]
    _report(diagnostics.date_range_summary(result.factors, keys, F.lit(6)), out, f"date_range_{kind}")
    june = assign.june_assignments(jobs.assignments(panel, kind, robust), list(jobs.sort_domains(kind, robust)))
    if kind == "2x3":
        for name in [p for p in june.columns if p.startswith("nfport")]:
            _report(diagnostics.size_nf_cell_counts(june, name), out, f"size_{name}_counts_{kind}")
    if kind == "2x2x2x2x2":
        _report(diagnostics.portfolio_group_count(june), out, f"portfolio_groups_{kind}")


def run_sorts(inputs: jobs.Inputs, panel: jobs.Panel, kind: str, published: DataFrame | None, out: str, fmt: str) -> None:
    job = jobs.job_bivariate_portfolios if kind == "bivariate" else jobs.job_threeway_portfolios
    result = job(inputs, panel)
    sinks.write_portfolios(result.portfolios, f"{out}/portfolios_{kind}", kind, fmt)
    sinks.write_portfolio_nfirms(result.nfirms, f"{out}/portfolios_nfirms_{kind}", kind, fmt)
    sinks.write_legend(result.legend, f"{out}/legend_{kind}", kind, fmt)
    counts = diagnostics.portfolio_nfirms(result.sorts)
    _report(diagnostics.portfolio_coverage_pct(counts, result.cube), out, f"coverage_{kind}")
    _report(diagnostics.portfolios_per_date(result.sorts), out, f"portfolios_per_date_{kind}")
    _report(diagnostics.misassigned_check(jobs.assignments(panel, kind)), out, f"misassigned_{kind}")
    _report(diagnostics.date_range_summary(result.portfolios, [*SERIES, "sort_on"], F.count_distinct("ptf_code")), out, f"date_range_{kind}")
    if published is not None:
        compared = align.compare_portfolios(result.portfolios, published)
        _report(diagnostics.portfolio_correlations(compared), out, f"correlations_{kind}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--jobs", nargs="+", choices=JOBS, default=list(JOBS))
    parser.add_argument("--returns", required=True, help="monthly returns, CSV or parquet")
    parser.add_argument("--chars", required=True, help="June characteristics, CSV or parquet")
    parser.add_argument("--measures", required=True, help="pattern of the candidate measure CSV files")
    parser.add_argument("--factors", required=True, help="published factor file (text)")
    parser.add_argument("--published", nargs="*", default=[], metavar="SORT=PATH",
                        help="published portfolio files, e.g. size_bm=/data/25_Portfolios_5x5.csv")
    parser.add_argument("--robust", nargs="*", default=["nf"], choices=config.MEASURES,
                        help="measures of the 2x3 sort that use the alternative breakpoint sets")
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", default="csv", choices=("csv", "parquet"))
    args = parser.parse_args(argv)

    spark, before = build_session(), landed_so_far()
    inputs = load_inputs(spark, args.returns, args.chars, args.measures, args.factors)
    panel = jobs.prepare_panel(inputs)
    report_panel(panel, args.out)
    paths = dict(p.split("=", 1) for p in args.published)
    for kind in args.jobs:
        if kind in ("bivariate", "three_way"):
            k, n_size, n_other = (2, 5, 5) if kind == "bivariate" else (3, 2, 4)
            own = {s: p for s, p in paths.items() if s.count("_") == k - 1}
            published = load_published(spark, own, inputs.benchmark, n_size, n_other) if own else None
            run_sorts(inputs, panel, kind, published, args.out, args.format)
        else:
            run_factors(inputs, panel, kind, tuple(args.robust), args.out, args.format)
    drop_landed(before)


if __name__ == "__main__":
    main()
