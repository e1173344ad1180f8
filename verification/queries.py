"""One query per operator, over the input tables derived from the driver's tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, lru_cache, reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortfolio.functions.columns import formation_year, month_end
from sortfolio.functions.sums import exact_sum
from sortfolio.landing import land, landing_path
from sortfolio.operators import align, assign, breakpoints, diagnostics, factors, returns, universe
from sortfolio.operators.align import PAIR, SERIES
from sortfolio.plans import config, increments, jobs
from sortfolio.sources import calendar, codes, sinks, store, tables, text
from verification import fixtures, panel_queries

ROBUST = ("nf",)
#: the sorts, each with its measures of alternative breakpoint sets
FACTOR_KINDS = {"2x3": ROBUST, "2x2": (), "2x2x2x2x2": ()}
SORT_KINDS = ("bivariate", "three_way")
STORE_BUCKETS = 7


class Context:
    """Shared intermediate results of one session and folder; each is computed when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def inputs(self) -> jobs.Inputs:
        return fixtures.derived(self.spark, self.sf_dir)

    @cached_property
    def panel(self) -> jobs.Panel:
        return jobs.prepare_panel(self.inputs)

    @cached_property
    def full_panel(self) -> DataFrame:
        """Pairs with all characteristics."""
        return align.build_panel(self.inputs.chars, self.inputs.measures)

    @lru_cache(maxsize=None)  # noqa: B019 - lives as long as the session
    def assigned(self, kind: str, robust: tuple[str, ...] = ()) -> DataFrame:
        return jobs.assignments(self.panel, kind, robust)

    def june(self, kind: str, robust: tuple[str, ...] = ()) -> DataFrame:
        return assign.june_assignments(self.assigned(kind, robust), list(jobs.sort_domains(kind, robust)))

    def monthly(self, kind: str, robust: tuple[str, ...] = ()) -> DataFrame:
        carried = align.carry_forward(self.inputs.returns, self.june(kind, robust))
        return universe.drop_unassigned(carried, list(jobs.sort_domains(kind, robust)))

    def cube(self, kind: str, robust: tuple[str, ...] = ()) -> DataFrame:
        return self.panel.cube(kind, robust)

    @lru_cache(maxsize=None)  # noqa: B019
    def ptfs(self, kind: str) -> DataFrame:
        if kind == "2x3":
            return land(returns.vw_return_2x3(self.cube("2x3", ROBUST), ROBUST), "ptfs")
        if kind == "2x2":
            return land(returns.vw_return_2x2(self.cube("2x2")), "ptfs")
        if kind == "2x2x2x2x2":
            return land(returns.vw_return_5way(self.cube("2x2x2x2x2")), "ptfs")
        if kind == "bivariate":
            return land(returns.vw_return_bivariate(self.cube(kind), config.bivariate_sorts()), "ptfs")
        return land(returns.vw_return_threeway(self.cube(kind), config.threeway_sorts()), "ptfs")

    def factors(self, kind: str) -> DataFrame:
        robust = ROBUST if kind == "2x3" else ()
        table = factors.factor_table(self.ptfs(kind), self.cube(kind, robust), self.inputs.benchmark, kind)
        return jobs.tag(table, robust)

    def nfirms(self, kind: str) -> DataFrame:
        cube, bench = self.cube(kind, ROBUST if kind == "2x3" else ()), self.inputs.benchmark
        if kind == "2x3":
            return diagnostics.factor_nfirms_2x3(cube, bench, ROBUST)
        if kind == "2x2":
            return diagnostics.factor_nfirms_2x2(cube, bench)
        return diagnostics.factor_nfirms_5way(cube, bench)

    def excess(self, kind: str) -> DataFrame:
        return returns.excess_returns(self.ptfs(kind), self.inputs.benchmark)

    def published(self, kind: str) -> DataFrame:
        make = fixtures.published_bivariate if kind == "bivariate" else fixtures.published_threeway
        return make(self.spark, self.sf_dir)


_contexts: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = Context(spark, sf_dir)
    return _contexts[key]


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Results are compared at nine decimals: sums may run in any order."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def flat_edges(df: DataFrame, var: str, probs: tuple[float, ...]) -> DataFrame:
    """``<var>_edges`` as one column per percentile, e.g. ``bm30``."""
    cols = {f"{var}{round(p * 100)}": F.get(f"{var}_edges", F.lit(i)) for i, p in enumerate(probs)}
    return df.withColumns(cols).drop(f"{var}_edges")


SERIES_PAIR = [*SERIES, *PAIR]
PORTS = ["szport", "bmport", "opport", "invport", "nfport"]
NPORTS = ["sizeport", "bmport", "opport", "invport", "nfport"]
PAIR_KEYS = [*SERIES, "bp", "jdate"]


# --- sources -------------------------------------------------------------------------------

def _csv(df: DataFrame, path: str) -> str:
    df.write.option("header", "true").csv(path)
    return path


def q_read_returns(c: Context) -> DataFrame:
    return tables.read_returns(c.spark, _csv(c.inputs.returns, landing_path(c.spark, "returns_csv")))


def q_read_characteristics(c: Context) -> DataFrame:
    stored = universe.eligibility_flags(c.inputs.chars)  # stale flags are in the file, not in the result
    return tables.read_characteristics(c.spark, _csv(stored, landing_path(c.spark, "chars_csv")))


def q_read_measures(c: Context) -> DataFrame:
    folder = landing_path(c.spark, "measure_files")
    paths = [_csv(wide, f"{folder}/{name}.csv") for name, wide in fixtures.wide_measures(c.spark, c.sf_dir).items()]
    return tables.measures_long(tables.read_measures(c.spark, paths))


def _write_text(parts: list[DataFrame], path: str) -> str:
    """Numbered lines as one text file (a published file has one line per month)."""
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    lines.repartition(1).sortWithinPartitions("block", "key").select("line").write.text(path)
    return path


def _head(spark: SparkSession, block: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(block, str(i), line) for i, line in enumerate(lines)], "block INT, key STRING, line STRING")


def factor_text(c: Context) -> str:
    b = c.inputs.benchmark
    values = [F.format_string("%.4f", F.col(f) * 100) for f in text.FACTOR_FIELDS]
    monthly = b.select(F.lit(1).alias("block"), F.date_format("date", "yyyyMM").alias("key"),
                       F.concat_ws(",", F.date_format("date", "yyyyMM"), *values).alias("line"))
    yearly = (b.groupBy(F.year("date").cast("string").alias("key")).agg(
        *[F.sum(f).alias(f) for f in text.FACTOR_FIELDS])
        .select(F.lit(3).alias("block"), "key", F.concat_ws(",", F.concat(F.lit("  "), "key"), *values).alias("line")))
    head = ["This file holds monthly and annual factors", "in percent", "", "," + ",".join(text.FACTOR_FIELDS)]
    return _write_text([_head(c.spark, 0, head), monthly,
                        _head(c.spark, 2, ["", " Annual Factors: January-December", head[-1]]), yearly],
                       landing_path(c.spark, "factor_text"))


def published_name(sort_on: str, i: int, j: int) -> str:
    """Column name of cell (i, j) in a published 5x5 file, e.g. ``SMALL LoBM`` or ``ME2 BM3``."""
    corner = i in (1, 5) and j in (1, 5)

    def part(measure: str, k: int) -> str:
        name = "ME" if measure == "size" else measure.upper()
        if not corner:
            return f"{name}{k}"
        return {1: "SMALL", 5: "BIG"}[k] if measure == "size" else {1: "Lo", 5: "Hi"}[k] + name

    a, b = sort_on.split("_")
    return f"{part(a, i)} {part(b, j)}"


CELLS = [(i, j) for i in range(1, 6) for j in range(1, 6)]


def published_wide(c: Context, sort_on: str, names: dict[str, str] | None = None) -> DataFrame:
    a, b = sort_on.split("_")
    cell_codes = [f"{a}{i}_{b}{j}" for i, j in CELLS]
    wide = (c.published("bivariate").filter(F.col("sort_on") == sort_on)
            .groupBy("date").pivot("ptf_code", cell_codes).agg(F.max("ret")))
    return wide.withColumnsRenamed(names) if names else wide


def portfolio_text(c: Context, sort_on: str = "size_bm") -> str:
    wide, (a, b) = published_wide(c, sort_on), sort_on.split("_")
    names = [published_name(sort_on, i, j) for i, j in CELLS]
    values = [F.coalesce(F.format_string("%10.4f", F.col(f"{a}{i}_{b}{j}") * 100), F.lit("")) for i, j in CELLS]
    month = F.date_format("date", "yyyyMM")
    rows = wide.select(F.lit(1).alias("block"), month.alias("key"), F.concat_ws(",", month, *values).alias("line"))
    equal = wide.select(F.lit(3).alias("block"), month.alias("key"),
                        F.concat_ws(",", month, *[F.lit("1.0000") for _ in CELLS]).alias("line"))
    header = "," + ",".join(names)
    head = ["This file holds portfolio returns", "", "  " + config.VW_MONTHLY_MARKER, header]
    return _write_text([_head(c.spark, 0, head), rows,
                        _head(c.spark, 2, ["", "", "  Average Equal Weighted Returns -- Monthly", header]), equal],
                       landing_path(c.spark, "portfolio_text"))


def q_parse_benchmark_factors(c: Context) -> DataFrame:
    return rounded(text.parse_benchmark_factors(text.read_lines(c.spark, factor_text(c))))


def q_parse_benchmark_portfolios(c: Context) -> DataFrame:
    return rounded(_stacked([
        text.parse_benchmark_portfolios(text.read_lines(c.spark, portfolio_text(c, sort_on)))
        .select("date", "ptf_code", "ret", F.lit(sort_on).alias("sort_on")) for sort_on in config.PUBLISHED_BIVARIATE]))


def q_clip_to_window(c: Context) -> DataFrame:
    monthly = c.inputs.returns.select(F.col("jdate").alias("date"), "permno", "retadj")
    return calendar.clip_to_window(monthly, calendar.clip_to_returns(c.inputs.benchmark, c.inputs.returns))


def q_normalise_portfolio_codes(c: Context) -> DataFrame:
    wide = {}
    for sort_on in config.PUBLISHED_BIVARIATE:
        a, b = sort_on.split("_")
        wide[sort_on] = published_wide(c, sort_on, {f"{a}{i}_{b}{j}": published_name(sort_on, i, j) for i, j in CELLS})
    return codes.normalise_portfolio_codes(codes.benchmark_long(wide), 5, 5)


def q_benchmark_long(c: Context) -> DataFrame:
    return codes.benchmark_long({s: published_wide(c, s) for s in config.PUBLISHED_BIVARIATE})


def q_month_end(c: Context) -> DataFrame:
    return _stacked([wide.select(F.lit(name).alias("source_file"), "permno", "date", month_end(F.col("date"), "yyyyMM").alias("jdate"))
                     for name, wide in fixtures.wide_measures(c.spark, c.sf_dir).items()])


def q_formation_year(c: Context) -> DataFrame:
    return c.inputs.chars.select(*PAIR, formation_year(F.col("jdate")).alias("ffyear"))


# --- sinks: written, then read back -----------------------------------------------------------

def _back(c: Context, path: str) -> DataFrame:
    df = c.spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return df.withColumns({d: F.col(d).cast("date") for d in ("date", "jdate") if d in df.columns})


def _text(*names: str) -> list:
    """Text columns as they were: an empty text comes back missing from a CSV file."""
    return [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]


def q_write_factors(c: Context) -> DataFrame:
    parts = []
    for kind, robust in FACTOR_KINDS.items():
        path = landing_path(c.spark, "factors_csv")
        sinks.write_factors(c.factors(kind), path, kind, robust)
        parts.append(_back(c, path).select("file", "date", *factors.FACTOR_COLUMNS, *_text("measures_robust_bp", "bp"), "measure"))
    return rounded(_stacked(parts))


def _complete_nfirms(c: Context) -> DataFrame:
    """Tagged firm counts of the series that have all portfolios."""
    complete = returns.completeness_check(c.ptfs("2x3"), jobs.n_portfolios("2x3"), factors.FACTOR_KEYS)
    return jobs.tag(c.nfirms("2x3").join(complete, factors.FACTOR_KEYS, "left_semi"), ROBUST)


def q_write_factor_nfirms(c: Context) -> DataFrame:
    parts = []
    for kind, robust in FACTOR_KINDS.items():
        path = landing_path(c.spark, "nfirms_csv")
        counts = _complete_nfirms(c) if kind == "2x3" else jobs.tag(c.nfirms(kind), robust)
        sinks.write_factor_nfirms(counts, path, kind, robust)
        back = _back(c, path)
        cols = [(F.col(x) if x in back.columns else F.lit(None)).cast("bigint").alias(x) for x in diagnostics.NFIRMS_COLUMNS]  # 2x2 has no market
        parts.append(back.select("file", "jdate", *cols, *_text("measures_robust_bp", "bp"), "measure"))
    return _stacked(parts)


def _legend(c: Context) -> DataFrame:
    return jobs.measures_legend(c.inputs.measures)


def q_write_portfolios(c: Context) -> DataFrame:
    parts = []
    for kind in SORT_KINDS:
        path = landing_path(c.spark, "portfolios_csv")
        sinks.write_portfolios(jobs.with_index(c.excess(kind), _legend(c)), path, kind)
        parts.append(_back(c, path).select("file", "date", "ptf_code", "ret", "sort_on", "measure"))
    return _stacked(parts)


def q_write_portfolio_nfirms(c: Context) -> DataFrame:
    parts = []
    for kind in SORT_KINDS:
        path = landing_path(c.spark, "portfolio_nfirms_csv")
        sinks.write_portfolio_nfirms(jobs.with_index(diagnostics.portfolio_nfirms(c.ptfs(kind)), _legend(c)), path, kind)
        parts.append(_back(c, path).select("file", "date", "ptf_code", F.col("nfirms").cast("bigint").alias("nfirms"), "sort_on", "measure"))
    return _stacked(parts)


def q_write_legend(c: Context) -> DataFrame:
    parts = []
    for kind in SORT_KINDS:
        path = landing_path(c.spark, "legend_csv")
        sinks.write_legend(_legend(c), path, kind)
        parts.append(_back(c, path).select("file", "measure", "index"))
    return _stacked(parts)


# --- filters and flags ----------------------------------------------------------------------

def _pair_rows(df: DataFrame) -> DataFrame:
    return df.select(*PAIR)


def q_nyse_universe_nf(c: Context) -> DataFrame:
    return universe.nyse_universe_nf(align.attach_measure(c.full_panel)).select(*SERIES_PAIR)


def q_eligibility_flags(c: Context) -> DataFrame:
    return universe.eligibility_flags(c.inputs.chars).select(
        *PAIR, "is_size_ok", "is_beme_ok", "is_inv_ok", "is_op_ok")


def q_nf_eligibility_flag(c: Context) -> DataFrame:
    return universe.nf_eligibility_flag(align.attach_measure(c.panel.pairs)).select(*SERIES_PAIR, "is_nf_ok")


def q_drop_degenerate_measures(c: Context) -> DataFrame:
    return universe.drop_degenerate_measures(align.attach_measure(c.panel.pairs)).select(*SERIES_PAIR, "nf")


def q_min_distinct_guard(c: Context) -> DataFrame:
    return universe.min_distinct_guard(c.panel.long, breakpoints.NF_KEYS).select(*SERIES_PAIR, "nf")


def q_drop_unassigned(c: Context) -> DataFrame:
    return c.monthly("2x2").select(*SERIES_PAIR, *PORTS)


def q_require_all_assigned(c: Context) -> DataFrame:
    return universe.require_all_assigned(c.monthly("2x2x2x2x2"), PORTS).select(*SERIES_PAIR, *PORTS)


def q_null_label_cleanup(c: Context) -> DataFrame:
    labelled = c.assigned("2x2").select(*SERIES_PAIR, *[F.coalesce(p, F.lit("nan")).alias(p) for p in PORTS])
    return universe.null_label_cleanup(labelled, PORTS)


# --- joins ----------------------------------------------------------------------------------

def q_align_measures(c: Context) -> DataFrame:
    return tables.measures_long(align.align_measures(c.inputs.measures, c.inputs.chars))


def q_common_pairs(c: Context) -> DataFrame:
    return align.common_pairs(c.inputs.chars, c.inputs.measures).select("source_file", *PAIR, "exchcd", "me", "be", "op")


def q_attach_measure(c: Context) -> DataFrame:
    return align.attach_measure(c.full_panel).select(*SERIES_PAIR, "me", "beme", "nf")


def _flat_breaks(df: DataFrame, probs: tuple[float, ...], variables: tuple[str, ...] = ("bm", "inv", "op")) -> DataFrame:
    for v in variables:
        df = flat_edges(df, v, probs)
    return rounded(df)


def _breaks_2x3(c: Context) -> tuple[DataFrame, DataFrame]:
    return breakpoints.factor_breakpoints(c.panel.quantiles, False)


def q_combine_breakpoints(c: Context) -> DataFrame:
    chars_bp, _ = _breaks_2x3(c)
    combined = align.combine_breakpoints(calendar.formation_calendar(c.inputs.benchmark), chars_bp)
    return _flat_breaks(combined, config.SET_PROBS)


def q_align_breakpoints(c: Context) -> DataFrame:
    breaks = breakpoints.size_median(c.panel.pairs)
    return rounded(align.align_breakpoints(c.panel.long, breaks, ["source_file", "jdate"]).select(*SERIES_PAIR, "me", "sizemedn"))


def q_merge_assignments(c: Context) -> DataFrame:
    keys = ["source_file", *PAIR]
    edges = breakpoints.quintile_edges(c.panel.pairs)
    done = assign.assign_ntile_independent(align.align_breakpoints(c.panel.pairs, edges, ["source_file", "jdate"]))
    done = land(done.select(*keys, *NPORTS[:4]), "char_buckets")
    parts = {p: done.filter(F.col(p).isNotNull()).select(*keys, p) for p in NPORTS[:4]}
    return align.merge_assignments(c.panel.pairs.select(*keys), parts, keys)


def q_carry_forward(c: Context) -> DataFrame:
    return align.carry_forward(c.inputs.returns, c.june("2x2")).select(
        *SERIES, "permno", "jdate", "ffyear", "retadj", "wt", *PORTS)


def q_on_calendar(c: Context) -> DataFrame:
    market = returns.wavg_market_return(c.cube("2x2"))
    return rounded(align.on_calendar(market, c.inputs.benchmark, SERIES))


def q_compare_factors(c: Context) -> DataFrame:
    return rounded(_stacked([
        align.compare_factors(c.inputs.benchmark, c.factors(kind).drop("measures_robust_bp")).withColumn("kind", F.lit(kind)) for kind in FACTOR_KINDS]))


def q_compare_portfolios(c: Context) -> DataFrame:
    return rounded(_stacked([align.compare_portfolios(c.excess(kind), c.published(kind)) for kind in SORT_KINDS]))


# --- breakpoints ----------------------------------------------------------------------------

def q_char_breakpoints(c: Context) -> DataFrame:
    return _flat_breaks(breakpoints.char_breakpoints(c.panel.pairs), config.SET_PROBS)


def q_nf_breakpoints(c: Context) -> DataFrame:
    return _flat_breaks(breakpoints.nf_breakpoints(c.panel.long), config.SET_PROBS, ("nf",))


def q_quintile_edges(c: Context) -> DataFrame:
    return _flat_breaks(breakpoints.quintile_edges(c.panel.pairs), config.QUINTILE_PROBS, breakpoints.CHAR_VARS)


def q_size_half_edges(c: Context) -> DataFrame:
    return _flat_breaks(breakpoints.size_half_edges(c.panel.pairs), config.HALF_PROBS, ("size",))


def _sized(c: Context) -> DataFrame:
    edges = breakpoints.size_half_edges(c.panel.pairs)
    return assign.assign_size_half(align.align_breakpoints(c.panel.pairs, edges, ["source_file", "jdate"])).drop("size_edges")


def q_conditional_quartile_edges(c: Context) -> DataFrame:
    return _flat_breaks(breakpoints.conditional_quartile_edges(_sized(c)), config.QUARTILE_PROBS)


def q_nf_edges_epsilon(c: Context) -> DataFrame:
    edges = breakpoints.nf_edges_epsilon(c.panel.long, config.QUINTILE_PROBS)
    for i, p in enumerate(config.QUINTILE_PROBS):
        edges = edges.withColumn(f"nf{round(p * 100)}", F.round(F.get("nf_edges", F.lit(i)), 13))
    return edges.drop("nf_edges")


# --- assignment -----------------------------------------------------------------------------

def q_assign_3way_robust(c: Context) -> DataFrame:
    return c.assigned("2x3", ROBUST).select(
        *SERIES_PAIR, "szport", "bmport", "opport", "invport", *[f"nfport_{bp}" for bp in config.BP_SETS])


# --- portfolios -----------------------------------------------------------------------------

def q_sort_combinations(c: Context) -> DataFrame:
    sorts = {"bivariate": config.bivariate_sorts(), "three_way": config.threeway_sorts()}
    return _stacked([
        c.ptfs(kind).filter(F.col("sort_on").isin(returns.sort_combinations(own))).groupBy("sort_on")
        .agg(F.sum("n_rows").alias("n_rows"), F.count_distinct("ptf_code").alias("n_cells")) for kind, own in sorts.items()])


def q_select_bp_columns(c: Context) -> DataFrame:
    return _stacked([returns.select_bp_columns(c.cube("2x3", ROBUST), bp, ROBUST).select(*PAIR_KEYS, *PORTS, "n_rows", "n_ret")
                     for bp in config.evaluated_sets(ROBUST)])


def q_melt_buckets(c: Context) -> DataFrame:
    melted = returns.melt_buckets(returns.select_bp_columns(c.cube("2x2"), "", ()))
    return melted.select(*SERIES, "jdate", "szport", "variable", "value", "n_rows", "n_wt")


def _vw(c: Context, kind: str, keys: list[str]) -> DataFrame:
    # products of a six-decimal return and a two-decimal weight have eight decimals
    return rounded(c.ptfs(kind).select(
        *keys, F.round("retadj_x_wt", 8).alias("retadj_x_wt"), F.round("wt", 4).alias("wt"), "vwret"))


def q_portfolio_code(c: Context) -> DataFrame:
    pairs = returns.melt_buckets(returns.select_bp_columns(c.cube("2x2"), "", ()))
    five = universe.require_all_assigned(c.cube("2x2x2x2x2"), PORTS)
    kinds = [pairs.select(*SERIES, "jdate", returns.portfolio_code("pair").alias("ptf_code"), "n_rows"),
             five.select(*SERIES, "jdate", returns.portfolio_code("five").alias("ptf_code"), "n_rows")]
    for kind, sorts in (("bivariate", config.bivariate_sorts()), ("three_way", config.threeway_sorts())):
        for sort in sorts:
            cells = universe.require_all_assigned(c.cube(kind), [config.ntile_port(m) for m in sort])
            kinds.append(cells.select(*SERIES, "jdate", returns.portfolio_code("sort", sort).alias("ptf_code"), "n_rows"))
    return (_stacked(kinds)
            .groupBy(*SERIES, "jdate", "ptf_code").agg(F.sum("n_rows").alias("n_rows")))


def q_pivot_portfolios(c: Context) -> DataFrame:
    return rounded(returns.pivot_portfolios(c.ptfs("2x2x2x2x2"), config.FIVE_CODES, [*SERIES, "jdate"]))


def q_completeness_check(c: Context) -> DataFrame:
    checked = []
    for kind in ("2x3", "2x2", "2x2x2x2x2"):
        n = jobs.n_portfolios(kind)
        checked.append(returns.completeness_check(c.ptfs(kind), n, factors.FACTOR_KEYS).withColumn("kind", F.lit(kind)))
    return checked[0].unionByName(checked[1]).unionByName(checked[2])


def q_fill_missing_cells(c: Context) -> DataFrame:
    after = returns.fill_missing_cells(c.ptfs("2x2"), c.inputs.benchmark, config.PAIR_CODES_2, SERIES, True)
    before = returns.fill_missing_cells(c.ptfs("2x2x2x2x2"), c.inputs.benchmark, config.FIVE_CODES, SERIES, False)
    cols = [*SERIES, "jdate", "ptf_code", "vwret"]
    return rounded(after.select(*cols).unionByName(before.select(*cols)))


def q_portfolios_long(c: Context) -> DataFrame:
    keys = [*SERIES, "jdate"]
    codes = {"bivariate": [f"{a}{i}_{b}{j}" for a, b in config.bivariate_sorts() for i, j in CELLS],
             "three_way": ["_".join(f"{m}{i}" for m, i in zip(sort, cell)) for sort in config.threeway_sorts()
                           for cell in product(*[range(1, 3 if m == "size" else 5) for m in sort])]}
    long = _stacked([returns.portfolios_long(returns.pivot_portfolios(c.ptfs(kind), own, keys), own, keys) for kind, own in codes.items()])
    long = long.withColumn("sort_on", F.regexp_replace("ptf_code", r"\d", ""))
    return rounded(jobs.with_index(long, _legend(c)))


# --- factors --------------------------------------------------------------------------------

def _factor(f: Callable, kind: str) -> Callable[[Context], DataFrame]:
    return lambda c: rounded(f(c.ptfs(kind), c.inputs.benchmark))


# --- diagnostics ----------------------------------------------------------------------------

def q_portfolio_nfirms(c: Context) -> DataFrame:
    return diagnostics.portfolio_nfirms(c.ptfs("bivariate")).unionByName(diagnostics.portfolio_nfirms(c.ptfs("three_way")))


def q_portfolio_coverage_pct(c: Context) -> DataFrame:
    done = [diagnostics.portfolio_coverage_pct(diagnostics.portfolio_nfirms(c.ptfs(k)), c.cube(k))
            for k in ("bivariate", "three_way")]
    return rounded(done[0].unionByName(done[1]), 6)


def q_factor_coverage_pct(c: Context) -> DataFrame:
    parts = [diagnostics.factor_coverage_pct(c.nfirms(kind), c.cube(kind, robust)).withColumn("kind", F.lit(kind)) for kind, robust in FACTOR_KINDS.items()]
    parts = [p if "Mkt-RF" in p.columns else p.withColumn("Mkt-RF", F.lit(None).cast("double")) for p in parts]
    return rounded(_stacked(parts), 6)


def q_factor_correlations(c: Context) -> DataFrame:
    return rounded(_stacked([
        diagnostics.factor_correlations(align.compare_factors(c.inputs.benchmark, c.factors(kind))).withColumn("kind", F.lit(kind)) for kind in FACTOR_KINDS]), 8)


def q_portfolio_correlations(c: Context) -> DataFrame:
    done = [diagnostics.portfolio_correlations(align.compare_portfolios(c.excess(k), c.published(k)))
            for k in ("bivariate", "three_way")]
    return rounded(done[0].unionByName(done[1]), 8)


def q_date_range_summary(c: Context) -> DataFrame:
    return _stacked([diagnostics.date_range_summary(c.excess(kind), [*SERIES, "sort_on"], F.count_distinct("ptf_code")) for kind in SORT_KINDS])


def q_misassigned_check(c: Context) -> DataFrame:
    return _stacked([diagnostics.misassigned_check(c.assigned(kind)).withColumn("kind", F.lit(kind)) for kind in SORT_KINDS])


# --- jobs -----------------------------------------------------------------------------------

def _tagged_factors(c: Context) -> DataFrame:
    return rounded(c.factors("2x3").select("date", *factors.FACTOR_COLUMNS, "measures_robust_bp", "bp", *SERIES))


def _job_factors(kind: str, robust: tuple[str, ...]) -> Callable[[Context], DataFrame]:
    def run(c: Context) -> DataFrame:
        result = jobs.job_factors(c.inputs, kind, robust)
        return rounded(result.factors.select("date", *factors.FACTOR_COLUMNS, "measures_robust_bp", "bp", *SERIES))
    return run


def _job_sorts(job: Callable) -> Callable[[Context], DataFrame]:
    return lambda c: rounded(job(c.inputs).portfolios)


def _colocated(c: Context) -> jobs.Inputs:
    """The inputs with the returns read from a store, written once a session."""
    if not hasattr(c, "store"):
        c.store = landing_path(c.spark, "returns-store")
        store.write_returns_store(c.inputs.returns, c.store, STORE_BUCKETS)
    stored, buckets = store.open_returns_store(c.spark, c.store)
    return replace(c.inputs, returns=stored, return_buckets=buckets)


def q_factors_2x2_colocated(c: Context) -> DataFrame:
    return rounded(jobs.job_factors_2x2(_colocated(c)).factors)


def q_portfolios_bivariate_colocated(c: Context) -> DataFrame:
    return rounded(jobs.job_bivariate_portfolios(_colocated(c)).portfolios)


def q_factors_2x3_increments(c: Context) -> DataFrame:
    """Two updates: up to a June in the middle, then the rest."""
    at = landing_path(c.spark, "increments")
    for until in (datetime.date(1998, 6, 30), None):
        increments.update(c.inputs, at, "2x3", ROBUST, until)
    return rounded(increments.factors(c.spark, at, c.inputs.benchmark, "2x3", ROBUST).factors)


def q_exact_sums(c: Context) -> DataFrame:
    """Sums of products that no decimal holds, over all line items and by part."""
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * 0.7390851332151607
    rows = c.spark.read.parquet(f"{c.sf_dir}/lineitem.parquet").select("l_partkey", paid.alias("paid"))
    sums = [F.round(exact_sum(F.col("paid")), 5).alias("paid"), F.count("*").alias("n")]
    return rows.groupBy("l_partkey").agg(*sums).unionByName(rows.groupBy(F.lit(None).cast("bigint").alias("l_partkey")).agg(*sums))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess returns of the 5x5 test portfolios of every sort and measure."""
    return _job_sorts(jobs.job_bivariate_portfolios)(context(spark, sf_dir))


OPERATORS: dict[str, Callable[[Context], DataFrame]] = {
    # sources, parsing, calendar
    "read_returns": q_read_returns,
    "read_characteristics": q_read_characteristics,
    "read_measures": q_read_measures,
    "parse_benchmark_factors": q_parse_benchmark_factors,
    "parse_benchmark_portfolios": q_parse_benchmark_portfolios,
    "clip_to_window": q_clip_to_window,
    "normalise_portfolio_codes": q_normalise_portfolio_codes,
    "benchmark_long": q_benchmark_long,
    "month_end": q_month_end,
    "formation_calendar": lambda c: calendar.formation_calendar(c.inputs.benchmark),
    "formation_year": q_formation_year,
    # sinks
    "write_factors": q_write_factors,
    "write_factor_nfirms": q_write_factor_nfirms,
    "write_portfolios": q_write_portfolios,
    "write_portfolio_nfirms": q_write_portfolio_nfirms,
    "write_legend": q_write_legend,
    # projections, filters, predicates
    "nyse_universe_size": lambda c: _pair_rows(universe.nyse_universe_size(c.inputs.chars)),
    "nyse_universe_bm": lambda c: _pair_rows(universe.nyse_universe_bm(c.inputs.chars)),
    "nyse_universe_inv": lambda c: _pair_rows(universe.nyse_universe_inv(c.inputs.chars)),
    "nyse_universe_op": lambda c: _pair_rows(universe.nyse_universe_op(c.inputs.chars)),
    "nyse_universe_nf": q_nyse_universe_nf,
    "eligibility_flags": q_eligibility_flags,
    "nf_eligibility_flag": q_nf_eligibility_flag,
    "drop_degenerate_measures": q_drop_degenerate_measures,
    "min_distinct_guard": q_min_distinct_guard,
    "drop_unassigned": q_drop_unassigned,
    "require_all_assigned": q_require_all_assigned,
    "null_label_cleanup": q_null_label_cleanup,
    # joins
    "align_measures": q_align_measures,
    "common_pairs": q_common_pairs,
    "attach_measure": q_attach_measure,
    "combine_breakpoints": q_combine_breakpoints,
    "align_breakpoints": q_align_breakpoints,
    "merge_assignments": q_merge_assignments,
    "carry_forward": q_carry_forward,
    "on_calendar": q_on_calendar,
    "compare_factors": q_compare_factors,
    "compare_portfolios": q_compare_portfolios,
    # breakpoints
    "size_median": lambda c: rounded(breakpoints.size_median(c.panel.pairs)),
    "char_breakpoints": q_char_breakpoints,
    "nf_breakpoints": q_nf_breakpoints,
    "char_medians": lambda c: rounded(breakpoints.char_medians(c.panel.pairs)),
    "nf_median": lambda c: rounded(breakpoints.nf_median(c.panel.long)),
    "quintile_edges": q_quintile_edges,
    "size_half_edges": q_size_half_edges,
    "conditional_quartile_edges": q_conditional_quartile_edges,
    "nf_edges_epsilon": q_nf_edges_epsilon,
    # bucket assignment
    "assign_size_2": lambda c: c.assigned("2x3").select(*SERIES_PAIR, "szport"),
    "assign_2way": lambda c: c.assigned("2x2").select(*SERIES_PAIR, *PORTS[1:]),
    "assign_3way": lambda c: c.assigned("2x3").select(*SERIES_PAIR, *PORTS[1:]),
    "assign_3way_robust": q_assign_3way_robust,
    "assign_ntile_independent": lambda c: c.assigned("bivariate").select(*SERIES_PAIR, *NPORTS[:4]),
    "assign_nf_ntile": lambda c: c.assigned("bivariate").select(*SERIES_PAIR, "nfport"),
    "assign_size_half": lambda c: _sized(c).select("source_file", *PAIR, "sizeport"),
    "assign_ntile_dependent": lambda c: c.assigned("three_way").select(*SERIES_PAIR, *NPORTS[:4]),
    "assign_nf_ntile_dependent": lambda c: c.assigned("three_way").select(*SERIES_PAIR, "nfport"),
    "june_assignments": lambda c: c.june("2x2"),
    # portfolio returns
    "sort_combinations": q_sort_combinations,
    "select_bp_columns": q_select_bp_columns,
    "melt_buckets": q_melt_buckets,
    "vw_return_2x3": lambda c: _vw(c, "2x3", [*PAIR_KEYS, "szport", "value", "variable", "ptf_code"]),
    "vw_return_2x2": lambda c: _vw(c, "2x2", [*SERIES, "jdate", "szport", "value", "variable", "ptf_code"]),
    "vw_return_5way": lambda c: _vw(c, "2x2x2x2x2", [*SERIES, "jdate", *PORTS, "ptf_code"]),
    "vw_return_bivariate": lambda c: _vw(c, "bivariate", [*SERIES, "sort_on", "jdate", "ptf_code"]),
    "vw_return_threeway": lambda c: _vw(c, "three_way", [*SERIES, "sort_on", "jdate", "ptf_code"]),
    "portfolio_code": q_portfolio_code,
    "pivot_portfolios": q_pivot_portfolios,
    "completeness_check": q_completeness_check,
    "fill_missing_cells": q_fill_missing_cells,
    "excess_returns": lambda c: rounded(c.excess("bivariate")),
    "wavg_market_return": lambda c: rounded(returns.wavg_market_return(c.cube("2x2"))),
    "market_excess": lambda c: rounded(returns.market_excess(c.cube("2x2"), c.inputs.benchmark)),
    "portfolios_long": q_portfolios_long,
    # factors
    "hml_2x3": _factor(factors.hml_2x3, "2x3"),
    "cma_2x3": _factor(factors.cma_2x3, "2x3"),
    "rmw_2x3": _factor(factors.rmw_2x3, "2x3"),
    "xmy_2x3": _factor(factors.xmy_2x3, "2x3"),
    "smb_parts_2x3": _factor(factors.smb_parts_2x3, "2x3"),
    "smb_2x3": _factor(factors.smb_2x3, "2x3"),
    "hml_cma_rmw_xmy_2x2": _factor(factors.hml_cma_rmw_xmy_2x2, "2x2"),
    "smb_2x2": _factor(factors.smb_2x2, "2x2"),
    "factors_2x2x2x2x2": _factor(factors.factors_2x2x2x2x2, "2x2x2x2x2"),
    "factor_table": lambda c: rounded(c.factors("2x2x2x2x2").select("date", *factors.FACTOR_COLUMNS, *SERIES)),
    # diagnostics
    "measure_coverage_summary": lambda c: diagnostics.measure_coverage_summary(align.attach_measure(c.panel.pairs)),
    "common_pair_count": lambda c: diagnostics.common_pair_count(c.panel.pairs),
    "missing_pct": lambda c: rounded(diagnostics.missing_pct(c.panel.long)),
    "good_measure_counts": lambda c: diagnostics.good_measure_counts(c.panel.long),
    "good_measure_pct": lambda c: rounded(diagnostics.good_measure_pct(c.panel.long)),
    "size_nf_cell_counts": lambda c: diagnostics.size_nf_cell_counts(c.june("2x3")),
    "portfolio_group_count": lambda c: diagnostics.portfolio_group_count(c.june("2x2x2x2x2")),
    "portfolios_per_date": lambda c: diagnostics.portfolios_per_date(c.ptfs("bivariate")),
    "misassigned_check": q_misassigned_check,
    "factor_nfirms_2x3": lambda c: c.nfirms("2x3"),
    "factor_nfirms_2x2": lambda c: c.nfirms("2x2").drop("bp"),
    "factor_nfirms_5way": lambda c: c.nfirms("2x2x2x2x2").drop("bp"),
    "factor_coverage_pct": q_factor_coverage_pct,
    "portfolio_nfirms": q_portfolio_nfirms,
    "portfolio_coverage_pct": q_portfolio_coverage_pct,
    "factor_correlations": q_factor_correlations,
    "portfolio_correlations": q_portfolio_correlations,
    "date_range_summary": q_date_range_summary,
    # assembly and end-to-end jobs
    "tag_and_union_factors": _tagged_factors,
    "tag_and_union_nfirms": _complete_nfirms,
    "measures_legend": _legend,
    "stack_portfolios": lambda c: rounded(jobs.with_index(c.excess("three_way"), _legend(c))),
    "job_factors_2x3": _job_factors("2x3", ROBUST),
    "job_factors_2x3_default_sets": _job_factors("2x3", ()),
    "job_factors_2x3_all_robust": _job_factors("2x3", config.MEASURES),
    "job_factors_2x2": _job_factors("2x2", ()),
    "job_factors_2x2x2x2x2": _job_factors("2x2x2x2x2", ()),
    "job_factors_2x2_colocated": q_factors_2x2_colocated,
    "job_factors_2x3_increments": q_factors_2x3_increments,
    "job_bivariate_portfolios": _job_sorts(jobs.job_bivariate_portfolios),
    "job_bivariate_portfolios_colocated": q_portfolios_bivariate_colocated,
    "exact_sums": q_exact_sums,
    "job_threeway_portfolios": _job_sorts(jobs.job_threeway_portfolios),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(op: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: op(context(spark, sf_dir))

    return {name: bind(op) for name, op in OPERATORS.items()} | panel_queries.queries()
