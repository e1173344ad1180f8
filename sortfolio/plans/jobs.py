"""End-to-end jobs: from the input tables to factor tables and test portfolios.

Files, measures, breakpoint sets and sorts are columns, so one job handles all of them.  The
panel, the breakpoints and the monthly sums are landed: each is read several times, and every
landed table is small enough to be joined without shuffling its larger partner, or is the
deliberate end of a heavy shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortfolio.landing import land
from sortfolio.operators import align, assign, breakpoints, diagnostics, factors, returns, universe
from sortfolio.operators.align import SERIES
from sortfolio.plans import config
from sortfolio.sources.calendar import formation_calendar

CHARS = ["bm", "op", "inv"]
MEDIAN_KINDS = ("2x2", "2x2x2x2x2")


@dataclass
class Inputs:
    returns: DataFrame
    chars: DataFrame
    measures: DataFrame  # source_file, permno, jdate, values
    benchmark: DataFrame
    return_buckets: int | None = None  # of returns stored by (permno, ffyear), see sortfolio.sources.store


@dataclass
class Panel:
    pairs: DataFrame  # one row per file, permno and June, landed
    totals: DataFrame  # one row per (file, measure), landed

    benchmark: DataFrame
    returns: DataFrame
    return_buckets: int | None = None
    every: bool = False  # keep series that are all zero or missing
    _cubes: dict = field(default_factory=dict)

    @property
    def usable(self) -> DataFrame:
        """Series that are not all zero or missing."""
        return self.totals.select(*SERIES) if self.every else universe.usable_measures(self.totals)

    @property
    def legend(self) -> DataFrame:
        return self.totals.select(*SERIES, "index")

    @cached_property
    def series(self) -> DataFrame:
        """All series with their numbers, landed: a small table."""
        return land(returns.numbered_series(self.totals), "series")

    @property
    def long(self) -> DataFrame:
        """One row per pair and usable measure."""
        return self.explode(self.pairs)

    @cached_property
    def quantiles(self) -> DataFrame:
        """Quantiles of every independent sort, landed once for all jobs."""
        return breakpoints.all_quantiles(self.pairs, self.long, breakpoints.CHAR_VARS, ["source_file", "jdate"],
                                         breakpoints.INDEPENDENT_PROBS)

    def cube(self, kind: str, robust: tuple[str, ...] = ()) -> DataFrame:
        """Landed monthly sums of a sort; the two median sorts have the same buckets and share one."""
        key = ("median" if kind in MEDIAN_KINDS else kind, robust)
        if key not in self._cubes:
            domains = sort_domains(kind, robust)
            june = assign.june_assignments(assignments(self, kind, robust), list(domains))
            self._cubes[key] = land(returns.monthly_cube(self.returns, june, domains, self.return_buckets, self.series), "cube")
        return self._cubes[key]

    def explode(self, pairs: DataFrame) -> DataFrame:
        long = universe.drop_degenerate_measures(align.attach_measure(pairs), self.usable)
        return universe.nf_eligibility_flag(long)


class PreparedPanel(Panel):
    """A panel that asks its inputs for the returns and the published months when a step reads them."""

    def __init__(self, pairs: DataFrame, totals: DataFrame, inputs: Inputs):
        self.pairs, self.totals, self.inputs = pairs, totals, inputs
        self.return_buckets, self._cubes = inputs.return_buckets, {}

    @property
    def benchmark(self) -> DataFrame:
        return self.inputs.benchmark

    @property
    def returns(self) -> DataFrame:
        return self.inputs.returns


@dataclass
class FactorResult:
    factors: DataFrame
    nfirms: DataFrame
    cube: DataFrame
    portfolios: DataFrame


@dataclass
class PortfolioResult:
    portfolios: DataFrame
    nfirms: DataFrame
    legend: DataFrame
    cube: DataFrame
    sorts: DataFrame


PANEL_VALUES = ["me", "beme", "inv", "op"]


def prepare_panel(inputs: Inputs, validate: bool = True) -> Panel:
    """Aligned pairs with flags; the raw inputs of the flags are not carried on, nor shuffled."""
    flagged = universe.universe_flags(universe.eligibility_flags(inputs.chars))
    flags = [c for c in flagged.columns if c.startswith(("is_", "u_"))]
    pairs = align.build_panel(flagged.select(*align.PAIR, *PANEL_VALUES, *flags), inputs.measures)
    pairs = land(pairs.select("source_file", *align.PAIR, "ffyear", *PANEL_VALUES, *flags, "values"), "panel")
    if validate:  # a repeated pair on either side of the alignment shows up here
        universe.require_unique(pairs, ["source_file", *align.PAIR], "characteristics or measures")
    totals = land(universe.measure_totals(align.attach_measure(pairs)), "totals")
    return PreparedPanel(pairs, totals, inputs)


def sort_domains(kind: str, robust: tuple[str, ...] = ()) -> dict:
    """Bucket columns of a sort and their values."""
    if kind == "bivariate":
        return assign.ntile_domains(5, 5)
    if kind == "three_way":
        return assign.ntile_domains(2, 4)
    return assign.factor_domains(robust, kind in MEDIAN_KINDS)


def assignments(panel: Panel, kind: str, robust: tuple[str, ...] = ()) -> DataFrame:
    """Panel rows per measure with every bucket of a sort."""
    if kind == "bivariate":
        return independent_assignments(panel)
    if kind == "three_way":
        return dependent_assignments(panel)
    return factor_assignments(panel, kind, robust)


def factor_assignments(panel: Panel, kind: str, robust: tuple[str, ...] = ()) -> DataFrame:
    two_by_two = kind in MEDIAN_KINDS
    chars_bp, nf_bp = breakpoints.factor_breakpoints(panel.quantiles, two_by_two)
    chars_bp = align.combine_breakpoints(formation_calendar(panel.benchmark), chars_bp)
    sized = assign.assign_size_2(align.align_breakpoints(panel.pairs, chars_bp, ["source_file", "jdate"]))
    split = assign.assign_2way if two_by_two else (lambda df, ms: assign.assign_3way_robust(df, ms, robust))
    done = split(sized, CHARS).drop("sizemedn", "bm_edges", "inv_edges", "op_edges")
    long = align.align_breakpoints(panel.explode(done), nf_bp, breakpoints.NF_KEYS)
    return split(long, ["nf"]).drop("nf_edges")


def job_factors(inputs: Inputs, kind: str, robust: tuple[str, ...] = (), panel: Panel | None = None) -> FactorResult:
    panel = panel or prepare_panel(inputs)
    return factor_result(panel.cube(kind, robust), inputs.benchmark, kind, robust)


def factor_result(cube: DataFrame, benchmark: DataFrame, kind: str, robust: tuple[str, ...] = ()) -> FactorResult:
    """Tables of a factor job from its monthly sums."""
    if kind == "2x3":
        ptfs, nfirms = returns.vw_return_2x3(cube, robust), diagnostics.factor_nfirms_2x3(cube, benchmark, robust)
    elif kind == "2x2":
        ptfs, nfirms = returns.vw_return_2x2(cube), diagnostics.factor_nfirms_2x2(cube, benchmark)
    else:
        ptfs, nfirms = returns.vw_return_5way(cube), diagnostics.factor_nfirms_5way(cube, benchmark)
    ptfs = land(ptfs, "portfolios")
    table = factors.factor_table(ptfs, cube, benchmark, kind)
    complete = returns.completeness_check(ptfs, n_portfolios(kind), factors.FACTOR_KEYS)
    nfirms = nfirms.join(complete, factors.FACTOR_KEYS, "left_semi")
    return FactorResult(tag(table, robust), tag(nfirms, robust), cube, ptfs)


def n_portfolios(kind: str) -> int:
    return {"2x3": len(config.PAIR_CODES_3), "2x2": len(config.PAIR_CODES_2), "2x2x2x2x2": len(config.FIVE_CODES)}[kind]


def tag(table: DataFrame, robust: tuple[str, ...]) -> DataFrame:
    """Adds the list of measures with alternative breakpoints; set and measure are columns already."""
    return table.withColumn("measures_robust_bp", F.lit("_".join(robust)))


def job_factors_2x3(inputs: Inputs, robust: tuple[str, ...] = ("nf",), panel: Panel | None = None) -> FactorResult:
    return job_factors(inputs, "2x3", robust, panel)


def job_factors_2x2(inputs: Inputs, panel: Panel | None = None) -> FactorResult:
    return job_factors(inputs, "2x2", (), panel)


def job_factors_2x2x2x2x2(inputs: Inputs, panel: Panel | None = None) -> FactorResult:
    return job_factors(inputs, "2x2x2x2x2", (), panel)


def independent_assignments(panel: Panel, n: int = 5) -> DataFrame:
    """Panel rows per measure with independent n-tile buckets."""
    keys = ["source_file", "jdate"]
    chars_bp, nf_bp = breakpoints.ntile_breakpoints(
        panel.quantiles, breakpoints.CHAR_VARS, config.QUINTILE_PROBS, keys)
    done = assign.assign_ntile_independent(align.align_breakpoints(panel.pairs, chars_bp, keys), n)
    return assign.assign_nf_ntile(align.align_breakpoints(panel.explode(done), nf_bp, breakpoints.NF_KEYS), n)


def dependent_assignments(panel: Panel, n: int = 4) -> DataFrame:
    """Panel rows per measure with size halves and n-tile buckets inside each half."""
    keys = ["source_file", "jdate"]
    medians, _ = breakpoints.factor_breakpoints(panel.quantiles, True)
    size_bp = medians.select(*keys, F.array("sizemedn").alias("size_edges"))
    sized = assign.assign_size_half(align.align_breakpoints(panel.pairs, size_bp, keys)).drop("size_edges")
    inside = sized.filter(F.col("sizeport").isNotNull())
    keys = ["source_file", "jdate", "sizeport"]
    quantiles = breakpoints.all_quantiles(
        inside, panel.explode(inside), CHARS, keys, breakpoints.DEPENDENT_PROBS)
    chars_bp, nf_bp = breakpoints.ntile_breakpoints(quantiles, CHARS, config.QUARTILE_PROBS, keys)
    done = assign.assign_ntile_dependent(align.align_breakpoints(sized, chars_bp, keys), n)
    long = align.align_breakpoints(panel.explode(done), nf_bp, ["measure", *keys])
    return assign.assign_nf_ntile_dependent(long, n)


def job_sorts(inputs: Inputs, panel: Panel, kind: str) -> PortfolioResult:
    return sort_result(panel.cube(kind), panel.legend, inputs.benchmark, kind)


def sort_result(cube: DataFrame, legend: DataFrame, benchmark: DataFrame, kind: str) -> PortfolioResult:
    """Tables of a portfolio job from its monthly sums."""
    if kind == "bivariate":
        cells, n_cells = returns.vw_return_bivariate(cube, config.bivariate_sorts()), 25
    else:
        cells, n_cells = returns.vw_return_threeway(cube, config.threeway_sorts()), 32
    cells = returns.keep_complete(land(cells, "sorts"), n_cells, [*SERIES, "sort_on"])
    return PortfolioResult(
        with_index(returns.excess_returns(cells, benchmark), legend),
        with_index(diagnostics.portfolio_nfirms(cells), legend), legend, cube, cells)


def job_bivariate_portfolios(inputs: Inputs, panel: Panel | None = None) -> PortfolioResult:
    return job_sorts(inputs, panel or prepare_panel(inputs), "bivariate")


def job_threeway_portfolios(inputs: Inputs, panel: Panel | None = None) -> PortfolioResult:
    return job_sorts(inputs, panel or prepare_panel(inputs), "three_way")


def measures_legend(measures: DataFrame) -> DataFrame:
    """1-based position of every measure in its file; all rows of a file carry the same names."""
    return (measures.groupBy("source_file").agg(F.max("values.measure").alias("names"))
            .select("source_file", F.posexplode("names").alias("pos", "measure"))
            .select("source_file", "measure", (F.col("pos") + 1).alias("index")))


def with_index(table: DataFrame, legend: DataFrame) -> DataFrame:
    """Adds the measure's position in its file as ``measure_index``."""
    return table.join(legend.withColumnRenamed("index", "measure_index"), SERIES)
