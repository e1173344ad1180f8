"""Value-weighted portfolio returns.

Every output of a job needs sums over some of the bucket columns, so the monthly rows are summed
once by all of them (:func:`monthly_cube`, combined on the map side to at most months x cells
rows); the sorts, the market return and the firm counts are sums over that small table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortfolio.functions.columns import all_not_null, any_not_null, guarded_ratio
from sortfolio.functions.sums import exact_sum
from sortfolio.operators.align import SERIES, carry_forward, series_calendar
from sortfolio.plans.config import (
    DEFAULT_SET, FIVE_ORDER, MEASURES, SORT_MEASURES, evaluated_sets, ntile_port, port,
)

EXACT = ("retadj_x_wt", "wt")  # doubles, summed alike in any order
CUBE_SUMS = ["retadj_x_wt", "wt", "n_ret", "n_wt", "n_both", "n_rows"]


def cell_layout(domains: dict[str, Sequence]) -> dict[str, tuple[int, int]]:
    """First bit and width of every bucket column in the packed number; 0 stands for a missing bucket."""
    layout, at = {}, 0
    for c, labels in domains.items():
        if isinstance(labels, range) and labels and labels[0] != 1:
            raise ValueError(f"buckets of {c} must be numbered from 1")
        width = len(labels).bit_length()
        layout[c] = (at, width)
        at += width
    if at > 63:
        raise ValueError(f"the buckets of {list(domains)} need {at} bits, more than the 63 of one number")
    return layout


def pack_buckets(june: DataFrame, domains: dict[str, Sequence]) -> DataFrame:
    """All buckets of a row as one number ``cell``; a bucket outside its domain is an error.

    The wide join and the aggregation then move one number instead of a column per sort.
    """
    layout, cell = cell_layout(domains), F.lit(0).cast("bigint")
    for c, labels in domains.items():
        # array_position reads the bucket once; a chain of comparisons would copy its expression
        index = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col(c))
        error = F.raise_error(F.concat(F.lit(f"{c} has no bucket "), F.col(c).cast("string")))
        # bound once: copies of all buckets in one method make it too large for the JVM to compile
        known = F.transform(F.array(index), _known_or(error))[0]
        cell = cell.bitwiseOR(F.shiftleft(known.cast("bigint"), layout[c][0]))
    return june.select(*SERIES, "permno", "ffyear", cell.alias("cell"))


def _known_or(error: Column) -> Callable[[Column], Column]:
    """A place in a domain, 0 for a missing bucket; place 0 of a bucket that is there is an error."""
    return lambda i: F.when(i == 0, error).otherwise(F.coalesce(i, F.lit(0)))


def unpack_buckets(df: DataFrame, domains: dict[str, Sequence]) -> DataFrame:
    layout, buckets = cell_layout(domains), []
    for c, labels in domains.items():
        at, width = layout[c]
        index = F.shiftright("cell", at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).cast("int")
        if isinstance(labels, range):
            buckets.append(F.nullif(index, F.lit(0)).alias(c))
        else:
            buckets.append(F.get(F.array(*[F.lit(label) for label in labels]), index - 1).alias(c))
    return df.select(*buckets, *[c for c in df.columns if c != "cell"])


def _dealt(packed: DataFrame, buckets: int | None) -> DataFrame:
    """Rows dealt by the keys of the monthly join, which then needs no further shuffle of this side; ``buckets`` deals them as
    returns stored in so many buckets are."""
    return packed.repartition(buckets, "permno", "ffyear") if buckets else packed.repartition("permno", "ffyear")


def june_cells(packed: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per (file, permno, formation year) with the packed buckets of all its measures as one array.

    The array holds one entry per measure of the file.
    """
    return (_dealt(packed, buckets).groupBy("permno", "ffyear", "source_file")
            .agg(F.collect_list(F.struct("measure", "cell")).alias("cells")))


def numbered_series(series: DataFrame) -> DataFrame:
    """One row per series with a number ``series``, the same whenever it is computed."""
    return series.select(*SERIES).distinct().withColumn("series", F.row_number().over(Window.orderBy(*SERIES)))


def monthly_cube(returns: DataFrame, june: DataFrame, domains: dict[str, Sequence], buckets: int | None = None,
                 series: DataFrame | None = None) -> DataFrame:
    """Sums and counts per series, month and combination of buckets; rows without any bucket drop out.

    Both sides of the join grow with the data: neither is broadcast.  Series travel and are grouped as numbers, two
    names in every key cost more than the sums; ``series`` is the small table of them, if it is at hand
    (:func:`numbered_series`).  A monthly row multiplies by the measures only in the join, right before the map-side sums.
    """
    names = numbered_series(june) if series is None else series
    packed = pack_buckets(june.filter(any_not_null(list(domains))), domains)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")) for c in SERIES]
    # numbered after the shuffle: next to the packing, both would be one method that the JVM compiles badly
    cells = _dealt(packed, buckets).alias("p").join(names.alias("n"), same).select("permno", "ffyear", "series", "cell")
    both = F.col("retadj") * F.col("wt")
    joined = carry_forward(returns, cells.hint("merge")).filter(F.col("cell").isNotNull())
    cube = joined.groupBy("series", "jdate", "cell").agg(
        exact_sum(both).alias("retadj_x_wt"), exact_sum(F.col("wt")).alias("wt"),
        F.count("retadj").alias("n_ret"), F.count("wt").alias("n_wt"),
        F.count(both).alias("n_both"), F.count(F.lit(1)).alias("n_rows"))
    return unpack_buckets(cube.join(names, "series").select(*SERIES, "jdate", "cell", *CUBE_SUMS), domains)


def _sums() -> list[Column]:
    return [(exact_sum(F.col(c)) if c in EXACT else F.sum(c)).alias(c) for c in CUBE_SUMS]


def vwret() -> Column:
    return guarded_ratio(F.col("retadj_x_wt"), F.col("wt"))


def bp_view(cube: DataFrame, bp: str, robust: tuple[str, ...]) -> DataFrame:
    """The cube with the buckets of one breakpoint set under their plain names."""
    names = {m: f"{port(m)}_{bp}" if m in robust else port(m) for m in MEASURES}
    keep = [c for c in cube.columns if not c.startswith(tuple(port(m) for m in MEASURES))]
    return cube.select(*keep, *[F.col(c).alias(port(m)) for m, c in names.items()], F.lit(bp).alias("bp"))


def select_bp_columns(cube: DataFrame, bp: str, robust: tuple[str, ...]) -> DataFrame:
    """As :func:`bp_view` without the rows that have no bucket in the set."""
    return bp_view(cube, bp, robust).filter(any_not_null(["szport"] + [port(m) for m in MEASURES]))


def melt_buckets(df: DataFrame, ports: Sequence[str] = tuple(port(m) for m in MEASURES)) -> DataFrame:
    """One row per bucket column (variable, value); rows without size or value drop out."""
    ids = [c for c in df.columns if c not in ports]
    return (df.unpivot(ids, list(ports), "variable", "value")
            .filter(F.col("szport").isNotNull() & F.col("value").isNotNull()))


def melt_sets(cube: DataFrame, robust: tuple[str, ...]) -> DataFrame:
    """As :func:`melt_buckets` for all evaluated breakpoint sets at once, with the set as ``bp``.

    A default measure has the same portfolios in every set, so it is melted once and its sums
    are repeated only after the aggregation (:func:`vw_return_pairs`).
    """
    sets = evaluated_sets(robust)
    cols = [port(m) for m in MEASURES if m not in robust]
    cols += [f"{port(m)}_{bp}" for m in MEASURES if m in robust for bp in sets]
    return melt_buckets(cube.select(*SERIES, "jdate", "szport", *CUBE_SUMS, *cols), cols)


def vw_return_pairs(cube: DataFrame, robust: tuple[str, ...] = (), default_set: str = DEFAULT_SET) -> DataFrame:
    """Per (series, bp, month, size, value, variable): sums, counts and the value-weighted return."""
    sums = melt_sets(cube, robust).groupBy(*SERIES, "jdate", "szport", "value", "variable").agg(*_sums())
    sets = evaluated_sets(robust) if robust else (default_set,)
    suffix = F.regexp_extract("variable", r"_(\d+_\d+)$", 1)
    own = F.when(suffix != "", F.array(suffix)).otherwise(F.array(*[F.lit(s) for s in sets]))
    return (sums.withColumn("bp", F.explode(own))
            .withColumn("variable", F.split_part("variable", F.lit("_"), F.lit(1)))
            .withColumn("vwret", vwret())
            .withColumn("ptf_code", portfolio_code("pair")))


def vw_return_2x3(cube: DataFrame, robust: tuple[str, ...] = ()) -> DataFrame:
    return vw_return_pairs(cube, robust)


def vw_return_2x2(cube: DataFrame) -> DataFrame:
    """Median labels; the set column stays empty."""
    return vw_return_pairs(cube, (), "")


def vw_return_5way(cube: DataFrame) -> DataFrame:
    ports = [port(m) for m in FIVE_ORDER]
    return (cube.filter(all_not_null(ports)).groupBy(*SERIES, "jdate", *ports).agg(*_sums())
            .withColumn("vwret", vwret()).withColumn("ptf_code", portfolio_code("five"))
            .withColumn("bp", F.lit("")))


def sort_combinations(sorts: list[tuple[str, ...]]) -> list[str]:
    return ["_".join(s) for s in sorts]


def vw_return_sorts(cube: DataFrame, sorts: list[tuple[str, ...]], n_size: int, n_other: int) -> DataFrame:
    """All cells of all sorts in every month of the cube, empty cells with return 0.

    One pass of grouping sets sums every sort; the full grid then enters as rows without any
    weight, so that filling empty cells is an aggregation too.
    """
    keys = [*SERIES, "jdate"]
    ports = [ntile_port(m) for m in ("size", *SORT_MEASURES)]
    sets = [[F.col(c) for c in keys + [ntile_port(m) for m in s]] for s in sorts]
    summed = cube.groupingSets(sets, *keys, *ports).agg(F.grouping_id().alias("gid"), *_sums())
    # a bit of the grouping id is set for every column that the sort leaves out
    named, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in sorts:
        inside = {ntile_port(m) for m in s}
        gid = sum(1 << (len(ports) - 1 - i) for i, p in enumerate(ports) if p not in inside)
        this = F.col("gid") == gid
        named = F.when(this, "_".join(s)).otherwise(named)
        complete = all_not_null([ntile_port(m) for m in s])
        code = F.when(this, F.when(complete, portfolio_code("sort", s))).otherwise(code)
    data = (summed.select(*keys, named.alias("sort_on"), code.alias("ptf_code"), *CUBE_SUMS)
            .filter(F.col("ptf_code").isNotNull()))
    empty = [F.lit(0).cast(cube.schema[c].dataType).alias(c) for c in CUBE_SUMS]
    grid = sort_grid(cube, sorts, n_size, n_other)
    return (data.unionByName(grid.select(*grid.columns, *empty))
            .groupBy(*keys, "sort_on", "ptf_code").agg(*_sums())
            .withColumn("vwret", F.coalesce(vwret(), F.lit(0.0))))


def vw_return_bivariate(cube: DataFrame, sorts: list[tuple[str, ...]]) -> DataFrame:
    return vw_return_sorts(cube, sorts, 5, 5)


def vw_return_threeway(cube: DataFrame, sorts: list[tuple[str, ...]]) -> DataFrame:
    return vw_return_sorts(cube, sorts, 2, 4)


def sort_grid(cube: DataFrame, sorts: list[tuple[str, ...]], n_size: int, n_other: int) -> DataFrame:
    """Every month of the cube with every cell of every sort."""
    by_sort = [
        F.struct(F.lit("_".join(s)).alias("sort_on"),
                 F.array(*[F.lit(m) for m in s]).alias("by"),
                 F.array(*[F.lit(n_size if m == "size" else n_other) for m in s]).alias("bins"))
        for s in sorts]
    grid = (cube.select(*SERIES, "jdate").distinct().withColumn("s", F.explode(F.array(*by_sort)))
            .select(*SERIES, "jdate", "s.*").withColumn("ptf_code", F.lit("")))
    for i in range(max(len(s) for s in sorts)):
        step = F.concat(F.lit("_") if i else F.lit(""), F.get("by", F.lit(i)))
        grid = (grid.withColumn("k", F.explode(F.sequence(F.lit(1), F.get("bins", F.lit(i)))))
                .withColumn("ptf_code", F.concat("ptf_code", step, F.col("k").cast("string"))))
    return grid.select(*SERIES, "jdate", "sort_on", "ptf_code")


def _cell_code(sort: tuple[str, ...], buckets: Sequence[Column]) -> Column:
    return F.concat_ws("_", *[F.concat(F.lit(m), b.cast("string")) for m, b in zip(sort, buckets)])


def portfolio_code(kind: str, sort: tuple[str, ...] = ()) -> Column:
    """``SH_bmport`` for pairs, ``SHRCX`` for the five-way sort, ``size1_bm3`` for n-tile sorts."""
    if kind == "pair":
        return F.concat("szport", "value", F.lit("_"), "variable")
    if kind == "five":
        return F.concat(*[port(m) for m in FIVE_ORDER])
    return _cell_code(sort, [F.col(ntile_port(m)) for m in sort])


def pivot_portfolios(long: DataFrame, codes: list[str], keys: list[str], value: str = "vwret") -> DataFrame:
    """Date x portfolio matrix over an explicit list of codes."""
    return long.groupBy(*keys).pivot("ptf_code", codes).agg(F.max(value))


def completeness_check(long: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Series whose number of distinct portfolios over all months is ``n``."""
    codes = long.select(*keys, "ptf_code").distinct()
    return codes.groupBy(*keys).agg(F.count("ptf_code").alias("n_ptfs")).filter(F.col("n_ptfs") == n).select(*keys)


def keep_complete(long: DataFrame, n: int, keys: list[str]) -> DataFrame:
    return long.join(completeness_check(long, n, keys), keys, "left_semi")


def fill_missing_cells(long: DataFrame, benchmark: DataFrame, codes: list[str], keys: list[str],
                       after_calendar: bool) -> DataFrame:
    """Portfolios on the published calendar; missing cells become 0.

    ``after_calendar`` also fills months without any data, otherwise those stay missing.
    """
    series = long.select(*keys).distinct()
    grid = series_calendar(series, benchmark).withColumn("ptf_code", F.explode(F.array(*[F.lit(c) for c in codes])))
    if after_calendar:
        return (grid.join(long.select(*keys, "jdate", "ptf_code", "vwret"), [*keys, "jdate", "ptf_code"], "left")
                .withColumn("vwret", F.coalesce("vwret", F.lit(0.0))))
    wide = pivot_portfolios(long, codes, [*keys, "jdate"]).fillna(0.0, codes)
    return (series_calendar(series, benchmark).join(wide, [*keys, "jdate"], "left")
            .unpivot([*keys, "jdate"], codes, "ptf_code", "vwret"))


def excess_returns(ptfs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Portfolios minus the risk-free rate on the published calendar; months without data stay missing."""
    keys = [*SERIES, "sort_on", "ptf_code"]
    grid = series_calendar(ptfs.select(*keys).distinct(), benchmark)
    rf = benchmark.select(F.col("date").alias("jdate"), "RF")
    return (grid.join(ptfs.select(*keys, "jdate", "vwret"), [*keys, "jdate"], "left").join(rf, "jdate")
            .select(F.col("jdate").alias("date"), "ptf_code", (F.col("vwret") - F.col("RF")).alias("ret"),
                    "sort_on", *SERIES))


def wavg_market_return(cube: DataFrame) -> DataFrame:
    """Value-weighted return of all rows with at least one bucket."""
    return (cube.groupBy(*SERIES, "jdate").agg(*[exact_sum(F.col(c)).alias(c) for c in EXACT])
            .select(*SERIES, "jdate", vwret().alias("Mkt")))


def market_excess(cube: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Market minus risk-free on the published calendar; months without data stay missing."""
    mkt = wavg_market_return(cube)
    rf = benchmark.select(F.col("date").alias("jdate"), "RF")
    return (series_calendar(mkt.select(*SERIES).distinct(), benchmark)
            .join(mkt, [*SERIES, "jdate"], "left").join(rf, "jdate")
            .select(*SERIES, "jdate", (F.col("Mkt") - F.col("RF")).alias("Mkt-RF")))


def portfolios_long(wide: DataFrame, codes: list[str], keys: list[str]) -> DataFrame:
    return wide.unpivot(keys, codes, "ptf_code", "ret")
