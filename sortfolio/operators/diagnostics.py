"""Counts, coverage and correlations reported next to the portfolio and factor tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.functions.columns import all_not_null, any_not_null, percent
from sortfolio.operators.align import SERIES, series_calendar
from sortfolio.operators.factors import FACTOR_KEYS
from sortfolio.operators.returns import bp_view
from sortfolio.plans.config import (
    FACTOR_OF, FIVE_ORDER, FLAG_COL, LABELS3, MEASURES, PUBLISHED_FACTORS, SIZE_LABELS, evaluated_sets, port,
)

NFIRMS_COLUMNS = ["Mkt-RF", "SMB", "HML", "CMA", "RMW", "XMY"]


def measure_coverage_summary(long: DataFrame) -> DataFrame:
    """Smallest, largest and mean (truncated) number of stocks with a value, over the Junes."""
    per_june = long.groupBy(*SERIES, "jdate").agg(F.count("nf").alias("n"))
    return per_june.groupBy(*SERIES).agg(
        F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").cast("bigint").alias("mean"))


def common_pair_count(panel: DataFrame) -> DataFrame:
    return panel.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_pairs"))


def missing_pct(long: DataFrame) -> DataFrame:
    cols = ["beme", "inv", "op", "nf"]
    counted = long.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counted.select(*SERIES, *[percent(F.col(c), F.col("n")).alias(c) for c in cols])


def good_measure_counts(flagged: DataFrame) -> DataFrame:
    """Stocks with a usable value of each measure per June; needs all flags including the candidate's."""
    return flagged.groupBy(*SERIES, "jdate").agg(
        *[F.sum(f).alias(f) for f in FLAG_COL.values()], F.count(F.lit(1)).alias("n_rows"))


def good_measure_pct(flagged: DataFrame) -> DataFrame:
    counts = good_measure_counts(flagged)
    return counts.select(
        *SERIES, "jdate", *[percent(F.col(f), F.col("n_rows")).alias(f) for f in FLAG_COL.values()])


def size_nf_cell_counts(june: DataFrame, nfport: str = "nfport") -> DataFrame:
    """Stocks per formation year in each size x candidate cell; cells without stocks are missing."""
    cells = [(s, v) for s in SIZE_LABELS for v in LABELS3["nf"]]
    return june.groupBy(*SERIES, "ffyear").agg(*[
        F.nullif(F.count_if((F.col("szport") == s) & (F.col(nfport) == v)), F.lit(0)).alias(f"{s}_{v}")
        for s, v in cells])


def portfolio_group_count(june: DataFrame) -> DataFrame:
    """Number of distinct complete bucket combinations."""
    ports = [port(m) for m in FIVE_ORDER]
    return (june.filter(all_not_null(ports)).select(*SERIES, *ports).distinct()
            .groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_groups")))


def portfolios_per_date(sorts: DataFrame) -> DataFrame:
    keys = [*SERIES, "sort_on", "jdate"]
    return sorts.select(*keys, "ptf_code").distinct().groupBy(*keys).agg(F.count("ptf_code").alias("n_portfolios"))


def misassigned_check(assigned: DataFrame) -> DataFrame:
    """Distinct buckets given to stocks that are not eligible, per measure."""
    # a bucket column has at most a handful of values, so the collected sets stay tiny
    return assigned.groupBy(*SERIES).agg(*[
        F.size(F.collect_set(F.when(F.col(FLAG_COL[m]) == 0, F.col(f"{m}port")))).alias(f"{m}_misassigned")
        for m in ("size", "bm", "op", "inv")])


def _with_calendar(counts: DataFrame, keys: list[str], benchmark: DataFrame, cols: list[str]) -> DataFrame:
    return (series_calendar(counts.select(*keys).distinct(), benchmark)
            .join(counts, [*keys, "jdate"], "left").fillna(0, cols))


def factor_nfirms_2x3(cube: DataFrame, benchmark: DataFrame, robust: tuple[str, ...] = (),
                      count_op: bool = False) -> DataFrame:
    """Firms behind each factor per month.

    SMB counts rows with a bm, inv or nf bucket of the set; op counts only with ``count_op``.
    """
    counted = ["bm", "inv", "nf"] + (["op"] if count_op else [])
    # rows without a bucket in a set still count for the market
    parts = reduce(DataFrame.unionByName, [bp_view(cube, bp, robust) for bp in evaluated_sets(robust)])
    counts = parts.groupBy(*FACTOR_KEYS, "jdate").agg(
        F.sum("n_ret").alias("Mkt-RF"),
        _rows_where(any_not_null([port(m) for m in counted])).alias("SMB"),
        *[_weights_where(m).alias(FACTOR_OF[m]) for m in MEASURES])
    return _with_calendar(counts, FACTOR_KEYS, benchmark, NFIRMS_COLUMNS).select(
        *FACTOR_KEYS, "jdate", *NFIRMS_COLUMNS)


def _rows_where(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n_rows"))), F.lit(0))


def _weights_where(m: str) -> Column:
    return F.coalesce(F.sum(F.when(all_not_null(["szport", port(m)]), F.col("n_wt"))), F.lit(0))


def factor_nfirms_2x2(cube: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As the 2x3 counts with all four buckets in SMB and without a market column."""
    cols = NFIRMS_COLUMNS[1:]
    counts = cube.withColumn("bp", F.lit("")).groupBy(*FACTOR_KEYS, "jdate").agg(
        _rows_where(any_not_null([port(m) for m in MEASURES])).alias("SMB"),
        *[_weights_where(m).alias(FACTOR_OF[m]) for m in MEASURES])
    return _with_calendar(counts, FACTOR_KEYS, benchmark, cols).select(*FACTOR_KEYS, "jdate", *cols)


def factor_nfirms_5way(cube: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows with all five buckets, the same for every factor, and non-missing returns for the market."""
    complete = _rows_where(all_not_null([port(m) for m in FIVE_ORDER]))
    counts = cube.withColumn("bp", F.lit("")).groupBy(*FACTOR_KEYS, "jdate").agg(
        F.sum("n_ret").alias("Mkt-RF"), *[complete.alias(c) for c in NFIRMS_COLUMNS[1:]])
    return _with_calendar(counts, FACTOR_KEYS, benchmark, NFIRMS_COLUMNS).select(
        *FACTOR_KEYS, "jdate", *NFIRMS_COLUMNS)


def month_rows(cube: DataFrame) -> DataFrame:
    return cube.groupBy(*SERIES, "jdate").agg(F.sum("n_rows").alias("month_rows"))


def factor_coverage_pct(nfirms: DataFrame, cube: DataFrame) -> DataFrame:
    """Average share of the month's rows behind each factor."""
    cols = [c for c in NFIRMS_COLUMNS if c in nfirms.columns]
    return (nfirms.join(month_rows(cube), [*SERIES, "jdate"]).groupBy(*FACTOR_KEYS)
            .agg(*[F.avg(percent(F.col(c), F.col("month_rows"))).alias(c) for c in cols]))


def portfolio_nfirms(sorts: DataFrame) -> DataFrame:
    """Rows with return and weight per month and cell, for months with data only."""
    return sorts.select(F.col("jdate").alias("date"), "ptf_code", F.col("n_both").alias("nfirms"), "sort_on", *SERIES)


def portfolio_coverage_pct(nfirms: DataFrame, cube: DataFrame) -> DataFrame:
    """Share of the month's rows in any cell of the sort, averaged over the months."""
    keys = [*SERIES, "sort_on"]
    shares = (nfirms.withColumnRenamed("date", "jdate").join(month_rows(cube), [*SERIES, "jdate"])
              .groupBy(*keys, "jdate").agg(F.sum(percent(F.col("nfirms"), F.col("month_rows"))).alias("share")))
    return shares.groupBy(*keys).agg(F.avg("share").alias("coverage_pct"))


def factor_correlations(compared: DataFrame) -> DataFrame:
    """Pearson correlation of each replicated factor with the published one."""
    return compared.groupBy(*FACTOR_KEYS).agg(*[F.corr(f"{c}_orig", c).alias(c) for c in PUBLISHED_FACTORS])


def portfolio_correlations(compared: DataFrame) -> DataFrame:
    return (compared.filter(F.col("sort_on_x").isNotNull())
            .groupBy(*SERIES, F.col("sort_on_x").alias("sort_on")).agg(F.corr("ret_x", "ret_y").alias("corr")))


def date_range_summary(table: DataFrame, keys: list[str], series: Column) -> DataFrame:
    """Number of dates and series, first and last date."""
    return table.groupBy(*keys).agg(
        F.count_distinct("date").alias("n_dates"), series.alias("n_series"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"))
