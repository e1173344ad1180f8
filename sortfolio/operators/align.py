"""Joins that bring characteristics, candidate measures, returns and the published calendar together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.functions.columns import formation_year

PAIR = ["permno", "jdate"]
SERIES = ["source_file", "measure"]


def align_measures(measures: DataFrame, chars: DataFrame) -> DataFrame:
    """Measure rows whose (permno, jdate) pair exists in the characteristics."""
    return measures.join(chars.select(*PAIR), PAIR)


def build_panel(chars: DataFrame, measures: DataFrame) -> DataFrame:
    """One row per (source file, permno, June): the characteristics and all values of the file.

    The values travel as one array, so the join moves a pair once however many measures it has.
    """
    return (measures.select("source_file", *PAIR, "values").join(chars, PAIR)
            .withColumn("ffyear", formation_year(F.col("jdate"))))


def common_pairs(chars: DataFrame, measures: DataFrame) -> DataFrame:
    """Characteristics of the pairs present in each measure file."""
    return build_panel(chars, measures).drop("values", "ffyear")


def attach_measure(panel: DataFrame) -> DataFrame:
    """One row per pair and measure: the measure's value as ``nf`` and its 1-based place in the file as ``index``."""
    return (panel.select(*[c for c in panel.columns if c != "values"], F.posexplode("values").alias("pos", "value"))
            .withColumns({"index": F.col("pos") + 1, "measure": F.col("value.measure"), "nf": F.col("value.nf")})
            .drop("pos", "value"))


def combine_breakpoints(dates: DataFrame, breaks: DataFrame) -> DataFrame:
    """Breakpoints of the Junes in the published calendar, one row per file and June."""
    return breaks.join(dates.select("jdate"), "jdate", "left_semi")


def align_breakpoints(panel: DataFrame, breaks: DataFrame, on: list[str]) -> DataFrame:
    return panel.join(breaks, on, "left")


def merge_assignments(panel: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Attach separately computed buckets: a full outer merge on the keys, then a left join.

    The outer merge is one grouping of the stacked parts instead of a chain of outer joins.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                     [part.select(*keys, bucket) for bucket, part in parts.items()])
    merged = stacked.groupBy(*keys).agg(*[F.max(b).alias(b) for b in parts])
    return panel.join(merged, keys, "left")


def carry_forward(returns: DataFrame, june: DataFrame) -> DataFrame:
    """Monthly rows with the buckets of their formation year."""
    cols = ["date", "permno", "retadj", "wt", "ffyear", "jdate"]
    return returns.select(*[c for c in cols if c in returns.columns]).join(june, ["permno", "ffyear"], "left")


def calendar_dates(benchmark: DataFrame) -> Column:
    """All published month-ends as one array value (a published table has one row per month)."""
    return benchmark.agg(F.sort_array(F.collect_set("date"))).scalar()


def series_calendar(series: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every published month for every series."""
    return (series.withColumn("dates", calendar_dates(benchmark))
            .withColumn("jdate", F.explode("dates")).drop("dates"))


def on_calendar(df: DataFrame, benchmark: DataFrame, series: list[str]) -> DataFrame:
    """Published months on the left: months without data appear with missing values."""
    return series_calendar(df.select(*series).distinct(), benchmark).join(df, series + ["jdate"], "left")


def compare_factors(published: DataFrame, replicated: DataFrame) -> DataFrame:
    """Inner join by date; published columns that also exist in the replication end in ``_orig``."""
    renamed = published.select(*[
        F.col(c).alias(f"{c}_orig") if c != "date" and c in replicated.columns else F.col(c)
        for c in published.columns])
    return replicated.join(renamed, "date")


def compare_portfolios(replicated: DataFrame, published: DataFrame) -> DataFrame:
    """Published portfolios on the right; ``ret_x``/``sort_on_x`` replicated, ``ret_y``/``sort_on_y`` published."""
    left = replicated.withColumnsRenamed({"ret": "ret_x", "sort_on": "sort_on_x"})
    right = published.withColumnsRenamed({"ret": "ret_y", "sort_on": "sort_on_y"})
    return left.join(right, ["date", "ptf_code"], "right")
