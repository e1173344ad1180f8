"""Dates: the published months are the calendar of every output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def formation_calendar(benchmark: DataFrame) -> DataFrame:
    """June formation dates: one month before every published July."""
    july = benchmark.filter(F.month("date") == 7)
    return july.select(F.last_day(F.add_months("date", -1)).alias("jdate")).distinct()


def clip_to_returns(benchmark: DataFrame, returns: DataFrame) -> DataFrame:
    """Published months up to the last return date (dates of the returns are ISO text)."""
    last = returns.agg(F.max(F.to_date("date"))).scalar()
    return benchmark.filter(F.col("date") <= last)


def clip_to_window(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows between the first and the last published month."""
    first, last = benchmark.agg(F.min("date")).scalar(), benchmark.agg(F.max("date")).scalar()
    return df.filter((F.col("date") >= first) & (F.col("date") <= last))
