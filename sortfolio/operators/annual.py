"""Annual accounts by calendar year: the last record, years on file, growth between years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: parts that rows without a firm are dealt to, so that they don't meet in one task
_LOOSE = 4096


def _loose(df: DataFrame, firm: str) -> Column:
    return F.when(F.col(firm).isNull(), F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_LOOSE)))


def last_annual_record(accounts: DataFrame, firm: str = "gvkey", end: str = "datadate") -> DataFrame:
    """The last record of each firm and calendar year of the fiscal end, re-keyed by ``cal_year``.

    ``n_records``: records of that year; ``months``: from the end of the firm's record before this one, kept or not (missing for the first);
    ``changed``: the fiscal year ends in another month than that record's. Records of one end count as one, the greatest in the order of columns.
    Records without a firm or an end are dropped. All windows share one shuffle by firm.
    """
    others = [c for c in accounts.columns if c not in (firm, end)]
    rows = accounts.where(F.col(firm).isNotNull() & F.col(end).isNotNull()).repartition(firm).withColumn("cal_year", F.year(end))
    same = Window.partitionBy(firm, end).orderBy(*[F.col(c).desc_nulls_last() for c in others] or [F.lit(1)])
    rows = rows.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    by_end, before = Window.partitionBy(firm).orderBy(end), F.col("__before")
    rows = rows.withColumn("__before", F.lag(end).over(by_end)).withColumns({
        "months": (F.year(end) - F.year(before)) * 12 + F.month(end) - F.month(before), "changed": F.month(end) != F.month(before)}).drop("__before")
    year = Window.partitionBy(firm, "cal_year")
    return rows.withColumns({"n_records": F.count("*").over(year), "__last": F.max(end).over(year)}).where(F.col(end) == F.col("__last")).drop("__last")


def years_on_file(accounts: DataFrame, firm: str = "gvkey", year: str = "cal_year") -> DataFrame:
    """``years_on_file``: years with a record up to this one; ``run_years``: those since the last gap; ``restarts``: gaps so far.

    Several records of a year have the same numbers; a missing firm or year has none.
    """
    known = F.col(firm).isNotNull() & F.col(year).isNotNull()
    own = Window.partitionBy(firm, "__loose")
    rows = accounts.withColumn("__loose", _loose(accounts, firm)).withColumn("__rank", F.dense_rank().over(own.orderBy(F.col(year).asc_nulls_last())))
    rows = rows.withColumn("__island", F.col(year) - F.col("__rank"))
    # the number of a firm's islands grows by one at each gap
    rows = rows.withColumn("__begin", F.min(year).over(Window.partitionBy(firm, "__loose", "__island"))).withColumn(
        "__islands", F.dense_rank().over(own.orderBy(F.col("__island").asc_nulls_last())))
    return rows.withColumns({
        "years_on_file": F.when(known, F.col("__rank")), "run_years": F.when(known, F.col(year) - F.col("__begin") + 1),
        "restarts": F.when(known, F.col("__islands") - 1)}).drop("__loose", "__rank", "__island", "__begin", "__islands")


def seasoned(accounts: DataFrame, least: int = 2, by: str = "years_on_file") -> DataFrame:
    """Records of firms with ``least`` years on file by then (``by="run_years"``: without a gap)."""
    return accounts.where(F.col(by) >= least)


def growth(accounts: DataFrame, value: str, name: str, firm: str = "gvkey", year: str = "cal_year") -> DataFrame:
    """Growth of ``value`` over that of the year before, which must be on file: a gap gives missing, not the last year there is.

    One record per firm and year is expected; with several, the greatest value of the year before counts.
    """
    before = F.max(value).over(Window.partitionBy(firm, "__loose").orderBy(year).rangeBetween(-1, -1))
    known = F.col(firm).isNotNull() & F.col(year).isNotNull()
    return accounts.withColumn("__loose", _loose(accounts, firm)).withColumn("__before", F.when(known, before)).withColumn(
        name, F.try_divide(F.col(value) - F.col("__before"), F.col("__before"))).drop("__loose", "__before")
