"""One query per operator of the June panel's construction, over raw tables derived from the driver's."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortfolio.landing import land
from sortfolio.operators import accounting, annual, firms, intervals, links
from sortfolio.plans import panel
from verification import raw


class Context:
    """Shared steps of one session and folder; each is computed when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.raw = raw.raw(spark, sf_dir)

    @cached_property
    def monthly(self) -> DataFrame:
        """A projection of the landed securities."""
        return firms.market_equity(self.raw.securities).withColumn("firm", F.coalesce(F.col("permco"), -F.col("permno")))

    @cached_property
    def yearly(self) -> DataFrame:
        return land(panel.annual_accounts(self.raw.accounts), "yearly")

    @cached_property
    def judged(self) -> DataFrame:
        return land(links.resolve_links(panel.june_links(self.monthly, self.raw.links, self.yearly), panel.link_rules()), "judged-links")


_contexts: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = Context(spark, sf_dir)
    return _contexts[key]


def q_dated_link_join(c: Context) -> DataFrame:
    """All months of all securities with the links of that day; a month without a link stays."""
    return intervals.dated_join(c.raw.securities.select("permno", "date"), c.raw.links, ["permno"], "date", "linkdt", "linkenddt", "left")


def q_firm_market_equity(c: Context) -> DataFrame:
    """Every month, the tie-break by the security's number of months so far left to the keyed draw."""
    return firms.firm_market_equity(c.monthly, "permco", carry=("exchcd", "shrcd"))


def q_december_market_equity(c: Context) -> DataFrame:
    firm = land(firms.firm_market_equity(c.monthly, "firm").select("firm", "date", "me"), "firm-equity")
    june = firm.where(F.month("date") == 6)
    bounded = panel.december_equity(june, firm, raw.STALE).withColumn("bound", F.lit(raw.STALE))
    return bounded.unionByName(panel.december_equity(june, firm, None).withColumn("bound", F.lit(None).cast("int")))


def q_book_equity(c: Context) -> DataFrame:
    out = accounting.book_equity(c.raw.accounts)
    return out.select("gvkey", "datadate", *[x for i in accounting.BOOK_EQUITY for x in (i.name, f"{i.name}_branch")])


def q_last_annual_record(c: Context) -> DataFrame:
    return annual.last_annual_record(c.raw.accounts).select(
        "gvkey", "datadate", "cal_year", "months", F.col("changed").cast("int").alias("changed"), "n_records", "at")


def q_years_on_file(c: Context) -> DataFrame:
    rows = annual.years_on_file(annual.last_annual_record(c.raw.accounts))
    flags = {f"in_{by}": F.col(by) >= panel.LEAST_YEARS for by in ("years_on_file", "run_years")}
    return rows.withColumns(flags).select("gvkey", "cal_year", "years_on_file", "run_years", "restarts", *flags)


def q_asset_growth(c: Context) -> DataFrame:
    return annual.growth(annual.last_annual_record(c.raw.accounts), "at", "inv").select("gvkey", "cal_year", "at", "inv")


def q_operating_profitability(c: Context) -> DataFrame:
    return accounting.operating_profitability(accounting.book_equity(c.raw.accounts)).select("gvkey", "datadate", "be", "op")


OPERATORS: dict[str, Callable[[Context], DataFrame]] = {
    "dated_link_join": q_dated_link_join,
    "december_market_equity": q_december_market_equity,
    "firm_market_equity": q_firm_market_equity,
    "resolve_links": lambda c: c.judged.groupBy("gvkey", "permno", "date", "rule", "round").agg(F.count("*").alias("n")),
    "link_drop_counts": lambda c: links.link_drop_counts(c.judged),
    "years_on_file": q_years_on_file,
    "last_annual_record": q_last_annual_record,
    "book_equity": q_book_equity,
    "operating_profitability": q_operating_profitability,
    "asset_growth": q_asset_growth,
    "job_june_panel": lambda c: panel.june_panel(c.raw, raw.STALE),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(op: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: op(context(spark, sf_dir))

    return {name: bind(op) for name, op in OPERATORS.items()}
