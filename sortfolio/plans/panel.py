"""The June panel out of raw tables: monthly securities, annual accounts and dated links between the two."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.landing import land
from sortfolio.operators import accounting, annual, firms, intervals, links
from sortfolio.plans.config import COMMON_SHARE_CODES

#: fixed values: exchanges and years on file of the sample
EXCHANGES = (1, 2, 3)
LEAST_YEARS = 2
#: a month-end at the end of December counts, one 31 days before it doesn't
MAX_DAYS = 30
#: columns of the panel, as the sorting jobs read them, and what it is linked by
CHARS = ["permno", "jdate", "exchcd", "shrcd", "prc", "shrout", "me", "dec_me", "be", "beme", "inv", "op", "revt", "cogs", "xsga", "xint"]
EXTRA = ["gvkey", "years_on_file", "n_classes"]


@dataclass
class Raw:
    securities: DataFrame  # permno, permco, date (month-end), prc, shrout, exchcd, shrcd
    accounts: DataFrame  # gvkey, datadate, items
    links: DataFrame  # gvkey, permno, linkprim, linkdt, linkenddt


def annual_accounts(accounts: DataFrame) -> DataFrame:
    """One record per firm and calendar year with years on file, book equity, profitability and asset growth."""
    rows = annual.years_on_file(annual.last_annual_record(accounts))
    return annual.growth(accounting.operating_profitability(accounting.book_equity(rows)), "at", "inv")


def link_rules() -> Mapping[str, Column]:
    """Which of several links stays: the primary one, then the account longest on file, then a keyed draw."""
    return {"primary": F.col("linkprim") == "P", "age": F.col("years_on_file"),
            "draw": F.md5(F.concat_ws(":", F.col("gvkey").cast("string"), F.col("permno").cast("string")).cast("binary"))}


def june_links(securities: DataFrame, links_table: DataFrame, accounts: DataFrame) -> DataFrame:
    """Links that hold on each security's June day, with the years on file of the account's record of the calendar year before."""
    june = securities.where(F.month("date") == 6).select("permno", "date")
    held = intervals.dated_join(june, links_table.select("permno", "gvkey", "linkprim", "linkdt", "linkenddt"), ["permno"], "date", "linkdt", "linkenddt")
    on_file = accounts.select("gvkey", (F.col("cal_year") + 1).alias("june_year"), "years_on_file")
    return held.withColumn("june_year", F.year("date")).join(on_file, ["gvkey", "june_year"], "left").select(
        "gvkey", "permno", "date", "linkprim", "linkdt", "linkenddt", "years_on_file")


def december_equity(june: DataFrame, monthly: DataFrame, max_days: int | None = MAX_DAYS, firm: str = "firm") -> DataFrame:
    """``dec_me``: the firm's equity as of the end of the December before each June, at most ``max_days`` old.

    As of the end of a year, only the last row of a year can count, so that the history is cut to those before it is sorted.
    """
    row = F.struct(F.col("date").alias("dec_date"), F.col("me").alias("dec_me"))
    last = monthly.where(F.col("me").isNotNull()).groupBy(firm, F.year("date").alias("year")).agg(F.max(row).alias("row"))
    history = last.select(firm, "row.*")
    points = june.withColumn("december", F.make_date(F.year("date") - 1, F.lit(12), F.lit(31)))
    return intervals.as_of(points, history, [firm], "december", "dec_date", max_days).drop("december")


def june_panel(raw: Raw, max_days: int = MAX_DAYS, exchanges: Sequence[int] = EXCHANGES, shares: Sequence[int] = COMMON_SHARE_CODES,
               least_years: int = LEAST_YEARS) -> DataFrame:
    """Characteristics of the sample's firms each June, one security per firm and one account per security.

    Equity is summed over all share classes first; exchange, share code and years on file filter the securities that stand for
    their firms only after that, so no class is lost to the sums. Accounts are those of the calendar year before.
    """
    monthly = land(firms.market_equity(raw.securities).withColumn("firm", F.coalesce(F.col("permco"), -F.col("permno"))), "securities")
    accounts = land(annual_accounts(raw.accounts), "accounts")
    judged = links.resolve_links(june_links(monthly, raw.links, accounts), link_rules())
    linked = land(links.kept_links(judged).select("permno", "date", "gvkey", "years_on_file"), "linked")
    june = monthly.where(F.month("date") == 6).join(linked, ["permno", "date"], "left")
    chosen = firms.firm_market_equity(june, "firm", years="years_on_file", carry=("exchcd", "shrcd", "prc", "shrout", "gvkey"))
    totals = firms.firm_market_equity(monthly, "firm").select("firm", "date", "me")
    priced = december_equity(land(chosen, "june-firms"), totals, max_days)
    items = accounts.select("gvkey", (F.col("cal_year") + 1).alias("june_year"), "years_on_file", "be", "inv", "op", "revt", "cogs", "xsga", "xint")
    panel = priced.withColumn("june_year", F.year("date")).join(items, ["gvkey", "june_year"])
    sample = annual.seasoned(panel, least_years).where(F.col("exchcd").isin(*exchanges) & F.col("shrcd").isin(*shares))
    return sample.withColumnRenamed("date", "jdate").withColumn("beme", F.try_divide("be", "dec_me")).select(*CHARS, *EXTRA)
