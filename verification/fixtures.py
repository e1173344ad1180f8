"""Input tables of the library derived from the driver's read-only tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortfolio.landing import land
from sortfolio.plans.config import PUBLISHED_BIVARIATE, PUBLISHED_THREEWAY
from sortfolio.plans.jobs import Inputs
from sortfolio.sources.tables import measures_from_wide


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date")
    return li.select(
        F.col("l_partkey").alias("permno"), day.alias("d"),
        (F.year(day) + (F.month(day) > 6).cast("int")).alias("fy"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.sum("qty").cast("bigint")
    jdate = F.last_day("d")
    # a part has about one line a month, so that sums before the shuffle would merge next to nothing
    return (_lines(spark, sf_dir).repartition("permno").groupBy("permno", jdate.alias("jdate")).agg(
        F.date_format(F.max("d"), "yyyy-MM-dd").alias("date"),
        F.when(units % 11 != 0, F.round(F.avg("disc") - F.avg("tax"), 6)).alias("retadj"),
        F.when(F.count(F.lit(1)) % 3 != 0, F.round(F.sum("price"), 2)).alias("wt"))
        .withColumn("ffyear", F.year("jdate") - (F.month("jdate") < 7).cast("int"))
        .select("date", "permno", "retadj", "wt", "ffyear", "jdate"))


_years: dict[tuple[str, str], DataFrame] = {}


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the lines of a part and formation year, landed once per session: the characteristics and both measure files are
    projections of it. Lines are dealt by part, so that grouping and the year before need no further shuffle."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _years:
        price, units = F.col("price"), F.sum("qty")
        yearly = _lines(spark, sf_dir).repartition("permno").groupBy("permno", "fy").agg(
            F.round(F.sum("price"), 2).alias("me"),
            F.round(F.sum(F.when(F.month("d") > 6, price)), 2).alias("dec_me"),
            F.round(units * 100 * (F.avg("tax") * 25 - F.lit(0.2)), 6).alias("be"),
            F.when(units.cast("bigint") % 13 != 0, F.round(F.sum(price * (1 - F.col("disc"))), 4)).alias("revt"),
            F.round(F.sum(F.when(F.col("rf") == "R", price * 0.5)), 4).alias("cogs"),
            F.round(F.sum(F.when(F.col("rf") == "A", price * 0.2)), 4).alias("xsga"),
            F.round(F.sum(F.when(F.col("ls") == "O", price * F.col("tax"))), 4).alias("xint"),
            units.alias("shrout"),
            F.round(F.avg("qty"), 6).alias("m1"), F.round(F.max("disc"), 6).alias("m2"),
            F.round(F.min(F.when(F.col("rf") == "R", price)), 2).alias("m4"), F.count_if(F.col("rf") == "R").alias("n_returned"))
        last_year = Window.partitionBy("permno").orderBy("fy").rangeBetween(-1, -1)
        # a missing year would be its own predecessor
        yearly = yearly.withColumn("me_before", F.when(F.col("fy").isNotNull(), F.max("me").over(last_year)))
        _years[key] = land(yearly, "years")
    return _years[key]


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("permno"), (F.lit(10) + F.col("p_size") % 4).alias("shrcd"),
        F.when(F.col("p_partkey") % 37 != 0, F.col("p_retailprice")).alias("prc"))
    spent = F.coalesce("cogs", F.lit(0.0)) + F.coalesce("xsga", F.lit(0.0)) + F.coalesce("xint", F.lit(0.0))
    # ratios of rounded inputs are the same double in every engine and need no rounding of their own
    return (years(spark, sf_dir).join(part, "permno").select(
        "permno", F.make_date("fy", F.lit(6), F.lit(30)).alias("jdate"),
        (F.lit(1) + F.col("permno") % 3).cast("int").alias("exchcd"), "shrcd", "prc", "shrout", "me", "dec_me", "be",
        F.try_divide("be", "dec_me").alias("beme"),
        F.try_divide(F.col("me") - F.col("me_before"), F.col("me_before")).alias("inv"),
        F.try_divide(F.col("revt") - spent, F.col("be")).alias("op"),
        "revt", "cogs", "xsga", "xint"))


def wide_measures(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two measure files with different headers; the second covers only pairs with returned goods."""
    date = F.concat(F.col("fy").cast("string"), F.lit("06")).cast("int").alias("date")
    yearly = years(spark, sf_dir)
    return {"measures_alpha": yearly.select("permno", date, "m1", "m2", F.lit(0.0).alias("m3")),
            "measures_beta": yearly.filter(F.col("n_returned") > 0).select("permno", date, "m4")}


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [measures_from_wide(w, name) for name, w in wide_measures(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


# order priority (first character) whose average order value stands in for a published factor
FACTOR_PRIORITY = {"Mkt-RF": "1", "SMB": "2", "HML": "3", "RMW": "4", "CMA": "5"}


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    date = F.last_day(F.col("o_orderdate").cast("date"))
    priority = F.substring("o_orderpriority", 1, 1)
    return (orders.groupBy(date.alias("date")).agg(*[
        F.round(F.coalesce(F.avg(F.when(priority == p, F.col("o_totalprice"))), F.avg("o_totalprice")) / 1e6, 6).alias(f)
        for f, p in FACTOR_PRIORITY.items()])
        .withColumn("RF", F.round(F.lit(0.001) + F.lit(0.0001) * F.month("date"), 4)))


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.last_day(F.col("o_orderdate").cast("date")).alias("date"), "o_totalprice",
        F.col("o_custkey"), F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("half"))


def published_bivariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio cell: order priority by customer group."""
    cells = _order_cells(spark, sf_dir).groupBy(
        "date", F.col("prio").alias("i"), (F.lit(1) + F.col("o_custkey") % 5).alias("j")).agg(
        F.round(F.avg("o_totalprice") / 1e6, 6).alias("ret"))
    sorts = [F.struct(F.lit(s).alias("sort_on"), F.lit(s.split("_")[0]).alias("a"), F.lit(s.split("_")[1]).alias("b"))
             for s in PUBLISHED_BIVARIATE]
    return (cells.withColumn("s", F.explode(F.array(*sorts)))
            .select("date", F.concat("s.a", F.col("i").cast("string"), F.lit("_"), "s.b", F.col("j").cast("string"))
                    .alias("ptf_code"), "ret", "s.sort_on"))


def published_threeway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio cell: order status half by two customer groups."""
    cells = _order_cells(spark, sf_dir).groupBy(
        "date", "half", (F.lit(1) + F.col("o_custkey") % 4).alias("i"),
        (F.lit(1) + F.col("o_custkey") % 3 + (F.col("prio") == 1).cast("int")).alias("j")).agg(
        F.round(F.avg("o_totalprice") / 1e6, 6).alias("ret"))
    sorts = [F.struct(F.lit(s).alias("sort_on"), F.lit(s.split("_")[1]).alias("a"), F.lit(s.split("_")[2]).alias("b"))
             for s in PUBLISHED_THREEWAY]
    return (cells.withColumn("s", F.explode(F.array(*sorts)))
            .select("date", F.concat(F.lit("size"), F.col("half").cast("string"), F.lit("_"),
                                     "s.a", F.col("i").cast("string"), F.lit("_"), "s.b", F.col("j").cast("string"))
                    .alias("ptf_code"), "ret", "s.sort_on"))


class Derived(Inputs):
    """The input tables, each derived when first asked for. Returns and published months are landed; characteristics and measures are
    projections of the landed yearly sums."""

    def __init__(self, spark: SparkSession | None = None, sf_dir: str | None = None, **given: DataFrame | int | None):
        self.spark, self.sf_dir = spark, sf_dir
        vars(self).update(given)

    @cached_property
    def returns(self) -> DataFrame:
        return land(returns(self.spark, self.sf_dir), "returns")

    @cached_property
    def chars(self) -> DataFrame:
        return chars(self.spark, self.sf_dir)

    @cached_property
    def measures(self) -> DataFrame:
        return measures(self.spark, self.sf_dir)

    @cached_property
    def benchmark(self) -> DataFrame:
        return land(benchmark(self.spark, self.sf_dir), "benchmark")


_derived: dict[tuple[str, str], Derived] = {}


def derived(spark: SparkSession, sf_dir: str) -> Derived:
    """The four input tables, derived at most once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _derived:
        _derived[key] = Derived(spark, sf_dir)
    return _derived[key]


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """All four input tables, derived now."""
    found = derived(spark, sf_dir)
    for name in ("returns", "chars", "measures", "benchmark"):
        getattr(found, name)
    return found
