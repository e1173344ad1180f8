"""Raw inputs of the June panel derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortfolio.landing import land
from sortfolio.plans.panel import Raw

#: days that the thin months of these tables may lie before December
STALE = 200


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_partkey").alias("permno"), (F.floor(F.col("l_partkey") / 2) * 3 + F.col("l_suppkey") % 3 + 1).cast("bigint").alias("gvkey"),
        day.alias("d"), F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_extendedprice").alias("price"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    permno, top = F.col("permno"), F.floor(F.max("price")).cast("double")
    return _lines(spark, sf_dir).groupBy("permno", F.last_day("d").alias("date")).agg(
        F.when(F.sum("qty") % 17 != 0, F.when(permno % 5 == 0, -top).otherwise(top)).alias("prc"), F.sum("qty").cast("double").alias("shrout")).select(
        "permno", F.when(permno % 41 != 0, F.floor(permno / 3) + 1).cast("bigint").alias("permco"), "date", "prc", "shrout",
        (permno % 4 + 1).cast("int").alias("exchcd"), (permno % 3 + 10).cast("int").alias("shrcd"))


#: item: factor of units (u) or lines (k) and when it is there
ITEMS = {"seq": ("u", 2.0, "u % 3 <> 0"), "ceq": ("u", 1.75, "u % 2 = 0"), "pstk": ("k", 4.0, "k % 2 = 0"), "at": ("u", 8.0, "u % 11 <> 0"),
         "lt": ("k", 16.0, "k % 5 <> 0"), "txditc": ("u", 0.25, "u % 5 = 0"), "pstkrv": ("k", 2.0, "u % 7 = 0"), "pstkl": ("k", 3.0, "u % 4 = 0"),
         "mib": ("k", 0.5, "k % 4 = 0"), "revt": ("u", 3.0, "u % 13 <> 0"), "cogs": ("u", 1.25, "u % 2 = 1"), "xsga": ("u", 0.5, "k % 3 = 0"),
         "xint": ("k", 1.0, "k % 7 = 0")}


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years end in the month of the last line, so they change; every seventh firm has two records a year."""
    half = F.when(F.col("gvkey") % 7 == 0, (F.month("d") > 6).cast("int")).otherwise(0)
    rows = _lines(spark, sf_dir).groupBy("gvkey", F.year("d").alias("y"), half.alias("h")).agg(
        F.last_day(F.max("d")).alias("datadate"), F.sum("qty").alias("u"), F.count("*").alias("k"))

    def item(base: str, factor: float, when: str) -> Column:
        return F.when(F.expr(when), F.col(base) * factor)

    return rows.select("gvkey", "datadate", *[item(*x).alias(n) for n, x in ITEMS.items()])


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two links a pair, with open ends on either side and intervals that end before they begin."""
    key = F.col("permno") + F.col("gvkey")
    pairs = _lines(spark, sf_dir).groupBy("permno", "gvkey").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    kind = (F.col("permno") * 7 + F.col("gvkey")) % 4
    first = pairs.select(
        "gvkey", "permno", F.when(kind == 0, "P").when(kind == 1, "C").when(kind == 2, "J").alias("linkprim"),
        F.when(key % 13 != 0, F.col("lo")).alias("linkdt"),
        F.when(key % 17 == 0, F.date_sub("lo", 1)).when(key % 3 != 0, F.date_add("hi", 400)).alias("linkenddt"))
    second = pairs.where(F.col("permno") % 9 == 0).select("gvkey", "permno", F.lit("C").alias("linkprim"), F.col("lo").alias("linkdt"), F.col("hi").alias("linkenddt"))
    return first.unionByName(second)


class Derived(Raw):
    """The raw tables, each derived and landed when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def securities(self) -> DataFrame:
        return land(securities(self.spark, self.sf_dir), "raw-securities")

    @cached_property
    def accounts(self) -> DataFrame:
        return land(accounts(self.spark, self.sf_dir), "raw-accounts")

    @cached_property
    def links(self) -> DataFrame:
        return land(links(self.spark, self.sf_dir), "raw-links")


_raw: dict[tuple[str, str], Raw] = {}


def raw(spark: SparkSession, sf_dir: str) -> Raw:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _raw:
        _raw[key] = Derived(spark, sf_dir)
    return _raw[key]
