"""Jobs that grow by formation years: finished Junes are kept, a new June costs its own twelve months.

Breakpoints and buckets of a June and the sums of its months depend on that June's rows alone, so the monthly sums are stored by
(formation year, measure file). The tables of a job are sums over them and are made from all stored years.

An update computes the Junes that are not finished, replaces their parts (dynamic partition overwrite) and writes the
manifest last. What a killed update has left is replaced by the next one; a June is finished when its twelfth month is there.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortfolio.landing import exists, land
from sortfolio.operators import align, universe
from sortfolio.operators.align import SERIES
from sortfolio.plans import jobs

PART = ["ffyear", "source_file"]
_MANIFEST = "source_file STRING, jdate DATE, complete BOOLEAN"


def _folder(path: str, kind: str, robust: tuple[str, ...], what: str) -> str:
    return f"{path}/{'-'.join([kind, *robust])}/{what}"


def manifest(spark: SparkSession, path: str, kind: str, robust: tuple[str, ...] = ()) -> DataFrame:
    """Junes computed so far; a June that was not complete the first time has a row for each update."""
    at = _folder(path, kind, robust, "manifest")
    return spark.read.schema(_MANIFEST).parquet(at) if exists(spark, at) else spark.createDataFrame([], _MANIFEST)


def _replace(df: DataFrame, at: str) -> None:
    """Replace the parts that ``df`` has rows of; all other parts stay."""
    df.repartition(*PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PART).parquet(at)


def pending(inputs: jobs.Inputs, path: str, kind: str, robust: tuple[str, ...] = (), until: dt.date | None = None) -> DataFrame:
    """``(source_file, jdate, complete)`` of the Junes to compute, up to ``until``."""
    spark = inputs.chars.sparkSession
    junes = inputs.measures.select("source_file", "jdate").distinct().join(inputs.chars.select("jdate").distinct(), "jdate")
    if until is not None:
        junes = junes.where(F.col("jdate") <= F.lit(until))
    finished = manifest(spark, path, kind, robust).where("complete").select("source_file", "jdate").distinct()
    last = inputs.returns.agg(F.max("jdate")).scalar()
    twelfth = F.make_date(F.year("jdate") + 1, F.lit(6), F.lit(30))
    return junes.join(finished, ["source_file", "jdate"], "left_anti").withColumn("complete", F.coalesce(last >= twelfth, F.lit(False)))


def update(inputs: jobs.Inputs, path: str, kind: str, robust: tuple[str, ...] = (), until: dt.date | None = None) -> int:
    """Compute what is pending; returns the number of (file, June) parts computed."""
    todo = land(pending(inputs, path, kind, robust, until).select("source_file", "jdate", "complete"), "pending")
    n = todo.count()
    if not n:
        return 0
    years = todo.select(F.year("jdate").alias("ffyear")).distinct()
    part = jobs.Inputs(
        inputs.returns.join(years, "ffyear", "left_semi"), inputs.chars.join(todo.select("jdate").distinct(), "jdate", "left_semi"),
        inputs.measures.join(todo, ["source_file", "jdate"], "left_semi"), inputs.benchmark)
    panel = jobs.prepare_panel(part)
    panel.every = True  # whether a measure is all zero shows only over all years
    cube = panel.cube(kind, robust)
    month = F.col("jdate")
    _replace(cube.withColumn("ffyear", F.year(month) - (F.month(month) < 7).cast("int")), _folder(path, kind, robust, "cube"))
    by_june = align.attach_measure(panel.pairs).groupBy(*SERIES, "index", "ffyear").agg(F.sum(F.abs("nf")).alias("total"))
    _replace(by_june, _folder(path, kind, robust, "totals"))
    todo.coalesce(1).write.mode("append").parquet(_folder(path, kind, robust, "manifest"))
    return n


def stored(spark: SparkSession, path: str, kind: str, robust: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The stored monthly sums of usable measures, and the measures' places in their files."""
    cube, totals = (spark.read.parquet(_folder(path, kind, robust, what)) for what in ("cube", "totals"))
    totals = land(totals.groupBy(*SERIES, "index").agg(F.sum("total").alias("total")), "totals")
    kept = universe.drop_degenerate_measures(cube.drop("ffyear"), universe.usable_measures(totals))
    return land(kept, "cube"), totals.select(*SERIES, "index")


def factors(spark: SparkSession, path: str, benchmark: DataFrame, kind: str, robust: tuple[str, ...] = ()) -> jobs.FactorResult:
    return jobs.factor_result(stored(spark, path, kind, robust)[0], benchmark, kind, robust)


def portfolios(spark: SparkSession, path: str, benchmark: DataFrame, kind: str) -> jobs.PortfolioResult:
    cube, legend = stored(spark, path, kind)
    return jobs.sort_result(cube, legend, benchmark, kind)
