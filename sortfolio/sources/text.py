"""Published benchmark files: text with a preamble, a monthly block in percent and further blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortfolio.functions.columns import month_end
from sortfolio.plans.config import PUBLISHED_FACTORS, VW_MONTHLY_MARKER

FACTOR_PREAMBLE_LINES = 3
MONTH_LINE = r"^\s*\d{6}\s*,"
FACTOR_FIELDS = (*PUBLISHED_FACTORS, "RF")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines per file (``path``, ``pos``, ``line``); such a file has one line per month."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def _fields(line: str) -> Column:
    return F.transform(F.split(line, ","), lambda field: F.trim(field))


def _block(lines: DataFrame, start: DataFrame) -> DataFrame:
    """The run of monthly lines after the header line at ``start`` (path, header_pos, header)."""
    after = lines.join(start, "path").filter(F.col("pos") > F.col("header_pos")).filter(F.trim("line") != "")
    bad = (after.filter(~F.col("line").rlike(MONTH_LINE)).groupBy("path").agg(F.min("pos").alias("stop")))
    return (after.join(bad, "path", "left").filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
            .withColumn("fields", _fields("line")))


def parse_benchmark_factors(lines: DataFrame) -> DataFrame:
    """Monthly factors as fractions at month-ends, up to the first line with a missing value."""
    start = (lines.filter((F.col("pos") >= FACTOR_PREAMBLE_LINES) & (F.trim("line") != "")).groupBy("path")
             .agg(F.min_by("line", "pos").alias("header"), F.min("pos").alias("header_pos")))
    names = _fields("header")
    rows = _block(lines, start).withColumn("by_name", F.map_from_arrays(
        F.concat(F.array(F.lit("date")), F.slice(names, 2, F.size(names) - 1)),
        F.slice(F.concat("fields", F.array_repeat(F.lit(""), F.size(names))), F.lit(1), F.size(names))))
    values = [F.col("by_name")[c].try_cast("double") for c in FACTOR_FIELDS]
    parsed = rows.select("path", "pos", month_end(F.col("by_name")["date"], "yyyyMM", strict=False).alias("date"),
                         *[(v / 100).alias(c) for c, v in zip(FACTOR_FIELDS, values)])
    complete = F.lit(True)
    for c in FACTOR_FIELDS:
        complete = complete & F.col(c).isNotNull()
    gap = parsed.filter(~complete).groupBy("path").agg(F.min("pos").alias("gap"))
    return (parsed.join(gap, "path", "left").filter(F.col("gap").isNull() | (F.col("pos") < F.col("gap")))
            .select("date", *FACTOR_FIELDS))


def parse_benchmark_portfolios(lines: DataFrame, marker: str = VW_MONTHLY_MARKER,
                               mask_missing: bool = False) -> DataFrame:
    """Long (path, date, ptf_code, ret) rows of the block under the marker line.

    ``mask_missing`` turns the published missing codes (-99.99, -999) into nulls.
    """
    at = lines.filter(F.trim("line") == marker).groupBy("path").agg(F.min("pos").alias("marker_pos"))
    start = (lines.join(at, "path").filter((F.col("pos") > F.col("marker_pos")) & (F.trim("line") != ""))
             .groupBy("path").agg(F.min_by("line", "pos").alias("header"), F.min("pos").alias("header_pos")))
    names = _fields("header")
    cells = _block(lines, start).select(
        "path", month_end(F.get("fields", F.lit(0)), "yyyyMM", strict=False).alias("date"), "fields",
        F.posexplode(names).alias("i", "ptf_code")).filter("i > 0")
    value = F.get("fields", F.col("i")).try_cast("double")
    if mask_missing:
        value = F.when(~value.isin(-99.99, -999.0), value)
    return cells.select("path", "date", "ptf_code", (value / 100).alias("ret"))
