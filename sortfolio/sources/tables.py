"""Monthly returns, June characteristics and candidate measure files."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortfolio.functions.columns import month_end, nan_to_null

RETURNS_FIELDS = {
    "date": "string", "permno": "bigint", "retadj": "double", "wt": "double", "ffyear": "int", "jdate": "date",
}
CHARS_FIELDS = {
    "permno": "bigint", "jdate": "date", "exchcd": "int", "shrcd": "int",
    **dict.fromkeys(["prc", "shrout", "me", "dec_me", "be", "beme", "inv", "op", "revt", "cogs", "xsga", "xint"], "double"),
}
# spellings of missing and infinite numbers in the files
# a part whose header differs from the schema's is an error, never read by position
CSV_OPTIONS = {"header": "true", "enforceSchema": "false", "nanValue": "nan", "positiveInf": "inf", "negativeInf": "-inf"}
RESERVED = {"permno", "jdate", "date", "source_file", "measure", "nf"}


def _clean(df: DataFrame) -> DataFrame:
    return df.select(*[
        nan_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


def is_parquet(spark: SparkSession, path: str) -> bool:
    """By name, or by what a folder holds."""
    if path.rstrip("/").endswith(".parquet"):
        return True
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return not found.load(path).select("path").isEmpty()


def _read(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Parquet by its own schema, otherwise CSV by header name; parts with another column order are an error."""
    if is_parquet(spark, path):
        df = spark.read.parquet(path)
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in fields.items()])
    header = spark.read.options(**CSV_OPTIONS).csv(path).columns
    schema = ", ".join(f"`{c}` {fields.get(c, 'STRING')}" for c in header)
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path).select(*fields)


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    return _clean(_read(spark, path, RETURNS_FIELDS))


def read_characteristics(spark: SparkSession, path: str) -> DataFrame:
    """June panel; stored ``*_ok`` flags are not read, they are derived again."""
    return _clean(_read(spark, path, CHARS_FIELDS))


def measures_from_wide(wide: DataFrame, source_file: str | Column) -> DataFrame:
    """One row per pair with all measures of the file as an array in header order."""
    names = [c for c in wide.columns if c not in ("permno", "date", "jdate")]
    clash = [n for n in names if n.lower() in RESERVED or n.lower() in CHARS_FIELDS]
    if clash:
        raise ValueError(f"measure names {clash} are reserved")
    values = F.array(*[
        F.struct(F.lit(n).alias("measure"), nan_to_null(F.col(f"`{n}`").cast("double")).alias("nf")) for n in names])
    jdate = F.col("jdate") if "jdate" in wide.columns else month_end(F.col("date"), "yyyyMM")
    source = F.lit(source_file) if isinstance(source_file, str) else source_file
    return wide.select(source.alias("source_file"), F.col("permno").cast("bigint").alias("permno"),
                       jdate.alias("jdate"), values.alias("values"))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a pattern; only names reach the driver."""
    found = spark.read.format("binaryFile").load(pattern).select("path")
    return sorted(r.path for r in found.collect())


# name of a file, or of the folder its parts lie in, without the extension
SOURCE_NAME = r"([^/]+?)(?:\.[^/]*)?(?:/part-[^/]*)?$"


def read_measures(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Wide measure files with any headers; a path may be a file or a folder of part files.

    Files with the same header are one distributed scan; only headers are looked at one by one.
    """
    paths = list_files(spark, paths) if isinstance(paths, str) else list(paths)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        # the first line as data: read as a header, repeated names would be renamed silently
        header = tuple(str(c).strip() for c in spark.read.csv(path).first())
        if len({c.lower() for c in header}) != len(header) or not {"permno", "date"} <= set(header):
            raise ValueError(f"{path}: needs permno, date and distinct measure names, has {list(header)}")
        by_header.setdefault(header, []).append(path)
    frames = []
    for header, same in by_header.items():
        types = {"permno": "BIGINT", "date": "STRING"}
        schema = ", ".join(f"`{c}` {types.get(c, 'DOUBLE')}" for c in header)
        wide = spark.read.options(**CSV_OPTIONS).schema(schema).csv(same)
        source = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), SOURCE_NAME, 1)
        frames.append(measures_from_wide(wide, source))
    return reduce(DataFrame.unionByName, frames)


def measures_long(measures: DataFrame) -> DataFrame:
    """Rows (source_file, measure, permno, jdate, nf)."""
    return (measures.withColumn("v", F.explode("values"))
            .select("source_file", "v.measure", "permno", "jdate", "v.nf"))
