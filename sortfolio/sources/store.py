"""Returns stored by (permno, ffyear) in buckets, so that no job shuffles them for the monthly join."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

KEYS = ["permno", "ffyear"]


def write_returns_store(returns: DataFrame, path: str, buckets: int) -> None:
    """Sorted bucket files below ``path/data``, one a bucket, and their layout below ``path/layout``.

    A new path is expected; an existing one is an error. Choose so many buckets that one fits a task's memory.
    """
    spark, name = returns.sparkSession, f"returns_{uuid.uuid4().hex}"
    (returns.repartition(buckets, *KEYS).write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS)
     .option("path", f"{path}/data").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # an external table: only its entry goes
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in returns.schema.fields)
    spark.createDataFrame([(buckets, ddl)], "buckets INT, ddl STRING").coalesce(1).write.json(f"{path}/layout")


def open_returns_store(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The stored returns, known to Spark as bucketed, and the number of buckets (for ``Inputs.return_buckets``)."""
    layout = spark.read.schema("buckets INT, ddl STRING").json(f"{path}/layout").first()
    name = f"returns_store_{hashlib.md5(path.encode()).hexdigest()}"
    by = ", ".join(KEYS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({layout['ddl']}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
              f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/data'")
    return spark.table(name), layout["buckets"]
