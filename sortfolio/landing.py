"""Landing of intermediate tables in the shared folder of the cluster.

A landed table is ordinary parquet: its lineage ends there, it survives the loss of any
executor, and the optimizer knows its true size.  Joins against a landed table therefore need
no hint: Spark broadcasts it when its files are below ``spark.sql.autoBroadcastJoinThreshold``
and otherwise uses a sort-merge join, whose skewed partitions AQE splits.

Without ``spark.checkpoint.dir`` nothing is written: the table is kept by the executors with its
lineage, from which Spark recomputes what it loses.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}
_landed: list[tuple[SparkSession, DataFrame | str]] = []  # kept tables and written folders, in order


def _base(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def _app_folder(spark: SparkSession, base: str) -> str:
    return f"{base.rstrip('/')}/sortfolio/{spark.sparkContext.applicationId}"


def landing_path(spark: SparkSession, name: str) -> str:
    """A new path for files whose writing is the point; below a temporary folder only for local masters."""
    base, app = _base(spark), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.TemporaryDirectory(prefix="sortfolio-")
        base = _local_dirs[app].name
    return f"{_app_folder(spark, base)}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table; without a shared folder, keep it with its lineage."""
    spark = df.sparkSession
    if not _base(spark):
        _landed.append((spark, df.persist(StorageLevel.MEMORY_AND_DISK)))
        return df
    path = landing_path(spark, name)
    _landed.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def landed_so_far() -> int:
    return len(_landed)


def drop_landed(since: int) -> None:
    """Give up the tables landed after :func:`landed_so_far` returned ``since``."""
    while len(_landed) > since:
        spark, table = _landed.pop()
        if isinstance(table, str):
            folder = spark._jvm.org.apache.hadoop.fs.Path(table)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        else:
            table.unpersist()
