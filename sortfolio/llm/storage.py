"""Written intermediate tables in the folder that all executors and the driver share, and tables that tasks fill as they go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local master without that setting gets a folder of its own."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and return the written table: the lineage ends there, and lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Solved(dict):
    """Values solved when first asked for; a lookup costs no call."""

    def __init__(self, solve: Callable):
        super().__init__()
        self.solve = solve

    def __missing__(self, key):
        return self.solve(key)
