"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that hold at any size; parallelism is left to the cluster (or to the caller).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # plans are built from many column expressions; do not record a call site for each of them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "sortfolio", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
