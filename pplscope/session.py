"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE does the runtime work (coalescing, skew splits, demoting joins); the advisory size
# keeps reduce tasks small enough to stay in executor memory whatever the input size is.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app_name: str = "pplscope", master: str | None = None, **extra: str) -> SparkSession:
    """Session with SETTINGS; `extra` keys use `__` for dots (`spark__sql__shuffle__partitions`)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
