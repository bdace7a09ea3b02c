"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sunloom", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew joins and Arrow; ``settings`` override (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    return builder.config(map=conf).getOrCreate()
