"""Broadcast hints behind a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast on our word.
MOST = 50_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, counted no further; else as it is, for Catalyst and
    AQE to join by shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, by: str | Column, like: DataFrame, rows: int) -> DataFrame:
    """``df`` by hash of ``by`` in as many parts as ``like`` has times ``rows`` rows.

    A table of few bytes is read by one task, and AQE merges what is slim into a few more, however much each row is about to
    become. A number of parts that is stated stays, so a task's share does not grow with the table.
    """
    parts = -(-like.count() // rows)
    return df.repartition(parts, by) if parts > 1 else df


#: Bytes of an Arrow batch handed to Python.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``: rows that hold arrays then don't add up. A smaller bound is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
