"""Runs as streams: statistics over frames as they come, walks with state per thread, windows over late events.

Sources and sinks are files with checkpoints, so a query that stops goes on where it was. Each function runs its query over
what there is (``availableNow``) and returns the sink's table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.staging import shared_path


def event_stream(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """Events as a stream of files; event time as a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> str:
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return path


def upsert(stream: DataFrame, spark: SparkSession, name: str, mode: str = "update") -> str:
    """A sink that keeps what each batch changed under the batch's number, so a repeated batch writes the same place."""
    path = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return path


def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, greatest, mean and number of values by event type after all batches; the last batch of a key counts."""
    stats = event_stream(spark, sf_dir).groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    path = upsert(stats, spark, "running-stats")
    made = spark.read.option("basePath", path).schema("event_type string, low double, high double, mean double, n long, batch int").parquet(f"{path}/*")
    last = made.groupBy("event_type").agg(F.max_by(F.struct("low", "high", "mean", "n"), "batch").alias("s"))
    return last.select("event_type", F.round("s.low", 6).alias("low"), F.round("s.high", 6).alias("high"), F.round("s.mean", 6).alias("mean"), "s.n")


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum of each user's values in the order of event_id, with the sum as state across batches.

    Events of a user that come in a later batch count as later, as a stream of frames in order does.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        sums = total + rows["value"].cumsum()
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "step": n + pd.RangeIndex(1, len(rows) + 1), "position": sums.round(6)})
        state.update((float(sums.iloc[-1]), n + len(rows)))

    stream = event_stream(spark, sf_dir).select("user_id", "event_id", "value")
    stepped = stream.groupBy("user_id").applyInPandasWithState(advance, "user_id long, event_id long, step long, position double", "total double, n long", "append", GroupStateTimeout.NoTimeout)
    return spark.read.schema("user_id long, event_id long, step long, position double").parquet(run(stepped, spark, "walk"))


def late_windows(spark: SparkSession, sf_dir: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window of event time; windows come out once the watermark has passed them. (An addition: an
    image sequence has no late frames, it refuses them.)"""
    windows = event_stream(spark, sf_dir).withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    flat = windows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "total")
    return spark.read.schema("start string, n long, total double").parquet(run(flat, spark, "windows"))
