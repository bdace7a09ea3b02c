"""Runs as tables and files: tidy and nested threads, manifests, JSON listings with broken entries kept, indexes."""

from __future__ import annotations

import subprocess
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging

#: Codecs by their names in run configurations.
CODECS = {"lzf": "lz4", "gzip": "gzip", "none": "uncompressed"}


def nest(points: DataFrame, by: str, at: str, columns: list[str]) -> DataFrame:
    """One row per thread with aligned arrays, from one row per point. A thread's points are gathered as its row."""
    packed = F.array_sort(F.collect_list(F.struct(at, *columns)))
    return points.groupBy(by).agg(packed.alias("__p")).select(by, *[F.col("__p")[c].alias(c) for c in columns])


def unnest(threads: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """One row per point, ``idx`` from 0."""
    return threads.select(by, F.posexplode(F.arrays_zip(*columns)).alias("idx", "__p")).select(by, "idx", *[F.col("__p")[c].alias(c) for c in columns])


def offsets(threads: DataFrame, by: str, column: str, group: str) -> DataFrame:
    """Start and end of each thread's values when a group's arrays are laid end to end."""
    upto = F.expr(f"sum(size({column})) over (partition by {group} order by {by})")
    return threads.select(group, by, (upto - F.size(column)).alias("start"), upto.alias("end"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and upper-case SHA-256 of the files below ``path``, read by Spark from any file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime", F.upper(F.sha2("content", 256)).alias("digest"))


def manifest_faults(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, fault) of entries that are missing or have another digest."""
    found = stored.select(F.col(key).alias("__key"), F.col("digest").alias("__digest"))
    joined = expected.join(found, F.col(key) == F.col("__key"), "left").filter(F.col("__digest").isNull() | (F.col("__digest") != F.col("digest")))
    return joined.select(key, F.when(F.col("__key").isNull(), "missing").otherwise("changed").alias("fault"))


def listing(spark: SparkSession, glob: str, schema: str, newest: str) -> DataFrame:
    """JSON documents of a glob, newest first; those that can't be read stay, with their text as ``broken``."""
    read = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").schema(f"{schema}, broken string").json(glob)
    return read.withColumn("path", F.col("_metadata.file_path")).orderBy(F.col(newest).desc_nulls_last(), "path")


def write_run(tables: dict[str, DataFrame], path: str, compression: str = "gzip") -> None:
    """Tables of a run below ``path``; any that exists is an error, and the marker that completes the run comes last."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", CODECS[compression]).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(name,) for name in sorted(tables)], "name string").coalesce(1).write.mode("errorifexists").json(f"{path}/complete")


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a complete run; without its marker there is nothing to read and this raises."""
    names = [r["name"] for r in spark.read.schema("name string").json(f"{path}/complete").collect()]  # tables of one run
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def catalog(tables: dict[str, DataFrame]) -> list[dict]:
    """Columns of each table with type, unit and meaning."""
    return [{"table": name, "column": f.name, "type": f.dataType.simpleString(), **f.metadata} for name, df in sorted(tables.items()) for f in df.schema.fields]


def index(summaries: DataFrame) -> DataFrame:
    """Summaries in the order of an index."""
    return summaries.orderBy("generated_utc", "simulation_id")


def generated_utc() -> Column:
    """When a query runs, as ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def generator_commit(folder: str | None = None) -> str:
    """The commit of the checkout that runs, or "unknown"."""
    try:
        made = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder or Path(__file__).parent, capture_output=True, text=True, timeout=10, check=True)
        return made.stdout.strip() or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def stage_run(tables: dict[str, DataFrame], target: str) -> str:
    """Tables of a run beside ``target``, not yet visible there; give the result to ``staging.publish`` or ``discard``."""
    spark = next(iter(tables.values())).sparkSession
    staged = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        write_run(tables, staged)
    except Exception:
        staging.discard(spark, staged)
        raise
    return staged


def replay(spark: SparkSession, path: str, table: str, frame: int) -> DataFrame:
    """One frame of a complete run's table; the condition on frame_idx reaches the scan."""
    return read_run(spark, path)[table].filter(F.col("frame_idx") == frame)


def receipt(tables: dict[str, DataFrame], config_digest: str) -> DataFrame:
    """One row that describes a run: rows by table, the configuration's digest, when and by which commit it was made."""
    spark = next(iter(tables.values())).sparkSession
    counts = spark.createDataFrame([(name,) for name in sorted(tables)], "name string").limit(0).select("name", F.lit(0).cast("long").alias("rows"))
    for name, df in sorted(tables.items()):
        counts = counts.unionByName(df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")))
    all_rows = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "rows")))).alias("tables"))
    return all_rows.select("tables", F.lit(config_digest).alias("config_digest"), generated_utc().alias("generated_utc"), F.lit(generator_commit()).alias("generator_commit"))


def save_preview(tables: dict[str, DataFrame], config_digest: str, target: str) -> None:
    """A preview's tables and, last, their receipt; seen at ``target`` whole or not at all, and never twice."""
    spark = next(iter(tables.values())).sparkSession
    staged = stage_run(tables, target)
    try:
        receipt(tables, config_digest).coalesce(1).write.json(f"{staged}/receipt")
        staging.publish(spark, staged, target)
    finally:
        staging.discard(spark, staged)
