"""What the operators of this subpackage share: staging in the shared folder, Arrow batches, ASCII text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches handed to Python hold at most this much, so very long texts don't add up.
BATCH_BYTES = 8 << 20


#: Folders and tables written here, by Spark application, for ``drop_staged``.
_written: dict[str, tuple[list[str], list[str]]] = {}
#: Buckets a table may have.
MAX_BUCKETS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that would scatter parts over
    machines, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sunloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, ([], []))[0].append(path)
    return path


def fresh_table(spark: SparkSession, name: str) -> str:
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, ([], []))[1].append(table)
    return table


def stage(df: DataFrame, name: str, codec: str = "zstd", **options: int) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(compression=codec, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession, rows: int, rows_per_bucket: int) -> int:
    """Buckets for a table: the session's shuffle partitions, or as many as keep a bucket near ``rows_per_bucket`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_BUCKETS, -(-rows // rows_per_bucket)))


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``stage``, in ``buckets`` buckets of ``key``: later joins and groups by ``key`` read it without a shuffle."""
    spark = df.sparkSession
    table = fresh_table(spark, name)
    df.write.option("compression", "zstd").option("path", fresh_path(spark, name)).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables and folders that this application's operators have written, and nothing else.

    Call it when no result of theirs is needed any more; results read from a dropped folder fail.
    """
    paths, tables = _written.pop(spark.sparkContext.applicationId, ([], []))
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes.

    Spark reads the bound when the plan runs, so it stays lowered in the session; a smaller one of the caller's is kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def spread(df: DataFrame) -> DataFrame:
    """A table read from few files dealt over all cores, for work that costs more than the shuffle; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in their ``tree`` by ``order``, and ``nodes``, the rows of the tree.

    One range sort; a tree's rows lie in any number of ranges, whose counts are summed ahead of each.
    """
    cols = ["tree", *order]
    ranged = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("at", 33))
    tree, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("count"))
    pieces = pieces.select("tree", "part", "first", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.sum("count").over(tree).alias("nodes"))
    joined = ranged.join(stage(pieces, "pieces"), ["tree", "part"])
    return joined.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def own(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def row_id(doc_id: Column, text: Column) -> Column:
    """The doc_id; a row without one gets a number from its text, above all that tables use."""
    return F.coalesce(doc_id, F.lit(2**62) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2**61)))


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """A broadcast hint only for a side that was counted; beyond ``limit`` rows the join shuffles and AQE splits skew."""
    return F.broadcast(df) if small_enough(df, limit) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
