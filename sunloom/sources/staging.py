"""A folder that driver and executors share, and writes that are seen whole or not at all."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import HadoopStore


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sunloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, staged: str, target: str, replace: bool = False) -> None:
    """Move a finished folder to ``target``; a target that exists is an error, or makes room if ``replace``.

    Moves never overwrite: of two writers of one target one fails. With ``replace`` the old folder steps aside, comes back
    if the new one can't take its place, and is deleted last; for the moment between two moves readers find nothing. Where
    that matters, keep the data in a ``commits.Table``, whose readers always find a whole version.
    """
    files = HadoopStore(spark)
    if not files.exists(staged):
        raise FileNotFoundError(staged)
    old = f"{target.rstrip('/')}.replaced-{uuid.uuid4().hex}"
    if files.exists(target):
        if not replace:
            raise FileExistsError(target)
        files.move(target, old)
    try:
        files.move(staged, target)
    except Exception:
        if files.exists(old) and not files.exists(target):
            files.move(old, target)
        raise
    files.delete(old)


def discard(spark: SparkSession, staged: str) -> None:
    """Remove what an aborted write has left."""
    HadoopStore(spark).delete(staged)


def write_whole(df: DataFrame, target: str, kind: str = "parquet", replace: bool = False, **options: str) -> None:
    """``df`` below ``target``, which readers see only when all of it is there; a failed write leaves no target."""
    spark, staged = df.sparkSession, f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        df.write.format(kind).options(**options).save(staged)
        publish(spark, staged, target, replace)
    finally:
        discard(spark, staged)


def write_json(df: DataFrame, target: str, replace: bool = False) -> None:
    """Rows as JSON lines with sorted keys, nulls included, seen whole or not at all."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    write_whole(df.select(line.alias("value")), target, "text", replace)
