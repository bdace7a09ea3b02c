"""Masks of optical depth as a table: exported for all frames at once, read back frame by frame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transfer import absorption
from .commits import Table

#: What the columns mean, kept with the table.
MEANING = {"binary": "tau over the threshold, not grown", "absorption": "1 - exp(-tau), line centre", "grid": "highres before blurring, native after"}
SCHEMA = "grid string, frame_idx long, time_s double, tau_threshold double, row_idx long, col_idx long, binary boolean, absorption double"


def masks(tau: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``tau`` (grid, frame_idx, time_s, row_idx, col_idx, tau) to masks; a null depth is no absorption."""
    if not (math.isfinite(threshold) and threshold > 0):
        raise ValueError("the threshold must be finite and above zero")
    depth = F.coalesce("tau", F.lit(0.0))
    named = {"binary": depth > threshold, "absorption": absorption(depth)}
    return tau.select("grid", "frame_idx", "time_s", F.lit(threshold).alias("tau_threshold"), "row_idx", "col_idx", *[c.alias(n, metadata={"comment": MEANING[n]}) for n, c in named.items()])


def uneven_grids(tau: DataFrame) -> DataFrame:
    """Frames (frame_idx, grids) that not all grids of ``tau`` have."""
    grids = tau.select("grid").distinct().count()  # two, by name
    return tau.groupBy("frame_idx").agg(F.countDistinct("grid").alias("grids")).filter(F.col("grids") < grids)


def export(tau: DataFrame, target: str, threshold: float = 0.1, replace: bool = True) -> None:
    """Masks of every frame as a table below ``target``, clustered by grid and frame so that reading one prunes the rest.

    ``target`` holds a log of versions: readers see the old export or the new one, never a part or nothing, and of two
    exports that race one fails. Frames that one grid lacks are an error, as is an export that is there unless ``replace``.
    """
    if uneven_grids(tau).limit(1).count():
        raise ValueError("all grids must have the same frames")
    table = Table(tau.sparkSession, target)
    if not replace and table.folders():
        raise FileExistsError(target)
    made = masks(tau, threshold)
    table.replace(made.repartitionByRange("grid", "frame_idx", "row_idx").sortWithinPartitions("grid", "frame_idx", "row_idx", "col_idx"))


def read_frame(spark: SparkSession, target: str, frame: int = 0, version: int | None = None) -> DataFrame:
    """One frame of all grids of the newest export; the condition reaches the scan. A frame that isn't there has no rows."""
    return Table(spark, target).read(SCHEMA, version).filter(F.col("frame_idx") == frame)
