"""Image sequences as tables: frames and pixels, written once, read by strides, with the checks of a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field(name: str, kind: T.DataType, unit: str, meaning: str, nullable: bool = False) -> T.StructField:
    return T.StructField(name, kind, nullable, {"unit": unit, "comment": meaning})


SEQUENCES = T.StructType(
    [
        field("sequence_id", T.StringType(), "", "name of the sequence"),
        field("version", T.IntegerType(), "", "version of the layout, 1"),
        field("cadence_s", T.DoubleType(), "s", "time between frames"),
        field("native_pixel_km", T.DoubleType(), "km", "size of a pixel"),
        field("disk_mu", T.DoubleType(), "", "cosine of the angle from disk centre"),
        field("limb_direction_deg", T.DoubleType(), "deg", "direction to the limb"),
        field("n_frames", T.LongType(), "", "frames"),
    ]
)
PIXELS = T.StructType(
    [
        field("sequence_id", T.StringType(), "", "name of the sequence"),
        field("frame_idx", T.LongType(), "", "frame from 0"),
        field("row_idx", T.LongType(), "px", "row, y"),
        field("col_idx", T.LongType(), "px", "column, x"),
        field("intensity", T.FloatType(), "", "brightness", True),
    ]
)


def strided(frames: DataFrame, start: int, step: int, count: int | None = None) -> DataFrame:
    """Every ``step``-th frame from ``start``; the condition on frame_idx reaches the scan."""
    chosen = frames.filter((F.col("frame_idx") >= start) & ((F.col("frame_idx") - start) % step == 0))
    return chosen if count is None else chosen.filter(F.col("frame_idx") <= start + step * (count - 1))


def header_rules() -> dict[str, Column]:
    c = F.col
    return {
        "version": c("version") == 1,
        "cadence": (c("cadence_s") > 0) & (c("cadence_s") < float("inf")),
        "pixel": (c("native_pixel_km") > 0) & (c("native_pixel_km") < float("inf")),
        "disk": (c("disk_mu") > 0) & (c("disk_mu") <= 1),
        "limb": c("limb_direction_deg").between(0, 360),
        "frames": c("n_frames") >= 1,
    }


def uneven(times: DataFrame, headers: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Frames (sequence_id, frame_idx, time_s) whose time is not frame times cadence."""
    late = F.abs(F.col("time_s") - F.col("frame_idx") * F.col("cadence_s")) > tolerance
    return times.join(headers.select("sequence_id", "cadence_s"), "sequence_id").filter(late).select("sequence_id", "frame_idx", "time_s")


def bad_pixels(pixels: DataFrame, value: str = "intensity") -> DataFrame:
    """Pixels that are null, not finite or not positive: errors, not missing values."""
    v = F.col(value)
    return pixels.filter(v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf")))


def within(headers: DataFrame, start: int, step: int, count: int) -> DataFrame:
    """Sequences long enough for a request."""
    return headers.filter(F.col("n_frames") > start + step * (count - 1))


def write(pixels: DataFrame, path: str, codec: str = "zstd") -> None:
    """Write once: an existing target is an error. Frames are clustered, so strides prune row groups."""
    ordered = pixels.repartitionByRange("sequence_id", "frame_idx").sortWithinPartitions("sequence_id", "frame_idx", "row_idx", "col_idx")
    ordered.write.mode("errorifexists").option("compression", codec).partitionBy("sequence_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PIXELS).parquet(path)


def pick(paths: DataFrame, draw: int) -> DataFrame:
    """One of a listing (path), by a number: the same for the same listing, whatever its order."""
    least = F.struct(F.xxhash64(F.concat(F.lit(f"{draw}:"), F.col("path"))), "path")
    return paths.agg(F.min(least).alias("m")).select("m.path")
