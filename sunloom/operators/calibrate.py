"""Calibration of a model grid to published anchors: factors, log-linear interpolation, checks, cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import interpolate
from .sizes import small

KEYS = ["height_mm", "temperature_k", "pressure"]


def factors(raw: DataFrame, anchors: DataFrame) -> DataFrame:
    """Published over raw value per anchor: c_i, c_f."""
    return raw.join(small(anchors), KEYS).withColumn("c_i", F.col("i_value") / F.col("i_raw")).withColumn("c_f", F.col("f_value") / F.col("f_raw"))


def extend(raw: DataFrame, anchors: DataFrame) -> DataFrame:
    """The raw grid times factors interpolated linearly in their logarithm along height, held beyond the anchors."""
    known = factors(raw, anchors).select("temperature_k", "pressure", F.col("height_mm").cast("double").alias("h"), F.log("c_i").alias("log_i"), F.log("c_f").alias("log_f"))
    asked = raw.withColumn("h", F.col("height_mm").cast("double"))
    applied = interpolate(asked, known, ["temperature_k", "pressure"], "h", ["log_i", "log_f"])
    return applied.select(*KEYS, "i_raw", "f_raw", (F.col("i_raw") * F.exp("log_i")).alias("i_value"), (F.col("f_raw") * F.exp("log_f")).alias("f_value"))


def cell_name(temperature: Column, pressure: Column) -> Column:
    return F.concat(F.lit("t"), temperature.cast("string"), F.lit("_p"), F.rint(pressure * 100).cast("int").cast("string"))


def wide(grid: DataFrame, value: str, names: list[str]) -> DataFrame:
    """One row per height, one column per temperature and pressure; ``names`` fix the columns, so nothing is collected."""
    return grid.withColumn("cell", cell_name(F.col("temperature_k"), F.col("pressure"))).groupBy("height_mm").pivot("cell", names).agg(F.avg(value))


def long_form(table: DataFrame, key: str, names: list[str], value: str) -> DataFrame:
    return table.unpivot([key], names, "cell", value)


def anchor_check(grid: DataFrame, anchors: DataFrame) -> DataFrame:
    """Differences of an extended grid at the anchors."""
    known = anchors.select(*KEYS, F.col("i_value").alias("i_published"), F.col("f_value").alias("f_published"))
    joined = grid.join(small(known), KEYS)
    return joined.select(*KEYS, (F.col("i_value") - F.col("i_published")).alias("delta_i"), (F.col("f_value") - F.col("f_published")).alias("delta_f"))


def cross_validate(calibrated: DataFrame) -> DataFrame:
    """Each anchor height predicts the others: relative errors by (anchor_mm, target_mm), in percent."""
    a = calibrated.select(F.col("height_mm").alias("anchor_mm"), "temperature_k", "pressure", F.col("c_i").alias("a_i"), F.col("c_f").alias("a_f"))
    pairs = calibrated.withColumnRenamed("height_mm", "target_mm").join(a, ["temperature_k", "pressure"]).filter("anchor_mm <> target_mm")
    error = lambda c, raw, v: F.abs((F.col(c) * F.col(raw) - F.col(v)) / F.col(v))
    scored = pairs.select("anchor_mm", "target_mm", error("a_i", "i_raw", "i_value").alias("e_i"), error("a_f", "f_raw", "f_value").alias("e_f"))
    aggs = [f(F.col(e)).alias(n) for e, n, f in (("e_i", "i_median", _median), ("e_i", "i_max", _largest), ("e_f", "f_median", _median), ("e_f", "f_max", _largest))]
    return scored.groupBy("anchor_mm", "target_mm").agg(F.count(F.lit(1)).alias("n"), *aggs)


def _median(c: Column) -> Column:
    return 100 * F.percentile(c, 0.5)


def _largest(c: Column) -> Column:
    return 100 * F.max(c)
