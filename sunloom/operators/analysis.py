"""Time-distance analysis in DataFrames: slits, per-column scaling, periodograms, detrending."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dips import clip
from . import quantiles


def slit_points(spark: SparkSession, x: float, y: float, angle_deg: float, length: float, width: float, step: float = 1.0, width_step: float = 1.0) -> DataFrame:
    """Sampling points of a straight slit: k (place along it), j (across), sx, sy. A slit of width 1 is one line."""
    dx, dy = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    along = math.floor(length / step + 0.5 + 1e-9)
    across = math.floor(width / width_step + 0.5 + 1e-9) if width > 1 else 0
    k, j = F.col("k"), F.col("j")
    d = -length / 2 + k * step
    a = -width / 2 + j * width_step if width > 1 else F.lit(0.0)
    grid = spark.range(along + 1).withColumnRenamed("id", "k").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across))))
    return grid.select("k", "j", d.cast("double").alias("distance"), (x + d * dx - a * dy).alias("sx"), (y + d * dy + a * dx).alias("sy"))


def time_distance(pixels: DataFrame, slit: DataFrame, value: str, rows: int, columns: int) -> DataFrame:
    """Mean over the slit's width of bilinear samples: frame_idx, k, distance, value. ``slit`` is small by construction.

    A sample outside the image, or with one of its four pixels missing, counts as missing; so does a pixel that isn't a
    number. Positions whose samples are all missing have no row.
    """
    inside = slit.filter(F.col("sx").between(0, columns - 1) & F.col("sy").between(0, rows - 1))
    r, c = F.least(F.floor("sy"), F.lit(rows - 2)).cast("long"), F.least(F.floor("sx"), F.lit(columns - 2)).cast("long")
    corners = inside.withColumn("__r", r).withColumn("__c", c).withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(3))))
    down, right = F.shiftright("corner", 1), F.col("corner").bitwiseAND(1)
    fy, fx = F.col("sy") - F.col("__r"), F.col("sx") - F.col("__c")
    weight = F.when(down == 1, fy).otherwise(1 - fy) * F.when(right == 1, fx).otherwise(1 - fx)
    corners = corners.select("k", "j", "distance", (F.col("__r") + down).alias("row_idx"), (F.col("__c") + right).alias("col_idx"), weight.alias("w"))
    good = pixels.filter(F.col(value).isNotNull() & ~F.isnan(value))
    joined = good.join(F.broadcast(corners), ["row_idx", "col_idx"])
    samples = joined.groupBy("frame_idx", "k", "j", "distance").agg(F.sum(F.col("w") * F.col(value)).alias("v"), F.count(F.lit(1)).alias("n")).filter("n = 4")
    return samples.groupBy("frame_idx", "k", "distance").agg(F.avg("v").alias("value"))


def normalised(df: DataFrame, by: list[str], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """``df`` with ``scaled``: 0 at the low and 1 at the high percentile of its group."""
    bounds = quantiles.wide(quantiles.percentiles(df, by, value, [low, high]), by, {"__low": low, "__high": high})
    spread = F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-12))
    return df.join(bounds, by).withColumn("scaled", (F.col(value) - F.col("__low")) / spread).drop("__low", "__high")


def detrended(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``df`` with ``residual`` from the straight line of least squares per group."""
    lines = df.groupBy(*by).agg(F.regr_slope(value, at).alias("__a"), F.regr_intercept(value, at).alias("__b"))
    return df.join(lines, by).withColumn("residual", F.col(value) - (F.col("__a") * F.col(at) + F.col("__b"))).drop("__a", "__b")


def periodogram(df: DataFrame, by: list[str], at: str, value: str, shortest: float, longest: float, count: int) -> DataFrame:
    """Normalised Lomb-Scargle power per group and frequency; frequencies are even from 1/longest to 1/shortest.

    Each sample meets each of ``count`` frequencies, and sums are pre-aggregated; values should have no mean.
    """
    step = (1 / shortest - 1 / longest) / (count - 1)
    spread = df.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("__w", 2 * math.pi * (1 / longest + F.col("f") * step) * F.col(at))
    y, c, s = F.col(value), F.cos("__w"), F.sin("__w")
    sums = spread.groupBy(*by, "f").agg(*[F.sum(e).alias(n) for n, e in (("yc", y * c), ("ys", y * s), ("cc", c * c), ("cs", c * s), ("yy", y * y), ("n", F.lit(1.0)))])
    ss = F.col("n") - F.col("cc")
    tau = 0.5 * F.atan2(2 * F.col("cs"), F.col("cc") - ss)
    ct, st = F.cos(tau), F.sin(tau)
    yc, ys = F.col("yc") * ct + F.col("ys") * st, F.col("ys") * ct - F.col("yc") * st
    cc = ct * ct * F.col("cc") + 2 * ct * st * F.col("cs") + st * st * ss
    s2 = ct * ct * ss - 2 * ct * st * F.col("cs") + st * st * F.col("cc")
    power = (F.try_divide(yc * yc, cc) + F.try_divide(ys * ys, s2)) / F.col("yy")
    return sums.select(*by, (1 / longest + F.col("f") * step).alias("frequency"), F.col("f"), power.alias("power"))


def best_period(power: DataFrame, by: list[str]) -> DataFrame:
    """The period of greatest power, the longest on ties."""
    best = power.groupBy(*by).agg(F.max(F.struct("power", (-F.col("f")).alias("o"), "frequency")).alias("b"))
    return best.select(*by, (1 / F.col("b.frequency")).alias("period"), F.col("b.power").alias("power"))


def subpixel(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Places of the least ``value`` per group, refined by the parabola through its neighbours."""
    w = Window.partitionBy(*by).orderBy(at)
    near = df.withColumn("__l", F.lag(value).over(w)).withColumn("__r", F.lead(value).over(w))
    least = near.groupBy(*by).agg(F.min(F.struct(value, at, "__l", "__r")).alias("m"))
    bend = F.col("m.__l") - 2 * F.col(f"m.{value}") + F.col("m.__r")
    shift = clip(0.5 * (F.col("m.__l") - F.col("m.__r")) / bend, -1.0, 1.0)
    return least.select(*by, (F.col(f"m.{at}") + F.when(bend > 1e-12, shift).otherwise(0.0)).alias("position"))
