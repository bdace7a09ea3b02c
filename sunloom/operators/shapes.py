"""Curves and frames: resampling, spine choice, pitch, disks, candidate crops, smooth noise, samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import interpolate
from .sequences import arclength, counter_uniform


def resample(curves: DataFrame, by: str, at: str, values: list[str], points: int) -> DataFrame:
    """``points`` points per curve, even in arclength of its (x, y): ``by``, k, arc and ``values``."""
    measured = curves.withColumn("arc", arclength([by], at, "x", "y"))
    lengths = measured.groupBy(by).agg(F.max("arc").alias("__length"))
    asked = lengths.select(by, F.col("__length"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    asked = asked.select(by, "k", (F.col("__length") * F.col("k") / float(points - 1)).alias("arc"))
    return interpolate(asked, measured.select(by, "arc", *values), [by], "arc", values).select(by, "k", "arc", *values)


def fitting_spines(curves: DataFrame, by: str, turn_deg: float, width: float, height: float, share: float, shortest: float, longest: float, at: str = "idx") -> DataFrame:
    """Curves whose box, turned by an angle, fits into ``share`` of an image and whose length lies within bounds."""
    c, s = math.cos(math.radians(turn_deg)), math.sin(math.radians(turn_deg))
    turned = curves.withColumn("__u", F.col("x") * c - F.col("y") * s).withColumn("__v", F.col("x") * s + F.col("y") * c).withColumn("__arc", arclength([by], at, "x", "y"))
    span = lambda n: F.max(n) - F.min(n)
    boxes = turned.groupBy(by).agg(span("__u").alias("width"), span("__v").alias("height"), F.max("__arc").alias("length"))
    return boxes.filter((F.col("width") <= share * width) & (F.col("height") <= share * height) & F.col("length").between(shortest, longest))


def mean_pitch(points: DataFrame, by: list[str], curve: str, at: str) -> DataFrame:
    """Mean unsigned angle in degrees between segments of curves and the direction (tx, ty), weighted by length."""
    w = Window.partitionBy(*by, curve).orderBy(at)
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    steps = points.withColumn("__dx", dx).withColumn("__dy", dy).withColumn("__l", F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy"))).filter("__l > 0")
    cosine = F.abs(F.col("__dx") * F.col("tx") + F.col("__dy") * F.col("ty")) / (F.col("__l") * F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty")))
    angle = F.degrees(F.acos(F.least(cosine, F.lit(1.0))))
    return steps.groupBy(*by).agg((F.sum(angle * F.col("__l")) / F.sum("__l")).alias("pitch_deg"))


def disk_geometry(pixels: DataFrame, by: list[str], value: str, floor: float) -> DataFrame:
    """Centre and radius of the bright support of each frame, and whether it is about as wide as high."""
    lit = pixels.filter(F.col(value) > floor)
    box = lit.groupBy(*by).agg(F.min("row_idx").alias("r0"), F.max("row_idx").alias("r1"), F.min("col_idx").alias("c0"), F.max("col_idx").alias("c1"))
    high, wide = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    return box.select(*by, ((F.col("c0") + F.col("c1")) / 2).alias("cx"), ((F.col("r0") + F.col("r1")) / 2).alias("cy"), ((high + wide) / 4).alias("radius"), (F.abs(high - wide) <= 0.02 * F.greatest(high, wide)).alias("round"))


def off_disk(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    return F.pow(x - cx, 2) + F.pow(y - cy, 2) > F.pow(radius + 0.5, 2)


def viewing_angle(dx: Column, dy: Column, radius: float) -> tuple[Column, Column]:
    """Cosine of the angle from disk centre and direction to the limb in degrees from 0 to 360."""
    mu = F.sqrt(F.greatest(1 - (dx * dx + dy * dy) / (radius * radius), F.lit(0.0)))
    return mu, F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def prepared_image(pixels: DataFrame, by: list[str], value: str, off: Column) -> DataFrame:
    """``pixels`` with ``scaled``: missing values take the mean of the off-disk pixels, nothing below 0, the greatest is 1."""
    good = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    means = pixels.groupBy(*by).agg(F.avg(F.when(good & off, F.col(value))).alias("__m"))
    filled = pixels.join(means, by).withColumn("scaled", F.greatest(F.when(good, F.col(value)).otherwise(F.coalesce("__m", F.lit(0.0))), F.lit(0.0)))
    tops = filled.groupBy(*by).agg(F.max("scaled").alias("__t"))
    return filled.join(tops, by).withColumn("scaled", F.when(F.col("__t") > 0, F.col("scaled") / F.col("__t")).otherwise(0.0)).drop("__m", "__t")


def candidate_crops(frames: DataFrame, by: str, size: tuple[int, int], crop: tuple[int, int], draws: int, stride: int) -> DataFrame:
    """Crops to try per frame: counter draws first, then a grid that reaches the far edges; each place once, at its
    first position. (``by``, position, x0, y0, x1, y1)"""
    top_x, top_y = size[0] - crop[0], size[1] - crop[1]
    random = frames.select(by, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("position"))
    place = lambda top, stream: F.floor(counter_uniform(F.col(by), F.col("position"), stream=stream) * (top + 1)).cast("long")
    random = random.select(by, F.col("position").cast("long").alias("position"), place(top_x, 21).alias("x0"), place(top_y, 22).alias("y0"))
    steps = lambda top: F.array_distinct(F.concat(F.sequence(F.lit(0), F.lit(top), F.lit(stride)), F.array(F.lit(top))))
    grid = frames.select(by, F.explode(steps(top_y)).alias("y0")).select(by, "y0", F.explode(steps(top_x)).alias("x0"))
    grid = grid.select(by, (draws + F.col("y0") * (top_x + 1) + F.col("x0")).cast("long").alias("position"), F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0"))
    first = random.unionByName(grid).groupBy(by, "x0", "y0").agg(F.min("position").alias("position"))
    return first.select(by, "position", "x0", "y0", (F.col("x0") + crop[0]).alias("x1"), (F.col("y0") + crop[1]).alias("y1"))


def smooth_noise(series: DataFrame, by: str, at: str, count: int, sigma: float, stream: int = 31) -> DataFrame:
    """Counter noise blurred along ``at`` (0 to count - 1, edges reflect) and scaled to a peak of 1 per series."""
    from .raster import gaussian_weights, reflected

    weights = gaussian_weights(sigma)
    reach = len(weights) // 2
    reads = series.withColumn("__k", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("__from", reflected(F.col(at) + F.col("__k"), count))
    noise = counter_uniform(F.col(by), F.col("__from"), stream=stream) - 0.5
    summed = reads.groupBy(by, at).agg(F.sum(noise * F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("__k") + reach + 1)).alias("noise"))
    peak = F.max(F.abs("noise")).over(Window.partitionBy(by))
    return summed.withColumn("noise", F.when(peak > 0, F.col("noise") / peak).otherwise(F.col("noise")))


def clipped_lognormal(key: Column, median: float, sigma: float, low: float, high: float) -> Column:
    """A bounded lognormal number from two counter draws."""
    u, v = counter_uniform(key, F.lit(0), stream=41), counter_uniform(key, F.lit(1), stream=42)
    normal = F.sqrt(-2 * F.log(F.greatest(1 - u, F.lit(1e-12)))) * F.cos(2 * math.pi * v)
    return F.least(F.greatest(median * F.exp(sigma * normal), F.lit(low)), F.lit(high))


def evenly(df: DataFrame, by: str, at: str, most: int) -> DataFrame:
    """Up to ``most`` rows per group at even places, the first and last included."""
    w = Window.partitionBy(by)
    numbered = df.withColumn("__n", F.row_number().over(w.orderBy(at)) - 1).withColumn("__c", F.count(F.lit(1)).over(w))
    slots = F.floor(F.col("__n") * (most - 1) / F.greatest(F.col("__c") - 1, F.lit(1)))
    before = F.floor((F.col("__n") - 1) * (most - 1) / F.greatest(F.col("__c") - 1, F.lit(1)))
    return numbered.filter((F.col("__c") <= most) | (F.col("__n") == 0) | (slots > before)).drop("__n", "__c")
