"""Images as sparse relations of pixels: scatter, block means, blur, velocity labels, thread masks, arrows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transfer import pixel_gaussian


def block_average(pixels: DataFrame, by: list[str], values: list[str], factor: int, rows: int, columns: int) -> DataFrame:
    """Means over blocks of factor by factor pixels; what doesn't fill a block at the far edges is left out."""
    inside = (F.col("row_idx") < rows // factor * factor) & (F.col("col_idx") < columns // factor * factor)
    block = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return pixels.filter(inside).groupBy(*by, block("row_idx"), block("col_idx")).agg(*[F.avg(v).alias(v) for v in values])


def scatter(contributions: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return contributions.groupBy(*by, "row_idx", "col_idx").agg(*[F.sum(v).alias(v) for v in values])


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def reflected(at: Column, size: int) -> Column:
    """Index mirrored about the edges of the image, the edge pixel counted twice."""
    folded = F.pmod(at, F.lit(2 * size))
    return F.when(folded < size, folded).otherwise(2 * size - 1 - folded)


def blur(pixels: DataFrame, by: list[str], values: list[str], sigma: float, rows: int, columns: int) -> DataFrame:
    """Gaussian blur in two passes of explode and sum; missing pixels are zero, edges reflect.

    Each pass gives a pixel's value to all pixels that reach it; a kernel wider than the image folds more than once.
    """
    weights = gaussian_weights(sigma)
    reach = len(weights) // 2
    table = F.array(*[F.lit(w) for w in weights])

    def one(df: DataFrame, axis: str, size: int) -> DataFrame:
        # The target t reads source reflect(t + k): source s serves every t whose t + k folds onto s.
        turns = 1 + reach // size
        images = [c + 2 * size * n for n in range(-turns, turns + 1) for c in (F.col(axis), -1 - F.col(axis))]
        spread = df.withColumn("__image", F.explode(F.array(*[i.cast("long") for i in images])))
        spread = spread.filter(F.col("__image").between(-reach, size - 1 + reach))
        spread = spread.withColumn("__to", F.explode(F.sequence(F.greatest(F.col("__image") - reach, F.lit(0)), F.least(F.col("__image") + reach, F.lit(size - 1)))))
        weight = F.element_at(table, (F.col("__image") - F.col("__to") + reach + 1).cast("int"))
        other = [c for c in ("row_idx", "col_idx") if c != axis]
        return spread.groupBy(*by, *other, F.col("__to").alias(axis)).agg(*[F.sum(F.col(v) * weight).alias(v) for v in values])

    return one(one(pixels, "row_idx", rows), "col_idx", columns)


def weighted_velocity(contributions: DataFrame, by: list[str], floor: float) -> DataFrame:
    """Velocity weighted by optical depth per pixel, zero where the weight is not above ``floor``; one aggregation."""
    sums = contributions.groupBy(*by, "row_idx", "col_idx").agg(F.sum("tau").alias("weight"), F.sum(F.col("tau") * F.col("vx")).alias("nx"), F.sum(F.col("tau") * F.col("vy")).alias("ny"))
    held = F.col("weight") > floor
    share = lambda n: F.when(held, F.try_divide(F.col(n), F.col("weight"))).otherwise(0.0)
    return sums.select(*by, "row_idx", "col_idx", "weight", share("nx").alias("vx"), share("ny").alias("vy"))


def thread_contributions(points: DataFrame, by: list[str], rows: int, columns: int) -> DataFrame:
    """Optical depth that samples of threads give to pixels.

    ``points``: ``by`` (the thread), x_px, y_px, sigma_px, amplitude. Samples below 1e-7 of their thread's strongest are
    left out; each of the others covers pixels up to 4 sigma + 1/2 around it with the Gaussian's integral over the pixel.
    """
    top = F.max("amplitude").over(Window.partitionBy(*by))
    active = points.withColumn("__top", top).filter((F.col("amplitude") > 0) & (F.col("amplitude") >= 1e-7 * F.col("__top")))
    half = F.greatest(F.ceil(4 * F.col("sigma_px") + 0.5), F.lit(1))

    def window(name: str, size: int) -> Column:
        centre = F.rint(name).cast("long")
        low, high = F.greatest(centre - half, F.lit(0)), F.least(centre + half, F.lit(size - 1))
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    spread = active.withColumn("row_idx", window("y_px", rows)).withColumn("__gy", pixel_gaussian(F.col("row_idx"), F.col("y_px"), F.col("sigma_px")))
    spread = spread.withColumn("col_idx", window("x_px", columns)).withColumn("__gx", pixel_gaussian(F.col("col_idx"), F.col("x_px"), F.col("sigma_px")))
    return spread.withColumn("tau", F.col("amplitude") * F.col("__gy") * F.col("__gx")).drop("__top", "__gx", "__gy")


def thread_masks(segments: DataFrame, by: list[str], rows: int, columns: int, dilation: int = 0) -> DataFrame:
    """Pixels that tubes cover: ``by``, row_idx, col_idx, each once.

    ``segments``: r0, c0, radius0, r1, c1, radius1 in whole pixels (radii any). The line between the ends is stepped by its
    longer side, radii go linearly, and each step covers the disk of its radius plus half a pixel's diagonal. ``dilation``
    grows the result by a disk.
    """
    steps = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")))
    line = segments.withColumn("__steps", steps).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__steps").cast("long"))))
    share = F.when(F.col("__steps") > 0, F.col("__k") / F.col("__steps")).otherwise(0.0)
    at = lambda a, b: (F.col(a) + F.rint((F.col(b) - F.col(a)) * share)).cast("long")
    line = line.select(*by, at("r0", "r1").alias("row_idx"), at("c0", "c1").alias("col_idx"), (F.col("radius0") + (F.col("radius1") - F.col("radius0")) * share + math.sqrt(2) / 2).alias("reach"))
    line = line.groupBy(*by, "row_idx", "col_idx").agg(F.max("reach").alias("reach"))
    covered = disk(line, by, F.col("reach"), rows, columns)
    return disk(covered, by, F.lit(float(dilation)), rows, columns) if dilation else covered


def disk(pixels: DataFrame, by: list[str], reach: Column, rows: int, columns: int) -> DataFrame:
    """Pixels within ``reach`` of any of ``pixels``, inside the image."""
    offsets = F.sequence(-F.ceil(reach), F.ceil(reach))
    spread = pixels.withColumn("__reach", reach).withColumn("__dr", F.explode(offsets)).withColumn("__dc", F.explode(F.sequence(-F.ceil(F.col("__reach")), F.ceil(F.col("__reach")))))
    spread = spread.filter(F.col("__dr") * F.col("__dr") + F.col("__dc") * F.col("__dc") <= F.col("__reach") * F.col("__reach"))
    moved = spread.select(*by, (F.col("row_idx") + F.col("__dr")).alias("row_idx"), (F.col("col_idx") + F.col("__dc")).alias("col_idx"))
    return moved.filter(F.col("row_idx").between(0, rows - 1) & F.col("col_idx").between(0, columns - 1)).distinct()


def strongest_per_cell(pixels: DataFrame, by: list[str], stride: int, least_speed: float) -> DataFrame:
    """Per cell of ``stride`` pixels the one of greatest weight times speed, the first in reading order on ties
    to nine digits; unit direction and speed, unless that speed is not above ``least_speed`` or nothing moves."""
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    scored = pixels.withColumn("speed", speed).withColumn("__score", F.round(F.col("weight") * F.col("speed"), 9)).filter("__score > 0")
    cell = lambda c: F.floor(F.col(c) / stride).cast("long")
    best = F.max(F.struct("__score", -F.col("row_idx"), -F.col("col_idx"), "vx", "vy", "speed"))
    top = scored.groupBy(*by, cell("row_idx").alias("__r"), cell("col_idx").alias("__c")).agg(best.alias("b"))
    named = top.select(*by, (-F.col("b.col2")).alias("row_idx"), (-F.col("b.col3")).alias("col_idx"), "b.vx", "b.vy", "b.speed")
    return named.filter(F.col("speed") > least_speed).select(*by, "row_idx", "col_idx", (F.col("vx") / F.col("speed")).alias("ux"), (F.col("vy") / F.col("speed")).alias("uy"), "speed")


def mask_bounds(pixels: DataFrame, by: list[str], padding: int, rows: int, columns: int) -> DataFrame:
    """Half-open bounds of the pixels per group, padded and kept inside the image."""
    low = lambda c: F.greatest(F.min(c) - padding, F.lit(0))
    high = lambda c, n: F.least(F.max(c) + padding + 1, F.lit(n))
    return pixels.groupBy(*by).agg(low("row_idx").alias("row0"), high("row_idx", rows).alias("row1"), low("col_idx").alias("col0"), high("col_idx", columns).alias("col1"))
