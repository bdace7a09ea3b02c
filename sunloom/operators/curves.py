"""Curves set into a field of view, and threads set onto curves: spans, offsets, point counts, points of circular dips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dips
from .sequences import counter_uniform

#: The share of a field of view's side that stays free, the least envelope of a channel, and how far beyond
#: its half width threads may lie, with the least envelope that counts for it.
MARGIN, ENVELOPE, REACH, LEAST = 0.05, 0.15, 1.6, 0.25


def oriented(curves: DataFrame, by: str, turn_deg: Column, flip_x: Column, flip_y: Column, width: float, height: float) -> DataFrame:
    """Curves (``by``, idx, x, y) around their mean, mirrored, turned and set into the middle of the field of view.

    A curve that fits is moved just as far as keeps MARGIN of each side free; other columns of ``curves`` stay.
    """
    whole = Window.partitionBy(by)
    centred = curves.withColumn("x", F.col("x") - F.avg("x").over(whole)).withColumn("y", F.col("y") - F.avg("y").over(whole))
    x, y = F.when(flip_x, -F.col("x")).otherwise(F.col("x")), F.when(flip_y, -F.col("y")).otherwise(F.col("y"))
    c, s = F.cos(F.radians(turn_deg)), F.sin(F.radians(turn_deg))
    turned = centred.withColumn("__u", x * c - y * s + width / 2).withColumn("__v", x * s + y * c + height / 2)
    for name, side in (("__u", width), ("__v", height)):
        low, high = MARGIN * side - F.min(name).over(whole), (1 - MARGIN) * side - F.max(name).over(whole)
        turned = turned.withColumn(f"{name}_by", F.least(F.greatest(F.lit(0.0), low), high))
    return turned.withColumn("x", F.col("__u") + F.col("__u_by")).withColumn("y", F.col("__v") + F.col("__v_by")).drop("__u", "__v", "__u_by", "__v_by")


def span_on(centre: Column, span: Column, total: Column) -> tuple[Column, Column]:
    """Start and end of an interval around ``centre`` that is moved back, not cut, where it leaves [0, ``total``]."""
    held = F.least(span, total)
    start = F.least(F.greatest(centre - held / 2, F.lit(0.0)), total - held)
    return start, start + held


def envelope(position: Column, total: Column, modulation: Column) -> Column:
    """Relative width of a channel: an ellipse over its length, not under ENVELOPE, times a modulation around one."""
    ellipse = F.sqrt(F.greatest(1 - F.pow(2 * position / total - 1, 2), F.lit(0.0)))
    return F.greatest(ellipse, F.lit(ENVELOPE)) * modulation


def confined(offset: Column, width: Column, half_width: Column | float) -> Column:
    """``offset`` drawn back softly into the channel of relative ``width``."""
    limit = REACH * F.greatest(width, F.lit(LEAST)) * half_width
    return limit * F.tanh(offset / limit)


def odd_points(length: Column, spacing: float, least: int = 5) -> Column:
    """An odd number of points, so that one is in the middle, no farther apart than ``spacing``."""
    n = F.greatest(F.ceil(length / spacing) + 1, F.lit(least)).cast("long")
    return n + (1 - n % 2)


def dip_points(threads: DataFrame, by: str, spacing: float) -> DataFrame:
    """Points (``by``, k, s, x, y, z) of circular dips: ``threads`` has anchor_x, anchor_y, direction_x, direction_y,
    length_km, dip_radius_km and height_km, of the lowest point. A thread's points come from its own row, without a shuffle."""
    n = odd_points(F.col("length_km"), spacing)
    points = threads.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    s = F.col("length_km") * F.col("k") / (F.col("n") - 1)
    angle = s / F.col("dip_radius_km") - dips.half_angle(F.col("length_km"), F.col("dip_radius_km"))
    along = F.col("dip_radius_km") * F.sin(angle)
    return points.select(
        by,
        "k",
        s.alias("s"),
        (F.col("anchor_x") + along * F.col("direction_x")).alias("x"),
        (F.col("anchor_y") + along * F.col("direction_y")).alias("y"),
        (F.col("height_km") + 2 * F.col("dip_radius_km") * F.pow(F.sin(angle / 2), 2)).alias("z"),
    )


def directions(pitch_deg: Column, tangent_deg: Column) -> tuple[Column, Column]:
    """A thread's direction, turned by its pitch from the tangent of its curve."""
    turn = F.radians(pitch_deg + tangent_deg)
    return F.cos(turn), F.sin(turn)


def even(value: Column) -> Column:
    """Rounded up to an even number, as video frames need."""
    return value + value % 2




def drawn_orientation(seed: Column) -> tuple[Column, Column]:
    """Angle from -90 to 90 degrees and chirality (-1 or 1) of an experiment that leaves them to its seed."""
    angle, side = (counter_uniform(seed, F.lit(0).cast("long"), stream=k) for k in (61, 62))
    return 180.0 * angle - 90.0, F.when(side < 0.5, -1).otherwise(1)


def translated(points: DataFrame, shifts: DataFrame, by: str, columns: dict[str, str]) -> DataFrame:
    """Every point in every frame of ``shifts`` (``by``, frame_idx, ...), moved by its thread's shift; ``columns`` names the
    shift of each coordinate. A thread without shifts has no rows."""
    kept = [c for c in points.columns if c not in columns]
    joined = points.join(shifts.select(by, "frame_idx", *columns.values()), by)
    return joined.select("frame_idx", *kept, *[(F.col(c) + F.col(d)).alias(c) for c, d in columns.items()])


def segments(points: DataFrame, by: list[str], at: str, columns: list[str]) -> DataFrame:
    """Consecutive points of each curve as segments: ``by``, ``at``, and both ends of each of ``columns`` (a_, b_)."""
    ahead = Window.partitionBy(*by).orderBy(at)
    ends = [F.lead(c).over(ahead).alias(f"b_{c}") for c in columns]
    made = points.select(*by, at, *[F.col(c).alias(f"a_{c}") for c in columns], *ends, F.lead(at).over(ahead).alias("__next"))
    return made.filter(F.col("__next").isNotNull()).drop("__next")
