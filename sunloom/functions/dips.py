"""Geometry of circular dips and of profiles along threads, as Column expressions in kilometres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def half_angle(length: Column, radius: Column) -> Column:
    return length / (2 * radius)


def depth(length: Column, radius: Column) -> Column:
    """Depth of an arc of a length on a radius; exact for shallow arcs."""
    return 2 * radius * F.pow(F.sin(half_angle(length, radius) / 2), 2)


def chord(length: Column, radius: Column) -> Column:
    return 2 * radius * F.sin(half_angle(length, radius))


def fits(length: Column, radius: Column) -> Column:
    """An arc is no longer than a semicircle."""
    return (length > 0) & (radius > 0) & (length <= math.pi * radius)


def arc_points(length: Column, radius: Column, bottom: Column, share: Column) -> tuple[Column, Column, Column]:
    """(along the chord, height, arclength) at ``share`` of the arc, from 0 to 1."""
    angle = half_angle(length, radius) * (2 * share - 1)
    return radius * F.sin(angle), bottom + 2 * radius * F.pow(F.sin(angle / 2), 2), radius * (angle + half_angle(length, radius))


def xi(s: Column, length: Column) -> Column:
    """0 at the middle of a thread, 1 at its ends."""
    middle = length / 2
    return clip(F.abs(s - middle) / F.greatest(middle, F.lit(1.0)), 0.0, 1.0)


def xi_one_sided(s: Column, length: Column) -> Column:
    return clip(s / F.greatest(length, F.lit(1.0)), 0.0, 1.0)


def tapered_radius(radius: Column, at: Column, floor: float) -> Column:
    return radius * (floor + (1 - floor) * F.sqrt(1 - F.pow(at, 2)))


def smoothstep(t: Column) -> Column:
    return t * t * (3 - 2 * t)


def foot_envelope(s: Column, length: Column, share: float) -> Column:
    """Fades to zero over ``share`` of the length at both ends."""
    ramp = F.greatest(share * length, F.lit(1.0))
    return smoothstep(clip(s / ramp, 0.0, 1.0)) * smoothstep(clip((length - s) / ramp, 0.0, 1.0))


def expanded_bounds(low: Column, high: Column, limit: Column, least: float, padding: float) -> tuple[Column, Column]:
    """An interval padded by a share of its size, grown to a least size around its middle, kept inside [0, limit]."""
    size = F.greatest((high - low) * (1 + 2 * padding), least * limit)
    size = F.least(size, limit)
    start = clip((low + high) / 2 - size / 2, F.lit(0.0), limit - size)
    return start, start + size


def boundary_distance(x: Column, y: Column, dx: Column, dy: Column, width: float, height: float) -> Column:
    """Distance along a direction to the edge of an image of pixel centres."""
    hits = F.array(
        F.when(dx > 1e-12, (width - 1 - x) / dx), F.when(dx < -1e-12, -x / dx), F.when(dy > 1e-12, (height - 1 - y) / dy), F.when(dy < -1e-12, -y / dy)
    )
    return F.array_min(F.filter(hits, lambda d: d >= 0))
