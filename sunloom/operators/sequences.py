"""Ordered relations: islands and windows, arclength, integrals, hydrostatic columns, walks, deltas.

Every window is partitioned by the sequence's key; ``by`` may not be empty for tables that grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: list[str], at: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(at)


def running(by: list[str], at: str) -> WindowSpec:
    return ordered(by, at).rowsBetween(Window.unboundedPreceding, 0)


def regular_windows(ticks: DataFrame, by: list[str], at: str, n: int, cadence: float, tolerance: float = 1e-6) -> DataFrame:
    """First rows of windows of ``n`` ticks that don't overlap and lie in islands of even ``cadence``.

    Adds ``island`` (its number in the group), ``k`` (place in the island). A group of fewer than ``n`` ticks has none.
    """
    gap = F.col(at) - F.lag(at).over(ordered(by, at))
    cut = F.when(gap.isNull() | (F.abs(gap - cadence) > tolerance), 1).otherwise(0)
    islands = ticks.withColumn("__cut", cut).withColumn("island", F.sum("__cut").over(running(by, at)))
    inside = Window.partitionBy(*by, "island")
    numbered = islands.withColumn("k", F.row_number().over(inside.orderBy(at)) - 1).withColumn("__size", F.count(F.lit(1)).over(inside))
    return numbered.filter((F.col("k") % n == 0) & (F.col("k") + n <= F.col("__size"))).drop("__cut", "__size")


def irregular(ticks: DataFrame, by: list[str], at: str) -> DataFrame:
    """Ticks that don't come after the one before: what a strict sequence may not have."""
    return ticks.withColumn("__before", F.lag(at).over(ordered(by, "idx"))).filter(F.col(at) <= F.col("__before")).drop("__before")


def trapezoid_weight(by: list[str], at: str) -> Column:
    """Half the distance to both neighbours; one for a single point."""
    w = ordered(by, at)
    left, right = F.col(at) - F.lag(at).over(w), F.lead(at).over(w) - F.col(at)
    both = F.coalesce(left, F.lit(0.0)) + F.coalesce(right, F.lit(0.0))
    return F.when(left.isNull() & right.isNull(), 1.0).otherwise(both / 2)


def arclength(by: list[str], at: str, *coordinates: str) -> Column:
    """Distance along a curve from its first point."""
    squares = sum(F.pow(F.col(c) - F.lag(c).over(ordered(by, at)), 2) for c in coordinates)
    return F.sum(F.coalesce(F.sqrt(squares), F.lit(0.0))).over(running(by, at))


def gradient(by: list[str], at: str, value: str, s: str) -> Column:
    """Second-order central difference on uneven steps, one-sided at the ends."""
    w = ordered(by, at)
    a, b = F.col(s) - F.lag(s).over(w), F.lead(s).over(w) - F.col(s)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    v = F.col(value)
    inner = (a * a * after + (b * b - a * a) * v - b * b * before) / (a * b * (a + b))
    return F.when(a.isNull(), (after - v) / b).when(b.isNull(), (v - before) / a).otherwise(inner)


def simpson_steps(df: DataFrame, by: list[str], at: str, value: str, s: str) -> DataFrame:
    """``df`` with ``step``: Simpson's integral over the interval that ends at each row, 0 at the first.

    Intervals go in turn with the next point and the one before: the first, third, ... use the parabola through their
    ends and the following point, the others through the preceding one; a last interval without follower uses the
    preceding; two points alone use the trapezoid.
    """
    w = ordered(by, at)
    v = lambda k: F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)
    x = lambda k: F.lead(s, k).over(w) if k > 0 else F.lag(s, -k).over(w) if k < 0 else F.col(s)

    def parabola(h1: Column, h2: Column, y1: Column, y2: Column, y3: Column) -> Column:
        """Integral over the first of two neighbouring intervals."""
        return h1 / 6 * (y1 * (3 - h1 / (h1 + h2)) + y2 * (3 + h1 * h1 / (h2 * (h1 + h2)) + h1 / (h1 + h2)) - y3 * h1 * h1 / (h2 * (h1 + h2)))

    number = F.row_number().over(w)
    ahead = parabola(x(0) - x(-1), x(1) - x(0), v(-1), v(0), v(1))
    behind = parabola(x(0) - x(-1), x(-1) - x(-2), v(0), v(-1), v(-2))
    straight = (x(0) - x(-1)) * (v(0) + v(-1)) / 2
    odd = number % 2 == 0  # the row ends interval number - 1
    step = F.when(number == 1, 0.0).when(odd & x(1).isNotNull(), ahead).when(x(-2).isNotNull(), behind).otherwise(straight)
    return df.withColumn("step", step)


def cumulative_integral(df: DataFrame, by: list[str], at: str, value: str, s: str) -> DataFrame:
    """``df`` with ``integral`` of ``value`` over ``s`` from the first row of each group."""
    return simpson_steps(df, by, at, value, s).withColumn("integral", F.sum("step").over(running(by, at))).drop("step")


def hydrostatic(df: DataFrame, by: list[str], at: str, edge_pressure: float) -> DataFrame:
    """``df`` (z, s, slope, scale) with ``pressure``: integrated from both ends of each group to its lowest point.

    ``scale`` is the relative growth of pressure per length of height, ``slope`` the height per arclength, unsigned. The
    side whose pressure at the lowest point is higher is scaled to the other.
    """
    group = Window.partitionBy(*by)
    lowest = F.min(F.struct("z", at)).over(group)[at]
    sided = df.withColumn("__low", lowest).withColumn("__rate", F.col("scale") * F.col("slope"))
    left = sided.filter(F.col(at) <= F.col("__low")).withColumn("__at", F.col(at).cast("double")).withColumn("__side", F.lit(0)).withColumn("__s", F.col("s"))
    right = sided.filter(F.col(at) >= F.col("__low")).withColumn("__at", -F.col(at).cast("double")).withColumn("__side", F.lit(1)).withColumn("__s", -F.col("s"))
    keys = [*by, "__side"]
    both = cumulative_integral(left.unionByName(right), keys, "__at", "__rate", "__s").withColumn("__p", edge_pressure * F.exp("integral"))
    centre = F.max(F.when(F.col(at) == F.col("__low"), F.col("__p"))).over(Window.partitionBy(*keys))
    both = both.withColumn("__centre", centre)
    least = F.min("__centre").over(group)
    both = both.withColumn("pressure", F.col("__p") * least / F.col("__centre"))
    # The lowest point is in both sides with the same pressure; the right one stays.
    return both.filter((F.col("__side") == 1) | (F.col(at) < F.col("__low"))).select(*df.columns, "pressure")


def counter_uniform(*keys: Column, stream: int) -> Column:
    """A number in [0, 1) from whole-number keys alone: the same in any order, partition and engine."""
    mixed = F.lit(stream * 7919 + 17).cast("long")
    for key in keys:
        mixed = F.pmod((mixed * 48271 + key * 69621 + 11), F.lit(2147483647))
        mixed = F.pmod(mixed * 16807 + 7, F.lit(2147483647))
    return mixed / F.lit(2147483647.0)


def walk(steps: DataFrame, by: list[str], at: str, columns: list[str]) -> DataFrame:
    """Running sums of ``columns`` along ``at``."""
    return steps.select(*by, at, *[F.sum(c).over(running(by, at)).alias(c) for c in columns])


def since_first(value: str, by: list[str], at: str) -> Column:
    return F.col(value) - F.first(value).over(ordered(by, at))


def strictly_next(frames: DataFrame, by: list[str], at: str = "frame_idx") -> DataFrame:
    """Frames that don't follow the one before by exactly one: what an ordered writer may not accept."""
    return frames.withColumn("__before", F.lag(at).over(ordered(by, at))).filter(F.col(at) != F.coalesce(F.col("__before") + 1, F.lit(0))).drop("__before")
