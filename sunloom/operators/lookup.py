"""Interpolating lookups: piecewise linear along ordered knots, and trilinear in a small grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolate(queries: DataFrame, knots: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """``queries`` with ``values`` of ``knots`` interpolated linearly at ``at``, per ``by``; held beyond the outermost.

    Knots and queries are merged and each row looks back and ahead for its nearest knots in one window: one shuffle on
    ``by``, no range join. A query on a knot gets the knot's values; groups without knots get null.
    """
    extra = [c for c in queries.columns if c not in (*by, at)]
    knot = F.struct(at, *values)
    left = knots.select(*by, at, knot.alias("knot"), F.lit(0).alias("kind"), *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in extra])
    right = queries.select(*by, at, F.lit(None).cast(left.schema["knot"].dataType).alias("knot"), F.lit(1).alias("kind"), *extra)
    # Looking ahead is looking back in descending order: a frame that ends in the future would start anew at every row.
    back = Window.partitionBy(*by).orderBy(at, "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(at).desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right).select("*", F.last("knot", ignorenulls=True).over(back).alias("low"), F.last("knot", ignorenulls=True).over(ahead).alias("high"))

    def value(name: str) -> Column:
        low, high = F.col("low"), F.col("high")
        share = (F.col(at) - low[at]) / (high[at] - low[at])
        line = F.when(high[at] > low[at], low[name] + (high[name] - low[name]) * share).otherwise(low[name])
        return F.when(low.isNull(), high[name]).when(high.isNull(), low[name]).otherwise(line)

    return merged.filter("kind = 1").select(*by, at, *extra, *[value(v).alias(v) for v in values])


def cell(value: Column, axis: list[float]) -> tuple[Column, Column]:
    """Index of the interval of ``axis`` that holds ``value`` clipped to it, and the share of the way through."""
    held = F.least(F.greatest(value, F.lit(axis[0])), F.lit(axis[-1]))
    steps = {round(b - a, 9) for a, b in zip(axis, axis[1:], strict=False)}
    if len(steps) == 1:
        index = F.least(F.floor((held - axis[0]) / (axis[1] - axis[0])), F.lit(len(axis) - 2)).cast("int")
    else:
        index = reduce(lambda a, b: a + b, [(held >= x).cast("int") for x in axis[1:-1]], F.lit(0))
    low, high = F.array(*[F.lit(x) for x in axis[:-1]]), F.array(*[F.lit(x) for x in axis[1:]])
    a, b = F.element_at(low, index + 1), F.element_at(high, index + 1)
    return index, (held - a) / (b - a)


def corner_cells(table: DataFrame, axes: dict[str, list[float]], values: list[str]) -> DataFrame:
    """One row per cell of the grid, with an array of the eight corners' values; the axes have few points.

    ``table`` has a row per grid point; cells are named by the index of their lower corner on each axis.
    """
    names = list(axes)
    indexed = table
    for name, points in axes.items():
        at = F.array_position(F.array(*[F.lit(float(p)) for p in points]), F.col(name).cast("double")).cast("int") - 1
        indexed = indexed.withColumn(f"{name}_at", at)
    corners = indexed.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    for k, (name, points) in enumerate(axes.items()):
        side = F.shiftright("corner", k).bitwiseAND(1)
        corners = corners.withColumn(f"{name}_cell", F.col(f"{name}_at") - side).filter((F.col(f"{name}_cell") >= 0) & (F.col(f"{name}_cell") < len(points) - 1))
    packed = F.array_sort(F.collect_list(F.struct("corner", *values)))
    return corners.groupBy(*[f"{n}_cell" for n in names]).agg(packed.alias("corners"))


def trilinear(queries: DataFrame, table: DataFrame, axes: dict[str, tuple[Column, list[float]]], values: list[str]) -> DataFrame:
    """``queries`` with ``values`` of the three-dimensional ``table`` at the axes' columns, clipped to the grid.

    ``table`` has one row per combination of the axes' points, so its size is their product and it can be broadcast.
    """
    cells = F.broadcast(corner_cells(table, {n: p for n, (_, p) in axes.items()}, values))
    out, shares = queries, []
    for name, (column, points) in axes.items():
        index, share = cell(column, points)
        out = out.withColumn(f"{name}_cell", index).withColumn(f"{name}_share", share)
        shares.append(f"{name}_share")
    joined = out.join(cells, [f"{n}_cell" for n in axes])

    def value(name: str) -> Column:
        total = F.lit(0.0)
        for corner in range(8):
            weight = F.lit(1.0)
            for k, share in enumerate(shares):
                weight = weight * (F.col(share) if corner >> k & 1 else 1 - F.col(share))
            total = total + weight * F.col("corners")[corner][name]
        return total

    return joined.select(*queries.columns, *[value(v).alias(v) for v in values])


def saturation(columns: dict[str, tuple[Column, list[float]]]) -> dict[str, Column]:
    """Per axis, whether a value lies below or above the grid."""
    return {f"{name}_{side}": (c < p[0] if side == "low" else c > p[-1]) for name, (c, p) in columns.items() for side in ("low", "high")}
