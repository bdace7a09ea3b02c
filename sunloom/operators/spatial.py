"""Spatial joins by grid cells: nearest segments and points within a radius, overlapping boxes, nearest vectors in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import written


def dot(a: tuple, b: tuple) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b, strict=True)])


def minus(a: tuple, b: tuple) -> tuple:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def with_segment_distance(df: DataFrame, a: tuple, b: tuple, c: tuple, d: tuple, name: str) -> DataFrame:
    """``df`` with the distance in space between its segments ab and cd.

    All that is needed are six products of u = b - a, v = d - c, w = a - c. Each end is held against the other segment,
    and where the lines are skew and come closest inside both, that distance counts too.
    """
    u, v, w = minus(b, a), minus(d, c), minus(a, c)
    products = {"uu": dot(u, u), "vv": dot(v, v), "ww": dot(w, w), "uv": dot(u, v), "uw": dot(u, w), "vw": dot(v, w)}
    uu, vv, ww, uv, uw, vw = (F.col(f"__{k}") for k in products)

    def end(off: Column, along: Column, size: Column) -> Column:
        """Squared distance of a point from a segment: ``off`` its squared offset, ``along`` its product with the segment."""
        t = F.least(F.greatest(F.coalesce(F.try_divide(along, size), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return off - 2 * t * along + t * t * size

    ends = [end(ww, vw, vv), end(ww + 2 * uw + uu, vw + uv, vv), end(ww, -uw, uu), end(ww - 2 * vw + vv, uv - uw, uu)]
    area = uu * vv - uv * uv
    s, t = F.try_divide(uv * vw - vv * uw, area), F.try_divide(uu * vw - uv * uw, area)
    inside = (area > 4.93e-32 * uu * vv) & s.between(0, 1) & t.between(0, 1)
    inner = ww + s * s * uu + t * t * vv + 2 * s * uw - 2 * t * vw - 2 * s * t * uv
    least = F.least(*ends, F.when(inside, inner))
    named = df.withColumns({f"__{k}": p for k, p in products.items()})
    return named.withColumn(name, F.sqrt(F.greatest(least, F.lit(0.0)))).drop(*[f"__{k}" for k in products])


def near_pairs(left: DataFrame, right: DataFrame, at_left: list[str], at_right: list[str], radius: float) -> DataFrame:
    """Pairs whose points ``at_left`` and ``at_right`` lie in the same or neighbouring cells of size ``radius``.

    The left side goes to one cell, the right side to its 27 neighbours (in three dimensions), and cells are joined by
    equality: no pair within the radius is lost and no side is compared whole.
    """
    cells = lambda names: [F.floor(F.col(n) / radius).cast("long") for n in names]
    a = left.select("*", *[c.alias(f"cell{k}") for k, c in enumerate(cells(at_left))])
    b = right
    for k, c in enumerate(cells(at_right)):
        b = b.withColumn(f"cell{k}", F.explode(F.array(c - 1, c, c + 1)))
    # Both sides are dealt by cells in parts of few rows: pairs are many times the rows, and neither side's bytes tell how many.
    # So no side is taken for small and broadcast, and no parts are merged.
    names = [f"cell{k}" for k in range(len(at_left))]
    # Fewer parts than the session's shuffles have, a join would deal anew.
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-left.count() // 2_000))
    return a.repartition(parts, *names).hint("shuffle_hash").join(b.repartition(parts, *names), names)


def nearest_other(points: DataFrame, by: str, axes: list[str], radius: float, together: int = 64) -> DataFrame:
    """Per ``by`` the distance ``gap`` from its points to the nearest point of another one, where that is within ``radius``.

    Points are looked for within a reach that is small enough where they are densest, and those that find nothing look again
    within twice the reach, up to the radius. Points still looking keep their distance from each other, so few of them meet
    any one point, and a round's work grows with the points, not with their square. Equal places count once.
    """
    known = points.select(by, *[F.col(a).cast("double").alias(a) for a in axes]).dropna()
    places = written(known.groupBy(*axes).agg(F.min(by).alias("one"), F.max(by).alias("other")), "places")
    shared = places.filter("one <> other").select(*axes)
    found = known.join(shared, axes, "left_semi").select(by, F.lit(0.0).alias("gap"))
    asked = places.filter("one = other").select(F.col("one").alias("who"), *axes)
    total = places.count()
    cell = lambda c, size: F.floor(c / size).cast("long")
    level = 0
    # Fine enough that a point meets few others on average: of a cell's points each meets all, in eight cells or so.
    while level < 40:
        counts = places.groupBy(*[cell(F.col(a), 2 * radius / 2**level).alias(a) for a in axes]).count()
        if 2 ** len(axes) * (counts.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0) <= together * total:
            break
        level += 1
    for k in range(level, -1, -1):
        # A hair wider, so that rounding in the division loses no pair at the very edge.
        reach = radius / 2**k * (1 + 1e-9)
        here = places.select(*[F.col(a).alias(f"o_{a}") for a in axes], "one", "other", *[cell(F.col(a), 2 * reach).alias(f"cell_{a}") for a in axes])
        spread = asked
        for a in axes:
            spread = spread.withColumn(f"cell_{a}", F.explode(F.array_distinct(F.array(cell(F.col(a) - reach, 2 * reach), cell(F.col(a) + reach, 2 * reach)))))
        gap = F.sqrt(reduce(lambda x, y: x + y, [F.pow(F.col(a) - F.col(f"o_{a}"), 2) for a in axes]))
        met = spread.hint("merge").join(here, [f"cell_{a}" for a in axes]).filter("one <> who or other <> who")
        near = written(met.withColumn("gap", gap).filter(F.col("gap") <= radius / 2**k).groupBy("who", *axes).agg(F.min("gap").alias("gap")), "nearest-other")
        found = found.unionByName(near.select(F.col("who").alias(by), "gap"))
        if k:
            asked = written(asked.join(near.select("who", *axes), ["who", *axes], "left_anti"), "still-asked")
    return found.groupBy(by).agg(F.min("gap").alias("gap"))


def overlapping(left: DataFrame, boxes: DataFrame, tile: float, how: str = "left_semi", grow_share: float = 0.0, grow_px: float = 0.0) -> DataFrame:
    """Rows of ``left`` (x0, y0, x1, y1) that overlap any of ``boxes`` grown on all sides, or with "left_anti" none.

    Both go to the tiles they touch, the join is on tiles, so a box meets only its neighbourhood. Boxes in the same place are
    held against others once.
    """
    place = ["x0", "y0", "x1", "y1"]
    grown = boxes.select(
        (F.col("x0") - grow_share * (F.col("x1") - F.col("x0")) - grow_px).alias("bx0"),
        (F.col("y0") - grow_share * (F.col("y1") - F.col("y0")) - grow_px).alias("by0"),
        (F.col("x1") + grow_share * (F.col("x1") - F.col("x0")) + grow_px).alias("bx1"),
        (F.col("y1") + grow_share * (F.col("y1") - F.col("y0")) + grow_px).alias("by1"),
    )

    def tiles(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile)))
        return df.withColumn("tx", span(x0, x1)).withColumn("ty", span(y0, y1))

    meets = (F.col("bx0") < F.col("x1")) & (F.col("bx1") > F.col("x0")) & (F.col("by0") < F.col("y1")) & (F.col("by1") > F.col("y0"))
    hit = tiles(left.select(*place).distinct(), *place).join(tiles(grown.distinct(), "bx0", "by0", "bx1", "by1"), ["tx", "ty"]).filter(meets).select(*place).distinct()
    return left.join(hit, place, how).select(*left.columns)


def nearest(queries: DataFrame, candidates: DataFrame, by: str, at: str, of: str, tie: str) -> DataFrame:
    """Per query (``by``, at ``at``) the candidate whose ``of`` is nearest: ``tie`` and ``gap``; ties go to the smallest ``tie``.

    Both sides are merged by one range sort: the nearest candidate is the last one before a query or the first one after it,
    within the query's range or, where that has none, at the end of the nearest range that has. So the work is that of a
    sort, however values clump. Nulls and NaN on either side count for nothing; no candidate makes no rows.
    """
    point = lambda c: F.col(c).cast("double").alias("v")
    real = lambda df: df.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    kinds = dict(queries.dtypes)[by], dict(candidates.dtypes)[tie]
    points = real(candidates.select(point(of), F.col(tie).alias("tie"))).groupBy("v").agg(F.min("tie").alias("tie"))
    sides = [points.select("v", F.lit(0).alias("side"), "tie", F.lit(None).cast(kinds[0]).alias("by")), real(queries.select(point(at), F.lit(1).alias("side"), F.lit(None).cast(kinds[1]).alias("tie"), F.col(by).alias("by")))]
    merged = sides[0].unionByName(sides[1]).repartitionByRange("v", "side", "by").sortWithinPartitions("v", "side", "by")
    merged = written(merged.withColumn("at", F.monotonically_increasing_id()), "nearest").withColumn("part", F.shiftright("at", 33))
    here = F.when(F.col("side") == 0, F.struct("v", "tie"))
    # One row a range: what candidates lie before it and after it.
    ends = merged.groupBy("part").agg(F.max(here).alias("last"), F.min(here).alias("first"))
    up, down = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", F.last("last", True).over(up).alias("earlier"), F.last("first", True).over(down).alias("later"))
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.select("part", "side", "v", "by", F.last(here, True).over(own).alias("below"), F.last(here, True).over(back).alias("above")).filter("side = 1")
    found = seen.join(F.broadcast(ends), "part").select("by", "v", F.coalesce("below", "earlier").alias("below"), F.coalesce("above", "later").alias("above"))
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col("v")).alias("gap"), F.col(f"{c}.tie").alias("tie")))
    best = found.select("by", F.array_min(F.array_compact(F.array(gap("below"), gap("above")))).alias("best")).filter("best is not null")
    return best.select(F.col("by").alias(by), "best.gap", F.col("best.tie").alias(tie))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, by: str, key: str, column: str, count: int, digits: int = 6, rows: int = 50_000, asked: int = 4096) -> DataFrame:
    """The ``count`` nearest of ``vectors`` (key, column) to each of ``queries`` (by, column), other keys than its own: by,
    key and ``d``, the squared distance rounded to ``digits``; ties go to the smallest key.

    Vectors and queries go to blocks of about ``rows`` and ``asked``; every pair of blocks is one group, met by equal
    numbers, that holds no more than the two blocks and gives ``count`` rows a query. Products of matrices find who may be
    among the nearest, and their distances are then summed exactly. Vectors of other lengths than a query's are not near it.
    """
    left = bucket_number(vectors, key, rows)
    right = bucket_number(queries, by, asked)
    left_blocks, right_blocks = left[1], right[1]
    spread = left[0].select(F.col("block").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1))).alias("q"), F.col(key).alias("key"), F.col(column).cast("array<double>").alias("x"))
    wanted = right[0].select(F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1))).alias("v"), F.col("block").alias("q"), F.col(by).alias("by"), F.col(column).cast("array<double>").alias("x"))

    def lists(table: pa.Table, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and matrix of the rows of each length."""
        column = table["x"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        keys = table[name].to_numpy()
        for n in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == n)
            yield keys[at], column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    def run(near: pa.Table, query: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        by_length = {x.shape[1]: (k, x) for k, x in lists(query, "by")}
        for keys, x in lists(near, "key"):
            if x.shape[1] not in by_length:
                continue
            names, y = by_length[x.shape[1]]
            size = (x * x).sum(axis=1)
            for k in range(0, len(y), 256):
                part = y[k : k + 256]
                rough = size - 2 * part @ x.T + (part * part).sum(axis=1)[:, None]
                take = min(len(keys), count + 1)
                edge = np.partition(rough, take - 1, axis=1)[:, take - 1]
                for name, row, last, vector in zip(names[k : k + 256].tolist(), rough, edge.tolist(), part, strict=True):
                    maybe = np.flatnonzero(row <= last + 10.0**-digits + 1e-9 * abs(last))
                    maybe = maybe[keys[maybe] != name]
                    d = np.round(((x[maybe] - vector) ** 2).sum(axis=1), digits)
                    order = np.lexsort((keys[maybe], d))[:count]
                    out += [(name, int(keys[maybe[j]]), float(d[j])) for j in order.tolist()]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"by": pa.array(columns[0], pa.int64()), "key": pa.array(columns[1], pa.int64()), "d": pa.array(columns[2], pa.float64())})

    found = spread.groupBy("v", "q").cogroup(wanted.groupBy("v", "q")).applyInArrow(run, "by long, key long, d double")
    first = Window.partitionBy("by").orderBy("d", "key")
    return found.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= count).select(F.col("by").alias(by), F.col("key").alias(key), "d")


def bucket_number(df: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """``df`` with ``block``, a number by hash of its key, so that blocks hold about ``rows`` rows; and how many there are."""
    blocks = max(1, -(-df.count() // rows))
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), blocks
