"""Choices that a search would make one after the other, made for all groups at once by rounds over what conflicts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graphs
from .sizes import dealt

#: Tries of a group that one task walks through; larger groups are placed in rounds. Tries that a part has.
WALKED, PART = 32_768, 200_000


def overlaps(boxes: DataFrame, by: str, cell: float) -> DataFrame:
    """Pairs (a, b; a < b) of ``boxes`` (``by``, node, x0, y0, x1, y1) of one group that overlap.

    Boxes go to the cells they touch, cells are joined by equality, and a pair is taken in the cell of its overlap's lower
    corner alone, so it comes once.
    """
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    placed = boxes.select(by, "node", "x0", "y0", "x1", "y1").withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    a, b = placed.alias("a"), placed.alias("b")
    same = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.node") < F.col("b.node"))
    corner = [F.floor(F.greatest(f"a.{k}0", f"b.{k}0") / cell) == F.col(f"a.c{k}") for k in "xy"]
    meets = [(F.col(f"a.{k}0") < F.col(f"b.{k}1")) & (F.col(f"b.{k}0") < F.col(f"a.{k}1")) for k in "xy"]
    return a.join(b, same).filter(corner[0] & corner[1] & meets[0] & meets[1]).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def choose_crops(crops: DataFrame, by: str, key: str, count: int, tried: int = 128, cell: float = 256.0) -> DataFrame:
    """Per ``by``, up to ``count`` of the first ``tried`` crops (rank, x0, y0, x1, y1) in order of rank, then ``key``, that
    overlap none chosen before. The number tried is part of the rule, as a search for quiet crops stops after so many."""
    best = Window.partitionBy(by).orderBy("rank", key)
    first = crops.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= tried)
    first = graphs.written(first.withColumn("node", F.monotonically_increasing_id()), "crops")
    taken = graphs.chosen_by_rank(first.select("node", F.col("place").alias("rank")), overlaps(first, by, cell))
    # A search that stops after ``count`` has the best of what one without end would choose.
    kept = first.join(taken, "node").withColumn("chosen", F.row_number().over(Window.partitionBy(by).orderBy("place")))
    return kept.filter(F.col("chosen") <= count).select(*crops.columns)


def _near(tries: DataFrame, by: str, separation: float) -> DataFrame:
    """Candidates (thread_id, attempt) and those of earlier threads (other, other_attempt) that are near enough to matter for
    them: their distance, and whether it is too small. Points meet through cells, never all of a group."""
    widest = tries.agg(F.max("radius")).first()[0] or 0.0
    reach = max(2 * separation * widest, 1e-9)
    axes = ["x", "y", "z"]
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    here = tries.select(by, "thread_id", "attempt", "radius", *axes, *[cell(c).alias(f"c{c}") for c in axes])
    there = tries.select(by, F.col("thread_id").alias("other"), F.col("attempt").alias("other_attempt"), F.col("radius").alias("other_radius"), *[F.col(c).alias(f"o{c}") for c in axes])
    for c in axes:
        at = F.floor(F.col(f"o{c}") / reach).cast("long")
        there = there.withColumn(f"c{c}", F.explode(F.array(at - 1, at, at + 1)))
    distance = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in axes))
    met = here.join(there, [by, *[f"c{c}" for c in axes]]).filter("other < thread_id").withColumn("distance", distance)
    # Beyond the widest pair's separation a thread neither conflicts nor is the nearest of one that conflicts.
    close = met.filter(F.col("distance") <= separation * (F.col("radius") + F.lit(widest)))
    clash = F.col("distance") < separation * (F.col("radius") + F.col("other_radius"))
    return close.select(by, "thread_id", "attempt", "other", "other_attempt", "distance", clash.alias("clash"))


def walked(xyz: np.ndarray, radius: np.ndarray, first: np.ndarray, separation: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The walk itself over tries of one group by thread and attempt: which row each thread takes, its gap to the nearest
    thread before it (NaN for none) and whether that is free. Threads begin at rows ``first``."""
    ends = np.append(first[1:], len(xyz))
    taken, gap, free = np.zeros(len(first), np.int64), np.full(len(first), np.nan), np.ones(len(first), bool)
    at, wide = np.empty((len(first), 3)), np.empty(len(first))
    for k, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
        row, nearest = 0, np.full(b - a, np.nan)
        if k:
            d = xyz[a:b, None, :] - at[None, :k, :]
            d = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
            clear = ~(d < separation * (radius[a:b, None] + wide[None, :k])).any(axis=1)
            nearest = np.fmin.reduce(d, axis=1)
            free[k] = clear.any()
            row = int(np.argmax(clear)) if free[k] else int(np.nanargmax(nearest))
        taken[k], gap[k], at[k], wide[k] = a + row, nearest[row], xyz[a + row], radius[a + row]
    return taken, gap, free


def place_threads(wanted: DataFrame, by: str, separation: float, attempts: int = 8, rounds: int = 1000, most: int | None = None) -> DataFrame:
    """Threads placed as if one after the other in each group ``by``: the first of ``attempts`` candidates that keeps the
    separation (times both radii) from all threads before it, else the one farthest from them.

    ``wanted``: ``by``, thread_id, attempt, x, y, z, radius. Adds ``gap`` (to the nearest earlier thread, null for the first)
    and ``accepted``. A group of at most ``most`` tries (``WALKED``; a filament has fewer) is walked through by one task;
    larger ones are placed in rounds, to the same end. Rows without a group, thread or attempt are left out.
    """
    most = WALKED if most is None else most
    tries = wanted.filter(F.col("attempt") < attempts).select(by, "thread_id", "attempt", "x", "y", "z", "radius").dropna(subset=[by, "thread_id"])
    large = graphs.written(tries.groupBy(by).count().filter(F.col("count") > most).select(by), "large-groups")
    kinds = {f.name: f.dataType.simpleString() for f in tries.schema}
    names = [by, "thread_id", "attempt", "x", "y", "z"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", gap double, accepted boolean"

    def walk(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("thread_id", "ascending"), ("attempt", "ascending")])
        thread = np.asarray(group["thread_id"])
        first = np.flatnonzero(np.append(True, thread[1:] != thread[:-1]))
        xyz = np.column_stack([group[c].cast(pa.float64()).to_numpy() for c in "xyz"])
        taken, gap, free = walked(xyz, group["radius"].cast(pa.float64()).to_numpy(), first, separation)
        picked = group.select(names).take(pa.array(taken))
        return picked.append_column("gap", pa.array(gap, from_pandas=True)).append_column("accepted", pa.array(free))

    if not large.limit(1).count():
        return dealt(tries, by, tries, PART).groupBy(by).applyInArrow(walk, schema)
    few = tries.join(large, by, "left_anti").select(*tries.columns)
    return few.groupBy(by).applyInArrow(walk, schema).unionByName(_placed_in_rounds(tries.join(large, by, "left_semi").select(*tries.columns), by, separation, rounds))


def _placed_in_rounds(wanted: DataFrame, by: str, separation: float, rounds: int) -> DataFrame:
    """``place_threads`` for groups of any size.

    All threads choose at once, given what the others chose in the round before, until nobody changes: a thread is right once
    those before it are, so the end is the only fixed point, the one that a walk finds, and rounds are as many as the longest
    chain of threads that make each other move.
    """
    tries = graphs.written(wanted, "tries")
    near = graphs.written(_near(tries, by, separation), "near")
    names = [by, "thread_id", "attempt"]
    chosen = graphs.written(tries.groupBy(by, "thread_id").agg(F.min("attempt").alias("attempt"), F.lit(True).alias("accepted")), "placed")
    for _ in range(rounds):
        there = chosen.select(by, F.col("thread_id").alias("other"), F.col("attempt").alias("other_attempt"))
        met = near.join(there, [by, "other", "other_attempt"]).groupBy(*names).agg(F.max("clash").alias("clash"), F.min("distance").alias("nearest"))
        seen = tries.select(*names).join(met, names, "left").withColumn("free", ~F.coalesce("clash", F.lit(False)))
        first, far = F.min(F.when(F.col("free"), F.col("attempt"))), F.max_by("attempt", F.struct("nearest", -F.col("attempt")))
        picked = seen.groupBy(by, "thread_id").agg(F.coalesce(first, far).alias("attempt"), F.max("free").alias("accepted"))
        after = graphs.written(picked, "placed")
        changed = after.join(chosen, [*names, "accepted"], "left_anti").limit(1).count()
        chosen = after
        if not changed:
            break
    else:
        raise RuntimeError(f"threads did not settle in {rounds} rounds")
    placed = tries.join(chosen, names).drop("radius")
    earlier = placed.select(by, F.col("thread_id").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    distance = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"))
    gaps = placed.join(earlier, by).filter("other < thread_id").groupBy(by, "thread_id").agg(F.min(distance).alias("gap"))
    return placed.join(gaps, [by, "thread_id"], "left").select(*names, "x", "y", "z", "gap", "accepted")
