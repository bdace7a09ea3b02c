import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from sunloom.plans import kernels as plans
from sunloom.plans import series
from sunloom.plans import threads as moving
from sunloom.plans.relations import relation
from sunloom.streaming import dynamics, runs


def test_running_statistics_equal_the_batch(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    batch = events.groupBy("event_type").agg(F.min("value"), F.max("value"), F.round(F.avg("value"), 6), F.count(F.lit(1)))
    assert sorted(map(tuple, runs.running_stats(spark, small).collect())) == sorted((a, round(b, 6), round(c, 6), d, e) for a, b, c, d, e in map(tuple, batch.collect()))


def test_walk_equals_the_window(spark, small):
    made = {(r.user_id, r.event_id): (r.step, r.position) for r in runs.walk(spark, small).collect()}
    events = spark.read.parquet(f"{small}/events.parquet").select("user_id", "event_id", "value").orderBy("event_id").collect()
    total, steps = {}, {}
    for e in events:
        total[e.user_id] = total.get(e.user_id, 0) + e.value
        steps[e.user_id] = steps.get(e.user_id, 0) + 1
        step, position = made[e.user_id, e.event_id]
        assert step == steps[e.user_id] and abs(position - total[e.user_id]) < 1e-5
    assert len(made) == len(events)


def test_windows_come_once_and_hold_no_more_than_there_is(spark, small):
    rows = runs.late_windows(spark, small).collect()
    assert len({r.start for r in rows}) == len(rows) and sum(r.n for r in rows) <= spark.read.parquet(f"{small}/events.parquet").count()


def put(spark, folder, rows):
    made = [(t, f, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=f if at is None else at), float(dx), 0.5, -1.0, float(f)) for t, f, dx, at in rows]
    spark.createDataFrame(made, dynamics.STEPS).coalesce(1).write.mode("append").parquet(folder)


def test_threads_move_in_order_from_their_start_and_after_a_restart(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    starts = spark.createDataFrame([(1, 100.0, 0.0, 7.0), (2, -5.0, 1.0, 1.0)], "thread_id long, x double, y double, z double")

    def go():
        steps = spark.readStream.schema(dynamics.STEPS).parquet(source)
        dynamics.follow(steps, starts, sink, partitions=2)
        return sorted((r.thread_id, r.frame_idx, r.x, r.y, r.z, r.kind, r.waiting) for r in spark.read.schema(dynamics.MOVED).parquet(sink).collect())

    put(spark, source, [(1, 0, 1, None), (1, 3, 1000, None), (2, 1, 10, None), (3, 0, 4, None)])
    assert go() == [(1, 0, 101.0, 0.5, 6.0, "frame", 1), (3, 0, 4.0, 0.5, -1.0, "frame", 0)]
    # A gap is filled, rows repeat with other values, and the query has stopped in between.
    put(spark, source, [(1, 1, 10, None), (1, 0, 7777, None), (1, 3, 8888, None), (2, 0, 1, None)])
    assert go()[1:4] == [(1, 1, 111.0, 1.0, 5.0, "frame", 1), (2, 0, -4.0, 1.5, 0.0, "frame", 1), (2, 1, 6.0, 2.0, -1.0, "frame", 0)]
    put(spark, source, [(1, 2, 100, None)])
    assert [r[:3] for r in go() if r[0] == 1] == [(1, 0, 101.0), (1, 1, 111.0), (1, 2, 211.0), (1, 3, 1211.0)]
    # Long after, the watermark has passed all but thread 4: the others close, with what still waits.
    put(spark, source, [(2, 9, 1, 5)])
    put(spark, source, [(4, 0, 1, 600)])
    go()
    put(spark, source, [(4, 1, 1, 601)])
    closed = {r[0]: (r[1], r[2], r[6]) for r in go() if r[5] == "closed"}
    assert closed == {1: (3, 1211.0, 0), 2: (1, 6.0, 1), 3: (0, 4.0, 0)}


def test_streamed_walks_equal_the_batch(spark, small):
    made = {(r.thread_id, r.frame_idx): (r.x, r.y, r.z, r.longitudinal_km) for r in plans.book.queries["stream_dynamics"](spark, small).collect()}
    threads, frames = (relation(spark, small, n) for n in ("threads", "frames"))
    walk = {(r.thread_id, r.frame_idx): (r.x, r.y, r.z) for r in series.brownian_walk(threads, frames).collect()}
    swing = {(r.thread_id, r.frame_idx): r.longitudinal_km for r in moving.oscillation_components(threads, frames).collect()}
    assert made.keys() == walk.keys()
    assert all(abs(a - b) < 1e-5 for k, v in made.items() for a, b in zip(v, (*walk[k], swing[k]), strict=True))


class Held:
    """A state handle that keeps one value and timers in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at

    getCurrentWatermarkInMs = getExpiryTimeInMs  # noqa: N815


def test_one_state_moves_a_block_of_threads():
    draw, held = random.Random(2), Held()
    motion = dynamics.Motion(1_000)
    motion.init(held)
    motion.handleInitialState((0,), pd.DataFrame({"thread_id": [3, 900], "x": [1.0, 2.0], "y": 0.0, "z": 0.0}), None)
    rows = [(t, f, pd.Timestamp(1_000 * (t + 1), unit="ms"), draw.random(), 1.0, -1.0, float(f)) for t in range(1_000) for f in range(6) if (t, f) != (7, 2)]
    draw.shuffle(rows)
    names, got = ["thread_id", "frame_idx", "ts", "dx", "dy", "dz", "along_km"], []
    for k in range(0, len(rows), 1_500):
        part = pd.DataFrame(rows[k : k + 1_500], columns=names)
        got += [r for made in motion.handleInputRows((0,), iter([part[:700], part[700:]]), None) for r in made.itertuples(index=False)]
    step, want = {r[:2]: r[3] for r in rows}, {}
    for t in range(1_000):
        x = {3: 1.0, 900: 2.0}.get(t, 0.0)
        for f in range(2 if t == 7 else 6):
            x += step[t, f]
            want[t, f] = x
    assert {(r.thread_id, r.frame_idx): r.x for r in got} == want and len(got) == len(want)
    # The block's only timer is that of the thread that has been silent longest; the rest stay.
    assert held.timers == {2_000}
    held.at = 8_000
    closed = [(r.thread_id, r.frame_idx, r.kind, r.waiting) for made in motion.handleExpiredTimer((0,), held, held) for r in made.itertuples(index=False)]
    held.timers.discard(2_000)
    assert closed == [(t, 5, "closed", 0) for t in range(7)] and held.timers == {9_000}
    held.at = 9_000
    assert [(r.thread_id, r.frame_idx, r.waiting) for made in motion.handleExpiredTimer((0,), held, held) for r in made.itertuples(index=False)] == [(7, 1, 3)]
