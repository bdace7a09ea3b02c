"""Threads that move frame by frame as a stream: positions, frames that came too early and closing times are kept as state.

A thread begins where a batch table says. Its frames are taken in order, whatever order they come in: one that comes early
waits, one that was taken before is passed over, so a repeated file changes nothing. Event time closes threads that are not
heard of any more. A query goes on from its checkpoint.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEPS = "thread_id long, frame_idx long, ts timestamp, dx double, dy double, dz double, along_km double"
MOVED = "thread_id long, frame_idx long, x double, y double, z double, along_km double, kind string, waiting long"
_NAMES = [f.split()[0] for f in MOVED.split(", ")]


#: Threads that share one state: a call into Python costs as much for one thread as for a block of them.
BLOCK = 1024
_PLACE = np.dtype([("thread", "i8"), ("x", "f8"), ("y", "f8"), ("z", "f8"), ("due", "i8"), ("heard", "i8")])
_STEP = np.dtype([("thread", "i8"), ("frame", "i8"), ("dx", "f8"), ("dy", "f8"), ("dz", "f8"), ("along", "f8")])


class Motion(StatefulProcessor):
    """State of a block of threads: where each is and which frame is next, and the frames that wait."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("block", "place binary, early binary")

    def _load(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.state.get() if self.state.exists() else (b"", b"")
        return np.frombuffer(bytes(held[0]), _PLACE).copy(), np.frombuffer(bytes(held[1]), _STEP).copy()

    def _keep(self, place: np.ndarray, early: np.ndarray) -> None:
        """One timer a block, for the thread that has been silent longest; threads that were never heard of have none."""
        if len(place):
            self.state.update((place.tobytes(), early.tobytes()))
        else:
            self.state.clear()
        heard = place["heard"][place["heard"] > 0]
        wanted = {int(heard.min()) + self.idle_ms} if len(heard) else set()
        now = set(self.handle.listTimers())
        for timer in now - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - now:
            self.handle.registerTimer(timer)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        place, early = self._load()
        # Of several starts of one thread the first stands.
        fresh = initialState[~initialState["thread_id"].isin(place["thread"])].drop_duplicates("thread_id")
        more = np.zeros(len(fresh), _PLACE)
        for name, column in zip(("thread", "x", "y", "z"), ("thread_id", "x", "y", "z"), strict=True):
            more[name] = fresh[column].to_numpy()
        place = np.concatenate([place, more])
        self.state.update((place[np.argsort(place["thread"])].tobytes(), early.tobytes()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        place, early = self._load()
        steps, times = [early], []
        for batch in rows:
            some = np.zeros(len(batch), _STEP)
            for name, column in zip(_STEP.names, ("thread_id", "frame_idx", "dx", "dy", "dz", "along_km"), strict=True):
                some[name] = batch[column].to_numpy()
            steps.append(some)
            times.append(batch["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64))
        fresh = np.concatenate(steps[1:])
        # Threads without a start begin at the origin.
        unknown = np.setdiff1d(fresh["thread"], place["thread"])
        more = np.zeros(len(unknown), _PLACE)
        more["thread"] = unknown
        place = np.concatenate([place, more])
        place = place[np.argsort(place["thread"])]
        np.maximum.at(place["heard"], np.searchsorted(place["thread"], fresh["thread"]), np.concatenate(times))
        # Of two rows of one frame the first stands, and what waited came first; a frame that was taken is over.
        held = np.concatenate(steps)
        held = held[held["frame"] >= place["due"][np.searchsorted(place["thread"], held["thread"])]]
        held = held[np.lexsort((held["frame"], held["thread"]))]
        again = (held["thread"][1:] == held["thread"][:-1]) & (held["frame"][1:] == held["frame"][:-1])
        held = held[np.concatenate([[True], ~again])] if len(held) else held
        at = np.searchsorted(place["thread"], held["thread"])
        first, count = np.searchsorted(held["thread"], place["thread"]), np.bincount(at, minlength=len(place))
        rank = np.arange(len(held)) - first[at]
        taken = np.flatnonzero(held["frame"] - rank == place["due"][at])
        made = {c: np.zeros(len(held)) for c in "xyz"}
        # All threads take their next frame at once, so each adds its steps in order.
        by_rank = taken[np.argsort(rank[taken], kind="stable")]
        ends = np.flatnonzero(np.diff(rank[by_rank])) + 1
        for now in np.split(by_rank, ends):
            for c in "xyz":
                place[c][at[now]] += held[f"d{c}"][now]
                made[c][now] = place[c][at[now]]
        place["due"] += np.bincount(at[taken], minlength=len(place))
        waits = np.ones(len(held), dtype=bool)
        waits[taken] = False
        self._keep(place, held[waits])
        if len(taken):
            values = [held["thread"], held["frame"], *made.values(), held["along"], np.full(len(held), "frame", dtype=object), count[at] - rank - 1]
            yield pd.DataFrame({n: v[taken] for n, v in zip(_NAMES, values, strict=True)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Threads that were silent for so long end: their last place, and how many frames still waited for one before."""
        place, early = self._load()
        ends = place["heard"] + self.idle_ms
        over = (place["heard"] > 0) & ((ends <= expiredTimerInfo.getExpiryTimeInMs()) | (ends < timerValues.getCurrentWatermarkInMs()))
        gone = place[over]
        closed = np.isin(early["thread"], gone["thread"])
        waiting = np.bincount(np.searchsorted(gone["thread"], early["thread"][closed]), minlength=len(gone))
        self._keep(place[~over], early[~closed])
        if len(gone):
            values = [gone["thread"], gone["due"] - 1, gone["x"], gone["y"], gone["z"], np.zeros(len(gone)), np.full(len(gone), "closed", dtype=object), waiting]
            yield pd.DataFrame(dict(zip(_NAMES, values, strict=True)))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks(spark: SparkSession, partitions: int | None = None):
    """State with timers and lists needs RocksDB; a stream keeps the number of partitions that it was first started with."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def moved(steps: DataFrame, starts: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The stream of positions of ``steps`` (a stream, see ``STEPS``) from ``starts`` (thread_id, x, y, z; a batch table).

    A thread that has no start begins at the origin. ``idle`` of event time without a row closes a thread. Rows that are
    later than ``late`` behind the newest event time are dropped by Spark, so it bounds how far frames may be out of order,
    and with that how many wait.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    block = F.floor(F.col("thread_id") / BLOCK).cast("long")
    timed = steps.withColumn("block", block).withWatermark("ts", late).groupBy("block")
    begin = starts.withColumn("block", block).groupBy("block")
    return timed.transformWithStateInPandas(Motion(idle_ms), MOVED, "append", "EventTime", initialState=begin)


def follow(steps: DataFrame, starts: DataFrame, path: str, partitions: int | None = None, **times: str) -> None:
    """Run what there is of ``steps`` to its end into Parquet below ``path``; a later call goes on where this one stopped."""
    spark = steps.sparkSession
    with rocks(spark, partitions):
        sink = moved(steps, starts, **times).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
