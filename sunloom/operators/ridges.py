"""Dark ridges of time-distance diagrams: Spark gathers each diagram, matrices of many diagrams are searched at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import bounded_batches


def weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """A Gaussian's weights from -reach to reach."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)] if reach else [1.0]
    return [w / sum(raw) for w in raw]


def _percentile(ordered: np.ndarray, share: float) -> np.ndarray:
    """Along the last axis."""
    at = (ordered.shape[-1] - 1) * share
    low, high = ordered[..., math.floor(at)], ordered[..., math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def _blurred(image: np.ndarray, values: list[float], axis: int) -> np.ndarray:
    """Weighed along ``axis``, edge values repeated."""
    size, reach = image.shape[axis], len(values) // 2
    out = np.zeros_like(image)
    for k, w in enumerate(values):
        out += w * image.take(np.clip(np.arange(size) + k - reach, 0, size - 1), axis=axis)
    return out


def positions(images: np.ndarray, start: float | None, jump: int, penalty: float, start_penalty: float, sigma: tuple[float, float]) -> np.ndarray:
    """(diagrams, times): the place along the last axis of each diagram's cheapest path; see ``dark_ridge``."""
    count, times, n = images.shape
    image = _blurred(_blurred(images, weights(sigma[0]), 2), weights(sigma[1]), 1)
    ordered = np.sort(image, axis=2)
    low, high = _percentile(ordered, 0.1)[..., None], _percentile(ordered, 0.9)[..., None]
    costs = (image - low) / np.maximum(high - low, 1e-12)
    last = costs[:, 0] + (start_penalty * (np.arange(n) - float(start)) ** 2 if start is not None else 0.0)
    came = np.zeros((count, times, n), dtype=np.int32)
    for j in range(1, times):
        best, of = np.full((count, n), np.inf), np.tile(np.arange(n, dtype=np.int32), (count, 1))
        # In order of where a move comes from, and only what is less replaces: of equal ones the smallest distance wins.
        for d in range(-min(jump, n - 1), min(jump, n - 1) + 1):
            to = slice(max(0, -d), n - max(0, d))
            source = np.arange(n)[to] + d
            value = last[:, source] + penalty * d * d + costs[:, j, to]
            less = value < best[:, to]
            best[:, to] = np.where(less, value, best[:, to])
            of[:, to] = np.where(less, source, of[:, to])
        last, came[:, j] = best, of
    every, path = np.arange(count), np.zeros((count, times), dtype=np.int64)
    path[:, -1] = last.argmin(axis=1)
    for j in range(times - 1, 0, -1):
        path[:, j - 1] = came[every, j, path[:, j]]
    around = [np.take_along_axis(image, np.clip(path + k, 0, n - 1)[..., None], axis=2)[..., 0] for k in (-1, 0, 1)]
    bend = around[0] - 2 * around[1] + around[2]
    refine = (path > 0) & (path < n - 1) & (bend > 1e-12)
    return path + np.where(refine, np.clip(0.5 * (around[0] - around[2]) / np.where(refine, bend, 1.0), -1, 1), 0.0)


def dark_ridge(
    diagrams: DataFrame,
    by: str = "diagram_id",
    between: tuple[float, float] | None = None,
    start: float | None = None,
    jump: int = 6,
    penalty: float = 0.15,
    start_penalty: float = 0.5,
    sigma: tuple[float, float] = (1.5, 0.7),
) -> DataFrame:
    """(``by``, t, position): the cheapest dark path through each diagram of cells (``by``, t, k, value), k whole numbers.

    Missing values count as the diagram's median; the image is blurred along distance and time, and scaled per time between
    its 10th and 90th percentile. Moves of up to ``jump`` cost by their square; of equal ones the smallest distance wins. The
    path is refined by parabolas where it has neighbours on both sides. ``between`` keeps it within distances of that closed
    range, ``start`` pulls its beginning. A diagram is what one row holds, so its size is the model's.
    """
    cells = diagrams if between is None else diagrams.filter(F.col("k").between(*between))
    kind = cells.schema[by].dataType.simpleString()
    cells = cells.select(by, F.col("t").cast("long").alias("t"), F.col("k").cast("long").alias("k"), F.col("value").cast("double").alias("v"))
    whole = cells.groupBy(by).agg(*[F.collect_list(F.coalesce(c, F.lit(math.nan)) if c == "v" else F.col(c)).alias(c) for c in "tkv"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes: dict[tuple[int, int], list[tuple[int, np.ndarray, int, np.ndarray]]] = {}
            for row, lists in enumerate(zip(*[batch.column(c) for c in "tkv"], strict=True)):
                t, k, v = (x.values.to_numpy(zero_copy_only=False) for x in lists)
                (ts, j), (ks, i) = np.unique(t, return_inverse=True), np.unique(k, return_inverse=True)
                at = j * len(ks) + i
                if len(np.unique(at)) < len(at):
                    raise ValueError(f"diagram {batch.column(by)[row].as_py()} has a cell twice")
                real = np.sort(v[~np.isnan(v)])
                if not len(real):
                    continue
                image = np.full(len(ts) * len(ks), np.nan)
                image[at] = v
                image = np.where(np.isnan(image), _percentile(real, 0.5), image).reshape(len(ts), len(ks))
                shapes.setdefault(image.shape, []).append((row, ts, int(ks[0]), image))
            for (times, _), alike in shapes.items():
                rows, ts, first, images = zip(*alike, strict=True)
                made = positions(np.stack(images), start, jump, penalty, start_penalty, sigma) + np.array(first)[:, None]
                names = batch.column(by).take(pa.array(np.repeat(rows, times)))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(ts)), pa.array(made.reshape(-1))], names=[by, "t", "position"])

    bounded_batches(diagrams.sparkSession)
    return whole.mapInArrow(run, f"`{by}` {kind}, t long, position double")
