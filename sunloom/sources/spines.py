"""Libraries of measured curves: read from NPZ files or tables, checked, and one curve picked for each experiment."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIBRARY = "path string, spine_id long, points array<struct<x:double,y:double>>, true_length_km double, source_file_id string, epoch string"
#: Fixed names: a library's arrays, with their dimensions; a letter stands for one size wherever it occurs.
ARRAYS = {"points": ("n", "k", 2), "true_length_km": ("n",), "source_file_id": ("n",), "epoch": ("n",), "format_version": ()}
VERSION = 1


def faults(shapes: dict[str, tuple[int, ...]]) -> list[str]:
    """What is wrong with a library's header, given as the shapes of its arrays."""
    out, sizes = [f"{name} is missing" for name in ARRAYS if name not in shapes], {"n": None, "k": None}
    for name, wanted in ARRAYS.items():
        shape = shapes.get(name, wanted)
        fits = len(shape) == len(wanted)
        for size, letter in zip(shape, wanted) if fits and name in shapes else ():
            known = sizes.setdefault(letter, letter) if isinstance(letter, int) else sizes[letter]
            sizes[letter] = size if known is None else known
            fits = fits and size == sizes[letter] and size > 0
        if not fits:
            out.append(f"{name} does not belong to the others")
    return out


def _rows(path: str, content: bytes) -> pd.DataFrame:
    with np.load(io.BytesIO(content), allow_pickle=False) as data:
        arrays = {name: data[name] for name in ARRAYS if name in data.files}
    found = faults({name: a.shape for name, a in arrays.items()})
    if not found and arrays["format_version"] != VERSION:
        found = [f"format {arrays['format_version']} is not known"]
    if found:
        raise ValueError(f"{path}: {'; '.join(found)}")
    columns = {name: arrays[name].astype(kind) for name, kind in (("true_length_km", float), ("source_file_id", str), ("epoch", str))}
    curves = [[dict(zip("xy", point)) for point in curve] for curve in arrays["points"].astype(float).tolist()]
    return pd.DataFrame({"path": path, "spine_id": range(len(curves)), "points": curves, **columns})


def read_npz(spark: SparkSession, glob: str) -> DataFrame:
    """Curves of NPZ libraries, one row each. Spark reads the files, a task unpacks each; a file that is no library fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield _rows(path, content)

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, LIBRARY)


def rules() -> dict[str, Column]:
    """Rules of a library's rows: at least two points, all finite, and a finite positive length."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    length = F.col("true_length_km")
    return {
        "points": F.size("points") >= 2,
        "finite": F.forall("points", lambda p: finite(p["x"]) & finite(p["y"])),
        "length": finite(length) & (length > 0),
    }


def points(library: DataFrame) -> DataFrame:
    """One row per point: spine_id, idx, x, y."""
    return library.select("spine_id", F.posexplode("points").alias("idx", "p")).select("spine_id", F.col("idx").cast("long").alias("idx"), "p.x", "p.y")


def pick(eligible: DataFrame, experiments: DataFrame, key: str, seed: str, index: str) -> DataFrame:
    """(``key``, spine_id): the curve an experiment asks for by ``index``, else one of ``eligible`` (spine_id) by its seed.

    The draw is by hash, so it does not depend on the order of rows; a library is small, and every experiment that draws
    meets its curves' numbers as one array.
    """
    known = eligible.agg(F.array_sort(F.collect_set("spine_id")).alias("known"))
    drawn = experiments.withColumn("__one", F.lit(1)).join(F.broadcast(known.withColumn("__one", F.lit(1))), "__one")
    place = F.pmod(F.xxhash64(F.lit("spine"), F.col(seed)), F.size("known")).cast("int") + 1
    chosen = F.coalesce(F.col(index).cast("long"), F.when(F.size("known") > 0, F.try_element_at("known", place)))
    return drawn.select(key, chosen.alias("spine_id"))
