"""Opacity grids from CSV: one row per grid point, or one per height with a column per cell, checked before use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate

VALUES = ("i_value", "f_value")
LONG = "height_mm double, temperature_k double, pressure double, i_value double, f_value double"
#: Names of a wide table's cells, such as T6000K_p0.05.
CELL = r"^T([0-9.]+)K_p([0-9.]+)$"


def read_long(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """A CSV with a header; ``names`` maps its columns to height_mm, temperature_k, pressure, i_value and f_value."""
    names = names or {n.split()[0]: n.split()[0] for n in LONG.split(", ")}
    rows = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    missing = sorted(set(names) - set(rows.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return rows.select(*[F.col(f"`{a}`").try_cast("double").alias(b) for a, b in names.items()])


def read_wide(spark: SparkSession, path: str, height: str, value: str) -> DataFrame:
    """height_mm, temperature_k, pressure and ``value`` of a CSV with one row per height and one column per cell.

    The columns are a table's, so few; rows are unpivoted by Spark.
    """
    rows = spark.read.option("header", "true").csv(path)
    cells = [c for c in rows.columns if c != height]
    long = rows.unpivot([height], [f"`{c}`" for c in cells], "cell", value)
    part = lambda k: F.regexp_extract("cell", CELL, k).try_cast("double")
    return long.select(F.col(height).try_cast("double").alias("height_mm"), part(1).alias("temperature_k"), part(2).alias("pressure"), F.col(value).try_cast("double").alias(value))


def grid(spark: SparkSession, i_path: str, f_path: str, height: str = "height_Mm") -> DataFrame:
    """Both wide tables joined on their grid points."""
    return read_wide(spark, i_path, height, "i_value").join(read_wide(spark, f_path, height, "f_value"), calibrate.KEYS, "full")


def faults(table: DataFrame, axes: dict[str, list[float]]) -> DataFrame:
    """(fault, n) of everything that keeps a table from being the full grid of ``axes`` with allowed values.

    Ionization lies in (0, 1] and the population factor above 0; every combination of the axes is there once, and nothing
    else is. Axes have few points, so their product is a small table.
    """
    spark = table.sparkSession
    points = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [spark.createDataFrame([(float(x),) for x in axes[k]], f"{k} double") for k in calibrate.KEYS])
    counted = table.groupBy(*calibrate.KEYS).agg(F.count(F.lit(1)).alias("n"))
    joined = points.withColumn("wanted", F.lit(1)).join(counted, calibrate.KEYS, "full")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    i, f = F.col("i_value"), F.col("f_value")
    of_points: dict[str, Column] = {"missing": F.col("n").isNull(), "doubled": F.col("n") > 1, "off the grid": F.col("wanted").isNull()}
    of_values: dict[str, Column] = {"not finite": ~(finite(i) & finite(f)), "ionization": finite(i) & ~((i > 0) & (i <= 1)), "population": finite(f) & ~(f > 0)}
    tally = lambda df, rules: df.agg(F.array(*[F.struct(F.lit(n).alias("fault"), F.count_if(c).alias("n")) for n, c in rules.items()]).alias("all")).select(F.inline("all"))
    return tally(joined, of_points).unionByName(tally(table, of_values)).filter("n > 0")


def checked(table: DataFrame, axes: dict[str, list[float]]) -> DataFrame:
    """``table``, if it is the full grid; else an error that names its faults."""
    found = {r["fault"]: r["n"] for r in faults(table, axes).collect()}  # at most six rows
    if found:
        raise ValueError(f"the opacity table is not usable: {found}")
    return table


def metadata(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """One row: digest and size of the file or files at ``path``, rows and domains of the table read from it."""
    files = spark.read.format("binaryFile").load(path).agg(F.array_join(F.array_sort(F.collect_list(F.sha2("content", 256))), ",").alias("sha256"), F.sum("length").alias("bytes"))
    domain = [F.array(F.min(k), F.max(k)).alias(f"{k}_domain") for k in calibrate.KEYS]
    return files.join(F.broadcast(table.agg(F.count(F.lit(1)).alias("row_count"), *domain)))
