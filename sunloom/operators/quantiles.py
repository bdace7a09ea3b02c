"""Exact percentiles of groups of any size by histograms that are refined where the rank lies.

A histogram merges before it is shuffled and has at most ``BINS`` bins a group; the bin that holds the rank is split again,
between the least and greatest value that really lie in it, until few values or equal ones are left. So no task ever holds
a group's values, only those of one last bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import written
from .sizes import small

BINS = 1024
#: Values of one bin that are sorted in one row.
FEW = 2048


def percentiles(values: DataFrame, by: list[str], value: str, shares: list[float], few: int = FEW, bins: int = BINS) -> DataFrame:
    """``by``, share, level: the percentile of each share (0 to 1) of every group, between two values linearly.

    Nulls, NaN and infinite values don't count; a group without others has no row; groups with a null in ``by`` have none.
    """
    number = F.col(value).cast("double")
    rows = values.select(*by, number.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    rows = written(rows.withColumn("__all", F.lit(0)), "quantile-values")
    keys = [*by, "__all"]
    sizes = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "quantile-sizes")
    asked = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("at", F.col("share") * (F.col("n") - 1))
    asked = asked.select(*keys, "share", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"), "low", "high", "n").distinct()
    # ``k`` counts from the bin's first value, ``rank`` from the group's.
    state, settled = written(asked.select(*keys, "rank", "low", "high", "n", F.col("rank").alias("k")).distinct(), "quantile-bins"), None
    open_bin = (F.col("n") > few) & (F.col("low") < F.col("high"))
    while True:
        done = state.filter(~open_bin)
        settled = done if settled is None else settled.unionByName(done)
        left = state.filter(open_bin)
        if not left.limit(1).count():
            break
        met = rows.join(small(left.withColumnRenamed("n", "held")), keys).filter(F.col("v").between(F.col("low"), F.col("high")))
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins))
        counted = met.groupBy(*keys, "rank", "k", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin"))
        inside = counted.withColumn("upto", upto).filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
        state = written(inside.select(*keys, "rank", "low", "high", "n", (F.col("k") - F.col("upto") + F.col("n")).alias("k")), "quantile-bins")
    settled = written(settled, "quantile-settled")
    few_left = settled.filter("low < high")
    met = rows.join(small(few_left), keys).filter(F.col("v").between(F.col("low"), F.col("high")))
    picked = met.groupBy(*keys, "rank", "k").agg(F.sort_array(F.collect_list("v")).alias("s")).select(*keys, "rank", F.get("s", F.col("k").cast("int")).alias("found"))
    levels = settled.filter("low >= high").select(*keys, "rank", F.col("low").alias("found")).unionByName(picked)
    both = asked.select(*keys, "share", "at", "rank").join(levels, [*keys, "rank"]).groupBy(*keys, "share", "at").agg(F.min_by("found", "rank").alias("a"), F.max_by("found", "rank").alias("b"))
    return both.select(*by, "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("level"))


def wide(levels: DataFrame, by: list[str], names: dict[str, float]) -> DataFrame:
    """One row a group, a column for each share."""
    return levels.groupBy(*by).agg(*[F.max(F.when(F.col("share") == s, F.col("level"))).alias(n) for n, s in names.items()])
