"""Connected components of a large edge table by alternating stars, in shuffles that combine before they move rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges`` (u, v; undirected, any duplicates) to (node, component), the smallest node that each node reaches.

    Alternates two steps over edges kept as (u, v) with v < u: every node links its larger neighbours to the smallest node
    around it, then its smaller neighbours and itself to the smallest of them. Both keep all connections; the edges end as
    stars around the smallest nodes after a number of rounds that grows with the logarithm of the longest path. The
    smallest neighbours come from pre-aggregated minima, and a node with very many edges is split by AQE's skew join.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stage(edges, "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
