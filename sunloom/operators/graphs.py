"""Work on large edge tables in rounds of joins: connected components, and choices in order of rank among what conflicts.

Each round's state is written to the folder that driver and executors share and read again, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import shared_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``edges`` (a, b; longs, any order, any repeats) to (node, least): the least node each node reaches.

    Nodes hang on to smaller ones as parents. In a round every node takes the least parent among its neighbours' and its
    own, then the parent of that parent; an edge becomes one between the parents of its ends, and those whose ends agree go.
    Parents only get smaller, and a chain halves every round.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = written(edges, "graph-edges")
    nodes = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    parents = written(nodes.withColumn("least", F.col("node")), "graph-parents")
    for _ in range(rounds):
        if not left.limit(1).count():
            return parents
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The graph of roots: each root goes under the least root next to it.
        under = both.groupBy(F.col("a").alias("root")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        under = written(_jumped(_jumped(under)), "graph-roots")
        moved = parents.join(under, F.col("least") == F.col("root"), "left").select("node", F.coalesce("to", "least").alias("least"))
        parents = written(moved, "graph-parents")
        one = left.join(under.select(F.col("root").alias("a"), F.col("to").alias("x")), "a").join(under.select(F.col("root").alias("b"), F.col("to").alias("y")), "b")
        left = written(one.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "graph-edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _jumped(under: DataFrame) -> DataFrame:
    """Every root under what its parent is under."""
    above = under.select(F.col("root").alias("to"), F.col("to").alias("up"))
    return under.join(above, "to", "left").select("root", F.coalesce("up", "to").alias("to"))


def chosen_by_rank(nodes: DataFrame, conflicts: DataFrame, rounds: int = 200) -> DataFrame:
    """Of ``nodes`` (node, and rank: no two alike), those that a walk in order of rank takes when it passes over what
    conflicts with one taken before; ``conflicts``: a, b, any order, any repeats.

    All at once instead: in a round a node that outranks all undecided ones it conflicts with is taken, and those go. The
    result is that of the walk, and with ranks in random order the rounds grow with the logarithm of the nodes.
    """
    ranked = nodes.select("node", "rank")
    both = conflicts.filter("a <> b").select("a", "b").unionByName(conflicts.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    with_rank = both.join(ranked.select(F.col("node").alias("a"), F.col("rank").alias("a_rank")), "a").join(ranked.select(F.col("node").alias("b"), F.col("rank").alias("b_rank")), "b")
    # An edge points from the better to the worse end.
    edges = written(with_rank.filter("a_rank < b_rank").select("a", "b"), "rank-edges")
    undecided, taken = written(ranked, "rank-undecided"), None
    for _ in range(rounds):
        first = written(undecided.join(edges.select(F.col("b").alias("node")).distinct(), "node", "left_anti").select("node"), "rank-taken")
        taken = first if taken is None else taken.unionByName(first)
        lost = edges.join(first.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
        gone = written(first.unionByName(lost).distinct(), "rank-gone")
        undecided = written(undecided.join(gone, "node", "left_anti"), "rank-undecided")
        if not undecided.limit(1).count():
            return taken
        edges = written(edges.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti"), "rank-edges")
    raise RuntimeError(f"choices did not settle in {rounds} rounds")
