"""Digests of large ordered tables as trees along their keys, instead of one digest over whole files.

A range (a frame, say) has the digest of its rows in order; a key above it the digest of its ranges' in order, and so on to
the root. Ranges are what a task holds; above them there are only digests. The result depends on the rows alone, not on files
or partitions, and two trees that differ name the ranges that do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoded(column: str | Column) -> Column:
    """A value as text that tells nulls, texts and lengths apart."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _joined(order: list[str], value: Column) -> Column:
    """The digest of a group's values in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, value.alias("__v"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["__v"]), "").cast("binary"), 256)


def tree(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per node: depth, ``keys`` (null below its own), digest. Depth 0 is the root, len(keys) the ranges.

    A range's rows are hashed by ``order``, then by what they hold, so rows that tie need no order; a null key is a key.
    An empty table has no nodes.
    """
    value = F.concat(*[encoded(c) for c in columns])
    nodes = rows.select(*keys, *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], value.alias("__row"))
    places = [f"__o{k}" for k in range(len(order))]
    level = nodes.groupBy(*keys).agg(_joined([*places, "__row"], F.col("__row")).alias("digest"))
    out = level.select(F.lit(len(keys)).alias("depth"), *keys, "digest")
    for depth in range(len(keys) - 1, -1, -1):
        child = keys[depth]
        level = level.groupBy(*keys[:depth]).agg(_joined([child], F.concat(encoded(child), "digest")).alias("digest")).filter(F.col("digest") != EMPTY)
        gone = [F.lit(None).cast(dict(rows.dtypes)[k]).alias(k) for k in keys[depth:]]
        out = out.unionByName(level.select(F.lit(depth).alias("depth"), *keys[:depth], *gone, "digest"))
    return out


#: The digest of nothing, which a table without rows would give its root.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def root(nodes: DataFrame) -> DataFrame:
    """The one digest of the whole."""
    return nodes.filter("depth = 0").select("digest")


def changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (``keys``, fault) that two trees differ in: "missing" after, "new" after, or "changed"."""
    lowest = F.col("depth") == len(keys)
    a, b = before.filter(lowest).alias("a"), after.filter(lowest).alias("b")
    same = None
    for k in keys:
        one = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = one if same is None else same & one
    met = a.join(b, same, "full").filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    fault = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "new").otherwise("changed")
    own = [F.when(F.col("a.digest").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    return met.select(*own, fault.alias("fault"))


def table_manifest(tables: dict[str, DataFrame], keys: dict[str, list[str]], order: dict[str, list[str]]) -> DataFrame:
    """(path, digest) of each table of a run, as ``runs.manifest_faults`` compares them, whatever files hold their rows."""
    out = None
    for name, df in sorted(tables.items()):
        rest = [c for c in df.columns]
        row = root(tree(df, keys[name], order[name], rest)).select(F.lit(name).alias("path"), F.upper("digest").alias("digest"))
        out = row if out is None else out.unionByName(row)
    return out
