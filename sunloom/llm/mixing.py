"""Mixing sources to target weights by hash thresholds that are found from histograms, without sorting documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BUCKETS, own, stage

#: Sources in code point order weigh these, repeating; no source is taken more often than CAP times.
WEIGHTS, CAP = (5, 2, 1), 3
#: Documents of at least these sizes form the classes; each class takes what the ones before missed or overran.
CLASSES = (1024, 64)
#: A hash has 52 bits: two histogram levels of 13, the rest only inside the boundary bucket.
LEVEL_BITS, HASH_BITS = 13, 52
#: Sources that a range holds when sources are ranked.
RANGE_ROWS = 100_000
#: Sources up to which one row per source is broadcast; a class's rules have three times as many.
FEW = 20_000


def words(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(doc_id: Column) -> Column:
    """52 bits of the MD5 of the doc_id as text; a null doc_id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def running(df: DataFrame, rows: int, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` (of about ``rows`` rows) with ``rank`` (from 0) and, for each of ``sums``, ``before_<name>``, the sum over the rows before, in ``order``.

    Rows are dealt to ranges of the order and summed within each; a range's start comes from the ranges' totals, of which
    the driver sees one row a range. So no task holds all rows, however many sources there are.
    """
    spark = df.sparkSession
    ranges = max(1, min(MAX_BUCKETS, -(-rows // RANGE_ROWS)))
    placed = stage(df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    totals = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rank"), *[F.sum(c).alias(c) for c in sums]).orderBy("range").collect()
    at, starts = [0] * (1 + len(sums)), []
    for t in totals:
        starts.append((t["range"], *map(float, at)))
        at = [x + (t[c] or 0) for x, c in zip(at, ["rank", *sums], strict=True)]
    names = ["rank", *[f"before_{c}" for c in sums]]
    # As a literal: a table made from Python objects would start Python workers.
    fields = ["range int", *[f"start_{c} double" for c in names]]
    lines = json.dumps([dict(zip([f.split()[0] for f in fields], line, strict=True)) for line in starts])
    first = spark.range(1).select(F.inline(F.from_json(F.lit(lines), f"array<struct<{', '.join(f.replace(' ', ':') for f in fields)}>>")))
    own = Window.partitionBy("range").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    inside = [F.row_number().over(own) - 1, *[F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums]]
    joined = placed.withColumns(dict(zip(names, inside, strict=True))).join(F.broadcast(first), "range")
    return joined.select(*df.columns, *[(F.col(c) + F.col(f"start_{c}")).alias(c) for c in names])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, sources: int | None = None) -> DataFrame:
    """source and source_size to its target: shares by weight, stopped at ``cap`` times the size, the excess reshared.

    Sources stop in the order of cap * size / weight; the first that does not stop fixes the level for all others.
    """
    by_name, by_ratio = F.col("source").asc_nulls_last(), F.col("ratio").asc()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    n = sizes.count() if sources is None else sources
    named = running(sizes.select("source", "source_size"), n, [by_name], [])
    named = named.withColumn("weight", weight).drop("rank").withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    ordered = stage(running(named, n, [by_ratio, by_name], ["source_size", "weight"]), "mix-order")
    all_words, all_weights = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(all_words or 0)) - cap * F.col("before_source_size")) / (F.lit(float(all_weights or 0)) - F.col("before_weight"))
    fixed = ordered.withColumn("level", level).filter("ratio >= level").agg(F.min_by("level", "rank")).first()[0]
    share = F.col("weight") * F.lit(fixed).cast("double")
    return ordered.select("source", "source_size", F.least((cap * F.col("source_size")).cast("double"), share).alias("target"))


def _boundary(cells: DataFrame, state: DataFrame, cell: str) -> DataFrame:
    """The first cell of each source whose running sum reaches ``want``: its ``base`` (sum before) and its sum.

    ``cells``: source_key, cell, words; ``state``: source_key, want, base, hinted for a broadcast where that is safe.
    Sources that never reach it get no row.
    """
    run = Window.partitionBy("source_key").orderBy(cell)
    joined = cells.join(state, "source_key")
    summed = joined.withColumn("upto", F.col("base") + F.sum("words").over(run)).filter("upto >= want")
    first = summed.groupBy("source_key").agg(F.min_by(F.struct(cell, "upto", "words", "want"), cell).alias("b"))
    return first.select("source_key", f"b.{cell}", "b.upto", (F.col("b.upto") - F.col("b.words")).alias("base"), "b.want")


def traits() -> dict[str, Column]:
    """Of a document: its size in words, its size class, its source as a key that is never null, its hash."""
    size = words(F.col("text"))
    return {
        "size": size,
        "class": sum((size < c).cast("int") for c in CLASSES),
        "source_key": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
        "h": hashed(F.col("doc_id")),
    }


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source and class: source_size, target, ``whole`` (times that every document is taken) and ``limit`` (documents
    with a hash below it are taken once more).

    ``rows``: source, source_key, class, size, h. One pass makes the histogram of all classes; then each class reads the
    numbers once more, for the boundary buckets alone.
    """
    low, lower = HASH_BITS - LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS
    sums = stage(rows.groupBy("source_key", "source", "class", F.shiftright("h", low).alias("bucket")).agg(F.sum("size").alias("words")), "mix-histogram")
    sized = sums.groupBy("source", "source_key").agg(F.sum("words").alias("source_size"))
    sources = sized.count()
    # One row per source in all that is joined below: broadcast only where the sources were counted and are few.
    near = F.broadcast if sources <= FEW else lambda df: df
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    plan = targets(sized, weights, cap, sources).withColumn("source_key", key).drop("source").withColumn("whole", F.floor(ratio))
    plan = stage(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    carry = plan.select("source_key", F.lit(0.0).alias("carry"))
    limits = None
    for c in range(len(CLASSES) + 1):
        cells = sums.filter(F.col("class") == c)
        totals = cells.groupBy("source_key").agg(F.sum("words").alias("total"))
        want = F.col("budget") * F.coalesce(F.try_divide(F.coalesce("total", F.lit(0)).cast("double"), F.col("source_size").cast("double")), F.lit(0.0)) + F.col("carry")
        state = plan.join(near(carry), "source_key").join(near(totals), "source_key", "left").select("source_key", want.alias("want"), F.coalesce("total", F.lit(0)).alias("total"))
        state = stage(state, "mix-state")
        seek = state.filter("want > 0").select("source_key", "want", F.lit(0).cast("long").alias("base"))
        first = stage(_boundary(cells, near(seek), "bucket"), "mix-bucket")
        inside = rows.filter(F.col("class") == c).withColumn("bucket", F.shiftright("h", low)).join(near(first.select("source_key", "bucket")), ["source_key", "bucket"])
        inside = stage(inside.groupBy("source_key", "h").agg(F.sum("size").alias("words")).withColumn("finer", F.shiftright("h", lower)), "mix-inside")
        finer = inside.groupBy("source_key", "finer").agg(F.sum("words").alias("words"))
        second = stage(_boundary(finer, near(first.select("source_key", "want", "base")), "finer"), "mix-finer")
        inside = inside.join(near(second.select("source_key", "finer")), ["source_key", "finer"])
        third = _boundary(inside, near(second.select("source_key", "want", "base")), "h")
        over = (F.col("upto") - F.col("want")) < (F.col("want") - F.col("base"))
        third = third.select("source_key", (F.col("h") + over.cast("long")).alias("limit"), F.when(over, F.col("upto")).otherwise(F.col("base")).alias("got"))
        everything = F.when(F.col("want") > 0, F.lit(2**HASH_BITS)).otherwise(F.lit(0)).cast("long")
        done = state.join(near(third), "source_key", "left").select(
            "source_key",
            F.lit(c).alias("class"),
            F.coalesce("limit", everything).alias("limit"),
            (F.col("want") - F.coalesce("got", F.when(F.col("want") > 0, F.col("total")).otherwise(F.lit(0)))).alias("carry"),
        )
        done = stage(done, "mix-limit")
        carry = done.select("source_key", "carry")
        limits = done if limits is None else limits.unionByName(done)
    return near(limits.join(near(plan.select("source_key", "source_size", "target", "whole")), "source_key").drop("carry"))


def _times() -> Column:
    return F.col("whole") + (F.col("h") < F.col("limit")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    Every document of a source is taken floor(target / source_size) times; documents under a hash threshold are taken once
    more. The threshold is found per source and size class, large documents first: a histogram of words by hash bucket
    gives the bucket where the budget ends, that bucket alone is split again, and the threshold falls on the hash whose
    running sum is nearest to the budget. What a class misses or overruns goes to the next, so the last one's documents
    (the smallest) settle the error. Repeated doc_ids share a hash and stand or fall together. A source with no words has
    target and taken 0; an empty table gives no rows; null source is a source, and its place is last. Only doc_id, text
    and source are read.
    """
    rows = staged(docs, ["doc_id"])
    rules = thresholds(rows.drop("doc_id"), weights, cap)
    joined = rows.join(rules, ["source_key", "class"])
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).cast("long").alias("taken"))


def staged(docs: DataFrame, kept: list[str]) -> DataFrame:
    """``traits`` of every row, with source and the columns ``kept``, in one pass over the texts."""
    made = traits()
    rows = docs.select(*kept, F.col("source").cast("string").alias("source"), made["size"].alias("size"), made["source_key"].alias("source_key"), made["h"].alias("h"))
    return stage(rows.withColumn("class", sum((F.col("size") < c).cast("int") for c in CLASSES)), "mix-rows")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h FROM documents),
k AS (SELECT *, (size < 1024)::INT + (size < 64)::INT AS cls, coalesce('=' || source, '') AS sk FROM d),
s AS (SELECT sk, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM k GROUP BY sk),
w AS (SELECT *, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS rank,
             ((SELECT sum(source_size) FROM s) - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (SELECT sk, source_size, least((3 * source_size)::DOUBLE, weight * (SELECT level FROM l WHERE ratio >= level ORDER BY rank LIMIT 1)) AS target FROM l),
p AS (SELECT *, floor(coalesce(target / nullif(source_size, 0)::DOUBLE, 0))::BIGINT AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM p),
g AS (SELECT sk, cls, h, sum(size)::BIGINT AS words FROM k GROUP BY ALL),
u AS (SELECT *, sum(words) OVER (PARTITION BY sk, cls ORDER BY h)::BIGINT AS upto, sum(words) OVER (PARTITION BY sk, cls)::BIGINT AS total FROM g),
o AS (
  SELECT sk, -1 AS cls, 0::BIGINT AS "limit", 0e0 AS carry FROM b
  UNION ALL
  SELECT x.sk, x.cls, x."limit", x.want - x.got FROM (
    SELECT y.sk, y.cls, y.want,
           CASE WHEN y.want <= 0 THEN 0 WHEN y.f IS NULL THEN 4503599627370496 ELSE y.f.h + (y.f.upto - y.want < y.want - (y.f.upto - y.f.words))::BIGINT END AS "limit",
           CASE WHEN y.want <= 0 THEN 0 WHEN y.f IS NULL THEN y.total WHEN y.f.upto - y.want < y.want - (y.f.upto - y.f.words) THEN y.f.upto ELSE y.f.upto - y.f.words END AS got
    FROM (
      SELECT z.*, (SELECT min({'h': u.h, 'upto': u.upto, 'words': u.words}) FROM u WHERE u.sk = z.sk AND u.cls = z.cls AND u.upto >= z.want) AS f
      FROM (
        SELECT o.sk, o.cls + 1 AS cls, coalesce(v.total, 0) AS total, b.budget * coalesce(coalesce(v.total, 0)::DOUBLE / nullif(b.source_size, 0)::DOUBLE, 0) + o.carry AS want
        FROM o JOIN b ON b.sk = o.sk LEFT JOIN (SELECT DISTINCT sk, cls, total FROM u) v ON v.sk = o.sk AND v.cls = o.cls + 1
        WHERE o.cls < 2) z) y) x)
SELECT k.doc_id, k.size, b.source_size, b.target, (k.size * (b.whole + (k.h < o."limit")::BIGINT))::BIGINT AS taken
FROM k JOIN b ON b.sk = k.sk JOIN o ON o.sk = k.sk AND o.cls = k.cls
"""


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with all columns of ``docs``.

    A row's own source, size and hash decide, so nothing is joined by doc_id: texts that share one are each taken by their
    own size, rows without doc_id share the hash of the empty text. Texts without words have nothing to take and go.
    """
    rules = thresholds(staged(docs, []), weights, cap)
    mark, of, rule, copy = (own(docs, name) for name in ("mix_row", "mix_of", "mix_rule", "mix_copy"))
    marked = docs.withColumn(mark, F.struct(*[c.alias(n) for n, c in traits().items()]))
    rules = rules.select(F.struct("source_key", "class").alias(of), F.struct("whole", "limit").alias(rule))
    m, r = F.col(mark), F.col(rule)
    joined = marked.join(rules, F.struct(m["source_key"].alias("source_key"), m["class"].alias("class")) == F.col(of))
    times = F.when(m["size"] > 0, r["whole"] + (m["h"] < r["limit"]).cast("long")).otherwise(0).cast("int")
    copies = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(True), times)).alias(copy))
    return copies.drop(copy)
