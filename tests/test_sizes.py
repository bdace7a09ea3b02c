"""Parts grow in number with a table, not in size."""

from pyspark.sql import functions as F

from sunloom.operators import sizes
from sunloom.plans import relations


def test_parts_follow_the_rows_and_keep_groups_whole(spark):
    rows = spark.range(0, 10_000, 1, 1).select((F.col("id") % 500).alias("g"), "id")
    made = sizes.dealt(rows, "g", rows, 1_000)
    assert made.rdd.getNumPartitions() == 10 and made.count() == 10_000
    assert made.select("g", F.spark_partition_id().alias("part")).distinct().count() == 500
    assert sizes.dealt(rows, "g", rows, 10_000).rdd.getNumPartitions() == 1


def test_threads_of_one_small_file_go_to_many_parts(spark, tmp_path):
    spark.range(1, 20_001, 1, 1).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    assert relations.relation(spark, str(tmp_path), "threads").rdd.getNumPartitions() == 5


def test_frames_of_one_small_file_go_to_many_parts(spark, tmp_path):
    line = spark.range(0, 400_000, 1, 1).select((F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") * 3).alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(0.1).alias("l_discount"), F.lit(2.0).alias("l_quantity"))
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert relations.relation(spark, str(tmp_path), "pixels").rdd.getNumPartitions() == 4


def test_cells_of_diagrams_and_ridges_are_dealt_before_they_meet(spark):
    from sunloom.plans import kernels as plans

    ticks = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("idx"), (60.0 * F.col("id")).alias("t"), (F.col("id") % 100 / 7.0).alias("value"))
    assert plans.diagrams(ticks).rdd.getNumPartitions() == 4 and plans.ridges(ticks).rdd.getNumPartitions() == 3


def test_windows_of_samples_hold_only_the_image(spark):
    from sunloom.operators import raster

    rows = spark.createDataFrame([(1, 0.2, 5.1, 0.6, 1.0), (2, -40.0, 3.0, 0.5, 1.0), (3, 9.4, 9.4, 0.6, 1.0)], "t long, x_px double, y_px double, sigma_px double, amplitude double")
    made = raster.thread_contributions(rows, ["t"], 10, 10)
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    seen = {(r.t, r.row_idx, r.col_idx) for r in made.collect()}
    assert {t for t, _, _ in seen} == {1, 3} and all(0 <= y < 10 and 0 <= x < 10 for _, y, x in seen)
    assert {(y, x) for t, y, x in seen if t == 1} == {(y, x) for y in range(2, 9) for x in range(4)}


def test_no_side_of_near_pairs_is_broadcast(spark):
    from sunloom.operators import spatial

    rows = spark.range(0, 50_000, 1, 1).select("id", F.col("id").cast("double").alias("x"))
    made = spatial.near_pairs(rows, rows.toDF("o_id", "o_x"), ["x"], ["o_x"], 10.0)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString() and made.rdd.getNumPartitions() == 25
    assert made.filter("abs(x - o_x) <= 10 and id <> o_id").count() == 2 * (10 * 50_000 - 55)


def test_nearest_other_at_all_distances(spark):
    import math
    import random

    from sunloom.operators import spatial

    draw = random.Random(5)
    # A dense clump, scattered points, equal places of two owners and of one, and one point alone.
    rows = [(k % 60, draw.gauss(0, 0.01), draw.gauss(0, 0.01), draw.gauss(0, 0.01)) for k in range(300)]
    rows += [(100 + k // 2, *[draw.uniform(0, 300) for _ in "xyz"]) for k in range(200)]
    rows += [(300, 50.0, 50.0, 50.0), (301, 50.0, 50.0, 50.0), (302, -40.0, 0.0, 0.0), (302, -40.0, 0.0, 0.0), (303, -40.0, 15.0, 0.0), (304, 9e5, 0.0, 0.0)]
    made = {r.by: r.gap for r in spatial.nearest_other(spark.createDataFrame(rows, "by long, x double, y double, z double"), "by", ["x", "y", "z"], 15.0, together=8).collect()}
    want = {}
    for a in rows:
        gap = min(math.dist(a[1:], b[1:]) for b in rows if b[0] != a[0])
        if gap <= 15.0:
            want[a[0]] = min(gap, want.get(a[0], gap))
    assert made.keys() == want.keys() and all(abs(made[k] - v) < 1e-9 for k, v in want.items())
    assert want[302] == 15.0 and want[300] == 0.0 and 304 not in want


def test_boxes_in_one_place_are_held_against_others_once(spark):
    from sunloom.operators import spatial

    crops = spark.range(0, 400, 1, 2).select("id", *[F.lit(v).alias(n) for n, v in (("x0", 10.0), ("y0", 10.0), ("x1", 74.0), ("y1", 74.0))])
    crops = crops.unionByName(crops.filter("id = 7").withColumns({"id": F.lit(1_000).cast("long"), "x0": F.lit(900.0), "x1": F.lit(964.0)}))
    boxes = spark.range(0, 400, 1, 2).select(*[F.lit(v).alias(n) for n, v in (("x0", 20.0), ("y0", 20.0), ("x1", 40.0), ("y1", 40.0))])
    made = spatial.overlapping(crops, boxes, 128.0, "left_anti")
    assert made.columns == crops.columns and [r.id for r in made.collect()] == [1_000]
    assert spatial.overlapping(crops, boxes, 128.0, "left_semi").count() == 400
    # Each side drops repeats before the tiles are joined.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3
