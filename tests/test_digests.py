"""Digest trees: the same for any partitioning, different for any change, which they name."""

import hashlib

from pyspark.sql import functions as F

from sunloom.sources import digests, runs

KEYS, ORDER, COLUMNS = ["run", "frame"], ["cell"], ["cell", "v", "t"]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "run string, frame long, cell long, v double, t string")


def made(df):
    return {(r.depth, r.run, r.frame): r.digest for r in digests.tree(df, KEYS, ORDER, COLUMNS).collect()}


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def test_trees_by_hand_and_in_any_order(spark):
    rows = [("a", 0, 1, 0.5, "é"), ("a", 0, 0, None, ""), ("a", 2, 0, 1.0, None), (None, None, 3, 2.0, "x"), ("a", 0, 1, 0.25, "é"), ("a", 0, 1, 0.25, "é")]
    df = rows_of(spark, rows)
    got = made(df)
    low = {}
    for key in {(r[0], r[1]) for r in rows}:
        held = [(r[2], "".join(map(enc, r[2:]))) for r in rows if (r[0], r[1]) == key]
        low[key] = h("".join(t for _, t in sorted(held)))
    runs_ = {None: h(enc(None) + low[None, None]), "a": h(enc(0) + low["a", 0] + enc(2) + low["a", 2])}
    assert got == {(2, *k): d for k, d in low.items()} | {(1, k, None): d for k, d in runs_.items()} | {(0, None, None): h(enc(None) + runs_[None] + enc("a") + runs_["a"])}
    assert made(rows_of(spark, rows[::-1]).repartition(5)) == got
    assert made(df.limit(0)) == {}


def test_changes_are_named(spark):
    rows = [("a", f, c, float(f * c), "t") for f in range(6) for c in range(20)]
    other = [r if r[1:3] != (3, 7) else (*r[:3], 99.0, "t") for r in rows if r[1] != 1] + [("b", 0, 0, 1.0, "t")]
    one, two = (digests.tree(rows_of(spark, x), KEYS, ORDER, COLUMNS) for x in (rows, other))
    assert {tuple(r) for r in digests.changed(one, two, KEYS).collect()} == {("a", 1, "missing"), ("a", 3, "changed"), ("b", 0, "new")}
    assert digests.changed(one, one, KEYS).count() == 0 and digests.root(one).first() != digests.root(two).first()


def test_fields_do_not_run_together(spark):
    one, two = rows_of(spark, [("a", 0, 1, 2.0, "3"), ("a", 1, 0, 0.0, "ab")]), rows_of(spark, [("a", 0, 1, 2.0, "3"), ("a", 1, 0, 0.0, "a")])
    assert digests.root(digests.tree(one, KEYS, ORDER, COLUMNS)).first() != digests.root(digests.tree(two, KEYS, ORDER, COLUMNS)).first()


def test_runs_are_checked_by_their_tables(spark):
    frames, points = rows_of(spark, [("a", f, c, 1.0, "t") for f in range(3) for c in range(4)]), spark.range(9).selectExpr("id div 3 run", "id")
    about = {"frames": frames, "points": points}, {"frames": KEYS, "points": ["run"]}, {"frames": ["cell"], "points": ["id"]}
    stored = digests.table_manifest(*about)
    again = digests.table_manifest({"frames": frames.repartition(3), "points": points.filter("id <> 4")}, *about[1:])
    assert [tuple(r) for r in runs.manifest_faults(stored, again, "path").collect()] == [("points", "changed")]
    assert runs.manifest_faults(stored, again.filter(F.col("path") == "frames"), "path").first().fault == "missing"
