"""Drafts of all versions: what is kept, renamed, filled and lost."""

import json

from pyspark.sql import functions as F

from sunloom.sources import drafts
from sunloom.sources.drafts import Step


def frame(spark, bodies):
    return spark.createDataFrame([(k, b if b is None or isinstance(b, str) else json.dumps(b)) for k, b in bodies.items()], "key long, body string")


def upgraded(spark, bodies, **more):
    rows = drafts.upgrade(frame(spark, bodies), **more).collect()
    assert len(rows) == len(bodies)
    return {r.key: (r["values"], [tuple(x) for x in r.lost], r.broken) for r in rows}


def test_old_and_new_drafts(spark):
    got = upgraded(
        spark,
        {
            1: {"static": {"nx": 512, "dip_parameterization": "dip_depth", "dip_depth_min_km": 5}, "dynamics": {"seed": 9, "period": 3000, "center_height_km": "auto"}, "dynamic_background": {"crop_width_px": 7}},
            2: {"version": 2, "static": {"seed": 4}, "dynamics": {"period": 100.5, "oscillation_mode": "shared_period"}, "dynamic_background": {"seed": 1, "use_detector": True}},
            3: {"version": 3, "static": {"spine_library_length_bounds_km": [1, 2.5], "nx": True, "odd": 1, "ny": {"a": 1}}, "dynamics": {"period_s": 8, "period": 7}, "export": {"compression": None}},
            4: {"version": 99, "video": {"fps": "fast"}, "other": {"x": 1}, "static": 5},
            5: "not json",
            6: None,
            7: {},
            8: [1, 2],
        },
    )
    dips = {"static.dip_curvature_radius_min_km": 50_000.0, "static.dip_curvature_radius_median_km": 100_000.0, "static.dip_curvature_radius_max_km": 250_000.0, "static.dip_curvature_radius_sigma_ln": 0.25}
    assert got[1][0] == {"static.nx": 512.0, "dynamics.seed": 9.0, "dynamics.period_s": 3000.0, "dynamics.center_height_km": None, "dynamic_background.seed": 9.0, "dynamics.transverse_period_s": 3000.0} | dips
    assert got[1][1] == [("dynamic_background.crop_width_px", "dropped in 2"), ("static.dip_depth_min_km", "dropped in 1"), ("static.dip_parameterization", "dropped in 1")]
    assert got[2][0]["dynamics.period_s"] == 100.5 and got[2][0]["dynamic_background.seed"] == 1.0 and got[2][0]["dynamics.oscillation_mode"] == 1.0
    assert got[2][1] == [("dynamic_background.use_detector", "unknown")]  # it was dropped in 2, so a draft of 2 doesn't have it
    assert got[3][0]["static.spine_library_length_bounds_km[1]"] == 2.5 and got[3][0]["dynamics.period_s"] == 8.0 and got[3][0]["export.compression"] is None
    assert got[3][1] == [("dynamics.period", "unknown"), ("static.nx", "unreadable"), ("static.ny", "unreadable"), ("static.odd", "unknown")]
    assert got[4][1] == [("other.x", "unknown"), ("video.fps", "unreadable")]
    assert [got[k][2] for k in range(1, 9)] == [False] * 4 + [True, True, False, False]
    assert got[5][:2] == ({}, []) and got[7][1] == [] and got[8][1] == []


def test_an_old_name_beside_the_new_one_is_replaced(spark):
    steps, tables = [Step(1, "drop", "a.gone")], {"a": {"new": drafts.Number(None)}}
    both = [*steps, Step(2, "rename", "a.old", to="a.new")]
    rows = drafts.parameters(frame(spark, {1: {"version": 1, "a": {"old": 1, "old2": 3}}, 2: {"version": 2, "a": {"old": 1, "new": 2}}, 3: {"a": {"gone": 1}}}), both, tables).collect()
    assert {(r.key, r.name, r.target, r.why) for r in rows} == {(1, "a.old", "a.new", None), (1, "a.old2", None, "unknown"), (2, "a.old", None, "unknown"), (2, "a.new", "a.new", None), (3, "a.gone", None, "dropped in 1")}
    twice = spark.createDataFrame([(1, '{"a": {"new": 1}}'), (1, '{"a": {"new": 5}}')], "key long, body string")
    assert sorted(r.why or "" for r in drafts.parameters(twice, both[:1], tables).collect()) == ["", "replaced"]


def test_routes_go_back_through_all_steps():
    steps = [Step(1, "rename", "s.a", to="s.b"), Step(2, "drop", "s.x"), Step(3, "rename", "s.b", to="s.c"), Step(3, "fill", "s.d", value=1.0)]
    led = {(v, n): (t, w) for v, n, t, w in drafts.routes(steps, ["s.c", "s.d"])}
    assert led[3, "s.c"] == ("s.c", None) and (3, "s.b") not in led
    assert led[2, "s.b"] == ("s.c", None) and (2, "s.x") not in led and (2, "s.c") not in led
    assert led[1, "s.x"] == (None, "dropped in 2") and led[1, "s.b"] == ("s.c", None)
    assert led[0, "s.a"] == ("s.c", None) and led[0, "s.x"] == (None, "dropped in 2") and (0, "s.b") not in led


def test_no_drafts(spark):
    assert drafts.upgrade(spark.createDataFrame([], "key long, body string")).count() == 0


def test_actions_ask_only_for_what_they_need(spark):
    import pytest

    from sunloom.sources import experiments

    rows = [
        (1, "fine", "", "a", {"static.nx": 896.0}),
        (2, "", "x" * 501, "a", {"dynamics.n_frames": 0.0, "video.fps": 1000.0, "dynamic_background.frame_step": 0.0}),
        (3, "fine", "", "none", {"static.seed": -1.0}),
        (4, "fine", "", "a", {"dynamic_background.start_index": 100.0, "static.nx": 64.0}),
        (5, "fine", "", " ", {"dynamics.n_frames": 101.0}),
    ]
    configs = spark.createDataFrame(rows, "path long, name string, description string, background string, values map<string,double>")
    headers = spark.createDataFrame([("a", 100, 448, 448), (" ", 100, 448, 448)], "sequence_id string, n_frames long, height long, width long")
    found = {s: sorted(tuple(r) for r in experiments.scoped_faults(configs.withColumn("values", F.map_concat("values", F.when(F.map_contains_key("values", "dynamics.n_frames"), F.expr("cast(map() as map<string,double>)")).otherwise(F.create_map(F.lit("dynamics.n_frames"), F.lit(100.0))))), s, headers).collect()) for s in experiments.SCOPES}
    assert found["preview"] == [(3, "inputs", "sequence known"), (3, "static", "seed allowed"), (4, "inputs", "first frame there"), (4, "inputs", "width fits"), (5, "experiment", "background path")]
    assert [r for r in found["save"] if r[0] == 2] == [(2, "dynamic_background", "frame_step allowed"), (2, "dynamics", "n_frames allowed"), (2, "experiment", "description"), (2, "experiment", "name"), (2, "video", "fps allowed")]
    assert [r for r in found["save"] if r[0] in (4, 5)] == [(4, "inputs", "run fits"), (4, "inputs", "width fits"), (5, "experiment", "background path"), (5, "inputs", "run fits")]
    assert found["production"] == found["save"] and not [r for r in found["save"] if r[0] == 1]
    assert not [r for r in experiments.scoped_faults(configs, "save").collect() if r.section == "inputs"]
    with pytest.raises(ValueError):
        experiments.scoped_faults(configs, "production")
