import pytest
from pyspark.sql import functions as F

from sunloom.operators import control
from sunloom.sources import runs, sequences


def test_sequences_are_written_once_and_read_by_strides(spark, tmp_path):
    pixels = spark.range(3 * 4 * 5).selectExpr("'a' sequence_id", "id div 20 frame_idx", "(id div 5) % 4 row_idx", "id % 5 col_idx", "cast(id + 1 as float) intensity")
    path = str(tmp_path / "seq")
    sequences.write(pixels, path)
    back = sequences.read(spark, path)
    assert back.count() == 60 and sequences.bad_pixels(back).count() == 0
    assert [r.frame_idx for r in sequences.strided(back, 0, 2).select("frame_idx").distinct().orderBy("frame_idx").collect()] == [0, 2]
    assert sequences.strided(back, 0, 2, 1).select("frame_idx").distinct().count() == 1
    with pytest.raises(Exception, match="exists"):
        sequences.write(pixels, path)


def test_header_checks(spark):
    good = (1, 60.0, 700.0, 0.8, 45.0, 3)
    bad = (2, -1.0, 700.0, 1.8, 400.0, 0)
    heads = spark.createDataFrame([("a", *good), ("b", *bad), ("c", None, None, None, None, None, None)], "sequence_id string, version int, cadence_s double, native_pixel_km double, disk_mu double, limb_direction_deg double, n_frames long")
    found = control.violations(heads, "sequence_id", sequences.header_rules()).groupBy("sequence_id").count().collect()
    assert {r.sequence_id: r["count"] for r in found} == {"b": 5, "c": 6}
    assert [r.sequence_id for r in sequences.within(heads, 0, 1, 3).collect()] == ["a"]
    times = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 60.0), ("a", 2, 125.0)], "sequence_id string, frame_idx long, time_s double")
    assert [r.frame_idx for r in sequences.uneven(times, heads).collect()] == [2]


def test_pick_does_not_depend_on_order(spark):
    paths = [(f"p{k}",) for k in range(9)]
    picked = {sequences.pick(spark.createDataFrame(p, "path string"), 7).first()[0] for p in (paths, paths[::-1])}
    assert len(picked) == 1


def test_runs_go_round(spark, tmp_path):
    points = spark.createDataFrame([(t, k, float(k), 10.0 * t) for t in (1, 2) for k in range(t + 2)], "thread_id long, idx long, s double, z double")
    nested = runs.nest(points, "thread_id", "idx", ["s", "z"])
    assert sorted(map(tuple, runs.unnest(nested, "thread_id", ["s", "z"]).collect())) == sorted(map(tuple, points.selectExpr("thread_id", "cast(idx as int)", "s", "z").collect()))
    ends = runs.offsets(nested.withColumn("g", F.lit(1)), "thread_id", "s", "g").orderBy("thread_id").collect()
    assert [(r.start, r.end) for r in ends] == [(0, 3), (3, 7)]
    path = str(tmp_path / "run")
    with pytest.raises(Exception):
        runs.read_run(spark, path)
    runs.write_run({"points": points}, path)
    assert runs.read_run(spark, path)["points"].count() == 7
    with pytest.raises(Exception):
        runs.write_run({"points": points}, path)
    assert {"path", "length", "modificationTime", "digest"} <= set(runs.manifest(spark, path).columns)
    assert runs.catalog({"p": points})[0]["column"] == "thread_id"


def test_listing_keeps_broken_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x", "utc": "2024"}')
    (tmp_path / "b.json").write_text('{"id": "y", "utc": ')
    rows = runs.listing(spark, f"{tmp_path}/*.json", "id string, utc string", "utc").collect()
    assert len(rows) == 2 and rows[0].id == "x" and rows[1].broken is not None


def test_names_and_seeds(spark):
    rows = spark.createDataFrame([(" Quiet  Sun -- 7! ",), ("",), ("ÄB c",)], "n string")
    made = rows.select(control.slug(F.col("n")).alias("s"), control.run_label(F.col("n")).alias("l")).collect()
    assert [(r.s, r.l) for r in made] == [("quiet-sun-7", "quiet-sun-7"), ("", "experiment"), ("b-c", "äb-c")]
    import hashlib

    text = control.PAIR_TEXT + "5:6"
    digest = hashlib.sha256(text.encode()).digest()
    a, b = (int.from_bytes(digest[k : k + 8], "big") % (2**31 - 1) for k in (0, 8))
    row = spark.range(1).select(*control.next_seeds(F.lit(5), F.lit(6))).first()
    assert tuple(row) == (a, b)


def test_experiments_from_files(spark, tmp_path):
    from sunloom.sources import experiments

    (tmp_path / "a.toml").write_text('[experiment]\nname = "one"\n[inputs]\nh5_background_path = "x"\n[static]\nheight_mean_km = 500\nseed = 3\nspine_library_length_bounds_km = [5, 4]\n[dynamics]\nseed = 9\noscillation_mode = "spin"\n')
    (tmp_path / "b.toml").write_text('[experiment]\nname = "-two"\n[inputs]\nh5_background_path = "x"\n[static]\nturns = 1\nspine_library_entry_index = "auto"\npsf_sigma_px = true\n[dynamics]\ncenter_height_km = "auto"\n[video]\nfps = 0\nvelocity_limit_km_s = "auto"\n[export]\ncompression = "gzip"\nvideo_upper_percentile = 0\n')
    (tmp_path / "c.toml").write_text("[static\n")
    rows = experiments.load(spark, f"{tmp_path}/*.toml")
    assert [(r.name, r.error is None) for r in rows.collect()] == [(None, False), ("-two", True), ("one", True)]
    good = rows.filter("error is null")
    faults = sorted((r.name, r.section, r.rule) for r in experiments.faults(good, "path").join(good.select("path", "name"), "path").collect())
    assert faults == sorted(
        [
            ("one", "static", "height_mean_km allowed"), ("one", "static", "spine_library_length_bounds_km[0] up to spine_library_length_bounds_km[1]"), ("one", "dynamics", "oscillation_mode allowed"),
            ("-two", "static", "unknown: turns"), ("-two", "static", "psf_sigma_px allowed"), ("-two", "video", "fps allowed"), ("-two", "export", "percentiles rise"), ("-two", "experiment", "name"),
        ]
    )
    seeds = {r.name: r.own for r in good.select("name", experiments.section(good, "dynamic_background").alias("own")).collect()}
    assert seeds == {"one": {"seed": 9.0}, "-two": {}}
    assert experiments.faults(good, "path", exact=True).filter("rule like 'missing: %'").count() > 100
    plain = spark.createDataFrame([("x", {}), ("y", {"psf_sigma_px": 4.0}), ("z", {"psf_sigma_px": 5.0})], "name string, overrides map<string,double>")
    marks = {r.name: r.digest for r in experiments.fingerprint(plain, "name", "overrides", experiments.STATIC).collect()}
    assert marks["x"] == marks["y"] != marks["z"]
    for section, table in experiments.SECTIONS.items():
        assert experiments.broken(plain.filter("name = 'x'"), "name", "overrides", table, experiments.rules_of(section)).count() == 0
    assert experiments.broken(plain, "name", "overrides", experiments.STATIC, experiments.static_rules()).count() == 0
    width = experiments.effective(plain, "name", "overrides").first()
    assert abs(width.image_width_km - 896 * 695_508 / 1800) < 1e-6 and (width.temperature_low_K, width.temperature_high_K) == (6000, 14000)
    stamp = F.to_timestamp(F.lit("2024-05-06 07:08:09"))
    made = spark.range(1).select(experiments.simulation_id(stamp, F.lit(7), F.lit("ABCDEF012345"), F.lit("quiet")), experiments.simulation_id(stamp, F.lit(7), F.lit("ABCDEF012345"), F.lit(""))).first()
    assert tuple(made) == ("sim-20240506T070809Z-s7-abcdef0123-quiet", "sim-20240506T070809Z-s7-abcdef0123")


def test_saved_experiments_come_back(spark, tmp_path):
    from sunloom.sources import experiments

    values = {"static.nx": 640.0, "static.spine_library_length_bounds_km[0]": 7e4, "static.spine_library_length_bounds_km[1]": 8.5e4, "static.column_mass_g_cm2": 1.5e-7, "dynamics.oscillation_mode": 1.0, "dynamics.center_height_km": None, "export.compression": 2.0, "video.fps": 25.0}
    rows = spark.createDataFrame([("One run", 'say "so" \\ here', "a/b", values), ("Two", "", "c", {"static.seed": 4.0, "static.old_name": 1.0})], "name string, description string, background string, values map<string,double>")
    path = str(tmp_path / "saved")
    experiments.save(rows, path)
    back = {r.name: r for r in experiments.load(spark, f"{path}/*/*.txt").collect()}
    assert (back["One run"].description, back["One run"].background, back["One run"].values) == ('say "so" \\ here', "a/b", values)
    assert back["Two"].values == {"static.seed": 4.0} and back["Two"].error is None
    with pytest.raises(Exception, match="exists"):
        experiments.save(rows, path)
    copies = {r.name: r.values for r in experiments.clone(rows).collect()}
    assert copies == {"One run copy": values, "Two copy": {"static.seed": 4.0}}


def test_published_cross_validation(spark, small):
    """The summary published with the model run, in percent."""
    from sunloom.plans import records

    published = {(10, 20): (0.47497, 2.65654, 1.63599, 4.08144), (10, 30): (0.55538, 2.45250, 2.98236, 5.75485)}
    made = {(r.anchor_mm, r.target_mm): (r.i_median, r.i_max, r.f_median, r.f_max) for r in records.book.queries["published_cross_validation"](spark, small).collect()}
    for pair, want in published.items():
        assert made[pair] == pytest.approx(want, abs=2e-4)
    first = next(r for r in records.book.queries["published_factors"](spark, small).collect() if (r.height_mm, r.temperature_k, r.pressure) == (10, 6000, 0.01))
    assert (first.c_i, first.c_f) == pytest.approx((0.9932537, 0.6522085), abs=1e-6)


def test_opacity_tables_are_checked(spark, tmp_path):
    from sunloom.sources import opacity

    axes = {"height_mm": [1.0, 2.0], "temperature_k": [6000.0], "pressure": [0.1, 0.2]}
    good = "height_mm,temperature_k,pressure,i_value,f_value\n1,6000,0.1,0.5,2\n1,6000,0.2,0.5,2\n2,6000,0.1,0.5,2\n2,6000,0.2,0.5,2\n"
    (tmp_path / "good.csv").write_text(good)
    table = opacity.checked(opacity.read_long(spark, str(tmp_path / "good.csv")), axes)
    about = opacity.metadata(spark, str(tmp_path / "good.csv"), table).first()
    assert about.row_count == 4 and about.height_mm_domain == [1.0, 2.0] and about.bytes == len(good)
    import hashlib

    assert about.sha256 == hashlib.sha256(good.encode()).hexdigest()
    (tmp_path / "bad.csv").write_text(good.replace("2,6000,0.2,0.5,2", "2,7000,0.2,1.5,0") + "1,6000,0.1,x,2\n")
    faults = {r.fault: r.n for r in opacity.faults(opacity.read_long(spark, str(tmp_path / "bad.csv")), axes).collect()}
    assert faults == {"missing": 1, "doubled": 1, "off the grid": 1, "not finite": 1, "ionization": 1, "population": 1}
    with pytest.raises(ValueError, match="not usable"):
        opacity.checked(opacity.read_long(spark, str(tmp_path / "bad.csv")), axes)
    (tmp_path / "short.csv").write_text("height_mm,temperature_k\n1,2\n")
    with pytest.raises(ValueError, match="columns are missing"):
        opacity.read_long(spark, str(tmp_path / "short.csv"))


def test_masks_are_seen_whole(spark, tmp_path):
    from sunloom.sources import masks, staging

    tau = spark.range(2 * 2 * 6).selectExpr("if(id % 2 = 0, 'highres', 'native') grid", "id div 12 frame_idx", "60.0D * (id div 12) time_s", "(id div 2) % 3 row_idx", "(id div 6) % 2 col_idx", "if(id = 5, null, id / 40) tau")
    target = str(tmp_path / "masks")
    masks.export(tau, target, 0.2)
    frame = masks.read_frame(spark, target, 1)
    assert frame.count() == 12 and frame.filter("binary").count() == 12 and {r.time_s for r in frame.collect()} == {60.0}
    assert masks.read_frame(spark, target, 9).count() == 0
    for bad in (0.0, float("nan"), -1.0):
        with pytest.raises(ValueError):
            masks.export(tau, target, bad)
    with pytest.raises(ValueError, match="same frames"):
        masks.export(tau.filter("grid = 'native' or frame_idx = 0"), target, 0.2)
    with pytest.raises(Exception):
        masks.export(tau.withColumn("tau", F.expr("raise_error('broken')").cast("double")), target, 0.2)
    assert masks.read_frame(spark, target, 1).count() == 12  # the old export stays, and nothing half-written beside it
    assert [p.name for p in tmp_path.iterdir()] == ["masks"]
    with pytest.raises(FileExistsError):
        staging.write_whole(tau, target)
    staging.write_json(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first().value == '{"a":null,"b":1}'
    with pytest.raises(FileNotFoundError):
        staging.publish(spark, str(tmp_path / "nothing"), str(tmp_path / "x"))


def test_spine_libraries(spark, tmp_path):
    import numpy as np

    from sunloom.sources import spines

    rng = np.random.default_rng(0)
    parts = {"points": rng.normal(size=(3, 5, 2)), "true_length_km": np.array([1e5, 2e5, 3e5]), "source_file_id": np.array(["a", "b", "c"]), "epoch": np.array(["x", "y", "z"]), "format_version": np.array(1)}
    np.savez(tmp_path / "good.npz", **parts)
    library = spines.read_npz(spark, f"{tmp_path}/good.npz")
    assert [tuple(r) for r in library.select("spine_id", "source_file_id", "true_length_km").orderBy("spine_id").collect()] == [(0, "a", 1e5), (1, "b", 2e5), (2, "c", 3e5)]
    rows = spines.points(library).orderBy("spine_id", "idx").collect()
    assert np.allclose([(r.x, r.y) for r in rows], parts["points"].reshape(-1, 2)) and control.violations(library, "spine_id", spines.rules()).count() == 0
    bad = spark.createDataFrame([(1, [(0.0, float("nan")), (1.0, 1.0)], 5.0), (2, [(0.0, 0.0)], -1.0)], "spine_id long, points array<struct<x:double,y:double>>, true_length_km double")
    assert sorted(map(tuple, control.violations(bad, "spine_id", spines.rules()).collect())) == [(1, "finite"), (2, "length"), (2, "points")]
    for name, change in (("missing", {"epoch": None}), ("version", {"format_version": np.array(2)}), ("shape", {"true_length_km": np.array([1.0])})):
        np.savez(tmp_path / f"{name}.npz", **{k: v for k, v in (parts | change).items() if v is not None})
        with pytest.raises(Exception, match="missing|not known|belong"):
            spines.read_npz(spark, f"{tmp_path}/{name}.npz").collect()
    asked = spark.createDataFrame([(k, k * 7, 1 if k == 3 else None) for k in range(60)], "run long, seed long, entry long")
    picked = {r.run: r.spine_id for r in spines.pick(library.filter("spine_id <> 1"), asked, "run", "seed", "entry").collect()}
    assert picked[3] == 1 and {v for k, v in picked.items() if k != 3} == {0, 2}
    assert picked == {r.run: r.spine_id for r in spines.pick(library.filter("spine_id <> 1").orderBy(F.desc("spine_id")), asked.repartition(3), "run", "seed", "entry").collect()}
    assert {r.spine_id for r in spines.pick(library.limit(0), asked.filter("run <> 3"), "run", "seed", "entry").collect()} == {None}


def test_runs_are_staged_published_and_described(spark, tmp_path):
    from sunloom.sources import staging

    frames = spark.range(12).selectExpr("id div 4 frame_idx", "id % 4 cell", "id / 2 tau")
    target = str(tmp_path / "run")
    staged = runs.stage_run({"frames": frames}, target)
    with pytest.raises(Exception):
        runs.read_run(spark, target)
    staging.publish(spark, staged, target)
    assert runs.replay(spark, target, "frames", 2).count() == 4
    late = runs.stage_run({"frames": frames}, target)
    staged_late = late.rsplit("/", 1)[1]
    with pytest.raises(FileExistsError):
        staging.publish(spark, late, target)
    other = runs.stage_run({"frames": frames.limit(4)}, target)
    assert other != late
    staging.publish(spark, other, target, replace=True)
    assert runs.read_run(spark, target)["frames"].count() == 4
    with pytest.raises(FileNotFoundError):
        staging.publish(spark, str(tmp_path / "none"), target, replace=True)
    assert runs.read_run(spark, target)["frames"].count() == 4
    about = runs.receipt({"frames": frames, "none": frames.limit(0)}, "abc").first()
    assert about.tables == {"frames": 12, "none": 0} and about.config_digest == "abc"
    preview = str(tmp_path / "preview")
    runs.save_preview({"frames": frames}, "abc", preview)
    assert spark.read.json(f"{preview}/receipt").first().config_digest == "abc" and runs.read_run(spark, preview)["frames"].count() == 12
    with pytest.raises(FileExistsError):
        runs.save_preview({"frames": frames}, "abc", preview)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["preview", "run", staged_late]
    assert frames.select(control.finite(F.col("tau"), "tau").alias("x")).agg(F.max("x")).first()[0] == 5.5
    with pytest.raises(Exception, match="tau must be finite"):
        frames.select(control.finite(F.lit(float("nan")), "tau")).collect()
    import datetime

    assert abs((datetime.datetime.now(datetime.UTC) - datetime.datetime.fromisoformat(about.generated_utc)).total_seconds()) < 120
    assert runs.generator_commit("/") == "unknown" and len(runs.generator_commit()) in (7, 40)
