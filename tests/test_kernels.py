import math

import numpy as np
from pyspark.sql import functions as F

from sunloom.operators import kernels, raster, ridges, sequences, spatial
from sunloom.plans import kernels as plans
from sunloom.plans.relations import relation


def test_loading_keeps_its_invariants(spark, small):
    rows = kernels.column_mass_loading(relation(spark, small, "threads")).collect()
    for x in rows:
        assert x.status in ("converged", "capacity_limited")
        assert x.intervals <= 8192 and 0 < x.loaded_share <= 1
        if x.status == "converged":
            assert abs(x.mass - 1e-4) <= 1.0001e-8
        else:
            assert x.loaded_share == 1 and x.mass == x.capacity < 1e-4


def test_loading_of_what_is_no_arc(spark):
    rows = spark.createDataFrame([(1, 400_000.0, 50_000.0), (2, None, 50_000.0), (3, 20_000.0, 50_000.0)], "thread_id long, length_km double, dip_radius_km double")
    made = {r.thread_id: r.status for r in kernels.column_mass_loading(rows.na.fill(0.0)).collect()}
    assert made[1] == made[2] == "invalid" and made[3] != "invalid"


def test_more_mass_loads_more():
    length, radius = np.array([60_000.0]), np.array([100_000.0])
    shares = [float(kernels.load(length, radius, m, kernels.PLASMA)[0][0]) for m in (1e-6, 1e-5, 3e-5)]
    assert shares == sorted(shares) and len(set(shares)) == 3


def mass_brute(share, n, length, radius, plasma):
    """The half dip's column mass one sample after the other."""
    loaded, half = share * length / 2, n // 2
    s = [loaded * (1 - k / half) for k in range(half + 1)]
    temp = [plasma["centre"] + (plasma["edge"] - plasma["centre"]) * (x / loaded) ** plasma["power"] for x in s]
    mass = []
    for t in temp:
        cool = min(1, max(0, (plasma["edge"] - t) / (plasma["edge"] - plasma["centre"])))
        mass.append((1 + 4 * kernels.HELIUM) / (2 + kernels.HELIUM - (1 - plasma["ionized"]) * cool**2))
    growth = [m * kernels.HYDROGEN * kernels.GRAVITY * 1e5 / (kernels.BOLTZMANN * t) * math.sin(x / radius) for m, t, x in zip(mass, temp, s, strict=True)]
    h, total, run = loaded / half, 0.0, [0.0]
    for k in range(1, half + 1):
        if k % 2 and k < half:
            total += h / 12 * (5 * growth[k - 1] + 8 * growth[k] - growth[k + 1])
        else:
            total += h / 12 * (-growth[k - 2] + 8 * growth[k - 1] + 5 * growth[k])
        run.append(total)
    density = [m * kernels.HYDROGEN * plasma["pressure"] * math.exp(r) / (kernels.BOLTZMANN * t) for m, r, t in zip(mass, run, temp, strict=True)]
    return 2e5 * h / 3 * sum(d * (1 if k in (0, half) else 4 if k % 2 else 2) for k, d in enumerate(density))


def test_rows_loaded_together_equal_rows_alone():
    rng = np.random.default_rng(9)
    length, radius = rng.uniform(10_000, 120_000, 40), rng.uniform(40_000, 250_000, 40)
    length[3] = np.nan
    together = kernels.load(length, radius, 5e-5, kernels.PLASMA)
    for k in range(40):
        alone = kernels.load(length[k : k + 1], radius[k : k + 1], 5e-5, kernels.PLASMA)
        assert [str(x[k]) for x in together] == [str(x[0]) for x in alone]
        if together[3][k] != "invalid":
            want = mass_brute(together[0][k], int(together[4][k]), length[k], radius[k], kernels.PLASMA)
            assert math.isclose(together[1][k], want, rel_tol=1e-9)
    assert together[3][3] == "invalid" and {"converged", "capacity_limited"} <= set(together[3])


def blurred(image, sigma, axis):
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    pad = [(reach, reach) if a == axis else (0, 0) for a in range(2)]
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="edge"), len(w), axis=axis) @ (w / w.sum())


def ridge_brute(diagram, start, jump, penalty, pull):
    """Cell by cell over a (distance, time) array."""
    image = np.where(np.isfinite(diagram), diagram, np.nanmedian(diagram))
    image = blurred(blurred(image, 1.5, 0), 0.7, 1)
    low, high = np.percentile(image, [10, 90], axis=0)
    cost = (image - low) / np.maximum(high - low, 1e-12)
    n, times = cost.shape
    totals, came = [[cost[i, 0] + (pull * (i - start) ** 2 if start is not None else 0) for i in range(n)]], []
    for t in range(1, times):
        best = [min((totals[-1][m] + penalty * (m - i) ** 2 + cost[i, t], m) for m in range(max(0, i - jump), min(n, i + jump + 1))) for i in range(n)]
        totals.append([b[0] for b in best])
        came.append([b[1] for b in best])
    path = [min(range(n), key=lambda i: (totals[-1][i], i))]
    for back in reversed(came):
        path.append(back[path[-1]])
    out = []
    for t, p in enumerate(path[::-1]):
        bend = image[p - 1, t] - 2 * image[p, t] + image[p + 1, t] if 0 < p < n - 1 else 0
        out.append(p + (float(np.clip(0.5 * (image[p - 1, t] - image[p + 1, t]) / bend, -1, 1)) if bend > 1e-12 else 0))
    return out


def test_ridges_by_cells(spark):
    rng = np.random.default_rng(12)
    shapes = {1: (15, 9), 2: (4, 5), 3: (1, 3), 4: (9, 1), 5: (12, 8)}
    made = {d: rng.random(s) for d, s in shapes.items()}
    made[5][:] = 1.0
    made[1][3, 4] = made[1][14, 0] = np.nan
    rows = [(d, 10 * t, 7 + k, None if np.isnan(v) and t else float(v)) for d, m in made.items() for (k, t), v in np.ndenumerate(m)]
    rows += [(6, 0, 0, None), (6, 1, 0, float("nan"))]
    df = spark.createDataFrame(rows, "diagram_id long, t long, k long, value double")
    for start, jump, penalty in ((None, 6, 0.15), (2.0, 1, 0.3)):
        found = {}
        for r in ridges.dark_ridge(df, start=start, jump=jump, penalty=penalty).collect():
            found.setdefault(r.diagram_id, {})[r.t] = r.position
        assert set(found) == set(made)
        for d, m in made.items():
            want = ridge_brute(m, start, jump, penalty, 0.5)
            assert np.allclose([found[d][10 * t] - 7 for t in range(m.shape[1])], want, atol=1e-9), d


def test_ridge_follows_the_band(spark, small):
    ticks = relation(spark, small, "ticks")
    truth = {(r.diagram_id, r.t): r.centre for r in plans.diagrams(ticks).select("diagram_id", "t").distinct().withColumn("centre", plans.swing(F.col("diagram_id"), F.col("t"))).collect()}
    made = ridges.dark_ridge(plans.diagrams(ticks)).collect()
    off = [abs(r.position - truth[r.diagram_id, r.t]) for r in made]
    assert len(made) == ticks.count() and np.median(off) < 0.3 and np.mean(np.array(off) < 2) > 0.98
    lower = ridges.dark_ridge(plans.diagrams(ticks), between=(20, 40)).collect()
    assert all(19 <= r.position <= 41 for r in lower)


def test_fit_recovers_its_parameters(spark, small):
    made = kernels.damped_sine_fit(plans.ridges(relation(spark, small, "ticks"))).collect()
    assert sum(x.trusted for x in made) >= 0.7 * len(made)
    for x in made:
        if x.trusted:
            assert abs(x.period - (3_600 + 120 * (x.ridge_id % 10))) < 60 and abs(x.amplitude - 10) < 0.5
            assert 0 < x.period_error < 60 and abs(x.period - (3_600 + 120 * (x.ridge_id % 10))) < 5 * x.period_error + 1


def test_fit_of_a_clean_sine_is_exact_and_its_errors_scale():
    t = 60.0 * np.arange(240)
    p = np.array([50.0, 0.001, 10.0, 3_900.0, 14_400.0, 0.3])
    made = kernels.fit_sine(t, kernels.sine(p, t))
    assert made["trusted"] == 1 and abs(made["period"] - 3_900) < 1e-3 and abs(made["amplitude"] - 10) < 1e-5 and made["period_error"] < 1e-2
    noise = np.random.default_rng(1).normal(0, 0.2, 240)
    some, more = (kernels.fit_sine(t, kernels.sine(p, t) + k * noise, robust=False) for k in (1, 2))
    assert math.isclose(more["period_error"] / some["period_error"], 2, rel_tol=0.1)
    # The textbook form: the residuals' variance times the inverse of the normal matrix.
    q = np.array([some[n] for n in ("equilibrium", "drift", "amplitude", "period", "damping", "phase")])
    j = kernels.sine_slopes(q, t)
    variance = ((kernels.sine(q, t) - kernels.sine(p, t) - noise) ** 2).sum() / (240 - 6)
    want = np.sqrt(np.diag(np.linalg.inv(j.T @ j)) * variance)
    assert np.allclose([some[f"{n}_error"] for n in ("equilibrium", "drift", "amplitude", "period", "damping", "phase")], want, rtol=1e-4)


def test_errors_of_what_the_data_leave_open():
    slopes = np.zeros((10, 3))
    slopes[:, 0], slopes[:, 1], slopes[:, 2] = 1, np.arange(10), 2
    made = kernels.column_errors(slopes, 8.0)
    assert np.isinf(made[[0, 2]]).all() and math.isclose(made[1], math.sqrt(8 / 7 / 82.5))
    assert np.isnan(kernels.column_errors(np.eye(3), 1.0)).all()
    assert np.isinf(kernels.column_errors(np.eye(4)[:, :2] * [1, 0], 1.0)).tolist() == [False, True]


def test_fit_within_given_periods():
    t = 60.0 * np.arange(240)
    both = kernels.sine(np.array([0.0, 0.0, 10.0, 3_900.0, 14_400.0, 0.3]), t) + kernels.sine(np.array([0.0, 0.0, 4.0, 1_200.0, 14_400.0, 1.0]), t)
    assert abs(kernels.fit_sine(t, both, robust=False)["period"] - 3_900) < 60
    assert abs(kernels.fit_sine(t, both, robust=False, periods=(900.0, 1_500.0))["period"] - 1_200) < 30


def test_fit_of_too_little_is_null():
    assert math.isnan(kernels.fit_sine(np.arange(5.0), np.ones(5))["period"])


def test_blur_equals_numpy(spark):
    rng = np.random.default_rng(3)
    image = rng.random((12, 10))
    rows = spark.createDataFrame([(0, int(i), int(j), float(image[i, j])) for i in range(12) for j in range(10)], "f int, row_idx long, col_idx long, v double")
    made = raster.blur(rows, ["f"], ["v"], 4.0, 12, 10).collect()
    w = np.array(raster.gaussian_weights(4.0))
    want = image
    for axis in (0, 1):
        pad = [(16, 16) if a == axis else (0, 0) for a in (0, 1)]
        want = np.lib.stride_tricks.sliding_window_view(np.pad(want, pad, mode="symmetric"), 33, axis=axis) @ w
    assert len(made) == 120
    assert max(abs(r.v - want[r.row_idx, r.col_idx]) for r in made) < 1e-12


def test_regular_windows_by_gaps(spark):
    def starts(times, n, cadence):
        rows = spark.createDataFrame([(0, float(t)) for t in times], "g int, t double")
        return sorted(r.t for r in sequences.regular_windows(rows, ["g"], "t", n, cadence).collect())

    assert starts([0, 60, 120, 240, 300, 360], 3, 60.0) == [0, 240]
    assert starts([0, 20, 80, 140], 3, 60.0) == [20]


def test_irregular_times_are_found(spark):
    rows = spark.createDataFrame([(0, k, t) for k, t in enumerate([0.0, 60.0, 60.0, 120.0])], "g int, idx int, t double")
    assert [r.idx for r in sequences.irregular(rows, ["g"], "t").collect()] == [2]


def test_simpson_is_exact_for_parabolas(spark):
    xs = [0.0, 0.5, 1.25, 2.0, 3.5, 4.0]
    rows = spark.createDataFrame([(0, k, x, 3 * x * x + 2 * x + 1) for k, x in enumerate(xs)], "g int, idx int, x double, y double")
    for r in sequences.cumulative_integral(rows, ["g"], "idx", "y", "x").collect():
        assert abs(r.integral - (r.x**3 + r.x**2 + r.x)) < 1e-9


def test_placement_keeps_distance_or_the_farthest(spark, small):
    made = plans.book.queries["thread_placement"](spark, small)
    rows = made.collect()
    assert len(rows) == 200 and {r.filament_id for r in rows} == {0, 1}
    assert all(r.accepted for r in rows if r.gap is None)
    assert made.groupBy("thread_id").count().filter("count > 1").count() == 0


def test_placement_by_walk_equals_rounds_and_a_plain_loop(spark):
    from sunloom.operators import greedy

    rng = np.random.default_rng(12)
    rows = [(g, t, a, *map(float, rng.uniform(0, 40, 3)), float(1 + t % 3)) for g, n in ((0, 1), (1, 7), (2, 40)) for t in range(n) for a in range(4)]
    rows += [(None, 1, 0, 1.0, 1.0, 1.0, 1.0), (1, 99, 9, 1.0, 1.0, 1.0, 1.0)]
    tries = spark.createDataFrame(rows, "g long, thread_id long, attempt long, x double, y double, z double, radius double").repartition(5)
    want = {}
    for g in range(3):
        placed = []
        for t in sorted({r[1] for r in rows if r[0] == g and r[2] < 4}):
            best = None
            for r in sorted(r for r in rows if r[:2] == (g, t)):
                gaps = [math.dist(r[3:6], p[3:6]) for p in placed]
                free = all(d >= 2.5 * (r[6] + p[6]) for d, p in zip(gaps, placed, strict=True))
                score = (free, -r[2] if free else min(gaps, default=0.0))
                if best is None or score > best[0]:
                    best = (score, r, min(gaps, default=None), free)
            placed.append(best[1])
            want[g, t] = (best[1][2], best[2] and round(best[2], 9), best[3])
    for most in (10**6, 30, 0):
        made = greedy.place_threads(tries, "g", 2.5, attempts=4, most=most)
        assert {(r.g, r.thread_id): (r.attempt, r.gap and round(r.gap, 9), r.accepted) for r in made.collect()} == want
    assert {v[2] for v in want.values()} == {True, False}
    plan = greedy.place_threads(tries, "g", 2.5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_selected_crops_do_not_overlap(spark, small):
    made = plans.book.queries["crop_selection"](spark, small)
    a, b = made.alias("a"), made.alias("b")
    met = a.join(b, F.expr("a.window_id = b.window_id and a.crop_id < b.crop_id and a.x0 < b.x1 and a.x1 > b.x0 and a.y0 < b.y1 and a.y1 > b.y0"))
    assert met.count() == 0


def test_nearest_by_one_merge_is_the_nearest(spark):
    rng = np.random.default_rng(4)
    sites = [(k, float(x)) for k, x in enumerate([*rng.uniform(0, 1e5, 40), 5e6, -3e6])] + [(99, None)]
    things = [(k, float(x)) for k, x in enumerate(np.round(rng.uniform(0, 1e5, 300), -2))]
    made = {r.q: (r.id, r.gap) for r in spatial.nearest(spark.createDataFrame(sites, "q long, at double"), spark.createDataFrame(things, "id long, x double"), "q", "at", "x", "id").collect()}
    assert made == {q: min(((abs(x - at), k) for k, x in things))[::-1] for q, at in sites if at is not None}
    clump = [(k, 1e9 + k % 7) for k in range(500)] + [(k, float("nan")) for k in range(500, 510)]
    far = [(k, float(k % 3)) for k in range(200)] + [(200, 2e9), (201, 1e9 + 3)]
    made = {r.q: (r.id, r.gap) for r in spatial.nearest(spark.createDataFrame(far, "q long, at double").repartition(7), spark.createDataFrame(clump, "id long, x double"), "q", "at", "x", "id").collect()}
    assert made == {q: min(((abs(x - at), k) for k, x in clump if x == x))[::-1] for q, at in far}
    none = spatial.nearest(spark.createDataFrame(sites, "q long, at double"), spark.createDataFrame([], "id long, x double"), "q", "at", "x", "id")
    assert none.count() == 0 and none.columns == ["q", "gap", "id"]


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(230, 7)), 1)
    x[5] = x[9] = x[11]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, [1.0, 2.0])], "id long, v array<double>")
    asked = vectors.filter("id % 10 = 5 or id > 400").selectExpr("id q", "v")
    made = {}
    for r in spatial.nearest_vectors(asked, vectors, "q", "id", "v", 3, rows=40, asked=5).collect():
        made.setdefault(r.q, []).append((r.d, r.id))
    assert set(made) == set(range(5, 230, 10))
    for q, got in made.items():
        d = np.round(((x - x[q]) ** 2).sum(axis=1), 6)
        assert sorted(got) == sorted((d[k], k) for k in range(230) if k != q)[:3]
    plan = spatial.nearest_vectors(asked, vectors, "q", "id", "v", 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
