"""Regions over tiles, closing, quiet crops, cohesion, components and choices in rounds, all against plain walks."""

import random

import numpy as np
import pytest

from sunloom.operators import graphs, greedy, regions

NEAR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
ALL = [*NEAR, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def flood(mask, steps):
    """Sets of connected cells."""
    left, out = {tuple(map(int, p)) for p in np.argwhere(mask)}, []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            r, c = todo.pop()
            for dr, dc in steps:
                if (r + dr, c + dc) in left:
                    left.discard((r + dr, c + dc))
                    part.add((r + dr, c + dc))
                    todo.append((r + dr, c + dc))
        out.append(part)
    return out


def described(frame, kind, part, shape):
    rows, columns = [p[0] for p in part], [p[1] for p in part]
    box = min(rows), max(rows), min(columns), max(columns)
    edge = box[0] == 0 or box[1] == shape[0] - 1 or box[2] == 0 or box[3] == shape[1] - 1
    return (frame, kind, len(part), *box, edge)


def wanted(images, diagonal=True):
    out = []
    for frame, mask in images.items():
        for kind, m, d in ((True, mask, diagonal), (False, ~mask, not diagonal)):
            out += [described(frame, kind, part, mask.shape) for part in flood(m, ALL if d else NEAR)]
    return sorted(out)


def pixels(spark, images):
    rows = [(f, int(r), int(c), "x") for f, m in images.items() for r, c in np.argwhere(m)]
    return spark.createDataFrame(rows, "frame_idx long, row_idx long, col_idx long, tile_row string")


def names(spark, images):
    return spark.createDataFrame([(f,) for f in images], "frame_idx long")


def shapes(height, width, seed):
    rng = np.random.default_rng(seed)
    snake = np.zeros((height, width), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    ring = np.zeros((height, width), bool)
    ring[2:-2, 2:-2] = True
    ring[4:-4, 4:-4] = False
    checks = np.indices((height, width)).sum(axis=0) % 2 == 0
    return {1: snake, 2: ring, 3: checks, 4: rng.random((height, width)) < 0.4, 5: rng.random((height, width)) < 0.6, 6: np.zeros((height, width), bool), 7: np.ones((height, width), bool)}


@pytest.mark.parametrize("tile", [2, 5, 8, 32])
@pytest.mark.parametrize("diagonal", [True, False])
def test_regions_by_flooding(spark, tile, diagonal):
    images = shapes(21, 17, tile)
    made = regions.regions(pixels(spark, images), ["frame_idx"], 21, 17, tile, diagonal, names(spark, images))
    columns = ("frame_idx", "set", "pixels", "top", "bottom", "first", "last", "edge")
    assert sorted(tuple(r[c] for c in columns) for r in made.collect()) == wanted(images, diagonal)


def test_pixels_outside_count_for_nothing_and_repeats_once(spark):
    rows = [(1, 0, 0, "x"), (1, 0, 0, "x"), (1, 9, 9, "x"), (1, -1, 0, "x"), (1, 0, 3, "x"), (1, None, 1, "x")]
    df = spark.createDataFrame(rows, "frame_idx long, row_idx long, col_idx long, tile_row string")
    made = sorted((r["set"], r.pixels) for r in regions.regions(df, ["frame_idx"], 3, 3, 2).collect())
    assert made == [(False, 8), (True, 1)]
    assert regions.regions(df.limit(0), ["frame_idx"], 3, 3, 2).count() == 0


@pytest.mark.parametrize("tile", [1, 3, 16])
def test_labels_of_tiles(tile):
    rng = np.random.default_rng(tile)
    mask = rng.random((5, tile, tile)) < 0.6
    for diagonal in (True, False):
        made = regions.labelled(mask, diagonal)
        for k in range(5):
            want = np.full((tile, tile), -1)
            for part in flood(mask[k], ALL if diagonal else NEAR):
                for r, c in part:
                    want[r, c] = min(a * tile + b for a, b in part)
            assert (made[k] == want).all()


def closed(mask, reach=2):
    height, width = mask.shape
    grown = np.zeros_like(mask)
    for r, c in np.argwhere(mask):
        grown[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1] = True
    out = np.zeros_like(mask)
    for r in range(reach, height - reach):
        for c in range(reach, width - reach):
            out[r, c] = grown[r - reach : r + reach + 1, c - reach : c + reach + 1].all()
    return out


def test_closing_by_windows(spark):
    images = {k: np.random.default_rng(k).random((13, 11)) < d for k, d in ((1, 0.05), (2, 0.2), (3, 0.9))}
    made = {(r.frame_idx, r.row_idx, r.col_idx) for r in regions.closed(pixels(spark, images), ["frame_idx"], 13, 11).collect()}
    assert made == {(k, int(r), int(c)) for k, m in images.items() for r, c in np.argwhere(closed(m))}


def quiet(crop):
    middle = float(np.median(crop))
    if middle <= 0:
        return False
    for raw, area in ((crop < 0.92 * middle, 0.02), (crop > 1.12 * middle, 0.03)):
        for part in flood(raw | closed(raw), ALL):
            rows, columns = [p[0] for p in part], [p[1] for p in part]
            if len(part) > area * crop.size or max(max(rows) - min(rows), max(columns) - min(columns)) + 1 > 0.35 * max(crop.shape):
                return False
    return True


def test_quiet_crops_by_rule(spark):
    crops = {}
    calm = np.full((40, 40), 100.0)
    for k, (where, value) in enumerate([((slice(0, 0), slice(0, 0)), 0), ((slice(10, 20), slice(10, 20)), 50), ((5, slice(2, 30)), 130), ((5, slice(2, 9)), 130), ((slice(3, 6), slice(3, 6)), 80), ((slice(0, 40), slice(0, 21)), -3.0)]):
        crops[k] = calm.copy()
        crops[k][where] = value
    rng = np.random.default_rng(1)
    for k in range(6, 12):
        crops[k] = 100 * (1 + 0.06 * rng.normal(size=(40, 40)))
        crops[k][rng.random((40, 40)) < 0.001 * (k - 6)] = 140
    holes = {(2, 7, 7), (3, 0, 0), (6, 20, 20)}
    rows = [(k, 0, r, c, float(v)) for k, m in crops.items() for (r, c), v in np.ndenumerate(m) if (k, r, c) not in holes]
    for k, r, c in holes:
        crops[k][r, c] = 0.0
    made = {r.frame_idx: r.quiet for r in regions.quiet_crops(spark.createDataFrame(rows, "frame_idx long, crop long, row_idx long, col_idx long, value double"), ["frame_idx", "crop"], 40, 40, tile=16).collect()}
    assert made == {k: quiet(m) for k, m in crops.items()} and set(made.values()) == {True, False}


def test_quiet_crops_whole_and_by_tiles_agree(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = []
    for k in range(30):
        crop = 100 * (1 + 0.03 * rng.normal(size=(16, 20)))
        y, x = rng.integers(0, 12, 2)
        crop[y : y + rng.integers(1, 4), x : x + rng.integers(1, 5)] *= 0.7 + 0.2 * (k % 4)
        rows += [(k // 3, k % 3, r, c, None if rng.random() < 0.002 else float(v)) for (r, c), v in np.ndenumerate(crop) if rng.random() > 0.003 * (k % 5)]
    rows += [(50, 0, r, c, 0.0) for r in range(4) for c in range(4)] + [(51, 0, -1, 3, 5.0), (51, 0, 3, 99, 5.0)]
    pixels = spark.createDataFrame(rows, "frame_idx long, crop long, row_idx long, col_idx long, value double")
    made = []
    for whole in (1 << 18, 0):
        monkeypatch.setattr(regions, "WHOLE", whole)
        crops = regions.quiet_crops(pixels, ["frame_idx", "crop"], 16, 20, tile=8)
        made.append({(r.frame_idx, r.crop): r.quiet for r in crops.collect()})
        if whole:
            assert "Join" not in crops._jdf.queryExecution().executedPlan().toString()
    assert made[0] == made[1] and len(made[0]) == 32 and set(made[0].values()) == {True, False}


@pytest.mark.parametrize("tile", [4, 64])
def test_cohesion_by_flooding(spark, tile):
    rng = np.random.default_rng(5)
    images = shapes(20, 19, 3)
    values = {k: np.where(m, 0.2 + 0.5 * rng.random(m.shape), 0.1 * rng.random(m.shape)) for k, m in images.items()}
    rows = [(k, r, c, float(v)) for k, m in values.items() for (r, c), v in np.ndenumerate(m)]
    made = {r.frame_idx: r for r in regions.cohesion(spark.createDataFrame(rows, "frame_idx long, row_idx long, col_idx long, absorption double"), "frame_idx", 20, 19, 0.15, tile=tile).collect()}
    assert set(made) == set(images)
    for k, m in images.items():
        parts = flood(m, ALL)
        holes = sum(len(p) for p in flood(~m, NEAR) if not described(0, False, p, m.shape)[-1])
        got, total = made[k], int(m.sum())
        assert (got.parts, got.largest_share, got.hole_share) == (len(parts), max(map(len, parts), default=0) / max(1, total), holes / max(1, total + holes))
        assert (got.p50 is None) if not total else np.allclose([got.p50, got.p90], np.percentile(values[k][m], [50, 90]))


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**12), 400)
    edges = [(ids[k], ids[k + 1]) for k in range(99)] + [(ids[100], ids[k]) for k in range(101, 200)] + [(ids[rng.randrange(200, 400)], ids[rng.randrange(200, 400)]) for _ in range(120)]
    edges += [edges[0], edges[3][::-1], (ids[5], ids[5])]
    made = {r.node: r.least for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert made == {x: find(x) for e in edges for x in e}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def greedily(nodes, conflicts):
    near, taken = {}, set()
    for a, b in conflicts:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node, _ in sorted(nodes, key=lambda n: n[1]):
        if not near.get(node, set()) & taken - {node}:
            taken.add(node)
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_choices_in_rounds_are_those_of_a_walk(spark, seed):
    rng = random.Random(seed)
    ranks = rng.sample(range(1000), 120) if seed else list(range(120))
    nodes = [(k * 7, r) for k, r in enumerate(ranks)]
    conflicts = [(k * 7, k * 7 + 7) for k in range(119)] if not seed else [(rng.randrange(120) * 7, rng.randrange(120) * 7) for _ in range(300)]
    made = graphs.chosen_by_rank(spark.createDataFrame(nodes, "node long, rank long"), spark.createDataFrame(conflicts + conflicts[:5], "a long, b long"))
    assert sorted(r.node for r in made.collect()) == sorted(greedily(nodes, conflicts))


def test_crops_are_chosen_as_one_after_the_other(spark):
    rng = random.Random(4)
    rows = [(w, rng.randrange(20), k, x, y, x + s, y + s) for k in range(400) for w, s, x, y in [(rng.randrange(3), rng.choice([10.0, 30.0, 200.0]), 7.0 * rng.randrange(60), 7.0 * rng.randrange(60))]]
    df = spark.createDataFrame(rows, "w long, rank long, id long, x0 double, y0 double, x1 double, y1 double")
    for count, tried in ((5, 40), (1000, 1000), (0, 10)):
        made = sorted(tuple(r) for r in greedy.choose_crops(df, "w", "id", count, tried, cell=50.0).collect())
        want = []
        for w in range(3):
            kept = []
            for r in sorted((r for r in rows if r[0] == w), key=lambda r: (r[1], r[2]))[:tried]:
                if len(kept) < count and all(r[3] >= k[5] or r[5] <= k[3] or r[4] >= k[6] or r[6] <= k[4] for k in kept):
                    kept.append(r)
            want += kept
        assert made == sorted(want)
    assert greedy.choose_crops(df.limit(0), "w", "id", 3).count() == 0


def placed(rows, separation, attempts):
    """Threads one after the other."""
    out, groups = [], {}
    for r in rows:
        if r[2] < attempts:
            groups.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    for group, threads in groups.items():
        before = []
        for thread in sorted(threads):
            best = None
            for _, _, attempt, x, y, z, radius in sorted(threads[thread], key=lambda r: r[2]):
                far = [((x - p[0]) ** 2 + (y - p[1]) ** 2 + (z - p[2]) ** 2) ** 0.5 for p in before]
                free = all(d >= separation * (radius + p[3]) for d, p in zip(far, before, strict=True))
                found = (free, min(far, default=None), (x, y, z, radius), attempt)
                if free or best is None or found[1] > best[1]:
                    best = found
                if free:
                    break
            before.append(best[2])
            out.append((group, thread, best[3], *best[2][:3], best[1], best[0]))
    return sorted(out)


@pytest.mark.parametrize("size", [3.0, 12.0, 60.0])
def test_threads_are_placed_as_one_after_the_other(spark, size):
    rng = np.random.default_rng(int(size))
    rows = [(g, 10 * g + int(t) * 3, a, *rng.uniform(0, size, 3).tolist(), float(rng.choice([0.2, 0.5, 1.0]))) for g in range(3) for t in rng.permutation(40) for a in range(6)]
    df = spark.createDataFrame(rows, "g long, thread_id long, attempt long, x double, y double, z double, radius double")
    made = sorted(tuple(r) for r in greedy.place_threads(df, "g", 1.5, 5).collect())
    want = placed(rows, 1.5, 5)
    assert [m[:3] + (m[-1],) for m in made] == [w[:3] + (w[-1],) for w in want]
    assert all((m[6] is None) == (w[6] is None) and (m[6] is None or abs(m[6] - w[6]) < 1e-9) for m, w in zip(made, want, strict=True))
    assert {w[-1] for w in want} == ({True, False} if size == 3 else {True})
    assert greedy.place_threads(df.limit(0), "g", 1.5).count() == 0
