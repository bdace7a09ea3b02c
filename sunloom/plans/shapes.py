"""Queries over curves, crops and frames: resampling, spine choice, pitch, disks, candidates, samples, renders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dips, pendulum, transfer
from ..operators import curves, raster, sequences, shapes
from ..operators.sizes import small
from .images import _gauss
from .registry import Registry, r
from .relations import group_of
from .relations import rounded as q
from .relations import with_relations as over
from .series import _AMP, _AZ, _CP, _uniform, brownian_steps

book = Registry()
_CURVE = "cv AS (SELECT thread_id, idx, x_km + s AS x, y_km + 500e0 * sin(idx / 3e0) AS y FROM thread_points), ds AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0e0) AS d FROM cv WINDOW w AS (PARTITION BY thread_id ORDER BY idx)), ar AS (SELECT *, sum(d) OVER (PARTITION BY thread_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS arc FROM ds)"


def _curves(points: DataFrame) -> DataFrame:
    return points.select("thread_id", "idx", (F.col("x_km") + F.col("s")).alias("x"), (F.col("y_km") + 500.0 * F.sin(F.col("idx") / 3.0)).alias("y"))


@book.query(
    "thread_points",
    sql=over(
        f"{_CURVE}, le AS (SELECT *, lead(arc) OVER w AS arc1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ar WINDOW w AS (PARTITION BY thread_id ORDER BY idx)), qs AS (SELECT thread_id, k, max(arc) * k / 10e0 AS at FROM ar, (SELECT unnest(range(11)) AS k) GROUP BY 1, 2) "
        f"SELECT q.thread_id, k::INT AS k, {q('q.at')} AS arc, {q('CASE WHEN arc1 IS NULL THEN x ELSE x + (x1 - x) * (q.at - arc) / (arc1 - arc) END', 4)} AS x, {q('CASE WHEN arc1 IS NULL THEN y ELSE y + (y1 - y) * (q.at - arc) / (arc1 - arc) END', 4)} AS y FROM qs q ASOF JOIN le ON q.thread_id = le.thread_id AND q.at >= le.arc",
        "thread_points",
    ),
)
def arclength_resample(points: DataFrame) -> DataFrame:
    made = shapes.resample(_curves(points), "thread_id", "idx", ["x", "y"], 11)
    return made.select("thread_id", "k", r(F.col("arc")).alias("arc"), r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"))


_C40, _S40 = repr(math.cos(math.radians(40))) + "::DOUBLE", repr(math.sin(math.radians(40))) + "::DOUBLE"


@book.query(
    "thread_points",
    sql=over(
        f"{_CURVE}, bx AS (SELECT thread_id, max(x * {_C40} - y * {_S40}) - min(x * {_C40} - y * {_S40}) AS width, max(x * {_S40} + y * {_C40}) - min(x * {_S40} + y * {_C40}) AS height, max(arc) AS length FROM ar GROUP BY 1) "
        f"SELECT thread_id, {q('width', 4)} AS width, {q('height', 4)} AS height, {q('length', 4)} AS length FROM bx WHERE width <= 0.9e0 * 60000e0 AND height <= 0.9e0 * 60000e0 AND length BETWEEN 30000e0 AND 80000e0",
        "thread_points",
    ),
)
def spine_choice(points: DataFrame) -> DataFrame:
    made = shapes.fitting_spines(_curves(points), "thread_id", 40.0, 60_000.0, 60_000.0, 0.9, 30_000.0, 80_000.0)
    return made.select("thread_id", *[r(F.col(c), 4).alias(c) for c in ("width", "height", "length")])


@book.query(
    "thread_points",
    sql=over(
        f"{_CURVE}, st AS (SELECT thread_id % 12 AS grp, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM cv WINDOW w AS (PARTITION BY thread_id ORDER BY idx)), an AS (SELECT grp, sqrt(dx * dx + dy * dy) AS l, degrees(acos(least(abs(dx * 3e0 + dy * 4e0) / (sqrt(dx * dx + dy * dy) * sqrt(25e0)), 1e0))) AS a FROM st WHERE sqrt(dx * dx + dy * dy) > 0) SELECT grp, {q('sum(a * l) / sum(l)')} AS pitch_deg FROM an GROUP BY 1",
        "thread_points",
    ),
)
def mean_pitch(points: DataFrame) -> DataFrame:
    rows = _curves(points).select((F.col("thread_id") % 12).alias("grp"), "thread_id", "idx", "x", "y", F.lit(3.0).alias("tx"), F.lit(4.0).alias("ty"))
    return shapes.mean_pitch(rows, ["grp"], "thread_id", "idx").select("grp", r(F.col("pitch_deg")).alias("pitch_deg"))


@book.query("pixels", sql=over(f"b AS (SELECT frame_idx, min(row_idx) AS r0, max(row_idx) AS r1, min(col_idx) AS c0, max(col_idx) AS c1 FROM pixels WHERE intensity > 49e0 AND row_idx BETWEEN 8 AND 55 AND col_idx BETWEEN 8 AND 55 GROUP BY 1) SELECT frame_idx, (c0 + c1) / 2e0 AS cx, (r0 + r1) / 2e0 AS cy, ((r1 - r0 + 1) + (c1 - c0 + 1)) / 4e0 AS radius, abs((r1 - r0) - (c1 - c0)) <= 0.02e0 * greatest(r1 - r0 + 1, c1 - c0 + 1) AS \"round\" FROM b", "pixels"))
def disk_geometry(pixels: DataFrame) -> DataFrame:
    return shapes.disk_geometry(pixels.filter(F.col("row_idx").between(8, 55) & F.col("col_idx").between(8, 55)), ["frame_idx"], "intensity", 49.0)


@book.query(
    "pixels",
    sql=over(
        f"v AS (SELECT frame_idx, row_idx, col_idx, CASE WHEN (row_idx + col_idx) % 17 = 0 THEN NULL ELSE intensity - 10e0 END AS v, pow(col_idx - 32, 2) + pow(row_idx - 32, 2) > pow(20.5e0, 2) AS off_disk FROM pixels), m AS (SELECT frame_idx, avg(v) FILTER (off_disk) AS m FROM v GROUP BY 1), f AS (SELECT v.*, greatest(coalesce(v, m), 0e0) AS s FROM v JOIN m USING (frame_idx)), t AS (SELECT frame_idx, max(s) AS t FROM f GROUP BY 1) SELECT frame_idx, row_idx, col_idx, {q('s / t')} AS scaled FROM f JOIN t USING (frame_idx)",
        "pixels",
    ),
)
def detector_input(pixels: DataFrame) -> DataFrame:
    value = F.when((F.col("row_idx") + F.col("col_idx")) % 17 != 0, F.col("intensity") - 10.0)
    off = shapes.off_disk(F.col("col_idx"), F.col("row_idx"), F.lit(32.0), F.lit(32.0), F.lit(20.0))
    made = shapes.prepared_image(pixels.select("frame_idx", "row_idx", "col_idx", value.alias("v")), ["frame_idx"], "v", off)
    return made.select("frame_idx", "row_idx", "col_idx", r(F.col("scaled")).alias("scaled"))


@book.query(
    "frames",
    sql=over(
        f"d AS (SELECT frame_idx, p AS position, floor({_uniform(21, 'frame_idx', 'p')} * 193)::BIGINT AS x0, floor({_uniform(22, 'frame_idx', 'p')} * 137)::BIGINT AS y0 FROM (SELECT frame_idx, unnest(range(64)) AS p FROM frames)), "
        "gx AS (SELECT unnest(list_distinct(list_concat(range(0, 193, 16), [192::BIGINT]))) AS x0), gy AS (SELECT unnest(list_distinct(list_concat(range(0, 137, 16), [136::BIGINT]))) AS y0), g AS (SELECT frame_idx, 64 + y0 * 193 + x0 AS position, x0, y0 FROM frames, gx, gy) "
        "SELECT frame_idx, min(position) AS position, x0, y0, x0 + 64 AS x1, y0 + 64 AS y1 FROM (SELECT * FROM d UNION ALL SELECT * FROM g) GROUP BY frame_idx, x0, y0",
        "frames",
    ),
)
def candidate_crops(frames: DataFrame) -> DataFrame:
    return shapes.candidate_crops(frames, "frame_idx", (256, 200), (64, 64), 64, 16)


_NOISE_W = raster.gaussian_weights(2.0)


@book.query(
    "threads",
    sql=over(
        f"w AS (SELECT unnest(range(-8, 9)) AS k, unnest([{', '.join(repr(w) + '::DOUBLE' for w in _NOISE_W)}]) AS w), t AS (SELECT thread_id, unnest(range(24)) AS i FROM threads), f AS (SELECT thread_id, i, w, CASE WHEN (i + k + 48) % 48 < 24 THEN (i + k + 48) % 48 ELSE 47 - (i + k + 48) % 48 END AS frame_idx FROM t, w), "
        f"s AS (SELECT thread_id, i, sum(({_uniform(31)} - 0.5e0) * w) AS noise FROM f GROUP BY 1, 2) SELECT thread_id, i::INT AS i, {q('noise / max(abs(noise)) OVER (PARTITION BY thread_id)')} AS noise FROM s",
        "threads",
    ),
)
def smooth_noise(threads: DataFrame) -> DataFrame:
    series = threads.select("thread_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i"))
    return shapes.smooth_noise(series, "thread_id", "i", 24, 2.0).select("thread_id", "i", r(F.col("noise")).alias("noise"))


@book.query("threads", sql=over(f"u AS (SELECT thread_id, {_uniform(41, 'thread_id', '0')} AS u, {_uniform(42, 'thread_id', '1')} AS v FROM threads) SELECT thread_id, {q('least(greatest(100000e0 * exp(0.25e0 * sqrt(-2e0 * ln(greatest(1e0 - u, 1e-12))) * cos(2e0 * pi() * v)), 50000e0), 250000e0)', 4)} AS radius_km FROM u", "threads"))
def dip_radius_sample(threads: DataFrame) -> DataFrame:
    return threads.select("thread_id", r(shapes.clipped_lognormal(F.col("thread_id"), 100_000.0, 0.25, 50_000.0, 250_000.0), 4).alias("radius_km"))


@book.query("crops", sql=over(f"c AS (SELECT crop_id, (x0 + x1) / 2e0 - 800e0 AS dx, (y0 + y1) / 2e0 - 800e0 AS dy FROM crops) SELECT crop_id, {q('sqrt(greatest(1e0 - (dx * dx + dy * dy) / (900e0 * 900e0), 0e0))')} AS mu, {q('(degrees(atan2(dy, dx)) + 360e0) % 360e0')} AS limb_deg FROM c", "crops"))
def viewing_angle(crops: DataFrame) -> DataFrame:
    mu, limb = shapes.viewing_angle((F.col("x0") + F.col("x1")) / 2 - 800.0, (F.col("y0") + F.col("y1")) / 2 - 800.0, 900.0)
    return crops.select("crop_id", r(mu).alias("mu"), r(limb).alias("limb_deg"))


@book.query("threads", sql=over(f"d AS (SELECT thread_id, x_km / 4000e0 AS x, y_km / 4000e0 AS y, cos(radians(pitch_deg * 8e0)) AS dx, sin(radians(pitch_deg * 8e0)) AS dy FROM threads) SELECT thread_id, {q('list_min(list_filter([CASE WHEN dx > 1e-12 THEN (95e0 - x) / dx END, CASE WHEN dx < -1e-12 THEN -x / dx END, CASE WHEN dy > 1e-12 THEN (95e0 - y) / dy END, CASE WHEN dy < -1e-12 THEN -y / dy END], lambda d: d >= 0))')} AS distance FROM d", "threads"))
def boundary_distance(threads: DataFrame) -> DataFrame:
    turn = F.radians(F.col("pitch_deg") * 8.0)
    return threads.select("thread_id", r(dips.boundary_distance(F.col("x_km") / 4000.0, F.col("y_km") / 4000.0, F.cos(turn), F.sin(turn), 96.0, 96.0)).alias("distance"))


@book.query("boxes", sql=over(f"s AS (SELECT box_id, x0, x1, least(greatest((x1 - x0) * 1.5e0, 0.04e0 * 1700e0), 1700e0) AS w FROM boxes), l AS (SELECT *, least(greatest((x0 + x1) / 2e0 - w / 2e0, 0e0), 1700e0 - w) AS lo FROM s) SELECT box_id, {q('lo')} AS low, {q('lo + w')} AS high FROM l", "boxes"))
def expanded_bounds(boxes: DataFrame) -> DataFrame:
    low, high = dips.expanded_bounds(F.col("x0"), F.col("x1"), F.lit(1700.0), 0.04, 0.25)
    return boxes.select("box_id", r(low).alias("low"), r(high).alias("high"))


@book.query("threads", "frames", sql=over(f"SELECT thread_id, frame_idx, {q('50e0 + 0.001e0 * (time_s - 60e0) + radius_km / 30e0 * exp(-(time_s - 60e0) / 14400e0) * sin(2e0 * pi() * (time_s - 60e0) / (600e0 + pitch_deg) + 0.3e0)')} AS model FROM threads CROSS JOIN frames", "threads", "frames"))
def damped_sine_model(threads: DataFrame, frames: DataFrame) -> DataFrame:
    f = lambda x: F.lit(float(x))
    both = threads.crossJoin(small(frames))
    model = pendulum.damped_sine(F.col("time_s"), f(50), f(0.001), F.col("radius_km") / 30.0, 600.0 + F.col("pitch_deg"), f(14_400), f(0.3), f(60))
    return both.select("thread_id", "frame_idx", r(model).alias("model"))


_THIRTEENTHS = group_of("idx", 13)


@book.query("ticks", sql=over(f"n AS (SELECT {_THIRTEENTHS} AS grp, idx, row_number() OVER (PARTITION BY {_THIRTEENTHS} ORDER BY t) - 1 AS n, count(*) OVER (PARTITION BY {_THIRTEENTHS}) AS c FROM ticks) SELECT grp, idx FROM n WHERE c <= 20 OR n = 0 OR floor(n * 19 / greatest(c - 1, 1)) > floor((n - 1) * 19 / greatest(c - 1, 1))", "ticks"))
def even_sample(ticks: DataFrame) -> DataFrame:
    rows = ticks.select(F.expr(_THIRTEENTHS).alias("grp"), "idx", "t")
    return shapes.evenly(rows, "grp", "t", 20).select("grp", "idx")


@book.query("thread_points", sql=over(f"g AS (SELECT thread_id, s FROM thread_points UNION SELECT thread_id, length_km * k / 16e0 FROM threads, (SELECT unnest(range(17)) AS k)) SELECT thread_id, {q('s')} AS s, row_number() OVER (PARTITION BY thread_id ORDER BY s) - 1 AS k FROM g", "thread_points"))
def merged_grid(points: DataFrame) -> DataFrame:
    """The sorted union of two samplings of each thread, each place once."""
    even = points.filter("idx = 0").select("thread_id", F.col("length_km").alias("__l"), F.explode(F.sequence(F.lit(0), F.lit(16))).alias("__k")).select("thread_id", (F.col("__l") * F.col("__k") / 16.0).alias("s"))
    both = points.select("thread_id", "s").unionByName(even).distinct()
    return both.select("thread_id", r(F.col("s")).alias("s"), (F.row_number().over(sequences.ordered(["thread_id"], "s")) - 1).cast("long").alias("k"))


@book.query("pixels", sql=over(f"b AS (SELECT row_idx, col_idx, intensity FROM pixels WHERE frame_idx = 0), a AS (SELECT * FROM pixels WHERE frame_idx % 2 = 0) SELECT p.frame_idx, p.row_idx, p.col_idx, {q('coalesce(a.intensity, b.intensity, 0e0)')} AS background FROM pixels p LEFT JOIN a USING (frame_idx, row_idx, col_idx) LEFT JOIN b ON b.row_idx = p.row_idx AND b.col_idx = p.col_idx", "pixels"))
def frame_background(pixels: DataFrame) -> DataFrame:
    """A frame's own background where there is one, else that of frame 0."""
    own = pixels.filter("frame_idx % 2 = 0").select("frame_idx", "row_idx", "col_idx", F.col("intensity").alias("own"))
    still = pixels.filter("frame_idx = 0").select("row_idx", "col_idx", F.col("intensity").alias("still"))
    joined = pixels.select("frame_idx", "row_idx", "col_idx").join(own, ["frame_idx", "row_idx", "col_idx"], "left").join(still, ["row_idx", "col_idx"], "left")
    return joined.select("frame_idx", "row_idx", "col_idx", r(F.coalesce("own", "still", F.lit(0.0))).alias("background"))


@book.query("pixels", sql=over(f"SELECT frame_idx, {q('coalesce(quantile_cont(tau, 0.95) FILTER (tau > 0.35e0), 0e0)')} AS tau_p95, {q('coalesce(max(abs(tau - 0.05e0)) FILTER (intensity > 49.5e0), 0e0)')} AS most, {q('min(tau)')} AS low, {q('quantile_cont(tau, 0.5)')} AS middle, {q('max(tau)')} AS high, count_if(tau > 0.1e0) AS hard FROM pixels GROUP BY 1", "pixels"))
def static_summary(pixels: DataFrame) -> DataFrame:
    """Aggregates inside masks with 0 where a mask is empty."""
    tau = F.col("tau")
    inside = F.coalesce(F.percentile(F.when(tau > 0.35, tau), 0.95), F.lit(0.0))
    most = F.coalesce(F.max(F.when(F.col("intensity") > 49.5, F.abs(tau - 0.05))), F.lit(0.0))
    return pixels.groupBy("frame_idx").agg(r(inside).alias("tau_p95"), r(most).alias("most"), r(F.min(tau)).alias("low"), r(F.percentile(tau, 0.5)).alias("middle"), r(F.max(tau)).alias("high"), F.count_if(tau > 0.1).alias("hard"))


_MOVED = "mv AS (SELECT thread_id, frame_idx, (x_km + 3000e0 * sin(2e0 * pi() * time_s / (600e0 + pitch_deg))) / 4000e0 AS x_px, (y_km + 500e0 * cos(2e0 * pi() * time_s / 900e0)) / 4000e0 AS y_px, radius_km / 400e0 AS sigma_px, 1e0 + pitch_deg / 40e0 AS amplitude, cos(radians(pitch_deg)) AS vx, sin(radians(pitch_deg)) AS vy FROM threads CROSS JOIN frames)"


@book.query(
    "threads",
    "frames",
    sql=over(
        f"{_MOVED}, h AS (SELECT *, greatest(ceil(4e0 * sigma_px + 0.5e0), 1)::BIGINT AS half FROM mv), y AS (SELECT *, unnest(range(round_even(y_px, 0)::BIGINT - half, round_even(y_px, 0)::BIGINT + half + 1)) AS row_idx FROM h), x AS (SELECT *, unnest(range(round_even(x_px, 0)::BIGINT - half, round_even(x_px, 0)::BIGINT + half + 1)) AS col_idx FROM y WHERE row_idx BETWEEN 0 AND 93), "
        f"c AS (SELECT frame_idx, row_idx, col_idx, vx, vy, amplitude * {_gauss('row_idx', 'y_px')} * {_gauss('col_idx', 'x_px')} AS tau FROM x WHERE col_idx BETWEEN 0 AND 93), s AS (SELECT frame_idx, row_idx, col_idx, sum(tau) AS w, sum(tau * vx) AS nx, sum(tau * vy) AS ny FROM c GROUP BY 1, 2, 3) "
        f"SELECT frame_idx, row_idx, col_idx, {q('w', 5)} AS weight, {q('CASE WHEN w > 0.001e0 THEN nx / w ELSE 0e0 END', 4)} AS vx, {q('CASE WHEN w > 0.001e0 THEN ny / w ELSE 0e0 END', 4)} AS vy FROM s WHERE w > 0.01e0",
        "threads",
        "frames",
    ),
)
def dynamic_render(threads: DataFrame, frames: DataFrame) -> DataFrame:
    """Moved threads to optical depth and weighted velocity of every frame, in one aggregation."""
    t, pitch = F.col("time_s"), F.radians("pitch_deg")
    moved = threads.crossJoin(small(frames)).select(
        "thread_id", "frame_idx", ((F.col("x_km") + 3000.0 * F.sin(2 * math.pi * t / (600.0 + F.col("pitch_deg")))) / 4000.0).alias("x_px"),
        ((F.col("y_km") + 500.0 * F.cos(2 * math.pi * t / 900.0)) / 4000.0).alias("y_px"), (F.col("radius_km") / 400.0).alias("sigma_px"), (1 + F.col("pitch_deg") / 40.0).alias("amplitude"), F.cos(pitch).alias("vx"), F.sin(pitch).alias("vy"),
    )
    hits = raster.thread_contributions(moved, ["thread_id", "frame_idx"], 94, 94)
    made = raster.weighted_velocity(hits, ["frame_idx"], 0.001).filter("weight > 0.01")
    return made.select("frame_idx", "row_idx", "col_idx", r(F.col("weight"), 5).alias("weight"), r(F.col("vx"), 4).alias("vx"), r(F.col("vy"), 4).alias("vy"))


@book.query("pixels", sql=over(f"SELECT frame_idx, row_idx, col_idx, 3e0 + (greatest(2e0 * 8, 18e0) - 3e0) * least(greatest(intensity / 40e0, 0e0), 1e0) AS length_px, round_even(255e0 * least(greatest((tau - 0.01e0) / (0.3e0 - 0.01e0), 0e0), 1e0), 0)::INT AS colour FROM pixels", "pixels"))
def arrow_lengths(pixels: DataFrame) -> DataFrame:
    """Display geometry: arrow lengths by speed and colour indexes."""
    longest = max(2.0 * 8, 18.0)
    length = 3.0 + (longest - 3.0) * dips.clip(F.col("intensity") / 40.0, 0.0, 1.0)
    return pixels.select("frame_idx", "row_idx", "col_idx", length.alias("length_px"), transfer.display(F.col("tau"), F.lit(0.01), F.lit(0.3)).alias("colour"))


@book.query(
    "thread_points",
    sql=over(
        """c AS (SELECT thread_id, idx, pitch_deg, (x_km + s) - avg(x_km + s) OVER w AS x0, (y_km + 500e0 * sin(idx / 3e0)) - avg(y_km + 500e0 * sin(idx / 3e0)) OVER w AS y0 FROM thread_points WINDOW w AS (PARTITION BY thread_id)),
        f AS (SELECT thread_id, idx, radians(3e0 * pitch_deg) AS a, CASE WHEN thread_id % 2 = 1 THEN -x0 ELSE x0 END AS x, CASE WHEN thread_id % 4 > 1 THEN -y0 ELSE y0 END AS y FROM c),
        t AS (SELECT thread_id, idx, x * cos(a) - y * sin(a) + 45000e0 AS u, x * sin(a) + y * cos(a) + 45000e0 AS v FROM f),
        m AS (SELECT *, least(greatest(0e0, 4500e0 - min(u) OVER w), 85500e0 - max(u) OVER w) AS du, least(greatest(0e0, 4500e0 - min(v) OVER w), 85500e0 - max(v) OVER w) AS dv FROM t WINDOW w AS (PARTITION BY thread_id)) """
        + f"SELECT thread_id, idx, {q('u + du', 4)} AS x, {q('v + dv', 4)} AS y FROM m",
        "thread_points",
    ),
)
def oriented_spine(points: DataFrame) -> DataFrame:
    """Each thread's curve mirrored, turned and set into a field of view of 90 Mm a side."""
    i = F.col("thread_id")
    rows = points.select("thread_id", "idx", "pitch_deg", (F.col("x_km") + F.col("s")).alias("x"), (F.col("y_km") + 500.0 * F.sin(F.col("idx") / 3.0)).alias("y"))
    made = curves.oriented(rows, "thread_id", 3.0 * F.col("pitch_deg"), i % 2 == 1, i % 4 > 1, 90_000.0, 90_000.0)
    return made.select("thread_id", "idx", r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"))


_TOTAL = 400_000.0


@book.query(
    "threads",
    sql=over(
        """v AS (SELECT thread_id, x_km * 4e5 / 375000e0 AS centre, least(2e0 * dip_radius_km * sin(length_km / (2e0 * dip_radius_km)) * abs(cos(radians(pitch_deg))), 4e5) AS span, 1e0 + 0.35e0 * sin(thread_id) AS wave, (thread_id % 21 - 10) * 1000e0 AS aside, length_km FROM threads),
        s AS (SELECT *, least(greatest(centre - span / 2, 0e0), 4e5 - span) AS a FROM v), e AS (SELECT *, greatest(sqrt(greatest(1e0 - pow(2e0 * (a + span / 2) / 4e5 - 1e0, 2), 0e0)), 0.15e0) * wave AS w FROM s),
        l AS (SELECT *, 1.6e0 * greatest(w, 0.25e0) * 3750e0 AS lim, greatest(ceil(length_km / 150e0)::BIGINT + 1, 5) AS n FROM e) """
        + f"SELECT thread_id, {q('a')} AS start_km, {q('a + span')} AS end_km, {q('w')} AS envelope, {q('lim * tanh(aside / lim)')} AS offset_km, n + (1 - n % 2) AS points FROM l",
        "threads",
    ),
)
def thread_spans(threads: DataFrame) -> DataFrame:
    """Where each thread lies on a curve of 400 Mm, how far aside, and how many points it gets."""
    chord = 2 * F.col("dip_radius_km") * F.sin(dips.half_angle(F.col("length_km"), F.col("dip_radius_km")))
    total = F.lit(_TOTAL)
    start, end = curves.span_on(F.col("x_km") * _TOTAL / 375_000.0, chord * F.abs(F.cos(F.radians("pitch_deg"))), total)
    placed = threads.select("thread_id", "length_km", start.alias("start_km"), end.alias("end_km"), (1 + 0.35 * F.sin("thread_id")).alias("wave"), ((F.col("thread_id") % 21 - 10) * 1_000.0).alias("aside"))
    placed = placed.withColumn("envelope", curves.envelope((F.col("start_km") + F.col("end_km")) / 2, total, F.col("wave")))
    offset = curves.confined(F.col("aside"), F.col("envelope"), 3_750.0)
    return placed.select("thread_id", r(F.col("start_km")).alias("start_km"), r(F.col("end_km")).alias("end_km"), r(F.col("envelope")).alias("envelope"), r(offset).alias("offset_km"), curves.odd_points(F.col("length_km"), 150.0).alias("points"))


@book.query(
    "threads",
    sql=over(
        """n AS (SELECT *, greatest(ceil(length_km / 4000e0)::BIGINT + 1, 5) AS m FROM threads), o AS (SELECT *, m + (1 - m % 2) AS n FROM n), p AS (SELECT *, unnest(range(n)) AS k FROM o),
        g AS (SELECT *, length_km * k / (n - 1) AS s, length_km * k / (n - 1) / dip_radius_km - length_km / (2e0 * dip_radius_km) AS a, radians(pitch_deg + thread_id % 180) AS d FROM p) """
        + f"SELECT thread_id, k, {q('s', 4)} AS s, {q('x_km + dip_radius_km * sin(a) * cos(d)', 4)} AS x, {q('y_km + dip_radius_km * sin(a) * sin(d)', 4)} AS y, {q('height_km + 2e0 * dip_radius_km * pow(sin(a / 2e0), 2)', 4)} AS z FROM g",
        "threads",
    ),
)
def thread_geometry(threads: DataFrame) -> DataFrame:
    """All points of all threads, from one row each: circular dips with an odd number of points."""
    along, across = curves.directions(F.col("pitch_deg"), F.col("thread_id") % 180)
    placed = threads.select("thread_id", "length_km", "dip_radius_km", "height_km", F.col("x_km").alias("anchor_x"), F.col("y_km").alias("anchor_y"), along.alias("direction_x"), across.alias("direction_y"))
    made = curves.dip_points(placed, "thread_id", 4_000.0)
    return made.select("thread_id", "k", *[r(F.col(c), 4).alias(c) for c in ("s", "x", "y", "z")])


@book.query(
    "threads",
    sql=over(
        f"SELECT thread_id, {q('(640 + 2 * (thread_id % 100)) * (0.5e0 + pitch_deg)', 4)} AS image_width_km, {q('896 * (0.5e0 + pitch_deg)', 4)} AS image_height_km, (640 + 2 * (thread_id % 100)) // 2 AS native_nx, 448::BIGINT AS native_ny, (640 + 2 * (thread_id % 100)) // 2 + (640 + 2 * (thread_id % 100)) // 2 % 2 AS video_nx FROM threads",
        "threads",
    ),
)
def field_of_view(threads: DataFrame) -> DataFrame:
    """Sizes that follow from configurations: the image in km, the detector's pixels, the even width of its video."""
    from ..sources import experiments

    values = {"nx": (640 + 2 * (F.col("thread_id") % 100)).cast("double"), "pixel_size_km": 0.5 + F.col("pitch_deg")}
    configs = threads.select("thread_id", F.map_from_arrays(F.array(*[F.lit(n) for n in values]), F.array(*values.values())).alias("overrides"))
    made = experiments.effective(configs, "thread_id", "overrides")
    return made.select("thread_id", r(F.col("image_width_km"), 4).alias("image_width_km"), r(F.col("image_height_km"), 4).alias("image_height_km"), "native_nx", "native_ny", curves.even(F.col("native_nx")).alias("video_nx"))


@book.query("orders", sql=f"SELECT o_orderkey, {q('180e0 * ' + _uniform(61, 'o_orderkey', '0') + ' - 90e0')} AS orientation_deg, CASE WHEN {_uniform(62, 'o_orderkey', '0')} < 0.5e0 THEN -1 ELSE 1 END AS chirality FROM orders")
def static_draws(orders: DataFrame) -> DataFrame:
    """What an experiment's seed decides where its configuration leaves it open."""
    angle, side = curves.drawn_orientation(F.col("o_orderkey"))
    return orders.select("o_orderkey", r(angle).alias("orientation_deg"), side.alias("chirality"))


@book.query(
    "thread_points",
    "threads",
    "frames",
    sql=over(
        f"""u AS (SELECT thread_id, frame_idx, {_AMP} AS a, {_CP} AS c, {_AZ} AS z FROM threads CROSS JOIN frames), d AS (SELECT thread_id, frame_idx, CASE WHEN frame_idx > 0 THEN a * sqrt(greatest(1e0 - c * c, 0e0)) * cos(z) ELSE 0e0 END AS dx, CASE WHEN frame_idx > 0 THEN a * c ELSE 0e0 END AS dz FROM u),
        w AS (SELECT thread_id, frame_idx, sum(dx) OVER o AS dx, sum(dz) OVER o AS dz FROM d WINDOW o AS (PARTITION BY thread_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)) """
        + f"SELECT w.frame_idx, p.thread_id, p.idx, {q('x_km + s + dx', 4)} AS x, {q('height_km + dz', 4)} AS z FROM thread_points p JOIN w USING (thread_id) WHERE w.frame_idx % 6 = 5",
        "thread_points",
        "threads",
        "frames",
    ),
)
def translated_threads(points: DataFrame, threads: DataFrame, frames: DataFrame) -> DataFrame:
    """All points of all threads in every sixth frame of their random walk."""
    walked = sequences.walk(brownian_steps(threads, frames), ["thread_id"], "frame_idx", ["dx", "dz"]).filter("frame_idx % 6 = 5")
    rows = points.select("thread_id", "idx", (F.col("x_km") + F.col("s")).alias("x"), F.col("height_km").alias("z"))
    made = curves.translated(rows, walked, "thread_id", {"x": "dx", "z": "dz"})
    return made.select("frame_idx", "thread_id", "idx", r(F.col("x"), 4).alias("x"), r(F.col("z"), 4).alias("z"))


@book.query("thread_points", sql=over(f"s AS (SELECT thread_id, idx, x_km + s AS ax, height_km + idx AS az, lead(x_km + s) OVER w AS bx, lead(height_km + idx) OVER w AS bz FROM thread_points WINDOW w AS (PARTITION BY thread_id ORDER BY idx)) SELECT thread_id, idx, {q('ax', 4)} AS a_x, {q('az', 4)} AS a_z, {q('bx', 4)} AS b_x, {q('bz', 4)} AS b_z FROM s WHERE bx IS NOT NULL", "thread_points"))
def thread_segments(points: DataFrame) -> DataFrame:
    """The segments of all threads, for masks that draw long ones."""
    rows = points.select("thread_id", "idx", (F.col("x_km") + F.col("s")).alias("x"), (F.col("height_km") + F.col("idx")).alias("z"))
    made = curves.segments(rows, ["thread_id"], "idx", ["x", "z"])
    return made.select("thread_id", "idx", *[r(F.col(c), 4).alias(c) for c in ("a_x", "a_z", "b_x", "b_z")])
