"""Queries over threads and their points: pendulum, geometry, plasma, lookups, spatial joins, ordered integrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dips, pendulum, plasma, transfer
from ..operators import lookup, quantiles, spatial
from ..operators.sizes import small
from .anchors import HEIGHTS, PRESSURES, TEMPERATURES
from .registry import Registry, r
from .relations import rounded as q
from .relations import with_relations as over

book = Registry()
G = "(274e0 * pow(696.3e6 / (696.3e6 + height_km * 1000e0), 2))"
RQ = "(1e0 / (1e0 / (dip_radius_km * 1000e0) + 1e0 / (696.3e6 + height_km * 1000e0)))"
CUT = f"(2e0 * pi() * sqrt((696.3e6 + height_km * 1000e0) / {G}))"
PERIOD = f"(2e0 * pi() * sqrt({RQ} / {G}))"


def _si() -> tuple[Column, Column]:
    """Dip radius and height in metres."""
    return F.col("dip_radius_km") * 1000.0, F.col("height_km") * 1000.0


@book.query("threads", sql=over(f"SELECT thread_id, {q(G)} AS gravity, {q(CUT)} AS cutoff_s, {q(RQ, 3)} AS equivalent_m, {q(PERIOD)} AS period_s FROM threads", "threads"))
def luna_period(threads: DataFrame) -> DataFrame:
    radius, height = _si()
    return threads.select("thread_id", r(pendulum.gravity(height)).alias("gravity"), r(pendulum.cutoff_period(height)).alias("cutoff_s"), r(pendulum.equivalent_radius(radius, height), 3).alias("equivalent_m"), r(pendulum.longitudinal_period(radius, height)).alias("period_s"))


@book.query(
    "threads",
    sql=over(
        f"radii AS (SELECT unnest([20e6, 80e6, 300e6]) AS radius), p AS (SELECT thread_id, height_km, radius, {CUT} AS cut, 2e0 * pi() * sqrt((1e0 / (1e0 / radius + 1e0 / (696.3e6 + height_km * 1000e0))) / {G}) AS p FROM threads CROSS JOIN radii) "
        f"SELECT thread_id, radius, {q('p')} AS period_s, {q('(696.3e6 + height_km * 1000e0) * pow(p / cut, 2) / (1e0 - pow(p / cut, 2)) / 1000e0', 3)} AS radius_km FROM p WHERE p < cut",
        "threads",
    ),
)
def luna_inverse_roundtrip(threads: DataFrame) -> DataFrame:
    height = F.col("height_km") * 1000.0
    asked = threads.withColumn("radius", F.explode(F.array(*[F.lit(x) for x in (20e6, 80e6, 300e6)]))).withColumn("p", pendulum.longitudinal_period(F.col("radius"), height))
    below = asked.filter(F.col("p") < pendulum.cutoff_period(height))
    return below.select("thread_id", "radius", r(F.col("p")).alias("period_s"), r(pendulum.inferred_radius(F.col("p"), height) / 1000.0, 3).alias("radius_km"))


_H = "(h * 1e6)"
_GH = f"(274e0 * pow(696.3e6 / (696.3e6 + {_H}), 2))"
_CH = f"(2e0 * pi() * sqrt((696.3e6 + {_H}) / {_GH}))"


@book.query(
    sql="WITH g AS (SELECT unnest(range(1, 101)) AS h) SELECT h AS height_mm, "
    + ", ".join(f"{q(f'2e0 * pi() * sqrt((1e0 / (1e0 / ({m} * 1e6) + 1e0 / (696.3e6 + {_H}))) / {_GH}) / 60e0')} AS period_r{m}" for m in (25, 50, 100, 200))
    + ", "
    + ", ".join(f"CASE WHEN {p} * 60e0 < {_CH} THEN {q(f'(696.3e6 + {_H}) * pow({p} * 60e0 / {_CH}, 2) / (1e0 - pow({p} * 60e0 / {_CH}, 2)) / 1e6')} END AS radius_p{p}" for p in (30, 60, 90, 120, 150))
    + " FROM g"
)
def luna_height_table(spark: SparkSession) -> DataFrame:
    heights = spark.range(1, 101).select(F.col("id").alias("height_mm"))
    h = F.col("height_mm") * 1e6
    radii, periods = (25, 50, 100, 200), (30, 60, 90, 120, 150)
    cells = heights.select("height_mm", F.explode(F.array(*[F.struct(F.lit(f"period_r{m}").alias("name"), r(pendulum.longitudinal_period(F.lit(m * 1e6), h) / 60).alias("v")) for m in radii], *[F.struct(F.lit(f"radius_p{p}").alias("name"), r(pendulum.inferred_radius(F.lit(p * 60.0), h) / 1e6).alias("v")) for p in periods])).alias("c"))
    names = [f"period_r{m}" for m in radii] + [f"radius_p{p}" for p in periods]
    return cells.select("height_mm", "c.*").groupBy("height_mm").pivot("name", names).agg(F.first("v"))


@book.query(
    "threads",
    sql=over(
        f"w AS (SELECT dip_radius_km AS radius_km, height_km, {G} AS gravity, {CUT} AS cutoff_s, {PERIOD} AS period_s FROM threads), u AS (UNPIVOT w ON radius_km, height_km, gravity, cutoff_s, period_s INTO NAME metric VALUE v) "
        f"SELECT metric, {q('min(v)')} AS low, {q('quantile_cont(v, 0.5)')} AS middle, {q('max(v)')} AS high FROM u GROUP BY metric",
        "threads",
    ),
)
def luna_summary_triplet(threads: DataFrame) -> DataFrame:
    radius, height = _si()
    wide = threads.select(F.col("dip_radius_km").alias("radius_km"), "height_km", pendulum.gravity(height).alias("gravity"), pendulum.cutoff_period(height).alias("cutoff_s"), pendulum.longitudinal_period(radius, height).alias("period_s"))
    long = wide.unpivot([], ["radius_km", "height_km", "gravity", "cutoff_s", "period_s"], "metric", "v")
    levels = quantiles.wide(quantiles.percentiles(long, ["metric"], "v", [0.0, 0.5, 1.0]), ["metric"], {"low": 0.0, "middle": 0.5, "high": 1.0})
    return levels.select("metric", *[r(F.col(c)).alias(c) for c in ("low", "middle", "high")])


def _component(amplitude: str, period: str) -> tuple[str, str]:
    q0, w = "(time_s - 1200e0)", f"(2e0 * pi() / {period})"
    e = f"exp(-{q0} / 14400e0)"
    move = f"{amplitude} * {e} * sin({w} * {q0})"
    speed = f"{amplitude} * {e} * ({w} * cos({w} * {q0}) - sin({w} * {q0}) / 14400e0)"
    return tuple(f"CASE WHEN time_s < 1200e0 THEN 0e0 ELSE {x} END" for x in (move, speed))


_LM, _LV = _component("18000e0", "p")
_TM, _TV = _component("2000e0", "1500e0")


def in_motion(threads: DataFrame, frames: DataFrame) -> DataFrame:
    """Threads at all frames of a run."""
    radius, height = _si()
    both = threads.withColumn("p", pendulum.longitudinal_period(radius, height)).crossJoin(small(frames))
    lm, lv = pendulum.damped(F.col("time_s"), F.col("p"), 18_000.0, 1_200.0, 14_400.0)
    tm, tv = pendulum.damped(F.col("time_s"), F.lit(1_500.0), 2_000.0, 1_200.0, 14_400.0)
    return both.select("*", lm.alias("lm"), lv.alias("lv"), tm.alias("tm"), tv.alias("tv"))


@book.query("threads", "frames", sql=over(f"m AS (SELECT *, {PERIOD} AS p FROM threads CROSS JOIN frames) SELECT thread_id, frame_idx, {q(_LM)} AS longitudinal_km, {q(_TM)} AS transverse_km, {q(_LV)} AS longitudinal_kms, {q(_TV)} AS transverse_kms FROM m", "threads", "frames"))
def oscillation_components(threads: DataFrame, frames: DataFrame) -> DataFrame:
    return in_motion(threads, frames).select("thread_id", "frame_idx", r(F.col("lm")).alias("longitudinal_km"), r(F.col("tm")).alias("transverse_km"), r(F.col("lv")).alias("longitudinal_kms"), r(F.col("tv")).alias("transverse_kms"))


_D = "sqrt(pow(x_km - 187500e0, 2) + pow(y_km - 187500e0, 2) + pow(height_km - 20000e0, 2))"
_W = f"exp(-ln(2e0) * pow({_D} / 60000e0, 1.1e0))"


def _distance() -> Column:
    return F.sqrt(F.pow(F.col("x_km") - 187_500.0, 2) + F.pow(F.col("y_km") - 187_500.0, 2) + F.pow(F.col("height_km") - 20_000.0, 2))


@book.query("threads", sql=over(f"SELECT thread_id, {q(_D)} AS distance_km, {q(f'CASE WHEN {_W} >= 0.05e0 THEN {_W} ELSE 0e0 END')} AS weight FROM threads", "threads"))
def local_weights(threads: DataFrame) -> DataFrame:
    return threads.select("thread_id", r(_distance()).alias("distance_km"), r(pendulum.local_weight(_distance(), 60_000.0)).alias("weight"))


_EX, _EY = "cos(radians(30e0))", "sin(radians(30e0))"


@book.query(
    "threads",
    "frames",
    sql=over(
        f"m AS (SELECT *, {PERIOD} AS p, CASE WHEN {_W} >= 0.05e0 THEN {_W} ELSE 0e0 END AS w FROM threads CROSS JOIN frames), "
        f"v AS (SELECT thread_id, frame_idx, w * (({_LV}) * cos(radians(pitch_deg)) - ({_TV}) * sin(radians(pitch_deg))) AS vx, w * (({_LV}) * sin(radians(pitch_deg)) + ({_TV}) * cos(radians(pitch_deg))) AS vy FROM m), "
        f"s AS (SELECT *, (0.8e0 - 1e0) * (vx * {_EX} + vy * {_EY}) AS shift FROM v) SELECT thread_id, frame_idx, {q(f'vx + shift * {_EX}')} AS vx, {q(f'vy + shift * {_EY}')} AS vy FROM s WHERE frame_idx > 0",
        "threads",
        "frames",
    ),
)
def coherent_velocity(threads: DataFrame, frames: DataFrame) -> DataFrame:
    c, s = F.cos(F.radians("pitch_deg")), F.sin(F.radians("pitch_deg"))
    w = pendulum.local_weight(_distance(), 60_000.0)
    moving = in_motion(threads, frames).filter("frame_idx > 0").select("thread_id", "frame_idx", (w * (F.col("lv") * c - F.col("tv") * s)).alias("x"), (w * (F.col("lv") * s + F.col("tv") * c)).alias("y"))
    vx, vy = transfer.project_vector(F.col("x"), F.col("y"), F.lit(0.0), 0.8, 30.0)
    return moving.select("thread_id", "frame_idx", r(vx).alias("vx"), r(vy).alias("vy"))


_HALF = "(length_km / (2e0 * dip_radius_km))"


@book.query("threads", sql=over(f"SELECT thread_id, {q(f'2e0 * dip_radius_km * pow(sin({_HALF} / 2e0), 2)')} AS depth_km, {q(_HALF, 9)} AS half_angle, {q(f'2e0 * dip_radius_km * sin({_HALF})')} AS chord_km, length_km <= pi() * dip_radius_km AS fits FROM threads", "threads"))
def dip_geometry(threads: DataFrame) -> DataFrame:
    length, radius = F.col("length_km"), F.col("dip_radius_km")
    return threads.select("thread_id", r(dips.depth(length, radius)).alias("depth_km"), r(dips.half_angle(length, radius), 9).alias("half_angle"), r(dips.chord(length, radius)).alias("chord_km"), dips.fits(length, radius).alias("fits"))


_ANGLE = f"({_HALF} * (2e0 * k / 24e0 - 1e0))"


@book.query("threads", sql=over(f"e AS (SELECT *, unnest(range(25)) AS k FROM threads) SELECT thread_id, k::INT AS k, {q(f'x_km + dip_radius_km * sin({_ANGLE}) * cos(radians(pitch_deg))')} AS x, {q(f'y_km + dip_radius_km * sin({_ANGLE}) * sin(radians(pitch_deg))')} AS y, {q(f'height_km + 2e0 * dip_radius_km * pow(sin({_ANGLE} / 2e0), 2)')} AS z, {q(f'dip_radius_km * ({_ANGLE} + {_HALF})')} AS s FROM e", "threads"))
def dip_centerline(threads: DataFrame) -> DataFrame:
    points = threads.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24))))
    along, z, s = dips.arc_points(F.col("length_km"), F.col("dip_radius_km"), F.col("height_km"), F.col("k") / 24.0)
    return points.select("thread_id", "k", r(F.col("x_km") + along * F.cos(F.radians("pitch_deg"))).alias("x"), r(F.col("y_km") + along * F.sin(F.radians("pitch_deg"))).alias("y"), r(z).alias("z"), r(s).alias("s"))


_LEAN = "(sqrt(1e0 - 0.8e0 * 0.8e0) / 0.8e0)"


@book.query(
    "thread_points",
    sql=over(
        f"p AS (SELECT thread_id, idx, x_km + s + height_km * ({_LEAN} * {_EX}) AS px, y_km + height_km * ({_LEAN} * {_EY}) AS py FROM thread_points), a AS (SELECT *, (px - 187500e0) * {_EX} + (py - 187500e0) * {_EY} AS along FROM p) "
        f"SELECT thread_id, idx, {q(f'px + (0.8e0 - 1e0) * along * {_EX}')} AS x, {q(f'py + (0.8e0 - 1e0) * along * {_EY}')} AS y FROM a",
        "thread_points",
    ),
)
def projected_points(points: DataFrame) -> DataFrame:
    x, y = transfer.project(F.col("x_km") + F.col("s"), F.col("y_km"), F.col("height_km"), 0.8, 30.0, 375_000.0, 375_000.0)
    return points.select("thread_id", "idx", r(x).alias("x"), r(y).alias("y"))


_XI = "least(greatest(abs(s - length_km / 2e0) / greatest(length_km / 2e0, 1e0), 0e0), 1e0)"
_T = f"(7000e0 + 93000e0 * pow({_XI}, 2e0))"
_I = f"(1e0 - 0.7e0 * pow(least(greatest((100000e0 - {_T}) / 93000e0, 0e0), 1e0), 2))"


def _xi() -> Column:
    return dips.xi(F.col("s"), F.col("length_km"))


def _temperature() -> Column:
    return plasma.temperature(_xi(), 7_000.0, 100_000.0, 2.0)


@book.query("thread_points", sql=over(f"SELECT thread_id, idx, {q(f'radius_km * (0.4e0 + 0.6e0 * sqrt(1e0 - pow({_XI}, 2)))')} AS radius_km FROM thread_points", "thread_points"))
def radius_taper(points: DataFrame) -> DataFrame:
    return points.select("thread_id", "idx", r(dips.tapered_radius(F.col("radius_km"), _xi(), 0.4)).alias("radius_km"))


@book.query("thread_points", sql=over(f"SELECT thread_id, idx, {q(_T)} AS temperature_k FROM thread_points", "thread_points"))
def temperature_profile(points: DataFrame) -> DataFrame:
    return points.select("thread_id", "idx", r(_temperature()).alias("temperature_k"))


@book.query("thread_points", sql=over(f"SELECT thread_id, idx, {q(_I)} AS ionization, {q(f'1.4e0 / (1.1e0 + {_I})')} AS mean_mass FROM thread_points", "thread_points"))
def ionization_degree(points: DataFrame) -> DataFrame:
    ionized = plasma.ionization(_temperature(), 7_000.0, 100_000.0, 0.3)
    return points.select("thread_id", "idx", r(ionized).alias("ionization"), r(plasma.mean_mass(ionized)).alias("mean_mass"))


def _step(t: str) -> str:
    t = f"least(greatest({t}, 0e0), 1e0)"
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


_RAMP = "greatest(0.1e0 * length_km, 1e0)"


@book.query("thread_points", sql=over(f"SELECT thread_id, idx, {q(_step(f's / {_RAMP}') + ' * ' + _step(f'(length_km - s) / {_RAMP}'))} AS envelope FROM thread_points", "thread_points"))
def foot_envelope(points: DataFrame) -> DataFrame:
    return points.select("thread_id", "idx", r(dips.foot_envelope(F.col("s"), F.col("length_km"), 0.1)).alias("envelope"))


_DIL = lambda h: f"(0.5e0 * (1e0 - sqrt(1e0 - pow(695508e0 / (695508e0 + {h}), 2))))"


@book.query(
    "threads",
    sql=over(
        f"m AS (SELECT thread_id % 16 AS grp, avg(height_km * (thread_id % 16 + 1) / 16e0) AS h FROM threads GROUP BY 1) SELECT grp, {q('h')} AS height_km, "
        + q(
            f"CASE WHEN h < 10000e0 THEN 3.22e0 / 6.93e0 * {_DIL('h')} / {_DIL('10000e0')} WHEN h <= 20000e0 THEN 3.22e0 / 6.93e0 + (2.98e0 / 6.93e0 - 3.22e0 / 6.93e0) * (h - 10000e0) / 10000e0 "
            f"WHEN h <= 30000e0 THEN 2.98e0 / 6.93e0 + (2.80e0 / 6.93e0 - 2.98e0 / 6.93e0) * (h - 20000e0) / 10000e0 ELSE 2.80e0 / 6.93e0 * {_DIL('h')} / {_DIL('30000e0')} END"
        )
        + " AS fraction FROM m",
        "threads",
    ),
)
def source_fraction(threads: DataFrame) -> DataFrame:
    grp = F.col("thread_id") % 16
    means = threads.groupBy(grp.alias("grp")).agg(F.avg(F.col("height_km") * (grp + 1) / 16.0).alias("h"))
    return means.select("grp", r(F.col("h")).alias("height_km"), r(plasma.source_fraction(F.col("h"))).alias("fraction"))


@book.query(
    "knots",
    "spine_queries",
    sql=over(
        "k AS (SELECT spine_id, s, v, lead(s) OVER w AS s1, lead(v) OVER w AS v1, row_number() OVER w AS n FROM knots WINDOW w AS (PARTITION BY spine_id ORDER BY s)) "
        f"SELECT q.query_id, {q('CASE WHEN f.s IS NULL THEN (SELECT arg_min(v, s) FROM knots z WHERE z.spine_id = q.spine_id) WHEN f.s1 IS NULL THEN f.v ELSE f.v + (f.v1 - f.v) * (q.s - f.s) / (f.s1 - f.s) END')} AS v "
        "FROM spine_queries q ASOF LEFT JOIN k f ON q.spine_id = f.spine_id AND q.s >= f.s",
        "knots",
        "spine_queries",
    ),
)
def spine_interp(knots: DataFrame, queries: DataFrame) -> DataFrame:
    return lookup.interpolate(queries, knots, ["spine_id"], "s", ["v"]).select("query_id", r(F.col("v")).alias("v"))


GRID_HEIGHTS = [float(1000 * h) for h in range(1, 101)]
AXES = {"height": GRID_HEIGHTS, "temperature": [float(t) for t in TEMPERATURES], "press": [float(p) for p in PRESSURES]}


def opacity_grid(anchors: DataFrame) -> DataFrame:
    """The full grid of heights (km): anchors interpolated linearly in the logarithm, held beyond 10 and 30 Mm."""
    spark = anchors.sparkSession
    known = anchors.select("temperature_k", "pressure", F.col("height_mm").cast("double").alias("h"), F.log("i_value").alias("i"), F.log("f_value").alias("f"))
    asked = anchors.filter(f"height_mm = {HEIGHTS[0]}").select("temperature_k", "pressure").crossJoin(F.broadcast(spark.range(1, 101).select(F.col("id").cast("double").alias("h"))))
    full = lookup.interpolate(asked, known, ["temperature_k", "pressure"], "h", ["i", "f"])
    return full.select((F.col("h") * 1000).alias("height"), F.col("temperature_k").cast("double").alias("temperature"), F.col("pressure").alias("press"), F.exp("i").alias("ion"), F.exp("f").alias("pop"))


GRID_SQL = """grid AS (
  SELECT h.h * 1000e0 AS height, a.temperature_k::DOUBLE AS temperature, a.pressure AS press,
         exp(CASE WHEN h.h <= 10 THEN ln(a.i_value) WHEN h.h <= 20 THEN ln(a.i_value) + (ln(b.i_value) - ln(a.i_value)) * (h.h - 10e0) / 10e0 WHEN h.h <= 30 THEN ln(b.i_value) + (ln(c.i_value) - ln(b.i_value)) * (h.h - 20e0) / 10e0 ELSE ln(c.i_value) END) AS ion,
         exp(CASE WHEN h.h <= 10 THEN ln(a.f_value) WHEN h.h <= 20 THEN ln(a.f_value) + (ln(b.f_value) - ln(a.f_value)) * (h.h - 10e0) / 10e0 WHEN h.h <= 30 THEN ln(b.f_value) + (ln(c.f_value) - ln(b.f_value)) * (h.h - 20e0) / 10e0 ELSE ln(c.f_value) END) AS pop
  FROM (SELECT * FROM anchors WHERE height_mm = 10) a JOIN (SELECT * FROM anchors WHERE height_mm = 20) b USING (temperature_k, pressure)
  JOIN (SELECT * FROM anchors WHERE height_mm = 30) c USING (temperature_k, pressure) CROSS JOIN (SELECT unnest(range(1, 101)) AS h) h),
ax AS (SELECT 'height' AS name, [h * 1000e0 FOR h IN range(1, 101)] AS p UNION ALL SELECT 'temperature', [6000e0, 8000e0, 10000e0, 12000e0, 14000e0] UNION ALL SELECT 'press', [0.01e0, 0.02e0, 0.05e0, 0.1e0, 0.2e0])"""


def _clip_sql(value: str, axis: str) -> str:
    return f"least(greatest({value}, (SELECT p[1] FROM ax WHERE name = '{axis}')), (SELECT p[-1] FROM ax WHERE name = '{axis}'))"


_PRESS = "(0.005e0 + 0.3e0 * idx / 24e0)"
_QUERY_SQL = f"u AS (SELECT thread_id, idx, {_clip_sql('height_km * 1.02e0', 'height')} AS h, {_clip_sql(_T, 'temperature')} AS t, {_clip_sql(_PRESS, 'press')} AS p FROM thread_points)"

_CELLS = f"""v AS (SELECT *, (SELECT p FROM ax WHERE name = 'height') AS ha, (SELECT p FROM ax WHERE name = 'temperature') AS ta, (SELECT p FROM ax WHERE name = 'press') AS pa FROM u),
w AS (SELECT *, least(floor(h / 1000e0)::INT, 99) AS hi, least(len(list_filter(ta, lambda x: x <= t)), 4)::INT AS ti, least(len(list_filter(pa, lambda x: x <= p)), 4)::INT AS pi FROM v),
c AS (SELECT w.thread_id, w.idx, k, ha[hi + (k & 1)] AS gh, ta[ti + ((k >> 1) & 1)] AS gt, pa[pi + ((k >> 2) & 1)] AS gp,
  (CASE WHEN k & 1 = 1 THEN (h - ha[hi]) / (ha[hi + 1] - ha[hi]) ELSE 1e0 - (h - ha[hi]) / (ha[hi + 1] - ha[hi]) END)
  * (CASE WHEN (k >> 1) & 1 = 1 THEN (t - ta[ti]) / (ta[ti + 1] - ta[ti]) ELSE 1e0 - (t - ta[ti]) / (ta[ti + 1] - ta[ti]) END)
  * (CASE WHEN (k >> 2) & 1 = 1 THEN (p - pa[pi]) / (pa[pi + 1] - pa[pi]) ELSE 1e0 - (p - pa[pi]) / (pa[pi + 1] - pa[pi]) END) AS wt
  FROM w CROSS JOIN (SELECT unnest(range(8)) AS k)),
o AS (SELECT c.thread_id, c.idx, sum(wt * ion) AS ion, sum(wt * pop) AS pop FROM c JOIN grid g ON g.height = gh AND g.temperature = gt AND g.press = gp GROUP BY 1, 2)"""


def _asked(points: DataFrame) -> tuple[DataFrame, dict]:
    asked = points.select("thread_id", "idx", "length_km", "dip_radius_km", "radius_km", (F.col("height_km") * 1.02).alias("qh"), _temperature().alias("qt"), (0.005 + 0.3 * F.col("idx") / 24.0).alias("qp"), _xi().alias("at"))
    return asked, {"height": (F.col("qh"), GRID_HEIGHTS), "temperature": (F.col("qt"), AXES["temperature"]), "press": (F.col("qp"), AXES["press"])}


@book.query("thread_points", "anchors", sql=over(f"{GRID_SQL}, {_QUERY_SQL}, {_CELLS} SELECT thread_id, idx, {q('ion')} AS ionization, {q('pop')} AS population FROM o", "thread_points", "anchors"))
def opacity_trilinear(points: DataFrame, anchors: DataFrame) -> DataFrame:
    asked, axes = _asked(points)
    return lookup.trilinear(asked, opacity_grid(anchors), axes, ["ion", "pop"]).select("thread_id", "idx", r(F.col("ion")).alias("ionization"), r(F.col("pop")).alias("population"))


@book.query(
    "thread_points",
    sql=over(
        f"s AS (SELECT thread_id, {_T} AS t, height_km * 1.02e0 AS h, {_PRESS} AS p FROM thread_points), f AS (SELECT thread_id, unnest([struct_pack(name := 'height_low', b := h < 1000), struct_pack(name := 'height_high', b := h > 100000), struct_pack(name := 'temperature_low', b := t < 6000), "
        "struct_pack(name := 'temperature_high', b := t > 14000), struct_pack(name := 'press_low', b := p < 0.01), struct_pack(name := 'press_high', b := p > 0.2)]) AS x FROM s), g AS (SELECT x.name AS axis, thread_id, count_if(x.b) AS n FROM f GROUP BY ALL) "
        "SELECT axis, sum(n)::BIGINT AS points, count_if(n > 0) AS threads FROM g GROUP BY axis",
        "thread_points",
    ),
)
def opacity_saturation(points: DataFrame) -> DataFrame:
    asked, axes = _asked(points)
    flags = lookup.saturation(axes)
    counts = asked.groupBy("thread_id").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    return counts.unpivot(["thread_id"], list(flags), "axis", "n").groupBy("axis").agg(F.sum("n").alias("points"), F.count_if(F.col("n") > 0).alias("threads"))


_KAPPA = (
    "CASE WHEN t BETWEEN 6000e0 AND 14000e0 THEN 1.7e-2 * pow(p / (1.380649e-16 * t * (1e0 + 1.1e0 / greatest(ion, 1e-6))), 2) / (pop * 1e16) "
    "/ (sqrt(pi()) * ((2.99792458e10 / (6562.8e0 * 1e-8)) / 2.99792458e10 * sqrt(2e0 * 1.380649e-16 / 1.6726e-24 * t + pow(5e5, 2)))) ELSE 0e0 END"
)


@book.query(
    "thread_points",
    "anchors",
    sql=over(
        f"{GRID_SQL}, {_QUERY_SQL}, {_CELLS}, z AS (SELECT tp.thread_id, tp.idx, {_T} AS t, {_PRESS} AS p, tp.radius_km * (0.4e0 + 0.6e0 * sqrt(1e0 - pow({_XI}, 2))) AS rad, {_XI} AS xi FROM thread_points tp), "
        f"y AS (SELECT z.*, {_KAPPA} AS kappa FROM z JOIN o USING (thread_id, idx)), "
        "e AS (SELECT y.thread_id, min({'xi': xi, 'idx': idx, 'kappa': kappa, 'rad': rad}) AS dip, max({'kappa': kappa, 'idx': -idx, 'rad': rad}) AS top, count_if(kappa > 0) AS positive FROM y GROUP BY 1) "
        f"SELECT thread_id, {q('CASE WHEN dip.kappa > 0 THEN dip.kappa * 2e0 * dip.rad * 1e5 ELSE top.kappa * 2e0 * top.rad * 1e5 END')} AS tau, positive, dip.kappa > 0 AS at_dip FROM e",
        "thread_points",
        "anchors",
    ),
)
def line_opacity(points: DataFrame, anchors: DataFrame) -> DataFrame:
    asked, axes = _asked(points)
    found = lookup.trilinear(asked, opacity_grid(anchors), axes, ["ion", "pop"])
    kappa = F.when(F.col("qt").between(6_000.0, 14_000.0), plasma.line_opacity(F.col("qp"), F.col("qt"), F.col("ion"), F.col("pop") * 1e16)).otherwise(0.0)
    rated = found.withColumn("kappa", kappa).withColumn("rad", dips.tapered_radius(F.col("radius_km"), F.col("at"), 0.4))
    ends = rated.groupBy("thread_id").agg(F.min(F.struct("at", "idx", "kappa", "rad")).alias("dip"), F.max(F.struct("kappa", (-F.col("idx")).alias("o"), "rad")).alias("top"), F.count_if(F.col("kappa") > 0).alias("positive"))
    at_dip = F.col("dip.kappa") > 0
    tau = F.when(at_dip, F.col("dip.kappa") * 2 * F.col("dip.rad")).otherwise(F.col("top.kappa") * 2 * F.col("top.rad")) * 1e5
    return ends.select("thread_id", r(tau).alias("tau"), "positive", at_dip.alias("at_dip"))


RADIUS = 12_000.0


def _point_segment(p: tuple, o: tuple, e: tuple) -> str:
    fix = lambda t, c: f"{t[0]}.{t[1]}{c}".replace("by", "by_")
    P, O, E = ([fix(t, c) for c in "xyz"] for t in (p, o, e))
    d = [f"({b} - {a})" for a, b in zip(O, E, strict=True)]
    off = [f"({a} - {b})" for a, b in zip(P, O, strict=True)]
    dd, od = " + ".join(f"{x} * {x}" for x in d), " + ".join(f"{x} * {y}" for x, y in zip(off, d, strict=True))
    t = f"least(greatest(({od}) / ({dd}), 0e0), 1e0)"
    return "(" + " + ".join(f"pow({x} - {t} * {y}, 2)" for x, y in zip(off, d, strict=True)) + ")"


_ENDS = ", ".join(_point_segment(*x) for x in ((("l", "a"), ("m", "a"), ("m", "b")), (("l", "b"), ("m", "a"), ("m", "b")), (("m", "a"), ("l", "a"), ("l", "b")), (("m", "b"), ("l", "a"), ("l", "b"))))


@book.query(
    "segments",
    sql=over(
        f"""j AS (SELECT l.thread_id, l.ax, l.ay, l.az, least({_ENDS}) AS ends, l.bx - l.ax AS ux, l.by_ - l.ay AS uy, l.bz - l.az AS uz, m.bx - m.ax AS vx, m.by_ - m.ay AS vy, m.bz - m.az AS vz, l.ax - m.ax AS wx, l.ay - m.ay AS wy, l.az - m.az AS wz
        FROM segments l JOIN segments m ON l.thread_id <> m.thread_id AND abs(l.ax - m.ax) < 30000 AND abs(l.ay - m.ay) < 30000 AND abs(l.az - m.az) < 30000),
        n AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM j),
        t AS (SELECT *, nx * nx + ny * ny + nz * nz AS nn, (vy * wz - vz * wy) * nx + (vz * wx - vx * wz) * ny + (vx * wy - vy * wx) * nz AS sn, (uy * wz - uz * wy) * nx + (uz * wx - ux * wz) * ny + (ux * wy - uy * wx) * nz AS tn FROM n),
        i AS (SELECT thread_id, CASE WHEN nn > 4.93e-32 * (ux*ux+uy*uy+uz*uz) * (vx*vx+vy*vy+vz*vz) AND sn / nn BETWEEN 0 AND 1 AND tn / nn BETWEEN 0 AND 1
          THEN least(ends, pow(wx + sn/nn*ux - tn/nn*vx, 2) + pow(wy + sn/nn*uy - tn/nn*vy, 2) + pow(wz + sn/nn*uz - tn/nn*vz, 2)) ELSE ends END AS d2 FROM t)
        SELECT thread_id, {q('sqrt(min(d2))', 3)} AS distance_km, count(*) AS neighbours FROM i WHERE sqrt(d2) <= 12000 GROUP BY 1""",
        "segments",
    ),
)
def segment_min_distance(segments: DataFrame) -> DataFrame:
    """Segments are at most 6.1 Mm long, so their middles lie within the radius plus that of each other."""
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    left = segments.select("*", mid("ax", "bx").alias("mx"), mid("ay", "by_").alias("my"), mid("az", "bz").alias("mz"))
    right = left.toDF(*[f"o_{c}" for c in left.columns])
    apart = sum((F.col(f"m{c}") - F.col(f"o_m{c}")) * (F.col(f"m{c}") - F.col(f"o_m{c}")) for c in "xyz")
    # Of the pairs of neighbouring cells a sixth has middles that near, and only those are measured.
    pairs = spatial.near_pairs(left, right, ["mx", "my", "mz"], ["o_mx", "o_my", "o_mz"], RADIUS + 6_100.0).filter((F.col("thread_id") != F.col("o_thread_id")) & (apart <= (RADIUS + 6_101.0) ** 2))
    ends = [tuple(F.col(n) for n in names) for names in (("ax", "ay", "az"), ("bx", "by_", "bz"), ("o_ax", "o_ay", "o_az"), ("o_bx", "o_by_", "o_bz"))]
    near = F.when(F.col("gap") <= RADIUS, F.col("gap"))
    # Conditions inside the aggregates: a filter would carry the distance's formula into the join, spelt out many times.
    counted = spatial.with_segment_distance(pairs, *ends, name="gap").groupBy("thread_id").agg(F.min(near).alias("d"), F.count(near).alias("neighbours"))
    return counted.filter("neighbours > 0").select("thread_id", r(F.col("d"), 3).alias("distance_km"), "neighbours")


@book.query("probes", sql=over(f"j AS (SELECT a.thread_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM probes a JOIN probes b ON a.thread_id <> b.thread_id AND abs(a.x - b.x) <= 15000) SELECT thread_id, {q('min(d)')} AS distance_km FROM j WHERE d <= 15000 GROUP BY 1", "probes"))
def probe_min_distance(probes: DataFrame) -> DataFrame:
    found = spatial.nearest_other(probes, "thread_id", ["x", "y", "z"], 15_000.0)
    return found.select("thread_id", r(F.col("gap")).alias("distance_km"))


@book.query("crops", "detections", sql=over("SELECT c.crop_id FROM crops c WHERE NOT EXISTS (SELECT 1 FROM detections d WHERE d.x0 - 0.1e0 * (d.x1 - d.x0) - 2e0 < c.x1 AND d.x1 + 0.1e0 * (d.x1 - d.x0) + 2e0 > c.x0 AND d.y0 - 0.1e0 * (d.y1 - d.y0) - 2e0 < c.y1 AND d.y1 + 0.1e0 * (d.y1 - d.y0) + 2e0 > c.y0)", "crops", "detections"))
def box_overlap_reject(crops: DataFrame, detections: DataFrame) -> DataFrame:
    return spatial.overlapping(crops, detections, 128.0, "left_anti", 0.1, 2.0).select("crop_id")


@book.query("threads", "frames", sql=over("c AS (SELECT frame_idx, 375000e0 * frame_idx / 24e0 AS place FROM frames) SELECT frame_idx, min({'gap': abs(x_km - place), 'id': thread_id}).id AS thread_id, " + q("min({'gap': abs(x_km - place), 'id': thread_id}).gap") + " AS gap FROM c CROSS JOIN threads GROUP BY 1", "threads", "frames"))
def nearest_site(threads: DataFrame, frames: DataFrame) -> DataFrame:
    sites = frames.select("frame_idx", (375_000.0 * F.col("frame_idx") / 24.0).alias("at"))
    found = spatial.nearest(sites, threads, "frame_idx", "at", "x_km", "thread_id")
    return found.select("frame_idx", "thread_id", r(F.col("gap")).alias("gap"))


_KNN = (
    "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))), 6) AS d "
    "FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, d FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 5"
)


@book.query("embeddings", sql=_KNN)
def embedding_knn(vectors: DataFrame) -> DataFrame:
    """Five nearest vectors of the stated query set (ids divisible by 50), against all rows in blocks."""
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return spatial.nearest_vectors(asked, vectors, "query_id", "vec_id", "embedding", 5)
