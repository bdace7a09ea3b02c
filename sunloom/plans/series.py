"""Queries over ordered series: windows of regular ticks, integrals, hydrostatic columns, walks, periodograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dips, plasma
from ..operators import analysis, sequences
from ..operators.sizes import small
from .registry import Registry, r
from .relations import group_of
from .relations import rounded as q
from .relations import with_relations as over

book = Registry()
#: Groups of ticks.
EIGHTHS, TENTHS = group_of("idx", 8), group_of("idx", 10)


@book.query(
    "ticks",
    sql=over(
        f"b AS (SELECT {EIGHTHS} AS grp, idx, t, coalesce(abs(t - lag(t) OVER (PARTITION BY {EIGHTHS} ORDER BY t) - 480e0) > 1e-6, true)::INT AS cut FROM ticks), i AS (SELECT *, sum(cut) OVER (PARTITION BY grp ORDER BY t) AS island FROM b), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY grp, island ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY grp, island) AS size FROM i) SELECT grp, idx, t, island::BIGINT AS island, k FROM n WHERE k % 2 = 0 AND k + 2 <= size",
        "ticks",
    ),
)
def regular_windows(ticks: DataFrame) -> DataFrame:
    grouped = ticks.select(F.expr(EIGHTHS).alias("grp"), "idx", "t")
    return sequences.regular_windows(grouped, ["grp"], "t", 2, 480.0).withColumn("k", F.col("k").cast("long"))


_TW = "CASE WHEN l IS NULL AND n IS NULL THEN 1e0 ELSE (coalesce(s - l, 0e0) + coalesce(n - s, 0e0)) / 2e0 END"
_WEIGHTED = "w AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS n FROM thread_points WINDOW w AS (PARTITION BY thread_id ORDER BY idx))"


@book.query("thread_points", sql=over(f"{_WEIGHTED} SELECT thread_id, idx, {q(_TW)} AS weight FROM w", "thread_points"))
def trapezoid_weights(points: DataFrame) -> DataFrame:
    return points.select("thread_id", "idx", r(sequences.trapezoid_weight(["thread_id"], "s").cast("double")).alias("weight"))


_TAU = "CASE WHEN thread_id % 5 = 0 THEN 0e0 ELSE greatest(1e0 - abs(2e0 * idx / 24e0 - 1e0), 0e0) END"


@book.query("thread_points", sql=over(f"{_WEIGHTED}, v AS (SELECT thread_id, x_km + s AS x, height_km + abs(idx - 12) * 100e0 AS z, {_TW} AS w, {_TAU} AS tau FROM w) SELECT thread_id, {q('CASE WHEN sum(w * tau) > 0 THEN sum(w * tau * x) / sum(w * tau) ELSE sum(w * x) / sum(w) END')} AS x, {q('CASE WHEN sum(w * tau) > 0 THEN sum(w * tau * z) / sum(w * tau) ELSE sum(w * z) / sum(w) END')} AS z FROM v GROUP BY 1", "thread_points"))
def material_centroid(points: DataFrame) -> DataFrame:
    tau = F.when(F.col("thread_id") % 5 == 0, 0.0).otherwise(F.greatest(1 - F.abs(2.0 * F.col("idx") / 24.0 - 1), F.lit(0.0)))
    rows = points.select("thread_id", (F.col("x_km") + F.col("s")).alias("x"), (F.col("height_km") + F.abs(F.col("idx") - 12) * 100.0).alias("z"), sequences.trapezoid_weight(["thread_id"], "s").alias("w"), tau.alias("tau"))
    mean = lambda c: F.when(F.sum(F.col("w") * F.col("tau")) > 0, F.try_divide(F.sum(F.col("w") * F.col("tau") * F.col(c)), F.sum(F.col("w") * F.col("tau")))).otherwise(F.sum(F.col("w") * F.col(c)) / F.sum("w"))
    return rows.groupBy("thread_id").agg(r(mean("x")).alias("x"), r(mean("z")).alias("z"))


def _simpson_sql(source: str, by: str, at: str, value: str, s: str) -> str:
    """CTEs p (with the steps' neighbours) and ``{source}_cum`` (with integral), for the rule of ``simpson_steps``."""
    par = lambda h1, h2, y1, y2, y3: f"({h1}) / 6e0 * ({y1} * (3e0 - ({h1}) / (({h1}) + ({h2}))) + {y2} * (3e0 + ({h1}) * ({h1}) / (({h2}) * (({h1}) + ({h2}))) + ({h1}) / (({h1}) + ({h2}))) - {y3} * ({h1}) * ({h1}) / (({h2}) * (({h1}) + ({h2}))))"
    ahead, behind = par("x0 - xa", "xn - x0", "va", "v0", "vn"), par("x0 - xa", "xa - xb", "v0", "va", "vb")
    return (
        f"{source}_nb AS (SELECT *, row_number() OVER w AS rn, {s} AS x0, {value} AS v0, lag({s}) OVER w AS xa, lag({s}, 2) OVER w AS xb, lead({s}) OVER w AS xn, lag({value}) OVER w AS va, lag({value}, 2) OVER w AS vb, lead({value}) OVER w AS vn FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY {at})), "
        f"{source}_st AS (SELECT *, CASE WHEN rn = 1 THEN 0e0 WHEN rn % 2 = 0 AND xn IS NOT NULL THEN {ahead} WHEN xb IS NOT NULL THEN {behind} ELSE (x0 - xa) * (v0 + va) / 2e0 END AS step FROM {source}_nb), "
        f"{source}_cum AS (SELECT *, sum(step) OVER (PARTITION BY {by} ORDER BY {at} ROWS UNBOUNDED PRECEDING) AS integral FROM {source}_st)"
    )


@book.query("thread_points", sql=over("a AS (SELECT thread_id, idx, s + 20e0 * sin(idx) AS u, cos(idx / 5e0) + radius_km / 100e0 AS y FROM thread_points), " + _simpson_sql("a", "thread_id", "idx", "y", "u") + f" SELECT thread_id, idx, {q('integral', 5)} AS integral FROM a_cum", "thread_points"))
def cumulative_integral(points: DataFrame) -> DataFrame:
    rows = points.select("thread_id", "idx", (F.col("s") + 20.0 * F.sin("idx")).alias("u"), (F.cos(F.col("idx") / 5.0) + F.col("radius_km") / 100.0).alias("y"))
    return sequences.cumulative_integral(rows, ["thread_id"], "idx", "y", "u").select("thread_id", "idx", r(F.col("integral"), 5).alias("integral"))


_A = "(s / dip_radius_km - length_km / (2e0 * dip_radius_km))"
_X = "least(greatest(abs(s - length_km / 2e0) / greatest(length_km / 2e0, 1e0), 0e0), 1e0)"
_TT = f"(7000e0 + 93000e0 * pow({_X}, 2e0))"
_II = f"(1e0 - 0.7e0 * pow(least(greatest((100000e0 - {_TT}) / 93000e0, 0e0), 1e0), 2))"


@book.query(
    "thread_points",
    sql=over(
        f"h AS (SELECT thread_id, idx, s, height_km + 2e0 * dip_radius_km * pow(sin({_A} / 2e0), 2) AS z, abs(sin({_A})) * (1.4e0 / (1.1e0 + {_II})) * (1.6726e-24 * 2.74e4 * 1e5 / 1.380649e-16) / {_TT} AS rate FROM thread_points), "
        "lo AS (SELECT thread_id, min({'z': z, 'i': idx}).i AS low FROM h GROUP BY 1), side AS (SELECT h.thread_id, h.idx, 0 AS sd, idx::DOUBLE AS o, s AS u, rate, low FROM h JOIN lo USING (thread_id) WHERE idx <= low UNION ALL SELECT h.thread_id, h.idx, 1, -idx::DOUBLE, -s, rate, low FROM h JOIN lo USING (thread_id) WHERE idx >= low), "
        + _simpson_sql("side", "thread_id, sd", "o", "rate", "u")
        + ", pr AS (SELECT *, 0.015e0 * exp(integral) AS p FROM side_cum), ce AS (SELECT *, max(CASE WHEN idx = low THEN p END) OVER (PARTITION BY thread_id, sd) AS c FROM pr), le AS (SELECT *, min(c) OVER (PARTITION BY thread_id) AS m FROM ce) "
        f"SELECT thread_id, idx, {q('ln(p * m / c)')} AS log_pressure FROM le WHERE sd = 1 OR idx < low",
        "thread_points",
    ),
)
def hydrostatic_pressure(points: DataFrame) -> DataFrame:
    angle = F.col("s") / F.col("dip_radius_km") - dips.half_angle(F.col("length_km"), F.col("dip_radius_km"))
    temp = plasma.temperature(dips.xi(F.col("s"), F.col("length_km")), 7_000.0, 100_000.0, 2.0)
    mass = plasma.mean_mass(plasma.ionization(temp, 7_000.0, 100_000.0, 0.3))
    rows = points.select("thread_id", "idx", "s", (F.col("height_km") + 2 * F.col("dip_radius_km") * F.pow(F.sin(angle / 2), 2)).alias("z"), F.abs(F.sin(angle)).alias("slope"), plasma.pressure_scale(mass, temp).alias("scale"))
    return sequences.hydrostatic(rows, ["thread_id"], "idx", 0.015).select("thread_id", "idx", r(F.log("pressure")).alias("log_pressure"))


def _uniform(stream: int, *keys: str) -> str:
    m = f"({stream * 7919 + 17}::BIGINT)"
    for key in keys or ("thread_id", "frame_idx"):
        m = f"((({m} * 48271 + {key} * 69621 + 11) % 2147483647) * 16807 + 7) % 2147483647"
        m = f"({m})"
    return f"({m} / 2147483647e0)"


_AMP = f"(200e0 + 300e0 * {_uniform(1)})"
_CP, _AZ = f"(2e0 * {_uniform(2)} - 1e0)", f"(2e0 * pi() * {_uniform(3)})"


def brownian_steps(threads: DataFrame, frames: DataFrame) -> DataFrame:
    """One isotropic step per thread and frame from 1 on, of a length between 200 and 500 km."""
    both = threads.select("thread_id").crossJoin(small(frames.select("frame_idx")))
    u = [sequences.counter_uniform(F.col("thread_id"), F.col("frame_idx"), stream=k) for k in (1, 2, 3)]
    size, polar, azimuth = 200.0 + 300.0 * u[0], 2.0 * u[1] - 1.0, 2.0 * F.pi() * u[2]
    flat = F.sqrt(F.greatest(1 - polar * polar, F.lit(0.0)))
    moving = F.col("frame_idx") > 0
    step = lambda c: F.when(moving, c).otherwise(0.0)
    return both.select("thread_id", "frame_idx", step(size * flat * F.cos(azimuth)).alias("dx"), step(size * flat * F.sin(azimuth)).alias("dy"), step(size * polar).alias("dz"))


@book.query(
    "threads",
    "frames",
    sql=over(
        f"u AS (SELECT thread_id, frame_idx, {_AMP} AS a, {_CP} AS c, {_AZ} AS z FROM threads CROSS JOIN frames), d AS (SELECT thread_id, frame_idx, CASE WHEN frame_idx > 0 THEN a * sqrt(greatest(1e0 - c * c, 0e0)) * cos(z) ELSE 0e0 END AS dx, CASE WHEN frame_idx > 0 THEN a * sqrt(greatest(1e0 - c * c, 0e0)) * sin(z) ELSE 0e0 END AS dy, CASE WHEN frame_idx > 0 THEN a * c ELSE 0e0 END AS dz FROM u) "
        f"SELECT thread_id, frame_idx, {q('sum(dx) OVER w')} AS x, {q('sum(dy) OVER w')} AS y, {q('sum(dz) OVER w')} AS z FROM d WINDOW w AS (PARTITION BY thread_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)",
        "threads",
        "frames",
    ),
)
def brownian_walk(threads: DataFrame, frames: DataFrame) -> DataFrame:
    made = sequences.walk(brownian_steps(threads, frames), ["thread_id"], "frame_idx", ["dx", "dy", "dz"])
    return made.select("thread_id", "frame_idx", *[r(F.col(c)).alias(c[1]) for c in ("dx", "dy", "dz")])


_CENTRED = f"c AS (SELECT {TENTHS} AS grp, t, value - avg(value) OVER (PARTITION BY {TENTHS}) AS y FROM ticks)"
_FREQ = "(1e0 / 60000e0 + f * ((1e0 / 2000e0 - 1e0 / 60000e0) / 39e0))"


@book.query(
    "ticks",
    sql=over(
        f"{_CENTRED}, e AS (SELECT grp, f, y, cos(2e0 * pi() * {_FREQ} * t) AS co, sin(2e0 * pi() * {_FREQ} * t) AS si FROM c, (SELECT unnest(range(40)) AS f)), s AS (SELECT grp, f, sum(y * co) AS yc, sum(y * si) AS ys, sum(co * co) AS cc, sum(co * si) AS cs, sum(y * y) AS yy, count(*)::DOUBLE AS n FROM e GROUP BY 1, 2), "
        "t AS (SELECT *, n - cc AS ss, 0.5e0 * atan2(2e0 * cs, cc - (n - cc)) AS tau FROM s), p AS (SELECT grp, f, (pow(yc * cos(tau) + ys * sin(tau), 2) / (cos(tau) * cos(tau) * cc + 2e0 * cos(tau) * sin(tau) * cs + sin(tau) * sin(tau) * ss) "
        f"+ pow(ys * cos(tau) - yc * sin(tau), 2) / (cos(tau) * cos(tau) * ss - 2e0 * cos(tau) * sin(tau) * cs + sin(tau) * sin(tau) * cc)) / yy AS power FROM t) SELECT grp, f::INT AS f, {q('power')} AS power FROM p",
        "ticks",
    ),
)
def lomb_scargle(ticks: DataFrame) -> DataFrame:
    grouped = ticks.select(F.expr(TENTHS).alias("grp"), "t", "value")
    means = grouped.groupBy("grp").agg(F.avg("value").alias("m"))
    centred = grouped.join(means, "grp").select("grp", "t", (F.col("value") - F.col("m")).alias("y"))
    return analysis.periodogram(centred, ["grp"], "t", "y", 2_000.0, 60_000.0, 40).select("grp", "f", r(F.col("power")).alias("power"))


@book.query("ticks", sql=over(f"g AS (SELECT {TENTHS} AS grp, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM ticks GROUP BY 1) SELECT idx, {q('value - (a * t + b)')} AS residual FROM ticks JOIN g ON {TENTHS} = grp", "ticks"))
def linear_detrend(ticks: DataFrame) -> DataFrame:
    grouped = ticks.withColumn("grp", F.expr(TENTHS))
    return analysis.detrended(grouped, ["grp"], "t", "value").select("idx", r(F.col("residual")).alias("residual"))


@book.query(
    "thread_points",
    sql=over(
        "c AS (SELECT thread_id, idx, x_km + s AS x, y_km + 500e0 * sin(idx / 3e0) AS y FROM thread_points), d AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0e0) AS ds FROM c WINDOW w AS (PARTITION BY thread_id ORDER BY idx)), "
        "l AS (SELECT *, sum(ds) OVER (PARTITION BY thread_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS arc FROM d), n AS (SELECT *, arc - lag(arc) OVER w AS a, lead(arc) OVER w - arc AS b, lag(y) OVER w AS ya, lead(y) OVER w AS yb FROM l WINDOW w AS (PARTITION BY thread_id ORDER BY idx)) "
        f"SELECT thread_id, idx, {q('arc')} AS arc, {q('CASE WHEN a IS NULL THEN (yb - y) / b WHEN b IS NULL THEN (y - ya) / a ELSE (a * a * yb + (b * b - a * a) * y - b * b * ya) / (a * b * (a + b)) END')} AS slope FROM n",
        "thread_points",
    ),
)
def arclength_tangent(points: DataFrame) -> DataFrame:
    curve = points.select("thread_id", "idx", (F.col("x_km") + F.col("s")).alias("x"), (F.col("y_km") + 500.0 * F.sin(F.col("idx") / 3.0)).alias("y"))
    measured = curve.withColumn("arc", sequences.arclength(["thread_id"], "idx", "x", "y"))
    return measured.select("thread_id", "idx", r(F.col("arc")).alias("arc"), r(sequences.gradient(["thread_id"], "idx", "y", "arc")).alias("slope"))
