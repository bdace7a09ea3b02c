"""Queries over pixels: block means, scatter, velocity, blur, transfer, masks, arrows, running statistics, slits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dips, transfer
from ..operators import analysis, quantiles, raster, sequences
from .registry import Registry, r
from .relations import rounded as q
from .relations import with_relations as over

book = Registry()
N = 64


@book.query("pixels", sql=over(f"SELECT frame_idx, row_idx // 3 AS row_idx, col_idx // 3 AS col_idx, {q('avg(tau)')} AS tau, {q('avg(intensity)')} AS intensity FROM pixels WHERE row_idx < 63 AND col_idx < 63 GROUP BY ALL", "pixels"))
def block_average(pixels: DataFrame) -> DataFrame:
    return raster.block_average(pixels, ["frame_idx"], ["tau", "intensity"], 3, N, N).withColumns({c: r(F.col(c)) for c in ("tau", "intensity")})


@book.query("lineitem", sql=f"SELECT (l_linenumber - 1)::BIGINT AS frame_idx, l_orderkey % 64 AS row_idx, l_partkey % 64 AS col_idx, {q('sum(l_discount)')} AS tau, {q('sum(l_discount * l_quantity)')} AS weighted FROM lineitem GROUP BY ALL")
def tau_scatter(lineitem: DataFrame) -> DataFrame:
    hits = lineitem.select((F.col("l_linenumber") - 1).cast("long").alias("frame_idx"), (F.col("l_orderkey") % N).alias("row_idx"), (F.col("l_partkey") % N).alias("col_idx"), F.col("l_discount").alias("tau"), (F.col("l_discount") * F.col("l_quantity")).alias("weighted"))
    return raster.scatter(hits, ["frame_idx"], ["tau", "weighted"]).withColumns({c: r(F.col(c)) for c in ("tau", "weighted")})


_HITS = "(l_linenumber - 1)::BIGINT AS frame_idx, l_orderkey % 64 AS row_idx, l_partkey % 64 AS col_idx, l_discount AS tau, l_quantity - 25e0 AS vx, l_tax * 100e0 - 4e0 AS vy"


def _velocity(lineitem: DataFrame) -> DataFrame:
    hits = lineitem.select(
        (F.col("l_linenumber") - 1).cast("long").alias("frame_idx"), (F.col("l_orderkey") % N).alias("row_idx"), (F.col("l_partkey") % N).alias("col_idx"),
        F.col("l_discount").alias("tau"), (F.col("l_quantity") - 25.0).alias("vx"), (F.col("l_tax") * 100.0 - 4.0).alias("vy"),
    )
    return raster.weighted_velocity(hits, ["frame_idx"], 0.055)


_VELOCITY = f"h AS (SELECT {_HITS} FROM lineitem), v AS (SELECT frame_idx, row_idx, col_idx, sum(tau) AS weight, CASE WHEN sum(tau) > 0.055e0 THEN sum(tau * vx) / sum(tau) ELSE 0e0 END AS vx, CASE WHEN sum(tau) > 0.055e0 THEN sum(tau * vy) / sum(tau) ELSE 0e0 END AS vy FROM h GROUP BY 1, 2, 3)"


@book.query("lineitem", sql=f"WITH {_VELOCITY} SELECT frame_idx, row_idx, col_idx, {q('weight')} AS weight, {q('vx')} AS vx, {q('vy')} AS vy FROM v")
def weighted_velocity(lineitem: DataFrame) -> DataFrame:
    return _velocity(lineitem).withColumns({c: r(F.col(c)) for c in ("weight", "vx", "vy")})


@book.query(
    "lineitem",
    sql=f"WITH {_VELOCITY}, s AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM v), c AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, row_idx // 8, col_idx // 8 ORDER BY round(weight * speed, 9) DESC, row_idx, col_idx) AS k FROM s WHERE round(weight * speed, 9) > 0) "
    f"SELECT frame_idx, row_idx, col_idx, {q('vx / speed')} AS ux, {q('vy / speed')} AS uy, {q('speed')} AS speed FROM c WHERE k = 1 AND speed > 0.04e0",
)
def arrow_top1(lineitem: DataFrame) -> DataFrame:
    return raster.strongest_per_cell(_velocity(lineitem), ["frame_idx"], 8, 0.04).withColumns({c: r(F.col(c)) for c in ("ux", "uy", "speed")})


_SIGMA = 1.5
_REACH = int(4 * _SIGMA + 0.5)
_KERNEL = ", ".join(repr(w) + "::DOUBLE" for w in raster.gaussian_weights(_SIGMA))


def _pass(source: str, axis: str, other: str) -> str:
    fold = f"CASE WHEN (t.i + k.k + 128) % 128 < 64 THEN (t.i + k.k + 128) % 128 ELSE 127 - (t.i + k.k + 128) % 128 END"
    return f"SELECT frame_idx, t.i AS {axis}, {other}, sum(v * k.w) AS v FROM t CROSS JOIN k JOIN {source} s ON s.{axis} = {fold} GROUP BY ALL"


_BLUR = f"""w AS (SELECT [{_KERNEL}] AS w), k AS (SELECT unnest(range(-{_REACH}, {_REACH + 1})) AS k, unnest(w) AS w FROM w), t AS (SELECT unnest(range(64)) AS i),
d AS (SELECT frame_idx, row_idx, col_idx, 1e0 - exp(-tau) AS v FROM pixels), a AS ({_pass('d', 'row_idx', 'col_idx')}), b AS ({_pass('a', 'col_idx', 'row_idx')})"""


def _blurred(pixels: DataFrame) -> DataFrame:
    return raster.blur(pixels.select("frame_idx", "row_idx", "col_idx", transfer.absorption(F.col("tau")).alias("v")), ["frame_idx"], ["v"], _SIGMA, N, N)


@book.query("pixels", sql=over(f"{_BLUR} SELECT frame_idx, row_idx, col_idx, {q('v')} AS absorption FROM b", "pixels"))
def psf_convolution(pixels: DataFrame) -> DataFrame:
    return _blurred(pixels).select("frame_idx", "row_idx", "col_idx", r(F.col("v")).alias("absorption"))


@book.query(
    "pixels",
    sql=over(
        f"{_BLUR}, n AS (SELECT frame_idx, row_idx // 2 AS row_idx, col_idx // 2 AS col_idx, least(greatest(1e0 - sum(v) / 4e0, 0e0), 1e0) AS tr FROM b GROUP BY ALL), g AS (SELECT frame_idx, row_idx // 2 AS row_idx, col_idx // 2 AS col_idx, avg(intensity) AS bg FROM pixels GROUP BY ALL), m AS (SELECT frame_idx, quantile_cont(bg, 0.5) AS level FROM g GROUP BY 1), "
        f"o AS (SELECT n.*, bg, level, least(greatest(1e0 - 0.65e0 * (1e0 - tr), 0e0), 1e0) AS td FROM n JOIN g USING (frame_idx, row_idx, col_idx) JOIN m USING (frame_idx)) SELECT frame_idx, row_idx, col_idx, {q('tr')} AS transmission, {q('bg * td + 3.22e0 / 6.93e0 * level * (1e0 - td)')} AS image FROM o",
        "pixels",
    ),
)
def gong_compose(pixels: DataFrame) -> DataFrame:
    """Transmission blurred and taken to the detector's pixels, diluted and composed over the frame's background."""
    cell = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    native = _blurred(pixels).groupBy("frame_idx", cell("row_idx"), cell("col_idx")).agg((1 - F.sum("v") / 4.0).alias("tr"))
    background = pixels.groupBy("frame_idx", cell("row_idx"), cell("col_idx")).agg(F.avg("intensity").alias("bg"))
    level = quantiles.percentiles(background, ["frame_idx"], "bg", [0.5]).select("frame_idx", "level")
    joined = native.join(background, ["frame_idx", "row_idx", "col_idx"]).join(level, "frame_idx").withColumn("tr", dips.clip(F.col("tr"), 0.0, 1.0))
    image = transfer.compose(F.col("bg"), transfer.dilute(F.col("tr"), 0.65), 3.22 / 6.93 * F.col("level"))
    return joined.select("frame_idx", "row_idx", "col_idx", r(F.col("tr")).alias("transmission"), r(image).alias("image"))


@book.query("pixels", sql=over(f"SELECT frame_idx, row_idx, col_idx, (tau > 0.1e0)::INT AS hard, {q('1e0 - exp(-tau)')} AS soft, {q('-ln(greatest(1e0 - (1e0 - exp(-tau)), 1e-12))')} AS native_tau FROM pixels", "pixels"))
def opacity_masks(pixels: DataFrame) -> DataFrame:
    soft = transfer.absorption(F.col("tau"))
    return pixels.select("frame_idx", "row_idx", "col_idx", (F.col("tau") > 0.1).cast("int").alias("hard"), r(soft).alias("soft"), r(transfer.native_tau(soft)).alias("native_tau"))


@book.query(
    "pixels",
    sql=over(
        "g AS (SELECT 'highres' AS grid, frame_idx, row_idx, col_idx, tau FROM pixels UNION ALL SELECT 'native', frame_idx, row_idx // 2, col_idx // 2, sum(tau) / 4e0 FROM pixels GROUP BY ALL) "
        f"SELECT grid, frame_idx, 60e0 * frame_idx AS time_s, row_idx, col_idx, tau > 0.1e0 AS hard, {q('1e0 - exp(-tau)')} AS absorption FROM g WHERE frame_idx = 2",
        "pixels",
    ),
)
def mask_round_trip(pixels: DataFrame) -> DataFrame:
    """Masks of every frame and both grids exported as a table, and one frame read back."""
    from ..sources import masks, staging

    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    native = pixels.groupBy("frame_idx", half("row_idx"), half("col_idx")).agg((F.sum("tau") / 4.0).alias("tau")).withColumn("grid", F.lit("native"))
    tau = pixels.select("frame_idx", "row_idx", "col_idx", "tau", F.lit("highres").alias("grid")).unionByName(native).withColumn("time_s", 60.0 * F.col("frame_idx"))
    target = staging.shared_path(pixels.sparkSession, "masks")
    masks.export(tau, target, 0.1)
    back = masks.read_frame(pixels.sparkSession, target, 2)
    return back.select("grid", "frame_idx", "time_s", "row_idx", "col_idx", F.col("binary").alias("hard"), r(F.col("absorption")).alias("absorption"))


_CUBES = "c AS (SELECT CASE frame_idx % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS sequence_id, frame_idx // 2 AS frame_idx, row_idx, col_idx, (intensity::FLOAT)::DOUBLE AS intensity FROM pixels)"


def _cubes(pixels: DataFrame, low: int, high: int) -> DataFrame:
    """Frames ``low`` to ``high`` of two sequences, as the recorder takes them: absent pixels are NaN."""
    from ..sources import frames

    half = F.floor(F.col("frame_idx") / 2).cast("long")
    name = F.when(F.col("frame_idx") % 2 == 0, "even").otherwise("odd")
    cells = pixels.select(name.alias("sequence_id"), half.alias("frame_idx"), (120.0 * half).alias("time_s"), "row_idx", "col_idx", "intensity")
    return frames.assemble(cells.filter(F.col("frame_idx").between(low, high)), N, N)


def _recorded(pixels: DataFrame) -> str:
    """A recording made in two batches, the second of which comes twice."""
    from ..sources import frames, staging

    spark = pixels.sparkSession
    frames.register(spark)
    path = staging.shared_path(spark, "recording")
    for batch, bounds in ((0, (0, 1)), (1, (2, 2**40)), (1, (2, 2**40))):
        _cubes(pixels, *bounds).write.format("frames").mode("append").options(writer="query", batch=str(batch)).save(path)
    return path


@book.query("pixels", sql=over(f"{_CUBES} SELECT sequence_id, frame_idx, row_idx, col_idx, intensity FROM c WHERE sequence_id = 'even' AND frame_idx BETWEEN 1 AND 2", "pixels"))
def frame_cubes(pixels: DataFrame) -> DataFrame:
    """Frames recorded as cubes, and two of one sequence read back by parts and byte ranges."""
    from ..sources import frames

    back = frames.scan(pixels.sparkSession, _recorded(pixels), ["even"], 1, 2).filter(~F.isnan("intensity"))
    return back.select("sequence_id", "frame_idx", "row_idx", "col_idx", F.col("intensity").cast("double").alias("intensity"))


@book.query("pixels", sql=over(f"{_CUBES} SELECT sequence_id, max(frame_idx) + 1 AS frames, min(intensity) AS low, max(intensity) AS high, {q('avg(intensity)')} AS mean, 120e0 * max(frame_idx) AS end_s FROM c GROUP BY 1", "pixels"))
def recording_index(pixels: DataFrame) -> DataFrame:
    """What the newest commit of a recording says of its sequences."""
    from ..sources import frames

    return frames.index(pixels.sparkSession, [_recorded(pixels)]).select("sequence_id", "frames", "low", "high", r(F.col("mean")).alias("mean"), "end_s")


@book.query("pixels", sql=over("SELECT frame_idx, greatest(min(row_idx) - 3, 0) AS row0, least(max(row_idx) + 4, 64) AS row1, greatest(min(col_idx) - 3, 0) AS col0, least(max(col_idx) + 4, 64) AS col1 FROM pixels WHERE tau > 0.25e0 AND row_idx BETWEEN 10 AND 50 GROUP BY 1", "pixels"))
def mask_bounds(pixels: DataFrame) -> DataFrame:
    return raster.mask_bounds(pixels.filter((F.col("tau") > 0.25) & F.col("row_idx").between(10, 50)), ["frame_idx"], 3, N, N)


@book.query("pixels", sql=over("m AS (SELECT row_idx, col_idx FROM pixels WHERE col_idx BETWEEN 12 AND 40 GROUP BY 1, 2 HAVING max((tau > 0.3e0)::INT) = 1) SELECT count(*) AS n, min(row_idx) AS row0, max(row_idx) + 1 AS row1, min(col_idx) AS col0, max(col_idx) + 1 AS col1 FROM m", "pixels"))
def mask_union_bbox(pixels: DataFrame) -> DataFrame:
    union = pixels.filter(F.col("col_idx").between(12, 40)).groupBy("row_idx", "col_idx").agg(F.max(F.col("tau") > 0.3).alias("on")).filter("on")
    return union.agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("row0"), (F.max("row_idx") + 1).alias("row1"), F.min("col_idx").alias("col0"), (F.max("col_idx") + 1).alias("col1"))


@book.query("pixels", sql=over(f"SELECT frame_idx, row_idx, col_idx, {q('tau - first_value(tau) OVER (PARTITION BY row_idx, col_idx ORDER BY frame_idx)')} AS delta FROM pixels", "pixels"))
def frame_zero_delta(pixels: DataFrame) -> DataFrame:
    return pixels.select("frame_idx", "row_idx", "col_idx", r(sequences.since_first("tau", ["row_idx", "col_idx"], "frame_idx")).alias("delta"))


@book.query("pixels", sql=over("l AS (SELECT quantile_cont(intensity, 0.01) AS lo, quantile_cont(intensity, 0.99) AS hi FROM pixels WHERE frame_idx = 0) SELECT frame_idx, row_idx, col_idx, round_even(255e0 * least(greatest((intensity - lo) / (hi - lo), 0e0), 1e0), 0)::INT AS display FROM pixels, l", "pixels"))
def display_scale(pixels: DataFrame) -> DataFrame:
    """Contrast fixed by percentiles of frame 0, one row that every pixel gets."""
    levels = quantiles.percentiles(pixels.filter("frame_idx = 0"), [], "intensity", [0.01, 0.99])
    limits = quantiles.wide(levels, [], {"low": 0.01, "high": 0.99})
    return pixels.crossJoin(F.broadcast(limits)).select("frame_idx", "row_idx", "col_idx", transfer.display(F.col("intensity"), F.col("low"), F.col("high")).alias("display"))


@book.query("pixels", sql=over(f"SELECT {q('min(intensity)')} AS low, {q('max(intensity)')} AS high, {q('avg((tau > 0.1e0)::INT)')} AS mask_share, {q('max(tau)')} AS most_tau, count(DISTINCT frame_idx) AS frames, {q('quantile_cont(tau, 0.95)')} AS p95 FROM pixels", "pixels"))
def running_stats(pixels: DataFrame) -> DataFrame:
    p95 = quantiles.percentiles(pixels, [], "tau", [0.95]).select(r(F.col("level")).alias("p95"))
    return pixels.agg(r(F.min("intensity")).alias("low"), r(F.max("intensity")).alias("high"), r(F.avg((F.col("tau") > 0.1).cast("int"))).alias("mask_share"), r(F.max("tau")).alias("most_tau"), F.countDistinct("frame_idx").alias("frames")).crossJoin(F.broadcast(p95))


_CA, _SA = math.cos(math.radians(30)), math.sin(math.radians(30))
_SLIT = f"""s AS (SELECT k, j, -20e0 + k AS distance, 31.3e0 + (-20e0 + k) * {_CA!r}::DOUBLE - (-1e0 + j) * {_SA!r}::DOUBLE AS sx, 30.7e0 + (-20e0 + k) * {_SA!r}::DOUBLE + (-1e0 + j) * {_CA!r}::DOUBLE AS sy FROM (SELECT unnest(range(41)) AS k), (SELECT unnest(range(3)) AS j)),
c AS (SELECT k, j, distance, least(floor(sy), 62)::BIGINT AS r0, least(floor(sx), 62)::BIGINT AS c0, sy - least(floor(sy), 62) AS fy, sx - least(floor(sx), 62) AS fx FROM s WHERE sx BETWEEN 0 AND 63 AND sy BETWEEN 0 AND 63),
e AS (SELECT *, r0 + d AS row_idx, c0 + h AS col_idx, (CASE WHEN d = 1 THEN fy ELSE 1e0 - fy END) * (CASE WHEN h = 1 THEN fx ELSE 1e0 - fx END) AS w FROM c, (SELECT unnest(range(2)) AS d), (SELECT unnest(range(2)) AS h)),
p AS (SELECT frame_idx, k, j, distance, sum(w * intensity) AS v FROM pixels JOIN e USING (row_idx, col_idx) GROUP BY ALL HAVING count(*) = 4),
t AS (SELECT frame_idx, k, distance, avg(v) AS value FROM p GROUP BY ALL)"""


def _slit(pixels: DataFrame) -> DataFrame:
    slit = analysis.slit_points(pixels.sparkSession, 31.3, 30.7, 30.0, 40.0, 2.0)
    return analysis.time_distance(pixels, slit, "intensity", N, N)


@book.query("pixels", sql=over(f"{_SLIT} SELECT frame_idx, k, {q('distance')} AS distance, {q('value')} AS value FROM t", "pixels"))
def slit_time_distance(pixels: DataFrame) -> DataFrame:
    return _slit(pixels).select("frame_idx", "k", r(F.col("distance")).alias("distance"), r(F.col("value")).alias("value"))


@book.query("pixels", sql=over(f"{_SLIT}, b AS (SELECT frame_idx, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM t GROUP BY 1) SELECT frame_idx, k, {q('(value - lo) / greatest(hi - lo, 1e-12)')} AS scaled FROM t JOIN b USING (frame_idx)", "pixels"))
def column_percentile_norm(pixels: DataFrame) -> DataFrame:
    return analysis.normalised(_slit(pixels), ["frame_idx"], "value").select("frame_idx", "k", r(F.col("scaled")).alias("scaled"))


@book.query(
    "pixels",
    sql=over(
        f"n AS (SELECT frame_idx, row_idx, col_idx, intensity, lag(intensity) OVER w AS l, lead(intensity) OVER w AS r FROM pixels WINDOW w AS (PARTITION BY frame_idx, row_idx ORDER BY col_idx)), m AS (SELECT frame_idx, row_idx, min({{'v': intensity, 'c': col_idx, 'l': l, 'r': r}}) AS m FROM n GROUP BY 1, 2) "
        f"SELECT frame_idx, row_idx, {q('m.c + CASE WHEN m.l - 2e0 * m.v + m.r > 1e-12 THEN least(greatest(0.5e0 * (m.l - m.r) / (m.l - 2e0 * m.v + m.r), -1e0), 1e0) ELSE 0e0 END')} AS position FROM m",
        "pixels",
    ),
)
def subpixel_minimum(pixels: DataFrame) -> DataFrame:
    return analysis.subpixel(pixels, ["frame_idx", "row_idx"], "col_idx", "intensity").select("frame_idx", "row_idx", r(F.col("position")).alias("position"))


_ERF = "(CASE WHEN {x} < 0 THEN -1e0 WHEN {x} > 0 THEN 1e0 ELSE 0e0 END) * (1e0 - ((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t} * exp(-abs({x}) * abs({x})))"


def _erf(x: str) -> str:
    return "(" + _ERF.replace("{t}", f"(1e0 / (1e0 + 0.3275911e0 * abs({x})))").replace("{x}", x) + ")"


def _gauss(pixel: str, centre: str) -> str:
    scale = "(1.4142135623730951e0 * sigma_px)"
    return f"(1.2533141373155001e0 * sigma_px * ({_erf(f'(({pixel} + 0.5e0 - {centre}) / {scale})')} - {_erf(f'(({pixel} - 0.5e0 - {centre}) / {scale})')}))"


_SAMPLES = """a AS (SELECT thread_id, idx, (x_km + s * cos(radians(pitch_deg))) / 4000e0 AS x_px, (y_km + s * sin(radians(pitch_deg))) / 4000e0 AS y_px, radius_km / 200e0 AS sigma_px, 1e0 - abs(2e0 * idx / 24e0 - 1e0) AS amplitude FROM thread_points),
b AS (SELECT *, max(amplitude) OVER (PARTITION BY thread_id) AS top FROM a)"""


def _samples(points: DataFrame) -> DataFrame:
    pitch = F.radians("pitch_deg")
    return points.select(
        "thread_id", "idx", ((F.col("x_km") + F.col("s") * F.cos(pitch)) / 4000.0).alias("x_px"), ((F.col("y_km") + F.col("s") * F.sin(pitch)) / 4000.0).alias("y_px"),
        (F.col("radius_km") / 200.0).alias("sigma_px"), (1 - F.abs(2.0 * F.col("idx") / 24.0 - 1)).alias("amplitude"),
    )


@book.query(
    "thread_points",
    sql=over(
        f"{_SAMPLES}, c AS (SELECT *, greatest(ceil(4e0 * sigma_px + 0.5e0), 1)::BIGINT AS half FROM b WHERE amplitude > 0 AND amplitude >= 1e-7 * top), "
        "y AS (SELECT *, unnest(range(round_even(y_px, 0)::BIGINT - half, round_even(y_px, 0)::BIGINT + half + 1)) AS row_idx FROM c), x AS (SELECT *, unnest(range(round_even(x_px, 0)::BIGINT - half, round_even(x_px, 0)::BIGINT + half + 1)) AS col_idx FROM y WHERE row_idx BETWEEN 0 AND 93) "
        f"SELECT row_idx, col_idx, {q('sum(amplitude * ' + _gauss('row_idx', 'y_px') + ' * ' + _gauss('col_idx', 'x_px') + ')', 5)} AS tau FROM x WHERE col_idx BETWEEN 0 AND 93 GROUP BY 1, 2",
        "thread_points",
    ),
)
def thread_erf_raster(points: DataFrame) -> DataFrame:
    hits = raster.thread_contributions(_samples(points), ["thread_id"], 94, 94)
    return raster.scatter(hits, [], ["tau"]).select("row_idx", "col_idx", r(F.col("tau"), 5).alias("tau"))


@book.query(
    "segments",
    sql=over(
        "g AS (SELECT thread_id, round_even(ay / 4000e0, 0)::BIGINT AS r0, round_even(ax / 4000e0, 0)::BIGINT AS c0, round_even(by_ / 4000e0, 0)::BIGINT AS r1, round_even(bx / 4000e0, 0)::BIGINT AS c1, 0.5e0 + (thread_id % 7) / 4e0 AS q0, 0.5e0 + (thread_id % 5) / 4e0 AS q1 FROM segments), "
        "n AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n FROM g), k AS (SELECT *, unnest(range(n + 1)) AS k FROM n), l AS (SELECT (r0 + round_even((r1 - r0) * CASE WHEN n > 0 THEN k / n ELSE 0e0 END, 0))::BIGINT AS r, (c0 + round_even((c1 - c0) * CASE WHEN n > 0 THEN k / n ELSE 0e0 END, 0))::BIGINT AS c, q0 + (q1 - q0) * CASE WHEN n > 0 THEN k / n ELSE 0e0 END + sqrt(2e0) / 2e0 AS q FROM k), "
        "o AS (SELECT r, c, max(q) AS q FROM l GROUP BY 1, 2), d AS (SELECT unnest(range(-4, 5)) AS d), m AS (SELECT DISTINCT r + a.d AS r, c + b.d AS c FROM o, d a, d b WHERE a.d * a.d + b.d * b.d <= q * q AND r + a.d BETWEEN 0 AND 93 AND c + b.d BETWEEN 0 AND 93) "
        "SELECT DISTINCT r + a.d AS row_idx, c + b.d AS col_idx FROM m, d a, d b WHERE a.d * a.d + b.d * b.d <= 1 AND r + a.d BETWEEN 0 AND 93 AND c + b.d BETWEEN 0 AND 93",
        "segments",
    ),
)
def thread_masks(segments: DataFrame) -> DataFrame:
    px = lambda c: F.rint(F.col(c) / 4000.0).cast("long")
    lines = segments.select(px("ay").alias("r0"), px("ax").alias("c0"), px("by_").alias("r1"), px("bx").alias("c1"), (0.5 + (F.col("thread_id") % 7) / 4.0).alias("radius0"), (0.5 + (F.col("thread_id") % 5) / 4.0).alias("radius1"))
    return raster.thread_masks(lines, [], 94, 94, dilation=1)


_LEAVES = "c AS (SELECT frame_idx, frame_idx // 4 AS part, row_idx, col_idx, cast(round(tau * 1e6) AS bigint) AS tau FROM pixels), e AS (SELECT part, frame_idx, row_idx, col_idx, strlen(row_idx::VARCHAR) || ':' || row_idx || strlen(col_idx::VARCHAR) || ':' || col_idx || strlen(tau::VARCHAR) || ':' || tau AS t FROM c)"
_UP = "strlen({0}::VARCHAR) || ':' || {0} || digest"


@book.query(
    "pixels",
    sql=over(
        f"{_LEAVES}, f AS (SELECT part, frame_idx, sha256(string_agg(t, '' ORDER BY row_idx, col_idx)) AS digest FROM e GROUP BY ALL), p AS (SELECT part, sha256(string_agg({_UP.format('frame_idx')}, '' ORDER BY frame_idx)) AS digest FROM f GROUP BY 1) "
        f"SELECT 2 AS depth, part, frame_idx, digest FROM f UNION ALL SELECT 1, part, NULL, digest FROM p UNION ALL SELECT 0, NULL, NULL, sha256(string_agg({_UP.format('part')}, '' ORDER BY part)) FROM p",
        "pixels",
    ),
)
def frame_digests(pixels: DataFrame) -> DataFrame:
    """Digests of frames, of four frames each, and of all."""
    from ..sources import digests

    part = F.floor(F.col("frame_idx") / 4).cast("long").alias("part")
    whole = pixels.select(part, "frame_idx", "row_idx", "col_idx", F.round(F.col("tau") * 1e6).cast("long").alias("tau"))
    return digests.tree(whole, ["part", "frame_idx"], ["row_idx", "col_idx"], ["row_idx", "col_idx", "tau"])
