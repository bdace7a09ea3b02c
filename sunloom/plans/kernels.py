"""Queries over the iterative kernels, which SQL has no form for and tests hold to invariants, and the streams, whose end
result is that of a batch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pendulum, transfer
from ..operators import greedy, kernels, regions, sequences
from ..operators import ridges as tracks
from ..operators.sizes import dealt
from ..sources import staging
from ..streaming import dynamics
from ..streaming import runs as streams
from . import series
from . import threads as thread_plans
from .registry import Registry, r
from .relations import rounded as _q
from .relations import with_relations as over

book = Registry()


@book.query("threads")
def column_mass_loading(threads: DataFrame) -> DataFrame:
    return kernels.column_mass_loading(threads)


#: Times and distances of a diagram, samples of a ridge, threads of a filament, crops of a window.
TIMES, WIDTH, SAMPLES, FILAMENT, CROPS = 60, 41, 240, 100, 100


def swing(diagram: Column, t: Column) -> Column:
    """Where the dark band of a diagram is: the truth that tracking should find."""
    return 20 + (4 + diagram % 12 / 4.0) * F.sin(2 * math.pi * t / 30 + diagram)


def diagrams(ticks: DataFrame) -> DataFrame:
    """A diagram for every TIMES ticks, a time for each tick: a dark band that swings around the middle, with noise from
    the tick's value and counters, and gaps."""
    diagram, t = F.floor(F.col("idx") / TIMES), F.col("idx") % TIMES
    # Dealt before a tick becomes a row of cells, so that only ticks are shuffled.
    times = dealt(ticks.select(diagram.alias("diagram_id"), t.alias("t"), "value"), "diagram_id", ticks, 100 * TIMES)
    cells = times.select("diagram_id", "t", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDTH - 1).cast("long"))).alias("k"))
    noise = sequences.counter_uniform(F.col("diagram_id"), F.col("t") * 64 + F.col("k"), stream=5) - 0.5
    value = 1 - F.exp(-F.pow((F.col("k") - swing(F.col("diagram_id"), F.col("t"))) / 2.5, 2)) + 0.2 * noise + F.col("value") % 1 / 50
    return cells.select("diagram_id", "t", "k", F.when((F.col("t") + F.col("k")) % 97 == 0, F.lit(None)).otherwise(value).alias("value"))


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_ACROSS, _ALONG = (", ".join(f"({k - len(w) // 2}, {x!r}::DOUBLE)" for k, x in enumerate(w)) for w in map(tracks.weights, (1.5, 0.7)))
_RIDGE = f"""c AS (SELECT cast(floor(idx / {TIMES}e0) AS bigint) AS d, idx % {TIMES} AS t, k, value FROM ticks CROSS JOIN range({WIDTH}) k(k)),
v AS (SELECT d, t, k, CASE WHEN (t + k) % 97 <> 0 THEN 1e0 - exp(-pow((k - (20e0 + (4e0 + d % 12 / 4e0) * sin(2e0 * pi() * t / 30e0 + d))) / 2.5e0, 2)) + 0.2e0 * ({series._uniform(5, 'd', '(t * 64 + k)')} - 0.5e0) + value % 1 / 50e0 END AS v FROM c),
m AS (SELECT d, quantile_cont(v, 0.5) AS middle, max(t) AS last FROM v GROUP BY d),
f AS (SELECT d, t, k, coalesce(v, middle) AS v FROM v JOIN m USING (d)),
wk(o, w) AS (VALUES {_ACROSS}), wt(o, w) AS (VALUES {_ALONG}),
ak AS (SELECT f.d, f.t, a.k, sum(wk.w * f.v) AS v FROM range({WIDTH}) a(k) CROSS JOIN wk JOIN f ON f.k = greatest(0, least({WIDTH - 1}, a.k + wk.o)) GROUP BY ALL),
img AS (SELECT n.d, n.t, f.k, sum(wt.w * f.v) AS v FROM (SELECT DISTINCT d, t, last FROM f JOIN m USING (d)) n CROSS JOIN wt JOIN ak f ON f.d = n.d AND f.t = greatest(0, least(n.last, n.t + wt.o)) GROUP BY ALL),
lim AS (SELECT d, t, quantile_cont(v, 0.1) AS low, quantile_cont(v, 0.9) AS high FROM img GROUP BY ALL),
cost AS (SELECT d, t, k, (v - low) / greatest(high - low, 1e-12) AS x FROM img JOIN lim USING (d, t)),
walk AS (
  SELECT d, t, k, x AS v, [k] AS path FROM cost WHERE t = 0
  UNION ALL
  SELECT d, t, k, best.v, list_append(best.path, k) FROM (
    SELECT c.d, c.t, c.k, min({{'v': w.v + 0.15e0 * (w.k - c.k) * (w.k - c.k) + c.x, 'm': w.k, 'path': w.path}}) AS best FROM walk w JOIN cost c ON c.d = w.d AND c.t = w.t + 1 AND c.k BETWEEN w.k - 6 AND w.k + 6 GROUP BY c.d, c.t, c.k)),
ended AS (SELECT d, unnest(min({{'v': v, 'k': k, 'path': path}}).path) AS p, unnest(range(max(last) + 1)) AS t FROM walk JOIN m USING (d) WHERE t = last GROUP BY d),
near AS (SELECT e.d, e.t, e.p, l.v AS l, o.v AS o, h.v AS h FROM ended e JOIN img o ON o.d = e.d AND o.t = e.t AND o.k = e.p LEFT JOIN img l ON l.d = e.d AND l.t = e.t AND l.k = e.p - 1 LEFT JOIN img h ON h.d = e.d AND h.t = e.t AND h.k = e.p + 1)
SELECT d AS diagram_id, t, {_q('p + CASE WHEN l - 2e0 * o + h > 1e-12 THEN least(greatest(0.5e0 * (l - h) / (l - 2e0 * o + h), -1e0), 1e0) ELSE 0e0 END')} AS position FROM near"""


@book.query("ticks", sql=recursive(over(_RIDGE, "ticks")))
def dark_ridge(ticks: DataFrame) -> DataFrame:
    return tracks.dark_ridge(diagrams(ticks)).withColumn("position", r(F.col("position")))


def ridges(ticks: DataFrame) -> DataFrame:
    """A ridge for every SAMPLES ticks: damped sines around 50 with amplitude 10, damping 14,400 s and periods from 3,600 s
    on, with noise of a fifth of a pixel, some outliers and some missing positions."""
    ridge, step = F.floor(F.col("idx") / SAMPLES), F.col("idx") % SAMPLES
    # A ridge is a few KB and a twentieth of a second: parts by the work, not by bytes.
    rows = dealt(ticks.select(ridge.alias("ridge_id"), (60.0 * step).alias("t"), "idx"), "ridge_id", ticks, 40 * SAMPLES)
    lits = lambda *v: [F.lit(float(x)) for x in v]
    equilibrium, drift, amplitude, damping, phase, reference = lits(50, 0, 10, 14_400, 0, 0)
    clean = pendulum.damped_sine(F.col("t"), equilibrium, drift, amplitude, 3_600.0 + 120.0 * (F.col("ridge_id") % 10), damping, phase, reference)
    noise = 0.4 * (sequences.counter_uniform(F.col("ridge_id"), F.col("idx"), stream=7) - 0.5) + F.when(F.col("idx") % 61 == 0, 8.0).otherwise(0.0)
    return rows.select("ridge_id", "t", F.when(F.col("idx") % 53 != 0, clean + noise).alias("position"))


@book.query("ticks")
def damped_sine_fit(ticks: DataFrame) -> DataFrame:
    return kernels.damped_sine_fit(ridges(ticks))


#: Labels of regions spread from cell to cell: the least of all that is reached.
_STEPS = "VALUES (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)"


def _labels(cells: str, by: str, width: int) -> str:
    """A table ``lab`` (``by``, r, c, s, l) for ``cells`` (``by``, r, c, s): set cells connect across corners, others not."""
    joined = " AND ".join(f"n.{k} = w.{k}" for k in by.split(", "))
    own = ", ".join(f"n.{k}" for k in by.split(", "))
    return f"""o(dr, dc) AS ({_STEPS}), lab({by}, r, c, s, l) USING KEY ({by}, r, c) AS (
  SELECT {by}, r, c, s, r * {width} + c FROM {cells}
  UNION
  SELECT {own}, n.r, n.c, n.s, min(w.l) FROM lab w JOIN o ON true JOIN recurring.lab n ON {joined} AND n.r = w.r + dr AND n.c = w.c + dc AND n.s = w.s
  WHERE w.l < n.l AND (n.s OR dr = 0 OR dc = 0) GROUP BY {own}, n.r, n.c, n.s)"""


_QUIET = f"""v AS (SELECT frame_idx, 2 * (row_idx // 32) + col_idx // 32 AS crop, row_idx % 32 AS r, col_idx % 32 AS c, 100e0 + intensity / 10e0 AS value FROM pixels),
g AS (SELECT frame_idx, crop, r, c, coalesce(value, 0e0) AS value FROM (SELECT DISTINCT frame_idx, crop FROM v) CROSS JOIN range(32) y(r) CROSS JOIN range(32) x(c) LEFT JOIN v USING (frame_idx, crop, r, c)),
m AS (SELECT frame_idx, crop, quantile_cont(value, 0.5) AS middle FROM g GROUP BY ALL),
raw AS (SELECT frame_idx, crop, kind, r, c, CASE kind WHEN 0 THEN value < 0.92e0 * middle ELSE value > 1.12e0 * middle END AS s FROM g JOIN m USING (frame_idx, crop), (VALUES (0), (1)) k(kind)),
near AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc)),
grown AS (SELECT DISTINCT frame_idx, crop, kind, r + dr AS r, c + dc AS c FROM raw, near WHERE s AND r + dr BETWEEN 0 AND 31 AND c + dc BETWEEN 0 AND 31),
shrunk AS (SELECT frame_idx, crop, kind, r + dr AS r, c + dc AS c FROM grown, near GROUP BY ALL HAVING count(*) = 25),
cells AS (SELECT raw.* REPLACE (raw.s OR shrunk.r IS NOT NULL AS s) FROM raw LEFT JOIN shrunk USING (frame_idx, crop, kind, r, c)),
setc AS (SELECT * FROM cells WHERE s),
{_labels("setc", "frame_idx, crop, kind", 32)},
parts AS (SELECT frame_idx, crop, kind, count(*) AS n, greatest(max(r) - min(r), max(c) - min(c)) + 1 AS long FROM lab GROUP BY frame_idx, crop, kind, l)
SELECT frame_idx, crop, NOT EXISTS (SELECT 1 FROM parts p WHERE p.frame_idx = m.frame_idx AND p.crop = m.crop AND (n > CASE kind WHEN 0 THEN 0.02e0 ELSE 0.03e0 END * 1024 OR long > 0.35e0 * 32)) AS quiet FROM m"""


@book.query("pixels", sql=recursive(over(_QUIET, "pixels")))
def quiet_crop(pixels: DataFrame) -> DataFrame:
    part = lambda c: F.floor(F.col(c) / 32).cast("long")
    crops = pixels.select("frame_idx", (2 * part("row_idx") + part("col_idx")).alias("crop"), (F.col("row_idx") % 32).alias("row_idx"), (F.col("col_idx") % 32).alias("col_idx"), (100 + F.col("intensity") / 10).alias("value"))
    return regions.quiet_crops(crops, ["frame_idx", "crop"], 32, 32, tile=16)


_COHESION = f"""g AS (SELECT frame_idx, r, c, coalesce(1e0 - exp(-tau), 0e0) AS a FROM (SELECT DISTINCT frame_idx FROM pixels) CROSS JOIN range(64) y(r) CROSS JOIN range(64) x(c) LEFT JOIN (SELECT frame_idx, row_idx AS r, col_idx AS c, tau FROM pixels) USING (frame_idx, r, c)),
cells AS (SELECT *, a > 0.08e0 AS s FROM g),
{_labels("cells", "frame_idx", 64)},
parts AS (SELECT frame_idx, s, count(*) AS n, min(r) = 0 OR max(r) = 63 OR min(c) = 0 OR max(c) = 63 AS edge FROM lab GROUP BY frame_idx, s, l),
sums AS (SELECT frame_idx, count(*) FILTER (s) AS parts, coalesce(max(n) FILTER (s), 0) AS largest, coalesce(sum(n) FILTER (s), 0) AS mask, coalesce(sum(n) FILTER (NOT s AND NOT edge), 0) AS holes FROM parts GROUP BY 1),
levels AS (SELECT frame_idx, quantile_cont(a, 0.5) AS p50, quantile_cont(a, 0.9) AS p90 FROM cells WHERE s GROUP BY 1)
SELECT frame_idx, parts, round(largest / greatest(1, mask), 9) AS largest_share, round(holes / greatest(1, mask + holes), 9) AS hole_share, round(p50, 9) AS p50, round(p90, 9) AS p90 FROM sums LEFT JOIN levels USING (frame_idx)"""


@book.query("pixels", sql=recursive(over(_COHESION, "pixels")))
def static_cohesion(pixels: DataFrame) -> DataFrame:
    seen = pixels.select("frame_idx", "row_idx", "col_idx", transfer.absorption(F.col("tau")).alias("absorption"))
    made = regions.cohesion(seen, "frame_idx", 64, 64, 0.08, tile=16)
    return made.withColumns({c: F.round(c, 9) for c in ("largest_share", "hole_share", "p50", "p90")})


_REGIONS = f"""g AS (SELECT frame_idx, r, c, coalesce(tau, 0e0) > 0.12e0 AS s FROM (SELECT DISTINCT frame_idx FROM pixels) CROSS JOIN range(64) y(r) CROSS JOIN range(64) x(c) LEFT JOIN (SELECT frame_idx, row_idx AS r, col_idx AS c, tau FROM pixels) USING (frame_idx, r, c)),
{_labels("g", "frame_idx", 64)}
SELECT frame_idx, s AS set, count(*) AS pixels, min(r) AS top, max(r) AS bottom, min(c) AS first, max(c) AS last, min(r) = 0 OR max(r) = 63 OR min(c) = 0 OR max(c) = 63 AS edge FROM lab GROUP BY frame_idx, s, l"""


@book.query("pixels", sql=recursive(over(_REGIONS, "pixels")))
def mask_regions(pixels: DataFrame) -> DataFrame:
    """Connected regions of optically thick pixels and of the rest, over tiles of 16."""
    thick = pixels.filter("tau > 0.12").select("frame_idx", "row_idx", "col_idx")
    return regions.regions(thick, ["frame_idx"], 64, 64, tile=16, frames=pixels)


_CHOICE = f"""c AS (SELECT cast(floor(crop_id / {CROPS}e0) AS bigint) AS window_id, (crop_id * 7919) % 10007 AS rank, crop_id, x0, y0, x1, y1 FROM crops),
k AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY rank, crop_id) AS k FROM c),
walk AS (
  SELECT DISTINCT window_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM c
  UNION ALL
  SELECT w.window_id, k.k, CASE WHEN len(kept) < 12 AND NOT EXISTS (SELECT 1 FROM k o WHERE o.window_id = k.window_id AND list_contains(kept, o.crop_id) AND o.x0 < k.x1 AND o.x1 > k.x0 AND o.y0 < k.y1 AND o.y1 > k.y0) THEN list_append(kept, k.crop_id) ELSE kept END
  FROM walk w JOIN k ON k.window_id = w.window_id AND k.k = w.k + 1 WHERE k.k <= 128),
ended AS (SELECT window_id, arg_max(kept, k) AS kept FROM walk GROUP BY 1)
SELECT c.* FROM c JOIN ended e ON e.window_id = c.window_id AND list_contains(kept, c.crop_id)"""


@book.query("crops", sql=recursive(over(_CHOICE, "crops")))
def crop_selection(crops: DataFrame) -> DataFrame:
    ranked = crops.select(F.floor(F.col("crop_id") / CROPS).alias("window_id"), (F.col("crop_id") * 7919 % 10007).alias("rank"), "crop_id", "x0", "y0", "x1", "y1")
    return greedy.choose_crops(ranked, "window_id", "crop_id", 12)


_TRY = [series._uniform(k, "thread_id", "attempt") for k in (11, 12, 13)]
_PLACEMENT = f"""tries AS (SELECT cast(floor(thread_id / {FILAMENT}e0) AS bigint) AS filament_id, thread_id, attempt, 60000e0 * {_TRY[0]} AS x, 7500e0 * {_TRY[1]} AS y, 20000e0 + 4000e0 * {_TRY[2]} AS z, radius_km AS radius FROM threads CROSS JOIN range(8) a(attempt)),
turn AS (SELECT *, dense_rank() OVER (PARTITION BY filament_id ORDER BY thread_id) AS k FROM tries),
walk AS (
  SELECT DISTINCT filament_id, 0::BIGINT AS k, []::STRUCT(thread_id BIGINT, attempt BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, radius DOUBLE, gap DOUBLE, accepted BOOLEAN)[] AS placed FROM tries
  UNION ALL
  SELECT filament_id, k, list_append(any_value(placed), min({{'taken': NOT free, 'late': CASE WHEN free THEN attempt::DOUBLE ELSE -gap END, 'attempt': attempt,
    'row': {{'thread_id': thread_id, 'attempt': attempt, 'x': x, 'y': y, 'z': z, 'radius': radius, 'gap': gap, 'accepted': free}}}}).row)
  FROM (SELECT t.*, w.placed, list_min(list_transform(w.placed, lambda p: sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2))) AS gap,
      len(list_filter(w.placed, lambda p: sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2) < 2.5e0 * (p.radius + t.radius))) = 0 AS free
    FROM walk w JOIN turn t ON t.filament_id = w.filament_id AND t.k = w.k + 1)
  GROUP BY filament_id, k),
ended AS (SELECT filament_id, unnest(arg_max(placed, k)) AS p FROM walk GROUP BY 1)
SELECT filament_id, p.thread_id, p.attempt, {_q('p.x')} AS x, {_q('p.y')} AS y, {_q('p.z')} AS z, {_q('p.gap')} AS gap, p.accepted FROM ended"""


@book.query("threads", sql=recursive(over(_PLACEMENT, "threads")))
def thread_placement(threads: DataFrame) -> DataFrame:
    tries = threads.select(F.floor(F.col("thread_id") / FILAMENT).alias("filament_id"), "thread_id", F.col("radius_km").alias("radius"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("attempt"))
    u = [sequences.counter_uniform(F.col("thread_id"), F.col("attempt"), stream=k) for k in (11, 12, 13)]
    made = greedy.place_threads(tries.select("*", (60_000 * u[0]).alias("x"), (7_500 * u[1]).alias("y"), (20_000 + 4_000 * u[2]).alias("z")), "filament_id", 2.5)
    return made.withColumns({c: r(F.col(c)) for c in ("x", "y", "z", "gap")})


_STREAMED = f"SELECT thread_id, frame_idx, x, y, z, longitudinal_km FROM ({series.book.oracles['brownian_walk']}) w JOIN ({thread_plans.book.oracles['oscillation_components']}) o USING (thread_id, frame_idx)"


#: When the streamed run starts, in seconds since 1970.
RUN_START = 1_700_000_000


@book.query("threads", "frames", sql=_STREAMED)
def stream_dynamics(threads: DataFrame, frames: DataFrame) -> DataFrame:
    """Displacements of all threads from a stream of steps whose frames come out of order, with state per thread."""
    spark = threads.sparkSession
    swing = thread_plans.in_motion(threads, frames).select("thread_id", "frame_idx", "time_s", F.col("lm").alias("along_km"))
    steps = series.brownian_steps(threads, frames).join(swing, ["thread_id", "frame_idx"])
    steps = steps.select("thread_id", "frame_idx", F.timestamp_seconds(F.lit(RUN_START) + F.col("time_s")).alias("ts"), "dx", "dy", "dz", "along_km")
    source, sink = (staging.shared_path(spark, n) for n in ("steps", "moved"))
    for third in range(3):
        steps.filter(F.col("frame_idx") % 3 == third).write.mode("append").parquet(source)
    starts = threads.select("thread_id", *[F.lit(0.0).alias(c) for c in "xyz"])
    # Six batches or so of a large table, as each costs a round over all state.
    files = max(16, -(-len(spark.read.parquet(source).inputFiles()) // 6))
    stream = spark.readStream.schema(dynamics.STEPS).option("maxFilesPerTrigger", files).parquet(source)
    dynamics.follow(stream, starts, sink, partitions=spark.sparkContext.defaultParallelism, late="1 day", idle="2 days")
    made = spark.read.schema(dynamics.MOVED).parquet(sink).filter("kind = 'frame'")
    return made.select("thread_id", "frame_idx", *[r(F.col(c)).alias(c) for c in "xyz"], r(F.col("along_km")).alias("longitudinal_km"))


book.queries["stream_running_stats"] = lambda spark, sf_dir: streams.running_stats(spark, sf_dir)
book.queries["stream_walk"] = lambda spark, sf_dir: streams.walk(spark, sf_dir)
book.queries["stream_windows"] = lambda spark, sf_dir: streams.late_windows(spark, sf_dir)

book.oracles["stream_running_stats"] = "SELECT event_type, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1"
book.oracles["stream_walk"] = "SELECT user_id, event_id, row_number() OVER w AS step, round(sum(value) OVER w, 6) AS position FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
book.oracles["stream_windows"] = (
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY date_trunc('hour', ts) "
    "HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"
)
