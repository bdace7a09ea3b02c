"""Queries over records: calibration of the opacity grid, seeds, names, fingerprints, rules, histograms, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import calibrate, control, sequences
from .anchors import PRESSURES, TEMPERATURES
from .registry import Registry, r
from .relations import group_of
from .relations import rounded as q
from .relations import with_relations as over
from .threads import GRID_SQL, opacity_grid

book = Registry()

#: A model grid that the anchors calibrate: their own grid times smooth factors of height, temperature and pressure.
_RAW = f"{GRID_SQL}, raw AS (SELECT (height / 1000)::INT AS height_mm, temperature::INT AS temperature_k, press AS pressure, ion * (0.97e0 + height / 2e6) AS i_raw, pop * (1.5e0 + height / 5e5 + temperature / 1e5) AS f_raw FROM grid), fa AS (SELECT raw.*, i_value, f_value, i_value / i_raw AS c_i, f_value / f_raw AS c_f FROM raw JOIN anchors USING (height_mm, temperature_k, pressure))"
_EXT = """ex AS (SELECT r.height_mm, r.temperature_k, r.pressure, i_raw * exp(CASE WHEN r.height_mm <= 10 THEN ln(a.c_i) WHEN r.height_mm <= 20 THEN ln(a.c_i) + (ln(b.c_i) - ln(a.c_i)) * (r.height_mm - 10e0) / 10e0 WHEN r.height_mm <= 30 THEN ln(b.c_i) + (ln(c.c_i) - ln(b.c_i)) * (r.height_mm - 20e0) / 10e0 ELSE ln(c.c_i) END) AS i_value,
  f_raw * exp(CASE WHEN r.height_mm <= 10 THEN ln(a.c_f) WHEN r.height_mm <= 20 THEN ln(a.c_f) + (ln(b.c_f) - ln(a.c_f)) * (r.height_mm - 10e0) / 10e0 WHEN r.height_mm <= 30 THEN ln(b.c_f) + (ln(c.c_f) - ln(b.c_f)) * (r.height_mm - 20e0) / 10e0 ELSE ln(c.c_f) END) AS f_value
  FROM raw r JOIN (SELECT temperature_k, pressure, c_i, c_f FROM fa WHERE height_mm = 10) a USING (temperature_k, pressure) JOIN (SELECT temperature_k, pressure, c_i, c_f FROM fa WHERE height_mm = 20) b USING (temperature_k, pressure) JOIN (SELECT temperature_k, pressure, c_i, c_f FROM fa WHERE height_mm = 30) c USING (temperature_k, pressure))"""


def raw_grid(anchors: DataFrame) -> DataFrame:
    grid = opacity_grid(anchors)
    return grid.select(
        (F.col("height") / 1000).cast("int").alias("height_mm"), F.col("temperature").cast("int").alias("temperature_k"), F.col("press").alias("pressure"),
        (F.col("ion") * (0.97 + F.col("height") / 2e6)).alias("i_raw"), (F.col("pop") * (1.5 + F.col("height") / 5e5 + F.col("temperature") / 1e5)).alias("f_raw"),
    )


@book.query("anchors", sql=over(f"{_RAW} SELECT height_mm, temperature_k, pressure, {q('c_i')} AS c_i, {q('c_f')} AS c_f FROM fa", "anchors"))
def calibration_factors(anchors: DataFrame) -> DataFrame:
    return calibrate.factors(raw_grid(anchors), anchors).select(*calibrate.KEYS, r(F.col("c_i")).alias("c_i"), r(F.col("c_f")).alias("c_f"))


@book.query("anchors", sql=over(f"{_RAW}, {_EXT} SELECT height_mm, temperature_k, pressure, {q('i_value')} AS i_value, {q('f_value')} AS f_value FROM ex", "anchors"))
def calibrated_extension(anchors: DataFrame) -> DataFrame:
    return calibrate.extend(raw_grid(anchors), anchors).select(*calibrate.KEYS, r(F.col("i_value")).alias("i_value"), r(F.col("f_value")).alias("f_value"))


@book.query("anchors", sql=over(f"{_RAW}, {_EXT} SELECT height_mm, temperature_k, pressure, {q('ex.i_value - a.i_value')} AS delta_i, {q('ex.f_value - a.f_value')} AS delta_f FROM ex JOIN anchors a USING (height_mm, temperature_k, pressure)", "anchors"))
def anchor_check(anchors: DataFrame) -> DataFrame:
    return calibrate.anchor_check(calibrate.extend(raw_grid(anchors), anchors), anchors).withColumns({c: r(F.col(c)) for c in ("delta_i", "delta_f")})


@book.query(
    "anchors",
    sql=over(
        f"{_RAW}, x AS (SELECT a.height_mm AS anchor_mm, t.height_mm AS target_mm, abs((a.c_i * t.i_raw - t.i_value) / t.i_value) AS e_i, abs((a.c_f * t.f_raw - t.f_value) / t.f_value) AS e_f FROM fa a JOIN fa t USING (temperature_k, pressure) WHERE a.height_mm <> t.height_mm) "
        f"SELECT anchor_mm, target_mm, count(*) AS n, {q('100e0 * quantile_cont(e_i, 0.5)')} AS i_median, {q('100e0 * max(e_i)')} AS i_max, {q('100e0 * quantile_cont(e_f, 0.5)')} AS f_median, {q('100e0 * max(e_f)')} AS f_max FROM x GROUP BY 1, 2",
        "anchors",
    ),
)
def anchor_cross_validation(anchors: DataFrame) -> DataFrame:
    scored = calibrate.cross_validate(calibrate.factors(raw_grid(anchors), anchors))
    return scored.withColumns({c: r(F.col(c)) for c in ("i_median", "i_max", "f_median", "f_max")})


_PUBLISHED = "k AS (SELECT m.*, a.i_value, a.f_value, a.i_value / m.i_raw AS c_i, a.f_value / m.f_raw AS c_f FROM modelled m JOIN anchors a USING (height_mm, temperature_k, pressure))"


@book.query("modelled", "anchors", sql=over(f"{_PUBLISHED} SELECT height_mm, temperature_k, pressure, {q('c_i')} AS c_i, {q('c_f')} AS c_f FROM k", "modelled", "anchors"))
def published_factors(modelled: DataFrame, anchors: DataFrame) -> DataFrame:
    """Published over modelled values at the anchors, of the published model run."""
    return calibrate.factors(modelled, anchors).select(*calibrate.KEYS, r(F.col("c_i")).alias("c_i"), r(F.col("c_f")).alias("c_f"))


@book.query(
    "modelled",
    "anchors",
    sql=over(
        f"{_PUBLISHED}, x AS (SELECT a.height_mm AS anchor_mm, t.height_mm AS target_mm, abs((a.c_i * t.i_raw - t.i_value) / t.i_value) AS e_i, abs((a.c_f * t.f_raw - t.f_value) / t.f_value) AS e_f FROM k a JOIN k t USING (temperature_k, pressure) WHERE a.height_mm <> t.height_mm) "
        f"SELECT anchor_mm, target_mm, count(*) AS n, {q('100e0 * quantile_cont(e_i, 0.5)', 4)} AS i_median, {q('100e0 * max(e_i)', 4)} AS i_max, {q('100e0 * quantile_cont(e_f, 0.5)', 4)} AS f_median, {q('100e0 * max(e_f)', 4)} AS f_max FROM x GROUP BY 1, 2",
        "modelled",
        "anchors",
    ),
)
def published_cross_validation(modelled: DataFrame, anchors: DataFrame) -> DataFrame:
    """How well one anchor height predicts the others, with the published model run."""
    scored = calibrate.cross_validate(calibrate.factors(modelled, anchors))
    return scored.withColumns({c: r(F.col(c), 4) for c in ("i_median", "i_max", "f_median", "f_max")})


@book.query("anchors", sql=over(f"{GRID_SQL} SELECT (height / 1000)::DOUBLE AS height_mm, temperature AS temperature_k, press AS pressure, {q('ion')} AS i_value, {q('pop')} AS f_value FROM grid", "anchors"))
def opacity_scan(anchors: DataFrame) -> DataFrame:
    """The grid written as two wide CSV tables, scanned, checked and made long again."""
    from ..sources import opacity, staging

    grid = opacity_grid(anchors).select((F.col("height") / 1000).alias("height_mm"), "temperature", "press", "ion", "pop")
    cell = F.format_string("T%dK_p%s", F.col("temperature").cast("int"), F.col("press").cast("string"))
    names = [f"T{t}K_p{p}" for t in TEMPERATURES for p in PRESSURES]
    paths = {}
    for value in ("ion", "pop"):
        paths[value] = staging.shared_path(anchors.sparkSession, f"opacity-{value}")
        wide = grid.withColumn("cell", cell).groupBy("height_mm").pivot("cell", names).agg(F.first(value))
        staging.write_whole(wide, paths[value], "csv", header="true")
    scanned = opacity.grid(anchors.sparkSession, paths["ion"], paths["pop"], "height_mm")
    axes = {"height_mm": [float(h) for h in range(1, 101)], "temperature_k": [float(t) for t in TEMPERATURES], "pressure": list(PRESSURES)}
    return opacity.checked(scanned, axes).select(*calibrate.KEYS, r(F.col("i_value")).alias("i_value"), r(F.col("f_value")).alias("f_value"))


CELLS = [f"t{t}_p{round(p * 100)}" for t in TEMPERATURES for p in PRESSURES]


@book.query("anchors", sql=over(GRID_SQL + " SELECT (height / 1000)::INT AS height_mm, " + ", ".join(f"{q(f'avg(ion) FILTER (temperature = {t} AND round(press * 100) = {round(p * 100)})')} AS t{t}_p{round(p * 100)}" for t in TEMPERATURES for p in PRESSURES) + " FROM grid GROUP BY 1", "anchors"))
def wide_pivot(anchors: DataFrame) -> DataFrame:
    grid = opacity_grid(anchors).select((F.col("height") / 1000).cast("int").alias("height_mm"), F.col("temperature").cast("int").alias("temperature_k"), F.col("press").alias("pressure"), "ion")
    return calibrate.wide(grid, "ion", CELLS).withColumns({c: r(F.col(c)) for c in CELLS})


@book.query("anchors", sql=over(GRID_SQL + f" SELECT (height / 1000)::INT AS height_mm, 't' || temperature::INT || '_p' || round(press * 100)::INT AS cell, {q('ion')} AS ion FROM grid", "anchors"))
def long_unpivot(anchors: DataFrame) -> DataFrame:
    """The wide table back to one row per grid point."""
    return calibrate.long_form(wide_pivot(anchors), "height_mm", CELLS, "ion")


@book.query("anchors", sql=over("g AS (SELECT h, temperature_k, pressure FROM (SELECT DISTINCT height_mm AS h FROM anchors) CROSS JOIN (SELECT DISTINCT temperature_k FROM anchors) CROSS JOIN (SELECT DISTINCT pressure FROM anchors)) SELECT count(*) AS points, count(a.i_value) AS found, count(*) - count(DISTINCT (g.h, g.temperature_k, g.pressure)) AS doubled, min(i_value) AS low, max(i_value) AS high FROM g LEFT JOIN anchors a ON a.height_mm = g.h AND a.temperature_k = g.temperature_k AND a.pressure = g.pressure", "anchors"))
def grid_completeness(anchors: DataFrame) -> DataFrame:
    """Every combination of the axes is there once: the checks of a table scan."""
    axes = [anchors.select(c).distinct() for c in calibrate.KEYS]
    full = axes[0].crossJoin(F.broadcast(axes[1])).crossJoin(F.broadcast(axes[2]))
    joined = full.join(anchors, calibrate.KEYS, "left")
    return joined.agg(F.count(F.lit(1)).alias("points"), F.count("i_value").alias("found"), (F.count(F.lit(1)) - F.countDistinct(*calibrate.KEYS)).alias("doubled"), F.min("i_value").alias("low"), F.max("i_value").alias("high"))


_NAME = "p_name || ' / ' || p_brand || ' #' || p_partkey"


def _name() -> Column:
    return F.concat("p_name", F.lit(" / "), "p_brand", F.lit(" #"), F.col("p_partkey").cast("string"))


@book.query(
    "part",
    sql=f"WITH n AS (SELECT p_partkey, {_NAME} AS name FROM part) SELECT p_partkey, rtrim(left(trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '-'), 48), '-') AS slug, rtrim(left(array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', ' ', 'g')), ' +'), lambda w: w <> ''), '-'), 24), '-') AS label FROM n",
)
def slugify(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", control.slug(_name()).alias("slug"), control.run_label(_name()).alias("label"))


_JOINED = "concat_ws('|', coalesce(o_orderkey::VARCHAR, 'null'), coalesce(o_custkey::VARCHAR, 'null'), coalesce(o_orderstatus, 'null'), coalesce(o_orderpriority, 'null'))"


@book.query("orders", sql=f"SELECT o_orderkey, upper(sha256({_JOINED})) AS digest, '{{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}}' AS canonical FROM orders")
def run_fingerprint(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", control.fingerprint(*[F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]).alias("digest"), control.canonical_json(orders, ["o_orderstatus", "o_custkey"]).alias("canonical"))


def _number(text: str, start: int = 1) -> str:
    return f"(('0x' || substr(sha256({text}), {start}, 16))::UBIGINT::HUGEINT % 2147483647)::BIGINT"


_PAIR = f"'{control.PAIR_TEXT}' || o_orderkey || ':' || o_custkey"
_BACK = f"'{control.BACKGROUND_TEXT}' || o_orderkey"


@book.query("orders", sql=f"WITH s AS (SELECT o_orderkey, {_number(_PAIR)} AS a, {_number(_PAIR, 17)} AS b, {_number(_BACK)} AS c FROM orders) SELECT o_orderkey, a AS static_seed, CASE WHEN a = b THEN (b + 1) % 2147483647 ELSE b END AS dynamics_seed, CASE WHEN c = o_orderkey THEN (c + 1) % 2147483647 ELSE c END AS background_seed FROM s")
def next_seed(orders: DataFrame) -> DataFrame:
    static, dynamics = control.next_seeds(F.col("o_orderkey"), F.col("o_custkey"))
    return orders.select("o_orderkey", static.alias("static_seed"), dynamics.alias("dynamics_seed"), control.next_background_seed(F.col("o_orderkey")).alias("background_seed"))


@book.query("threads", sql=over("SELECT least(floor((height_km - 1000e0) / ((100000e0 - 1000e0) / 40e0)), 39)::BIGINT AS bin, count(*) AS n FROM threads WHERE height_km BETWEEN 1000 AND 100000 GROUP BY 1", "threads"))
def histogram_bins(threads: DataFrame) -> DataFrame:
    return control.histogram(threads, [], "height_km", 1_000.0, 100_000.0, 40)


def thread_rules() -> dict[str, Column]:
    c = F.col
    return {
        "curvature": c("length_km") <= 3.141592653589793 * c("dip_radius_km"),
        "height": c("height_km").between(1_500.0, 98_000.0),
        "length": c("length_km").between(25_000.0, 95_000.0),
        "pitch": c("pitch_deg") >= 8.0,
        "radius": (c("radius_km") > 75.0) & (c("radius_km") < 300.0),
    }


@book.query(
    "threads",
    sql=over(
        "x AS (SELECT thread_id, unnest([CASE WHEN NOT length_km <= pi() * dip_radius_km THEN 'curvature' END, CASE WHEN NOT height_km BETWEEN 1500 AND 98000 THEN 'height' END, CASE WHEN NOT length_km BETWEEN 25000 AND 95000 THEN 'length' END, CASE WHEN NOT pitch_deg >= 8 THEN 'pitch' END, CASE WHEN NOT (radius_km > 75 AND radius_km < 300) THEN 'radius' END]) AS rule FROM threads) "
        "SELECT thread_id, rule FROM x WHERE rule IS NOT NULL",
        "threads",
    ),
)
def config_rules(threads: DataFrame) -> DataFrame:
    return control.violations(threads, "thread_id", thread_rules())


@book.query("ticks", sql=over("SELECT idx % 9 AS sequence_id, count(*) AS n_frames, min(t) AS first_s, max(t) AS last_s, bool_and(isfinite(value)) AS finite, count_if(value > 50) AS bright FROM ticks WHERE idx >= 100 AND (idx - 100) % 3 = 0 GROUP BY 1", "ticks"))
def sequence_scan(ticks: DataFrame) -> DataFrame:
    """A strided scan of sequences with the checks of a header."""
    from ..sources.sequences import strided

    rows = strided(ticks.select((F.col("idx") % 9).alias("sequence_id"), F.col("idx").alias("frame_idx"), "t", "value"), 100, 3)
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return rows.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_frames"), F.min("t").alias("first_s"), F.max("t").alias("last_s"), F.bool_and(finite).alias("finite"), F.count_if(F.col("value") > 50).alias("bright"))


@book.query("events", sql="WITH l AS (SELECT user_id % 97 AS job_id, event_id, event_type AS state, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT job_id, arg_max(state, event_id) AS state, arg_max(k, event_id) AS k FROM l GROUP BY 1")
def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each job from a log of statuses."""
    log = events.select((F.col("user_id") % 97).alias("job_id"), "event_id", F.col("event_type").alias("state"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return control.latest(log, ["job_id"], "event_id").select("job_id", "state", "k")


@book.query("threads", sql=over("m AS (SELECT thread_id, upper(sha256(thread_id || ':' || x_km)) AS expected, upper(sha256(thread_id || ':' || CASE WHEN thread_id % 101 = 0 THEN x_km + 1 ELSE x_km END)) AS found FROM threads WHERE thread_id % 53 <> 0) SELECT t.thread_id, CASE WHEN m.thread_id IS NULL THEN 'missing' ELSE 'changed' END AS fault FROM threads t LEFT JOIN m USING (thread_id) WHERE m.thread_id IS NULL OR m.expected <> m.found", "threads"))
def manifest_check(threads: DataFrame) -> DataFrame:
    """Parts that a manifest names but that are missing or have another digest."""
    from ..sources.runs import manifest_faults

    text = lambda x: F.concat(F.col("thread_id").cast("string"), F.lit(":"), x.cast("string"))
    digest = lambda x: F.upper(F.sha2(text(x).cast("binary"), 256))
    manifest = threads.select("thread_id", digest(F.col("x_km")).alias("digest"))
    moved = F.when(F.col("thread_id") % 101 == 0, F.col("x_km") + 1).otherwise(F.col("x_km"))
    stored = threads.filter("thread_id % 53 <> 0").select("thread_id", digest(moved).alias("digest"))
    return manifest_faults(manifest, stored, "thread_id")


_ELEVENTHS = group_of("idx", 11)


@book.query("ticks", sql=over(f"o AS (SELECT {_ELEVENTHS} AS grp, idx AS frame_idx FROM ticks WHERE idx % 1009 <> 0), n AS (SELECT grp, frame_idx % 11000 // 11 AS k FROM o), b AS (SELECT *, lag(k) OVER (PARTITION BY grp ORDER BY k) AS p FROM n) SELECT grp, k FROM b WHERE k <> coalesce(p + 1, 0)", "ticks"))
def frame_order(ticks: DataFrame) -> DataFrame:
    """Frames an ordered writer refuses: those that don't follow their predecessor."""
    rows = ticks.filter("idx % 1009 <> 0").select(F.expr(_ELEVENTHS).alias("grp"), F.floor(F.col("idx") % 11_000 / 11).cast("long").alias("k"))
    return sequences.strictly_next(rows, ["grp"], "k")


@book.query("part", sql="SELECT array_to_string(list_sort(list_filter(['p_brand', 'p_color', 'p_name', 'p_partkey'], lambda x: NOT list_contains(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'], x))), ',') AS missing, array_to_string(list_sort(list_filter(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'], lambda x: NOT list_contains(['p_brand', 'p_color', 'p_name', 'p_partkey'], x))), ',') AS unknown, count(*) AS n FROM part")
def key_differences(part: DataFrame) -> DataFrame:
    """Names missing from and unknown to a schema."""
    missing, unknown = control.key_differences(F.array(*[F.lit(c) for c in part.columns]), ["p_brand", "p_color", "p_name", "p_partkey"])
    return part.agg(F.count(F.lit(1)).alias("n")).select(F.array_join(missing, ",").alias("missing"), F.array_join(unknown, ",").alias("unknown"), "n")


_VALUES = """v AS (SELECT thread_id, height_km - 500 AS height_mean_km, radius_km * 1.25e0 AS thread_radius_min_km, 7 + (thread_id % 9) * 1000e0 AS temp_center_K, CASE WHEN thread_id % 7 = 0 THEN 3e0 ELSE 2e0 END AS downsample_factor, (thread_id % 3) - 1e0 AS chirality,
  length_km - 5000 AS thread_length_max_km, 2 * x_km AS shortest, CASE thread_id % 4 WHEN 0 THEN 2.5e0 WHEN 1 THEN NULL ELSE 3e0 END AS entry, thread_id % 6 - 1e0 AS n_threads FROM threads)"""


def _overrides(values: dict[str, Column]) -> Column:
    """A map of text to double; a value that is null stays in it."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in values]), F.array(*[v.cast("double") for v in values.values()]))


def _with_odd(own: Column, every: int) -> Column:
    odd = F.when(F.col("thread_id") % every == 0, F.create_map(F.lit("spin"), F.lit(1.0))).otherwise(F.expr("cast(map() as map<string,double>)"))
    return F.map_concat(own, odd)


@book.query(
    "threads",
    sql=over(
        _VALUES
        + """, w AS (SELECT thread_id, unnest([CASE WHEN NOT height_mean_km BETWEEN 1000 AND 100000 THEN 'height_mean_km allowed' END, CASE WHEN NOT thread_radius_min_km <= 300 THEN 'thread_radius_min_km up to thread_radius_max_km' END, CASE WHEN NOT temp_center_K BETWEEN 6000 AND 14000 THEN 'temp_center_K allowed' END,
        CASE WHEN NOT (896 % downsample_factor = 0) THEN 'factor divides' END, CASE WHEN chirality NOT IN (-1, 1) THEN 'chirality' END, CASE WHEN thread_id % 50 = 0 THEN 'unknown: spin' END, CASE WHEN NOT 20000 <= thread_length_max_km THEN 'thread_length_min_km up to thread_length_max_km' END,
        CASE WHEN shortest <= 0 THEN 'spine_library_length_bounds_km[0] allowed' END, CASE WHEN shortest > 500000 THEN 'spine_library_length_bounds_km[0] up to spine_library_length_bounds_km[1]' END, CASE WHEN entry = 2.5 THEN 'spine_library_entry_index allowed' END, CASE WHEN n_threads < 0 THEN 'n_threads allowed' END]) AS rule FROM v)
        SELECT thread_id, rule FROM w WHERE rule IS NOT NULL""",
        "threads",
    ),
)
def experiment_rules(threads: DataFrame) -> DataFrame:
    """All rules of static configurations, one configuration per thread: defaults with a few overrides."""
    from ..sources import experiments

    i = F.col("thread_id")
    values = {
        "height_mean_km": F.col("height_km") - 500,
        "thread_radius_min_km": F.col("radius_km") * 1.25,
        "temp_center_K": 7 + (i % 9) * 1000.0,
        "downsample_factor": F.when(i % 7 == 0, 3.0).otherwise(2.0),
        "chirality": (i % 3) - 1.0,
        "thread_length_max_km": F.col("length_km") - 5000,
        "spine_library_length_bounds_km[0]": 2 * F.col("x_km"),
        "spine_library_entry_index": F.when(i % 4 == 0, 2.5).when(i % 4 > 1, 3.0),
        "n_threads": i % 6 - 1,
    }
    configs = threads.select("thread_id", _with_odd(_overrides(values), 50).alias("overrides"))
    return experiments.broken(configs, "thread_id", "overrides", experiments.STATIC, experiments.static_rules())


@book.query(
    "threads",
    sql=over(
        """v AS (SELECT thread_id, thread_id % 5 AS n_frames, thread_id % 11 * 10 - 10 AS cadence_s, thread_id % 3 AS mode, CASE thread_id % 4 WHEN 0 THEN NULL WHEN 1 THEN -5 ELSE 900 END AS across, 2 * radius_km AS step, pitch_deg / 40e0 AS fraction, CASE WHEN thread_id % 13 = 0 THEN -1 END AS height FROM threads),
        w AS (SELECT thread_id, unnest([CASE WHEN n_frames < 1 THEN 'n_frames allowed' END, CASE WHEN cadence_s <= 0 THEN 'cadence_s allowed' END, CASE WHEN mode > 1 THEN 'oscillation_mode allowed' END, CASE WHEN across <= 0 THEN 'transverse_period_s allowed' END, CASE WHEN mode = 0 AND across IS NULL THEN 'transverse period given' END,
        CASE WHEN step > 500 THEN 'brownian_step_min_km up to brownian_step_max_km' END, CASE WHEN fraction > 1 THEN 'center_spine_fraction allowed' END, CASE WHEN height < 0 THEN 'center_height_km allowed' END, CASE WHEN thread_id % 40 = 0 THEN 'unknown: spin' END]) AS rule FROM v) SELECT thread_id, rule FROM w WHERE rule IS NOT NULL""",
        "threads",
    ),
)
def dynamics_rules(threads: DataFrame) -> DataFrame:
    """All rules of dynamics configurations, one configuration per thread; what is left open is null."""
    from ..sources import experiments

    i = F.col("thread_id")
    values = {
        "n_frames": i % 5,
        "cadence_s": i % 11 * 10 - 10,
        "oscillation_mode": i % 3,
        "transverse_period_s": F.when(i % 4 == 1, -5.0).when(i % 4 > 1, 900.0),
        "brownian_step_min_km": 2 * F.col("radius_km"),
        "center_spine_fraction": F.col("pitch_deg") / 40,
        "center_height_km": F.when(i % 13 == 0, -1.0),
    }
    configs = threads.select("thread_id", _with_odd(_overrides(values), 40).alias("overrides"))
    return experiments.broken(configs, "thread_id", "overrides", experiments.DYNAMICS, experiments.dynamics_rules())


@book.query(
    "threads",
    "supplier",
    sql=over(
        """c AS (SELECT thread_id, thread_id % 1000 AS s, thread_id % 30 AS start, 1 + thread_id % 3 AS step, 5 + thread_id % 20 AS n FROM threads), h AS (SELECT s_suppkey AS s, 40 + s_suppkey % 50 AS available, 30e0 + s_suppkey % 4 * 10 AS cadence FROM supplier)
        SELECT thread_id, start + step * (n - 1) AS last_frame, available, coalesce(start + step * (n - 1) < available, false) AS fits, cadence * step AS cadence_s FROM c LEFT JOIN h USING (s)""",
        "threads",
    ),
)
def run_requests(threads: DataFrame, supplier: DataFrame) -> DataFrame:
    """Which frames each run asks of its background sequence, and whether the sequence has them."""
    from ..sources import experiments

    i = F.col("thread_id")
    values = {"dynamic_background.start_index": i % 30, "dynamic_background.frame_step": 1 + i % 3, "dynamics.n_frames": 5 + i % 20}
    configs = threads.select("thread_id", (i % 1000).cast("string").alias("background"), _overrides(values).alias("values"))
    headers = supplier.select(F.col("s_suppkey").cast("string").alias("sequence_id"), (40 + F.col("s_suppkey") % 50).alias("n_frames"), (30.0 + F.col("s_suppkey") % 4 * 10).alias("cadence_s"))
    return experiments.requests(configs, headers, "thread_id")


_DRAFTS = """p AS (SELECT key, greatest(0, least(3, coalesce(try_cast(json_extract_string(body, '$.version') AS INT), 0))) AS version, body::JSON AS body FROM drafts WHERE json_valid(body)),
s AS (SELECT p.key, version, e.key AS part, e.value AS held FROM p, json_each(p.body) e WHERE e.key <> 'version'),
n AS (SELECT s.key, version, part || '.' || e.key AS name, e.value AS held, e.type AS kind FROM s, json_each(s.held) e),
f AS (SELECT key, version, name, held, kind FROM n WHERE kind <> 'ARRAY' UNION ALL SELECT n.key, version, name || '[' || e.key || ']', e.value, e.type FROM n, json_each(n.held) e WHERE kind = 'ARRAY'),
r AS (SELECT *, CASE WHEN name = 'dynamics.period' AND version < 3 THEN 'dynamics.period_s' WHEN name IN ('static.odd', 'dynamics.period') OR name LIKE '%.dip_%' OR name LIKE '%crop_width_px' OR name LIKE '%use_detector' THEN NULL ELSE name END AS target,
  CASE WHEN name LIKE '%.dip_%' THEN 'dropped in 1' WHEN name LIKE '%crop_width_px' OR name LIKE '%use_detector' THEN 'dropped in 2' WHEN name = 'static.odd' OR name = 'dynamics.period' AND version = 3 THEN 'unknown' WHEN kind = 'BOOLEAN' THEN 'unreadable' END AS why FROM f)
SELECT key, name, CASE WHEN why IS NULL THEN target END AS target, CASE WHEN why IS NOT NULL THEN NULL WHEN kind = 'VARCHAR' THEN CASE held::VARCHAR WHEN '"shared_period"' THEN 1e0 WHEN '"gzip"' THEN 1e0 END ELSE try_cast(held AS DOUBLE) END AS value, why FROM r"""


@book.query("drafts", sql=over(_DRAFTS, "drafts"))
def draft_upgrades(docs: DataFrame) -> DataFrame:
    """Drafts of four layouts, some broken: where each parameter is today, and why others are nowhere."""
    from ..sources import drafts

    return drafts.parameters(docs).select("key", "name", "target", "value", "why")


_SCOPED = """c AS (SELECT thread_id, thread_id % 12 AS s, thread_id % 60 AS start, thread_id % 4 AS step, thread_id % 5 AS n FROM threads), h AS (SELECT s_suppkey AS s, 40 + s_suppkey % 50 AS available, 448 + s_suppkey % 2 AS width FROM supplier WHERE s_suppkey < 10),
f AS (SELECT thread_id, 'static' AS section, 'seed allowed' AS rule FROM c WHERE thread_id % 7 = 0 UNION ALL SELECT thread_id, 'dynamics', 'n_frames allowed' FROM c WHERE n = 0 UNION ALL SELECT thread_id, 'dynamic_background', 'frame_step allowed' FROM c WHERE step = 0
  UNION ALL SELECT thread_id, 'experiment', 'name' FROM c WHERE thread_id % 6 = 0),
i AS (SELECT thread_id, r.scope, r.rule FROM c LEFT JOIN h USING (s), (VALUES ('preview', 'sequence known'), ('save', 'sequence known'), ('production', 'sequence known'), ('preview', 'first frame there'), ('save', 'run fits'), ('production', 'run fits'), ('preview', 'width fits'), ('save', 'width fits'), ('production', 'width fits')) r(scope, rule)
  WHERE CASE r.rule WHEN 'sequence known' THEN available IS NULL WHEN 'first frame there' THEN start >= available WHEN 'run fits' THEN start + step * (n - 1) >= available ELSE width <> 448 END)
SELECT thread_id, scope, section, rule FROM f, (VALUES ('preview'), ('save'), ('production')) x(scope) WHERE scope <> 'preview' OR section = 'static' UNION ALL SELECT thread_id, scope, 'inputs', rule FROM i"""


@book.query("threads", "supplier", sql=over(_SCOPED, "threads"))
def scoped_rules(threads: DataFrame, supplier: DataFrame) -> DataFrame:
    """What stands in the way of a preview, of saving and of production, for configurations with faults of all kinds."""
    from ..sources import experiments

    i = F.col("thread_id")
    values = {
        "static.seed": F.when(i % 7 == 0, -1.0).otherwise(1.0),
        "dynamics.n_frames": i % 5,
        "dynamic_background.start_index": i % 60,
        "dynamic_background.frame_step": i % 4,
    }
    configs = threads.select("thread_id", F.when(i % 6 == 0, "").otherwise("a name").alias("name"), F.lit("").alias("description"), (i % 12).cast("string").alias("background"), _overrides(values).alias("values"))
    headers = supplier.filter("s_suppkey < 10").select(F.col("s_suppkey").cast("string").alias("sequence_id"), (40 + F.col("s_suppkey") % 50).alias("n_frames"), (448 + F.col("s_suppkey") % 2).alias("width"))
    parts = [experiments.scoped_faults(configs, scope, headers, "thread_id").withColumn("scope", F.lit(scope)) for scope in experiments.SCOPES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("thread_id", "scope", "section", "rule")
