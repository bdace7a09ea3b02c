"""Experiment configurations as tables: parameters, defaults, overrides and rules, checked for all experiments at once.

A configuration is a row: a name, texts, and a map of numbers by parameter. What a parameter may be is said once, in the
table of its section; the rules, the defaults and the known names all come from there.
"""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control

INF = math.inf


@dataclass(frozen=True)
class Number:
    """A parameter: its default, the closed range it may have (``above``: without its lower end), whether it is whole, and
    whether it may be left open ("auto" in files, null in tables)."""

    default: float | None
    low: float = -INF
    high: float = INF
    above: bool = False
    whole: bool = False
    auto: bool = False

    def rule(self, name: str) -> Column:
        c = F.col(f"`{name}`")
        low = c > self.low if self.above or self.low == -INF else c >= self.low
        allowed = low & ((c <= self.high) if self.high < INF else (c < INF)) & ~F.isnan(c)
        if self.whole:
            allowed = allowed & (F.floor(c) == c)
        return (c.isNull() | allowed) if self.auto else allowed


def free(default: float) -> Number:
    return Number(default)


def above_zero(default: float, high: float = INF) -> Number:
    return Number(default, 0.0, high, above=True)


def from_zero(default: float, high: float = INF) -> Number:
    return Number(default, 0.0, high)


def whole(default: float, low: float = 0.0, high: float = INF) -> Number:
    return Number(default, low, high, whole=True)


def left_open(low: float = 0.0, high: float = INF, above: bool = False, is_whole: bool = False, default: float | None = None) -> Number:
    return Number(default, low, high, above, is_whole, auto=True)


#: Texts that a section may have instead of numbers; a row holds their place in the list.
CHOICES = {"oscillation_mode": ("luna_2022_curvature", "shared_period"), "compression": ("lzf", "gzip", "none")}
#: Fixed values in these tables: names, defaults and bounds of parameters.
STATIC: dict[str, Number] = {
    # the image: size, place on the disk, instrument
    "nx": whole(896, 8), "ny": whole(896, 8), "downsample_factor": whole(2, 1), "pixel_size_km": above_zero(695_508.0 / 900 / 2),
    "disk_mu": Number(1.0, 0.05, 1.0), "limb_direction_deg": free(0.0), "orientation_deg": free(0.0),
    "psf_sigma_px": from_zero(4.0), "mask_tau_threshold": free(0.10), "seed": whole(0),
    # the line: source function, passband, wavelength
    "source_fraction": from_zero(3.22 / 6.93, 1.0), "gong_bandpass_line_fraction": from_zero(0.65, 1.0),
    "halpha_wavelength_angstrom": above_zero(6562.8), "microturbulent_velocity_kms": from_zero(5.0),
    # plasma of a thread
    "temp_center_K": Number(7_000.0, 6_000.0, 14_000.0), "temp_tr_K": above_zero(100_000.0), "pctr_gamma": above_zero(2.0),
    "ionization_center": from_zero(0.3, 1.0), "transition_pressure_dyn_cm2": above_zero(0.015), "column_mass_g_cm2": above_zero(1.0e-4),
    "foot_taper_fraction": above_zero(0.10, 0.5),
    # the filament's spine
    "spine_width_km": above_zero(7_500.0), "spine_library_entry_index": left_open(is_whole=True),
    "spine_library_length_bounds_km[0]": above_zero(60_000.0), "spine_library_length_bounds_km[1]": above_zero(500_000.0), "chirality": free(1.0),
    # its threads: how many, where, how they hang
    "n_threads": whole(0), "thread_count_cap": whole(50_000, 1), "thread_density_per_mm": above_zero(50.0), "thread_separation_radii": from_zero(2.5),
    "thread_point_spacing_km": above_zero(150.0), "thread_pitch_mean_deg": free(25.0), "thread_pitch_std_deg": from_zero(6.0),
    "height_mean_km": Number(20_000.0, 1_000.0, 100_000.0), "height_std_km": from_zero(2_000.0),
    "thread_length_min_km": above_zero(20_000.0), "thread_length_max_km": above_zero(100_000.0),
    "dip_curvature_radius_min_km": above_zero(50_000.0), "dip_curvature_radius_median_km": above_zero(100_000.0),
    "dip_curvature_radius_max_km": above_zero(250_000.0), "dip_curvature_radius_sigma_ln": from_zero(0.25),
    # a thread's width
    "thread_radius_min_km": above_zero(75.0), "thread_radius_max_km": above_zero(300.0), "endpoint_radius_floor": above_zero(0.4, 1.0),
    "width_modulation_amplitude": from_zero(0.35, 1.0), "width_modulation_correlation": above_zero(0.25),
}
DYNAMICS: dict[str, Number] = {
    "seed": whole(0), "n_frames": whole(240, 1), "cadence_s": above_zero(60.0),
    "oscillation_mode": whole(0, 0, 1), "period_s": above_zero(3_600.0), "transverse_period_s": left_open(above=True, default=1_500.0), "phase_rad": free(0.0),
    "damping_time_s": above_zero(14_400.0), "oscillation_start_time_s": from_zero(1_200.0),
    "longitudinal_displacement_amplitude_km": free(18_000.0), "transverse_displacement_amplitude_km": free(2_000.0),
    "brownian_step_min_km": from_zero(200.0), "brownian_step_max_km": from_zero(500.0),
    "half_strength_distance_km": above_zero(11_900.0), "center_spine_fraction": left_open(0.0, 1.0, default=0.55), "center_height_km": left_open(),
}
BACKGROUND: dict[str, Number] = {"seed": whole(0), "start_index": whole(0), "frame_step": whole(1, 1)}
EXPORT: dict[str, Number] = {
    "thread_mask_dilation_px": whole(5), "video_lower_percentile": from_zero(0.0, 100.0), "video_upper_percentile": from_zero(100.0, 100.0),
    "velocity_opacity_floor": from_zero(1e-6), "compression": whole(0, 0, 2), "gzip_level": whole(4, 0, 9),
}
VIDEO: dict[str, Number] = {"fps": whole(30, 1, 120), "velocity_limit_km_s": left_open(above=True), "quiver_stride_px": whole(8, 1)}
SECTIONS = {"static": STATIC, "dynamics": DYNAMICS, "dynamic_background": BACKGROUND, "export": EXPORT, "video": VIDEO}


def parameter_rules(table: dict[str, Number]) -> dict[str, Column]:
    """One rule per parameter over columns of these names; a null breaks every rule unless it may be left open."""
    return {f"{name} allowed": number.rule(name) for name, number in table.items()}


def rising(*names: str) -> dict[str, Column]:
    """Rules that each of ``names`` is not above the next."""
    return {f"{a} up to {b}": F.col(f"`{a}`") <= F.col(f"`{b}`") for a, b in zip(names, names[1:], strict=False)}


def static_rules() -> dict[str, Column]:
    c = F.col
    rules = parameter_rules(STATIC)
    rules |= rising("thread_radius_min_km", "thread_radius_max_km") | rising("thread_length_min_km", "thread_length_max_km")
    rules |= rising("dip_curvature_radius_min_km", "dip_curvature_radius_median_km", "dip_curvature_radius_max_km")
    rules |= rising("spine_library_length_bounds_km[0]", "spine_library_length_bounds_km[1]")
    rules["chirality"] = c("chirality").isin(-1.0, 1.0)
    # The shortest thread is no more than a half circle of the least radius.
    rules["arc fits"] = c("dip_curvature_radius_min_km") >= c("thread_length_min_km") / math.pi
    rules["hotter edge"] = c("temp_tr_K") > c("temp_center_K")
    side = F.least("nx", "ny")
    rules["factor divides"] = (c("nx") % c("downsample_factor") == 0) & (c("ny") % c("downsample_factor") == 0) & (c("downsample_factor") < side)
    return rules


def dynamics_rules() -> dict[str, Column]:
    return parameter_rules(DYNAMICS) | rising("brownian_step_min_km", "brownian_step_max_km") | {"transverse period given": (F.col("oscillation_mode") != 0) | F.col("transverse_period_s").isNotNull()}


def export_rules() -> dict[str, Column]:
    return parameter_rules(EXPORT) | {"percentiles rise": F.col("video_lower_percentile") < F.col("video_upper_percentile")}


def rules_of(section: str) -> dict[str, Column]:
    own = {"static": static_rules, "dynamics": dynamics_rules, "export": export_rules}
    return own[section]() if section in own else parameter_rules(SECTIONS[section])


def with_defaults(configs: DataFrame, key: str, overrides: str, table: dict[str, Number]) -> DataFrame:
    """One column per parameter of ``table``: a configuration's own value (``overrides``, map of text to double), which may
    be null where it is left open, or the default."""
    given = F.coalesce(F.col(overrides), F.expr("cast(map() as map<string,double>)"))
    value = lambda n: F.when(F.map_contains_key(given, n), F.try_element_at(given, F.lit(n))).otherwise(F.lit(table[n].default).cast("double"))
    return configs.select(key, overrides, *[value(n).alias(n) for n in table])


def unknown_keys(configs: DataFrame, key: str, overrides: str, table: dict[str, Number]) -> DataFrame:
    """(key, unknown) for overrides that name nothing."""
    return configs.select(key, F.explode(F.array_except(F.map_keys(overrides), F.array(*[F.lit(n) for n in table]))).alias("unknown"))


def broken(configs: DataFrame, key: str, overrides: str, table: dict[str, Number], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of all that is wrong with configurations, unknown names included."""
    full = with_defaults(configs, key, overrides, table)
    named = unknown_keys(configs, key, overrides, table).select(key, F.concat(F.lit("unknown: "), "unknown").alias("rule"))
    return control.violations(full, key, rules).unionByName(named)


def section(configs: DataFrame, name: str, values: str = "values") -> Column:
    """The overrides of one section of ``load``'s map, without the section's name. Two sections share the background's seed:
    without one of its own it takes that of the dynamics."""
    pick = lambda part: F.transform_keys(F.map_filter(F.col(values), lambda k, v: k.startswith(f"{part}.")), lambda k, v: F.substring_index(k, ".", -1))
    own = pick(name)
    if name != "dynamic_background":
        return own
    seed = F.map_filter(pick("dynamics"), lambda k, v: k == "seed")
    return F.when(F.map_contains_key(own, "seed"), own).otherwise(F.map_concat(F.map_filter(own, lambda k, v: k != "seed"), seed))


def faults(configs: DataFrame, key: str = "path", exact: bool = False) -> DataFrame:
    """(key, section, rule) of everything that is wrong with configurations as ``load`` gives them, all sections at once.

    ``exact``: a parameter that a section leaves to its default is missing, as in files that must name all of them.
    """
    parts = []
    for name, table in SECTIONS.items():
        own = configs.select(key, section(configs, name).alias("own"))
        found = broken(own, key, "own", table, rules_of(name))
        if exact:
            missing, _ = control.key_differences(F.map_keys("own"), list(table))
            named = F.transform(missing, lambda n: F.concat(F.lit("missing: "), n))
            found = found.unionByName(own.select(key, F.explode(named).alias("rule")))
        parts.append(found.select(key, F.lit(name).alias("section"), "rule"))
    texts = {
        "name": F.col("name").rlike("^[A-Za-z0-9][A-Za-z0-9 _-]{0,79}$"),
        "description": F.length("description") <= 500,
        "background path": F.length(F.trim("background")) > 0,
    }
    parts.append(control.violations(configs, key, texts).select(key, F.lit("experiment").alias("section"), "rule"))
    return reduce(DataFrame.unionByName, parts)


#: What each action looks at: sections, rules it leaves out, whether texts count, what its sequence must have.
SCOPES = {
    "preview": (("static", "dynamic_background"), ("frame_step allowed",), False, "first frame there"),
    "save": (tuple(SECTIONS), (), True, "run fits"),
    "production": (tuple(SECTIONS), (), True, "run fits"),
}


def scoped_faults(configs: DataFrame, scope: str, headers: DataFrame | None = None, key: str = "path") -> DataFrame:
    """(key, section, rule) of what stands in the way of one action with configurations as ``load`` gives them.

    A preview shows the first frame, so it asks nothing of dynamics, export, video, texts or the spacing of later frames; a
    draft is saved, and a run produced, only if all of it is right. ``headers`` (sequence_id, n_frames, and height and width
    where they are known) are the sequences there are: a background must be one of them, have the frames that the action
    reads, and the size of the image. Saving may go without them, production not.
    """
    sections, left_out, texts, frames = SCOPES[scope]
    if scope == "production" and headers is None:
        raise ValueError("production needs the sequences that there are")
    named = faults(configs, key).filter(F.col("section").isin(*sections) | (F.col("section") == "experiment"))
    named = named.filter(~F.col("rule").isin(*left_out)) if left_out else named
    if not texts:
        named = named.filter((F.col("section") != "experiment") | (F.col("rule") == "background path"))
    if headers is None:
        return named
    asked = with_defaults(configs.select(key, "background", section(configs, "dynamic_background").alias("own")), key, "own", BACKGROUND).drop("own", "seed")
    size = with_defaults(configs.select(key, section(configs, "static").alias("own")), key, "own", STATIC).select(key, "nx", "ny", "downsample_factor")
    run = with_defaults(configs.select(key, section(configs, "dynamics").alias("own")), key, "own", DYNAMICS).select(key, F.col("n_frames").alias("wanted"))
    full = asked.join(size, key).join(run, key).join(configs.select(key, F.col("background").alias("sequence_id")), key)
    full = full.join(headers.withColumn("__there", F.lit(True)), "sequence_id", "left")
    there, last = F.col("__there").isNotNull(), F.col("start_index") + F.col("frame_step") * (F.col("wanted") - 1)
    rules = {"sequence known": there, frames: ~there | ((F.col("start_index") if frames == "first frame there" else last) < F.col("n_frames"))}
    for side, pixels in (("width", "nx"), ("height", "ny")):
        if side in headers.columns:
            rules[f"{side} fits"] = ~there | (F.floor(F.col(pixels) / F.col("downsample_factor")) == F.col(side))
    return named.unionByName(control.violations(full, key, rules).select(key, F.lit("inputs").alias("section"), "rule"))


def requests(configs: DataFrame, headers: DataFrame, key: str = "path") -> DataFrame:
    """(key, last_frame, available, fits, cadence_s): what each configuration asks of its background sequence.

    ``headers``: sequence_id, n_frames, cadence_s. A configuration's background names a sequence; frames are read from
    ``start_index`` in steps of ``frame_step``, which also stretches the cadence. Without such a sequence nothing fits.
    """
    asked = with_defaults(configs.select(key, "background", section(configs, "dynamic_background").alias("own")), key, "own", BACKGROUND).drop("own", "seed")
    run = with_defaults(configs.select(key, section(configs, "dynamics").alias("own")), key, "own", DYNAMICS).select(key, "n_frames")
    named = asked.join(run, key).join(configs.select(key, F.col("background").alias("sequence_id")), key)
    joined = named.withColumnRenamed("n_frames", "wanted").join(headers.select("sequence_id", "n_frames", "cadence_s"), "sequence_id", "left")
    last = (F.col("start_index") + F.col("frame_step") * (F.col("wanted") - 1)).cast("long")
    return joined.select(key, last.alias("last_frame"), F.col("n_frames").alias("available"), F.coalesce(last < F.col("n_frames"), F.lit(False)).alias("fits"), (F.col("cadence_s") * F.col("frame_step")).alias("cadence_s"))


LOADED = "name string, description string, background string, values map<string,double>, error string"


def load(spark: SparkSession, glob: str) -> DataFrame:
    """Configurations of TOML files: path, name, description, background, values (all sections' numbers as
    section.parameter), and error for files that can't be parsed.

    "auto" is a null value, a choice its place in CHOICES, a pair of numbers two parameters; what is no number otherwise
    (true, other texts) is NaN and breaks its rule. Files are read by Spark and parsed in tasks, a few kilobytes each.
    """
    parsed = F.udf(_parse, LOADED)
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parsed("value").alias("p"))
    return files.select("path", "p.*").orderBy(F.col("path").desc())


def _number(name: str, value: object) -> float | None:
    if isinstance(value, bool):
        return math.nan
    if isinstance(value, int | float):
        return float(value)
    if value == "auto":
        return None
    return float(CHOICES[name].index(value)) if value in CHOICES.get(name, ()) else math.nan


def _parse(text: str) -> tuple[str | None, str | None, str | None, dict[str, float | None] | None, str | None]:
    try:
        made = tomllib.loads(text)
        values: dict[str, float | None] = {}
        for part in made.keys() - {"experiment", "inputs"}:
            for name, value in made[part].items():
                if isinstance(value, list):
                    filled = [*value, *[math.nan] * (2 - len(value))]
                    values |= {f"{part}.{name}[{k}]": _number(name, v) for k, v in enumerate(filled)}
                else:
                    values[f"{part}.{name}"] = _number(name, value)
        about, inputs = made.get("experiment", {}), made.get("inputs", {})
        return about.get("name"), about.get("description", ""), inputs.get("h5_background_path", ""), values, None
    except (tomllib.TOMLDecodeError, AttributeError) as error:
        return None, None, None, None, str(error)


def toml(configs: DataFrame) -> Column:
    """The text of a configuration file, by Columns alone: only what a configuration sets itself."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))

    def number(name: str, value: Column) -> Column:
        plain = F.when(value.isNull(), F.lit('"auto"')).when(F.isnan(value), F.lit("nan")).otherwise(F.lower(value.cast("string")))
        if name in CHOICES:
            return F.concat(F.lit('"'), F.element_at(F.array(*[F.lit(x) for x in CHOICES[name]]), value.cast("int") + 1), F.lit('"'))
        return plain

    parts = [F.concat(F.lit("[experiment]\nname = "), quoted(F.col("name")), F.lit("\ndescription = "), quoted(F.col("description")), F.lit("\n[inputs]\nh5_background_path = "), quoted(F.col("background")))]
    for part, table in SECTIONS.items():
        lines = []
        for name in table:
            here = lambda n, part=part: F.try_element_at("values", F.lit(f"{part}.{n}"))
            given = F.map_contains_key("values", f"{part}.{name}")
            if name.endswith("[0]"):
                base = name[:-3]
                line = F.concat(F.lit(f"{base} = ["), number(base, here(name)), F.lit(", "), number(base, here(f"{base}[1]")), F.lit("]"))
            elif name.endswith("[1]"):
                continue
            else:
                line = F.concat(F.lit(f"{name} = "), number(name, here(name)))
            lines.append(F.when(given, line))
        parts.append(F.concat_ws("\n", F.lit(f"[{part}]"), *lines))
    return F.concat_ws("\n", *parts, F.lit(""))


def save(configs: DataFrame, path: str) -> None:
    """One TOML file a configuration, in a folder of its name's slug below ``path``; an existing ``path`` is an error."""
    rows = configs.select(control.slug(F.col("name")).alias("slug"), toml(configs).alias("value"))
    rows.repartition("slug").write.mode("errorifexists").partitionBy("slug").text(path)


def clone(configs: DataFrame, suffix: str = " copy") -> DataFrame:
    """Configurations of finished runs as drafts: a name of their own, parameters that no section knows left out."""
    known = F.array(*[F.lit(f"{part}.{name}") for part, table in SECTIONS.items() for name in table])
    return configs.withColumn("name", F.concat(F.substring("name", 1, 80 - len(suffix)), F.lit(suffix))).withColumn("values", F.map_filter("values", lambda k, v: F.array_contains(known, k)))


def fingerprint(configs: DataFrame, key: str, overrides: str, table: dict[str, Number]) -> DataFrame:
    """(key, digest) of effective values, the same however defaults and overrides are split."""
    full = with_defaults(configs, key, overrides, table)
    return full.select(key, F.upper(F.sha2(control.canonical_json(full, sorted(table)).cast("binary"), 256)).alias("digest"))


def simulation_id(utc: Column, seed: Column, digest: Column, label: Column) -> Column:
    """sim-<time>-s<seed>-<ten digits of the digest>[-label]."""
    return F.concat_ws("-", F.lit("sim"), F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'"), F.concat(F.lit("s"), seed.cast("string")), F.lower(F.substring(digest, 1, 10)), F.nullif(label, F.lit("")))


def effective(configs: DataFrame, key: str, overrides: str) -> DataFrame:
    """Field of view in km, the detector's pixels, and the table's temperatures: what follows from static parameters alone."""
    full = with_defaults(configs, key, overrides, STATIC)
    domain = STATIC["temp_center_K"]
    return full.select(
        key,
        (F.col("nx") * F.col("pixel_size_km")).alias("image_width_km"),
        (F.col("ny") * F.col("pixel_size_km")).alias("image_height_km"),
        F.floor(F.col("nx") / F.col("downsample_factor")).alias("native_nx"),
        F.floor(F.col("ny") / F.col("downsample_factor")).alias("native_ny"),
        F.lit(domain.low).alias("temperature_low_K"),
        F.lit(domain.high).alias("temperature_high_K"),
    )
