"""Drafts of older layouts as JSON documents: every parameter a row, led by a table of steps to where it belongs today.

A step says what a version changed: a parameter dropped, renamed, or new with a default. Steps fold into routes, one for each
version and name; documents of all versions are taken apart into rows by variants, and one join with the routes upgrades
them all. What has no place today is listed with the reason, nothing is lost without a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .experiments import CHOICES, SECTIONS, Number


@dataclass(frozen=True)
class Step:
    """What ``version`` did to ``name``: "drop", "rename" (``to`` another name), or "fill" (a default that is the ``value``
    or, with ``to``, what that parameter has)."""

    version: int
    kind: str
    name: str
    to: str | None = None
    value: float | None = None


#: Fixed names: parameters that drafts once had, and those that came instead.
STEPS = [
    *[Step(1, "drop", f"static.{n}") for n in ("dip_parameterization", "dip_depth_min_km", "dip_depth_max_km", "dip_depth_median_km", "dip_depth_sigma_ln")],
    *[Step(1, "fill", f"static.dip_curvature_radius_{n}", value=SECTIONS["static"][f"dip_curvature_radius_{n}"].default) for n in ("min_km", "median_km", "max_km", "sigma_ln")],
    *[Step(2, "drop", f"dynamic_background.{n}") for n in ("crop_height_px", "crop_width_px", "random_attempts", "use_detector", "detection_threshold", "box_expand_fraction", "box_expand_px")],
    Step(2, "fill", "dynamic_background.seed", to="dynamics.seed"),
    Step(3, "rename", "dynamics.period", to="dynamics.period_s"),
    Step(3, "fill", "dynamics.transverse_period_s", to="dynamics.period_s"),
]


def known(sections: dict[str, dict[str, Number]] = SECTIONS) -> list[str]:
    return [f"{part}.{name}" for part, table in sections.items() for name in table]


def routes(steps: list[Step], names: list[str]) -> list[tuple[int, str, str | None, str | None]]:
    """(version, name, target, why): where a name of a version leads today; without a target, why it leads nowhere."""
    now: dict[str, tuple[str | None, str | None]] = {n: (n, None) for n in names}
    newest = max((s.version for s in steps), default=0)
    out = []
    for version in range(newest, -1, -1):
        out += [(version, name, *led) for name, led in sorted(now.items())]
        # What this version did is undone for those before it.
        for step in reversed([s for s in steps if s.version == version]):
            if step.kind == "drop":
                now[step.name] = (None, f"dropped in {version}")
            elif step.kind == "rename":
                now[step.name] = now.pop(step.to)
    return out


def parameters(docs: DataFrame, steps: list[Step] = STEPS, sections: dict[str, dict[str, Number]] = SECTIONS) -> DataFrame:
    """One row per parameter of ``docs`` (key, body: JSON): key, version, name, target, value, why.

    ``target`` is the name today and ``value`` its number ("auto" and null are open, a choice is its place in CHOICES, a list
    is a parameter for each place). ``why`` says what stands in the way: "dropped in n", "unknown", "unreadable" (a text, a
    truth value, an object), "replaced" (an old name beside the new one); such a row has no target. A version above the
    newest counts as that. Documents that can't be parsed have no rows.
    """
    spark, newest = docs.sparkSession, max((s.version for s in steps), default=0)
    parsed = docs.select("key", F.try_parse_json("body").alias("v"))
    version = F.coalesce(F.try_variant_get("v", "$.version", "int"), F.lit(0))
    parsed = parsed.select("key", F.greatest(F.lit(0), F.least(version, F.lit(newest))).alias("version"), "v")
    parts = _exploded(parsed, "v").filter(F.col("at").isNotNull() & (F.col("at") != "version")).select("key", "version", F.col("at").alias("part"), "held")
    named = _exploded(parts, "held", "part").filter("at is not null").select("key", "version", F.concat("part", F.lit("."), "at").alias("name"), "held")
    # A list becomes a row for each place.
    listed = F.schema_of_variant("held").startswith("ARRAY")
    places = _exploded(named.filter(listed), "held", "name", place=True).select("key", "version", F.concat("name", F.lit("["), F.col("place").cast("string"), F.lit("]")).alias("name"), "held")
    flat = named.filter(~listed | F.col("held").isNull()).unionByName(places)
    kind, text = F.schema_of_variant("held"), F.try_variant_get("held", "$", "string")
    choices = spark.createDataFrame([(f"{part}.{n}", c, float(k)) for part, table in sections.items() for n in table for k, c in enumerate(CHOICES.get(n, ()))] or [("", "", 0.0)], "target string, choice string, place double")
    led = spark.createDataFrame(routes(steps, known(sections)), "version int, name string, target string, why string")
    # Both tables are as large as the tables of parameters, not as the documents.
    met = flat.join(F.broadcast(led), ["version", "name"], "left").withColumn("choice", F.when(kind == "STRING", text))
    met = met.join(F.broadcast(choices), ["target", "choice"], "left")
    numeric = kind.rlike("^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT|TINYINT|SMALLINT)")
    left_open = F.coalesce(kind == "VOID", F.lit(False)) | F.coalesce(F.col("choice") == "auto", F.lit(False))
    readable = numeric | left_open | F.col("place").isNotNull()
    value = F.when(numeric, F.try_variant_get("held", "$", "double")).otherwise(F.col("place"))
    why = F.when(F.col("target").isNull(), F.coalesce("why", F.lit("unknown"))).when(~readable, "unreadable")
    found = met.select("key", "version", "name", "target", value.alias("value"), why.alias("why"))
    best = F.row_number().over(Window.partitionBy("key", "target").orderBy((F.col("name") == F.col("target")).desc(), "name"))
    ranked = found.withColumn("__k", F.when(F.col("why").isNull(), best))
    late = F.col("why").isNull() & (F.col("__k") > 1)
    why = F.when(late, "replaced").otherwise(F.col("why"))
    return ranked.select("key", "version", "name", F.when(why.isNull(), F.col("target")).alias("target"), F.when(why.isNull(), F.col("value")).alias("value"), why.alias("why"))


def _exploded(rows: DataFrame, column: str, *more: str, place: bool = False) -> DataFrame:
    """key, version, ``more``, the name (or ``place``) of each member of a variant, and what it holds."""
    members = rows.sparkSession.tvf.variant_explode(F.col(column).outer())
    held = rows.lateralJoin(members.select(F.col("pos").alias("place"), F.col("key").alias("at"), F.col("value").alias("member")))
    return held.select("key", "version", *more, "place", "at", F.col("member").alias("held"))


def upgrade(docs: DataFrame, steps: list[Step] = STEPS, sections: dict[str, dict[str, Number]] = SECTIONS) -> DataFrame:
    """One row per document: key, ``values`` (parameters set, with those that steps fill in), ``lost`` (name, why), broken.

    Parameters that no step fills have the defaults of their table when they are read; they are not written here.
    """
    rows = parameters(docs, steps, sections)
    entry, loss = F.struct("target", "value"), F.struct("name", "why")
    held = rows.groupBy("key").agg(
        F.sort_array(F.collect_list(F.when(F.col("why").isNull(), entry))).alias("entries"),
        F.sort_array(F.collect_list(F.when(F.col("why").isNotNull(), loss))).alias("lost"),
    )
    values: Column = F.map_from_entries("entries")
    for step in (s for s in steps if s.kind == "fill"):
        given = F.lit(step.value).cast("double") if step.to is None else F.try_element_at("values", F.lit(step.to))
        absent = ~F.map_contains_key("values", step.name)
        filled = F.map_concat("values", F.create_map(F.lit(step.name), given))
        held = (held if "values" in held.columns else held.withColumn("values", values)).withColumn("values", F.when(absent & given.isNotNull(), filled).otherwise(F.col("values")))
    if "values" not in held.columns:
        held = held.withColumn("values", values)
    every = docs.select("key", F.try_parse_json("body").isNull().alias("broken"))
    out = every.join(held.drop("entries"), "key", "left")
    empty_values, empty_lost = F.create_map().cast("map<string,double>"), F.array().cast("array<struct<name:string,why:string>>")
    return out.select("key", F.coalesce("values", empty_values).alias("values"), F.coalesce("lost", empty_lost).alias("lost"), "broken")
