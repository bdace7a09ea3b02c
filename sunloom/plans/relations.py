"""Relations of threads, frames and pixels derived from the test tables by whole-number arithmetic.

One text serves both engines: Spark runs it over DataFrames, DuckDB as a common table expression over its views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import dealt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

FRAME = "cast(l_linenumber - 1 + 7 * cast(floor(l_orderkey / 15000e0) AS bigint) AS bigint)"
SQL = {
    "threads": """SELECT p_partkey AS thread_id, cast(1000 + (p_partkey * 7919) % 99001 AS double) AS height_km,
      cast(50000 + (p_partkey * 104729) % 200001 AS double) AS dip_radius_km, cast(20000 + (p_partkey * 15485863) % 80001 AS double) AS length_km,
      cast(75 + (p_partkey * 31) % 226 AS double) AS radius_km, cast((p_partkey * 6007) % 375000 AS double) AS x_km,
      cast((p_partkey * 9973) % 375000 AS double) AS y_km, cast(7 + (p_partkey * 17) % 37 AS double) AS pitch_deg FROM {part}""",
    "frames": "SELECT cast(n_nationkey AS bigint) AS frame_idx, cast(n_nationkey * 60 AS double) AS time_s FROM {nation}",
    # Seven frames for every 15,000 orders, so that frames grow in number with the table.
    "pixels": f"""SELECT {FRAME} AS frame_idx, l_orderkey % 64 AS row_idx, l_partkey % 64 AS col_idx,
      round(sum(l_discount), 6) AS tau, avg(l_quantity) AS intensity FROM {{lineitem}} GROUP BY 1, 2, 3""",
    "ticks": "SELECT event_id AS idx, cast(event_id * 60 + 20 * cast(floor(event_id / 17e0) AS bigint) AS double) AS t, value FROM {events}",
    "boxes": """SELECT o_orderkey AS box_id, cast((o_custkey * 37) % 1600 AS double) AS x0, cast((o_custkey * 53) % 1600 AS double) AS y0,
      cast((o_custkey * 37) % 1600 + 20 + o_orderkey % 60 AS double) AS x1, cast((o_custkey * 53) % 1600 + 20 + o_orderkey % 45 AS double) AS y1 FROM {orders}""",
    "crops": """SELECT c_custkey AS crop_id, cast((c_custkey * 41) % 1500 AS double) AS x0, cast((c_custkey * 71) % 1500 AS double) AS y0,
      cast((c_custkey * 41) % 1500 + 64 AS double) AS x1, cast((c_custkey * 71) % 1500 + 64 AS double) AS y1 FROM {customer}""",
    "detections": """SELECT s_suppkey AS box_id, cast((s_suppkey * 37) % 1600 AS double) AS x0, cast((s_suppkey * 53) % 1600 AS double) AS y0,
      cast((s_suppkey * 37) % 1600 + 20 + s_suppkey % 60 AS double) AS x1, cast((s_suppkey * 53) % 1600 + 20 + s_suppkey % 45 AS double) AS y1 FROM {supplier}""",
    "thread_points": """SELECT t.*, f.frame_idx AS idx, t.length_km * f.frame_idx / 24e0 AS s FROM {threads} t CROSS JOIN {frames} f""",
    "segments": """SELECT thread_id, x_km AS ax, y_km AS ay, height_km AS az, x_km + 2000e0 + 100e0 * pitch_deg AS bx, y_km + 50e0 * pitch_deg AS by_, height_km + 500e0 AS bz FROM {threads}""",
    "probes": """SELECT thread_id, k, x_km + (k - 1) * length_km / 4e0 AS x, y_km + (k - 1) * pitch_deg * 100e0 AS y, height_km + abs(k - 1) * 1000e0 AS z
      FROM {threads} CROSS JOIN (SELECT cast(r_regionkey AS bigint) AS k FROM {region} WHERE r_regionkey < 3) r""",
    "knots": """SELECT idx % 20 + 20 * cast(floor(idx / 10000e0) AS bigint) AS spine_id, cast(idx % 10000 * 60 + 20 * cast(floor(idx % 10000 / 17e0) AS bigint) AS double) AS s, value AS v FROM {ticks}""",
    "spine_queries": """SELECT o_orderkey AS query_id, o_orderkey % 20 + 20 * cast(floor(o_orderkey / 15000e0) AS bigint) AS spine_id, cast((o_orderkey * 37) % 700000 AS double) AS s FROM {orders}""",
    "drafts": """SELECT s_suppkey AS key, translate(CASE s_suppkey % 5
      WHEN 0 THEN concat('<"static": <"nx": ', 512 + s_suppkey % 64, ', "dip_parameterization": "dip_depth", "dip_depth_min_km": ', s_suppkey % 9, '>, "dynamics": <"seed": ', s_suppkey, ', "period": ', s_suppkey * 10, ', "center_height_km": "auto">>')
      WHEN 1 THEN concat('<"version": 1, "dynamic_background": <"crop_width_px": ', s_suppkey % 7, ', "start_index": ', s_suppkey % 11, ', "use_detector": true>, "dynamics": <"period": 3600.5>>')
      WHEN 2 THEN concat('<"version": 2, "static": <"seed": ', s_suppkey, ', "nx": false>, "dynamics": <"period": ', s_suppkey % 100, ', "oscillation_mode": "shared_period">>')
      WHEN 3 THEN concat('<"version": 3, "static": <"spine_library_length_bounds_km": [', s_suppkey % 5, ', 250.5], "odd": 1>, "dynamics": <"period_s": ', s_suppkey % 50, ', "period": 7>, "export": <"compression": "gzip">>')
      ELSE concat('<"static": <"nx": ', s_suppkey) END, '<>', concat(chr(123), chr(125))) AS body FROM {supplier}""",
    "anchors": """SELECT height_mm, temperature_k, pressure, i_value, f_value FROM {anchor_values}""",
    "modelled": """SELECT height_mm, temperature_k, pressure, i_raw, f_raw FROM {model_values}""",
}
#: Relations whose rows become many: dealt by a column, a part for so many rows of a table.
PARTS = {"threads": ("thread_id", "part", 4_000)}
#: Relations whose table is dealt by an expression before it is grouped, so that no task sums more than a part.
DEALT = {"pixels": ("lineitem", FRAME, 100_000)}
#: Bytes of files that a task deals at a time.
SPLIT = 16 << 20
_NAMES = re.compile(r"\{(\w+)\}")


def needs(*names: str) -> list[str]:
    """``names`` and what they are derived from, base tables left out, in an order in which they can be defined."""
    out: list[str] = []
    for name in names:
        if name in SQL:
            out += [n for n in needs(*_NAMES.findall(SQL[name])) if n not in out]
            if name not in out:
                out.append(name)
    return out


def bounded_splits(spark: SparkSession) -> None:
    """Splits of files of at most ``SPLIT`` bytes in this session, as a task keeps the rows that it deals; a smaller bound is kept."""
    key, unit = "spark.sql.files.maxPartitionBytes", spark._jvm.org.apache.spark.network.util.JavaUtils
    if unit.byteStringAsBytes(spark.conf.get(key)) > SPLIT:
        spark.conf.set(key, str(SPLIT))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("anchor_values", "model_values"):
        from . import anchors

        return anchors.anchor_frame(spark) if name == "anchor_values" else anchors.model_frame(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources = {n: relation(spark, sf_dir, n) for n in dict.fromkeys(_NAMES.findall(SQL[name]))}
    if name in DEALT:
        table, by, rows = DEALT[name]
        sources[table] = dealt(sources[table], F.expr(by), sources[table], rows)
        bounded_splits(spark)
    made = spark.sql(SQL[name], **sources)
    if name in PARTS:
        by, table, rows = PARTS[name]
        return dealt(made, by, relation(spark, sf_dir, table), rows)
    return made


def with_relations(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with ``names`` defined before it; ``sql`` may start with CTEs of its own, without WITH."""
    from .anchors import ANCHOR_SQL, MODEL_SQL

    chosen = needs(*names)
    parts = [f"{n} AS ({_NAMES.sub(lambda m: m[1], SQL[n])})" for n in chosen]
    if "anchors" in chosen:
        parts.insert(0, f"anchor_values AS ({ANCHOR_SQL})")
    if "modelled" in chosen:
        parts.insert(0, f"model_values AS ({MODEL_SQL})")
    return "WITH " + ",\n".join(parts) + ("\n" if sql.lstrip().upper().startswith("SELECT") else ",\n") + sql


def group_of(index: str, ways: int, rows: int = 1000) -> str:
    """A group number for both engines: ``ways`` interleaved groups for every ``ways * rows`` rows, so that groups grow in
    number with a table and not in size."""
    return f"({index} % {ways} + {ways} * cast(floor({index} / {ways * rows}e0) AS bigint))"


def rounded(expression: str, digits: int = 6) -> str:
    """Rounded in SQL without a negative zero."""
    return f"(round({expression}, {digits}) + 0e0)"
