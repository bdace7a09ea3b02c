"""Published anchors of the opacity table and the grid that a rule makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEMPERATURES, PRESSURES, HEIGHTS = (6000, 8000, 10000, 12000, 14000), (0.01, 0.02, 0.05, 0.10, 0.20), (10, 20, 30)
#: Published ionization degree and f (1e16 per cm^3), by height; lines are temperatures, columns pressures.
IONIZATION = {
    10: [
        0.74, 0.62, 0.44, 0.31, 0.20,
        0.83, 0.72, 0.55, 0.44, 0.35,
        0.87, 0.79, 0.70, 0.69, 0.73,
        0.91, 0.85, 0.82, 0.85, 0.89,
        0.93, 0.89, 0.89, 0.92, 0.94,
    ],
    20: [
        0.73, 0.60, 0.41, 0.29, 0.18,
        0.81, 0.70, 0.52, 0.41, 0.33,
        0.86, 0.78, 0.68, 0.68, 0.72,
        0.90, 0.84, 0.81, 0.84, 0.88,
        0.92, 0.88, 0.89, 0.91, 0.94,
    ],
    30: [
        0.71, 0.58, 0.39, 0.27, 0.17,
        0.80, 0.68, 0.50, 0.39, 0.32,
        0.85, 0.76, 0.66, 0.67, 0.71,
        0.89, 0.83, 0.81, 0.84, 0.88,
        0.92, 0.88, 0.88, 0.91, 0.93,
    ],
}
POPULATION = {
    10: [
        5.0, 4.6, 4.2, 4.0, 4.0,
        6.7, 5.8, 5.0, 4.8, 4.7,
        8.1, 6.8, 5.3, 5.1, 5.3,
        9.1, 7.0, 5.0, 4.9, 5.2,
        9.8, 7.1, 4.9, 4.8, 5.0,
    ],
    20: [
        4.7, 4.2, 3.8, 3.7, 3.6,
        6.3, 5.4, 4.6, 4.4, 4.3,
        7.6, 6.3, 4.8, 4.7, 4.9,
        8.6, 6.5, 4.6, 4.5, 4.8,
        9.2, 6.4, 4.5, 4.4, 4.6,
    ],
    30: [
        4.5, 4.0, 3.5, 3.4, 3.4,
        6.1, 5.1, 4.3, 4.0, 4.0,
        7.4, 6.0, 4.5, 4.3, 4.5,
        8.3, 6.1, 4.2, 4.2, 4.5,
        8.9, 6.0, 4.2, 4.1, 4.3,
    ],
}
#: What a radiative transfer model gave at the same points, which calibration holds against the published ones.
MODEL_IONIZATION = {
    10: [
        0.7450262, 0.6127554, 0.3787352, 0.2289693, 0.1334173,
        0.8223492, 0.7161191, 0.5226418, 0.3782694, 0.2929293,
        0.8679491, 0.7944467, 0.7193653, 0.7230123, 0.7377952,
        0.9009081, 0.8578532, 0.853861, 0.8804072, 0.90458,
        0.9260625, 0.9040099, 0.9162805, 0.9359237, 0.9518653,
    ],
    20: [
        0.7245261, 0.5849716, 0.351716, 0.2114355, 0.1232655,
        0.8060361, 0.6929201, 0.4938321, 0.3564123, 0.2785216,
        0.8551191, 0.7775998, 0.7049608, 0.7129956, 0.7283173,
        0.8913432, 0.8474484, 0.8480431, 0.8766794, 0.9015843,
        0.9191932, 0.8978955, 0.9132131, 0.9339198, 0.950384,
    ],
    30: [
        0.7050384, 0.5591645, 0.3286269, 0.1968667, 0.1148663,
        0.790208, 0.6709617, 0.4682078, 0.3378848, 0.2663336,
        0.8426386, 0.7616555, 0.6920579, 0.7039552, 0.7196414,
        0.8820881, 0.8377903, 0.8428075, 0.87327, 0.8988045,
        0.9126032, 0.8923235, 0.9104314, 0.9320814, 0.9490151,
    ],
}
MODEL_POPULATION = {
    10: [
        7.666261, 6.900345, 6.397346, 6.272836, 6.234426,
        9.736209, 8.820663, 8.118795, 7.903999, 7.847242,
        10.93515, 9.711724, 8.772711, 8.907848, 9.329581,
        11.71019, 9.659494, 8.211894, 8.347855, 9.050827,
        12.8033, 10.11698, 8.463228, 8.476193, 9.05295,
    ],
    20: [
        7.257334, 6.481899, 5.985467, 5.87594, 5.839993,
        9.302819, 8.316254, 7.591488, 7.390649, 7.337869,
        10.47552, 9.13382, 8.192089, 8.335857, 8.724643,
        11.17471, 9.029327, 7.66382, 7.818505, 8.487895,
        12.16392, 9.427498, 7.900207, 7.936749, 8.489966,
    ],
    30: [
        6.8968, 6.120812, 5.63792, 5.54134, 5.507597,
        8.917935, 7.874943, 7.143832, 6.959129, 6.91018,
        10.05947, 8.626494, 7.700813, 7.854564, 8.216384,
        10.68538, 8.480489, 7.20312, 7.373805, 8.015077,
        11.58078, 8.833012, 7.427687, 7.484049, 8.01773,
    ],
}


def rows() -> list[tuple[int, int, float, float, float]]:
    keys = [(h, t, p) for h in HEIGHTS for t in TEMPERATURES for p in PRESSURES]
    i = [x for h in HEIGHTS for x in IONIZATION[h]]
    f = [x for h in HEIGHTS for x in POPULATION[h]]
    return [(*k, a, b) for k, a, b in zip(keys, i, f, strict=True)]


def model_rows() -> list[tuple[int, int, float, float, float]]:
    i = [x for h in HEIGHTS for x in MODEL_IONIZATION[h]]
    f = [x for h in HEIGHTS for x in MODEL_POPULATION[h]]
    return [(*k[:3], a, b) for k, a, b in zip(rows(), i, f, strict=True)]


SCHEMA = "height_mm int, temperature_k int, pressure double, i_value double, f_value double"
MODEL_SCHEMA = SCHEMA.replace("i_value", "i_raw").replace("f_value", "f_raw")


def _values(points: list[tuple], schema: str) -> str:
    """The points as a SELECT for DuckDB."""
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    return "SELECT * FROM (VALUES " + ", ".join(f"({h}, {t}, {p!r}::double, {i!r}::double, {f!r}::double)" for h, t, p, i, f in points) + f") v({names})"


ANCHOR_SQL, MODEL_SQL = _values(rows(), SCHEMA), _values(model_rows(), MODEL_SCHEMA)


def anchor_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def model_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(model_rows(), MODEL_SCHEMA)
