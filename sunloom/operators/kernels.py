"""Iterative work that has no form as Columns: numpy bodies run per group or row by Spark, one small group at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plasma import BOLTZMANN, GRAVITY, HELIUM, HYDROGEN

# --- column-mass loading ---------------------------------------------------------------------------------------------

#: Relative and absolute tolerance of the integral, of the target, least and most intervals, halvings at most.
INTEGRAL, ABSOLUTE, TARGET, INTERVALS, HALVINGS = 2e-5, 1e-14, 1e-4, (16, 8192), 64
#: Threads that are halved together: a few arrays of so many rows by half the most intervals.
TOGETHER = 256


def running_simpson(y: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Integral from the first of evenly spaced samples to each, along the last axis; ``h`` is a step per row."""
    steps = np.zeros_like(y)
    h = np.asarray(h)[..., None]
    ahead = h / 12 * (5 * y[..., :-2] + 8 * y[..., 1:-1] - y[..., 2:])
    behind = h / 12 * (-y[..., :-2] + 8 * y[..., 1:-1] + 5 * y[..., 2:])
    steps[..., 1:-1:2] = ahead[..., ::2]
    steps[..., 2::2] = behind[..., ::2]
    if y.shape[-1] % 2 == 0:
        steps[..., -1] = behind[..., -1]
    return np.cumsum(steps, axis=-1)


def half_mass(share: np.ndarray, n: int, length: np.ndarray, radius: np.ndarray, plasma: dict[str, float]) -> np.ndarray:
    """Column mass of dips filled to ``share`` of their half length, on ``n`` intervals; both halves are alike."""
    loaded = share * length / 2
    part = np.linspace(1.0, 0.0, n // 2 + 1)  # from the edge to the middle
    s = loaded[:, None] * part
    temp = plasma["centre"] + (plasma["edge"] - plasma["centre"]) * part ** plasma["power"]
    cool = np.clip((plasma["edge"] - temp) / (plasma["edge"] - plasma["centre"]), 0, 1)
    mass = (1 + 4 * HELIUM) / (1 + HELIUM + 1 - (1 - plasma["ionized"]) * cool**2)
    growth = mass * HYDROGEN * GRAVITY * 1e5 / (BOLTZMANN * temp) * np.sin(s / radius[:, None])
    step = loaded / (n // 2)
    pressure = plasma["pressure"] * np.exp(running_simpson(growth, step))
    density = mass * HYDROGEN * pressure / (BOLTZMANN * temp)
    return 2e5 * step / 3 * (density[:, 0] + density[:, -1] + 4 * density[:, 1:-1:2].sum(axis=1) + 2 * density[:, 2:-1:2].sum(axis=1))


def settled_mass(share: np.ndarray, length: np.ndarray, radius: np.ndarray, plasma: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mass, intervals, and whether two doublings in a row changed it no more than the tolerance, for all rows at once."""
    mass, n, good = np.full(len(share), np.nan), np.full(len(share), INTERVALS[0]), np.zeros(len(share), bool)
    agreed, left, k = np.zeros(len(share), np.int64), np.arange(len(share)), INTERVALS[0]
    while len(left):
        fresh = half_mass(share[left], k, length[left], radius[left], plasma)
        with np.errstate(invalid="ignore"):
            same = np.abs(fresh - mass[left]) <= np.maximum(ABSOLUTE, INTEGRAL * np.abs(fresh))
        agreed[left] = np.where(same, agreed[left] + 1, 0)
        mass[left], n[left] = fresh, k
        good[left] = agreed[left] == 2
        left = left[~good[left]]
        if k == INTERVALS[1]:
            break
        k *= 2
    return mass, n, good


def load(length: np.ndarray, radius: np.ndarray, wanted: float, plasma: dict[str, float]) -> tuple[np.ndarray, ...]:
    """Share loaded, mass, capacity, status, intervals and halvings of each thread; all are halved together.

    A dip that can't hold the mass is full and "capacity_limited"; what does not settle is "numerical_failure", with the
    last state. Threads that are no arc (longer than a semicircle, not positive) are "invalid".
    """
    total = len(length)
    share, mass, capacity = (np.full(total, np.nan) for _ in range(3))
    status, intervals, halvings = np.full(total, "invalid", dtype=object), np.zeros(total, np.int64), np.zeros(total, np.int64)
    arcs = (length > 0) & (radius > 0) & (length <= math.pi * radius) & (wanted > 0)
    at = np.flatnonzero(arcs)
    if not len(at):
        return share, mass, capacity, status, intervals, halvings
    share[at] = 1.0
    capacity[at], intervals[at], good = settled_mass(share[at], length[at], radius[at], plasma)
    mass[at] = capacity[at]
    status[at] = np.where(~good, "numerical_failure", np.where(capacity[at] < wanted * (1 - TARGET), "capacity_limited", "converged"))
    at = at[good & (capacity[at] > wanted)]
    low, high = np.zeros(total), np.ones(total)
    status[at] = "numerical_failure"
    for k in range(1, HALVINGS + 1):
        if not len(at):
            break
        share[at] = (low[at] + high[at]) / 2
        mass[at], intervals[at], good = settled_mass(share[at], length[at], radius[at], plasma)
        halvings[at] = k
        done = good & (np.abs(mass[at] - wanted) <= TARGET * wanted)
        status[at[done]] = "converged"
        at = at[good & ~done]
        less = mass[at] < wanted
        low[at[less]], high[at[~less]] = share[at[less]], share[at[~less]]
    return share, mass, capacity, status, intervals, halvings


PLASMA = {"centre": 7_000.0, "edge": 100_000.0, "power": 2.0, "ionized": 0.3, "pressure": 0.015}


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most ``rows`` rows each."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def column_mass_loading(threads: DataFrame, wanted: float = 1e-4, plasma: dict[str, float] = PLASMA) -> DataFrame:
    """thread_id, loaded_share, mass, capacity, status, intervals, halvings of threads (length_km, dip_radius_km)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, TOGETHER):
            made = load(rows.column("length_km").to_numpy(zero_copy_only=False), rows.column("dip_radius_km").to_numpy(zero_copy_only=False), wanted, plasma)
            kinds = [pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("thread_id"), *columns], names=["thread_id", "loaded_share", "mass", "capacity", "status", "intervals", "halvings"])

    schema = "thread_id long, loaded_share double, mass double, capacity double, status string, intervals long, halvings long"
    # A thread is a few numbers and milliseconds of work: spread them over all cores, whatever the table's files.
    cores = max(threads.sparkSession.sparkContext.defaultParallelism, int(threads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return threads.select("thread_id", "length_km", "dip_radius_km").repartition(cores, "thread_id").mapInArrow(run, schema)


# --- damped sines ----------------------------------------------------------------------------------------------------

SINE = ("equilibrium", "drift", "amplitude", "period", "damping", "phase")
#: Fewest points of a fit, decays over the whole span that are tried first, samples a cycle and a step of the search.
LEAST_POINTS, DECAYS, SAMPLES_A_CYCLE, STEPS_A_CYCLE = 12, (0.0, 0.3, 1.0, 3.0, 9.0), 3, 8
TRIED_AT_ONCE = 64


def sine(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    return p[0] + p[1] * t + p[2] * np.exp(-t / p[4]) * np.sin(2 * np.pi * t / p[3] + p[5])


def sine_slopes(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Derivatives of ``sine`` by each parameter, one a column."""
    wave = p[2] * np.exp(-t / p[4]) * np.exp(1j * (2 * np.pi * t / p[3] + p[5]))
    return np.column_stack([np.ones_like(t), t, wave.imag / p[2], -2 * np.pi * t / p[3] ** 2 * wave.real, t / p[4] ** 2 * wave.imag, wave.real])


def linear_part(t: np.ndarray, y: np.ndarray, w: np.ndarray, wave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level, slope, sine and cosine that fit best for each ``wave`` (a row of exp((2 pi i cycles - decay) t)), and their misfits."""
    basis = np.empty((len(wave), 4, len(t)))
    basis[:, 0], basis[:, 1], basis[:, 2], basis[:, 3] = 1, t, wave.imag, wave.real
    # Products of matrices: sums over three factors at once take many times as long.
    normal = (basis * w) @ basis.transpose(0, 2, 1) + 1e-13 * len(t) * np.eye(4)
    found = np.linalg.solve(normal, (basis @ (w * y))[..., None])[..., 0]
    left = y - (found[:, None] @ basis)[:, 0]
    # A second pass on what is left takes back what the normal equations lose in digits.
    found += np.linalg.solve(normal, basis @ (w * left)[..., None])[..., 0]
    left = y - (found[:, None] @ basis)[:, 0]
    return found, (w * left**2).sum(axis=1)


def fit_sine(t: np.ndarray, y: np.ndarray, robust: bool = True, periods: tuple[float, float] | None = None, rounds: int = 48) -> dict[str, float]:
    """A damped sine with drift, by a search over cycles and decay in which the four linear parameters are solved for.

    The search begins with all cycles that the samples can tell apart (or those of ``periods``) and narrows around the best;
    ``robust`` weighs residuals down as it goes. Neither has bounds: a fit whose cycles left the range searched, that grows
    instead of fading, or whose period the data leave open by a tenth or more is not ``trusted``. Too few points give nulls.
    """
    good = np.isfinite(t) & np.isfinite(y)
    order = np.argsort(t[good], kind="stable")
    t, y = t[good][order], y[good][order]
    none = dict.fromkeys((*SINE, "cost"), math.nan) | {"trusted": 0.0} | dict.fromkeys([f"{n}_error" for n in SINE], math.nan)
    if len(t) < LEAST_POINTS or t[0] == t[-1]:
        return none
    t = t - t[0]
    span, unit, weight = t[-1], t / t[-1], np.ones(len(t))
    most = span / (SAMPLES_A_CYCLE * float(np.median(np.diff(t)))) if periods is None else span / periods[0]
    least = 0.75 if periods is None else span / periods[1]
    tried = np.arange(least, max(most, least + 0.5), 1 / STEPS_A_CYCLE)
    # Waves are most of the work: turning and fading are raised apart and multiplied, and matrices stay in a core's cache.
    firsts = []
    for k in range(0, len(tried), TRIED_AT_ONCE):
        turning = np.exp(2j * np.pi * tried[k : k + TRIED_AT_ONCE, None] * unit)
        for d in DECAYS:
            misfit = linear_part(unit, y, weight, turning * np.exp(-d * unit))[1]
            firsts.append((float(misfit.min()), d, float(tried[k + misfit.argmin()])))
    # Of equal misfits the fewest cycles, then the least decay.
    _, cycles, decay = min((m, c, d) for m, d, c in firsts)
    wide, deep, grid = 1 / STEPS_A_CYCLE, max(decay, 0.5) / 2, np.linspace(-1, 1, 5)
    for _ in range(rounds):
        turns, fades = cycles + wide * grid, decay + deep * grid
        waves = np.exp(-fades[:, None] * unit)[:, None] * np.exp(2j * np.pi * turns[:, None] * unit)
        found, misfit = linear_part(unit, y, weight, waves.reshape(-1, len(t)))
        best = int(misfit.argmin())
        cycles, decay, p = turns[best % len(grid)], fades[best // len(grid)], found[best]
        wide, deep = 0.6 * wide, 0.6 * deep
        if robust:
            wave = np.exp((2j * np.pi * cycles - decay) * unit)
            weight = 1 / np.sqrt(1 + (y - p[0] - p[1] * unit - p[2] * wave.imag - p[3] * wave.real) ** 2)
    values = np.array([p[0], p[1] / span, math.hypot(p[2], p[3]), span / cycles, span / decay if decay else math.inf, math.atan2(p[3], p[2])])
    left = sine(values, t) - y
    cost = float((np.sqrt(1 + left**2) - 1).sum() if robust else (left**2).sum() / 2)
    usable = values[2] > 0 and math.isfinite(values[4])
    errors = column_errors(sine_slopes(values, t), 2 * cost) if usable else np.full(len(SINE), np.inf)
    inside = tried[0] - 0.5 <= cycles <= tried[-1] + 0.5 if periods is None else periods[0] <= values[3] <= periods[1]
    trusted = float(bool(usable and inside and decay > 0 and np.isfinite(errors).all() and errors[3] < values[3] / 10))
    return dict(zip(SINE, values.tolist(), strict=True)) | {"cost": cost, "trusted": trusted} | dict(zip([f"{n}_error" for n in SINE], errors.tolist(), strict=True))


def column_errors(slopes: np.ndarray, misfit: float) -> np.ndarray:
    """One-sigma errors: the spread of residuals over what each column of ``slopes`` has that the others can't make up.

    A column that the others make up leaves its parameter undetermined: its error is infinite. Without spare points there is
    no spread to take (NaN).
    """
    rows, columns = slopes.shape
    if rows <= columns:
        return np.full(columns, np.nan)
    length = np.linalg.norm(slopes, axis=0)
    unit = slopes / np.where(length > 0, length, 1)
    own = np.empty(columns)
    for k in range(columns):
        q, r = np.linalg.qr(np.delete(unit, k, axis=1))
        q = q[:, np.abs(np.diag(r)) > 1e-10]
        own[k] = np.linalg.norm(unit[:, k] - q @ (q.T @ unit[:, k]))
    clear = own > 1e-9
    return np.where(clear, math.sqrt(misfit / (rows - columns)) / np.where(clear, own * length, 1), np.inf)


def damped_sine_fit(ridges: DataFrame, by: str = "ridge_id", robust: bool = True, periods: tuple[float, float] | None = None) -> DataFrame:
    """One row of parameters and their one-sigma errors per ridge of (``by``, t, position)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = fit_sine(group["t"].to_numpy(float), group["position"].to_numpy(float), robust, periods)
        return pd.DataFrame({by: [group[by].iloc[0]], **{k: [v] for k, v in made.items()}})

    fields = [*SINE, "cost", "trusted", *[f"{n}_error" for n in SINE]]
    return ridges.groupBy(by).applyInPandas(run, f"{by} long, " + ", ".join(f"{f} double" for f in fields))
