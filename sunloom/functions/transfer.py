"""Radiative transfer, projection, masks and display as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dips import clip

#: Fixed values of the error function's rational approximation (absolute error below 1.5e-7).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    a = F.abs(x)
    t = 1 / (1 + ERF_P * a)
    series = F.lit(ERF_A[-1])
    for c in reversed(ERF_A[:-1]):
        series = series * t + c
    return F.signum(x) * (1 - series * t * F.exp(-a * a))


def pixel_gaussian(pixel: Column, centre: Column, sigma: Column) -> Column:
    """Integral of exp(-d^2 / 2 sigma^2) over a pixel of unit width."""
    scale = math.sqrt(2) * sigma
    return math.sqrt(math.pi / 2) * sigma * (erf((pixel + 0.5 - centre) / scale) - erf((pixel - 0.5 - centre) / scale))


def absorption(tau: Column) -> Column:
    return 1 - F.exp(-tau)


def dilute(transmission: Column, share: float) -> Column:
    """Transmission seen through a band of which the line fills ``share``."""
    return clip(1 - share * (1 - transmission), 0.0, 1.0)


def compose(background: Column, transmission: Column, source: Column) -> Column:
    return background * transmission + source * (1 - transmission)


def native_tau(soft: Column) -> Column:
    return -F.log(F.greatest(1 - soft, F.lit(1e-12)))


def display(value: Column, low: Column, high: Column) -> Column:
    """0 to 255, rounded half to even; 0 for values that aren't finite."""
    scaled = clip((value - low) / (high - low), 0.0, 1.0)
    return F.rint(255 * F.when(value.isNull() | F.isnan(value), 0.0).otherwise(scaled)).cast("int")


def project(x: Column, y: Column, z: Column, mu: float, limb_deg: float, width: float, height: float) -> tuple[Column, Column]:
    """Image coordinates of points: parallax by height, foreshortening towards the limb; unchanged near disk centre."""
    if mu >= 0.999:
        return x, y
    ex, ey = math.cos(math.radians(limb_deg)), math.sin(math.radians(limb_deg))
    lean = math.sqrt(max(1 - mu * mu, 0.0)) / mu
    px, py = x + z * (lean * ex), y + z * (lean * ey)
    along = (px - width / 2) * ex + (py - height / 2) * ey
    return px + (mu - 1) * along * ex, py + (mu - 1) * along * ey


def project_vector(vx: Column, vy: Column, vz: Column, mu: float, limb_deg: float) -> tuple[Column, Column]:
    if mu >= 0.999:
        return vx, vy
    ex, ey = math.cos(math.radians(limb_deg)), math.sin(math.radians(limb_deg))
    shift = (mu - 1) * (vx * ex + vy * ey) + math.sqrt(max(1 - mu * mu, 0.0)) * vz
    return vx + shift * ex, vy + shift * ey
