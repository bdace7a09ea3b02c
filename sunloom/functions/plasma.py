"""Plasma of loaded dips as Column expressions, in CGS units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dips import clip

#: Boltzmann constant, hydrogen mass, gravity, helium per hydrogen, speed of light.
BOLTZMANN, HYDROGEN, GRAVITY, HELIUM, LIGHT = 1.380649e-16, 1.6726e-24, 2.74e4, 0.1, 2.99792458e10
#: Solar radius (km) of the dilution law; heights (km) and source fractions of the anchors.
DISK_RADIUS_KM = 695_508.0
SOURCE_HEIGHTS, SOURCE_FRACTIONS = (10_000.0, 20_000.0, 30_000.0), (3.22 / 6.93, 2.98 / 6.93, 2.80 / 6.93)


def temperature(at: Column, centre: float, edge: float, power: float) -> Column:
    return centre + (edge - centre) * F.pow(clip(at, 0.0, 1.0), power)


def ionization(temp: Column, centre: float, edge: float, at_centre: float) -> Column:
    share = clip((edge - temp) / (edge - centre), 0.0, 1.0)
    return 1 - (1 - at_centre) * share * share


def mean_mass(ionized: Column) -> Column:
    """Mean molecular mass in hydrogen masses."""
    return (1 + 4 * HELIUM) / (1 + HELIUM + ionized)


def pressure_scale(mass: Column, temp: Column) -> Column:
    """Relative growth of pressure per kilometre down."""
    return mass * (HYDROGEN * GRAVITY * 1e5 / BOLTZMANN) / temp


def electron_density(pressure: Column, temp: Column, ionized: Column) -> Column:
    return pressure / (BOLTZMANN * temp * (1 + 1.1 / F.greatest(ionized, F.lit(1e-6))))


def line_opacity(pressure: Column, temp: Column, ionized: Column, factor: Column, wavelength_angstrom: float = 6562.8, turbulence_kms: float = 5.0) -> Column:
    """Absorption coefficient per cm at line centre; ``factor`` is n_e^2 / n_2."""
    frequency = LIGHT / (wavelength_angstrom * 1e-8)
    width = (frequency / LIGHT) * F.sqrt(2 * BOLTZMANN / HYDROGEN * temp + (turbulence_kms * 1e5) ** 2)
    return 1.7e-2 * F.pow(electron_density(pressure, temp, ionized), 2) / factor / (math.sqrt(math.pi) * width)


def dilution(height_km: Column) -> Column:
    """Share of the sky that the disk fills at a height."""
    return 0.5 * (1 - F.sqrt(1 - F.pow(DISK_RADIUS_KM / (DISK_RADIUS_KM + height_km), 2)))


def source_fraction(height_km: Column) -> Column:
    """Linear between the anchors; beyond them the outermost anchor scaled by dilution."""
    h, s = SOURCE_HEIGHTS, SOURCE_FRACTIONS
    line = lambda a, b: s[a] + (s[b] - s[a]) * (height_km - h[a]) / (h[b] - h[a])
    outside = lambda k: s[k] * dilution(height_km) / dilution(F.lit(h[k]))
    return F.when(height_km < h[0], outside(0)).when(height_km <= h[1], line(0, 1)).when(height_km <= h[2], line(1, 2)).otherwise(outside(2))
