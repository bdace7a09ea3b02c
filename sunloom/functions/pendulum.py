"""Pendulum model of filament oscillations as Column expressions, in SI units unless named otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the pendulum model: solar radius (m) and surface gravity (m/s^2).
SOLAR_RADIUS_M, SURFACE_GRAVITY = 696.3e6, 274.0
TWO_PI = 2 * math.pi


def gravity(height_m: Column) -> Column:
    """Gravity at a height above the surface."""
    return SURFACE_GRAVITY * F.pow(SOLAR_RADIUS_M / (SOLAR_RADIUS_M + height_m), 2)


def cutoff_period(height_m: Column) -> Column:
    """Longest period the curvature of the Sun allows at a height."""
    return TWO_PI * F.sqrt((SOLAR_RADIUS_M + height_m) / gravity(height_m))


def equivalent_radius(radius_m: Column, height_m: Column) -> Column:
    """Curvature radius of the dip, corrected for the direction of gravity: 1/R + 1/(Rsun + h) inverted."""
    return 1 / (1 / radius_m + 1 / (SOLAR_RADIUS_M + height_m))


def longitudinal_period(radius_m: Column, height_m: Column) -> Column:
    return TWO_PI * F.sqrt(equivalent_radius(radius_m, height_m) / gravity(height_m))


def inferred_radius(period_s: Column, height_m: Column) -> Column:
    """Radius of the dip from a period; null where the period is not below the cutoff."""
    ratio = F.pow(period_s / cutoff_period(height_m), 2)
    return F.when(period_s < cutoff_period(height_m), (SOLAR_RADIUS_M + height_m) * ratio / (1 - ratio))


def thread_period(mode: Column, radius_m: Column, height_m: Column, shared_s: float) -> Column:
    """The shared period, or each thread's own by curvature."""
    return F.when(mode == "shared_period", F.lit(shared_s)).otherwise(longitudinal_period(radius_m, height_m))


def damped(time_s: Column, period_s: Column, amplitude: float, start_s: float, damping_s: float, phase: float = 0.0) -> tuple[Column, Column]:
    """Displacement and velocity of a damped oscillation that starts from rest position at ``start_s``; zero before."""
    q = time_s - start_s
    omega = TWO_PI / period_s
    envelope = F.exp(-q / damping_s)
    offset = F.sin(omega * q + phase) - math.sin(phase)
    moved = amplitude * envelope * offset
    speed = amplitude * envelope * (omega * F.cos(omega * q + phase) - offset / damping_s)
    rest = time_s < start_s
    return F.when(rest, 0.0).otherwise(moved), F.when(rest, 0.0).otherwise(speed)


def local_weight(distance: Column, half_strength: float) -> Column:
    """Half at ``half_strength``, zero where it would fall below 0.05."""
    weight = F.exp(-math.log(2) * F.pow(distance / half_strength, 1.1))
    return F.when(weight >= 0.05, weight).otherwise(0.0)


def damped_sine(time_s: Column, equilibrium: Column, drift: Column, amplitude: Column, period: Column, damping: Column, phase: Column, reference: Column) -> Column:
    """A damped sine around a drifting equilibrium."""
    t = time_s - reference
    return equilibrium + drift * t + amplitude * F.exp(-t / damping) * F.sin(TWO_PI * t / period + phase)
