"""WGS84, Web Mercator, ECEF and local frames as column expressions.

Angles are degrees unless a name says ``rad``; metres otherwise.  Nulls give nulls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
MAX_LATITUDE = 85.05112878
#: WGS84 ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
ECC2 = FLATTENING * (2 - FLATTENING)


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def mercator_x(lng: Column) -> Column:
    return F.lit(RADIUS) * F.radians(lng)


def mercator_y(lat: Column) -> Column:
    return F.lit(RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(clamp(lat, -MAX_LATITUDE, MAX_LATITUDE)) / 2))


def inverse_mercator_x(x: Column) -> Column:
    return F.degrees(x / RADIUS)


def inverse_mercator_y(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(math.pi / 2))


def local_xy(lng: Column, lat: Column, origin_lng: float, origin_lat: float) -> tuple[Column, Column]:
    """Metres east and north of an origin in Mercator."""
    return mercator_x(lng) - mercator_x(F.lit(origin_lng)), mercator_y(lat) - mercator_y(F.lit(origin_lat))


def from_local_xy(x: Column, y: Column, origin_lng: float, origin_lat: float) -> tuple[Column, Column]:
    return inverse_mercator_x(x + mercator_x(F.lit(origin_lng))), inverse_mercator_y(y + mercator_y(F.lit(origin_lat)))


def finite(x: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def assert_finite(x: Column, name: str) -> Column:
    """``x``, or an error that names it where it is not finite."""
    return F.when(finite(x), x).otherwise(F.raise_error(F.lit(f"{name} must be a finite number")).cast("double"))


def ecef(lng: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """Geodetic degrees and height to earth-centred coordinates."""
    lam, phi = F.radians(lng), F.radians(lat)
    n = F.lit(SEMI_MAJOR) / F.sqrt(1 - F.lit(ECC2) * F.sin(phi) * F.sin(phi))
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - ECC2) + height) * F.sin(phi)


def geodetic(x: Column, y: Column, z: Column, rounds: int = 6) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates to degrees and height by a fixed number of iterations."""
    p = F.sqrt(x * x + y * y)
    first = F.atan2(z, p * (1 - ECC2))

    def step(phi: Column, _: Column) -> Column:
        n = F.lit(SEMI_MAJOR) / F.sqrt(1 - F.lit(ECC2) * F.sin(phi) * F.sin(phi))
        h = p / F.cos(phi) - n
        return F.atan2(z, p * (1 - F.lit(ECC2) * n / (n + h)))

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)
    n = F.lit(SEMI_MAJOR) / F.sqrt(1 - F.lit(ECC2) * F.sin(phi) * F.sin(phi))
    return F.degrees(F.atan2(y, x)), F.degrees(phi), p / F.cos(phi) - n


def enu_axes(lng: Column, lat: Column) -> Column:
    """The unit vectors east, north and up at a place, one after another: nine numbers."""
    sl, cl, sp, cp = F.sin(F.radians(lng)), F.cos(F.radians(lng)), F.sin(F.radians(lat)), F.cos(F.radians(lat))
    return F.array(-sl, cl, F.lit(0.0), -sp * cl, -sp * sl, cp, cp * cl, cp * sl, sp)


def enu_to_ecef(lng: Column, lat: Column) -> Column:
    """The column-major 4 x 4 transform from east-north-up at a place on the ellipsoid to ECEF."""
    axes = enu_axes(lng, lat)
    at = ecef(lng, lat, F.lit(0.0))
    row = lambda k: [F.get(axes, F.lit(3 * k + i)) for i in range(3)] + [F.lit(0.0)]
    return F.array(*row(0), *row(1), *row(2), *at, F.lit(1.0))


def heading_pitch_range(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """An offset from a target as heading and pitch in degrees and distance."""
    flat = F.sqrt(dx * dx + dy * dy)
    return F.degrees(F.atan2(dx, dy)), F.degrees(F.atan2(dz, flat)), F.sqrt(dx * dx + dy * dy + dz * dz)


def offset_of(heading: Column, pitch: Column, distance: Column) -> tuple[Column, Column, Column]:
    flat = distance * F.cos(F.radians(pitch))
    return flat * F.sin(F.radians(heading)), flat * F.cos(F.radians(heading)), distance * F.sin(F.radians(pitch))


def ease_in_out(t: Column) -> Column:
    """Quadratic easing of t in 0..1."""
    return F.when(t < 0.5, 2 * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(2.0)) / 2)
