"""Coordinate reference systems by their codes: geographic, Web Mercator and transverse Mercator zones, as column expressions.

Transverse Mercator is the series in the third flattening, to its fourth power:
within four degrees of the central meridian it is exact to less than a millimetre.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import projection as P

#: Flattenings of the ellipsoids; both have the same semi-major axis.
WGS84, CGCS2000 = 1 / 298.257223563, 1 / 298.257222101


@dataclass(frozen=True)
class Zone:
    """A transverse Mercator zone."""

    meridian: float
    scale: float
    east: float
    north: float
    flattening: float


def zone_of(code: int) -> Zone | None:
    """The zone of a code: UTM on WGS84 or CGCS2000 Gauss-Kruger of 3 or 6 degrees, with the zone's number before the easting or not; None for others."""
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return Zone((code % 100) * 6 - 183.0, 0.9996, 500_000.0, 0.0 if code < 32700 else 10_000_000.0, WGS84)
    if 4491 <= code <= 4501:  # zones 13 to 23 of 6 degrees
        number = code - 4491 + 13
        return Zone(number * 6 - 3.0, 1.0, number * 1e6 + 500_000, 0.0, CGCS2000)
    if 4502 <= code <= 4512:  # 75 to 135 degrees east, every 6
        return Zone(75.0 + 6 * (code - 4502), 1.0, 500_000.0, 0.0, CGCS2000)
    if 4513 <= code <= 4533:  # zones 25 to 45 of 3 degrees
        number = code - 4513 + 25
        return Zone(number * 3.0, 1.0, number * 1e6 + 500_000, 0.0, CGCS2000)
    if 4534 <= code <= 4554:  # 75 to 135 degrees east, every 3
        return Zone(75.0 + 3 * (code - 4534), 1.0, 500_000.0, 0.0, CGCS2000)
    return None


def _series(f: float) -> tuple[float, float, list[float], list[float]]:
    """The rectifying radius, the eccentricity and the coefficients forward and backward."""
    n = f / (2 - f)
    radius = P.SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    backward = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, math.sqrt(f * (2 - f)), forward, backward


def to_zone(lng: Column, lat: Column, zone: Zone) -> tuple[Column, Column]:
    """Easting and northing of a place in degrees."""
    radius, e, alpha, _ = _series(zone.flattening)
    s, lam = F.sin(F.radians(lat)), F.radians(lng - zone.meridian)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))  # the tangent of the conformal latitude
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(alpha, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(alpha, 1)), F.lit(0.0))
    return x * (zone.scale * radius) + zone.east, y * (zone.scale * radius) + zone.north


def from_zone(east: Column, north: Column, zone: Zone, rounds: int = 4) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of an easting and northing; the latitude by a fixed number of Newton's steps."""
    radius, e, _, beta = _series(zone.flattening)
    xi, eta = (north - zone.north) / (zone.scale * radius), (east - zone.east) / (zone.scale * radius)
    x = xi - sum((b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(beta, 1)), F.lit(0.0))
    y = eta - sum((b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(beta, 1)), F.lit(0.0))
    conformal = F.sin(x) / F.sqrt(F.sinh(y) * F.sinh(y) + F.cos(x) * F.cos(x))
    e2 = e * e

    def step(tau: Column, _: Column) -> Column:
        root = F.sqrt(1 + tau * tau)
        sigma = F.sinh(e * F.atanh(e * tau / root))
        here = tau * F.sqrt(1 + sigma * sigma) - sigma * root
        slope = (F.sqrt((1 + sigma * sigma) * (1 + tau * tau)) - sigma * tau) * (1 - e2) * root / (1 + (1 - e2) * tau * tau)
        return tau + (conformal - here) / slope

    tau = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), conformal, step)
    return F.lit(zone.meridian) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(F.atan(tau))


def _code(crs: str) -> int:
    name = crs.strip().upper()
    if name in ("CRS84", "OGC:CRS84"):
        return 4326
    if not name.startswith("EPSG:") or not name[5:].isdigit():
        raise ValueError(f"unknown reference system {crs}")
    return int(name[5:])


def to_wgs84(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates (x east, y north) in a system named ``EPSG:<code>``.

    Geographic systems (4326, 4490), Web Mercator (3857), UTM and CGCS2000 zones are known; others raise ValueError.
    """
    code = _code(crs)
    if code in (4326, 4490):
        return x, y
    if code == 3857:
        return P.inverse_mercator_x(x), P.inverse_mercator_y(y)
    zone = zone_of(code)
    if zone is None:
        raise ValueError(f"unknown reference system {crs}")
    return from_zone(x, y, zone)


def from_wgs84(lng: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """The reverse of ``to_wgs84``."""
    code = _code(crs)
    if code in (4326, 4490):
        return lng, lat
    if code == 3857:
        return P.mercator_x(lng), P.mercator_y(lat)
    zone = zone_of(code)
    if zone is None:
        raise ValueError(f"unknown reference system {crs}")
    return to_zone(lng, lat, zone)
