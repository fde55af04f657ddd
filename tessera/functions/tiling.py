"""Tile indices and bounds of the XYZ, TMS and geographic schemes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.projection import MAX_LATITUDE, clamp

MAX_ZOOM = 22


def tile_zoom(zoom: Column) -> Column:
    return clamp(F.floor(zoom), 0, MAX_ZOOM)


def wrap_longitude(lng: Column) -> Column:
    """The longitude in [-180, 180)."""
    return F.pmod(lng + 180, F.lit(360.0)) - 180


def span(zoom: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), zoom.cast("int"))


def tile_x(lng: Column, zoom: Column) -> Column:
    n = span(zoom)
    x = F.floor((wrap_longitude(lng) + 180) / 360 * n.cast("double"))
    return F.greatest(F.least(x, n - 1), F.lit(0).cast("long"))


def tile_y(lat: Column, zoom: Column) -> Column:
    n = span(zoom)
    phi = F.radians(clamp(lat, -MAX_LATITUDE, MAX_LATITUDE))
    y = F.floor((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n.cast("double"))
    return F.greatest(F.least(y, n - 1), F.lit(0).cast("long"))


def tile_west(x: Column, zoom: Column) -> Column:
    return x.cast("double") / span(zoom).cast("double") * 360 - 180


def tile_north(y: Column, zoom: Column) -> Column:
    """The northern edge of row y, counted from the north; that of y + 1 is the southern edge."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y.cast("double") / span(zoom).cast("double")))))


def flip_row(y: Column, zoom: Column) -> Column:
    """A row counted from the other side."""
    return span(zoom) - 1 - y


def geo_x(lng: Column, zoom: Column) -> Column:
    n = span(zoom + 1)
    return F.greatest(F.least(F.floor((lng + 180) / 360 * n.cast("double")), n - 1), F.lit(0).cast("long"))


def geo_y(lat: Column, zoom: Column, origin: str) -> Column:
    """The row in the geographic scheme, counted from the "north" or the "south"."""
    n = span(zoom)
    part = (90 - lat) / 180 if origin == "north" else (lat + 90) / 180
    return F.greatest(F.least(F.floor(part * n.cast("double")), n - 1), F.lit(0).cast("long"))


def geo_bounds(x: Column, y: Column, zoom: Column, origin: str) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a geographic tile."""
    nx, ny = span(zoom + 1).cast("double"), span(zoom).cast("double")
    low, high = y.cast("double") / ny * 180, (y + 1).cast("double") / ny * 180
    south, north = (90 - high, 90 - low) if origin == "north" else (low - 90, high - 90)
    return x.cast("double") / nx * 360 - 180, south, (x + 1).cast("double") / nx * 360 - 180, north


def parent(x: Column, by: int | Column) -> Column:
    """The index ``by`` levels up; by 0 or less the index itself."""
    by = F.lit(by) if isinstance(by, int) else by
    return F.call_function("shiftright", x, F.greatest(by.cast("int"), F.lit(0)))


def is_ancestor(z1: Column, x1: Column, y1: Column, z2: Column, x2: Column, y2: Column) -> Column:
    """Whether tile 1 lies strictly above tile 2."""
    d = z2 - z1
    return (d > 0) & (parent(x2, d) == x1) & (parent(y2, d) == y1)


def tile_key(x: Column, y: Column, zoom: Column) -> Column:
    return F.concat_ws(",", x.cast("string"), y.cast("string"), zoom.cast("string"))


def global_pixel_x(lng: Column, zoom: Column) -> Column:
    return (lng + 180) / 360 * span(zoom).cast("double") * 256


def global_pixel_y(lat: Column, zoom: Column) -> Column:
    phi = F.radians(clamp(lat, -MAX_LATITUDE, MAX_LATITUDE))
    return (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * span(zoom).cast("double") * 256
