"""Lenient parsing and request addresses as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roads of these classes are major.
MAJOR_ROADS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"]


def parse_number(text: Column, fallback: float | Column) -> Column:
    """The first number in a string, or the fallback."""
    found = F.regexp_extract(F.coalesce(text.cast("string"), F.lit("")), r"[-+]?(\d+\.?\d*|\.\d+)", 0)
    return F.coalesce(found.try_cast("double"), F.lit(fallback) if isinstance(fallback, float) else fallback)


def building_height(text: Column, scale: float = 1.0, fallback: float = 12.0, least: float = 1.0, most: float = 1000.0) -> Column:
    return F.least(F.greatest(parse_number(text, fallback) * scale, F.lit(least)), F.lit(most))


def source_id(*candidates: Column) -> Column:
    """The first candidate that is neither null, empty nor 0."""
    truthy = lambda c: F.when(~c.cast("string").isin("", "0"), c.cast("string"))
    return F.coalesce(*[truthy(c) for c in candidates[:-1]], candidates[-1].cast("string"))


def is_major_road(fclass: Column) -> Column:
    return F.coalesce(fclass, F.lit("unknown")).isin(MAJOR_ROADS)


def rail_offset(layer: Column) -> Column:
    """Height offset of a railway by its layer, -2 to 3; no number counts as 0."""
    return F.least(F.greatest(F.coalesce(layer.cast("string").try_cast("double"), F.lit(0.0)), F.lit(-2.0)), F.lit(3.0)) * 0.45


def coordinate(value: Column) -> Column:
    """A number, or null for what is none; null, empty and boolean values are no numbers."""
    v = value.cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def replace_first(text: Column, mark: str, by: Column) -> Column:
    """``text`` with the first ``mark`` replaced; it names its input once, so nested calls do not multiply."""
    return F.call_function("array_join", F.split(text, re.escape(mark), 2), by)


def vendor_url(layer: str, token: str) -> str:
    """Address template of a public map service by layer type and token; {s} is the number of the host."""
    return f"https://t{{s}}.tianditu.gov.cn/DataServer?T={layer}&x={{x}}&y={{y}}&l={{z}}&tk={token}"


def is_subway(fclass: Column) -> Column:
    """Whether a railway is drawn as a subway line."""
    return F.coalesce(fclass, F.lit("unknown")) == "subway"


def xyz_url(template: Column, x: Column, y: Column, zoom: Column, subdomains: list[str]) -> Column:
    """The first occurrence of each placeholder filled; {s} rotates with x + y + zoom."""
    out = template
    if subdomains:
        out = replace_first(out, "{s}", F.element_at(F.array(*map(F.lit, subdomains)), (F.pmod(F.abs(x + y + zoom), F.lit(len(subdomains))) + 1).cast("int")))
    for mark, value in (("{x}", x), ("{y}", y), ("{z}", zoom)):
        out = replace_first(out, mark, value.cast("string"))
    return out


def tms_url(base: Column, x: Column, y: Column, zoom: Column, flip: bool = True, extension: str = "png") -> Column:
    row = F.call_function("shiftleft", F.lit(1).cast("long"), zoom.cast("int")) - 1 - y if flip else y
    return F.concat(F.concat_ws("/", F.regexp_replace(base, "/$", ""), zoom.cast("string"), x.cast("string"), row.cast("string")), F.lit(f".{extension}"))


def with_query(base: Column, parts: list[tuple[str, Column]]) -> Column:
    """``base`` with a query string, joined by ? or &; values are URL-encoded."""
    joined = F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(v.cast("string"))) for k, v in parts])
    return F.concat(base, F.when(F.instr(base, "?") > 0, F.lit("&")).otherwise(F.lit("?")), joined)


def wmts_url(base: Column, layer: str, matrix_set: str, x: Column, y: Column, label: Column, style: str = "default", fmt: str = "image/png") -> Column:
    """KVP GetTile request; ``label`` is the name of the tile matrix."""
    fixed = [("SERVICE", "WMTS"), ("REQUEST", "GetTile"), ("VERSION", "1.0.0"), ("LAYER", layer), ("STYLE", style), ("TILEMATRIXSET", matrix_set), ("FORMAT", fmt)]
    return with_query(base, [*((k, F.lit(v)) for k, v in fixed), ("TILEMATRIX", label), ("TILEROW", y), ("TILECOL", x)])


def wms_url(base: Column, layers: str, west: Column, south: Column, east: Column, north: Column, size: int = 256, version: str = "1.3.0", extra: dict[str, str] | None = None) -> Column:
    """GetMap request for a box in EPSG:3857 metres; ``extra`` overrides parameters.  Versions before 1.3.0 are refused."""
    if version < "1.3.0":
        raise ValueError("WMS versions before 1.3.0 are not supported")
    box = F.concat_ws(",", *[F.format_string("%.3f", v) for v in (west, south, east, north)])
    parts = {"SERVICE": F.lit("WMS"), "REQUEST": F.lit("GetMap"), "VERSION": F.lit(version), "LAYERS": F.lit(layers), "STYLES": F.lit(""), "CRS": F.lit("EPSG:3857"), "BBOX": box, "WIDTH": F.lit(size), "HEIGHT": F.lit(size), "FORMAT": F.lit("image/png"), "TRANSPARENT": F.lit("TRUE")}
    return with_query(base, list((parts | {k: F.lit(v) for k, v in (extra or {}).items()}).items()))


def terrain_url(template: Column, x: Column, y: Column, zoom: Column, version: str) -> Column:
    """All occurrences of all placeholders filled."""
    out = template
    for mark, value in (("{x}", x), ("{y}", y), ("{z}", zoom), ("{version}", F.lit(version))):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def resolve_url(uri: Column, base: Column) -> Column:
    """A relative address against the folder of ``base``."""
    return F.when(uri.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), uri).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), uri))


def request_server(url: Column, group: Column) -> Column:
    """What request limits count by: the stated group, else the host, else one key for all."""
    return F.coalesce(group, F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1), F.lit(""))


def permanent_failure(status: Column) -> Column:
    return status.isin(404, 410)


def cache_key(version: str, origin: str, zoom: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("/", F.lit(version), F.lit(origin), zoom.cast("string"), x.cast("string"), y.cast("string"))
