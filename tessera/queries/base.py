"""Derived inputs that the queries share, as DataFrames and as SQL text.

The tables have no coordinates, so points are derived from ``events``, whose
ids are unique; views from ``customer``; buildings and requests from ``orders``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import tiling as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    """Registers a query function under its name with its SQL, or None if SQL cannot express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scaled(x: Column, by: int) -> Column:
    """A double as a whole number of units of 1 / ``by``, halves up."""
    return F.floor(x * by + 0.5).cast("long")


def s_scaled(x: str, by: int) -> str:
    return f"CAST(floor(({x}) * {by} + 0.5) AS BIGINT)"


def degrees_of(key: Column) -> tuple[Column, Column]:
    """A place derived from an id."""
    lng = F.pmod(key * 104729, F.lit(360000)).cast("double") / 1000 - 180
    return lng, F.pmod(key * 7919, F.lit(170000)).cast("double") / 1000 - 85


def s_degrees(key: str) -> tuple[str, str]:
    return f"(CAST({key} * 104729 % 360000 AS DOUBLE) / 1000 - 180)", f"(CAST({key} * 7919 % 170000 AS DOUBLE) / 1000 - 85)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, ts, cents, lng, lat)."""
    e = table(spark, sf_dir, "events")
    lng, lat = degrees_of(F.col("event_id"))
    return e.select("event_id", "user_id", "event_type", "ts", scaled(F.col("value"), 100).alias("cents"), lng.alias("lng"), lat.alias("lat"))


P = f"(SELECT event_id, user_id, event_type, ts, {s_scaled('value', 100)} AS cents, {s_degrees('event_id')[0]} AS lng, {s_degrees('event_id')[1]} AS lat FROM events)"


def views(spark: SparkSession, sf_dir: str, half: float = 2.0) -> DataFrame:
    """(view, west, south, east, north): boxes of ``2 * half`` degrees around places of customers."""
    c = table(spark, sf_dir, "customer")
    lng, lat = degrees_of(F.col("c_custkey"))
    lng, lat = F.floor(lng) + 0.25, F.floor(lat * 0.8) + 0.25
    return c.select(F.col("c_custkey").alias("view"), (lng - half).alias("west"), (lat - half).alias("south"), (lng + half).alias("east"), (lat + half).alias("north"))


def V(half: float = 2.0) -> str:
    lng, lat = s_degrees("c_custkey")
    return f"(SELECT c_custkey AS view, floor({lng}) + 0.25 - {half} AS west, floor({lat} * 0.8) + 0.25 - {half} AS south, floor({lng}) + 0.25 + {half} AS east, floor({lat} * 0.8) + 0.25 + {half} AS north FROM customer)"


def s_tx(lng: str, z: str | int) -> str:
    return f"CAST(greatest(least(floor(((({lng}) + 180) - 360 * floor((({lng}) + 180) / 360.0)) / 360 * (1::BIGINT << ({z}))), (1::BIGINT << ({z})) - 1), 0) AS BIGINT)"


def s_ty(lat: str, z: str | int) -> str:
    phi = f"radians(greatest(least({lat}, 85.05112878), -85.05112878))"
    return f"CAST(greatest(least(floor((1 - ln(tan({phi}) + 1 / cos({phi})) / pi()) / 2 * (1::BIGINT << ({z}))), (1::BIGINT << ({z})) - 1), 0) AS BIGINT)"


def s_gx(lng: str, z: str | int) -> str:
    n = f"(1::BIGINT << (({z}) + 1))"
    return f"CAST(greatest(least(floor((({lng}) + 180) / 360.0 * {n}), {n} - 1), 0) AS BIGINT)"


def s_gy(lat: str, z: str | int, origin: str) -> str:
    n = f"(1::BIGINT << ({z}))"
    part = f"(90 - ({lat})) / 180.0" if origin == "north" else f"(({lat}) + 90) / 180.0"
    return f"CAST(greatest(least(floor({part} * {n}), {n} - 1), 0) AS BIGINT)"


def tiles(spark: SparkSession, sf_dir: str, zoom: int, every: int = 1, rest: int = 0) -> DataFrame:
    """The distinct XYZ tiles (z, x, y) of the points whose id leaves ``rest`` modulo ``every``."""
    p = points(spark, sf_dir)
    p = p.where(F.col("event_id") % every == rest) if every > 1 else p
    return p.select(F.lit(zoom).alias("z"), T.tile_x(F.col("lng"), F.lit(zoom)).alias("x"), T.tile_y(F.col("lat"), F.lit(zoom)).alias("y")).distinct()


def TL(zoom: int, every: int = 1, rest: int = 0) -> str:
    where = f" WHERE event_id % {every} = {rest}" if every > 1 else ""
    return f"(SELECT DISTINCT {zoom} AS z, {s_tx('lng', zoom)} AS x, {s_ty('lat', zoom)} AS y FROM {P}{where})"


def typed_tiles(spark: SparkSession, sf_dir: str, zoom: int, *types: str) -> DataFrame:
    """The distinct XYZ tiles (z, x, y) of the points of some types of events: what a part of the users holds or sees."""
    p = points(spark, sf_dir).where(F.col("event_type").isin(*types))
    return p.select(F.lit(zoom).alias("z"), T.tile_x(F.col("lng"), F.lit(zoom)).alias("x"), T.tile_y(F.col("lat"), F.lit(zoom)).alias("y")).distinct()


def TT(zoom: int, *types: str) -> str:
    return f"(SELECT DISTINCT {zoom} AS z, {s_tx('lng', zoom)} AS x, {s_ty('lat', zoom)} AS y FROM {P} WHERE event_type IN ({', '.join(repr(t) for t in types)}))"


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of available tiles (z, start_x, end_x, start_y, end_y), derived from suppliers."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    z = (F.col("k") % 7 + 2).cast("int")
    n = T.span(z)
    x, y = F.pmod(F.col("k") * 37, n), F.pmod(F.col("k") * 53, n)
    return s.select(z.alias("z"), x.alias("start_x"), F.least(x + F.col("k") % 5, n - 1).alias("end_x"), y.alias("start_y"), F.least(y + F.col("k") % 3, n - 1).alias("end_y"))


_N = "(1::BIGINT << (s_suppkey % 7 + 2)::INTEGER)"
A = f"(SELECT (s_suppkey % 7 + 2)::INTEGER AS z, s_suppkey * 37 % {_N} AS start_x, least(s_suppkey * 37 % {_N} + s_suppkey % 5, {_N} - 1) AS end_x, s_suppkey * 53 % {_N} AS start_y, least(s_suppkey * 53 % {_N} + s_suppkey % 3, {_N} - 1) AS end_y FROM supplier)"
