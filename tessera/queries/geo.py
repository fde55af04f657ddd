"""Projections, tile arithmetic and levels of detail over derived points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lod as L
from tessera.functions import projection as J
from tessera.functions import tiling as T
from tessera.queries.base import P, TL, points, query, s_degrees, s_gx, s_gy, s_scaled, s_tx, s_ty, scaled, table, tiles

LNG, LAT = F.col, F.col
s_my = "6378137.0 * ln(tan(pi() / 4 + radians(greatest(least(lat, 85.05112878), -85.05112878)) / 2))"


@query(f"SELECT 6 AS z, {s_tx('lng', 6)} AS x, {s_ty('lat', 6)} AS y, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM {P} GROUP BY ALL")
def tile_count_z6(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    z = F.lit(6)
    return p.groupBy(z.alias("z"), T.tile_x(F.col("lng"), z).alias("x"), T.tile_y(F.col("lat"), z).alias("y")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"SELECT event_id, {s_scaled('6378137.0 * radians(lng)', 100)} AS mx_cm, {s_scaled(s_my, 100)} AS my_cm FROM {P}")
def mercator_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("event_id", scaled(J.mercator_x(F.col("lng")), 100).alias("mx_cm"), scaled(J.mercator_y(F.col("lat")), 100).alias("my_cm"))


@query(f"SELECT event_id, {s_scaled('degrees(6378137.0 * radians(lng) / 6378137.0)', 10**6)} AS lng_e6, {s_scaled(f'degrees(2 * atan(exp(({s_my}) / 6378137.0)) - pi() / 2)', 10**6)} AS lat_e6 FROM {P}")
def mercator_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = J.mercator_x(F.col("lng")), J.mercator_y(F.col("lat"))
    return points(spark, sf_dir).select("event_id", scaled(J.inverse_mercator_x(x), 10**6).alias("lng_e6"), scaled(J.inverse_mercator_y(y), 10**6).alias("lat_e6"))


@query(f"SELECT event_id, {s_scaled('6378137.0 * radians(lng) - 6378137.0 * radians(118.1)', 100)} AS x_cm, {s_scaled(f'({s_my}) - 6378137.0 * ln(tan(pi() / 4 + radians(24.48) / 2))', 100)} AS y_cm FROM {P}")
def local_frame_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = J.local_xy(F.col("lng"), F.col("lat"), 118.1, 24.48)
    return points(spark, sf_dir).select("event_id", scaled(x, 100).alias("x_cm"), scaled(y, 100).alias("y_cm"))


_e2 = "((1 / 298.257223563) * (2 - 1 / 298.257223563))"
_n = f"(6378137.0 / sqrt(1 - {_e2} * sin(radians(lat)) * sin(radians(lat))))"
_h = "(event_id % 1000)"
_ecef = (f"(({_n} + {_h}) * cos(radians(lat)) * cos(radians(lng)))", f"(({_n} + {_h}) * cos(radians(lat)) * sin(radians(lng)))", f"(({_n} * (1 - {_e2}) + {_h}) * sin(radians(lat)))")


@query(f"SELECT event_id, {s_scaled(_ecef[0], 10)} AS x_dm, {s_scaled(_ecef[1], 10)} AS y_dm, {s_scaled(_ecef[2], 10)} AS z_dm FROM {P}")
def ecef_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = J.ecef(F.col("lng"), F.col("lat"), (F.col("event_id") % 1000).cast("double"))
    return points(spark, sf_dir).select("event_id", scaled(x, 10).alias("x_dm"), scaled(y, 10).alias("y_dm"), scaled(z, 10).alias("z_dm"))


# The inverse of the forward transform is its input: the oracle is the point itself.
@query(f"SELECT event_id, {s_scaled('lng', 10**5)} AS lng_e5, {s_scaled('lat', 10**5)} AS lat_e5, CAST(event_id % 1000 AS BIGINT) AS h_m FROM {P}")
def ecef_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = J.ecef(F.col("lng"), F.col("lat"), (F.col("event_id") % 1000).cast("double"))
    p = points(spark, sf_dir).select("event_id", x.alias("ex"), y.alias("ey"), z.alias("ez"))
    lng, lat, h = J.geodetic(F.col("ex"), F.col("ey"), F.col("ez"))
    return p.select("event_id", scaled(lng, 10**5).alias("lng_e5"), scaled(lat, 10**5).alias("lat_e5"), F.round(h, 3).cast("long").alias("h_m"))


@query(f"SELECT event_id, z::INTEGER AS z, {s_tx('lng', 'z')} AS x, {s_ty('lat', 'z')} AS y FROM {P}, (SELECT unnest([0, 3, 7, 11, 15])::INTEGER AS z)")
def tile_xy_multi_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("z", F.explode(F.array(*map(F.lit, (0, 3, 7, 11, 15)))))
    return p.select("event_id", "z", T.tile_x(F.col("lng"), F.col("z")).alias("x"), T.tile_y(F.col("lat"), F.col("z")).alias("y"))


def _bounds(y: str, z: str = "z") -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({y})::DOUBLE / (1::BIGINT << {z})))))"


@query(f"SELECT z::INTEGER AS z, x, y, {s_scaled('x::DOUBLE / (1::BIGINT << z) * 360 - 180', 10**6)} AS west, {s_scaled(_bounds('y + 1'), 10**6)} AS south, {s_scaled('(x + 1)::DOUBLE / (1::BIGINT << z) * 360 - 180', 10**6)} AS east, {s_scaled(_bounds('y'), 10**6)} AS north FROM {TL(9)}")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    b = {"west": T.tile_west(x, z), "south": T.tile_north(y + 1, z), "east": T.tile_west(x + 1, z), "north": T.tile_north(y, z)}
    return tiles(spark, sf_dir, 9).select("z", "x", "y", *[scaled(v, 10**6).alias(k) for k, v in b.items()])


@query(f"SELECT z::INTEGER AS z, x, y, (1::BIGINT << z) - 1 - y AS row, {s_scaled(_bounds('(1::BIGINT << z) - y'), 10**6)} AS south, {s_scaled(_bounds('(1::BIGINT << z) - 1 - y'), 10**6)} AS north FROM {TL(9)}")
def tms_flip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, y = F.col("z"), F.col("y")
    row = T.flip_row(y, z)
    return tiles(spark, sf_dir, 9).select("z", "x", "y", row.alias("row"), scaled(T.tile_north(row + 1, z), 10**6).alias("south"), scaled(T.tile_north(row, z), 10**6).alias("north"))


def _geo(origin: str) -> str:
    x, y = s_gx("lng", 7), s_gy("lat", 7, origin)
    low, high = ("90 - (y + 1) / 128.0 * 180", "90 - y / 128.0 * 180") if origin == "north" else ("y / 128.0 * 180 - 90", "(y + 1) / 128.0 * 180 - 90")
    return f"SELECT event_id, x, y, {s_scaled('x / 256.0 * 360 - 180', 10**6)} AS west, {s_scaled(low, 10**6)} AS south, {s_scaled(high, 10**6)} AS north FROM (SELECT event_id, {x} AS x, {y} AS y FROM {P})"


def _geo_tile(spark: SparkSession, sf_dir: str, origin: str) -> DataFrame:
    z = F.lit(7)
    p = points(spark, sf_dir).select("event_id", T.geo_x(F.col("lng"), z).alias("x"), T.geo_y(F.col("lat"), z, origin).alias("y"))
    west, south, _, north = T.geo_bounds(F.col("x"), F.col("y"), z, origin)
    return p.select("event_id", "x", "y", scaled(west, 10**6).alias("west"), scaled(south, 10**6).alias("south"), scaled(north, 10**6).alias("north"))


@query(_geo("north"))
def geo_tile_north(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geo_tile(spark, sf_dir, "north")


@query(_geo("south"))
def geo_tile_south(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geo_tile(spark, sf_dir, "south")


@query(f"SELECT event_id, {s_scaled('(lng + 180) / 360 * 4096 * 256', 10)} AS px, {s_scaled('(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096 * 256', 10)} AS py FROM {P}")
def global_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(12)
    return points(spark, sf_dir).select("event_id", scaled(T.global_pixel_x(F.col("lng"), z), 10).alias("px"), scaled(T.global_pixel_y(F.col("lat"), z), 10).alias("py"))


_D = "(event_id * 7907 % 100000 + 1.5)"


@query(f"SELECT event_id, CASE WHEN {_D} <= 500 THEN 12::BIGINT ELSE greatest(2, 12 - least(floor(log2({_D} / 500.0)), 5))::BIGINT END AS z FROM events")
def effective_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("event_id") * 7907 % 100000).cast("double") + 1.5
    return table(spark, sf_dir, "events").select("event_id", L.effective_zoom(d, F.lit(12), F.lit(500.0), 5, 2).alias("z"))


@query(f"SELECT event_id, greatest(1, least(18, ceil(log2(156543.034 * cos(radians(lat)) / (2 * {_D} * tan(radians(75.0) / 2) / 900)))))::BIGINT AS z FROM {P}")
def suggest_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("event_id") * 7907 % 100000).cast("double") + 1.5
    return points(spark, sf_dir).select("event_id", L.suggest_zoom(d, F.lit(75.0), F.lit(900.0), F.col("lat")).cast("long").alias("z"))


_E = "CAST(event_id % 2000 - 500 AS DOUBLE)"


@query(f"SELECT event_id, CASE WHEN {_E} > 0 THEN {s_scaled(f'6378137.0 * acos(6378137.0 / (6378137.0 + {_E})) * 1.05', 10)} ELSE 0 END AS far_dm FROM events")
def horizon_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scaled(L.horizon_distance((F.col("event_id") % 2000 - 500).cast("double")), 10).alias("far_dm"))


@query(f"""SELECT event_id, {s_scaled(f'78271.516964 / pow(2.0, event_id % 15) * 900 / ({_D} * 2 * tan(radians(60.0) / 2))', 100)} AS terrain,
{s_scaled(f'50.0 * 900 / (greatest({_D}, 1000.0) * 2 * tan(radians(60.0) / 2))', 1000)} AS perspective,
{s_scaled(f'50.0 * 900 * 2 * tan(radians(60.0) / 2) / greatest({_D}, 1000.0)', 1000)} AS compat FROM events""")
def screen_space_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, h, fov = (F.col("event_id") * 7907 % 100000).cast("double") + 1.5, F.lit(900.0), F.lit(60.0)
    return table(spark, sf_dir, "events").select(
        "event_id",
        scaled(L.terrain_error((F.col("event_id") % 15).cast("double"), d, h, fov), 100).alias("terrain"),
        scaled(L.sse_perspective(F.lit(50.0), d, h, fov, F.lit(1000.0)), 1000).alias("perspective"),
        scaled(L.sse_tiles3d_compat(F.lit(50.0), d, h, fov, F.lit(1000.0)), 1000).alias("compat"),
    )


_px = "CAST(event_id * 31 % 5000 + 0.5 AS DOUBLE)"


@query(f"SELECT event_id, least(greatest(least(greatest(14, 10 + event_id % 6 + 1), 10 + event_id % 6 + 1 + greatest(ceil(log2({_px} / 256)), 0)), 0), 21)::BIGINT AS z, least(256 * pow(2, greatest(ceil(log2({_px} * 2 / 256)), 0)), 2048)::BIGINT AS canvas FROM events")
def imagery_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = (F.col("event_id") * 31 % 5000).cast("double") + 0.5
    px = F.greatest(px, F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", L.imagery_zoom(px, 10 + F.col("event_id") % 6, F.lit(14).cast("long")).cast("long").alias("z"), L.canvas_size(px).alias("canvas"))


_t = "(event_id % 1001) / 1000.0"


@query(f"SELECT event_id, {s_scaled(f'CASE WHEN {_t} < 0.5 THEN 2 * {_t} * {_t} ELSE 1 - (2 - 2 * {_t}) * (2 - 2 * {_t}) / 2 END', 10**6)} AS eased FROM events")
def fly_easing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scaled(J.ease_in_out((F.col("event_id") % 1001).cast("double") / 1000), 10**6).alias("eased"))


_o = s_degrees("event_id")


@query(f"SELECT event_id, {s_scaled('degrees(atan2(lng, lat))', 1000)} AS heading, {s_scaled('degrees(atan2(50.0, sqrt(lng * lng + lat * lat)))', 1000)} AS pitch, {s_scaled('sqrt(lng * lng + lat * lat + 2500)', 1000)} AS far FROM {P}")
def heading_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, p, r = J.heading_pitch_range(F.col("lng"), F.col("lat"), F.lit(50.0))
    return points(spark, sf_dir).select("event_id", scaled(h, 1000).alias("heading"), scaled(p, 1000).alias("pitch"), scaled(r, 1000).alias("far"))
