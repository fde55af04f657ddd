"""Conversion of features, contents read back, reference systems, anchors, screen rays, colours and reports."""

from __future__ import annotations

import colorsys
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import camera as C
from tessera.functions import colour as L
from tessera.functions import crs as R
from tessera.functions import tiling as T
from tessera.operators import anchoring as N
from tessera.operators import conversion as K
from tessera.operators import meshes as E
from tessera.operators import metrics as M
from tessera.operators import reports as W
from tessera.queries import meshes as Q
from tessera.queries import vector as S
from tessera.queries import views as B
from tessera.queries.base import P, degrees_of, points, query, s_degrees, s_scaled, s_tx, s_ty, scaled, table
from tessera.sources import content, geojson, tileset

# ---- footprints of orders as GeoJSON, one document each, in metres: none, crossing itself, with a hole, with a hole that sticks out, square


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (k % 5 + 1).cast("double").alias("s"), (k % 1000 * 10.0).alias("x"), (k % 700 * 10.0).alias("y"), (k % 10).alias("kind"))
    at = lambda i, j: F.array(F.col("x") + F.col("s") * i, F.col("y") + F.col("s") * j)
    ring = lambda *ps: F.array(*[at(i, j) for i, j in (*ps, ps[0])])
    square = ring((0, 0), (1, 0), (1, 1), (0, 1))
    hole, out = ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)), ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5))
    rings = F.when(F.col("kind") == 1, F.array(ring((0, 0), (1, 1), (1, 0), (0, 1)))).when(F.col("kind") == 2, F.array(square, hole)).when(F.col("kind") == 3, F.array(square, out)).otherwise(F.array(square))
    named = lambda **kw: F.struct(*[v.alias(n) for n, v in kw.items()])
    geometry = F.when(F.col("kind") > 0, named(type=F.lit("Polygon"), coordinates=rings))
    feature = named(type=F.lit("Feature"), properties=named(height=F.concat((k % 40 - 5).cast("string"), F.lit(".5 m"))), geometry=geometry)
    return o.select("o_orderkey", F.to_json(named(type=F.lit("FeatureCollection"), features=F.array(feature))).alias("text"))


_KIND = "CASE o_orderkey % 10 WHEN 1 THEN {0} WHEN 2 THEN {1} WHEN 3 THEN {2} ELSE {3} END"
_SIDE = "(o_orderkey % 5 + 1)::DOUBLE"


@query(f"""SELECT o_orderkey, ({_KIND.format(2, 1, 2, 1)})::BIGINT AS parts, ({_KIND.format('true', 'false', 'true', 'false')}) AS repaired, {s_scaled(f"{_SIDE} * {_SIDE} * {_KIND.format(0.5, 0.75, 1.5, 1.0)}", 10000)} AS area_cm2,
{s_scaled("least(greatest(CASE WHEN o_orderkey % 40 < 5 THEN (o_orderkey % 40 - 5) - 0.5 ELSE (o_orderkey % 40 - 5) + 0.5 END, 1.0), 1000.0)", 100)} AS height_cm FROM orders WHERE o_orderkey % 10 <> 0""")
def building_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, repair and area of every order's footprint."""
    parts = K.building_parts(geojson.features(_documents(spark, sf_dir), "text"), ["o_orderkey"], crs="EPSG:3857")
    made = parts.groupBy("o_orderkey").agg(F.count("*").alias("parts"), F.max("repaired").alias("repaired"), F.sum(K.footprint_area(F.col("rings"))).alias("area"), F.max("height").alias("height"))
    return made.select("o_orderkey", "parts", "repaired", scaled(F.col("area"), 10000).alias("area_cm2"), scaled(F.col("height"), 100).alias("height_cm"))


@query("""SELECT count(*)::BIGINT AS input_features, sum(CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END)::BIGINT AS building_parts, count(*) FILTER (WHERE o_orderkey % 10 = 0)::BIGINT AS skipped_features,
count(*) FILTER (WHERE o_orderkey % 10 IN (1, 3))::BIGINT AS repaired_features FROM orders""")
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of a conversion from the geometry itself."""
    features = geojson.features(_documents(spark, sf_dir), "text")
    parts = K.building_parts(features, ["o_orderkey"], crs="EPSG:3857")
    return K.feature_statistics(features, parts, ["o_orderkey"]).select("input_features", "building_parts", "skipped_features", "repaired_features")


# ---- the cells' files read back: a building has each corner twice at its foot and three times at its top


@query(f"""SELECT col, row, 20 * count(*)::BIGINT AS vertices, 10 * count(*)::BIGINT AS triangles, {s_scaled('sum(10 * side) / (20 * count(*))', 1000)} AS mean_x_mm, {s_scaled('sum(10 * side) / (20 * count(*))', 1000)} AS mean_y_mm,
{s_scaled('sum(4.0 + 12.0 * height) / (20 * count(*))', 100)} AS mean_z_cm, {s_scaled('max(side)', 1000)} AS east_mm, {s_scaled('0.2 + max(height)', 1000)} AS top_mm, 4 * count(*)::BIGINT AS upward FROM {Q._CELLS} GROUP BY col, row""")
def cell_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the binary glTFs of all cells hold, decoded: counts, mean coordinates and extents."""
    from tessera.plans.staging import Staging

    made = E.cell_meshes(Q._parts(spark, sf_dir).drop("side"))
    files = Staging(spark, "contents").keep(made.select(F.struct("col", "row", "piece").alias("name"), F.col("glb").alias("data")), "files")
    v = content.content_vertices(files).groupBy("name.col", "name.row").agg(F.count("*").alias("vertices"), *[F.avg(c).alias(c) for c in "xyz"], F.max("x").alias("east"), F.max("z").alias("top"), F.count_if(F.col("nz") > 0.5).alias("upward"))
    t = content.content_triangles(files).groupBy("name.col", "name.row").agg(F.count("*").alias("triangles"))
    return v.join(t, ["col", "row"]).select("col", "row", "vertices", "triangles", scaled(F.col("x"), 1000).alias("mean_x_mm"), scaled(F.col("y"), 1000).alias("mean_y_mm"), scaled(F.col("z"), 100).alias("mean_z_cm"), scaled(F.col("east"), 1000).alias("east_mm"), scaled(F.col("top"), 1000).alias("top_mm"), "upward")


# ---- reference systems: each event lies in the zone of 117 degrees east


def _s_zone(zone: R.Zone) -> str:
    """Easting and northing of (lng, lat) by the same series, written out."""
    radius, e, alpha, _ = R._series(zone.flattening)
    t = f"sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat))))"
    xi, eta = "atan2(t, cos(l))", "atanh(sin(l) / sqrt(1 + t * t))"
    east = " + ".join(["eta", *[f"({a!r}) * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(alpha, 1)]])
    north = " + ".join(["xi", *[f"({a!r}) * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(alpha, 1)]])
    inner = f"SELECT *, {xi} AS xi, {eta} AS eta FROM (SELECT *, {t} AS t, radians(lng - {zone.meridian}) AS l FROM place)"
    return f"SELECT event_id, ({east}) * {zone.scale * radius!r} + {zone.east} AS e, ({north}) * {zone.scale * radius!r} + {zone.north} AS n FROM ({inner})"


_UTM, _GK = "EPSG:32650", "EPSG:4548"


@query(f"""WITH place AS (SELECT event_id, 114 + (event_id * 104729 % 6000)::DOUBLE / 1000 AS lng, {s_degrees('event_id')[1]} * 0.9 AS lat FROM events)
SELECT event_id, {s_scaled('u.e', 100)} AS utm_east_cm, {s_scaled('u.n', 100)} AS utm_north_cm, {s_scaled('g.e', 100)} AS gk_east_cm, {s_scaled('g.n', 100)} AS gk_north_cm, {s_scaled('place.lng', 10**7)} AS lng_e7, {s_scaled('place.lat', 10**7)} AS lat_e7
FROM place JOIN ({_s_zone(R.zone_of(32650))}) u USING (event_id) JOIN ({_s_zone(R.zone_of(4548))}) g USING (event_id)""")
def utm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transverse Mercator systems forward, and the first one back."""
    i = F.col("event_id")
    at = table(spark, sf_dir, "events").select("event_id", ((i * 104729 % 6000).cast("double") / 1000 + 114).alias("lng"), (degrees_of(i)[1] * 0.9).alias("lat"))
    (ue, un), (ge, gn) = (R.from_wgs84(F.col("lng"), F.col("lat"), c) for c in (_UTM, _GK))
    there = at.select("event_id", ue.alias("ue"), un.alias("un"), ge.alias("ge"), gn.alias("gn"))
    lng, lat = R.to_wgs84(F.col("ue"), F.col("un"), _UTM)
    # Half a unit of the last place that is compared keeps the way back from falling on the other side of it.
    back = lambda c: F.round(c, 9)
    return there.select("event_id", scaled(F.col("ue"), 100).alias("utm_east_cm"), scaled(F.col("un"), 100).alias("utm_north_cm"), scaled(F.col("ge"), 100).alias("gk_east_cm"), scaled(F.col("gn"), 100).alias("gk_north_cm"), scaled(back(lng), 10**7).alias("lng_e7"), scaled(back(lat), 10**7).alias("lat_e7"))


# ---- anchors: a tileset at the place of each supplier, with one child beside its middle

_at_lng, _at_lat = s_degrees("s_suppkey")
_ORIGIN = (118.0, 24.0)
_MX = f"(6378137.0 * (radians({_at_lng}) - radians({_ORIGIN[0]})))"
_ln = lambda lat: f"ln(tan({math.pi / 4!r} + radians({lat}) / 2))"
_MY = f"(6378137.0 * ({_ln(_at_lat)} - {_ln(_ORIGIN[1])}))"


@query(f"""WITH s AS (SELECT s_suppkey, {_MX} AS mx, {_MY} AS my, s_suppkey % 90 + 10.0 AS h FROM supplier)
SELECT s_suppkey, '0' AS node, {s_scaled('mx + 0.0005', 100)} AS x_cm, {s_scaled('my + 0.0005', 100)} AS y_cm, {s_scaled('h + 5.0005', 100)} AS z_cm FROM s
UNION ALL SELECT s_suppkey, '0/0', {s_scaled('mx + s_suppkey % 50 + 0.0005', 100)}, {s_scaled('my - s_suppkey % 30 + 0.0005', 100)}, {s_scaled('h + 5.0 + s_suppkey % 7 + 0.0005', 100)} FROM s""")
def dataset_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spheres of every node in the map's frame; half a millimetre keeps results from falling between units."""
    k = F.col("s_suppkey")
    lng, lat = degrees_of(k)
    named = lambda **kw: F.struct(*[v.alias(n) for n, v in kw.items()])
    zero, one = F.lit(0.0), F.lit(1.0)
    height = (k % 90 + 10).cast("double")
    child = named(geometricError=F.lit(0.0), boundingVolume=named(sphere=F.array((k % 50).cast("double"), (-(k % 30)).cast("double"), height + k % 7, F.lit(3.0))))
    root = named(geometricError=F.lit(9.0), transform=tileset.enu_to_ecef(lng, lat), boundingVolume=named(box=F.array(zero, zero, height, one, zero, zero, zero, one, zero, zero, zero, one)), children=F.array(child))
    docs = table(spark, sf_dir, "supplier").select(k.cast("string").alias("name"), F.to_json(named(root=root)).alias("text"))
    tree = tileset.nodes(docs, "name", "text")
    local = N.in_frame(tree, N.anchors(tree, *_ORIGIN, lift=5.0))
    return local.select(F.col("tileset").cast("long").alias("s_suppkey"), "node", *[scaled(F.col(c) + 0.0005, 100).alias(f"{c}_cm") for c in "xyz"])


# ---- rays through pixels to the ground and back

_PX, _PY = "(event_id * 37 % 1281)::DOUBLE", "(430 + event_id * 53 % 431)::DOUBLE"
_ACROSS, _UP = f"(({_PX} / 1280 * 2 - 1) * ({B._T} * 1280 / 860))", f"((1 - {_PY} / 860 * 2) * {B._T})"


@query(f"""WITH {B._BASIS}, ray AS (SELECT event_id, ex, ey, ez, ax + rx_ * {_ACROSS} + ux * {_UP} AS dx, ay + ry_ * {_ACROSS} + uy * {_UP} AS dy, az + uz * {_UP} AS dz FROM basis)
SELECT event_id, {s_scaled('CASE WHEN -ez / dz >= 0 THEN ex + dx * (-ez / dz) END', 10)} AS ground_x_dm, {s_scaled('CASE WHEN -ez / dz >= 0 THEN ey + dy * (-ez / dz) END', 10)} AS ground_y_dm,
  CASE WHEN -ez / dz >= 0 THEN CAST({_PX} AS BIGINT) END AS px, CASE WHEN -ez / dz >= 0 THEN CAST({_PY} AS BIGINT) END AS py FROM ray""")
def screen_ground_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground under a pixel of each event's camera, and the pixel of that ground."""
    i = F.col("event_id")
    seen = C.with_basis(B._seen(spark, sf_dir)).withColumns({"px": (i * 37 % 1281).cast("double"), "py": (i * 53 % 431 + 430).cast("double")})
    seen = seen.withColumn("g", C.ground_under(F.col("px"), F.col("py"), 1280.0, 860.0, 60.0))
    seen = seen.withColumn("back", C.pixel_of(F.col("g"), 1280.0, 860.0, 60.0, 100.0, 1e6))
    return seen.select("event_id", scaled(F.col("g.x"), 10).alias("ground_x_dm"), scaled(F.col("g.y"), 10).alias("ground_y_dm"), F.round("back.x").cast("long").alias("px"), F.round("back.y").cast("long").alias("py"))


# ---- colours of levels

_HSL = ", ".join("({!r}, {!r}, {!r})".format(h, s, light) for h, light, s in (colorsys.rgb_to_hls(*[L.linear((c >> b & 255) / 255) for b in (16, 8, 0)]) for c in L.LEVELS))
_CH = lambda turn: f"(CASE WHEN t{turn} < {1 / 6!r} THEN lo + (q - lo) * 6 * t{turn} WHEN t{turn} < 0.5 THEN q WHEN t{turn} < {2 / 3!r} THEN lo + (q - lo) * 6 * ({2 / 3!r} - t{turn}) ELSE lo END)"
_BYTE = lambda c: f"CAST(floor(greatest(least((CASE WHEN {c} < 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 0.41666) - 0.055 END) * 255, 255.0), 0.0) + 0.5) AS INTEGER)"


@query(f"""WITH hsl AS (SELECT row_number() OVER () - 1 AS z, * FROM (VALUES {_HSL}) v(h, s, l)),
t AS (SELECT event_id, event_id % 26 AS z, {s_tx('lng', 8)} AS x, {s_ty('lat', 8)} AS y FROM {P}),
b AS (SELECT event_id, coalesce(h, (t.z * 137.508) % 360 / 360) AS h, coalesce(s, 0.72) AS s, greatest(least(coalesce(l, 0.52) + ((xor(x * 73856093, y * 19349663) & 4294967295) % 3 - 1) * 0.04, 1.0), 0.0) AS l FROM t LEFT JOIN hsl USING (z)),
q AS (SELECT *, 2 * l - q AS lo FROM (SELECT *, CASE WHEN l <= 0.5 THEN l * (1 + s) ELSE l + s - l * s END AS q, (h + {1 / 3!r}) - floor(h + {1 / 3!r}) AS t0, h - floor(h) AS t1, (h - {1 / 3!r}) - floor(h - {1 / 3!r}) AS t2 FROM b))
SELECT event_id, {_BYTE(_CH(0))} AS red, {_BYTE(_CH(1))} AS green, {_BYTE(_CH(2))} AS blue FROM q""")
def level_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour of each event's tile at a level by its id."""
    eight = F.lit(8)
    tiles = points(spark, sf_dir).select("event_id", (F.col("event_id") % 26).cast("int").alias("z"), T.tile_x(F.col("lng"), eight).alias("x"), T.tile_y(F.col("lat"), eight).alias("y"))
    made = tiles.select("event_id", L.level_colour(F.col("z"), F.col("x"), F.col("y")).alias("c"))
    return made.select("event_id", *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("red", "green", "blue"))])


# ---- a report of scenarios against limits and against the samples of even number as the earlier run

_VALUES = "(SELECT scenario, unnest(['peak_blur', 'final_blur', 'peak_gaps', 'final_gaps']) AS metric, unnest([max(blur), arg_max(blur, seq), max(gaps), arg_max(gaps, seq)])::DOUBLE AS value FROM {0} GROUP BY scenario)"


@query(f"""WITH v AS {_VALUES.format(S._SM)}, b AS {_VALUES.format('(SELECT * FROM ' + S._SM + ' WHERE seq % 2 = 0)')}
SELECT v.scenario, v.metric, v.value, CASE WHEN v.metric = 'final_blur' AND v.value > 50 OR v.metric = 'final_gaps' AND v.value < 20 OR v.metric LIKE 'peak%' AND v.value > 99.5 THEN 'fail' ELSE 'pass' END AS verdict, b.value AS baseline, v.value - b.value AS change
FROM v LEFT JOIN b USING (scenario, metric)""")
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every scenario with its verdict, the earlier value and the change."""
    names = ["peak_blur", "final_blur", "peak_gaps", "final_gaps"]
    samples = S._samples(spark, sf_dir)
    values = lambda df: W.long_values(M.scenario_summary(df, "scenario", "seq", ["blur", "gaps"]), "scenario", names)
    now = values(samples)
    spec = now.select("scenario", "metric", F.when(F.col("metric") == "final_blur", 50.0).when(F.col("metric").like("peak%"), 99.5).alias("max"), F.when(F.col("metric") == "final_gaps", 20.0).alias("min"))
    return W.compare(now, spec, values(samples.where("seq % 2 = 0"))).select("scenario", "metric", "value", "verdict", "baseline", "change")
