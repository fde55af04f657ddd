"""Footprints as meshes: conversion statistics, tops, edges, bounds and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parsing as G
from tessera.operators import conversion as K
from tessera.operators import meshes as N
from tessera.operators import triangles as R
from tessera.operators import vectors as W
from tessera.queries.base import P, points, query, s_scaled, scaled, table
from tessera.queries.vector import _NUM, B, buildings
from tessera.sources.tileset import tileset_json

# Each order is a box: corners 0 to 3 below, 4 to 7 above; twelve triangles, and a ninth vertex in none.
_SIDE = "(id % 5 + 1)"
_VX = f"(SELECT id AS mesh, v::INTEGER AS vertex, CASE WHEN v % 4 IN (1, 2) THEN {_SIDE} ELSE 0 END::DOUBLE AS x, CASE WHEN v % 4 IN (2, 3) THEN {_SIDE} ELSE 0 END::DOUBLE AS y, CASE WHEN v = 8 THEN 99 WHEN v < 4 THEN -1 ELSE id % 30 - 3 END::DOUBLE AS z FROM {B}, (SELECT unnest(range(0, 9)) AS v))"
_FACES = [(0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7), (4, 5, 6), (4, 6, 7), (0, 2, 1), (0, 3, 2)]


def _boxes(spark: SparkSession, sf_dir: str, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles.  ``dealt`` deals the orders out by mesh before they become many rows, in partitions that are sorted in memory."""
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mesh"))
    if dealt:
        b = b.repartition(b.count() // 20_000 + 1, "mesh")
    v = b.withColumn("vertex", F.explode(F.array(*map(F.lit, range(9)))))
    side, k = (F.col("mesh") % 5 + 1).cast("double"), F.col("vertex")
    z = F.when(k == 8, 99).when(k < 4, -1).otherwise(F.col("mesh") % 30 - 3).cast("double")
    v = v.select("mesh", "vertex", F.when((k % 4).isin(1, 2), side).otherwise(0.0).alias("x"), F.when((k % 4).isin(2, 3), side).otherwise(0.0).alias("y"), z.alias("z"))
    faces = F.array(*[F.struct(*[F.lit(i).alias(n) for i, n in zip(f, "abc", strict=True)]) for f in _FACES])
    return v, b.select("mesh", F.explode(faces).alias("f")).select("mesh", "f.*")


@query(f"SELECT mesh, vertex, CASE WHEN vertex = 8 THEN 0 ELSE greatest(mesh % 30 - 3, -1, 0) END::BIGINT AS top FROM {_VX}")
def building_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.building_top(*_boxes(spark, sf_dir, dealt=True)).select("mesh", "vertex", F.col("top").cast("long").alias("top"))


@query(f"SELECT mesh, min(z)::BIGINT AS low, max(z)::BIGINT AS high FROM {_VX} GROUP BY mesh")
def mesh_height_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.height_range(_boxes(spark, sf_dir)[0]).select("mesh", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


@query(f"SELECT mesh % 64 AS cell, min(x)::BIGINT AS x0, max(x)::BIGINT AS x1, min(y)::BIGINT AS y0, max(y)::BIGINT AS y1, min(z)::BIGINT AS z0, max(z)::BIGINT AS z1 FROM {_VX} GROUP BY ALL")
def bounds_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _boxes(spark, sf_dir)[0].withColumn("cell", F.col("mesh") % 64)
    return R.bounds(v, ["cell"]).select("cell", *[F.col(f"{c}{k}").cast("long").alias(f"{c}{k}") for c in "xyz" for k in (0, 1)])


@query("SELECT o_orderkey AS id, edge, CASE WHEN edge < 2 AND least(h0, h1) > 0.7 AND abs(h1 - h0) <= 0.05 THEN 'roof' ELSE 'facade' END AS kind FROM (SELECT *, CASE WHEN edge = 2 THEN 0.2 ELSE o_orderkey % 9 / 4.0 END AS h0, CASE WHEN edge = 1 THEN o_orderkey % 9 / 4.0 + 0.04 ELSE o_orderkey % 9 / 4.0 END AS h1 FROM orders, (SELECT unnest(range(0, 3)) AS edge))")
def roof_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("edge"))
    high = F.col("id") % 9 / 4.0
    h0, h1 = F.when(F.col("edge") == 2, 0.2).otherwise(high), F.when(F.col("edge") == 1, high + 0.04).otherwise(high)
    return e.select("id", "edge", F.when(R.is_roof_edge(h0, h1, F.lit(0.2)), "roof").otherwise("facade").alias("kind"))


# ---- conversion of features to parts

_H = f"least(greatest({_NUM} * 3.0, 1.0), 1000.0)"
_FEATURES = f"(SELECT id, CASE id % 11 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS parts, id % 13 = 5 AS repaired, {s_scaled(_H, 100)} AS height FROM {B})"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with their numbers of polygons, one after another."""
    k = F.col("id") % 11
    b = buildings(spark, sf_dir)
    return b.select("id", F.when(k == 0, 0).when(k == 1, 2).otherwise(1).alias("parts"), (F.col("id") % 13 == 5).alias("repaired"), scaled(G.building_height(F.col("height"), 3.0), 100).alias("height"))


@query(f"""SELECT count(*)::BIGINT AS input_features, sum(parts)::BIGINT AS building_parts, count(*) FILTER (WHERE parts = 0)::BIGINT AS skipped_features, count(*) FILTER (WHERE repaired AND parts > 0)::BIGINT AS repaired_features,
min(height) FILTER (WHERE parts > 0) AS min_height, max(height) FILTER (WHERE parts > 0) AS max_height FROM {_FEATURES}""")
def conversion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.statistics(_features(spark, sf_dir))


@query(f"SELECT user_id, {s_scaled('min(lng)', 1000)} AS west, {s_scaled('min(lat)', 1000)} AS south, {s_scaled('max(lng)', 1000)} AS east, {s_scaled('max(lat)', 1000)} AS north FROM {P} GROUP BY user_id HAVING count(*) >= 3")
def points_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = K.bounds_of(points(spark, sf_dir), ["user_id"], "lng", "lat", least=3)
    return box.select("user_id", *[scaled(F.col(c), 1000).alias(c) for c in ("west", "south", "east", "north")])


_FCLASS = "['motorway', 'primary', 'footway', 'subway', 'rail', 'river'][(user_id % 6 + 1)::INTEGER]"


@query(f"""SELECT user_id, kind, count(*)::BIGINT AS segments, max(altitude)::BIGINT AS altitude_cm FROM (SELECT user_id, CASE WHEN {_FCLASS} IN ('motorway', 'primary') THEN 'major road' WHEN {_FCLASS} = 'subway' THEN 'subway' WHEN {_FCLASS} = 'rail' THEN 'rail' WHEN {_FCLASS} = 'river' THEN 'water' ELSE 'local road' END AS kind,
{s_scaled(f"CASE WHEN {_FCLASS} IN ('subway', 'rail') THEN 3.2 + least(greatest(CAST(user_id % 9 - 4 AS DOUBLE), -2.0), 3.0) * 0.45 WHEN {_FCLASS} = 'river' THEN 1.15 ELSE 2.4 END", 100)} AS altitude, lng, lat, lag(lng) OVER w AS x0, lag(lat) OVER w AS y0
FROM {P} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE x0 IS NOT NULL AND (lng - x0) * (lng - x0) + (lat - y0) * (lat - y0) > 1e-8 GROUP BY ALL""")
def class_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("user_id", "ts", "event_id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    fclass = F.element_at(F.array(*map(F.lit, ("motorway", "primary", "footway", "subway", "rail", "river"))), (F.col("user_id") % 6 + 1).cast("int"))
    kind, altitude = K.line_kind(fclass), K.line_altitude(K.line_kind(fclass), (F.col("user_id") % 9 - 4).cast("string"))
    s = W.segments(p, "user_id", ["ts", "event_id"])
    return s.groupBy("user_id", kind.alias("kind")).agg(F.count("*").alias("segments"), F.max(scaled(altitude, 100)).alias("altitude_cm"))


@query("SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 3 + 4 * (o_orderkey % 4) END)::INTEGER AS corners FROM orders")
def ring_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ring(3).alias("outer"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 4), lambda i: F.when(i > 0, ring(4))).alias("holes"))
    return o.select("id", F.size(W.all_corners(F.col("outer"), F.array_compact("holes"))).alias("corners"))


# No SQL engine has this hash; a test compares with hashlib.
@query(None)
def feature_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = buildings(spark, sf_dir).select("id", G.building_height(F.col("height"), 3.0).alias("height"))
    return K.with_colours(b, "id", "height").select("id", "wall", "roof")


# ---- cells of a grid as files and as a tileset

_CELLS = "(SELECT o_orderkey % 8 AS col, o_orderkey // 8 % 8 AS row, o_orderkey AS id, o_orderkey % 5 + 1 AS side, o_orderkey % 30 + 3 AS height FROM orders)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).alias("col"), (F.floor(F.col("o_orderkey") / 8) % 8).alias("row"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("side"), (F.col("o_orderkey") % 30 + 3).cast("double").alias("height"))
    corner = lambda x, y: F.struct((F.col("side") * x).alias("x"), (F.col("side") * y).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return o.select("col", "row", "id", F.array(ring).alias("rings"), F.lit(0.2).alias("base"), "height", "side")


@query(f"SELECT col, row, count(*)::BIGINT AS parts, 20 * count(*)::BIGINT AS vertices, 10 * count(*)::BIGINT AS triangles FROM {_CELLS} GROUP BY col, row")
def cell_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = N.cell_meshes(_parts(spark, sf_dir).drop("side"))
    return made.groupBy("col", "row").agg(*[F.sum(c).alias(c) for c in ("parts", "vertices", "triangles")])


@query(f"""WITH c AS (SELECT col, row, count(*) AS parts, col * 100.0 AS x0, row * 100.0 AS y0, col * 100.0 + max(side) AS x1, row * 100.0 + max(side) AS y1, 0.2 + max(height) AS z1 FROM {_CELLS} GROUP BY col, row)
SELECT 'REPLACE' AS refine, {s_scaled('sqrt(pow(max(x1) - min(x0), 2) + pow(max(y1) - min(y0), 2))', 100)} AS error, count(*)::BIGINT AS tiles, sum(parts)::BIGINT AS parts, {s_scaled('greatest(abs(min(x0)), abs(max(x1)))', 100)} AS half_x, {s_scaled('(0.2 + max(z1)) / 2', 100)} AS mid_z FROM c""")
def tileset_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _parts(spark, sf_dir).groupBy("col", "row").agg(F.count("*").alias("parts"), F.max("side").alias("s"), F.max("height").alias("h"))
    x, y = F.col("col") * 100.0, F.col("row") * 100.0
    c = c.select("col", "row", F.concat_ws("_", F.lit("tile"), "col", "row").alias("name"), x.alias("x0"), y.alias("y0"), F.lit(0.2).alias("z0"), (x + F.col("s")).alias("x1"), (y + F.col("s")).alias("y1"), (F.col("h") + 0.2).alias("z1"), "parts", (F.col("parts") * 20).alias("vertices"), (F.col("parts") * 10).alias("triangles"))
    at = lambda path: F.get_json_object("tileset", path)
    return tileset_json(c, 118.1, 24.48).select(at("$.root.refine").alias("refine"), scaled(at("$.root.geometricError").cast("double"), 100).alias("error"), at("$.extras.tileCount").cast("long").alias("tiles"), at("$.extras.buildingParts").cast("long").alias("parts"), scaled(at("$.root.boundingVolume.box[3]").cast("double"), 100).alias("half_x"), scaled(at("$.root.boundingVolume.box[2]").cast("double"), 100).alias("mid_z"))


# Customers in chains of various steps.
_EDGES = "(SELECT c_custkey AS a, c_custkey + CASE WHEN c_custkey % 10 < 5 THEN 10 ELSE 30 END AS b FROM customer)"


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}), r(v, t) AS (SELECT a, a FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t)
SELECT v, min(t) AS label FROM r GROUP BY v""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.components import connected_components as components
    from tessera.plans.staging import Staging

    k = F.col("c_custkey")
    edges = table(spark, sf_dir, "customer").select(k.alias("a"), (k + F.when(k % 10 < 5, 10).otherwise(30)).alias("b"))
    return components(edges, Staging(spark, "components-query"))
