"""Cameras and tiles: distances, projection, frustum, subdivision, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import camera as C
from tessera.functions import lod as L
from tessera.functions import parsing as G
from tessera.functions import tiling as T
from tessera.operators import hierarchy as H
from tessera.operators import overview as O
from tessera.operators import queueing as Q
from tessera.operators import triangles as R
from tessera.queries.base import P, TL, V, points, query, s_gx, s_gy, s_scaled, s_tx, s_ty, scaled, table, tiles, views

# Each event has the tile of zoom 8 it lies in and a camera south of it, in metres of the Mercator plane.
_HALF = 20037508.342789244
_SIDE = 2 * _HALF / 256
_FOV, _ASPECT, _NEAR, _FAR, _W, _H = 60.0, 1.5, 100.0, 1e6, 1280.0, 860.0
_SEEN = f"""(SELECT *, x0 + {_SIDE} / 2 AS cx, y0 + {_SIDE} / 2 AS cy, x0 + {_SIDE} AS x1, y0 + {_SIDE} AS y1,
  x0 + {_SIDE} / 2 + (event_id % 7 - 3) * 30000.0 AS ex, y0 + {_SIDE} / 2 - 60000.0 - (event_id % 5) * 20000.0 AS ey, 40000.0 + (event_id % 11) * 9000.0 AS ez,
  x0 + {_SIDE} / 2 + (event_id % 3 - 1) * 20000.0 AS tx, y0 + {_SIDE} / 2 + (event_id % 4) * 15000.0 AS ty, 0.0 AS tz, (event_id % 6) * 100.0 AS h
  FROM (SELECT event_id, x * {_SIDE} - {_HALF} AS x0, {_HALF} - (y + 1) * {_SIDE} AS y0 FROM (SELECT event_id, {s_tx('lng', 8)} AS x, {s_ty('lat', 8)} AS y FROM {P})))"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, i = F.lit(8), F.col("event_id")
    p = points(spark, sf_dir).select("event_id", (T.tile_x(F.col("lng"), z) * _SIDE - _HALF).alias("x0"), (F.lit(_HALF) - (T.tile_y(F.col("lat"), z) + 1) * _SIDE).alias("y0"))
    p = p.withColumns({"cx": F.col("x0") + _SIDE / 2, "cy": F.col("y0") + _SIDE / 2, "x1": F.col("x0") + _SIDE, "y1": F.col("y0") + _SIDE})
    p = p.withColumn("eye", F.struct((F.col("cx") + (i % 7 - 3) * 30000.0).alias("x"), (F.col("cy") - 60000.0 - (i % 5) * 20000.0).alias("y"), (F.lit(40000.0) + (i % 11) * 9000.0).alias("z")))
    p = p.withColumn("target", F.struct((F.col("cx") + (i % 3 - 1) * 20000.0).alias("x"), (F.col("cy") + (i % 4) * 15000.0).alias("y"), F.lit(0.0).alias("z")))
    return p.withColumn("h", (i % 6) * 100.0)


def _v(name: str):
    return F.col(f"{name}.x"), F.col(f"{name}.y"), F.col(f"{name}.z")


_CENTER = lambda: (F.col("cx"), F.col("cy"), F.col("h"))
_s_dist = lambda a, b, h="h": f"sqrt((cx - {a}x) * (cx - {a}x) + (cy - {a}y) * (cy - {a}y) + ({h} - {b}) * ({h} - {b}))"


@query(f"SELECT event_id, {s_scaled(_s_dist('t', 'tz'), 10)} AS target_dm, {s_scaled('least(' + _s_dist('t', 'tz') + ', ' + _s_dist('e', 'ez') + ')', 10)} AS nearest_dm FROM {_SEEN}")
def tile_center_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seen(spark, sf_dir)
    return s.select("event_id", scaled(C.distance(_CENTER(), _v("target")), 10).alias("target_dm"), scaled(C.nearest_of(_CENTER(), _v("target"), _v("eye")), 10).alias("nearest_dm"))


@query(f"SELECT event_id, {s_scaled('least(' + _s_dist('t', 'tz', '0') + ', ' + _s_dist('e', 'ez', '0') + ')', 10)} AS priority_dm FROM {_SEEN}")
def imagery_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    ground = (F.col("cx"), F.col("cy"), F.lit(0.0))
    return _seen(spark, sf_dir).select("event_id", scaled(C.nearest_of(ground, _v("target"), _v("eye")), 10).alias("priority_dm"))


@query(f"SELECT event_id, {s_scaled('sqrt(pow(ex - greatest(least(ex, x1), x0), 2) + pow(ey - greatest(least(ey, y1), y0), 2))', 10)} AS ground_dm FROM {_SEEN}")
def tile_rect_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.rectangle_distance(F.col("eye.x"), F.col("eye.y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return _seen(spark, sf_dir).select("event_id", scaled(d, 10).alias("ground_dm"))


@query(f"SELECT event_id, {s_scaled('-sin(radians(event_id % 360)) * f', 10)} AS dx_dm, {s_scaled('-cos(radians(event_id % 360)) * f', 10)} AS dy_dm FROM (SELECT event_id, (event_id % 500 + 10) / tan(radians(greatest(least(event_id % 120, 90), 1)::DOUBLE)) AS f FROM events)")
def camera_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x, y, _ = C.placed_offset((i % 500 + 10).cast("double"), (i % 120).cast("double"), (i % 360).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", scaled(x, 10).alias("dx_dm"), scaled(y, 10).alias("dy_dm"))


_off = "sqrt((ex - tx) * (ex - tx) + (ey - ty) * (ey - ty) + ez * ez)"
_want = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 1000.0 END"


@query(f"SELECT event_id, {s_scaled(f'(ez) * greatest(least(coalesce({_want}, {_off}), 150000.0), 50.0) / {_off}', 10)} AS height_dm FROM {_SEEN}")
def zoom_to_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 1000.0)
    return _seen(spark, sf_dir).select("event_id", scaled(C.zoomed_offset(_v("eye"), _v("target"), wanted, 50.0, 150000.0)[2], 10).alias("height_dm"))


# ---- projection

_T = "tan(radians(60.0) / 2)"
_BASIS = f"""basis AS (SELECT *, ax * rx_ + ay * ry_ AS zero_, ry_ * az AS ux, -rx_ * az AS uy, rx_ * ay - ry_ * ax AS uz FROM (
  SELECT *, ay / sqrt(ax * ax + ay * ay) AS rx_, -ax / sqrt(ax * ax + ay * ay) AS ry_ FROM (
  SELECT *, (tx - ex) / {_off} AS ax, (ty - ey) / {_off} AS ay, (tz - ez) / {_off} AS az FROM {_SEEN})))"""
_PROJECTED = f"""{_BASIS},
probes AS (SELECT *, unnest([cx, x0, x1, x1, x0]) - ex AS dx, unnest([cy, y1, y1, y0, y0]) - ey AS dy, h - ez AS dz FROM basis),
ndc AS (SELECT event_id, ex, ey, ez, cx, cy, h, d, (dx * rx_ + dy * ry_) / (d * ({_T} * 1.5)) AS nx, (dx * ux + dy * uy + dz * uz) / (d * {_T}) AS ny,
  ({_FAR} + {_NEAR}) / ({_FAR} - {_NEAR}) - 2 * {_FAR} * {_NEAR} / ({_FAR} - {_NEAR}) / d AS nz FROM (SELECT *, dx * ax + dy * ay + dz * az AS d FROM probes)),
held AS (SELECT event_id, any_value({_s_dist('e', 'ez')}) AS dist, count(*) FILTER (WHERE nz BETWEEN -1 AND 1) = 5 AS reliable, coalesce(greatest((max(nx) FILTER (WHERE nz BETWEEN -1 AND 1) - min(nx) FILTER (WHERE nz BETWEEN -1 AND 1)) * 640, (max(ny) FILTER (WHERE nz BETWEEN -1 AND 1) - min(ny) FILTER (WHERE nz BETWEEN -1 AND 1)) * 430), 0) AS pixel_size,
  coalesce((max(greatest(least(nx, 1), -1)) FILTER (WHERE nz BETWEEN -1 AND 1) - min(greatest(least(nx, 1), -1)) FILTER (WHERE nz BETWEEN -1 AND 1)) * 640, 0) AS w,
  coalesce((max(greatest(least(ny, 1), -1)) FILTER (WHERE nz BETWEEN -1 AND 1) - min(greatest(least(ny, 1), -1)) FILTER (WHERE nz BETWEEN -1 AND 1)) * 430, 0) AS v FROM ndc GROUP BY event_id)"""


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.with_basis(_seen(spark, sf_dir))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col("h").alias("z"))
    s = s.withColumn("probes", F.array(*[corner(x, y) for x, y in (("cx", "cy"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0"), ("x0", "y0"))]))
    return C.screen_size(s, "probes", _FOV, _ASPECT, _NEAR, _FAR, _W, _H)


@query(f"WITH {_PROJECTED} SELECT event_id, reliable, {s_scaled('least(pixel_size, 1e9)', 10)} AS pixels_dpx, {s_scaled('greatest(w, v)', 10)} AS visible_dpx, {s_scaled('least(w, v)', 10)} AS slim_dpx FROM held")
def screen_probe_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _projected(spark, sf_dir)
    return p.select("event_id", "reliable", scaled(F.least("pixel_size", F.lit(1e9)), 10).alias("pixels_dpx"), scaled(F.col("visible_size"), 10).alias("visible_dpx"), scaled(F.col("visible_min"), 10).alias("slim_dpx"))


_ERR = "(78271.516964 / pow(2, 8) * 860.0 / (dist * 2 * tan(radians(60.0) / 2)))"


@query(f"WITH {_PROJECTED} SELECT event_id, event_id % 5 <> 0 AND (NOT reliable OR least(w, v) > 256) AND ({_ERR} > 2.0 OR pixel_size > 512) AS divide FROM held")
def subdivide_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _projected(spark, sf_dir)
    error = L.terrain_error(F.lit(8.0), C.distance(_CENTER(), _v("eye")), F.lit(_H), F.lit(_FOV))
    return p.select("event_id", C.shall_subdivide(error, 2.0, F.col("pixel_size"), F.col("visible_min"), F.col("reliable"), 256.0, F.col("event_id") % 5 != 0).alias("divide"))


_plane = lambda f, sx, sy, sz, shift: f"{{'x': ax * {f} + {sx}, 'y': ay * {f} + {sy}, 'z': az * {f} + {sz}, 's': {shift}}}"
_PLANES = f"[{_plane(f'({_T} * 1.5)', '-rx_', '-ry_', '0', '0')}, {_plane(f'({_T} * 1.5)', 'rx_', 'ry_', '0', '0')}, {_plane(_T, '-ux', '-uy', '-uz', '0')}, {_plane(_T, 'ux', 'uy', 'uz', '0')}, {_plane('1', '0', '0', '0', f'-{_NEAR}')}, {_plane('-1', '0', '0', '0', str(_FAR))}]"


@query(f"""WITH {_BASIS}, p AS (SELECT *, unnest({_PLANES}) AS q FROM basis)
SELECT event_id, bool_and(q.x * ((CASE WHEN q.x > 0 THEN x1 ELSE x0 END) - ex) + q.y * ((CASE WHEN q.y > 0 THEN y1 ELSE y0 END) - ey) + q.z * ((CASE WHEN q.z > 0 THEN h ELSE 0 END) - ez) + q.s >= 0) AS seen FROM p GROUP BY event_id""")
def frustum_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.with_basis(_seen(spark, sf_dir)).withColumn("planes", C.frustum_planes(_FOV, _ASPECT, _NEAR, _FAR))
    seen = C.box_in_frustum(F.col("planes"), (F.col("x0"), F.col("y0"), F.lit(0.0)), (F.col("x1"), F.col("y1"), F.col("h")))
    return s.select("event_id", seen.alias("seen"))


@query(f"SELECT view, NOT (east < -30.0 - 60.0 OR west > 30.0 + 60.0 OR north < -20.0 - 40.0 OR south > 20.0 + 40.0) AS near FROM {V()}")
def expanded_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = tuple(map(F.col, ("west", "south", "east", "north")))
    return views(spark, sf_dir).select("view", C.near_view(box, tuple(F.lit(x) for x in (-30.0, -20.0, 30.0, 20.0))).alias("near"))


@query("SELECT event_id, CASE WHEN greatest(least(event_id % 24 - 1, 19), 1) < event_id % 5 + 6 THEN 'overview' ELSE 'detail' END AS layer FROM events")
def layer_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoom = F.greatest(F.least(F.col("event_id") % 24 - 1, F.lit(19)), F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", O.layer_for(zoom, F.col("event_id") % 5 + 6).alias("layer"))


# The canvas of a geographic tile of zoom z in imagery of level l is 256 * 2 ** l pixels a turn wide.
_b = ("x / 64.0 * 360 - 180", "y / 32.0 * 180 - 90", "(x + 1) / 64.0 * 360 - 180", "(y + 1) / 32.0 * 180 - 90")
_py = lambda lat: f"((1 - ln(tan(radians(greatest(least({lat}, 85.05112878), -85.05112878))) + 1 / cos(radians(greatest(least({lat}, 85.05112878), -85.05112878)))) / pi()) / 2)"


@query(f"""WITH g AS (SELECT x, y, l, floor((e - w) / 360.0 * 256 * (1::BIGINT << l::INTEGER) + 0.5) AS cw, floor(({_py('s')} - {_py('n')}) * 256 * (1::BIGINT << l::INTEGER) + 0.5) AS ch FROM
  (SELECT x, y, {_b[0]} AS w, {_b[1]} AS s, {_b[2]} AS e, {_b[3]} AS n FROM (SELECT DISTINCT {s_gx('lng', 5)} AS x, {s_gy('lat', 5, 'south')} AS y FROM {P})), (SELECT unnest(range(5, 13)) AS l))
SELECT x, y, coalesce(max(l) FILTER (WHERE cw <= 2048 AND ch <= 2048), 5)::INTEGER AS level FROM g GROUP BY x, y""")
def imagery_level_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(5)
    g = points(spark, sf_dir).select(T.geo_x(F.col("lng"), z).alias("x"), T.geo_y(F.col("lat"), z, "south").alias("y")).distinct()
    w, s, e, n = T.geo_bounds(F.col("x"), F.col("y"), z, "south")
    g = g.select("x", "y", w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))
    return g.select("x", "y", L.fitting_imagery_level(F.col("w"), F.col("s"), F.col("e"), F.col("n"), 5, 12, 2048).alias("level"))


# ---- queues and sets of tiles

_TQ = f"(SELECT z * 1000000 + x * 1000 + y AS key, z, x, y, (x * 7919 + y * 104729) % 1000 AS px, (x + y) % 3 = 0 AS fallback FROM {TL(7)})"


def _queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return tiles(spark, sf_dir, 7).select((F.col("z") * 1000000 + x * 1000 + y).alias("key"), "z", "x", "y", ((x * 7919 + y * 104729) % 1000).alias("px"), ((x + y) % 3 == 0).alias("fallback"))


@query(f"SELECT key, {s_scaled('CASE WHEN fallback THEN px / 4.0 ELSE px END', 100)} AS score FROM {_TQ} ORDER BY CASE WHEN fallback THEN px / 4.0 ELSE px END DESC, key LIMIT 40")
def imagery_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = Q.largest_first(_queued(spark, sf_dir), Q.upgrade_score(F.col("px"), F.col("fallback")), 40)
    return top.select("key", scaled(F.col("score").cast("double"), 100).alias("score"))


@query(f"SELECT key, px FROM {_TQ} ORDER BY px DESC, key LIMIT 32")
def tiles3d_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.largest_first(_queued(spark, sf_dir), F.col("px"), 32).select("key", "px")


@query(f"SELECT key, px FROM {_TQ} WHERE NOT fallback ORDER BY px, key LIMIT (SELECT least(6, count(*)) FROM {_TQ} WHERE NOT fallback)")
def frame_start_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bounded_queue(_queued(spark, sf_dir).where("not fallback").withColumnRenamed("px", "priority"), 6).select("key", F.col("priority").alias("px"))


@query(f"SELECT key, row_number() OVER (ORDER BY (x - 64) * (x - 64) + (y - 64) * (y - 64), key) <= 50 AS first FROM {_TQ} QUALIFY row_number() OVER (ORDER BY (x - 64) * (x - 64) + (y - 64) * (y - 64), key) <= 50")
def tiles_to_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = (F.col("x") - 64) * (F.col("x") - 64) + (F.col("y") - 64) * (F.col("y") - 64)
    return Q.largest_first(_queued(spark, sf_dir), -far, 50).select("key", F.lit(True).alias("first"))


@query(f"SELECT key FROM {_TQ} WHERE fallback AND ((x, y) IN (SELECT (x, y) FROM {TL(7, 2, 0)}) OR (x, y) IN (SELECT (x, y) FROM {TL(7, 3, 0)}))")
def retained_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tiles(spark, sf_dir, 7, 2, 0).union(tiles(spark, sf_dir, 7, 3, 0))
    return _queued(spark, sf_dir).where("fallback").join(kept, ["z", "x", "y"], "left_semi").select("key")


@query(f"SELECT z::INTEGER AS z, x, y, px FROM {_TQ} WHERE NOT fallback AND px > 1")
def renderable_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _queued(spark, sf_dir).select("z", "x", "y", "px", (~F.col("fallback")).alias("ready"), F.lit(True).alias("visible"), (F.col("px") / 1000).alias("opacity"))
    return ready.where(H.renderable(F.col("ready"), F.col("visible"), F.col("opacity"))).select("z", "x", "y", "px")


@query("SELECT DISTINCT request FROM (SELECT o_custkey AS request, bool_or(o_orderkey % 3 = 0) OVER (PARTITION BY o_custkey) AS active FROM orders) WHERE NOT active")
def ownerless_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("owner"))
    return Q.ownerless(o, o.where("owner % 3 = 0").select("owner"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 < 3 THEN least(coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 9 + 1 END, 6), o_custkey % 5 + 2) ELSE coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 9 + 1 END, 6) END::BIGINT AS effective FROM orders")
def group_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("grp"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 9 + 1).alias("cap"))
    limits = spark.range(3).select(F.col("id").alias("grp"), (F.col("id") + 2).alias("group_cap"))
    return Q.effective_caps(o, F.broadcast(limits), 6).select("id", F.col("effective").cast("long").alias("effective"))


@query(f"SELECT z::INTEGER AS z, x, y, 'https://t' || (x + y + z) % 8 || '.tianditu.gov.cn/DataServer?T=img_w&x=' || x || '&y=' || y || '&l=' || z || '&tk=key' AS url FROM {TL(9)}")
def url_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = G.xyz_url(F.lit(G.vendor_url("img_w", "key")), F.col("x"), F.col("y"), F.col("z"), [str(k) for k in range(8)])
    return tiles(spark, sf_dir, 9).select("z", "x", "y", url.alias("url"))


# ---- rays and quads

@query(f"""SELECT event_id, {s_scaled('CASE WHEN greatest(n0, 0) <= f0 THEN greatest(n0, 0) END', 1000)} AS box_at FROM (SELECT event_id, greatest(least((0 - ox) / dx, (10 - ox) / dx), least((0 - oy) / dy, (10 - oy) / dy), least((0 - 5.0) / -1, (3 - 5.0) / -1)) AS n0,
  least(greatest((0 - ox) / dx, (10 - ox) / dx), greatest((0 - oy) / dy, (10 - oy) / dy), greatest((0 - 5.0) / -1, (3 - 5.0) / -1)) AS f0 FROM (SELECT event_id, event_id % 17 - 3.0 AS ox, event_id % 13 - 2.0 AS oy, (event_id % 7 - 3.5) / 4 AS dx, (event_id % 5 - 2.5) / 4 AS dy FROM events))""")
def ray_box_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    at = R.ray_box(((i % 17) - 3.0, (i % 13) - 2.0, F.lit(5.0)), ((i % 7 - 3.5) / 4, (i % 5 - 2.5) / 4, F.lit(-1.0)), tuple(map(F.lit, (0.0, 0.0, 0.0))), tuple(map(F.lit, (10.0, 10.0, 3.0))))
    return table(spark, sf_dir, "events").select("event_id", scaled(at, 1000).alias("box_at"))


@query("SELECT event_id, CASE WHEN x >= 0 AND y >= 0 AND x / 10.0 + y / 8.0 <= 1 THEN 5000 END::BIGINT AS hit FROM (SELECT event_id, event_id % 17 - 3 AS x, event_id % 13 - 2 AS y FROM events)")
def ray_triangle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, z = F.col("event_id"), F.lit(0.0)
    at = R.ray_triangle((i % 17 - 3.0, i % 13 - 2.0, F.lit(5.0)), (z, z, F.lit(-1.0)), (z, z, z), (F.lit(10.0), z, z), (z, F.lit(8.0), z))
    return table(spark, sf_dir, "events").select("event_id", scaled(at, 1000).alias("hit"))


@query(f"""SELECT view, corner::INTEGER AS corner, {s_scaled('[west, east, east, east, west, west][corner + 1]', 100)} AS x, {s_scaled('[south, south, north, north, north, south][corner + 1]', 100)} AS y, [0, 1, 1, 1, 0, 0][corner + 1]::INTEGER AS u, [0, 0, 1, 1, 1, 0][corner + 1]::INTEGER AS v
FROM {V()}, (SELECT unnest(range(0, 6)) AS corner)""")
def tile_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.tile_quad(views(spark, sf_dir), "west", "south", "east", "north", F.lit(0.0))
    return q.select("view", "corner", scaled(F.col("x"), 100).alias("x"), scaled(F.col("y"), 100).alias("y"), "u", "v")
