"""Pyramids, hierarchy joins, selection and queues over derived tiles and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parsing as G
from tessera.functions import tiling as T
from tessera.operators import hierarchy as H
from tessera.operators import pyramid as Y
from tessera.operators import queueing as Q
from tessera.operators import selection as S
from tessera.queries.base import P, TL, TT, A, V, availability, points, query, s_gx, s_gy, s_scaled, s_tx, s_ty, scaled, table, tiles, typed_tiles, views

# ---- pyramid


@query(f"SELECT z::INTEGER AS z, x, y, (x >> 2)::BIGINT AS px, (y >> 2)::BIGINT AS py FROM {TL(9)}")
def tile_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir, 9).select("z", "x", "y", T.parent(F.col("x"), 2).alias("px"), T.parent(F.col("y"), 2).alias("py"))


@query(f"SELECT (z + 1)::INTEGER AS z, 2 * x + i AS x, 2 * y + j AS y FROM {TL(6)}, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)")
def tile_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.children(tiles(spark, sf_dir, 6))


@query(f"SELECT z::INTEGER AS z, x, y, az::INTEGER AS az, (x >> (z - az)::INTEGER)::BIGINT AS ax, (y >> (z - az)::INTEGER)::BIGINT AS ay FROM {TL(8)}, (SELECT unnest(range(2, 8)) AS az)")
def tile_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.ancestors(tiles(spark, sf_dir, 8), 2)


@query(f"SELECT l::INTEGER AS z, ({s_tx('lng', 8)} >> (8 - l)::INTEGER)::BIGINT AS x, ({s_ty('lat', 8)} >> (8 - l)::INTEGER)::BIGINT AS y, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM {P}, (SELECT unnest(range(0, 9)) AS l) GROUP BY ALL")
def pyramid_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(8)
    # Sum at the finest level first: what is exploded to all levels is tiles, not points.
    fine = points(spark, sf_dir).groupBy(z.alias("z"), T.tile_x(F.col("lng"), z).alias("x"), T.tile_y(F.col("lat"), z).alias("y")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return Y.rollup(fine, {"n": F.col("n"), "cents": F.col("cents")})


@query(f"""SELECT view, 6 AS z, x, y FROM (SELECT view, {s_tx('west', 6)} AS a, {s_tx('east', 6)} AS b, {s_ty('north', 6)} AS c, {s_ty('south', 6)} AS d FROM {V()}),
LATERAL (SELECT unnest(range(least(a, b), greatest(a, b) + 1)) AS x), LATERAL (SELECT unnest(range(least(c, d), greatest(c, d) + 1)) AS y)""")
def bbox_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.cover(views(spark, sf_dir), "west", "south", "east", "north", F.lit(6)).select("view", "z", "x", "y")


@query(f"SELECT view, count(*)::BIGINT AS n FROM {V(1.0)} WHERE east >= 0 AND west <= 60 AND north >= -20 AND south <= 40 GROUP BY view")
def bbox_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.lit(float(v)) for v in (0, -20, 60, 40)]
    return views(spark, sf_dir, 1.0).where(H.in_view(*map(F.col, ("west", "south", "east", "north")), *box)).groupBy("view").agg(F.count("*").alias("n"))


@query(f"""SELECT view, {s_scaled('greatest(west, 0.0)', 100)} AS west, {s_scaled('greatest(south, -20.0)', 100)} AS south, {s_scaled('least(east, 60.0)', 100)} AS east, {s_scaled('least(north, 40.0)', 100)} AS north
FROM {V()} WHERE greatest(west, 0.0) < least(east, 60.0) AND greatest(south, -20.0) < least(north, 40.0)""")
def bbox_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = tuple(map(F.col, ("west", "south", "east", "north")))
    cut = views(spark, sf_dir).select("view", H.box_overlap(mine, tuple(F.lit(float(v)) for v in (0, -20, 60, 40))).alias("b")).where("b.west < b.east and b.south < b.north")
    return cut.select("view", *[scaled(F.col(f"b.{c}"), 100).alias(c) for c in ("west", "south", "east", "north")])


@query(f"SELECT view, west >= -0.25 - 1e-9 AND east <= 90.25 + 1e-9 AND south >= -30 - 1e-9 AND north <= 30 + 1e-9 AS inside FROM {V()}")
def coverage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = tuple(F.lit(float(v)) for v in (-0.25, -30, 90.25, 30))
    return views(spark, sf_dir).select("view", H.box_covers(coverage, tuple(map(F.col, ("west", "south", "east", "north")))).alias("inside"))


# ---- joins over availability and hierarchy

_AT = f"(SELECT event_id, (event_id % 7 + 2)::INTEGER AS z, {s_tx('lng', '(event_id % 7 + 2)::INTEGER')} AS x, {s_ty('lat', '(event_id % 7 + 2)::INTEGER')} AS y FROM {P})"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.col("event_id") % 7 + 2).cast("int")
    return points(spark, sf_dir).select("event_id", z.alias("z"), T.tile_x(F.col("lng"), z).alias("x"), T.tile_y(F.col("lat"), z).alias("y"))


@query(f"SELECT event_id, t.z, x, y FROM {_AT} t WHERE EXISTS (SELECT 1 FROM {A} r WHERE r.z = t.z AND t.x BETWEEN start_x AND end_x AND t.y BETWEEN start_y AND end_y)")
def availability_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.available(_wanted(spark, sf_dir), availability(spark, sf_dir)).select("event_id", "z", "x", "y")


@query(f"""SELECT t.event_id, t.z, t.x, t.y, max(r.z)::INTEGER AS rz, (t.x >> (t.z - max(r.z))::INTEGER)::BIGINT AS rx, (t.y >> (t.z - max(r.z))::INTEGER)::BIGINT AS ry
FROM {_AT} t LEFT JOIN {A} r ON r.z <= t.z AND (t.x >> (t.z - r.z)::INTEGER) BETWEEN start_x AND end_x AND (t.y >> (t.z - r.z)::INTEGER) BETWEEN start_y AND end_y GROUP BY t.event_id, t.z, t.x, t.y""")
def nearest_available_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.nearest_available(_wanted(spark, sf_dir), availability(spark, sf_dir)).select("event_id", "z", "x", "y", "rz", "rx", "ry")


@query(f"""WITH l AS (SELECT * FROM {TL(8)} UNION SELECT * FROM {TL(5)}), o AS (SELECT * FROM {TT(6, 'error')})
SELECT DISTINCT l.z::INTEGER AS z, l.x, l.y FROM l, o WHERE (o.z > l.z AND (o.x >> (o.z - l.z)::INTEGER) = l.x AND (o.y >> (o.z - l.z)::INTEGER) = l.y)
OR (l.z > o.z AND (l.x >> (l.z - o.z)::INTEGER) = o.x AND (l.y >> (l.z - o.z)::INTEGER) = o.y)""")
def ancestor_descendant_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = tiles(spark, sf_dir, 8).union(tiles(spark, sf_dir, 5)).distinct()
    return H.related(loaded, typed_tiles(spark, sf_dir, 6, "error"))


@query(f"SELECT z::INTEGER AS z, x, y FROM {TL(7)} WHERE (x, y) IN (SELECT (x, y) FROM {TT(7, 'view', 'click')})")
def visible_loaded_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir, 7).join(typed_tiles(spark, sf_dir, 7, "view", "click"), ["z", "x", "y"], "left_semi")


@query(f"SELECT z::INTEGER AS z, x, y FROM {TL(7)} WHERE (x, y) NOT IN (SELECT (x, y) FROM {TT(7, 'view', 'click')})")
def missing_tiles_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir, 7).join(typed_tiles(spark, sf_dir, 7, "view", "click"), ["z", "x", "y"], "left_anti")


@query(f"""SELECT 5 AS z, p.x, p.y, coalesce(max(CASE WHEN c.x % 2 = 0 AND c.y % 2 = 0 THEN 1 END), 0)::INTEGER AS nw, coalesce(max(CASE WHEN c.x % 2 = 1 AND c.y % 2 = 0 THEN 1 END), 0)::INTEGER AS ne,
coalesce(max(CASE WHEN c.x % 2 = 0 AND c.y % 2 = 1 THEN 1 END), 0)::INTEGER AS sw, coalesce(max(CASE WHEN c.x % 2 = 1 AND c.y % 2 = 1 THEN 1 END), 0)::INTEGER AS se
FROM {TL(5)} p LEFT JOIN {TL(6, 3, 0)} c ON c.x >> 1 = p.x AND c.y >> 1 = p.y GROUP BY p.x, p.y""")
def child_occlusion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.child_flags(tiles(spark, sf_dir, 5), tiles(spark, sf_dir, 6, 3, 0))


@query(f"SELECT DISTINCT a::INTEGER AS z, (x >> (z - a)::INTEGER)::BIGINT AS x, (y >> (z - a)::INTEGER)::BIGINT AS y FROM {TL(9)}, (SELECT unnest(range(0, 9)) AS a)")
def covered_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.covered_ancestors(tiles(spark, sf_dir, 9))


@query(f"SELECT 4 AS z, (x >> 1)::BIGINT AS x, (y >> 1)::BIGINT AS y FROM {TL(5)} GROUP BY ALL HAVING count(*) = 4")
def fully_covered_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.fully_covered(tiles(spark, sf_dir, 5), 1)


@query(f"""WITH l5 AS (SELECT * FROM {TL(5)}), b5 AS (SELECT x, y, (x + y) % 9 <> 0 AS ok FROM l5),
l4 AS (SELECT (x >> 1)::BIGINT AS x, (y >> 1)::BIGINT AS y FROM b5 WHERE ok GROUP BY ALL HAVING count(*) = 4),
l3 AS (SELECT (x >> 1)::BIGINT AS x, (y >> 1)::BIGINT AS y FROM l4 GROUP BY ALL HAVING count(*) = 4)
SELECT 5 AS z, x, y FROM b5 WHERE ok UNION ALL SELECT 4, x, y FROM l4 UNION ALL SELECT 3, x, y FROM l3
UNION ALL SELECT 2, (x >> 1)::BIGINT, (y >> 1)::BIGINT FROM l3 GROUP BY ALL HAVING count(*) = 4""")
def quadrant_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir, 5).withColumn("renderable", (F.col("x") + F.col("y")) % 9 != 0)
    return Y.quadrant_coverage(t, 3)


_GB = ("x / 64.0 * 360 - 180", "y / 32.0 * 180 - 90", "(x + 1) / 64.0 * 360 - 180", "(y + 1) / 32.0 * 180 - 90")


@query(f"""WITH g AS (SELECT DISTINCT {s_gx('lng', 5)} AS x, {s_gy('lat', 5, 'south')} AS y FROM {P}),
b AS (SELECT x, y, {_GB[0]} + 1e-9 AS w, greatest({_GB[1]} + 1e-9, -85.0) AS s, {_GB[2]} - 1e-9 AS e, least({_GB[3]} - 1e-9, 85.0) AS n FROM g),
r AS (SELECT x, y, {s_tx('w', 6)} AS x0, {s_tx('e', 6)} AS x1, {s_ty('n', 6)} AS y0, {s_ty('s', 6)} AS y1 FROM b WHERE s < n)
SELECT x, y, tx, ty FROM r, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS tx), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS ty)""")
def imagery_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(5)
    g = points(spark, sf_dir).select(T.geo_x(F.col("lng"), z).alias("gx"), T.geo_y(F.col("lat"), z, "south").alias("gy")).distinct()
    w, s, e, n = T.geo_bounds(F.col("gx"), F.col("gy"), z, "south")
    g = g.select("gx", "gy", (w + 1e-9).alias("w"), F.greatest(s + 1e-9, F.lit(-85.0)).alias("s"), (e - 1e-9).alias("e"), F.least(n - 1e-9, F.lit(85.0)).alias("n")).where("s < n")
    return Y.cover(g, "w", "s", "e", "n", F.lit(6)).select(F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("x").alias("tx"), F.col("y").alias("ty"))


_HELD = f"(SELECT z, x, y, z * 1000 + x AS v FROM (SELECT * FROM {TL(5, 6, 0)} UNION SELECT * FROM {TL(7, 6, 1)} UNION SELECT * FROM {TL(3, 40, 2)}))"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir, 5, 6, 0).union(tiles(spark, sf_dir, 7, 6, 1)).union(tiles(spark, sf_dir, 3, 40, 2)).distinct()
    return t.withColumn("v", F.col("z") * 1000 + F.col("x"))


def _nearest_sql(levels: int, proper: bool) -> str:
    least = "h.z < t.z" if proper else "h.z <= t.z"
    return f"""SELECT t.z::INTEGER AS z, t.x, t.y, arg_max(h.v, h.z)::BIGINT AS v, max(h.z)::INTEGER AS from_z FROM {TL(8)} t
LEFT JOIN {_HELD} h ON {least} AND h.z >= t.z - {levels} AND (t.x >> (t.z - h.z)::INTEGER) = h.x AND (t.y >> (t.z - h.z)::INTEGER) = h.y GROUP BY t.z, t.x, t.y"""


@query(_nearest_sql(4, True))
def fallback_slot_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.nearest_ancestor(tiles(spark, sf_dir, 8), _held(spark, sf_dir), "v", levels=4, proper=True)


@query(f"SELECT z, x, y, coalesce(v, 0)::BIGINT AS height FROM ({_nearest_sql(24, False)})")
def surface_height_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.nearest_ancestor(tiles(spark, sf_dir, 8), _held(spark, sf_dir), "v")
    return found.select("z", "x", "y", F.coalesce("v", F.lit(0)).cast("long").alias("height"))


@query(f"""SELECT p.event_id, max(t.z)::INTEGER AS finest FROM {P} p LEFT JOIN {_HELD} t
ON (t.z = 3 AND t.x = {s_tx('p.lng', 3)} AND t.y = {s_ty('p.lat', 3)}) OR (t.z = 5 AND t.x = {s_tx('p.lng', 5)} AND t.y = {s_ty('p.lat', 5)}) OR (t.z = 7 AND t.x = {s_tx('p.lng', 7)} AND t.y = {s_ty('p.lat', 7)})
GROUP BY p.event_id""")
def finest_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select(F.col("event_id").alias("id"), "lng", "lat")
    return H.finest_cover(p, _held(spark, sf_dir), 3, 7).select(F.col("id").alias("event_id"), "finest")


# ---- selection

def _range_sql(z: str) -> str:
    return f"{s_gx('west', z)} AS x0, {s_gx('east', z)} AS x1, {s_gy('south', z, 'south')} AS y0, {s_gy('north', z, 'south')} AS y1"


_FLAT = f"""WITH v AS (SELECT * FROM {V()}), l AS (SELECT view, z::INTEGER AS z, {_range_sql('z::INTEGER')} FROM v, (SELECT unnest(range(0, 9)) AS z)),
c AS (SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) AS n FROM l),
pick AS (SELECT view, CASE WHEN max(n) FILTER (WHERE z = 8) <= 20 THEN 8 ELSE coalesce(max(z) FILTER (WHERE z <= 5 AND n <= 20), 0) END AS z FROM c GROUP BY view),
t AS (SELECT c.view, c.z, x, y FROM c JOIN pick p ON p.view = c.view AND p.z = c.z, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)),
b AS (SELECT t.view, t.z, t.x, t.y, max(r.z) AS rz FROM t JOIN {A} r ON r.z <= t.z AND (t.x >> (t.z - r.z)::INTEGER) BETWEEN start_x AND end_x AND (t.y >> (t.z - r.z)::INTEGER) BETWEEN start_y AND end_y GROUP BY ALL)
SELECT DISTINCT view, rz::INTEGER AS z, (x >> (z - rz)::INTEGER)::BIGINT AS x, (y >> (z - rz)::INTEGER)::BIGINT AS y FROM b"""


@query(_FLAT)
def flat_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flat_selection(views(spark, sf_dir), F.lit(8), availability(spark, sf_dir), most_tiles=20, max_lod=3)


@query(f"""SELECT view, max(z)::INTEGER AS z FROM (SELECT view, z::INTEGER AS z, {_range_sql('z::INTEGER')} FROM {V(8.0)}, (SELECT unnest(range(0, 8)) AS z)) WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= 48 GROUP BY view""")
def base_layer_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fitting_level(views(spark, sf_dir, 8.0), F.lit(7), 0, 48).select("view", "z")


@query(f"""WITH k AS (SELECT DISTINCT 7 AS z, 2 * x + i AS x, 2 * y + j AS y FROM {TL(6)}, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT k.z::INTEGER AS z, k.x, k.y FROM k WHERE EXISTS (SELECT 1 FROM {A} r WHERE r.z = k.z AND k.x BETWEEN start_x AND end_x AND k.y BETWEEN start_y AND end_y)
AND (k.x, k.y) NOT IN (SELECT (x, y) FROM {TL(7, 3, 0)}) ORDER BY z, x, y LIMIT 16""")
def prefetch_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prefetch(tiles(spark, sf_dir, 6), tiles(spark, sf_dir, 7, 3, 0), availability(spark, sf_dir), 16)


@query(f"SELECT DISTINCT 6 AS z, (x >> 1)::BIGINT AS x, (y >> 1)::BIGINT AS y FROM {TL(7)}")
def fallback_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.ancestors(tiles(spark, sf_dir, 7), 6).select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()


@query(f"SELECT z::INTEGER AS z, x, y FROM (SELECT z, x, y FROM {TT(6, 'view')} UNION SELECT z, x, y FROM {TT(6, 'click', 'signup')}) EXCEPT SELECT z, x, y FROM {TT(6, 'error')}")
def union_except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = typed_tiles(spark, sf_dir, 6, "view").union(typed_tiles(spark, sf_dir, 6, "click", "signup")).distinct()
    return seen.join(typed_tiles(spark, sf_dir, 6, "error"), ["z", "x", "y"], "left_anti")


# ---- requests, queues, caches

_RQ = "(SELECT o_orderkey AS id, (o_orderkey * 48271 % 100003)::BIGINT AS priority, 'host' || (o_custkey % 37) AS grp FROM orders)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 48271 % 100003).alias("priority"), F.concat(F.lit("host"), (F.col("o_custkey") % 37).cast("string")).alias("grp"))


@query(f"SELECT id, priority, grp FROM {_RQ} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY priority, id) <= 6 ORDER BY priority, id LIMIT 100")
def scheduler_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.admit(_requests(spark, sf_dir), "grp", 6, 100).select("id", "priority", "grp")


@query(f"SELECT id AS key, priority FROM {_RQ} ORDER BY priority, key LIMIT 64")
def bounded_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bounded_queue(_requests(spark, sf_dir).withColumnRenamed("id", "key"), 64).select("key", "priority")


_CA = "(SELECT event_id AS key, 'u' || (user_id % 50) AS cache, epoch_us(ts)::BIGINT AS last_access, (event_id * 613 % 90000 + 1000)::BIGINT AS bytes FROM events)"


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("key"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("cache"), F.unix_micros(F.col("ts").cast("timestamp")).alias("last_access"), (F.col("event_id") * 613 % 90000 + 1000).alias("bytes"))


@query(f"SELECT key, cache FROM {_CA} QUALIFY row_number() OVER (PARTITION BY cache ORDER BY last_access DESC, key DESC) > 20")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.lru_evicted(_cached(spark, sf_dir), "cache", 20).select("key", "cache")


@query(f"""WITH w AS (SELECT *, sum(bytes) OVER (PARTITION BY cache) AS total, coalesce(sum(bytes) OVER (PARTITION BY cache ORDER BY last_access, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM {_CA})
SELECT key, cache, bytes FROM w WHERE total > 2000000 AND total - freed > floor(2000000 * 0.8)""")
def lru_trim_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _cached(spark, sf_dir).withColumn("budget", F.lit(2_000_000).cast("long"))
    return Q.lru_trim(held, "cache", "budget").select("key", "cache", "bytes")


_FL = "(SELECT user_id AS key, [500, 503, 404, 200, 429][(event_id % 5 + 1)::INTEGER]::INTEGER AS status FROM events WHERE event_type <> 'click')"


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'click'")
    return e.select(F.col("user_id").alias("key"), F.element_at(F.array(*map(F.lit, (500, 503, 404, 200, 429))), (F.col("event_id") % 5 + 1).cast("int")).alias("status"))


@query(f"""SELECT key, count(*)::BIGINT AS attempts, bool_or(status IN (404, 410)) AS permanent,
CASE WHEN NOT bool_or(status IN (404, 410)) THEN least(10 * (1::BIGINT << least(count(*) - 1, 30)::INTEGER), 160)::BIGINT END AS wait_s FROM {_FL} WHERE status <> 200 GROUP BY key""")
def failure_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.failure_states(_failures(spark, sf_dir).where("status <> 200"))


@query(f"SELECT DISTINCT user_id AS key FROM events WHERE user_id NOT IN (SELECT key FROM {_FL} WHERE status IN (404, 410))")
def failure_cooldown_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _failures(spark, sf_dir).where(G.permanent_failure(F.col("status"))).select("key")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct().join(bad, "key", "left_anti")


@query(f"SELECT z::INTEGER AS z, x, y, 'https://' || ['a', 'b', 'c', 'd'][((x + y + z) % 4 + 1)::INTEGER] || '.tiles.example/' || z || '/' || x || '/' || y || '.png?again={{z}}' AS url FROM {TL(9)}")
def url_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lit("https://{s}.tiles.example/{z}/{x}/{y}.png?again={z}")
    return tiles(spark, sf_dir, 9).select("z", "x", "y", G.xyz_url(t, F.col("x"), F.col("y"), F.col("z"), ["a", "b", "c", "d"]).alias("url"))


@query(f"SELECT z::INTEGER AS z, x, y, 'https://t.example/base/' || z || '/' || x || '/' || (512 - 1 - y) || '.png' AS url FROM {TL(9)}")
def url_tms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir, 9).select("z", "x", "y", G.tms_url(F.lit("https://t.example/base/"), F.col("x"), F.col("y"), F.col("z")).alias("url"))


@query(f"SELECT z::INTEGER AS z, x, y, 'https://w.example/wmts?SERVICE=WMTS&REQUEST=GetTile&VERSION=1.0.0&LAYER=img&STYLE=default&TILEMATRIXSET=EPSG%3A3857&FORMAT=image%2Fpng&TILEMATRIX=EPSG%3A3857%3A' || z || '&TILEROW=' || y || '&TILECOL=' || x AS url FROM {TL(9)}")
def url_wmts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("EPSG:3857:"), F.col("z").cast("string"))
    return tiles(spark, sf_dir, 9).select("z", "x", "y", G.wmts_url(F.lit("https://w.example/wmts"), "img", "EPSG:3857", F.col("x"), F.col("y"), label).alias("url"))
