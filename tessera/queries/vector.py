"""Footprints, rings, metrics, trees and ordered analytics over derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import parsing as G
from tessera.operators import metrics as M
from tessera.operators import overview as O
from tessera.operators import tree as R
from tessera.operators import vectors as W
from tessera.queries.base import P, degrees_of, points, query, s_degrees, s_scaled, scaled, table

# ---- footprints: a box around a derived place for each order

_lng, _lat = s_degrees("o_orderkey")
_HT = "(o_orderpriority || ' ' || (o_orderkey % 40 - 5) || '.5 m')"
B = f"(SELECT o_orderkey AS id, {_lng} AS lng, {_lat} AS lat, {_HT} AS height, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders)"


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    lng, lat = degrees_of(F.col("o_orderkey"))
    height = F.concat(F.col("o_orderpriority"), F.lit(" "), (F.col("o_orderkey") % 40 - 5).cast("string"), F.lit(".5 m"))
    return o.select(F.col("o_orderkey").alias("id"), lng.alias("lng"), lat.alias("lat"), height.alias("height"), F.round("o_totalprice").cast("long").alias("price"))


_NUM = "coalesce(TRY_CAST(nullif(regexp_extract(height, '[-+]?(\\d+\\.?\\d*|\\.\\d+)', 0), '') AS DOUBLE), 12.0)"


@query(f"SELECT id, {s_scaled(_NUM, 100)} AS number, {s_scaled(f'least(greatest({_NUM} * 3.0, 1.0), 1000.0)', 100)} AS metres FROM {B}")
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings(spark, sf_dir).select("id", scaled(G.parse_number(F.col("height"), 12.0), 100).alias("number"), scaled(G.building_height(F.col("height"), 3.0), 100).alias("metres"))


_CELL = lambda v: f"CAST(greatest(least(floor(({v} - lo_{v}) / greatest(hi_{v} - lo_{v}, 1e-12) * 8), 7), 0) AS BIGINT)"
_GRID = f"(SELECT id, price, height, {_CELL('lng')} AS col, {_CELL('lat')} AS row FROM {B}, (SELECT min(lng) AS lo_lng, max(lng) AS hi_lng, min(lat) AS lo_lat, max(lat) AS hi_lat FROM {B}))"


@query(f"SELECT id, col, row FROM {_GRID}")
def grid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_grid(buildings(spark, sf_dir), "lng", "lat", 8).select("id", "col", "row")


@query(f"SELECT {s_scaled('min(lng)', 1000)} AS west, {s_scaled('min(lat)', 1000)} AS south, {s_scaled('max(lng)', 1000)} AS east, {s_scaled('max(lat)', 1000)} AS north, {s_scaled('(min(lng) + max(lng)) / 2', 1000)} AS lng, {s_scaled('(min(lat) + max(lat)) / 2', 1000)} AS lat, count(*)::BIGINT AS n FROM {B}")
def dataset_bbox_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = buildings(spark, sf_dir).agg(F.min("lng").alias("w"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.max("lat").alias("n"), F.count("*").alias("c"))
    return b.select(scaled(F.col("w"), 1000).alias("west"), scaled(F.col("s"), 1000).alias("south"), scaled(F.col("e"), 1000).alias("east"), scaled(F.col("n"), 1000).alias("north"), scaled((F.col("w") + F.col("e")) / 2, 1000).alias("lng"), scaled((F.col("s") + F.col("n")) / 2, 1000).alias("lat"), F.col("c").alias("n"))


@query(f"SELECT col, row, count(*)::BIGINT AS n, sum(price)::BIGINT AS price, min({s_scaled(_NUM, 100)}) AS low, max({s_scaled(_NUM, 100)}) AS high FROM {_GRID} GROUP BY col, row")
def cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = scaled(G.parse_number(F.col("height"), 12.0), 100)
    return W.with_grid(buildings(spark, sf_dir), "lng", "lat", 8).groupBy("col", "row").agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.min(h).alias("low"), F.max(h).alias("high"))


@query(f"""SELECT user_id, {s_scaled('x0', 1000)} AS x0, {s_scaled('y0', 1000)} AS y0, {s_scaled('lng', 1000)} AS x1, {s_scaled('lat', 1000)} AS y1 FROM
(SELECT user_id, lng, lat, lag(lng) OVER w AS x0, lag(lat) OVER w AS y0 FROM {P} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE x0 IS NOT NULL AND (lng - x0) * (lng - x0) + (lat - y0) * (lat - y0) > 1e-8""")
def segment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("user_id", "ts", "event_id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    return W.segments(p, "user_id", ["ts", "event_id"]).select("user_id", *[scaled(F.col(c), 1000).alias(c) for c in ("x0", "y0", "x1", "y1")])


# A ring for each order: corners 0 0 1 2 3 (one twice), closed for every other order, two points for every seventh.
_RING = "CASE WHEN id % 7 = 0 THEN [0, 0, 1] WHEN id % 2 = 0 THEN [0, 0, 1, 2, 3, 0] ELSE [0, 1, 1, 2, 3] END"


def _ring(df: DataFrame) -> DataFrame:
    corner = F.when(F.col("id") % 7 == 0, F.array(*map(F.lit, (0, 0, 1)))).when(F.col("id") % 2 == 0, F.array(*map(F.lit, (0, 0, 1, 2, 3, 0)))).otherwise(F.array(*map(F.lit, (0, 1, 1, 2, 3))))
    side = (F.col("id") % 5 + 1).cast("double")
    at = F.transform(corner, lambda c: F.struct(F.when(c.isin(1, 2), side).otherwise(0.0).alias("x"), F.when(c.isin(2, 3), side).otherwise(0.0).alias("y")))
    return df.withColumn("ring", at)


@query(f"SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE 4 END::INTEGER AS corners, CASE WHEN id % 7 = 0 THEN NULL ELSE (id % 5 + 1) * (id % 5 + 1) END::BIGINT AS area FROM (SELECT id, {_RING} AS r FROM {B})")
def ring_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ring(buildings(spark, sf_dir)).select("id", W.clean_ring(F.col("ring")).alias("r"))
    return r.select("id", F.when(F.col("r").isNotNull(), F.size("r")).alias("corners"), F.when(F.col("r").isNotNull(), W.ring_area(F.col("r"))).cast("long").alias("area"))


@query(f"""SELECT id, corner::INTEGER AS corner, CASE WHEN corner IN (0, 3) THEN [0, 1, 1, 0][edge + 1] ELSE [1, 1, 0, 0][edge + 1] END * (id % 5 + 1)::BIGINT AS x,
CASE WHEN corner IN (0, 3) THEN [0, 0, 1, 1][edge + 1] ELSE [0, 1, 1, 0][edge + 1] END * (id % 5 + 1)::BIGINT AS y, CASE WHEN corner < 2 THEN 2 ELSE 30 END::BIGINT AS h_dm,
[0, 1, 0, -1][edge + 1]::BIGINT AS nx, [-1, 0, 1, 0][edge + 1]::BIGINT AS ny FROM {B}, (SELECT unnest(range(0, 4)) AS edge), (SELECT unnest(range(0, 4)) AS corner) WHERE id % 7 <> 0""")
def wall_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ring(buildings(spark, sf_dir)).select("id", W.clean_ring(F.col("ring")).alias("ring")).where("ring is not null")
    v = W.walls(W.ring_segments(r, "ring"), F.lit(0.2), F.lit(3.0))
    return v.select("id", "corner", *[F.col(c).cast("long").alias(c) for c in ("x", "y")], F.round(F.col("h") * 10).cast("long").alias("h_dm"), F.col("nx").cast("long").alias("nx"), F.col("ny").cast("long").alias("ny"))


_FC = "[NULL, 'motorway', 'primary', 'footway', 'trunk_link', 'residential'][(event_id % 6 + 1)::INTEGER]"


@query(f"""SELECT event_id, coalesce({_FC} IN ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary', 'primary_link'), false) AS major,
{s_scaled('least(greatest(CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE CAST(event_id % 9 - 4 AS DOUBLE) END, -2.0), 3.0) * 0.45', 100)} AS rail FROM events""")
def road_class_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    classes = F.array(F.lit(None).cast("string"), *map(F.lit, ("motorway", "primary", "footway", "trunk_link", "residential")))
    layer = F.when(F.col("event_id") % 11 == 0, "none").otherwise((F.col("event_id") % 9 - 4).cast("string"))
    return e.select("event_id", G.is_major_road(F.element_at(classes, (F.col("event_id") % 6 + 1).cast("int"))).alias("major"), scaled(G.rail_offset(layer), 100).alias("rail"))


# ---- ordered decoding

_CODE = "(event_id * 7919 % 301)::BIGINT"


@query(f"SELECT event_id, CAST(sum(CASE WHEN {_CODE} % 2 = 0 THEN {_CODE} // 2 ELSE -({_CODE} + 1) // 2 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) & 65535 AS value FROM events")
def zigzag_delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("event_id") * 7919 % 301).cast("long")
    delta = F.shiftright(code, 1).bitwiseXOR(-code.bitwiseAND(F.lit(1).cast("long")))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.sum(delta).over(w).bitwiseAND(F.lit(65535).cast("long")).alias("value"))


@query("""SELECT event_id, (coalesce(sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - event_id % 4)::BIGINT AS value FROM events""")
def high_water_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("event_id") % 4
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", (F.coalesce(F.sum(F.when(code == 0, 1).otherwise(0)).over(w), F.lit(0)) - code).cast("long").alias("value"))


# ---- metrics

_ST = "(SELECT event_id, user_id % 40 AS view, CASE WHEN user_id % 5 = 0 THEN 'loaded' ELSE ['loaded', 'loaded', 'pending', 'failed', 'loaded', 'loading'][(event_id * 31 % 6 + 1)::INTEGER] END AS state, (event_id % 9)::INTEGER AS z, (event_id * 7907 % 100000)::BIGINT AS far, event_id % 3 = 0 AS backup FROM events)"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, ("loaded", "loaded", "pending", "failed", "loaded", "loading")))
    return e.select("event_id", (F.col("user_id") % 40).alias("view"), F.when(F.col("user_id") % 5 == 0, "loaded").otherwise(F.element_at(names, (F.col("event_id") * 31 % 6 + 1).cast("int"))).alias("state"), (F.col("event_id") % 9).cast("int").alias("z"), (F.col("event_id") * 7907 % 100000).alias("far"), (F.col("event_id") % 3 == 0).alias("backup"))


@query(f"SELECT z, count(*) FILTER (WHERE NOT backup)::BIGINT AS visible, count(*) FILTER (WHERE backup)::BIGINT AS backups, count(*) FILTER (WHERE state = 'loaded')::BIGINT AS drawn, min(far)::BIGINT AS nearest FROM {_ST} GROUP BY z")
def zoom_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.zoom_legend(_states(spark, sf_dir), F.col("z"), F.col("backup"), F.col("state") == "loaded", F.col("far"))


@query(f"""SELECT view, count(*) FILTER (WHERE state = 'loaded')::BIGINT AS loaded, count(*) FILTER (WHERE state IN ('pending', 'loading'))::BIGINT AS pending, count(*) FILTER (WHERE state = 'failed')::BIGINT AS failed,
count(*) FILTER (WHERE state <> 'loaded') = 0 AS complete, coalesce(array_to_string(list_sort(list(event_id) FILTER (WHERE state = 'failed')), ','), '') AS failed_keys FROM {_ST} GROUP BY view""")
def load_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.load_state(_states(spark, sf_dir), "view", "event_id").withColumn("failed_keys", F.array_join("failed_keys", ","))


_SM = "(SELECT event_id AS seq, 's' || (user_id % 12) AS scenario, (event_id * 17 % 101)::BIGINT AS blur, (event_id * 29 % 53)::BIGINT AS gaps FROM events)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("scenario"), (F.col("event_id") * 17 % 101).alias("blur"), (F.col("event_id") * 29 % 53).alias("gaps"))


@query(f"""WITH a AS (SELECT scenario, max(blur) AS peak_blur, arg_max(blur, seq) AS final_blur, max(gaps) AS peak_gaps, arg_max(gaps, seq) AS final_gaps FROM {_SM} GROUP BY scenario)
SELECT *, CASE WHEN final_blur > 50 THEN 'fail' ELSE 'pass' END AS verdict FROM a""")
def scenario_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.scenario_summary(_samples(spark, sf_dir), "scenario", "seq", ["blur", "gaps"])
    values = a.select("scenario", F.lit("final_blur").alias("metric"), F.col("final_blur").alias("value"))
    spec = a.select("scenario", F.lit("final_blur").alias("metric"), F.lit(50).cast("long").alias("max"), F.lit(None).cast("long").alias("min"))
    return a.join(M.check_thresholds(values, spec).select("scenario", "verdict"), "scenario")


@query("""WITH r AS (SELECT 's' || (user_id % 12) AS scenario, 'https://t.example/' || (event_id * 7 % 900) || CASE WHEN event_id % 2 = 0 THEN '?v=' || event_id ELSE '' END AS url FROM events)
SELECT scenario, count(*)::BIGINT AS total, count(DISTINCT split_part(url, '?', 1))::BIGINT AS uniq, CAST(floor((1 - count(DISTINCT split_part(url, '?', 1)) / count(*)) * 10000 + 0.5) AS BIGINT) AS ratio_e4 FROM r GROUP BY scenario""")
def dup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    url = F.concat(F.lit("https://t.example/"), (F.col("event_id") * 7 % 900).cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("?v="), F.col("event_id").cast("string"))).otherwise(""))
    got = M.duplicate_ratio(e.select(F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("scenario"), url.alias("url")), "scenario", "url")
    return got.select("scenario", "total", F.col("distinct").alias("uniq"), scaled(F.col("ratio"), 10000).alias("ratio_e4"))


_PALETTE = [("red", 255, 0, 0), ("green", 0, 255, 0), ("blue", 0, 0, 255), ("grey", 128, 128, 128), ("black", 0, 0, 0), ("white", 255, 255, 255)]
_rgb = ("event_id * 31 % 256", "event_id * 57 % 256", "event_id * 91 % 256")
_FAR = lambda r, g, b: f"({_rgb[0]} - {r}) * ({_rgb[0]} - {r}) + ({_rgb[1]} - {g}) * ({_rgb[1]} - {g}) + ({_rgb[2]} - {b}) * ({_rgb[2]} - {b})"
_BEST = "(SELECT event_id, arg_min(name, d * 10 + k) AS name FROM (" + " UNION ALL ".join(f"SELECT event_id, '{n}' AS name, {_FAR(r, g, b)} AS d, {k} AS k FROM events" for k, (n, r, g, b) in enumerate(_PALETTE)) + ") GROUP BY event_id)"


def _coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", M.nearest_colour(i * 31 % 256, i * 57 % 256, i * 91 % 256, _PALETTE).alias("name"))


@query(f"SELECT event_id, name FROM {_BEST}")
def nearest_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coloured(spark, sf_dir)


@query(f"SELECT x, y, name, count FROM (SELECT event_id % 20 AS x, event_id // 20 % 20 AS y, name, count(*)::BIGINT AS count FROM {_BEST} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY count DESC, name) = 1")
def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coloured(spark, sf_dir).select((F.col("event_id") % 20).alias("x"), (F.floor(F.col("event_id") / 20) % 20).alias("y"), "name")
    return M.dominant(c, ["x", "y"], "name").select("x", "y", "name", "count")


@query(f"SELECT a.event_id, a.view FROM {_ST} a WHERE EXISTS (SELECT 1 FROM {_ST} b WHERE b.view = a.view AND (b.far > a.far OR (b.far = a.far AND b.event_id > a.event_id)) AND b.z > a.z + 1)")
def lod_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lod_violations(_states(spark, sf_dir), "view", "far", "z", "event_id").select("event_id", "view")


# ---- time

@query("""SELECT event_id, count(*) OVER w AS frames, CAST(sum(event_id % 50) OVER w AS BIGINT) AS total FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def rolling_frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("frames"), F.sum(F.col("event_id") % 50).over(w).alias("total"))


_GAP = 3 * 86_400_000_000
_SES = f"""(SELECT *, sum(CASE WHEN t - before <= {_GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM
(SELECT user_id, event_id, epoch_us(ts) AS t, event_id % 9 AS z, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS before FROM events))"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % 9).alias("z"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    new = F.when(F.col("t") - F.lag("t").over(w) <= _GAP, 0).otherwise(1)
    return e.withColumn("_n", new).withColumn("session", F.sum("_n").over(w)).drop("_n")


@query(f"SELECT user_id, session::BIGINT AS session, min(t)::BIGINT AS start_us, max(t)::BIGINT AS end_us, count(*)::BIGINT AS n, max(z) - min(z) >= 2 AS burst FROM {_SES} GROUP BY user_id, session")
def burst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).groupBy("user_id", "session").agg(F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.count("*").alias("n"), (F.max("z") - F.min("z") >= 2).alias("burst"))


@query(f"SELECT user_id, arg_max(event_id, (t, event_id)) AS event_id, max(t)::BIGINT + {_GAP} AS fires_us FROM {_SES} GROUP BY user_id, session")
def debounce_moveend(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("t", "event_id"))
    s = _sessions(spark, sf_dir).groupBy("user_id", "session").agg(last.alias("l"))
    return s.select("user_id", F.col("l.event_id").alias("event_id"), (F.col("l.t") + _GAP).alias("fires_us"))


@query(f"""WITH q AS (SELECT *, blur < 60 AS quiet, sum(CASE WHEN blur < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY scenario ORDER BY seq) AS run FROM {_SM}),
n AS (SELECT *, sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER (PARTITION BY scenario, run ORDER BY seq) AS nth FROM q)
SELECT scenario, min(seq) FILTER (WHERE quiet AND nth >= 3)::BIGINT AS settled FROM n GROUP BY scenario""")
def settle_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.settle_index(_samples(spark, sf_dir), "scenario", "seq", F.col("blur") < 60, 3)


# ---- trees and entities: regions over nations over customers

_TREE = """(SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent, r_regionkey <> 2 AS "show" FROM region
UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_nationkey % 4 <> 1 FROM nation
UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, c_custkey % 5 <> 0 FROM customer)"""


def layer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), (F.col("r_regionkey") != 2).alias("show"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), (F.col("n_nationkey") % 4 != 1).alias("show"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("parent"), (F.col("c_custkey") % 5 != 0).alias("show"))
    return r.union(n).union(c)


@query(f"""WITH RECURSIVE t AS (SELECT * FROM {_TREE}), v(id, visible) AS (SELECT id, "show" FROM t WHERE parent IS NULL UNION ALL SELECT t.id, v.visible AND t."show" FROM t JOIN v ON t.parent = v.id)
SELECT id, visible FROM v""")
def tree_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.effective_visibility(layer_tree(spark, sf_dir))


@query(f"SELECT id, parent, (row_number() OVER (PARTITION BY parent ORDER BY ordinal, id) - 1)::BIGINT AS ordinal FROM (SELECT id, parent, id * 37 % 11 AS ordinal FROM {_TREE})")
def sibling_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.renumber(layer_tree(spark, sf_dir).withColumn("ordinal", F.col("id") * 37 % 11)).select("id", "parent", "ordinal")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Polyline' WHEN 1 THEN 'Polygon' ELSE 'Box' END AS kind, event_id % 5 + 1 AS n_points,
(event_id % 5 + 1) >= CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS finished, CASE WHEN event_id % 3 = 2 THEN 10 END::BIGINT AS size FROM events""")
def entity_to_primitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.entities import to_primitive

    kinds = F.element_at(F.array(*map(F.lit, ("line", "polygon", "point"))), (F.col("event_id") % 3 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", kinds.alias("type"), F.transform(F.sequence(F.lit(1).cast("long"), F.col("event_id") % 5 + 1), lambda i: F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).alias("points"))
    return to_primitive(e).select("event_id", "kind", F.size("points").cast("long").alias("n_points"), "finished", F.col("size").cast("long").alias("size"))
