"""Terrain: selection for the views of customers, and meshes of suppliers and customers with their samples, grids and skirts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import tiling as T
from tessera.operators import terrain as X
from tessera.queries.base import A, V, availability, query, s_gx, s_scaled, scaled, table, views

# ---- selection: each view looks at its middle from a place south of it; heights are in degrees of the equator

_METRES = math.pi / 180 * 6378137.0
_TOP, _MOST, _LIMIT, _HEIGHT, _FOV = 8, 20, 40.0, 860.0, 60.0
_SPREAD = 2 * math.tan(math.radians(_FOV) / 2)
_D = f"(least(sqrt((cx - tx) * (cx - tx) + (cy - ty) * (cy - ty)), sqrt((cx - tx) * (cx - tx) + (cy - ey) * (cy - ey) + eh * eh)) * {_METRES!r})"
_BOX = "SELECT *, (w + e) / 2 AS cx, (s + n) / 2 AS cy FROM (SELECT *, x::DOUBLE / (1::BIGINT << (z + 1)) * 360 - 180 AS w, y::DOUBLE / (1::BIGINT << z) * 180 - 90 AS s, (x + 1)::DOUBLE / (1::BIGINT << (z + 1)) * 360 - 180 AS e, (y + 1)::DOUBLE / (1::BIGINT << z) * 180 - 90 AS n FROM"


def _s_selection(virtual: bool) -> str:
    """All nodes of all views by recursion, put in order, and cut where a budget is spent."""
    can = "true" if virtual else "there"
    shown = "{'z': z, 'x': x, 'y': y}" if virtual else "CASE WHEN rz IS NOT NULL THEN {'z': rz, 'x': x >> (z - rz), 'y': y >> (z - rz)} END"
    return f"""WITH RECURSIVE v AS (SELECT *, (west + east) / 2 AS tx, (south + north) / 2 AS ty, (south + north) / 2 - 1.5 - view % 3 AS ey, 0.5 + view % 4 AS eh FROM {V()}),
avail AS (
  SELECT DISTINCT z, x, y FROM (SELECT z, y, unnest(range(start_x, end_x + 1)) AS x FROM (SELECT *, unnest(range(start_y, end_y + 1)) AS y FROM {A}))
  UNION SELECT z::INTEGER, x, y FROM (SELECT unnest([0, 1]) AS z), (SELECT unnest(range(0, 4)) AS x), (SELECT unnest(range(0, 2)) AS y) WHERE x < (2 << z) AND y < (1 << z)
), tree(view, z, x, y, stair, kept, there, open) AS (
  SELECT view, -1, 0::BIGINT, 0::BIGINT, []::STRUCT(d DOUBLE, z INTEGER, x BIGINT, y BIGINT)[], true, false, true FROM v
  UNION ALL
  SELECT view, z, x, y, list_append(list_filter(up, lambda q: q > me), me), kept, there, kept AND {can} AND z < {_TOP} AND 78271.516964 / pow(2, z) * {_HEIGHT} / (greatest(d, 1.0) * {_SPREAD!r}) > {_LIMIT}
  FROM (SELECT *, {{'d': d, 'z': z, 'x': x, 'y': y}} AS me, NOT (e < west - (east - west) OR w > east + (east - west) OR n < south - (north - south) OR s > north + (north - south)) AS kept
    FROM (SELECT b.*, {_D} AS d, a.z IS NOT NULL AS there FROM ({_BOX} (
      SELECT v.*, (t.z + 1)::INTEGER AS z, 2 * t.x + i AS x, 2 * t.y + j AS y, t.stair AS up FROM tree t JOIN v USING (view), (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)
      WHERE t.open AND (t.z >= 0 OR (j = 0 AND i BETWEEN least({s_gx('west', 0)}, {s_gx('east', 0)}) AND greatest({s_gx('west', 0)}, {s_gx('east', 0)}))))) ) b
      LEFT JOIN avail a ON a.z = b.z AND a.x = b.x AND a.y = b.y))
), nodes AS (SELECT * FROM tree WHERE z >= 0),
up AS (SELECT z, x, y, max(k) AS rz FROM (SELECT DISTINCT z, x, y, unnest(range(0, z + 1))::INTEGER AS k FROM nodes) n WHERE EXISTS (SELECT 1 FROM avail a WHERE a.z = n.k AND a.x = n.x >> (n.z - n.k) AND a.y = n.y >> (n.z - n.k)) GROUP BY ALL),
leaves AS (SELECT n.*, CASE WHEN kept AND NOT open THEN {shown} END AS shown FROM nodes n LEFT JOIN up USING (z, x, y)),
firsts AS (SELECT *, shown IS NOT NULL AND row_number() OVER (PARTITION BY view, shown ORDER BY stair) = 1 AS first, row_number() OVER (PARTITION BY view ORDER BY stair) AS taken FROM leaves),
counted AS (SELECT *, coalesce(sum(first::INTEGER) OVER (PARTITION BY view ORDER BY stair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM firsts)
SELECT view, z, x, y, virtual, place, {s_scaled(_D, 10)} AS priority_dm FROM ({_BOX} (
  SELECT v.*, c.shown.z AS z, c.shown.x AS x, c.shown.y AS y, {'NOT there' if virtual else 'false'} AS virtual, (before + 1)::BIGINT AS place FROM counted c JOIN v USING (view) WHERE first AND taken <= {max(8 * _MOST, 1024)} AND before < {_MOST})))"""


def _selected(spark: SparkSession, sf_dir: str, virtual: bool) -> DataFrame:
    seen = views(spark, sf_dir).withColumns({"tx": (F.col("west") + F.col("east")) / 2, "ty": (F.col("south") + F.col("north")) / 2})
    seen = seen.withColumns({"ey": F.col("ty") - 1.5 - F.col("view") % 3, "eh": F.lit(0.5) + F.col("view") % 4})
    ranges = availability(spark, sf_dir)
    top = spark.range(2).select(F.col("id").cast("int").alias("z"), F.lit(0).cast("long").alias("start_x"), (T.span(F.col("id") + 1) - 1).alias("end_x"), F.lit(0).cast("long").alias("start_y"), F.col("id").alias("end_y"))
    middle_x, middle_y = (F.col("tile_west") + F.col("tile_east")) / 2, (F.col("tile_south") + F.col("tile_north")) / 2
    dx, to_target, to_eye = middle_x - F.col("tx"), middle_y - F.col("ty"), middle_y - F.col("ey")
    distance = F.least(F.sqrt(dx * dx + to_target * to_target), F.sqrt(dx * dx + to_eye * to_eye + F.col("eh") * F.col("eh"))) * _METRES
    divide = X.too_coarse(F.col("d"), _HEIGHT, _FOV, _LIMIT)
    out = X.terrain_selection(seen, ranges.unionByName(top), distance, X.in_reach(), divide, 0, _TOP, _MOST, virtual)
    return out.select("view", "z", "x", "y", "virtual", "place", scaled(F.col("priority"), 10).alias("priority_dm"))


@query(_s_selection(True))
def terrain_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Virtual tiles below what is available."""
    return _selected(spark, sf_dir, True)


@query(_s_selection(False))
def terrain_selection_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available tiles only."""
    return _selected(spark, sf_dir, False)


# ---- meshes: a customer's is a square of 1 to 3 cells a side in metres, with heights by its key; orders are points on it

_Z = "((k * 31 + i * 17 + j * 29) % 97)::DOUBLE / 4"
_MESH = """(SELECT k, m, i, j, i * 100.0 / m AS x, j * 100.0 / m AS y, {z} AS z FROM (SELECT {key} AS k, ({key} % 3 + {least})::INTEGER AS m FROM {t}), LATERAL (SELECT unnest(range(0, m + 1)) AS i), LATERAL (SELECT unnest(range(0, m + 1)) AS j))"""


def _mesh(keys: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh, id, x, y, z, u, v) and triangles (mesh, t, a, b, c) for rows (mesh)."""
    m = F.col("m")
    sized = keys.withColumn("m", (F.col("mesh") % 3 + least).cast("int"))
    at = sized.withColumn("i", F.explode(F.sequence(F.lit(0), m))).withColumn("j", F.explode(F.sequence(F.lit(0), m)))
    z = ((F.col("mesh") * 31 + F.col("i") * 17 + F.col("j") * 29) % 97).cast("double") / 4
    vertices = at.select("mesh", (F.col("j") * (m + 1) + F.col("i")).alias("id"), (F.col("i") * 100.0 / m).alias("x"), (F.col("j") * 100.0 / m).alias("y"), z.alias("z"), (F.col("i") / m).alias("u"), (F.col("j") / m).alias("v"))
    cells = at.where((F.col("i") < m) & (F.col("j") < m)).withColumn("p", F.col("j") * (m + 1) + F.col("i"))
    half = lambda h, b, c: F.struct(F.lit(h).alias("h"), F.col("p").alias("a"), (F.col("p") + b).alias("b"), (F.col("p") + c).alias("c"))
    both = cells.withColumn("_t", F.explode(F.array(half(0, F.lit(1), m + 2), half(1, m + 2, m + 1))))
    return vertices, both.select("mesh", ((F.col("j") * m + F.col("i")) * 2 + F.col("_t.h")).alias("t"), "_t.a", "_t.b", "_t.c")


_CORNERS = """tri AS (SELECT p.k, ((p.j * p.m + p.i) * 2 + h)::INTEGER AS t, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS b_y, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz
  FROM mesh p, (SELECT unnest([0, 1]) AS h), mesh q, mesh r WHERE q.k = p.k AND r.k = p.k AND q.i = p.i + 1 AND q.j = p.j + h AND r.i = p.i + 1 - h AND r.j = p.j + 1)"""
_WEIGHTS = "((px - ax) * (cy - ay) - (py - ay) * (cx - ax)) / ((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) AS wb, ((bx - ax) * (py - ay) - (b_y - ay) * (px - ax)) / ((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) AS wc"


@query(f"""WITH mesh AS {_MESH.format(z=_Z, key='c_custkey', t='customer', least=1)}, {_CORNERS},
hit AS (SELECT o_orderkey, t, az, bz, cz, {_WEIGHTS} FROM (SELECT o_orderkey, o_custkey, (o_orderkey * 37 % 1201) / 12.0 AS px, (o_orderkey * 91 % 1201) / 12.0 AS py FROM orders) JOIN tri ON k = o_custkey)
SELECT o_orderkey, min(t) AS t, {s_scaled('arg_min((1 - wb - wc) * az + wb * bz + wc * cz, t)', 1000)} AS z_mm FROM hit WHERE least(wb, wc, 1 - wb - wc) >= -1e-7 GROUP BY o_orderkey""")
def point_in_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle of its customer's mesh on which each order lies, and the height there; orders beyond the mesh's edge (1200 / 12) are moved to it."""
    vertices, triangles = _mesh(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mesh")), 1)
    key = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mesh"), key.alias("id"), (key * 37 % 1201 / 12.0).alias("x"), (key * 91 % 1201 / 12.0).alias("y"))
    found = X.points_in_triangles(asked, X.corners(vertices, triangles)).where("t is not null")
    return found.select(F.col("id").alias("o_orderkey"), "t", scaled(F.col("z"), 1000).alias("z_mm"))


# A supplier's mesh lies in the Mercator plane, and its tile is a part of it and a strip beyond.
_TILE = "(SELECT s_suppkey AS k, s_suppkey % 5 * 0.00005 AS west, 0.0001 AS south, 0.00045 + s_suppkey % 4 * 0.0002 AS east, 0.0007 AS north FROM supplier)"
_N = 8
_my = lambda lat: f"(6378137.0 * ln(tan({math.pi / 4!r} + radians({lat}) / 2)))"


@query(f"""WITH mesh AS {_MESH.format(z=_Z, key='s_suppkey', t='supplier', least=2)}, {_CORNERS},
grid AS (SELECT k, gx, gy, 6378137.0 * radians(west + gx / {_N} * (east - west)) AS mx, {_my(f'(south + gy / {_N} * (north - south))')} AS my FROM {_TILE}, (SELECT unnest(range(0, {_N + 1})) AS gx), (SELECT unnest(range(0, {_N + 1})) AS gy)),
hit AS (SELECT k, gx, gy, mx, my, t, az, bz, cz, {_WEIGHTS} FROM (SELECT *, least(greatest(mx, 0.0), 100.0) AS px, least(greatest(my, 0.0), 100.0) AS py FROM grid) JOIN tri USING (k)),
best AS (SELECT k, gx, gy, arg_min((1 - wb - wc) * az + wb * bz + wc * cz, t) AS z FROM hit WHERE least(wb, wc, 1 - wb - wc) >= -1e-7 GROUP BY ALL)
SELECT k AS s_suppkey, (gy * {_N + 1} + gx)::INTEGER AS id, {s_scaled('mx', 1000)} AS x_mm, {s_scaled('my', 1000)} AS y_mm,
  {s_scaled('coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY k ORDER BY gy, gx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)', 100)} AS z_cm FROM grid LEFT JOIN best USING (k, gx, gy)""")
def upsample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 9 by 9 vertices over each supplier's tile with the heights of its mesh."""
    k = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    vertices, triangles = _mesh(suppliers.select(k.alias("mesh")), 2)
    tiles = suppliers.select(k.alias("mesh"), (k % 5 * 0.00005).alias("west"), F.lit(0.0001).alias("south"), (0.00045 + k % 4 * 0.0002).alias("east"), F.lit(0.0007).alias("north"))
    grid = X.upsampled(tiles, X.corners(vertices, triangles), _N)
    return grid.select(F.col("mesh").alias("s_suppkey"), "id", scaled(F.col("x"), 1000).alias("x_mm"), scaled(F.col("y"), 1000).alias("y_mm"), scaled(F.col("z"), 100).alias("z_cm"))


_EDGE = f"""WITH mesh AS {_MESH.format(z=_Z, key='s_suppkey', t='supplier', least=2)},
sizes AS (SELECT k, count(*) AS n, least(greatest((max(z) - min(z)) * 0.02, 2.0), 40.0) * least(greatest((k % 15 - 2) / 10, 0.25), 1.0) AS depth FROM mesh GROUP BY k),
edge AS (SELECT k, m, n, depth, j * (m + 1) + i AS id, x, y, z, CASE WHEN j = 0 THEN [0, i] WHEN i = m THEN [1, j] WHEN j = m THEN [2, -i] WHEN i = 0 THEN [3, -j] END AS place FROM mesh JOIN sizes USING (k) WHERE i IN (0, m) OR j IN (0, m)),
ring AS (SELECT *, row_number() OVER w - 1 AS r, coalesce(lead(id) OVER w, first_value(id) OVER w) AS next, count(*) OVER (PARTITION BY k) AS c FROM edge WINDOW w AS (PARTITION BY k ORDER BY place))"""


@query(f"""{_EDGE} SELECT k AS s_suppkey, (j * (m + 1) + i)::INTEGER AS id, {s_scaled('x', 1000)} AS x_mm, {s_scaled('y', 1000)} AS y_mm, {s_scaled('z', 1000)} AS z_mm FROM mesh
UNION ALL SELECT k, (n + r)::INTEGER, {s_scaled('x', 1000)}, {s_scaled('y', 1000)}, {s_scaled('z - depth', 1000)} FROM ring""")
def terrain_skirt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vertices of the suppliers' meshes with their skirts."""
    vertices, _ = _skirted(spark, sf_dir)
    return vertices.select(F.col("mesh").alias("s_suppkey"), "id", *[scaled(F.col(v), 1000).alias(f"{v}_mm") for v in "xyz"])


@query(f"""{_EDGE} SELECT k AS s_suppkey, (p * 2 + h)::INTEGER AS t, a::INTEGER AS a, (CASE h WHEN 0 THEN a + 1 ELSE a + m + 2 END)::INTEGER AS b, (CASE h WHEN 0 THEN a + m + 2 ELSE a + m + 1 END)::INTEGER AS c
  FROM (SELECT k, m, j * m + i AS p, j * (m + 1) + i AS a FROM mesh WHERE i < m AND j < m), (SELECT unnest([0, 1]) AS h)
UNION ALL SELECT k, (2 * m * m + r * 2 + h)::INTEGER, (CASE h WHEN 0 THEN id ELSE next END)::INTEGER, (n + r)::INTEGER, (CASE h WHEN 0 THEN next ELSE n + (r + 1) % c END)::INTEGER FROM ring, (SELECT unnest([0, 1]) AS h)""")
def terrain_skirt_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triangles of the suppliers' meshes with their skirts."""
    _, triangles = _skirted(spark, sf_dir)
    return triangles.select(F.col("mesh").alias("s_suppkey"), "t", "a", "b", "c")


def _skirted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mesh"))
    return X.with_skirts(*_mesh(keys, 2), keys.withColumn("zoom", F.col("mesh") % 15))
