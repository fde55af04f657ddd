"""Triangle meshes as rows: heights, tops and edges.  A vertex is (mesh, vertex, x, y, z), a triangle (mesh, a, b, c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.camera import Vector, dot


def height_range(vertices: DataFrame) -> DataFrame:
    """Smallest and largest height of each mesh."""
    return vertices.groupBy("mesh").agg(F.min("z").alias("low"), F.max("z").alias("high"))


def bounds(vertices: DataFrame, by: list[str]) -> DataFrame:
    """The box of all vertices of a key; without keys, of all."""
    return vertices.groupBy(*by).agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))])


def _at_vertices(rows: DataFrame, news: DataFrame, value: str) -> DataFrame:
    """``rows`` with the largest ``value`` that ``news`` (mesh, vertex, value) has for their vertex, null if none.

    Both are put in one table and looked through by vertex.  Unlike a join, this leaves tables that are dealt out by mesh where they are.
    """
    told = news.where("mesh is not null and vertex is not null").select("mesh", "vertex", value)
    both = rows.withColumn("_own", F.lit(True)).unionByName(told, allowMissingColumns=True)
    found = both.withColumn(value, F.max(value).over(Window.partitionBy("mesh", "vertex"))).where("_own")
    return found.select(*[c if found.schema[c].dataType == rows.schema[c].dataType else F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], value)


def building_top(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """``vertices`` with ``top``: the largest height of the triangles at each, 0 at least and for those in none.

    A triangle asks for the heights of its corners, is summed to their largest, and gives this back to them.  Repeated triangles change nothing.
    Vertices and triangles that are both dealt out by mesh, to the same number of partitions, are not shuffled again.
    """
    asked = triangles.where("mesh is not null").select("mesh", "a", "b", "c", F.explode(F.array("a", "b", "c")).alias("vertex"))
    highest = _at_vertices(asked, vertices.select("mesh", "vertex", "z"), "z").groupBy("mesh", "a", "b", "c").agg(F.max("z").alias("high"))
    given = highest.select("mesh", F.explode(F.array("a", "b", "c")).alias("vertex"), "high").groupBy("mesh", "vertex").agg(F.max("high").alias("top"))
    return _at_vertices(vertices, given, "top").withColumn("top", F.greatest(F.col("top"), F.lit(0.0)))


def is_roof_edge(h0: Column, h1: Column, base: Column, flat: float = 0.05, above: float = 0.5) -> Column:
    """Whether an edge is level and clearly above the building's base; the others are facade edges."""
    return (F.abs(h1 - h0) <= flat) & (F.least(h0, h1) > base + above)


def ray_box(origin: Vector, ray: Vector, low: Vector, high: Vector) -> Column:
    """The distance along a ray at which it meets a box (0 from inside), null if it misses; rays parallel to a side are allowed."""
    near, far, miss = F.lit(0.0), F.lit(float("inf")), F.lit(False)
    for o, d, lo, hi in zip(origin, ray, low, high, strict=True):
        level = d == 0
        t0, t1 = (lo - o) / d, (hi - o) / d
        near = F.greatest(near, F.when(level, near).otherwise(F.least(t0, t1)))
        far = F.least(far, F.when(level, far).otherwise(F.greatest(t0, t1)))
        miss = miss | (level & ((o < lo) | (o > hi)))
    return F.when(~miss & (near <= far), near)


def ray_triangle(origin: Vector, ray: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """The distance along a ray at which it meets a triangle from either side, null if it misses or is parallel."""
    minus = lambda p, q: tuple(x - y for x, y in zip(p, q, strict=True))
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    e1, e2 = minus(b, a), minus(c, a)
    h = cross(ray, e2)
    det = dot(e1, h)
    s = minus(origin, a)
    q = cross(s, e1)
    safe = F.when(F.abs(det) > 1e-12, det)
    u, v, t = dot(s, h) / safe, dot(ray, q) / safe, dot(e2, q) / safe
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def tile_quad(df: DataFrame, west: str, south: str, east: str, north: str, altitude: Column) -> DataFrame:
    """Six vertices of two triangles for each box, with texture coordinates: (corner 0 to 5, x, y, z, u, v)."""
    order = [(0, 0), (1, 0), (1, 1), (1, 1), (0, 1), (0, 0)]
    one = lambda u, v: F.struct(F.col(east if u else west).alias("x"), F.col(north if v else south).alias("y"), altitude.alias("z"), F.lit(u).alias("u"), F.lit(v).alias("v"))
    out = df.select("*", F.posexplode(F.array(*[one(u, v) for u, v in order])).alias("corner", "_q"))
    return out.select(*df.columns, "corner", "_q.x", "_q.y", "_q.z", "_q.u", "_q.v")
