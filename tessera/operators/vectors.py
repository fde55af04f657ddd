"""Vector geometry: rings, segments, footprints, walls and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean_ring(ring: Column) -> Column:
    """A ring (array of structs x, y) without consecutive repeats and without its closing point; null if fewer than 3 points are left."""
    same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    # A lambda's variable is evaluated once; an expression used n times in others is evaluated n times, in a lambda for each point.
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    valid = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    apart = let(valid, lambda v: F.filter(v, lambda p, i: (i == 0) | ~same(p, F.get(v, i - 1))))
    closed = lambda r: (F.size(r) > 1) & same(F.get(r, F.lit(0)), F.get(r, F.size(r) - 1))
    open_ring = let(apart, lambda r: F.when(closed(r), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))
    return let(open_ring, lambda r: F.when(F.size(r) >= 3, r))


def clean_polygon(rings: Column) -> Column:
    """The cleaned rings of a polygon, outer first; null if the outer one is no ring (a hole never takes its place)."""
    outer = clean_ring(F.get(rings, F.lit(0)))
    holes = F.filter(F.transform(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), clean_ring), lambda r: r.isNotNull())
    return F.when(outer.isNotNull(), F.concat(F.array(outer), holes))


def all_corners(outer: Column, holes: Column) -> Column:
    """The corners of a polygon, those of its outer ring and then of its holes; null rings add none."""
    alone = F.array(outer)
    return F.flatten(F.array_compact(F.concat(alone, F.coalesce(holes, F.slice(alone, 1, 0)))))


def ring_area(ring: Column) -> Column:
    """Signed area; positive for counter-clockwise rings."""
    n = F.size(ring)
    cross = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2


def segments(points: DataFrame, line: str, order: list[str]) -> DataFrame:
    """(line, x0, y0, x1, y1) of consecutive points of each line; segments shorter than 1e-4 are left out."""
    w = Window.partitionBy(line).orderBy(*order)
    pairs = points.select(line, F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return pairs.where(F.col("x0").isNotNull() & (dx * dx + dy * dy > 1e-8))


def ring_segments(df: DataFrame, ring: str) -> DataFrame:
    """One row per edge of each ring, the closing one too: columns x0, y0, x1, y1 in place of the ring."""
    r = F.col(ring)
    edges = F.transform(r, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get(r, (i + 1) % F.size(r))["x"].alias("x1"), F.get(r, (i + 1) % F.size(r))["y"].alias("y1")))
    rest = [c for c in df.columns if c != ring]
    return df.select(*rest, F.explode(edges).alias("_e")).select(*rest, "_e.*")


def walls(edges: DataFrame, base: Column, top: Column) -> DataFrame:
    """Four vertices of a wall quad per edge of a counter-clockwise ring, with its outward normal; tiny edges are left out."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.sqrt(dx * dx + dy * dy)
    corners = F.array(*[F.struct(F.lit(k).alias("corner"), F.col(x).alias("x"), F.col(y).alias("y"), z.alias("h")) for k, (x, y, z) in enumerate((("x0", "y0", base), ("x1", "y1", base), ("x1", "y1", top), ("x0", "y0", top)))])
    rest = [c for c in edges.columns if c not in ("x0", "y0", "x1", "y1")]
    kept = edges.where(length > 1e-6)
    return kept.select(*rest, (dy / length).alias("nx"), (-dx / length).alias("ny"), F.explode(corners).alias("_v")).select(*rest, "nx", "ny", "_v.*")


def grid_cell(x: Column, y: Column, west: Column, south: Column, east: Column, north: Column, n: int) -> tuple[Column, Column]:
    """Column and row of a place in an n x n grid over a box; places on or beyond an edge belong to the cell at it."""
    one = lambda v, lo, hi: F.greatest(F.least(F.floor((v - lo) / F.greatest(hi - lo, F.lit(1e-12)) * n), F.lit(n - 1).cast("long")), F.lit(0).cast("long"))
    return one(x, west, east), one(y, south, north)


def with_grid(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """``df`` with its ``col`` and ``row`` in a grid over the bounds of all rows (one aggregated row, broadcast as literals)."""
    b = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    lit = [F.lit(float(v)) if v is not None else F.lit(None).cast("double") for v in b]
    col, row = grid_cell(F.col(x), F.col(y), lit[0], lit[2], lit[1], lit[3], n)
    return df.withColumns({"col": col, "row": row})
