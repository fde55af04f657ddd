"""Terrain operators against a heap, a plane and meshes made by hand."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import terrain as X
from tessera.operators.triangles import building_top


def heap_selection(view, ranges, keep, divide, cap, most, virtual):
    """The search as one would write it for one view: a heap, a budget, ties by the smaller tile."""
    v, west, south, east, north, tx, ty = view

    def there(z, x, y):
        return ranges is None or any(r[0] == z and r[1] <= x <= r[2] and r[3] <= y <= r[4] for r in ranges)

    def box(z, x, y):
        return x / 2 ** (z + 1) * 360 - 180, y / 2**z * 180 - 90, (x + 1) / 2 ** (z + 1) * 360 - 180, (y + 1) / 2**z * 180 - 90

    def far(z, x, y):
        w, s, e, n = box(z, x, y)
        return math.hypot((w + e) / 2 - tx, (s + n) / 2 - ty)

    cell = lambda lng, lat: (min(max(math.floor((lng + 180) / 360 * 2), 0), 1), 0)
    heap = [(far(0, x, 0), 0, x, 0) for x in range(cell(west, south)[0], cell(east, north)[0] + 1)]
    heapq.heapify(heap)
    shown, out, visited = set(), [], 0
    while heap and visited < max(8 * most, 1024) and len(shown) < most:
        d, z, x, y = heapq.heappop(heap)
        visited += 1
        w, s, e, n = box(z, x, y)
        if e < west - (east - west) or w > east + (east - west) or n < south - (north - south) or s > north + (north - south) or not keep(z, x, y):
            continue
        real = there(z, x, y)
        unreal = virtual and ranges is not None and not real
        if z < cap and (real or unreal) and divide(z, d):
            for i in (0, 1):
                for j in (0, 1):
                    heapq.heappush(heap, (far(z + 1, 2 * x + i, 2 * y + j), z + 1, 2 * x + i, 2 * y + j))
            continue
        if not unreal:
            while z >= 0 and not there(z, x, y):
                z, x, y = z - 1, x >> 1, y >> 1
            if z < 0:
                continue
        if (z, x, y) not in shown:
            shown.add((z, x, y))
            out.append((v, z, x, y, unreal, len(shown), pytest.approx(far(z, x, y))))
    return out


CASES = [(12, True, False, 1), (12, False, False, 1), (50, True, True, 40), (500, None, False, 1)]


@pytest.mark.parametrize("most, virtual, whole, sparse", CASES)
def test_selection_equals_a_heap(spark, most, virtual, whole, sparse):
    rng = random.Random(most)
    ranges = [(0, 0, 1, 0, 0), (1, 0, 3, 0, 1)] + [(z, x, x + rng.randrange(3), y, y + rng.randrange(3)) for z in range(2, 6) for x, y in [(rng.randrange(2 << z), rng.randrange(1 << z)) for _ in range(3 << z)]]
    views = [(1, -180.0, -90.0, 180.0, 90.0, 3.3, 4.4)] if whole else []
    views += [(10 + i, lng, lat, lng + 20.0, lat + 9.0, lng + rng.random() * 20, lat + rng.random() * 9) for i, (lng, lat) in enumerate((rng.uniform(-180, 150), rng.uniform(-90, 80)) for _ in range(6))]
    cap = 6
    keep = lambda z, x, y: z < cap or (x + y) % sparse == 0
    divide = lambda z, d: whole or 90 / 2**z > d / 3
    df = spark.createDataFrame([(*v, "x", 0) for v in views] + [(99, None, 0.0, 1.0, 1.0, 0.0, 0.0, "x", 0)], "view long, west double, south double, east double, north double, tx double, ty double, name string, z int")
    held = None if virtual is None else spark.createDataFrame(ranges, "z int, start_x long, end_x long, start_y long, end_y long")
    far = F.hypot((F.col("tile_west") + F.col("tile_east")) / 2 - F.col("tx"), (F.col("tile_south") + F.col("tile_north")) / 2 - F.col("ty"))
    kept = X.in_reach() & ((F.col("z") < cap) | ((F.col("x") + F.col("y")) % sparse == 0))
    got = X.terrain_selection(df, held, far, kept, F.lit(whole) | (90 / F.pow(F.lit(2.0), "z") > F.col("d") / 3), 0, cap, most, bool(virtual))
    want = [r for v in views for r in heap_selection(v, None if virtual is None else ranges, keep, divide, cap, most, bool(virtual))]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[5])) == sorted(want, key=lambda r: (r[0], r[5]))
    assert len(want) > len(views)


def test_selection_of_no_views(spark):
    none = spark.createDataFrame([], "view long, west double, south double, east double, north double")
    got = X.terrain_selection(none, None, F.col("tile_west"), F.lit(True), F.lit(False), 0, 3, 5)
    assert got.columns == ["view", "z", "x", "y", "virtual", "place", "priority"] and got.count() == 0


def plane(spark, n, span):
    """A mesh of n x n cells over ``span`` metres whose heights are a plane, as vertices and triangles."""
    at = [(7, j * (n + 1) + i, i / n * span, j / n * span, 10 + 20 * i / n + 40 * j / n, i / n, j / n) for j in range(n + 1) for i in range(n + 1)]
    cells = [(7, 2 * (j * n + i) + h, k, k + (1, n + 2)[h], k + (n + 2, n + 1)[h]) for j in range(n) for i in range(n) for h in (0, 1) for k in [j * (n + 1) + i]]
    return spark.createDataFrame(at, "mesh long, id int, x double, y double, z double, u double, v double"), spark.createDataFrame(cells, "mesh long, t int, a int, b int, c int")


def test_points_inside_outside_and_unknown(spark):
    vertices, triangles = plane(spark, 5, 100.0)
    tri = X.corners(vertices, triangles)
    rng = random.Random(1)
    asked = [(7, i, rng.uniform(0, 100), rng.uniform(0, 100), "own") for i in range(300)] + [(7, 900, -50.0, 200.0, None), (8, 901, 1.0, 1.0, None), (7, 902, None, 1.0, None)]
    got = {r["id"]: r for r in X.points_in_triangles(spark.createDataFrame(asked, "mesh long, id int, x double, y double, t0 string"), tri).collect()}
    assert len(got) == 303 and got[901]["t"] is None and got[902]["z"] is None
    for _, i, x, y, _ in asked[:301]:
        x, y = min(max(x, 0), 100), min(max(y, 0), 100)
        assert got[i]["z"] == pytest.approx(10 + 20 * x / 100 + 40 * y / 100, abs=1e-9) and got[i]["wa"] + got[i]["wb"] + got[i]["wc"] == pytest.approx(1)


def test_exploded_meshes_are_not_broadcast(spark):
    vertices, triangles = plane(spark, 2, 100.0)
    asked = spark.createDataFrame([(7, 1, 10.0, 10.0)], "mesh long, id int, x double, y double")
    tops = building_top(vertices.withColumnRenamed("id", "vertex"), triangles)
    for made in (X.points_in_triangles(asked, X.corners(vertices, triangles)), tops, *X.with_skirts(vertices, triangles, asked.selectExpr("mesh", "3 zoom"))):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString() and made.count() > 0


def test_points_beside_a_hole_look_around(spark):
    vertices = spark.createDataFrame([(1, k, x, y, 5.0) for k, (x, y) in enumerate([(0.0, 0.0), (100.0, 0.0), (0.0, 1e-6), (100.0, 100.0)])], "mesh long, id int, x double, y double, z double")
    triangles = spark.createDataFrame([(1, t, 0, 1, 2) for t in range(40)] + [(1, 40, 1, 3, 1)], "mesh long, t int, a int, b int, c int")
    asked = spark.createDataFrame([(1, 0, 50.0, 0.0), (1, 1, 50.0, 50.0)], "mesh long, id int, x double, y double")
    got = {r["id"]: r["t"] for r in X.points_in_triangles(asked, X.corners(vertices, triangles)).collect()}
    assert got == {0: 0, 1: None}


def test_upsampling_a_plane_is_exact(spark):
    span = 6378137.0 * math.radians(0.001)
    vertices, triangles = plane(spark, 5, span)
    tile = spark.createDataFrame([(7, 0.0, 0.0, 0.001, 0.001, "x")], "mesh long, west double, south double, east double, north double, t string")
    grid = X.upsampled(tile, X.corners(vertices, triangles))
    rows = sorted(grid.collect(), key=lambda r: r["id"])
    assert len(rows) == 289 and rows[0]["z"] == pytest.approx(10) and rows[-1]["z"] == pytest.approx(70, abs=0.01)
    assert all(abs(r["z"] - (10 + 20 * r["gx"] / 16 + 40 * r["gy"] / 16)) < 0.01 for r in rows)
    assert X.grid_triangles(tile).count() == 512 and X.upsampled(tile, X.corners(vertices, triangles), 1).count() == 9
    beyond = spark.createDataFrame([(5, 0.0, 0.0, 1.0, 1.0)], "mesh long, west double, south double, east double, north double")
    assert {r["z"] for r in X.upsampled(beyond, X.corners(vertices, triangles), 2).collect()} == {0.0}


def test_skirts_close_the_ring(spark):
    vertices, triangles = plane(spark, 3, 30.0)
    lone = spark.createDataFrame([(9, 0, 0.0, 0.0, 1.0, 0.5, 0.5)], vertices.schema)
    zooms = spark.createDataFrame([(7, 12), (9, 3)], "mesh long, zoom int")
    v, t = X.with_skirts(vertices.union(lone), triangles, zooms)
    ring = [r["id"] for r in sorted(X.border_ring(vertices).collect(), key=lambda r: r["place"])]
    assert ring == [0, 1, 2, 3, 7, 11, 15, 14, 13, 12, 8, 4]
    low = {r["id"]: r for r in v.where("mesh = 7 and id >= 16").collect()}
    top = {r["id"]: r for r in vertices.collect()}
    assert sorted(low) == list(range(16, 28)) and all(low[16 + i]["z"] == pytest.approx(top[k]["z"] - 2.0) and low[16 + i]["x"] == top[k]["x"] for i, k in enumerate(ring))
    walls = sorted((r["t"], r["a"], r["b"], r["c"]) for r in t.where("t >= 18").collect())
    want = []
    for i, k in enumerate(ring):
        n, j = ring[(i + 1) % 12], (i + 1) % 12
        want += [(18 + 2 * i, k, 16 + i, n), (19 + 2 * i, n, 16 + i, 16 + j)]
    assert walls == want and v.where("mesh = 9").count() == 1
    depth = spark.range(1).select(X.skirt_depth(F.lit(1e4), F.lit(12)), X.skirt_depth(F.lit(1.0), F.lit(2))).first()
    assert tuple(depth) == (40.0, 0.5)


def test_selection_by_a_camera(spark):
    """The camera's rules judged tile by tile, and the order of a heap over them."""
    from tessera.functions import projection as P

    eye, target = {"x": 0.0, "y": -900_000.0, "z": 700_000.0}, {"x": 0.0, "y": 0.0, "z": 0.0}
    view = spark.createDataFrame([(5, -12.0, -9.0, 12.0, 9.0, eye, target)], "view long, west double, south double, east double, north double, eye struct<x:double,y:double,z:double>, target struct<x:double,y:double,z:double>")
    figures = lambda df: X.camera_figures(df, 0.0, 0.0, 60.0, 1280.0, 860.0, 1000.0, 1e7)
    cx, cy = P.local_xy((F.col("tile_west") + F.col("tile_east")) / 2, (F.col("tile_south") + F.col("tile_north")) / 2, 0.0, 0.0)
    far = F.sqrt(F.pow(cx - F.col("eye.x"), 2) + F.pow(cy - F.col("eye.y"), 2) + F.pow(F.col("eye.z"), 2))
    keep, divide = X.in_reach() & F.col("seen"), X.divided(F.col("d"), 860.0, 60.0, limit=16.0)
    got = X.terrain_selection(view, None, far, keep, divide, 1, 6, 30, prepare=figures)
    every = spark.range(1, 7).selectExpr("cast(id as int) z").selectExpr("z", "explode(sequence(0L, shiftleft(2L, z) - 1)) x").selectExpr("z", "x", "explode(sequence(0L, shiftleft(1L, z) - 1)) y")
    near = every.where("abs((x + 0.5) / shiftleft(2L, z) * 360 - 180) < 200 / shiftleft(1, z) + 40 and abs((y + 0.5) / shiftleft(1L, z) * 180 - 90) < 200 / shiftleft(1, z) + 40")
    told = figures(X.with_bounds(near.join(view.drop("z")), "south").withColumn("d", far))
    known = {(r["z"], r["x"], r["y"]): (r["d"], r["k"], r["v"]) for r in told.select("z", "x", "y", "d", keep.alias("k"), divide.alias("v")).collect()}
    heap = [(*known[1, x, y][:1], 1, x, y) for x in (1, 2) for y in (0, 1)]
    heapq.heapify(heap)
    want, visited = [], 0
    while heap and visited < 1024 and len(want) < 30:
        _, z, x, y = heapq.heappop(heap)
        visited += 1
        d, kept, split = known[z, x, y]
        if kept and split and z < 6:
            for k in ((z + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)):
                heapq.heappush(heap, (known[k][0], *k))
        elif kept:
            want.append((z, x, y))
    assert [(r["z"], r["x"], r["y"]) for r in got.orderBy("place").collect()] == want and len({z for z, *_ in want}) > 1
