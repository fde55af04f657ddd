from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import lod, parsing, projection, tiling
from tessera.operators import entities, hierarchy, metrics, pyramid, quadtree, queueing, tree, vectors
from tessera.plans.components import connected_components
from tessera.plans.joins import left_join_hot
from tessera.plans.staging import Staging


def value(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
    return tuple(r) if len(cols) > 1 else r[0]


def test_closed_forms(spark):
    assert value(spark, lod.horizon_distance(F.lit(0.0)), lod.horizon_distance(F.lit(-5.0))) == (0, 0)
    assert value(spark, lod.horizon_distance(F.lit(100.0))) == pytest.approx(6378137 * math.acos(6378137 / 6378237) * 1.05)
    assert value(spark, lod.horizon_distance(F.lit(1e6), most=500.0)) == 500
    assert value(spark, tiling.geo_x(F.lit(118.1371), F.lit(13)), tiling.geo_y(F.lit(24.49), F.lit(13), "south"), tiling.geo_y(F.lit(24.49), F.lit(13), "north")) == (13568, 5210, 2981)
    near, far = value(spark, lod.sse_perspective(F.lit(5.0), F.lit(100.0), F.lit(900.0), F.lit(75.0), F.lit(1.0)), lod.sse_tiles3d_compat(F.lit(5.0), F.lit(100.0), F.lit(900.0), F.lit(75.0), F.lit(1.0)))
    assert far / near == pytest.approx((2 * math.tan(math.radians(37.5))) ** 2)
    for polar in (45, 59, 60, 70, 80, 88):
        corners = value(spark, lod.ground_corners(F.lit(500.0), F.lit(90.0 - polar), F.lit(60.0), F.lit(1.5)))
        most = value(spark, lod.horizon_distance(F.lit(500.0)))
        assert len(corners) == 4 and all(math.hypot(*c) <= most + 1e-6 for c in corners)
    with pytest.raises(Exception, match="finite"):
        value(spark, projection.assert_finite(F.lit(float("nan")), "lng"))


def test_frames(spark):
    m = value(spark, projection.enu_to_ecef(F.lit(118.1), F.lit(24.5)))
    axes = [m[0:3], m[4:7], m[8:11]]
    for i in range(3):
        for j in range(3):
            assert sum(a * b for a, b in zip(axes[i], axes[j], strict=True)) == pytest.approx(float(i == j))
    back = value(spark, *projection.geodetic(*projection.ecef(F.lit(118.1), F.lit(-24.5), F.lit(1234.0))))
    assert back == pytest.approx((118.1, -24.5, 1234.0), abs=1e-6)
    assert value(spark, *projection.offset_of(*projection.heading_pitch_range(F.lit(3.0), F.lit(4.0), F.lit(12.0)))) == pytest.approx((3, 4, 12))
    assert value(spark, *projection.from_local_xy(*projection.local_xy(F.lit(10.0), F.lit(20.0), 11.0, 21.0), 11.0, 21.0)) == pytest.approx((10, 20))


def test_urls(spark):
    x, y, z = F.lit(5).cast("long"), F.lit(2).cast("long"), F.lit(3)
    assert value(spark, parsing.xyz_url(F.lit("h{s}/{z}/{x}/{y}/{x}"), x, y, z, ["0", "1", "2", "3"])) == "h2/3/5/2/{x}"
    assert value(spark, parsing.terrain_url(F.lit("{z}/{x}/{y}/{x}?v={version}"), x, y, z, "1.1")) == "3/5/2/5?v=1.1"
    assert value(spark, parsing.tms_url(F.lit("b"), x, y, z, flip=False)) == "b/3/5/2.png"
    url = value(spark, parsing.wms_url(F.lit("w?a=1"), "l", F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.5), extra={"FORMAT": "image/jpeg"}))
    assert url.startswith("w?a=1&SERVICE=WMS") and "BBOX=0.000%2C1.000%2C2.000%2C3.500" in url and "FORMAT=image%2Fjpeg" in url
    with pytest.raises(ValueError):
        parsing.wms_url(F.lit("w"), "l", x, x, x, x, version="1.1.1")
    assert value(spark, parsing.resolve_url(F.lit("a/b.glb"), F.lit("http://h/x/t.json")), parsing.resolve_url(F.lit("http://o/b"), F.lit("http://h/t"))) == ("http://h/x/a/b.glb", "http://o/b")
    assert value(spark, parsing.source_id(F.lit(0), F.lit(""), F.lit(7))) == "7"
    assert value(spark, parsing.request_server(F.lit("https://h.example/x"), F.lit(None).cast("string"))) == "h.example"
    assert value(spark, parsing.coordinate(F.lit("1.5")), parsing.coordinate(F.lit("")), parsing.coordinate(F.lit("true"))) == (1.5, None, None)


def test_occlusion_fixture(spark):
    t = lambda rows: spark.createDataFrame(rows, "z int, x long, y long")
    parent = t([(1, 0, 0)])
    assert pyramid.child_flags(parent, t([(2, 0, 1), (2, 1, 1)]), south_origin=True).first()[3:] == (1, 1, 0, 0)
    assert pyramid.child_flags(parent, t([(2, 0, 0), (2, 1, 1)]), south_origin=True).first()[3:] == (0, 1, 1, 0)
    assert pyramid.child_flags(parent, t([])).first()[3:] == (0, 0, 0, 0)


def test_availability_fixture(spark):
    ranges = spark.createDataFrame([(12, 6784, 6784, 2605, 2605)], "z int, start_x long, end_x long, start_y long, end_y long")
    want = spark.createDataFrame([(13, 13568, 5210), (13, 0, 0)], "z int, x long, y long")
    got = {r["x"]: (r["rz"], r["rx"], r["ry"]) for r in hierarchy.nearest_available(want, ranges).collect()}
    assert got == {13568: (12, 6784, 2605), 0: (None, None, None)}


def test_plans_have_no_nested_loops(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = spark.range(100).selectExpr("4 z", "id % 16 x", "id % 16 y")
        r = t.selectExpr("z", "x start_x", "x end_x", "y start_y", "y end_y")
        for df in (hierarchy.available(t, r), hierarchy.nearest_available(t, r), hierarchy.related(t, t), hierarchy.nearest_ancestor(t, t.withColumn("v", F.lit(1)), "v")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scheduler_fixtures(spark):
    rq = lambda rows: spark.createDataFrame(rows, "id long, priority long, grp string")
    assert queueing.admit(rq([(i, 5, "a") for i in range(12)]), "grp", 6, 100).count() == 6
    assert queueing.admit(rq([(i, 5, "ab"[i % 2]) for i in range(24)]), "grp", 6, 100).count() == 12
    assert [r["priority"] for r in queueing.admit(rq([(1, 10, "a"), (2, 1, "a"), (3, 5, "a")]), "grp", 6, 9).collect()] == [1, 5, 10]


def test_hot_join(spark):
    left = spark.range(1000).selectExpr("case when id < 700 then 1 else id % 50 end k", "id v")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for hot in (2, 100, 10_000):
        got = left_join_hot(left, right, ["k"], "n", hot, F.xxhash64("v"))
        assert got.count() == 1000 and got.where("top is null").count() == 0 and got.agg(F.sum("n")).first()[0] == sum(r["n"] ** 2 for r in right.collect())
    assert left_join_hot(left, right.limit(0), ["k"], "n", 5, F.xxhash64("v")).where("top is null").count() == 1000


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), *((100 + i, 101 + i) for i in range(40)), *((500, 501 + i) for i in range(30))]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, connected_components(df, Staging(spark, "t")).collect()))
    assert got[3] == 1 and got[9] == 8 and got[5] == 5 and got[140] == 100 and got[530] == 500
    assert connected_components(df.limit(0), Staging(spark, "t")).count() == 0


def test_components_beyond_a_broadcast_join_apart(spark, monkeypatch):
    joins, keep = [], Staging.keep

    def seen(self, df, name):
        joins.append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin"))
        return keep(self, df, name)

    monkeypatch.setattr(Staging, "keep", seen)
    monkeypatch.setattr("tessera.plans.components.BROADCAST_ROWS", 5)
    df = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(90, 91)], "a long, b long")
    got = dict(map(tuple, connected_components(df, Staging(spark, "t")).collect()))
    assert got == {**dict.fromkeys(range(21), 0), 90: 90, 91: 90}
    assert max(joins) == 1  # the hot keys, of which there is a fixed number


def test_ring_is_cleaned_by_two_filters(spark):
    rings = spark.createDataFrame([([(0.0, 0.0), (0.0, 0.0), None, (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)],), ([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)],), (None,)], "r array<struct<x:double,y:double>>")
    made = rings.select(vectors.clean_ring(F.col("r")).alias("c"))
    assert [r.c and [tuple(p) for p in r.c] for r in made.collect()] == [[(0, 0), (1, 0), (1, 1)], None, None]
    assert made._jdf.queryExecution().analyzed().toString().split("Relation")[0].split("LogicalRDD")[0].count("filter(") == 2


def test_available_is_every_range_whatever_their_overlap(spark):
    rng = random.Random(4)
    boxes = [(z, x, x + rng.randrange(0, 40), y, y + rng.randrange(0, 40)) for z in (3, 6) for _ in range(12) for x, y in [(rng.randrange(-20, 50), rng.randrange(0, 50))]]
    ranges = spark.createDataFrame([*boxes, (4, 5, 4, 0, 9), (4, None, 4, 0, 9), (None, 0, 9, 0, 9)], "z int, start_x long, end_x long, start_y long, end_y long")
    tiles = spark.createDataFrame([(k, z, rng.randrange(-30, 70), rng.randrange(0, 70)) for k in range(400) for z in (3, 4, 6)] + [(1, None, 1, 1)] * 2, "k long, z int, x long, y long")
    want = sorted(tuple(t) for t in tiles.collect() if t.z and any(t.z == z and a <= t.x <= b and c <= t.y <= d for z, a, b, c, d in boxes))
    assert 200 < len(want) < 800 and sorted(map(tuple, hierarchy.available(tiles, ranges).collect())) == want
    # One tile is met by one block, not by all ranges that have it.
    same = spark.range(3000).selectExpr("6 z", "id % 3 start_x", "id % 3 + 4 end_x", "0L start_y", "3L end_y")
    assert hierarchy.range_blocks(same).count() < 20 and hierarchy.available(tiles.limit(0), same).count() == 0


def test_grid_components(spark):
    cells = spark.createDataFrame([(0, 0, "a"), (1, 0, "a"), (1, 1, "a"), (3, 3, "a"), (2, 0, "b")], "x long, y long, cls string")
    got = sorted(map(tuple, metrics.grid_components(cells).collect()))
    assert got == [("a", 1, 3, 3, 3, 3), ("a", 3, 0, 1, 0, 1), ("b", 1, 2, 2, 0, 0)]


def test_tree_operations(spark):
    rows = [(1, None, 0, "root", "group", True), (2, 1, 0, "a", "vector", True), (3, 1, 1, "b", "raster", False), (4, 3, 0, "c", "odd", True)]
    df = spark.createDataFrame(rows, "id long, parent long, ordinal long, name string, type string, show boolean")
    assert dict(map(tuple, tree.effective_visibility(df).collect())) == {1: True, 2: True, 3: False, 4: False}
    assert {r["id"] for r in tree.remove(df, 3).collect()} == {1, 2}
    assert {(r["id"], r["ordinal"]) for r in tree.move(df, 2, 3, 0).where("parent = 3").collect()} == {(2, 0), (4, 1)}
    with pytest.raises(ValueError):
        tree.move(df, 1, 4, 0)
    made = {r["id"]: r["parent"] for r in tree.clone(df, 3, 50).collect()}
    assert made[50] == 1 and made[51] == 50
    with pytest.raises(ValueError):
        tree.with_ancestry(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))
    scene = tree.scene_json(df)
    again = tree.scene_rows(scene, "scene")
    assert sorted(map(tuple, again.select(*df.columns).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_entities(spark):
    df = spark.createDataFrame([(1, "line", [(0.0, 0.0, 0.0)]), (2, "point", [(1.0, 2.0, 3.0)])], "id long, type string, points array<struct<x:double,y:double,z:double>>")
    p = entities.to_primitive(df)
    assert [r["finished"] for r in p.orderBy("id").collect()] == [False, True]
    assert sorted(map(tuple, entities.to_entity(p).select("id", "type").collect())) == [(1, "line"), (2, "point")]
    assert entities.from_json(entities.to_json(p)).orderBy("id").collect()[1]["size"] == 10
    with pytest.raises(Exception, match="unknown entity"):
        entities.to_primitive(df.withColumn("type", F.lit("blob"))).collect()


def test_polygon_cleaning(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    square, hole, bad = p((0, 0), (0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), p((1, 1), (2, 1), (2, 2)), p((0, 0), (1, 1))
    df = spark.createDataFrame([(1, [square, hole]), (2, [bad, hole]), (3, [square, bad])], "id long, rings array<array<struct<x:double,y:double>>>")
    got = {r["id"]: r["c"] for r in df.select("id", vectors.clean_polygon(F.col("rings")).alias("c")).collect()}
    assert [len(r) for r in got[1]] == [4, 3] and got[2] is None and [len(r) for r in got[3]] == [4]


def test_adaptive_selection(spark):
    def covers(leaves, top, box):
        return sum(4 ** (top - z) for z, _, _ in leaves) >= (box[2] - box[0]) * (box[3] - box[1])

    box, focus = (0.0, 0.0, 63.5, 63.5), (20.5, 9.5)
    free = quadtree.select_adaptive(box, focus, 6, 1, 2.0, 5, 10**6)
    # Without a binding budget: every leaf is as fine as its distance asks, refined level by level.
    want, todo = [], [(1, x, y) for x in (0, 1) for y in (0, 1)]
    while todo:
        z, x, y = todo.pop()
        if quadtree._need(z, x, y, *focus, 2.0, 6, 5, 1)[0] > 0:
            todo += [(z + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]
        else:
            want.append((z, x, y))
    assert free == sorted(want) and covers(free, 6, box)
    for budget in (4, 7, 16, 40):
        tight = quadtree.select_adaptive(box, focus, 6, 1, 2.0, 5, budget)
        assert len(tight) <= budget and covers(tight, 6, box)
    views = spark.createDataFrame([(1, *box, *focus), (2, 0.0, 0.0, 5.0, 5.0, 1.0, 1.0)], "view long, x0 double, y0 double, x1 double, y1 double, fx double, fy double")
    got = quadtree.adaptive_tiles(views, 6, 1, 2.0, 5, 40).collect()
    assert [tuple(r)[1:] for r in got if r["view"] == 1] == quadtree.select_adaptive(box, focus, 6, 1, 2.0, 5, 40)


def test_settle_index_across_slots(spark):
    import random

    draw, rows, expected = random.Random(5), [], {}
    for name, n, share in [("hot", 3000, 0.5), ("rare", 400, 0.15), ("never", 50, 0.0), ("all", 7, 1.0), ("short", 2, 1.0), (None, 30, 0.6)]:
        at, run, first = 0, 0, None
        for _ in range(n):
            at += draw.choice([1, 1, 1, 900])
            quiet = draw.random() < share
            rows.append((name, at, quiet if quiet or draw.random() < 0.8 else None))
            run = run + 1 if quiet else 0
            first = at if first is None and run >= 4 else first
        expected[name] = first
    draw.shuffle(rows)
    samples = spark.createDataFrame(rows, "s string, t long, quiet boolean")
    for slots in (1, 5, 64, 5000):
        assert {r["s"]: r["settled"] for r in metrics.settle_index(samples, "s", "t", F.col("quiet"), 4, slots).collect()} == expected
    assert metrics.settle_index(samples.where("false"), "s", "t", F.col("quiet")).count() == 0
