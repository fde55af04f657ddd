"""Figures of views, boxes and availability without metadata, slots and components of hot groups."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import lod as L
from tessera.operators import entities, pixels, tree
from tessera.operators import hierarchy as H
from tessera.operators import metrics as M
from tessera.operators import overview as O
from tessera.operators import vectors as W
from tessera.plans import components
from tessera.plans.staging import Staging


def test_served_tiles(spark):
    tiles = spark.createDataFrame([(1, 0, 0), (1, 3, 1), (2, 5, 2)], "z int, x long, y long")
    ranges = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 4, 6, 0, 3)], "z int, start_x long, end_x long, start_y long, end_y long")
    keys = lambda df: sorted(tuple(r) for r in df.collect())
    assert keys(H.served(tiles, None)) == [(1, 0, 0), (1, 3, 1), (2, 5, 2)] and keys(H.served(tiles, ranges)) == [(1, 0, 0), (2, 5, 2)]
    assert keys(H.served(tiles, ranges, (40.0, -90.0, 60.0, 90.0))) == [(2, 5, 2)] and keys(H.served(tiles, None, (90.0, 0.0, 90.0, 0.0))) == [(1, 3, 1), (2, 5, 2)]


def test_boxes(spark):
    rows = [(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0), (0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 2.0, 1.0), (0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 6.0, 6.0), (0.0, 0.0, 1.0, 1.0, None, 0.0, 1.0, 1.0), (0.0, 0.0, 9.0, 9.0, 1.0, 1.0, 9.0 + 1e-10, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double")
    box, view = tuple(map(F.col, "abcd")), tuple(map(F.col, "efgh"))
    got = df.select(H.box_overlap(box, view).alias("o"), H.box_covers(box, view).alias("c"), H.in_known_view(box, view).alias("v")).collect()
    assert [tuple(r["o"]) if r["o"] else None for r in got] == [(1, 1, 2, 2), (1, 0, 1, 1), None, None, (1, 1, 9, 2)]
    assert [r["c"] for r in got] == [False, False, False, True, True] and [r["v"] for r in got] == [True, True, False, True, True]
    assert df.limit(1).select(H.box_covers((F.lit(None).cast("double"),) * 4, view)).first()[0] is False


def test_figures_of_views(spark):
    df = spark.createDataFrame([(1, None, True, 5.0, 10.0), (1, True, None, None, None), (2, False, True, 1.0, 900.0)], "z int, backup boolean, drawn boolean, far double, y double")
    legend = {r["z"]: tuple(r)[1:] for r in O.zoom_legend(df, F.col("z"), F.col("backup"), F.col("drawn"), F.col("far")).collect()}
    assert legend == {1: (1, 1, 1, 5.0), 2: (1, 0, 1, 1.0)}
    assert [r[0] for r in df.select(O.band(F.col("y"), 30.0)).collect()] == ["middle", None, "lower"]
    assert [r[0] for r in df.select(O.band(F.col("y"), 40.0, ("top", "bottom"))).collect()] == ["top", None, "bottom"]
    assert O.small_tiles(df, {"z": F.col("z")}, F.col("far"), 3).where("z = 1").first()["tiny"] == 0
    assert O.cache_sizes(df, F.col("z"), F.lit(None).cast("long"), F.col("backup")).where("cache = 2").first()[:] == (2, 1, 0, 0)
    assert O.observed_maxima(df, {}, F.col("far"), F.col("z"), F.col("drawn")).first()[:] == (5.0, 2)
    far = O.nearest_probe((F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.lit(3.0), F.lit(4.0), (F.lit(3.0), F.lit(4.0), F.lit(2.0)))
    assert df.select(far).first()[0] == 2.0 and df.select(O.layer_for(F.lit(None).cast("int"), F.lit(5))).first()[0] == "overview"
    rings = spark.createDataFrame([([(1.0, 1.0)], None), (None, [[(2.0, 2.0)], None])], "o array<struct<x:double,y:double>>, h array<array<struct<x:double,y:double>>>")
    assert [len(r[0]) for r in rings.select(W.all_corners(F.col("o"), F.col("h"))).collect()] == [1, 1]


def test_slots_stand_outliers_and_nulls(spark):
    rows = [("a", float(i)) for i in range(2000)] + [("a", 1e15), ("b", None), (None, 1.0)]
    got = M.in_slots(spark.createDataFrame(rows, "g string, v double"), "g", F.col("v"), 16)
    assert got.count() == len(rows) and got.where("g = 'a'").groupBy("_slot").count().agg(F.max("count")).first()[0] < 400
    ordered = [r["_slot"] for r in got.where("g = 'a'").orderBy("v").collect()]
    assert ordered == sorted(ordered) and got.where("g = 'b'").first()["_slot"] == -1


def test_stuck_and_watchdog_across_slots(spark):
    rng = random.Random(2)
    rows = [("s", i if i else 10**9, rng.random() < 0.7, float(rng.randrange(2))) for i in range(500)]
    df = spark.createDataFrame(rows, "scenario string, seq long, interacting boolean, pose double")
    ordered = sorted(rows, key=lambda r: r[1])
    want = sum(b[2] and abs(a[3] - b[3]) < 1e-3 for a, b in zip(ordered, ordered[1:], strict=False))
    assert M.stuck_gestures(df, "scenario", "seq", ["pose"], slots=8).first()["stuck"] == want
    still = spark.createDataFrame([(1, 0, "x"), (1, 500, "x"), (1, 900, "x"), (1, 950, None), (1, 2000, None)], "a int, t long, pose string")
    assert [r["released"] for r in M.watchdog(still, "a", ["t"], "t", "pose", 800).orderBy("t").collect()] == [False, False, True, False, True]


def test_components_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_ROWS", 10)
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)] + [(5000, 5000)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Staging(spark, "test"))
    assert dict(map(tuple, got.collect())) == {v: find(v) for v in root}


def test_window_medians_across_blocks(spark):
    rng = random.Random(5)
    held = {(x, y): rng.choice([None, *range(9)]) for x in range(-30, 60) for y in range(-9, 40) if rng.random() < 0.8}
    df = spark.createDataFrame([(x, y, v, "own") for (x, y), v in held.items()], "x int, y int, z int, note string")
    got = {(r["x"], r["y"]): r["median"] for r in pixels.window_median(df, "z", 6, 2, 10, block=16).collect()}
    want = {}
    for x, y in held:
        s = sorted(v for i in range(-6, 7, 2) for j in range(-6, 7, 2) if (v := held.get((x + i, y + j))) is not None)
        if len(s) >= 10:
            want[x, y] = s[len(s) // 2]
    assert got == want and pixels.window_median(df.limit(0), "z").count() == 0
    real = spark.createDataFrame([(0, 0, 1.5), (1, 0, 2.5)], "x int, y int, z double")
    assert {r["median"] for r in pixels.window_median(real, "z", 1, 1, 2).collect()} == {2.5}


def test_footprints_with_relief(spark):
    df = spark.createDataFrame([(1000.0,), (0.0,), (None,)], "eye double")
    view = lambda relief: df.select(L.view_footprint(F.col("eye"), F.lit(40.0), F.lit(60.0), F.lit(1.5), relief).alias("f")).collect()
    flat, raised, above = view(0.0), view(200.0), view(5000.0)
    assert [len(r["f"]) for r in flat] == [4, 0, 0] and [len(r["f"]) for r in raised] == [6, 0, 0] and len(above[0]["f"]) == 4
    low, lifted = flat[0]["f"][0], raised[0]["f"][0]
    assert lifted["up"] == 200 and abs(lifted["right"] - low["right"] * 0.8) < 1e-6 and abs(lifted["forward"] - low["forward"] * 0.8) < 1e-6
    assert [tuple(p) for p in (raised[0]["f"][1], *raised[0]["f"][3:])] == [tuple(p) for p in flat[0]["f"]]


def test_scene_edits(spark):
    rows = [(1, None, 0, "root", "group"), (2, 1, 0, "Layer1", "vector"), (3, 1, 1, "Group1", "group"), (4, 3, 0, "Layer3", "vector"), (5, 1, 2, "Layer01", "vector"), (6, 1, 3, "Layerx", "group")]
    nodes = spark.createDataFrame(rows, "id long, parent long, ordinal long, name string, type string")
    assert tree.next_name(nodes, "Layer", "vector") == "Layer2" and tree.next_name(nodes, "Group", "group") == "Group2" and tree.next_name(nodes.limit(0), "Layer", "vector") == "Layer1"
    pasted = {r["id"]: (r["parent"], r["ordinal"], r["name"]) for r in tree.paste(nodes, 3, 6, 100).collect()}
    assert pasted[100] == (6, 0, "Group1 copy") and pasted[101] == (100, 0, "Layer3") and len(pasted) == 8 and pasted[3] == (1, 1, "Group1")
    order = lambda df: [r["id"] for r in df.where("parent = 1").orderBy("ordinal").collect()]
    assert order(tree.shift(nodes, 3, -1)) == [3, 2, 5, 6] and order(tree.shift(nodes, 3, 1)) == [2, 5, 3, 6] and order(tree.shift(nodes, 2, 99)) == [3, 5, 6, 2]
    with pytest.raises(ValueError):
        tree.shift(nodes, 1, 1)
    held = spark.createDataFrame([(2, "a"), (4, "b"), (None, "c")], "layer long, what string")
    assert {r["what"] for r in tree.cleared(nodes, held, 3).collect()} == {"a", "c"} and {r["what"] for r in tree.cleared(nodes, held, 1).collect()} == {"c"}


def test_primitives_as_json(spark):
    shape = "id string, kind string, points array<struct<x:double,y:double,z:double>>, style string"
    df = spark.createDataFrame([("b", "Box", [(1.0, 2.0, 3.0)], '{"width":2.5,"color":"#fff"}'), ("l", "Polyline", [(0.0, 0.0, 0.0), (1.0, 1.0, 1.5)], None)], shape)
    texts = {r["id"]: r["json"] for r in entities.primitive_json(df).collect()}
    assert json.loads(texts["b"]) == {"primitiveType": "Box", "id": "b", "position": [1, 2, 3], "style": {"width": 2.5, "color": "#fff"}}
    assert json.loads(texts["l"]) == {"primitiveType": "Polyline", "id": "l", "points": [[0, 0, 0], [1, 1, 1.5]], "style": {}}
    back = {r["id"]: r for r in entities.primitive_rows(entities.primitive_json(df)).collect()}
    assert [tuple(p) for p in back["b"]["points"]] == [(1, 2, 3)] and json.loads(back["b"]["style"])["width"] == 2.5 and back["l"]["kind"] == "Polyline"
    odd = spark.createDataFrame([("no json",), ('{"primitiveType":"Cone","id":"c"}',), (None,)], "json string")
    assert [r["kind"] for r in entities.primitive_rows(odd).collect()] == [None, None, None]
    with pytest.raises(Exception, match="unknown kind"):
        entities.primitive_json(df.withColumn("kind", F.lit("Cone"))).collect()
