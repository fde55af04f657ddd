"""Repair, conversion, publication, contents, reports, reference systems, anchors and colours."""

from __future__ import annotations

import base64
import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import camera as C
from tessera.functions import colour, crs
from tessera.operators import anchoring, conversion, meshes, reports
from tessera.operators.repair import repair_polygon, repaired_polygons
from tessera.plans import publish
from tessera.sources import content, geojson, tileset


def enclosed(rings, at):
    """Which places an odd number of rings encloses."""
    odd = np.zeros(len(at), bool)
    for r in rings:
        for a, b in zip(r, np.roll(r, -1, axis=0), strict=True):
            if a[1] != b[1]:
                odd ^= ((a[1] > at[:, 1]) != (b[1] > at[:, 1])) & (at[:, 0] < a[0] + (at[:, 1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]))
    return odd


def square(x, y, s):
    return np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float)


@pytest.mark.parametrize(
    "rings, parts, area, changed",
    [
        ([square(0, 0, 4)], 1, 16, False),
        ([square(0, 0, 4)[::-1], square(1, 1, 2)], 1, 12, False),
        ([np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)], 2, 2, True),
        ([square(0, 0, 4), square(5, 5, 1)], 2, 17, True),
        ([square(0, 0, 4), square(3, 3, 4)], 2, 30, True),
        ([square(0, 0, 4), square(0, 0, 4)], 0, 0, True),
        ([square(0, 0, 4), square(1, 0, 2)], 1, 12, True),
        ([square(0, 0, 4), np.array([(0, 2), (1, 1), (1, 3)], float)], 1, 15, False),
        ([square(0, 0, 10), square(1, 1, 8), square(2, 2, 6)], 2, 72, True),
        ([np.array([(0, 0), (4, 0), (4, 4), (4, 8), (4, 4), (0, 4)], float)], 1, 16, True),
        ([], 0, 0, False),
    ],
)
def test_repair(rings, parts, area, changed):
    made, was = repair_polygon(rings)
    assert (len(made), was) == (parts, changed)
    assert sum(sum(meshes._area2(r) for r in p) / 2 for p in made) == pytest.approx(area)


def test_repair_covers_what_is_enclosed_and_can_be_triangulated():
    rng, at = random.Random(3), np.random.default_rng(0).random((1000, 2)) * 10
    for n in range(120):
        pick = (lambda: rng.randint(0, 10)) if n % 2 else (lambda: rng.uniform(0, 10))
        rings = [np.array([(pick(), pick()) for _ in range(rng.randint(3, 9))], float) for _ in range(rng.randint(1, 3))]
        rings = [r[np.any(r != np.roll(r, 1, axis=0), axis=1)] for r in rings]
        made, _ = repair_polygon([r for r in rings if len(r) > 2])
        got = sum((enclosed(p, at).astype(int) for p in made), np.zeros(len(at), int))
        assert (got == enclosed(rings, at)).all()
        for p in made:
            meshes.triangulate(p)


def features(spark):
    box = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    geometry = [
        {"type": "Polygon", "coordinates": [box(0, 0, 10)]},
        {"type": "Polygon", "coordinates": [[[20, 0], [30, 10], [30, 0], [20, 10], [20, 0]]]},
        {"type": "MultiPolygon", "coordinates": [[box(40, 40, 10), box(42, 42, 2)], [box(60, 60, 5)]]},
        None,
        {"type": "Point", "coordinates": [1, 1]},
        {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]},
    ]
    props = [{"height": "7 m", "osm_id": "a"}, {"height": "x"}, {"height": "5000"}, {}, {}, {}]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in zip(props, geometry, strict=True)]}
    return geojson.features(spark.createDataFrame([("d", json.dumps(doc))], "file string, text string"), "text")


def test_conversion_end_to_end(spark, tmp_path):
    f, keys = features(spark), ["file", "ordinal"]
    parts = conversion.building_parts(f, keys, crs="EPSG:3857")
    got = sorted((r["ordinal"], r["source"], r["height"], r["repaired"], round(r["area"], 6)) for r in parts.withColumn("area", conversion.footprint_area(F.col("rings"))).collect())
    assert got == [(0, "a", 7.0, False, 100.0), (1, "1", 12.0, True, 25.0), (1, "1", 12.0, True, 25.0), (2, "2", 1000.0, False, 25.0), (2, "2", 1000.0, False, 96.0)]
    assert conversion.feature_statistics(f, parts, keys).first().asDict() == {"input_features": 6, "building_parts": 5, "skipped_features": 3, "repaired_features": 1, "min_height": 7.0, "max_height": 1000.0}
    out = f"file://{tmp_path}/city"
    made = conversion.convert_buildings(f, keys, out, grid=2, crs="EPSG:3857", settings={"source": "d.json", "base": None})
    names = {r["name"] for r in made.collect()}
    doc = json.loads((tmp_path / "city" / "tileset.json").read_text())
    assert names == {"tileset.json", "conversion-report.json", *(c["content"]["uri"] for c in doc["root"]["children"])} and len(names) >= 4
    report = json.loads((tmp_path / "city" / "conversion-report.json").read_text())
    assert report["source"] == "d.json" and report["statistics"]["building_parts"] == 5 and report["statistics"]["tiles"] == len(names) - 2
    assert publish.differences(spark, out).count() == 0 and not [p for p in tmp_path.iterdir() if p.name != "city"]
    files = spark.read.format("binaryFile").load(f"{out}/*.glb").select(F.col("path").alias("name"), F.col("content").alias("data"))
    assert content.content_vertices(files).count() == report["statistics"]["vertices"] and content.content_triangles(files).count() == report["statistics"]["triangles"]
    with pytest.raises(FileExistsError):
        conversion.convert_buildings(f, keys, out, crs="EPSG:3857")
    with pytest.raises(ValueError):
        conversion.convert_buildings(f.where("ordinal > 2"), keys, f"{out}2")
    with pytest.raises(ValueError):
        conversion.building_parts(f, keys, crs="EPSG:9999")


def test_interior_points_lie_inside(spark):
    rng = random.Random(1)
    shapes = [[[(0, 0), (10, 0), (10, 1), (1, 1), (1, 9), (10, 9), (10, 10), (0, 10)]], [[(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (8, 1), (8, 8), (1, 8)]]]
    shapes += [[[(math.cos(k) * r + 50, math.sin(k) * r) for k, r in ((2 * math.pi * i / 9, rng.uniform(1, 9)) for i in range(9))]] for _ in range(20)]
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in s]) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, "id int, rings array<array<struct<x:double,y:double>>>")
    for r in df.select("id", conversion.interior_point(F.col("rings")).alias("p")).collect():
        assert enclosed([np.array(q, float) for q in shapes[r["id"]]], np.array([[r["p"]["x"], r["p"]["y"]]])).all()


def test_hole_of_a_convex_footprint_needs_no_cuts(monkeypatch):
    square, hole = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(1, 1), (2, 1), (2, 2), (1, 2)], float)
    cut = []
    monkeypatch.setattr("tessera.operators.repair._odd_edges", lambda *a: cut.append(a))
    made, changed = repair_polygon([square, hole, hole + [1.5, 0]])
    assert not changed and not cut and [r.tolist() for r in made[0]] == [square.tolist(), hole[::-1].tolist(), (hole + [1.5, 0])[::-1].tolist()]
    for other in (hole + [2, 0], hole + [2.5, 0]):  # one touches the outer ring, one crosses it
        with pytest.raises(TypeError):
            repair_polygon([square, other])
    assert len(cut) == 2


def test_statistics_broadcast_no_parts(spark):
    f, parts = spark.range(9).withColumnRenamed("id", "k"), spark.createDataFrame([(1, True, 3.0), (1, False, 4.0), (2, False, 5.0)], "k long, repaired boolean, height double")
    made = conversion.feature_statistics(f, parts, ["k"])
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString() and made.first()["skipped_features"] == 7


def test_documents_are_parsed_once(spark):
    docs = spark.createDataFrame([(1, "{}")], "k long, text string")
    plan = geojson.features(docs, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_repaired_polygons_table(spark):
    point = lambda x, y: {"x": x, "y": y}
    tie = [point(0.0, 0.0), point(2.0, 2.0), point(2.0, 0.0), point(0.0, 2.0), point(0.0, 0.0)]
    rows = [(1, "x", [tie]), (2, "y", None), (3, None, [[point(0.0, None), point(1.0, 1.0)]])]
    got = sorted(((r["id"], r["part"], r["repaired"], r["name"]) for r in repaired_polygons(spark.createDataFrame(rows, "id int, name string, rings array<array<struct<x:double,y:double>>>")).collect()), key=repr)
    assert got == sorted([(1, 0, True, "x"), (1, 1, True, "x"), (2, None, True, "y"), (3, None, True, None)], key=repr)


def test_publication_is_whole_or_not_at_all(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    first = publish.Publication(spark, out)
    spark.range(5).write.parquet(f"{first.folder}/numbers")
    first.put_text("note+ a.txt", "one")
    rows = {r["name"]: r["size"] for r in first.commit().collect()}
    assert rows["note+ a.txt"] == 3 and any(n.startswith("numbers/part-") for n in rows)
    killed = publish.Publication(spark, out, overwrite=True)
    killed.put_text("note+ a.txt", "other")  # never committed
    assert (tmp_path / "out" / "note+ a.txt").read_text() == "one" and publish.differences(spark, out).count() == 0
    (tmp_path / "out").rename(tmp_path / "out.old-abc")  # killed between the two renames
    second = publish.Publication(spark, out, overwrite=True)
    assert (tmp_path / "out" / "note+ a.txt").read_text() == "one"
    second.put_text("b.txt", "two")
    second.commit()
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["b.txt", "manifest.json"]
    (tmp_path / "out" / "b.txt").write_text("2")
    (tmp_path / "out" / "c.txt").write_text("new")
    (tmp_path / "out" / ".b.txt.crc").unlink(missing_ok=True)
    assert {tuple(r) for r in publish.differences(spark, out).collect()} == {("b.txt", "changed"), ("c.txt", "unknown")}
    with pytest.raises(FileExistsError):
        publish.Publication(spark, out)
    killed.abandon()
    assert not [p for p in tmp_path.iterdir() if p.name != "out"]


def test_reports_against_limits_and_an_earlier_run(spark, tmp_path):
    out = f"file://{tmp_path}/report"
    spec = spark.createDataFrame([("pan", "blur", 0.3, None), ("pan", "fps", None, 20.0), ("tilt", "blur", 0.3, None)], "scenario string, metric string, max double, min double")
    early = reports.long_values(spark.createDataFrame([("pan", 0.5, 30)], "s string, blur double, fps int"), "s", ["blur", "fps"])
    reports.publish_report(spark, out, early, spec)
    now = reports.long_values(spark.createDataFrame([("pan", 0.25, 12)], "s string, blur double, fps int"), "s", ["blur", "fps"])
    report = reports.compare(now, spec, reports.read_values(spark, out))
    got = {(r["scenario"], r["metric"]): (r["verdict"], r["change"]) for r in report.collect()}
    assert got == {("pan", "blur"): ("pass", -0.25), ("pan", "fps"): ("fail", -18.0), ("tilt", "blur"): ("unknown", None)}
    assert {r["scenario"]: (r["checks"], r["failed"], r["unknown"], r["passed"]) for r in reports.verdicts(report).collect()} == {"pan": (2, 1, 0, False), "tilt": (1, 0, 1, True)}
    reports.publish_report(spark, out, now, spec, early)
    lines = next((tmp_path / "report" / "report").glob("part-*")).read_text().splitlines()
    assert lines[2] == "| pan | 2 | 1 | FAIL |" and "| pan | fps | 12 | >= 20 | FAIL | 30 | -18 |" in lines


def tree_glb():
    """Two primitives under turned and moved nodes, one indexed strip and one fan without indices, in a stated stride."""
    p = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], "<f4")
    wide = np.zeros((4, 5), "<f4")
    wide[:, :3] = p
    index = np.array([0, 1, 2, 3], "<u2")
    blob = wide.tobytes() + index.tobytes()
    doc = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}],
        "nodes": [{"translation": [10, 0, 0], "children": [1, 2]}, {"mesh": 0, "rotation": [0, 0, math.sqrt(0.5), math.sqrt(0.5)], "scale": [2, 2, 2]}, {"mesh": 1}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "mode": 5}]}, {"primitives": [{"attributes": {"POSITION": 0}, "mode": 6}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 4, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 4, "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteLength": 80, "byteStride": 20}, {"buffer": 0, "byteOffset": 80, "byteLength": 8}],
        "buffers": [{"byteLength": 88, "uri": "data:application/octet-stream;base64," + base64.b64encode(blob).decode()}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sII", b"glTF", 2, 20 + len(text)) + struct.pack("<I4s", len(text), b"JSON") + text


def test_contents(spark):
    good = tree_glb()
    rows = [("t", good), ("cut", good[:200]), ("none", None), ("text", b"hello"), ("b", b"b3dm" + struct.pack("<6I", 1, 0, 0, 0, 4, 0) + b"abcd" + good)]
    df = spark.createDataFrame(rows, "name string, data binary")
    states = {r["name"]: (r["state"], r["primitives"], r["vertices"], r["triangles"]) for r in content.content_states(df).collect()}
    assert states == {"t": ("loaded", 2, 8, 4), "b": ("loaded", 2, 8, 4), "cut": ("failed", 0, 0, 0), "none": ("failed", 0, 0, 0), "text": ("failed", 0, 0, 0)}
    vertices = content.content_vertices(df).where("name = 't'").cache()
    at = {(r["primitive"], r["id"]): (r["x"], r["y"], r["z"]) for r in vertices.collect()}
    assert at[0, 1] == pytest.approx((10, 0, 2)) and at[0, 2] == pytest.approx((8, 0, 0)) and at[1, 3] == pytest.approx((11, 0, 1))
    tri = sorted((r["primitive"], r["t"], r["a"], r["b"], r["c"]) for r in content.content_triangles(df).where("name = 't'").collect())
    assert tri == [(0, 0, 0, 1, 2), (0, 1, 1, 3, 2), (1, 0, 0, 1, 2), (1, 1, 0, 2, 3)]
    moved = content.placed(vertices, spark.createDataFrame([("t", [float(v) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 6, 7, 1)])], "name string, transform array<double>"))
    assert {(round(r["x"], 6), round(r["y"], 6), round(r["z"], 6)) for r in moved.where("primitive = 1").collect()} == {(15, 6, 7), (16, 6, 7), (15, 6, 8), (16, 6, 8)}


def test_convex_parts_at_once_equal_one_by_one(spark):
    rng = random.Random(2)
    rings = [[[(0, 0), (0, 4), (4, 4), (4, 0)]], [[(0, 0), (5, 0), (5, 5), (2, 1)]], [[(math.cos(k) * 3, math.sin(k) * 2) for k in sorted(rng.uniform(0, 6.28) for _ in range(n))] for n in (5,)], [[(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (2, 1), (2, 2), (1, 2)]], [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]]
    rows = [(0, 0, i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in s], 0.5, 3.0 + i) for i, s in enumerate(rings)]
    got = {r["id"]: r for r in meshes.part_meshes(spark.createDataFrame(rows, "col long, row long, id long, rings array<array<struct<x:double,y:double>>>, base double, height double")).collect()}
    for _, _, i, _, base, height in rows:
        p, n, t = meshes.extrude([np.array(r, float) for r in rings[i]], base, height)
        assert np.allclose(np.frombuffer(got[i]["positions"]).reshape(-1, 3), p) and np.allclose(np.frombuffer(got[i]["normals"]).reshape(-1, 3), n)
        assert np.frombuffer(got[i]["indices"], np.int64).tolist() == t.tolist() and (got[i]["vertices"], got[i]["triangles"]) == (len(p), len(t) // 3)


def test_reference_systems(spark):
    df = spark.createDataFrame([(2.2945, 48.8582), (None, 1.0)], "lng double, lat double")
    e, n = crs.from_wgs84(F.col("lng"), F.col("lat"), "epsg:32631")
    row = df.select(e.alias("e"), n.alias("n")).collect()
    assert (row[0]["e"], row[0]["n"]) == pytest.approx((448251.795, 5411932.678), abs=1e-3) and row[1]["e"] is None
    for code, lng in (("EPSG:32731", 4.0), ("EPSG:4513", 76.1), ("EPSG:4526", 114.2), ("EPSG:4534", 74.5), ("EPSG:4549", 121.3), ("EPSG:4491", 76.0), ("EPSG:4502", 77.7), ("EPSG:3857", 1.0), ("OGC:CRS84", 1.0), ("EPSG:4490", 1.0)):
        at = spark.createDataFrame([(lng, y) for y in (-79.0, 0.0, 24.5, 83.0)], "lng double, lat double")
        x, y = crs.from_wgs84(F.col("lng"), F.col("lat"), code)
        back = at.withColumns({"x": x, "y": y})
        a, b = crs.to_wgs84(F.col("x"), F.col("y"), code)
        worst = back.agg(F.max(F.abs(a - F.col("lng"))), F.max(F.abs(b - F.col("lat")))).first()
        assert max(worst) < 1e-10
    assert crs.zone_of(4526).east == 38_500_000 and crs.zone_of(4549).meridian == 120 and crs.zone_of(32650).meridian == 117 and crs.zone_of(4491).meridian == 75
    for bad in ("EPSG:27700", "wgs", "EPSG:x"):
        with pytest.raises(ValueError):
            crs.to_wgs84(F.col("x"), F.col("y"), bad)


def test_anchors_carry_spheres_along(spark):
    lng, lat = 118.1, 24.48
    m = spark.range(1).select(tileset.enu_to_ecef(F.lit(lng), F.lit(lat))).first()[0]
    doc = {"root": {"transform": m, "geometricError": 9, "boundingVolume": {"box": [0, 0, 50, 9, 0, 0, 0, 9, 0, 0, 0, 50]}, "children": [{"geometricError": 0, "boundingVolume": {"sphere": [30, -40, 60, 7]}}]}}
    region = {"root": {"geometricError": 9, "boundingVolume": {"region": [2.0, 0.5, 2.01, 0.51, 10, 30]}}}
    tree = tileset.nodes(spark.createDataFrame([("a", json.dumps(doc)), ("r", json.dumps(region))], "n string, j string"), "n", "j")
    made = {r["tileset"]: r for r in anchoring.anchors(tree, 118.0, 24.0, lift=5.0).collect()}
    assert (made["a"]["lng"], made["a"]["lat"], made["a"]["height"]) == pytest.approx((lng, lat, 50), abs=1e-6)
    assert (made["r"]["lng"], made["r"]["lat"], made["r"]["height"]) == pytest.approx((math.degrees(2.005), math.degrees(0.505), 20), abs=1e-6)
    at = {r["node"]: r for r in anchoring.in_frame(tree, anchoring.anchors(tree, 118.0, 24.0, lift=5.0)).where("tileset = 'a'").collect()}
    east = 6378137 * math.radians(0.1)
    north = 6378137 * (math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) - math.log(math.tan(math.pi / 4 + math.radians(24) / 2)))
    assert (at["0"]["x"], at["0"]["y"], at["0"]["z"]) == pytest.approx((east, north, 55), abs=1e-3)
    assert (at["0/0"]["x"], at["0/0"]["y"], at["0/0"]["z"], at["0/0"]["radius"]) == pytest.approx((east + 30, north - 40, 65, 7), abs=1e-3)
    assert at["0"]["transform"][:12] == pytest.approx([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0], abs=1e-9)


def test_screen_and_ground(spark):
    eye, target = {"x": 100.0, "y": -300.0, "z": 250.0}, {"x": 0.0, "y": 0.0, "z": 0.0}
    df = C.with_basis(spark.createDataFrame([(x, y, eye, target) for x, y in ((640.0, 430.0), (10.0, 800.0), (1270.0, 500.0), (640.0, -5000.0), (None, 1.0))], "px double, py double, eye struct<x:double,y:double,z:double>, target struct<x:double,y:double,z:double>"))
    made = df.withColumn("g", C.ground_under(F.col("px"), F.col("py"), 1280.0, 860.0, 60.0)).withColumn("back", C.pixel_of(F.col("g"), 1280.0, 860.0, 60.0, 1.0, 1e5)).collect()
    assert (made[0]["g"]["x"], made[0]["g"]["y"]) == pytest.approx((0, 0), abs=1e-9)
    assert all((r["back"]["x"], r["back"]["y"]) == pytest.approx((r["px"], r["py"])) for r in made[:3]) and made[3]["g"] is None and made[4]["g"] is None
    behind = df.select(C.pixel_of(F.struct(F.lit(200.0).alias("x"), F.lit(-900.0).alias("y"), F.lit(900.0).alias("z")), 1280.0, 860.0, 60.0, 1.0, 1e5).alias("p")).first()
    assert behind["p"] is None


def test_level_colours(spark):
    df = spark.createDataFrame([(16, 0, 1), (1, 7, 3), (21, 1, 1), (None, 1, 1), (3, 8_000_000, 4_000_000)], "z int, x long, y long")
    got = [r["c"] for r in df.select(colour.level_colour(F.col("z"), F.col("x"), F.col("y")).alias("c")).collect()]
    hashes = [((x * 73856093) ^ (y * 19349663)) & 0xFFFFFFFF for x, y in ((0, 1), (7, 3), (1, 1), (8_000_000, 4_000_000))]
    assert hashes[1] % 3 == 1 and got[1] == [0x8E, 0x05, 0xF0] and got[3] is None
    assert [r[0] for r in df.where("z is not null").select(colour.tile_hash(F.col("x"), F.col("y"))).collect()] == hashes
