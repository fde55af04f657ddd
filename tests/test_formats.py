from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.catalog import ORACLES
from tessera.operators import meshes as M
from tessera.plans import joins
from tessera.plans.joins import broadcast_if_small, join_dealt
from tessera.plans.staging import Staging
from tessera.queries.sources import geojson_lines
from tessera.sources import content, geojson, terrain, tileset
from tests.helpers import duck_rows, rows_of


def test_geojson_geometries(spark, tmp_path):
    docs = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "id": 1, "properties": {"fclass": "primary"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, "x"], [2, 2]]}},
            {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0]], [[1, 1], [2, 2]]]}},
            {"type": "Feature", "properties": None, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
            {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [[[[0, 0], [3, 0], [3, 3]]], [[[5, 5], [6, 5], [6, 6]]]]}, {"type": "Point", "coordinates": [1, 1]}]}},
            {"type": "Feature", "geometry": None},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(docs))
    (tmp_path / "b.json").write_text(json.dumps({"type": "Feature"}))
    (tmp_path / "c.json").write_text("no json")
    f = geojson.read_features(spark, f"file://{tmp_path}")
    assert f.count() == 5
    assert sorted(len(r["line"]) for r in geojson.lines(f).collect()) == [2, 2]
    assert sorted(len(r["rings"][0]) for r in geojson.polygons(f).collect()) == [3, 3, 4]


def test_mean_of_a_line_adds_by_id(spark, tmp_path):
    """At an exact half the SQL's mean hangs on the order of rows; the query's does not, and is that of rows by id."""
    ids = [0, 1, 14]
    frame = pd.DataFrame({"event_id": ids, "user_id": 5, "event_type": "view", "ts": pd.Timestamp("2024-01-01"), "value": 1.0})
    want, sql = {}, ORACLES["geojson_lines"]
    for name, order in (("up", ids), ("down", ids[::-1])):
        rows = frame.set_index("event_id", drop=False).loc[order].reset_index(drop=True)
        want[name] = duck_rows(sql, events=rows)
        spark.createDataFrame(rows).coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
    assert [want[k][1][0][want[k][0].index("mean_lat_e2")] for k in ("up", "down")] == [-4541, -4540]
    assert rows_of(geojson_lines(spark, f"{tmp_path}/up")) == rows_of(geojson_lines(spark, f"{tmp_path}/down")) == want["up"]


def mesh():
    u, v, h = np.array([0, 32767, 32767, 0]), np.array([0, 0, 32767, 32767]), np.array([0, 100, 50, 25])
    return u, v, h, np.array([0, 1, 2, 2, 1, 3])


def test_quantized_mesh_round_trip(spark):
    u, v, h, i = mesh()
    payload = terrain.encode_mesh(u, v, h, i, 10.0, 100.0)
    df = spark.createDataFrame([(1, payload, 0.0, 0.0, 2.0, 1.0), (2, payload[:95], 0.0, 0.0, 2.0, 1.0), (3, None, 0.0, 0.0, 2.0, 1.0)], "id long, payload binary, west double, south double, east double, north double")
    rows = terrain.read_meshes(df)
    got = {r["id"]: r for r in rows.collect()}
    assert got[1]["u"] == u.tolist() and got[1]["v"] == v.tolist() and got[1]["h"] == h.tolist() and got[1]["indices"] == i.tolist()
    assert got[2]["u"] is None and got[3]["low"] is None
    corner = {r["i"]: r for r in terrain.vertices(rows).collect()}
    assert corner[2]["lng"] == pytest.approx(2.0) and corner[2]["lat"] == pytest.approx(1.0) and corner[1]["height"] == pytest.approx(10 + 90 * 100 / 32767)


def test_availability(spark):
    doc = json.dumps({"scheme": "slippyMap", "tiles": ["{z}/{x}/{y}"], "maxzoom": 9, "valid_bounds": [-1, -1, 1, 1], "available": [[{"startX": 0, "endX": 1, "startY": 0, "endY": 0}], [{"startX": 0, "endX": "?", "startY": 0, "endY": 0}, {"startX": 2, "endX": 3, "startY": 1, "endY": 1}]]})
    m = terrain.layer_metadata(spark.createDataFrame([(doc,)], "d string"), "d", 12)
    assert m.select("y_origin", "max_zoom", "template").first() == ("north", 9, "{z}/{x}/{y}")
    assert sorted(map(tuple, terrain.availability_ranges(m.select("available")).collect())) == [(0, 0, 1, 0, 0), (1, 2, 3, 1, 1)]


def area(p, t):
    a, b, c = p[t.reshape(-1, 3)].transpose(1, 0, 2)
    return (((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2)


def test_triangulation_keeps_area():
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    hole = np.array([(2, 2), (4, 2), (4, 4), (2, 4)], float)
    other = np.array([(6, 6), (8, 6), (8, 8), (6, 8)], float)
    concave = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    crossed = [np.array([(0, 0), (2, 2), (2, 0), (0, 3)], float)]
    with pytest.raises(ValueError):
        M.triangulate(crossed)
    rng = np.random.default_rng(3)
    for _ in range(150):  # aligned holes too
        cells = rng.permutation(16)[: rng.integers(0, 7)]
        holes = [np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float) + [1 + 2 * (c % 4), 1 + 2 * (c // 4)] for c in cells]
        assert area(*M.triangulate([square, *holes])).sum() == pytest.approx(100 - len(holes))
    for rings, want in (([square], 100), ([square[::-1], hole], 96), ([square, hole[::-1], other], 92), ([concave], 10)):
        parts = area(*M.triangulate(rings))
        assert (parts > 0).all() and parts.sum() == pytest.approx(want)


def test_cells_to_glb_and_tileset(spark, tmp_path):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 3.0}, {"x": 0.0, "y": 3.0}]
    parts = spark.createDataFrame([(0, 0, 1, [ring], 0.2, 9.0), (0, 0, 2, [ring], 0.2, 5.0), (1, 0, 3, [ring], 0.2, 5.0)], "col long, row long, id long, rings array<array<struct<x:double,y:double>>>, base double, height double")
    cells = M.cell_meshes(parts)
    got = {(r["col"], r["row"]): r for r in cells.collect()}
    assert got[0, 0]["parts"] == 2 and got[0, 0]["vertices"] == 2 * (4 + 16) and got[0, 0]["triangles"] == 2 * (2 + 8)
    glb = bytes(got[1, 0]["glb"])
    magic, version, length = struct.unpack_from("<4sII", glb)
    assert (magic, version, length) == (b"glTF", 2, len(glb))
    n, kind = struct.unpack_from("<I4s", glb, 12)
    doc = json.loads(glb[20 : 20 + n])
    assert kind == b"JSON" and doc["accessors"][0]["count"] == 20 and doc["accessors"][3]["componentType"] == 5123
    wrapped = b"b3dm" + struct.pack("<6I", 1, 0, 3, 0, 2, 0) + b"abcde" + glb
    bare = spark.createDataFrame([(1, wrapped), (2, glb), (3, b"b3dm"), (4, None)], "id int, data binary").select("id", content.unwrapped(F.col("data")).alias("data"))
    assert {r["id"]: r["data"] and bytes(r["data"]) for r in bare.collect()} == {1: glb, 2: glb, 3: b"b3dm", 4: None}
    named = cells.selectExpr("concat(col, '_', row, '.glb') name", "glb")
    M.write_files(named, str(tmp_path), "name", "glb")
    assert (tmp_path / "1_0.glb").read_bytes() == glb
    assert M.cell_meshes(parts, most_vertices=20).where("col = 0 and row = 0").selectExpr("sum(parts) p", "sum(vertices) v").first()[:] == (2, 40)


def test_tileset_document(spark):
    boxes = spark.createDataFrame([(0, 1, "b.glb", 3.0, 0.0, 0.0, 3.0, 4.0, 12.0, 2, 7, 5), (0, 0, "a.glb", 0.0, 0.0, 0.0, 3.0, 4.0, 0.0, 1, 7, 5)], "col int, row int, name string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, parts int, vertices int, triangles int")
    doc = json.loads(tileset.tileset_json(boxes, 118.1, 24.48).first()[0])
    root = doc["root"]
    assert doc["geometricError"] == root["geometricError"] == 5 and root["refine"] == "REPLACE"
    assert root["boundingVolume"]["box"] == [0, 0, 6, 3, 0, 0, 0, 4, 0, 0, 0, 6]
    assert [c["content"]["uri"] for c in root["children"]] == ["a.glb", "b.glb"] and root["children"][1]["extras"] == {"grid": [0, 1], "buildingParts": 2, "vertices": 7, "triangles": 5}
    assert root["children"][0]["boundingVolume"]["box"] == [1.5, 2, 0, 1.5, 0, 0, 0, 2, 0, 0, 0, 0.01]
    m = root["transform"]
    assert np.linalg.norm(m[12:15]) == pytest.approx(6374400, abs=2000) and np.dot(m[0:3], m[4:7]) == pytest.approx(0, abs=1e-12) and m[15] == 1
    assert doc["extras"] == {"centerWgs84": [118.1, 24.48, 0.0], "buildingParts": 3, "tileCount": 2}
    with pytest.raises(ValueError):
        tileset.tileset_json(boxes.limit(0), 0.0, 0.0)


TREE = {
    "root": {
        "boundingVolume": {"sphere": [0, 0, 0, 100]}, "geometricError": 100, "transform": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 10, 0, 0, 1],
        "children": [
            {"boundingVolume": {"sphere": [-50, 0, 0, 50]}, "geometricError": 40, "refine": "ADD", "content": {"uri": "l.b3dm"}, "children": [{"boundingVolume": {"box": [-50, 0, 0, 3, 0, 0, 0, 4, 0, 0, 0, 0]}, "geometricError": 0, "content": {"url": "ll.json"}}]},
            {"boundingVolume": {"sphere": [50, 0, 0, 50]}, "geometricError": 0, "content": {"uri": "r.b3dm"}},
        ],
    }
}


def test_tileset_nodes_and_traversal(spark):
    docs = spark.createDataFrame([("t", json.dumps(TREE)), ("bad", "x"), ("none", None)], "n string, j string")
    tree = tileset.nodes(docs, "n", "j")
    rows = {r["node"]: r for r in tree.collect()}
    assert set(rows) == {"0", "0/0", "0/1", "0/0/0"} and rows["0/0"]["x"] == -40 and rows["0/0/0"]["radius"] == 7 and rows["0/0/0"]["refine"] == "ADD"
    cams = spark.createDataFrame([("far", "t", 1e6, 0.0, 0.0, 900.0, 60.0), ("near", "t", 0.0, 0.0, 300.0, 900.0, 60.0)], "camera string, tileset string, cx double, cy double, cz double, height double, fov double")
    shown = {(r["camera"], r["node"]) for r in tileset.traverse(tree, cams).collect()}
    assert shown == {("far", "0"), ("near", "0/0"), ("near", "0/0/0"), ("near", "0/1")}
    culled = cams.selectExpr("*", "array(array(1D, 0D, 0D, 0D)) frustum")
    assert ("near", "0/0/0") not in {(r["camera"], r["node"]) for r in tileset.traverse(tree, culled, planes=True).collect()}
    inner = spark.createDataFrame([("ll.json", json.dumps({"root": {"boundingVolume": {"sphere": [1, 2, 3, 4]}, "geometricError": 0, "content": {"uri": "in.b3dm"}}}))], "n string, j string")
    whole = {r["node"]: r for r in tileset.expand_external(tree, tileset.nodes(inner, "n", "j")).collect()}
    assert whole["0/0/0"]["content"] is None and whole["0/0/0/0"]["x"] == 11 and whole["0/0/0/0"]["parent"] == "0/0/0" and whole["0/0/0/0"]["depth"] == 3


def test_traversal_stages_no_leaves(spark, monkeypatch):
    wide = {"root": {"boundingVolume": {"sphere": [0, 0, 0, 100]}, "geometricError": 100, "children": [{"boundingVolume": {"sphere": [k, 0, 0, 1]}, "geometricError": 0} for k in range(50)]}}
    tree = tileset.nodes(spark.createDataFrame([("t", json.dumps(wide))], "n string, j string"), "n", "j")
    cams = spark.range(40).selectExpr("id camera", "'t' tileset", "0D cx", "0D cy", "1D cz", "900D height", "60D fov")
    kept, keep = {}, tileset.Staging.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(tileset.Staging, "keep", counted)
    shown = tileset.traverse(tree, cams)
    assert shown.count() == shown.distinct().count() == 2000 and max(n for name, n in kept.items() if name.startswith("level")) == 40


def test_dealt_join_has_all_pairs(spark):
    left, right = spark.range(300).selectExpr("if(id < 250, 1, id % 7) k", "id a"), spark.range(90).selectExpr("if(id < 60, 1, id % 9) k", "id b")
    want = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    for pairs in (1000, 10**9):
        got = join_dealt(left, right, ["k"], F.xxhash64("a"), pairs)
        assert got.columns == ["k", "a", "b"] and sorted(map(tuple, got.collect())) == want
    assert join_dealt(left.limit(0), right, ["k"], F.xxhash64("a")).count() == 0


def test_join_by_blocks(spark, monkeypatch):
    """The pairs of a join, with keys of several blocks and parts, null keys, many lots, and beyond the bound of a broadcast."""
    left, right = spark.range(300).selectExpr("if(id % 50 = 0, null, if(id < 250, 1, id % 7)) k", "id a"), spark.range(90).selectExpr("if(id % 30 = 0, null, if(id < 60, 1, id % 9)) k", "id b", "if(id % 2 = 0, null, 'x') c")
    want = sorted(map(repr, map(tuple, left.join(right, "k").select("k", "a", "b", "c").collect())))
    monkeypatch.setattr(joins, "BLOCK", 4)
    monkeypatch.setattr(joins, "PART", 3)
    for bound in (joins.BROADCAST_ROWS, 0):
        monkeypatch.setattr(joins, "broadcast_if_small", lambda df, rows=bound: broadcast_if_small(df, rows))
        for pairs in (1000, 10**9):
            got = joins.join_blocks(left, right, ["k"], F.xxhash64("a"), Staging(spark, "test"), "right", pairs)
            assert got.columns == ["k", "a", "b", "c"] and sorted(map(repr, map(tuple, got.collect()))) == want
    monkeypatch.undo()
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert joins.join_blocks(a, b, ["k"], F.xxhash64("a"), Staging(spark, "test"), "right").count() == 0


def test_many_tiles_for_many_cameras_take_little_disk(spark, tmp_path):
    """An open tile's leaves repeat in short periods; all 14,000 in a row for each camera took 2 bytes a row, as pages of files have no two of such a period."""
    node = "'t' tileset, {} node, {} parent, {} depth, {} error, 'REPLACE' refine, {} x, 0.0D y, 0.0D z, 1.0D radius"
    tree = spark.range(1).selectExpr(*node.format("'r'", "cast(null as string)", 0, "1e9D", "0.0D").split(", "))
    tree = tree.union(spark.range(14_000).selectExpr(*node.format("'s' || id", "'r'", 1, "0.0D", "cast(id as double)").split(", ")))
    cameras = spark.range(200).selectExpr("id camera", "'t' tileset", "10.0D cx", "0.0D cy", "0.0D cz", "860.0D height", "60.0D fov")
    tileset.traverse(tree, cameras).select("camera", "node").write.parquet(f"{tmp_path}/shown")
    shown = spark.read.parquet(f"{tmp_path}/shown")
    assert shown.count() == shown.distinct().count() == 200 * 14_000
    assert sum(f.stat().st_size for f in (tmp_path / "shown").glob("*.parquet")) < 200 * 14_000 * 0.5


def test_region_sphere():
    x, y, z, r = tileset.bounding_sphere({"region": [-0.01, -0.01, 0.01, 0.01, 0, 100]})
    assert x == pytest.approx(6378187, abs=1) and abs(y) < 1e-6 and 80000 < r < 100000
