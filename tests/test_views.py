from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import camera
from tessera.operators import conversion, metrics, pixels, queueing, triangles
from tessera.queries.meshes import building_tops
from tessera.sources import geojson
from tests.conftest import SF


def test_straight_down_and_behind(spark):
    df = spark.createDataFrame([((0.0, 0.0, 100.0), (0.0, 0.0, 0.0))], "eye struct<x:double,y:double,z:double>, target struct<x:double,y:double,z:double>")
    df = camera.with_basis(df)
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in ((0.0, 0.0, 0.0), (100.0, 0.0, 0.0), (0.0, 100.0, 0.0), (0.0, 0.0, 200.0))])
    got = df.select(F.transform(points, lambda p: camera.project(p, 90.0, 1.0, 1.0, 1000.0)).alias("p")).first()["p"]
    assert [(round(p["x"], 9), round(p["y"], 9)) for p in got[:3]] == [(0, 0), (1, 0), (0, 1)] and got[3]["z"] > 1
    sized = camera.screen_size(df.withColumn("probes", points), "probes", 90.0, 1.0, 1.0, 1000.0, 200.0, 100.0).first()
    assert (sized["pixel_size"], sized["visible_min"], sized["reliable"]) == (pytest.approx(100), pytest.approx(50), False)


def test_colours_equal_hashlib(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 40.0), (None, None)], "id string, height double")
    for r in conversion.with_colours(df, "id", "height").collect():
        seed = hashlib.blake2b((r["id"] or "").encode(), digest_size=2).digest()[0] / 255 - 0.5
        wall = [int(min(max(w + s * seed + h * ((r["height"] or 0) / 40), 0), 255)) for w, s, h in zip((174, 181, 186), (18, 12, 4), (-12, -8, 8), strict=True)]
        assert r["wall"] == wall and r["roof"] == [min(a + b, 255) for a, b in zip(wall, (24, 23, 20), strict=True)]


def test_report_and_arguments(spark, tmp_path):
    features = spark.createDataFrame([(1, False, 5.0), (0, True, 90.0), (2, True, 7.0)], "parts int, repaired boolean, height double")
    conversion.write_report(conversion.statistics(features), f"file://{tmp_path}/r", {"source": "x.json", "gridSize": 8.0, "base": None})
    text = next((tmp_path / "r").glob("part-*.json")).read_text()
    assert json.loads(text) == {"source": "x.json", "gridSize": 8.0, "statistics": {"input_features": 3, "building_parts": 3, "skipped_features": 1, "repaired_features": 1, "min_height": 5.0, "max_height": 7.0}}
    assert conversion.statistics(features.limit(0)).first()["building_parts"] == 0
    conversion.checked_arguments(8, 1, 1000, 12)
    for bad in ((0, 1, 2, 3), (65, 1, 2, 3), (8, 5, 2, 3), (8, 0, 2, 3)):
        with pytest.raises(ValueError):
            conversion.checked_arguments(*bad)


def test_suffix_max_equals_one_window(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), None if d == 7 else float(d), int(z), i) for i, (g, d, z) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 90, 500), rng.integers(0, 30, 500), strict=True))]
    df = spark.createDataFrame(rows, "g int, d double, z int, k int")
    want = {}
    for g in range(3):
        best = None
        for _, d, z, k in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[3]), reverse=True):
            want[k], best = best, z if best is None else max(best, z)
    assert {r["k"]: r["m"] for r in metrics.suffix_max(df, "g", ["d", "k"], "z", "m", slots=8).collect()} == want
    assert metrics.suffix_max(df.limit(0), "g", ["d", "k"], "z", "m").count() == 0


def test_edges_of_pixels_and_queues(spark):
    one = spark.createDataFrame([(0, 0, 3)], "x long, y long, z long")
    assert pixels.window_median(one, "z", 2, 1, 2).count() == 0 and pixels.window_median(one, "z", 2, 1, 1).first()["median"] == 3
    samples = spark.createDataFrame([(1, 5.0, 5.0), (1, 50.0, 5.0)], "view long, px double, py double")
    boxes = spark.createDataFrame([(1, 3, 0.0, 10.0, 0.0, 10.0, 2.0), (1, 4, 0.0, 9.0, 0.0, 9.0, 1.0)], "view long, z int, x0 double, x1 double, y0 double, y1 double, ratio double")
    assert pixels.sample_ratios(samples, boxes, 1.2, 4).first()[:] == (1, 2, 1, 0, 1)
    assert pixels.sample_ratios(samples, boxes.limit(0), 1.2, 4).first()["uncovered"] == 2
    owners = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "request long, owner long")
    assert [r["request"] for r in queueing.ownerless(owners, spark.createDataFrame([(11,), (11,)], "owner long")).collect()] == [2]
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0), (1, 1, 0.0, 0.0, 7.0), (1, 2, 0.0, 0.0, -9.0), (1, 3, 0.0, 0.0, 50.0)], "mesh long, vertex int, x double, y double, z double")
    t = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 1, 2)], "mesh long, a int, b int, c int")
    assert {r["vertex"]: r["top"] for r in triangles.building_top(v, t).collect()} == {0: 7.0, 1: 7.0, 2: 7.0, 3: 0.0}


def test_tops_of_dealt_meshes_are_not_shuffled_again(spark):
    """Every shuffle of the query deals out orders, none corners; odd rows give what joins would give."""
    made = building_tops(spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_NUM" in plan and made.count() == 9 * spark.read.parquet(f"{SF}/orders.parquet").count()
    v = spark.createDataFrame([(1, 0, 4.0, "a"), (1, 0, 6.0, "b"), (1, 1, None, "c"), (None, 0, 8.0, "d"), (1, None, 9.0, "e"), (2, 0, -5.0, "f")], "mesh long, vertex int, z double, name string")
    t = spark.createDataFrame([(1, 0, 1, 7), (None, 0, 0, 0), (1, None, None, 1), (2, 0, 0, 0), (3, 0, 1, 2)], "mesh long, a long, b long, c long")
    tops = triangles.building_top(v, t)
    assert tops.schema.simpleString() == "struct<mesh:bigint,vertex:int,z:double,name:string,top:double>"
    assert sorted((r["name"], r["vertex"], r["top"]) for r in tops.collect()) == [("a", 0, 6.0), ("b", 0, 6.0), ("c", 1, 6.0), ("d", 0, 0.0), ("e", None, 0.0), ("f", 0, 0.0)]


def test_nested_collections_are_not_lost(spark):
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}
    for _ in range(7):
        shape = {"type": "GeometryCollection", "geometries": [shape, {"type": "Point", "coordinates": [1, 1]}, shape]} if _ == 6 else {"type": "GeometryCollection", "geometries": [shape]}
    doc = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": shape}]})
    found = geojson.features(spark.createDataFrame([(doc,)], "d string"), "d")
    assert geojson.polygons(found).count() == 2
