"""Batch conversion of features: statistics, report, bounds, classes of lines, colours."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import crs as R
from tessera.functions import projection as P
from tessera.functions.parsing import building_height, is_major_road, is_subway, parse_number, rail_offset, source_id
from tessera.operators.meshes import cell_meshes, write_files
from tessera.operators.repair import repaired_polygons
from tessera.operators.vectors import grid_cell, ring_area
from tessera.plans.joins import shuffled
from tessera.plans.publish import Publication
from tessera.plans.staging import Staging
from tessera.sources.geojson import polygons
from tessera.sources.tileset import tileset_json

#: Wall colour, its shift by the hash and by the height, and the roof's difference.
WALL, BY_HASH, BY_HEIGHT, ROOF = (174.0, 181.0, 186.0), (18.0, 12.0, 4.0), (-12.0, -8.0, 8.0), (24, 23, 20)


def statistics(features: DataFrame) -> DataFrame:
    """One row about ``features`` (parts, repaired, height): counts, and the heights of those with a part.

    A feature without a polygon is skipped.  An empty table has counts of 0 and null heights.
    """
    kept = F.col("parts") > 0
    return features.agg(
        F.count("*").alias("input_features"),
        F.coalesce(F.sum("parts"), F.lit(0)).cast("long").alias("building_parts"),
        F.count_if(~kept).alias("skipped_features"),
        F.count_if(kept & F.col("repaired")).alias("repaired_features"),
        F.min(F.when(kept, F.col("height"))).alias("min_height"),
        F.max(F.when(kept, F.col("height"))).alias("max_height"),
    )


def write_report(stats: DataFrame, path: str, settings: dict[str, str | float | None]) -> None:
    """Writes the one row of ``stats`` with the settings of the run as a JSON file in the folder ``path``."""
    fixed = [F.lit(v).alias(k) for k, v in settings.items() if v is not None]
    stats.select(*fixed, F.struct("*").alias("statistics")).coalesce(1).write.mode("overwrite").json(path)


def checked_arguments(grid: int, least_height: float, most_height: float, default_height: float) -> None:
    """Raises ValueError unless the grid is 1 to 64 and the heights are positive and in order."""
    if not 1 <= grid <= 64:
        raise ValueError("the grid must have 1 to 64 cells a side")
    if not 0 < least_height <= most_height or default_height <= 0:
        raise ValueError("heights must be positive, the least no more than the most")


def bounds_of(points: DataFrame, by: list[str], lng: str, lat: str, least: int = 3) -> DataFrame:
    """West, south, east and north of the points of each key that has ``least`` of them."""
    box = points.groupBy(*by).agg(F.count("*").alias("_n"), F.min(lng).alias("west"), F.min(lat).alias("south"), F.max(lng).alias("east"), F.max(lat).alias("north"))
    return box.where(F.col("_n") >= least).drop("_n")


def line_kind(fclass: Column) -> Column:
    """What a line is drawn as, by its class."""
    return F.when(is_major_road(fclass), "major road").when(is_subway(fclass), "subway").when(fclass == "rail", "rail").when(fclass == "river", "water").otherwise("local road")


def line_altitude(kind: Column, layer: Column) -> Column:
    """Height at which a line is drawn: railways by their layer, the edge of water just above it."""
    return F.when(kind.isin("subway", "rail"), 3.2 + rail_offset(layer)).when(kind == "water", 0.8 + 0.35).otherwise(2.4)


def with_colours(df: DataFrame, id_col: str, height_col: str) -> DataFrame:
    """``df`` with ``wall`` and ``roof``, arrays of red, green and blue, by a hash of the id and the share of the largest height.

    The largest height is one aggregate over all rows, joined by broadcast.  A null id counts as an
    empty one, a null height as 0.
    """

    @F.pandas_udf("array<int>")
    def wall(ids: pd.Series, share: pd.Series) -> pd.Series:
        seed = np.array([hashlib.blake2b((x or "").encode(), digest_size=2).digest()[0] / 255.0 for x in ids])
        made = np.array(WALL) + np.array(BY_HASH) * (seed - 0.5)[:, None] + np.array(BY_HEIGHT) * share.to_numpy()[:, None]
        return pd.Series(list(np.clip(made, 0, 255).astype(np.uint8).astype(np.int32)))

    most = F.broadcast(df.agg(F.greatest(F.max(height_col), F.lit(1.0)).alias("_most")))
    met = df.join(most).withColumn("wall", wall(F.col(id_col).cast("string"), F.least(F.coalesce(F.col(height_col) / F.col("_most"), F.lit(0.0)), F.lit(1.0)))).drop("_most")
    return met.withColumn("roof", F.zip_with("wall", F.array(*map(F.lit, ROOF)), lambda a, b: F.least(a + b, F.lit(255))))


def in_mercator(rings: Column, crs: str) -> Column:
    """Rings of a reference system as rings in metres of the Mercator plane."""

    def moved(p: Column) -> Column:
        if crs.upper() == "EPSG:3857":
            return p
        lng, lat = R.to_wgs84(p["x"], p["y"], crs)
        return F.struct(P.mercator_x(lng).alias("x"), P.mercator_y(lat).alias("y"))

    return F.transform(rings, lambda r: F.transform(r, moved))


def building_parts(
    features: DataFrame,
    keys: list[str],
    crs: str = "EPSG:4326",
    height_property: str = "height",
    default_height: float = 12.0,
    height_scale: float = 1.0,
    least_height: float = 1.0,
    most_height: float = 1000.0,
    base_height: float = 0.2,
    base_property: str | None = None,
) -> DataFrame:
    """The polygons of building features, repaired and in metres of the Mercator plane: one row per part.

    ``features`` is as ``geojson.features`` gives it; ``keys`` name a feature.  Columns: the keys, ``source`` (its osm_id, id or ordinal),
    ``rings``, ``base``, ``height``, ``repaired``.  Geometry that is no polygon, or of which nothing is
    left, has no row.  Each polygon is repaired by itself: those of one feature may overlap.  An unknown ``crs`` raises ValueError.
    """
    prop = lambda name: F.try_element_at("properties", F.lit(name))
    height = building_height(prop(height_property), height_scale, default_height, least_height, most_height)
    base = parse_number(prop(base_property), base_height) if base_property else F.lit(base_height)
    told = features.select(*keys, source_id(prop("osm_id"), F.col("id"), F.col("ordinal")).alias("source"), base.alias("base"), height.alias("height"), "type", "coordinates", "geometries")
    mended = repaired_polygons(polygons(told)).where("rings is not null")
    return mended.select(*keys, "source", in_mercator(F.col("rings"), crs).alias("rings"), "base", "height", "repaired")


def feature_statistics(features: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``statistics`` of features and their ``building_parts``; a null key is a feature's name like any other."""
    made = parts.groupBy(*keys).agg(F.count("*").alias("parts"), F.max("repaired").alias("repaired"), F.max("height").alias("height"))
    renamed = made.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "parts", "repaired", "height")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    met = features.select(*keys).join(shuffled(renamed), on, "left")
    return statistics(met.withColumns({"parts": F.coalesce("parts", F.lit(0)), "repaired": F.coalesce("repaired", F.lit(False))}))


def interior_point(rings: Column) -> Column:
    """A point (x, y) inside a polygon: the middle of its widest stretch halfway up, between the vertices nearest to that height."""
    ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    middle = (F.array_min(ys) + F.array_max(ys)) / 2
    level = (F.array_max(F.filter(ys, lambda y: y <= middle)) + F.array_min(F.filter(ys, lambda y: y > middle))) / 2

    def meetings(ring: Column, y: Column) -> Column:
        def meet(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % F.size(ring))
            return F.when((p["y"] > y) != (q["y"] > y), p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"]))

        return F.array_compact(F.transform(ring, meet))

    def widest(y: Column) -> Column:
        xs = F.array_sort(F.flatten(F.transform(rings, lambda r: meetings(r, y))))

        def stretches(x: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(x) / 2) - 1, F.lit(0).cast("long"))), lambda k: F.struct((F.get(x, 2 * k + 1) - F.get(x, 2 * k)).alias("wide"), ((F.get(x, 2 * k) + F.get(x, 2 * k + 1)) / 2).alias("x"), y.alias("y")))
            return F.array_max(pairs)

        return F.get(F.transform(F.array(xs), stretches), F.lit(0))

    best = F.get(F.transform(F.array(level), widest), F.lit(0))
    return F.struct(best["x"].alias("x"), best["y"].alias("y"))


def convert_buildings(features: DataFrame, keys: list[str], out: str, grid: int = 8, overwrite: bool = False, settings: dict[str, str | float | None] | None = None, **options) -> DataFrame:
    """Converts building features to a published tileset at ``out`` and returns the manifest of its files.

    ``features`` and ``options`` are those of ``building_parts``.  Parts are dealt to ``grid`` x ``grid`` cells by a point
    inside each; a cell is one binary glTF, or several if it is large, named in ``tileset.json``; ``conversion-report.json``
    has ``settings`` and the statistics.  Nothing appears at ``out`` before all is whole.  Features without any
    polygon raise ValueError.
    """
    checked_arguments(grid, options.get("least_height", 1.0), options.get("most_height", 1000.0), options.get("default_height", 12.0))
    spark = features.sparkSession
    staging = Staging(spark, "conversion")
    parts = staging.keep(building_parts(features, keys, **options).withColumn("id", F.monotonically_increasing_id()), "parts")
    outer = F.get("rings", F.lit(0))
    along = {v: F.transform(outer, (lambda p: p["x"]) if v == "x" else (lambda p: p["y"])) for v in "xy"}
    ends = {f"{v}{k}": f(along[v]) for v in "xy" for k, f in ((0, F.array_min), (1, F.array_max))}
    box = parts.agg(*[(F.min if k.endswith("0") else F.max)(e).alias(k) for k, e in ends.items()]).first()
    if box["x0"] is None:
        raise ValueError("no polygons among the features")
    mid_x, mid_y = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    point = interior_point(F.col("rings"))
    west, south, east, north = (F.lit(box["x0"]), F.lit(box["y0"]), F.greatest(F.lit(box["x1"]), F.lit(box["x0"] + 1.0)), F.greatest(F.lit(box["y1"]), F.lit(box["y0"] + 1.0)))
    placed = parts.withColumn("_p", point)
    col, row = grid_cell(F.col("_p.x"), F.col("_p.y"), west, south, east, north, grid)
    shifted = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] - mid_x).alias("x"), (p["y"] - mid_y).alias("y"))))
    placed = placed.select(col.alias("col"), row.alias("row"), "id", shifted.alias("rings"), "base", "height")
    run = Publication(spark, out, overwrite)
    meshes = staging.keep(cell_meshes(placed).withColumn("name", F.concat(F.concat_ws("_", F.lit("tile"), "col", "row", "piece"), F.lit(".glb"))), "meshes")
    write_files(meshes, run.folder, "name", "glb")
    bounds = placed.groupBy("col", "row").agg(*[(F.min if k.endswith("0") else F.max)(e).alias(k) for k, e in ends.items()], F.min("base").alias("z0"), F.max(F.col("base") + F.col("height")).alias("z1"))
    cells = meshes.select("col", "row", "name", "parts", "vertices", "triangles").join(bounds, ["col", "row"])
    lng, lat = spark.range(1).select(P.inverse_mercator_x(F.lit(mid_x)), P.inverse_mercator_y(F.lit(mid_y))).first()
    run.put_text("tileset.json", tileset_json(cells, lng, lat).first()[0])
    made = meshes.agg(F.count("*").alias("tiles"), F.sum("vertices").alias("vertices"), F.sum("triangles").alias("triangles"), F.sum(F.octet_length("glb")).alias("output_bytes")).first().asDict()
    counts = feature_statistics(features, parts, keys).first().asDict() | made
    report = {k: v for k, v in (settings or {}).items() if v is not None} | {"centerWgs84": [lng, lat], "sourceMercatorBounds": [box["x0"], box["y0"], box["x1"], box["y1"]], "gridSize": grid, "statistics": counts}
    run.put_text("conversion-report.json", json.dumps(report, indent=2) + "\n")
    return run.commit()


def footprint_area(rings: Column) -> Column:
    """The area of a polygon: its outer ring's less those of its holes."""
    sizes = F.transform(rings, lambda r: F.abs(ring_area(r)))
    return 2 * F.get(sizes, F.lit(0)) - F.aggregate(sizes, F.lit(0.0), lambda a, v: a + v)
