"""Datasets of 3D tiles in the frame of a map: anchors, and spheres and points carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import projection as P


def applied(matrix: Column, point: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A point moved by a column-major 4 x 4 transform."""
    at = lambda k: F.get(matrix, F.lit(k))
    return tuple(sum((at(4 * j + r) * point[j] for j in range(3)), at(12 + r)) for r in range(3))


def product(a: Column, b: Column) -> Column:
    """The transform that does ``b`` and then ``a``, both column-major."""
    at = lambda m, k: F.get(m, F.lit(k))
    return F.array(*[sum((at(a, 4 * k + r) * at(b, 4 * c + k) for k in range(4)), F.lit(0.0)) for c in range(4) for r in range(4)])


def anchors(tree: DataFrame, origin_lng: float, origin_lat: float, lift: float = 0.0) -> DataFrame:
    """(tileset, lng, lat, height, to_local) of each tileset in a node table, by the centre of its root's volume.

    ``to_local`` is the column-major transform from earth-centred coordinates to metres east, north
    and up in the map's plane, whose origin is (origin_lng, origin_lat): the east-north-up frame at the centre,
    moved to where the map has it, ``lift`` metres higher.  One row per root; a tileset without one has none.
    """
    roots = tree.where(F.col("parent").isNull()).select("tileset", "x", "y", "z")
    lng, lat, height = P.geodetic(F.col("x"), F.col("y"), F.col("z"))
    placed = roots.withColumn("_at", F.struct(lng.alias("lng"), lat.alias("lat"), height.alias("height"))).select("tileset", "x", "y", "z", "_at.*")
    placed = placed.withColumn("_axes", P.enu_axes(F.col("lng"), F.col("lat")))
    east, north = P.local_xy(F.col("lng"), F.col("lat"), origin_lng, origin_lat)
    axis = lambda k, i: F.get("_axes", F.lit(3 * k + i))
    here = (east, north, F.col("height") + lift)
    shift = [here[k] - sum((axis(k, i) * F.col(c) for i, c in enumerate("xyz")), F.lit(0.0)) for k in range(3)]
    columns = [axis(k, i) if k < 3 else F.lit(0.0) for i in range(3) for k in range(4)]
    return placed.select("tileset", "lng", "lat", "height", F.array(*columns, *shift, F.lit(1.0)).alias("to_local"))


def in_frame(tree: DataFrame, anchors: DataFrame) -> DataFrame:
    """The node table with its spheres and transforms in the map's frame; nodes of a tileset without an anchor are left out.

    Anchors are one row a tileset, so a tileset of any size is joined by a small side or dealt by AQE.
    """
    met = tree.join(anchors.select("tileset", "to_local"), "tileset")
    x, y, z = applied(F.col("to_local"), (F.col("x"), F.col("y"), F.col("z")))
    moved = {"x": x, "y": y, "z": z, "transform": product(F.col("to_local"), F.col("transform"))}
    return met.withColumns(moved).select(*tree.columns)
