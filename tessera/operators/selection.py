"""Selection of tiles for views, prefetching and base layers: explodes with stated caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tiling as T
from tessera.operators.hierarchy import available, nearest_available
from tessera.operators.pyramid import children


def geo_range(west: Column, south: Column, east: Column, north: Column, zoom: Column, origin: str) -> tuple[Column, Column, Column, Column]:
    """First and last column and row of a box in the geographic scheme."""
    x0, x1 = T.geo_x(west, zoom), T.geo_x(east, zoom)
    y0, y1 = T.geo_y(south, zoom, origin), T.geo_y(north, zoom, origin)
    return F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)


def fitting_level(views: DataFrame, top: Column, least: int, most_tiles: int, origin: str = "south") -> DataFrame:
    """``views`` (view, west, south, east, north) with ``z``, the finest level up to ``top`` whose tiles number ``most_tiles`` at most.

    Views for which no level from ``least`` on fits are left out.
    """
    levels = views.withColumn("z", F.explode(F.when(top >= least, F.sequence(F.lit(least), top)).otherwise(F.array().cast("array<int>"))))
    x0, x1, y0, y1 = geo_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("z"), origin)
    n = (x1 - x0 + 1) * (y1 - y0 + 1)
    return levels.where(n <= most_tiles).groupBy(*views.columns).agg(F.max("z").alias("z"))


def tiles_of(views: DataFrame, origin: str = "south") -> DataFrame:
    """One row per view and tile of its box at its level z; use after ``fitting_level``, which bounds them."""
    x0, x1, y0, y1 = geo_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("z"), origin)
    boxed = views.withColumns({"_x": F.sequence(x0, x1), "_y": F.sequence(y0, y1)})
    return boxed.withColumn("x", F.explode("_x")).withColumn("y", F.explode("_y")).drop("_x", "_y")


def flat_selection(views: DataFrame, zoom: Column, ranges: DataFrame, most_tiles: int = 64, max_lod: int = 3, min_zoom: int = 0, origin: str = "south") -> DataFrame:
    """(view, z, x, y) of the tiles that a view without a camera shows.

    All tiles of the box at ``zoom`` if they number ``most_tiles`` at most;
    else those of the first level from ``zoom - max_lod`` down that fits, or of
    ``min_zoom``.  Each is replaced by its nearest available ancestor.
    """
    wanted = views.withColumn("_top", zoom.cast("int"))
    x0, x1, y0, y1 = geo_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("_top"), origin)
    fits = (x1 - x0 + 1) * (y1 - y0 + 1) <= most_tiles
    whole = wanted.where(fits).withColumn("z", F.col("_top")).drop("_top")
    over = wanted.where(~fits).withColumn("_from", F.greatest(F.col("_top") - max_lod, F.lit(min_zoom)))
    found = fitting_level(over, F.col("_from"), min_zoom, most_tiles, origin)
    coarse = over.join(found.select("view", "z"), "view", "left").withColumn("z", F.coalesce("z", F.lit(min_zoom))).drop("_top", "_from")
    picked = tiles_of(whole.select(*coarse.columns).union(coarse), origin).select("view", "z", "x", "y")
    return nearest_available(picked, ranges, min_zoom).where("rz is not null").select("view", F.col("rz").alias("z"), F.col("rx").alias("x"), F.col("ry").alias("y")).distinct()


def prefetch(visible: DataFrame, held: DataFrame, ranges: DataFrame, budget: int) -> DataFrame:
    """The next level: available children of the deepest visible tiles that are not held, ``budget`` at most, in key order."""
    deepest = visible.agg(F.max("z").alias("_top"))
    below = children(visible.join(F.broadcast(deepest), F.col("z") == F.col("_top")).select("z", "x", "y"))
    return available(below, ranges).join(held.select("z", "x", "y"), ["z", "x", "y"], "left_anti").distinct().orderBy("z", "x", "y").limit(budget)
