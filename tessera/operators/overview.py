"""What views and caches hold, in figures: legends by level, bands of the screen, small tiles, maxima, cache sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.camera import Vector, distance


def nearest_probe(center: Vector, half_wide: Column, half_tall: Column, eye: Vector) -> Column:
    """The distance of an eye to the nearest of five places of a tile: its middle and its corners, at the middle's height."""
    x, y, z = center
    places = [(x, y, z), *[(x + half_wide * i, y + half_tall * j, z) for i in (-1, 1) for j in (-1, 1)]]
    return F.least(*[distance(p, eye) for p in places])


def zoom_legend(tiles: DataFrame, zoom: Column, backup: Column, drawn: Column, far: Column) -> DataFrame:
    """(z, visible, backups, drawn, nearest) by level: tiles that are shown, that stand in for others and that are drawn, and the nearest one's distance.

    A tile with a null flag counts as none of the kind; levels without tiles have no row.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    return tiles.groupBy(zoom.alias("z")).agg(F.count_if(~flag(backup)).alias("visible"), F.count_if(flag(backup)).alias("backups"), F.count_if(flag(drawn)).alias("drawn"), F.min(far).alias("nearest"))


def small_tiles(tiles: DataFrame, by: dict[str, Column], pixels: Column, least: float) -> DataFrame:
    """The tiles of each group and those (``tiny``) that show fewer than ``least`` pixels a side; an unknown size is not small."""
    return tiles.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.count_if(pixels < least).alias("tiny"), F.count("*").alias("n"))


def band(y: Column, height: float, names: tuple[str, ...] = ("upper", "middle", "lower")) -> Column:
    """The name of the horizontal band of a screen that a pixel's row lies in; bands are equally tall, rows beyond belong to the nearest."""
    out = F.when(y < height / len(names), names[0])
    for k, name in enumerate(names[1:-1], 2):
        out = out.when(y < height * k / len(names), name)
    return out.otherwise(F.when(y.isNotNull(), names[-1]))


def band_ranges(samples: DataFrame, by: dict[str, Column], far: Column, zoom: Column) -> DataFrame:
    """Samples of each group with the range of their distances and levels: n, nearest, farthest, coarsest, finest."""
    return samples.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.count("*").alias("n"), F.min(far).alias("nearest"), F.max(far).alias("farthest"), F.min(zoom).alias("coarsest"), F.max(zoom).alias("finest"))


def observed_maxima(tiles: DataFrame, by: dict[str, Column], height: Column, zoom: Column, visible: Column) -> DataFrame:
    """The greatest height met and the deepest visible level of each group; null where none is known."""
    return tiles.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.max(height).alias("highest"), F.max(F.when(visible, zoom)).alias("deepest"))


def cache_sizes(entries: DataFrame, cache: Column, size: Column, hit: Column) -> DataFrame:
    """Entries, bytes and hits of each cache; an entry of unknown size has none."""
    return entries.groupBy(cache.alias("cache")).agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))


def layer_for(zoom: Column, detail_from: Column, overview: str = "overview", detail: str = "detail") -> Column:
    """Which of two layers is shown: the detailed one from its least level on; an unknown level shows the overview."""
    return F.when(zoom >= detail_from, detail).otherwise(overview)
