"""The tile pyramid: covers, parents, children, ancestors, roll-ups, occlusion.

Tiles are rows (z, x, y).  Everything is an equi-join or an explode with a
stated bound; nothing loops over tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tiling as T


def cover(df: DataFrame, west: str, south: str, east: str, north: str, zoom: Column, most: int = 4096) -> DataFrame:
    """One row per row of ``df`` and tile of its box at that zoom; a box of more than ``most`` tiles raises an error."""
    x0, x1 = T.tile_x(F.col(west), zoom), T.tile_x(F.col(east), zoom)
    y0, y1 = T.tile_y(F.col(north), zoom), T.tile_y(F.col(south), zoom)
    boxed = df.withColumns({"z": zoom.cast("int"), "_x0": F.least(x0, x1), "_x1": F.greatest(x0, x1), "_y0": F.least(y0, y1), "_y1": F.greatest(y0, y1)})
    n = (F.col("_x1") - F.col("_x0") + 1) * (F.col("_y1") - F.col("_y0") + 1)
    xs = F.when(n <= most, F.sequence("_x0", "_x1")).otherwise(F.raise_error(F.lit(f"a box covers more than {most} tiles")))
    return boxed.withColumn("x", F.explode(xs)).withColumn("y", F.explode(F.sequence("_y0", "_y1"))).drop("_x0", "_x1", "_y0", "_y1")


def children(df: DataFrame) -> DataFrame:
    """The four tiles below each tile, in place of it."""
    four = F.array(*[F.struct((F.col("x") * 2 + i).alias("x"), (F.col("y") * 2 + j).alias("y")) for j in (0, 1) for i in (0, 1)])
    rest = [c for c in df.columns if c not in ("z", "x", "y")]
    return df.select(*rest, (F.col("z") + 1).alias("z"), F.explode(four).alias("_c")).select(*rest, "z", "_c.x", "_c.y")


def ancestors(df: DataFrame, least: Column | int = 0, proper: bool = True, name: str = "a") -> DataFrame:
    """Each tile with every tile above it down to zoom ``least``: columns ``{name}z``, ``{name}x``, ``{name}y``.

    At most 22 rows for a tile.  With ``proper`` false the tile itself is among them.
    """
    least = F.lit(least) if isinstance(least, int) else least
    top = F.col("z") - 1 if proper else F.col("z")
    levels = F.when(top >= least, F.sequence(least, top)).otherwise(F.array().cast("array<int>"))
    out = df.withColumn(f"{name}z", F.explode(levels))
    d = F.col("z") - F.col(f"{name}z")
    return out.withColumns({f"{name}x": T.parent(F.col("x"), d), f"{name}y": T.parent(F.col("y"), d)})


def rollup(tiles: DataFrame, measures: dict[str, Column], least: int = 0) -> DataFrame:
    """Sums at every zoom from the tiles' own down to ``least``; additive measures only."""
    up = ancestors(tiles, least, proper=False)
    return up.groupBy(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).agg(*[F.sum(c).alias(k) for k, c in measures.items()])


def child_flags(parents: DataFrame, tiles: DataFrame, south_origin: bool = False) -> DataFrame:
    """(z, x, y, nw, ne, sw, se) of each parent: which of its children are among ``tiles``."""
    low = F.col("y") % 2
    right = F.col("x") % 2
    top = low == (1 if south_origin else 0)
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    up = tiles.groupBy((F.col("z") - 1).alias("z"), T.parent(F.col("x"), 1).alias("x"), T.parent(F.col("y"), 1).alias("y")).agg(
        flag(top & (right == 0)).alias("nw"), flag(top & (right == 1)).alias("ne"), flag(~top & (right == 0)).alias("sw"), flag(~top & (right == 1)).alias("se")
    )
    return parents.join(up, ["z", "x", "y"], "left").select("z", "x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nw", "ne", "sw", "se")])


def fully_covered(tiles: DataFrame, depth: int) -> DataFrame:
    """(z, x, y) of every tile of whose descendants ``depth`` levels below all are among ``tiles``."""
    up = tiles.where(F.col("z") >= depth).select((F.col("z") - depth).alias("z"), T.parent(F.col("x"), depth).alias("x"), T.parent(F.col("y"), depth).alias("y"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return up.distinct().groupBy("z", "x", "y").count().where(F.col("count") == 4**depth).select("z", "x", "y")


def covered_ancestors(tiles: DataFrame, levels: int = 24) -> DataFrame:
    """Every tile above one of ``tiles``, ``levels`` up at most, once."""
    least = F.greatest(F.col("z") - levels, F.lit(0))
    return ancestors(tiles.select("z", "x", "y"), least).select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()


def quadrant_coverage(tiles: DataFrame, depth: int = 4) -> DataFrame:
    """(z, x, y) of the tiles covered by renderable ones: themselves, or all four of their quadrants.

    ``tiles`` has (z, x, y, renderable).  A tile that is loaded but not
    renderable is not covered, whatever lies below it.  Levels are joined bottom
    up, ``depth`` times at most.
    """
    blocked = tiles.where(~F.col("renderable")).select("z", "x", "y")
    done = tiles.where("renderable").select("z", "x", "y").distinct()
    for _ in range(depth):
        done = done.union(fully_covered(done, 1).join(blocked, ["z", "x", "y"], "left_anti")).distinct()
    return done
