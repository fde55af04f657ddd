"""Range joins over availability and nearest-ancestor joins.

A plain range join would compare every tile with every range.  Here a range is cut
into blocks whose sides are powers of two, as a quadtree has them, so that
a tile is in a range exactly if it is in one of its blocks: an equi-join, however many
ranges overlap.  ``binned_ranges`` keys ranges by bins of a level's width instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tiling as T
from tessera.operators.pyramid import ancestors


def level_widths(ranges: DataFrame, per_range: int = 16) -> Column:
    """The bin width of each level as one map, a scalar subquery; tile arithmetic has at most 62 levels."""
    widest = ranges.where("z is not null").groupBy(F.col("z").cast("int").alias("z")).agg(F.max(F.col("end_x") - F.col("start_x") + 1).alias("w"))
    width = F.greatest(F.ceil(F.col("w") / (per_range - 1)), F.lit(1)).cast("long")
    return widest.agg(F.map_from_entries(F.collect_list(F.struct("z", width.alias("width"))))).scalar()


def binned_ranges(ranges: DataFrame, per_range: int = 16) -> DataFrame:
    """``ranges`` (z, start_x, end_x, start_y, end_y) with one row per bin: ``width`` of the level and ``bin``."""
    keyed = ranges.withColumn("width", F.try_element_at(level_widths(ranges, per_range), F.col("z").cast("int")))
    return keyed.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_x") / F.col("width")), F.floor(F.col("end_x") / F.col("width")))))


def _blocks(low: Column, high: Column) -> Column:
    """The fewest (side, at) with ``at * 2 ** side`` to ``(at + 1) * 2 ** side - 1`` that make up ``low`` to ``high``: two of a side at most."""

    def of(side: Column) -> Column:
        up = lambda v: -F.call_function("shiftright", -v, side)
        first, end = up(low), F.call_function("shiftright", high + 1, side)
        ends = F.array(F.when((first % 2 != 0), first), F.when(end % 2 != 0, end - 1))
        return F.transform(F.when(first < end, F.array_compact(ends)).otherwise(F.array().cast("array<bigint>")), lambda at: F.struct(side.alias("side"), at.alias("at")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(61)), of))


def range_blocks(ranges: DataFrame) -> DataFrame:
    """The distinct blocks (z, w, h, bx, by) of ``ranges``: tiles with x >> w = bx and y >> h = by.

    A range of n by m tiles has at most about 4 log2(n) log2(m) of them; one without an end, or whose end lies before its start, has none.
    """
    long = {c: F.col(c).cast("long") for c in ("start_x", "end_x", "start_y", "end_y")}
    whole = ranges.select(F.col("z").cast("int").alias("z"), *[v.alias(c) for c, v in long.items()]).where("z is not null and start_x <= end_x and start_y <= end_y").distinct()
    wide = whole.select("z", "start_y", "end_y", F.explode(_blocks(F.col("start_x"), F.col("end_x"))).alias("_x")).distinct()
    tall = wide.select("z", "_x", F.explode(_blocks(F.col("start_y"), F.col("end_y"))).alias("_y"))
    return tall.select("z", F.col("_x.side").alias("w"), F.col("_y.side").alias("h"), F.col("_x.at").alias("bx"), F.col("_y.at").alias("by")).distinct()


def available(tiles: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``tiles`` (z, x, y, ...) that lie in a range of their level; a level without ranges has none.

    Each different tile is looked up once, in the block of each size that the ranges of its level have.
    """
    blocks = range_blocks(ranges)
    sizes = blocks.groupBy("z").agg(F.collect_set(F.struct("w", "h")).alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("z", "s")))).scalar()
    asked = tiles.select("z", "x", "y").distinct().withColumn("_s", F.explode(F.try_element_at(sizes, F.col("z").cast("int"))))
    at = lambda c, side: F.call_function("shiftright", F.col(c).cast("long"), F.col(f"_s.{side}"))
    asked = asked.select("z", "x", "y", F.col("z").cast("int").alias("_z"), F.col("_s.w").alias("w"), F.col("_s.h").alias("h"), at("x", "w").alias("bx"), at("y", "h").alias("by"))
    held = asked.join(blocks.withColumnRenamed("z", "_z"), ["_z", "w", "h", "bx", "by"], "left_semi").select("z", "x", "y").distinct()
    return tiles.join(held, ["z", "x", "y"], "left_semi").select(*tiles.columns)


def nearest_available(tiles: DataFrame, ranges: DataFrame, least: int = 0) -> DataFrame:
    """Each tile with its nearest available ancestor or itself: ``rz``, ``rx``, ``ry``, null if there is none."""
    keys = tiles.select("z", "x", "y").distinct()
    up = ancestors(keys, least, proper=False)
    wanted = up.select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    there = available(wanted, ranges).select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    best = up.join(there, ["az", "ax", "ay"]).groupBy("z", "x", "y").agg(F.max(F.struct("az", "ax", "ay")).alias("_b"))
    best = best.select("z", "x", "y", F.col("_b.az").alias("rz"), F.col("_b.ax").alias("rx"), F.col("_b.ay").alias("ry"))
    return tiles.join(best, ["z", "x", "y"], "left")


def nearest_ancestor(tiles: DataFrame, held: DataFrame, value: str, levels: int = 24, proper: bool = False) -> DataFrame:
    """Each tile with ``value`` of its nearest ancestor among ``held`` (or of itself), null if there is none."""
    keys = tiles.select("z", "x", "y").distinct()
    up = ancestors(keys, F.greatest(F.col("z") - levels, F.lit(0)), proper=proper)
    h = held.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col(value).alias("_v"))
    best = up.join(h, ["az", "ax", "ay"]).groupBy("z", "x", "y").agg(F.max_by("_v", "az").alias(value), F.max("az").alias("from_z"))
    return tiles.join(best, ["z", "x", "y"], "left")


def related(tiles: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of ``tiles`` that are ancestors or descendants of one of ``others``: two equi-joins on exploded ancestors."""
    mine, theirs = tiles.select("z", "x", "y").distinct(), others.select("z", "x", "y").distinct()
    above = ancestors(theirs).select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    below = ancestors(mine).join(theirs.toDF("az", "ax", "ay"), ["az", "ax", "ay"], "left_semi").select("z", "x", "y")
    return tiles.join(mine.join(above, ["z", "x", "y"], "left_semi").union(below).distinct(), ["z", "x", "y"], "left_semi")


def in_view(west: Column, south: Column, east: Column, north: Column, vw: Column, vs: Column, ve: Column, vn: Column) -> Column:
    """Inclusive overlap of two boxes."""
    return (east >= vw) & (west <= ve) & (north >= vs) & (south <= vn)


Box = tuple[Column, Column, Column, Column]


def served(tiles: DataFrame, ranges: DataFrame | None, bounds: tuple[float, float, float, float] | None = None, origin: str = "south") -> DataFrame:
    """The geographic tiles (z, x, y, ...) that a terrain server has: in a range of their level, and meeting its valid bounds.

    Without ranges (no metadata) every tile counts as there; a level without ranges has none.  Without ``bounds`` (west, south, east, north) all meet them.
    """
    there = tiles if ranges is None else available(tiles, ranges)
    if bounds is None:
        return there
    return there.where(in_view(*T.geo_bounds(F.col("x"), F.col("y"), F.col("z"), origin), *[F.lit(float(b)) for b in bounds]))


def in_known_view(box: Box, view: Box) -> Column:
    """``in_view``, true where the view is unknown (any side null)."""
    unknown = view[0].isNull() | view[1].isNull() | view[2].isNull() | view[3].isNull()
    return unknown | in_view(*box, *view)


def box_overlap(box: Box, view: Box) -> Column:
    """The common part (west, south, east, north) of two boxes as a struct, null if there is none or a side is unknown; touching boxes have one."""
    west, south = F.greatest(box[0], view[0]), F.greatest(box[1], view[1])
    east, north = F.least(box[2], view[2]), F.least(box[3], view[3])
    known = box[0] + box[1] + box[2] + box[3] + view[0] + view[1] + view[2] + view[3]
    return F.when(known.isNotNull() & (west <= east) & (south <= north), F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north")))


def box_covers(coverage: Box, required: Box, slack: float = 1e-9) -> Column:
    """Whether a coverage contains what is required, but for ``slack``: true if nothing is required (null), else false without a coverage."""
    contains = (coverage[0] <= required[0] + slack) & (coverage[1] <= required[1] + slack) & (coverage[2] >= required[2] - slack) & (coverage[3] >= required[3] - slack)
    return required[0].isNull() | F.coalesce(contains, F.lit(False))


def finest_cover(points: DataFrame, tiles: DataFrame, least: int, most: int) -> DataFrame:
    """Each point (id, lng, lat) with the zoom of the finest XYZ tile among ``tiles`` that has it, or null."""
    z = F.explode(F.sequence(F.lit(least), F.lit(most)))
    at = points.select("id", "lng", "lat", z.alias("z"))
    at = at.select("id", "z", T.tile_x(F.col("lng"), F.col("z")).alias("x"), T.tile_y(F.col("lat"), F.col("z")).alias("y"))
    found = at.join(tiles.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_semi").groupBy("id").agg(F.max("z").alias("finest"))
    return points.join(found, "id", "left")


def renderable(ready: Column, visible: Column, opacity: Column) -> Column:
    """Whether a tile is drawn: ready, visible and not almost transparent."""
    return ready & visible & (opacity > 0.001)
