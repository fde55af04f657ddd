"""Terrain: best-first selection of tiles for views, sampling of meshes at points, upsampling and skirts.

All of it is joins, explodes and windows over tables of views, vertices and triangles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import camera as C
from tessera.functions import lod as L
from tessera.functions import projection as P
from tessera.functions import tiling as T
from tessera.operators.hierarchy import nearest_available
from tessera.operators.pyramid import children
from tessera.operators.selection import geo_range
from tessera.plans.joins import shuffled
from tessera.plans.staging import Staging

BOUNDS = ("tile_west", "tile_south", "tile_east", "tile_north")


def with_bounds(tiles: DataFrame, origin: str) -> DataFrame:
    """Adds the geographic bounds of (z, x, y) as ``tile_west``, ``tile_south``, ``tile_east`` and ``tile_north``."""
    return tiles.withColumns(dict(zip(BOUNDS, T.geo_bounds(F.col("x"), F.col("y"), F.col("z"), origin), strict=True)))


def in_reach() -> Column:
    """Whether a tile meets the view's box expanded by its own size on each side."""
    return C.near_view(tuple(map(F.col, BOUNDS)), tuple(map(F.col, ("west", "south", "east", "north"))))


def too_coarse(distance: Column, viewport: float, fov_deg: float, limit: float) -> Column:
    """Whether a tile's screen-space error exceeds ``limit`` pixels at its distance, which counts as a metre at least."""
    return L.terrain_error(F.col("z").cast("double"), F.greatest(distance, F.lit(1.0)), F.lit(viewport), F.lit(fov_deg)) > limit


def camera_figures(nodes: DataFrame, origin_lng: float, origin_lat: float, fov_deg: float, width: float, height: float, near: float, far: float, top: float = 0.0) -> DataFrame:
    """Tiles with what a view's camera (structs ``eye`` and ``target`` in metres of the map's plane) says of each.

    Adds ``seen``, whether the tile's box from the ground to ``top`` meets the frustum, and ``pixel_size``, ``visible_min`` and
    ``reliable`` of its middle and corners on the ground; with them ``divided`` is the rule by which viewers subdivide.
    """
    west, south, east, north = map(F.col, BOUNDS)
    x0, y0 = P.local_xy(west, south, origin_lng, origin_lat)
    x1, y1 = P.local_xy(east, north, origin_lng, origin_lat)
    told = C.with_basis(nodes.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1}))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    a, b, c, d = map(F.col, ("_x0", "_y0", "_x1", "_y1"))
    told = told.withColumn("_probes", F.array(at((a + c) / 2, (b + d) / 2), at(a, d), at(c, d), at(c, b), at(a, b)))
    told = C.screen_size(told, "_probes", fov_deg, width / height, near, far, width, height).withColumn("_planes", C.frustum_planes(fov_deg, width / height, near, far))
    seen = C.box_in_frustum(F.col("_planes"), (a, b, F.lit(0.0)), (c, d, F.lit(float(top))))
    return told.withColumn("seen", seen).select(*nodes.columns, "seen", "pixel_size", "visible_min", "reliable")


def divided(distance: Column, viewport: float, fov_deg: float, limit: float = 2.0, tile_pixels: float = 256.0) -> Column:
    """Whether viewers subdivide a tile with ``camera_figures``: too coarse or too large, and no sliver on the screen."""
    error = L.terrain_error(F.col("z").cast("double"), F.greatest(distance, F.lit(1.0)), F.lit(viewport), F.lit(fov_deg))
    return C.shall_subdivide(error, limit, F.col("pixel_size"), F.col("visible_min"), F.col("reliable"), tile_pixels, F.lit(True))


def best_first(parent: Column | None, mine: Column) -> Column:
    """The place of a node in a best-first search of a tree, as an array to sort by.

    A search that always takes the nearest open node takes a node only after all that
    precede it on its own path, so first by the farthest node of its path, then by the farthest after
    that, and so on: the array holds each node of the path that is farther than all below it.
    """
    return F.array(mine) if parent is None else F.array_append(F.filter(parent, lambda e: e > mine), mine)


def terrain_selection(views: DataFrame, ranges: DataFrame | None, distance: Column, keep: Column, divide: Column, min_zoom: int, max_zoom: int, most_tiles: int, virtual: bool = True, origin: str = "south", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The terrain tiles that each view shows, with a budget for the tiles shown and the nodes looked at.

    ``views`` has (view, west, south, east, north) and any columns that the expressions use.
    ``distance``, ``keep`` and ``divide`` are columns over a view, (z, x, y) and the tile's bounds
    (``tile_west`` ...), ``keep`` and ``divide`` also over ``d``, the distance, and what ``prepare`` adds to the nodes (``camera_figures``).  From the tiles of ``min_zoom`` in the box, the nearest open node is taken (ties: the
    smaller z, x, y); one not to ``keep`` ends there; one to ``divide`` opens its children if it is
    above ``max_zoom`` and available, or ``virtual``; any other is a leaf.  An unavailable leaf is shown
    as itself if ``virtual``; other leaves as their nearest available ancestor or not at all.
    It ends when ``most_tiles`` are shown or ``max(8 * most_tiles, 1024)`` nodes were taken.  Without ``ranges`` all is available.

    Every round expands one level of all views at once.  Nodes before which the
    budget is spent already are never taken, whatever is found later, so they are dropped, and a view holds
    no more than five times its budget.  Columns: view, z, x, y, ``virtual``, ``place`` from 1 in the order shown, ``priority`` (the
    distance of the tile shown).  A null box gives no rows, nor do views without any.
    """
    staging = Staging(views.sparkSession, "terrain")
    budget = max(8 * most_tiles, 1024)
    own = [c for c in views.columns if c not in ("z", "x", "y")]
    mine = F.struct(F.col("d"), F.col("z"), F.col("x"), F.col("y"))
    boxed = views.select(*own).where("west is not null and south is not null and east is not null and north is not null").withColumn("z", F.lit(min_zoom))
    x0, x1, y0, y1 = geo_range(*map(F.col, ("west", "south", "east", "north")), F.col("z"), origin)
    roots = boxed.withColumns({"_x": F.sequence(x0, x1), "_y": F.sequence(y0, y1)}).withColumn("x", F.explode("_x")).withColumn("y", F.explode("_y")).drop("_x", "_y")
    frontier = with_bounds(roots, origin).withColumn("d", distance).withColumn("order", best_first(None, mine))
    known, level = None, min_zoom
    by_view = Window.partitionBy("view").orderBy("order")
    while True:
        frontier = staging.keep(frontier, f"frontier-{level}")
        if not frontier.limit(1).count():
            break
        if ranges is None:
            found = frontier.withColumns({"rz": F.col("z"), "rx": F.col("x"), "ry": F.col("y")})
        else:
            found = nearest_available(frontier, ranges, min_zoom)
        there = F.coalesce(F.col("rz") == F.col("z"), F.lit(False))
        unreal = F.lit(virtual and ranges is not None) & ~there
        can = (F.col("z") < max_zoom) & (there | unreal)
        found = prepare(found) if prepare else found
        judged = found.withColumn("kept", F.coalesce(keep, F.lit(False))).withColumn("open", F.col("kept") & can & F.coalesce(divide, F.lit(False)))
        leaf = F.col("kept") & ~F.col("open")
        shown = F.when(leaf & unreal, F.struct("z", "x", "y")).when(leaf & F.col("rz").isNotNull(), F.struct(F.col("rz").alias("z"), F.col("rx").alias("x"), F.col("ry").alias("y")))
        judged = judged.select(*own, "z", "x", "y", "order", "open", shown.alias("shown"), (leaf & unreal).alias("virtual"))
        every = judged if known is None else known.unionByName(judged)
        first = F.col("shown").isNotNull() & (F.row_number().over(Window.partitionBy("view", "shown").orderBy("order")) == 1)
        counted = every.withColumn("first", first).withColumn("taken", F.row_number().over(by_view))
        before = F.coalesce(F.sum(F.col("first").cast("long")).over(by_view.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("before", before).where((F.col("taken") <= budget) & (F.col("before") < most_tiles))
        known = staging.keep(counted, f"known-{level}")
        opened = known.where(F.col("open") & (F.col("z") == level)).drop("open", "shown", "virtual", "first", "taken", "before").withColumnRenamed("order", "_parent")
        below = children(opened)
        frontier = with_bounds(below, origin).withColumn("d", distance).withColumn("order", best_first(F.col("_parent"), mine)).drop("_parent")
        result, known = known, known.drop("first", "taken", "before")
        level += 1
    if known is None:
        return with_bounds(boxed.withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")}), origin).where("false").select("view", "z", "x", "y", F.lit(False).alias("virtual"), F.lit(0).cast("long").alias("place"), distance.alias("priority"))
    picked = result.where("first").select(*own, F.col("shown.z").alias("z"), F.col("shown.x").alias("x"), F.col("shown.y").alias("y"), "virtual", (F.col("before") + 1).alias("place"))
    return with_bounds(picked, origin).select("view", "z", "x", "y", "virtual", "place", distance.alias("priority"))


# ---- meshes as tables: vertices (mesh, id, x, y, z, ...), triangles (mesh, t, a, b, c) by vertex ids


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(mesh, t, ax, ay, az, bx, ..., cz): the triangles with the places of their corners, by one join and one grouping."""
    each = triangles.select("mesh", "t", F.explode(F.array(*[F.struct(F.lit(k).alias("corner"), F.col(k).alias("id")) for k in "abc"])).alias("_c")).select("mesh", "t", "_c.*")
    met = each.join(shuffled(vertices.select("mesh", "id", "x", "y", "z")), ["mesh", "id"])
    return met.groupBy("mesh", "t").agg(*[F.max(F.when(F.col("corner") == k, F.col(v))).alias(k + v) for k in "abc" for v in "xyz"])


def _grid(triangles: DataFrame, most_bins: int) -> DataFrame:
    """(mesh, min_x, max_x, min_y, max_y, bins, wide, tall): a mesh's bounds and its grid of about four triangles a bin."""
    lo = {v: F.least(*[F.col(k + v) for k in "abc"]) for v in "xy"}
    hi = {v: F.greatest(*[F.col(k + v) for k in "abc"]) for v in "xy"}
    whole = triangles.groupBy("mesh").agg(F.count("*").alias("_n"), *[F.min(lo[v]).alias(f"min_{v}") for v in "xy"], *[F.max(hi[v]).alias(f"max_{v}") for v in "xy"])
    bins = F.greatest(F.lit(1), F.least(F.lit(most_bins), F.ceil(F.sqrt(F.col("_n") / 4)).cast("int")))
    side = lambda v: F.greatest(F.col(f"max_{v}") - F.col(f"min_{v}"), F.lit(1e-6)) / F.col("bins")
    return whole.withColumn("bins", bins).withColumns({"wide": side("x"), "tall": side("y")}).drop("_n")


def _bin(value: Column, axis: str) -> Column:
    at = F.floor((value - F.col(f"min_{axis}")) / F.col({"x": "wide", "y": "tall"}[axis])).cast("int")
    return F.greatest(F.lit(0), F.least(at, F.col("bins") - 1))


def points_in_triangles(points: DataFrame, triangles: DataFrame, tolerance: float = 1e-7, rings: int = 2, most_bins: int = 64) -> DataFrame:
    """``points`` (mesh, id, x, y, ...) with the triangle of their mesh that holds each: ``t``, its weights ``wa``, ``wb``, ``wc`` and ``z``.

    ``triangles`` is as ``corners`` gives it.  A mesh's triangles are dealt to the bins of a grid that
    they touch, and a point meets those of its own bin; only points that none of these holds
    look into the bins around, up to ``rings`` away.  A point outside the mesh's bounds is moved to them.
    Of several triangles that of the nearest bin counts, there the first bin by row and column and the smallest ``t``.
    Weights are at least ``-tolerance``; triangles without area hold nothing.  A point that
    none holds, or of an unknown mesh, has nulls.  A null place is held by nothing; ids are unique in a mesh.
    """
    grid = _grid(triangles, most_bins)
    span = lambda v, how: how(*[F.col(k + v) for k in "abc"])
    dealt = triangles.join(shuffled(grid), "mesh").withColumn("_bx", F.explode(F.sequence(_bin(span("x", F.least), "x"), _bin(span("x", F.greatest), "x"))))
    dealt = dealt.withColumn("_by", F.explode(F.sequence(_bin(span("y", F.least), "y"), _bin(span("y", F.greatest), "y")))).select(*triangles.columns, "_bx", "_by")
    placed = points.select("mesh", "id", F.col("x").alias("_px"), F.col("y").alias("_py")).join(shuffled(grid), "mesh")
    inside = lambda v: F.greatest(F.least(F.col(f"_p{v}"), F.col(f"max_{v}")), F.col(f"min_{v}"))
    placed = placed.where("_px is not null and _py is not null").withColumns({"_px": inside("x"), "_py": inside("y")})
    placed = placed.select("mesh", "id", "_px", "_py", _bin(F.col("_px"), "x").alias("_cx"), _bin(F.col("_py"), "y").alias("_cy"))
    abx, aby, acx, acy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    px, py = F.col("_px") - F.col("ax"), F.col("_py") - F.col("ay")
    det = abx * acy - aby * acx
    wb, wc = (px * acy - py * acx) / det, (abx * py - aby * px) / det

    def held(asked: DataFrame) -> DataFrame:
        met = asked.join(shuffled(dealt), ["mesh", "_bx", "_by"]).where(F.abs(det) >= 1e-9).withColumns({"wb": wb, "wc": wc}).withColumn("wa", 1 - F.col("wb") - F.col("wc"))
        met = met.where(F.least("wa", "wb", "wc") >= -tolerance)
        rank = F.struct(F.greatest(F.abs(F.col("_bx") - F.col("_cx")), F.abs(F.col("_by") - F.col("_cy"))).alias("ring"), "_by", "_bx", "t")
        height = F.col("wa") * F.col("az") + F.col("wb") * F.col("bz") + F.col("wc") * F.col("cz")
        best = met.groupBy("mesh", "id").agg(F.min_by(F.struct("t", "wa", "wb", "wc", height.alias("z")), rank).alias("_hit"))
        return best.select("mesh", "id", "_hit.*")

    own = held(placed.withColumns({"_bx": F.col("_cx"), "_by": F.col("_cy")}))
    if rings:
        lost = placed.join(shuffled(own), ["mesh", "id"], "left_anti")
        near = lambda c: F.explode(F.sequence(F.col(c) - rings, F.col(c) + rings))
        around = lost.withColumn("_bx", near("_cx")).withColumn("_by", near("_cy")).where("_bx <> _cx or _by <> _cy")
        own = own.union(held(around))
    return points.drop("z").join(shuffled(own), ["mesh", "id"], "left")


def upsampled(tiles: DataFrame, triangles: DataFrame, segments: int = 16) -> DataFrame:
    """A grid of ``segments + 1`` by ``segments + 1`` vertices over each tile (mesh, west, south, east, north, ...), its heights from a coarser mesh.

    ``triangles`` is as ``corners`` gives it, in metres of the Mercator plane; ``segments`` is held within 2 to 64.
    Rows run from the south and from the west.  A vertex that no triangle holds takes the height before
    it in this order, at first 0.  Columns: those of ``tiles``; ``gx``, ``gy``, ``id``; ``x``, ``y``, ``z``; ``u``, ``v`` in 0 to 1, v by Mercator.
    """
    n = min(max(int(segments), 2), 64)
    steps = F.sequence(F.lit(0), F.lit(n))
    grid = tiles.withColumn("gy", F.explode(steps)).withColumn("gx", F.explode(steps)).withColumn("id", F.col("gy") * (n + 1) + F.col("gx"))
    lat = F.col("south") + F.col("gy") / n * (F.col("north") - F.col("south"))
    lng = F.col("west") + F.col("gx") / n * (F.col("east") - F.col("west"))
    south, north = P.mercator_y(F.col("south")), P.mercator_y(F.col("north"))
    grid = grid.withColumns({"x": P.mercator_x(lng), "y": P.mercator_y(lat), "u": F.col("gx") / n})
    grid = grid.withColumn("v", P.clamp((F.col("y") - south) / F.greatest(north - south, F.lit(1e-9)), 0.0, 1.0))
    found = points_in_triangles(grid, triangles).drop("t", "wa", "wb", "wc")
    so_far = Window.partitionBy("mesh").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("z", F.coalesce(F.last("z", ignorenulls=True).over(so_far), F.lit(0.0)))


def grid_triangles(meshes: DataFrame, segments: int = 16) -> DataFrame:
    """(mesh, t, a, b, c) of the grids that ``upsampled`` makes: two triangles a cell, row by row."""
    n = min(max(int(segments), 2), 64)
    cell = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))
    a = (F.floor(F.col("_k") / n) * (n + 1) + F.col("_k") % n).cast("int")
    both = F.array(F.struct(F.lit(0).alias("h"), F.col("_a").alias("a"), (F.col("_a") + 1).alias("b"), (F.col("_a") + n + 2).alias("c")), F.struct(F.lit(1).alias("h"), F.col("_a").alias("a"), (F.col("_a") + n + 2).alias("b"), (F.col("_a") + n + 1).alias("c")))
    cells = meshes.select("mesh").withColumn("_k", cell).withColumn("_a", a).withColumn("_t", F.explode(both))
    return cells.select("mesh", (F.col("_k") * 2 + F.col("_t.h")).alias("t"), "_t.a", "_t.b", "_t.c")


def skirt_depth(height_range: Column, zoom: Column) -> Column:
    """2 to 40 metres by the height range, less at coarse levels."""
    return P.clamp(height_range * 0.02, 2.0, 40.0) * P.clamp((zoom - 2) / 10, 0.25, 1.0)


def border_ring(vertices: DataFrame, margin: float = 0.001) -> DataFrame:
    """(mesh, id, x, y, z, u, v, place, next, ring): the border's vertices as a closed ring, from the south-west corner along the south.

    Sides in order south, east, north, west; a vertex belongs to the first side it lies on.  ``place`` counts from 0, ``next`` is the
    id of the vertex that follows (of the last: the first), ``ring`` the number of vertices.
    """
    u, v = F.col("u"), F.col("v")
    side = F.when(v < margin, 0).when(u > 1 - margin, 1).when(v > 1 - margin, 2).when(u < margin, 3)
    along = F.when(F.col("side") == 0, u).when(F.col("side") == 1, v).when(F.col("side") == 2, -u).otherwise(-v)
    edge = vertices.select("mesh", "id", "x", "y", "z", "u", "v", side.alias("side")).where("side is not null").withColumn("along", along)
    order = Window.partitionBy("mesh").orderBy("side", "along", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = edge.withColumns({"place": F.row_number().over(order) - 1, "next": F.coalesce(F.lead("id").over(order), F.first("id").over(whole)), "ring": F.count("*").over(whole)})
    return ring.drop("side", "along")


def with_skirts(vertices: DataFrame, triangles: DataFrame, zooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices (mesh, id, x, y, z, u, v) and triangles (mesh, t, a, b, c) with a wall below each mesh's border.

    ``zooms`` has (mesh, zoom).  Ids and ``t`` run from 0 in each mesh and go on: each vertex of the border
    has one below it, each edge of the ring two triangles.  A mesh with fewer than
    four border vertices, or without a zoom, stays as it is.
    """
    sizes = vertices.groupBy("mesh").agg(F.count("*").cast("int").alias("_n"), (F.max("z") - F.min("z")).alias("_range"))
    deep = sizes.join(shuffled(zooms.select("mesh", "zoom")), "mesh").select("mesh", "_n", skirt_depth(F.col("_range"), F.col("zoom")).alias("_depth"))
    ring = border_ring(vertices).where("ring >= 4").join(shuffled(deep), "mesh")
    low = ring.select("mesh", (F.col("_n") + F.col("place")).cast("int").alias("id"), "x", "y", (F.col("z") - F.col("_depth")).alias("z"), "u", "v")
    below = F.col("_n") + F.col("place")
    after = F.col("_n") + (F.col("place") + 1) % F.col("ring")
    count = triangles.groupBy("mesh").agg(F.count("*").cast("int").alias("_m"))
    both = F.array(F.struct(F.lit(0).alias("h"), F.col("id").alias("a"), below.alias("b"), F.col("next").alias("c")), F.struct(F.lit(1).alias("h"), F.col("next").alias("a"), below.alias("b"), after.alias("c")))
    wall = ring.join(shuffled(count), "mesh", "left").withColumn("_t", F.explode(both))
    at = F.coalesce("_m", F.lit(0)) + F.col("place") * 2 + F.col("_t.h")
    wall = wall.select("mesh", at.cast("int").alias("t"), *[F.col(f"_t.{k}").cast("int").alias(k) for k in "abc"])
    return vertices.select("mesh", "id", "x", "y", "z", "u", "v").union(low), triangles.select("mesh", "t", "a", "b", "c").union(wall)
