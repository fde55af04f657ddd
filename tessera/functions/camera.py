"""Cameras in the local frame (X east, Y north, Z up): placement, projection, frustum and subdivision tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def distance(a: Vector, b: Vector) -> Column:
    d = tuple(p - q for p, q in zip(a, b, strict=True))
    return F.sqrt(dot(d, d))


def nearest_of(center: Vector, target: Vector, camera: Vector) -> Column:
    """Distance of a tile's centre to the target or the camera, whichever is nearer."""
    return F.least(distance(center, target), distance(center, camera))


def placed_offset(height: Column, pitch_deg: Column, heading_deg: Column) -> Vector:
    """Where a camera ``height`` above its target stands to look down ``pitch_deg`` (1 to 90) and towards ``heading_deg``."""
    flat = height / F.tan(F.radians(F.greatest(F.least(pitch_deg, F.lit(90.0)), F.lit(1.0))))
    return -F.sin(F.radians(heading_deg)) * flat, -F.cos(F.radians(heading_deg)) * flat, height


def zoomed_offset(camera: Vector, target: Vector, wanted: Column, least: float, most: float) -> Vector:
    """The camera's offset from its target, in the same direction, at the ``wanted`` distance within the limits (null: as it is)."""
    d = tuple(p - q for p, q in zip(camera, target, strict=True))
    size = F.sqrt(dot(d, d))
    scale = F.greatest(F.least(F.coalesce(wanted, size), F.lit(most)), F.lit(least)) / size
    return d[0] * scale, d[1] * scale, d[2] * scale


def with_basis(df: DataFrame, eye: str = "eye", target: str = "target") -> DataFrame:
    """Adds ``ahead``, ``right`` and ``up`` (structs x, y, z) of a camera from struct columns ``eye`` and ``target``."""
    v = lambda c: (F.col(f"{c}.x"), F.col(f"{c}.y"), F.col(f"{c}.z"))
    s = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    size = distance(v(target), v(eye))
    df = df.withColumn("ahead", s(*((p - q) / size for p, q in zip(v(target), v(eye), strict=True))))
    flat = F.sqrt(F.col("ahead.x") * F.col("ahead.x") + F.col("ahead.y") * F.col("ahead.y"))
    # Looking straight down, north is up on the screen.
    level = flat > 0
    df = df.withColumn("right", s(F.when(level, F.col("ahead.y") / flat).otherwise(1.0), F.when(level, -F.col("ahead.x") / flat).otherwise(0.0), F.lit(0.0)))
    a, r = v("ahead"), v("right")
    return df.withColumn("up", s(r[1] * a[2] - r[2] * a[1], r[2] * a[0] - r[0] * a[2], r[0] * a[1] - r[1] * a[0]))


def project(point: Column, fov_deg: float, aspect: float, near: float, far: float) -> Column:
    """Normalised device coordinates (x, y, z) of a struct in the view of the columns of ``with_basis``; z is in -1 to 1 between near and far."""
    d = tuple(point[c] - F.col("eye")[c] for c in "xyz")
    along = lambda c: dot(d, (F.col(c)["x"], F.col(c)["y"], F.col(c)["z"]))
    t = math.tan(math.radians(fov_deg) / 2)
    depth = along("ahead")
    return F.struct((along("right") / (depth * (t * aspect))).alias("x"), (along("up") / (depth * t)).alias("y"), ((far + near) / (far - near) - 2 * far * near / (far - near) / depth).alias("z"))


def screen_size(df: DataFrame, probes: str, fov_deg: float, aspect: float, near: float, far: float, width: float, height: float) -> DataFrame:
    """Adds ``pixel_size``, ``visible_size``, ``visible_min`` and ``reliable`` of the points in ``probes``.

    Points outside near and far do not count.  ``pixel_size`` is the larger side of their
    box on the screen, unclipped; the visible sizes are the larger and smaller side of the box
    clipped to the screen; ``reliable`` says whether all points count.  Without any point the sizes are 0.
    """
    df = df.withColumn("_all", F.transform(probes, lambda p: project(p, fov_deg, aspect, near, far)))
    df = df.withColumn("_in", F.filter("_all", lambda p: (p["z"] >= -1) & (p["z"] <= 1)))
    clipped = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0))

    def side(axis: str, pixels: float, how=lambda v: v) -> Column:
        values = F.transform("_in", lambda p: how(p[axis]))
        return F.coalesce((F.array_max(values) - F.array_min(values)) * (pixels / 2), F.lit(0.0))

    df = df.withColumns({"pixel_size": F.greatest(side("x", width), side("y", height)), "_w": side("x", width, clipped), "_h": side("y", height, clipped)})
    made = {"visible_size": F.greatest("_w", "_h"), "visible_min": F.least("_w", "_h"), "reliable": F.size("_in") == F.size("_all")}
    return df.withColumns(made).drop("_all", "_in", "_w", "_h")


def frustum_planes(fov_deg: float, aspect: float, near: float, far: float) -> Column:
    """The six inward planes (x, y, z, d) of the view of the columns of ``with_basis``."""
    t = math.tan(math.radians(fov_deg) / 2)

    def plane(ahead: float, side: str | None, sign: float, shift: float) -> Column:
        n = [F.col("ahead")[c] * ahead + (F.col(side)[c] * sign if side else 0) for c in "xyz"]
        return F.struct(*[v.alias(c) for v, c in zip(n, "xyz", strict=True)], (-dot(tuple(n), (F.col("eye")["x"], F.col("eye")["y"], F.col("eye")["z"])) + shift).alias("d"))

    return F.array(plane(t * aspect, "right", -1, 0.0), plane(t * aspect, "right", 1, 0.0), plane(t, "up", -1, 0.0), plane(t, "up", 1, 0.0), plane(1, None, 0, -near), plane(-1, None, 0, far))


def box_in_frustum(planes: Column, low: Vector, high: Vector) -> Column:
    """Whether an axis-parallel box is not wholly outside one of the planes (its farthest corner along the normal decides)."""

    def inside(p: Column) -> Column:
        reach = sum(p[c] * F.when(p[c] > 0, hi).otherwise(lo) for c, lo, hi in zip("xyz", low, high, strict=True))
        return reach + p["d"] >= 0

    return F.forall(planes, inside)


def shall_subdivide(error: Column, limit: float, pixels: Column, visible_min: Column, reliable: Column, tile_pixels: float, can: Column) -> Column:
    """Whether a terrain tile is divided: too coarse by error or by size, not a sliver on the screen, and able to be."""
    guard = ~reliable | (visible_min > tile_pixels)
    return can & guard & ((error > limit) | (pixels > tile_pixels * 2))


def near_view(box: tuple[Column, Column, Column, Column], view: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a box (west, south, east, north) meets the view expanded by its own size on each side."""
    west, south, east, north = box
    w, s, e, n = view
    return ~((east < w - (e - w)) | (west > e + (e - w)) | (north < s - (n - s)) | (south > n + (n - s)))


def ray_through(x: Column, y: Column, width: float, height: float, fov_deg: float) -> Vector:
    """The direction, not of unit length, of the ray through a pixel of the view of the columns of ``with_basis``; pixels count from the upper left."""
    t = math.tan(math.radians(fov_deg) / 2)
    across = (x / width * 2 - 1) * (t * width / height)
    upward = (1 - y / height * 2) * t
    return tuple(F.col("ahead")[c] + F.col("right")[c] * across + F.col("up")[c] * upward for c in "xyz")


def ground_under(x: Column, y: Column, width: float, height: float, fov_deg: float, level: float = 0.0) -> Column:
    """Where the ray through a pixel meets the horizontal plane at ``level``: a struct (x, y, z), null if it does not.

    An eye below the plane sees it from below.  Null pixels or cameras give null.
    """
    d = ray_through(x, y, width, height, fov_deg)
    eye = tuple(F.col("eye")[c] for c in "xyz")
    reach = (F.lit(level) - eye[2]) / F.when(d[2] != 0, d[2])
    return F.when(reach >= 0, F.struct(*[(eye[k] + d[k] * reach).alias(c) for k, c in enumerate("xyz")]))


def pixel_of(point: Column, width: float, height: float, fov_deg: float, near: float, far: float) -> Column:
    """The pixel (x, y) of a struct (x, y, z), inside or outside the screen, null if it is not before the eye."""
    seen = project(point, fov_deg, width / height, near, far)
    d = tuple(point[c] - F.col("eye")[c] for c in "xyz")
    ahead = dot(d, tuple(F.col("ahead")[c] for c in "xyz")) > 0
    return F.when(ahead, F.struct(((seen["x"] + 1) / 2 * width).alias("x"), ((1 - seen["y"]) / 2 * height).alias("y")))
