"""Mesh generation: triangulation, footprint extrusion, binary glTF.

Each works on one polygon at a time with numpy; Spark spreads polygons and cells.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import Staging

#: Twice the area of a triangle that counts as none.
FLAT = 1e-14


def _area2(r: np.ndarray) -> float:
    x, y = r[:, 0], r[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def triangulate(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Points and triangles of a polygon with holes, whose areas add up to the polygon's.

    Ears are cut after holes are joined to the outer ring by bridges; where that
    does not give the whole area (bridges along aligned holes), the polygon is cut into
    trapezoids.  A polygon that neither covers (rings that cross) raises ValueError.
    """
    if len(rings) == 1 and _is_convex(rings[0]):
        pts = rings[0] if _area2(rings[0]) > 0 else rings[0][::-1]
        return pts, np.array([(0, k, k + 1) for k in range(1, len(pts) - 1)]).ravel()
    want = abs(_area2(rings[0])) - sum(abs(_area2(h)) for h in rings[1:])
    for cut in (_ears, _trapezoids):
        pts, tri = cut(rings)
        a, b, c = pts[tri.reshape(-1, 3)].transpose(1, 0, 2)
        have = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum() if len(tri) else 0.0
        if abs(have - want) <= 1e-6 * max(abs(want), 1e-9):
            return pts, tri
    raise ValueError("the rings of a polygon cross")


def _is_convex(ring: np.ndarray) -> bool:
    """Whether a ring turns to one side only, by a full turn in all."""
    a = np.roll(ring, -1, axis=0) - ring
    b = np.roll(a, -1, axis=0)
    turn = np.arctan2(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(1))
    return bool((turn > 1e-9).all() or (turn < -1e-9).all()) and abs(abs(turn.sum()) - 2 * math.pi) < 1e-6


def _trapezoids(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Triangles of the trapezoids between neighbouring x of all vertices; inside is what an odd number of edges lies below."""
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    xs = np.unique(a[:, 0])
    points: list[tuple[float, float]] = []
    out: list[int] = []
    for x0, x1 in zip(xs, xs[1:], strict=False):
        over = (np.minimum(a[:, 0], b[:, 0]) <= x0) & (np.maximum(a[:, 0], b[:, 0]) >= x1)
        p, q = a[over], b[over]
        slope = (q[:, 1] - p[:, 1]) / (q[:, 0] - p[:, 0])
        y0, y1 = p[:, 1] + slope * (x0 - p[:, 0]), p[:, 1] + slope * (x1 - p[:, 0])
        order = np.argsort(y0 + y1, kind="stable")
        for low, high in zip(order[::2], order[1::2], strict=False):
            corners = [(x0, y0[low]), (x1, y1[low]), (x1, y1[high]), (x0, y0[high])]
            for tri in ((0, 1, 2), (0, 2, 3)):
                if _cross(*(corners[k] for k in tri)) > FLAT:
                    out += [len(points) + k for k in range(3)]
                    points += [corners[k] for k in tri]
    return np.array(points).reshape(-1, 2), np.array(out, int)


def _ears(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Triangles by cutting ears, as far as it goes; holes are joined to the outer ring by bridges first."""
    outer = rings[0] if _area2(rings[0]) > 0 else rings[0][::-1]
    points = [tuple(p) for p in outer]
    for hole in sorted((h if _area2(h) < 0 else h[::-1] for h in rings[1:]), key=lambda h: -h[:, 0].max()):
        start = int(hole[:, 0].argmax())
        h = [tuple(p) for p in np.roll(hole, -start, axis=0)]
        best = min((i for i in range(len(points)) if _inside_corner(points, i, h[0]) and _visible(h[0], points[i], points, h)), key=lambda i: math.dist(points[i], h[0]), default=None)
        if best is None:
            continue
        points = points[: best + 1] + h + [h[0]] + points[best:]
    pts = np.array(points)
    live, out = list(range(len(pts))), []
    while len(live) > 3:
        around = [(k, live[k - 1], live[k], live[(k + 1) % len(live)]) for k in range(len(live))]
        # Ears free of vertices; else ears with some on their edges, as bridges cause; else a flat vertex goes.
        ear = next((e for loose in (False, True) for e in around if _is_ear(pts, *e[1:], live, loose)), None)
        if ear:
            out += ear[1:]
        else:
            ear = next((e for e in around if abs(_cross(*pts[list(e[1:])])) <= FLAT), None)
        if ear is None:
            break
        live.pop(ear[0])
    if len(live) == 3 and _cross(*pts[live]) > FLAT:
        out += live
    return pts, np.array(out, int)


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _is_ear(pts: np.ndarray, a: int, b: int, c: int, live: list[int], loose: bool) -> bool:
    if _cross(pts[a], pts[b], pts[c]) <= FLAT:
        return False
    others = pts[[i for i in live if i not in (a, b, c)]]
    if not len(others):
        return True
    same = (others[:, None] == pts[[a, b, c]][None]).all(2).any(1)
    q = others[~same]
    side = lambda p, r: (r[0] - p[0]) * (q[:, 1] - p[1]) - (r[1] - p[1]) * (q[:, 0] - p[0])
    least = np.minimum(np.minimum(side(pts[a], pts[b]), side(pts[b], pts[c])), side(pts[c], pts[a]))
    return not (least > 0 if loose else least >= 0).any()


def _inside_corner(ring: list, i: int, p) -> bool:
    """Whether ``p`` lies between the two edges at a vertex, on the inner side of a ring that runs counter-clockwise."""
    a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
    left = (_cross(a, b, p) >= 0, _cross(b, c, p) >= 0)
    return all(left) if _cross(a, b, c) >= 0 else any(left)


def _visible(p, q, outer: list, hole: list) -> bool:
    """Whether the segment from ``p`` to ``q`` meets no edge but those that end in one of them."""

    def meets(a, b) -> bool:
        if a in (p, q) or b in (p, q) or any(max(a[k], b[k]) < min(p[k], q[k]) or min(a[k], b[k]) > max(p[k], q[k]) for k in (0, 1)):
            return False
        return _cross(p, q, a) * _cross(p, q, b) <= 0 and _cross(a, b, p) * _cross(a, b, q) <= 0

    return not any(meets(r[i - 1], r[i]) for r in (outer, hole) for i in range(len(r)))


def extrude(rings: list[np.ndarray], base: float, height: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, normals and triangles of a building: a flat roof and a wall for each edge."""
    pts, tri = triangulate(rings)
    positions = [np.column_stack((pts, np.full(len(pts), base + height)))]
    normals = [np.tile([0.0, 0.0, 1.0], (len(pts), 1))]
    triangles, n = [tri], len(pts)
    for k, ring in enumerate(rings):
        r = ring if (_area2(ring) > 0) == (k == 0) else ring[::-1]
        a, b = r, np.roll(r, -1, axis=0)
        d = b - a
        length = np.hypot(d[:, 0], d[:, 1])
        a, b, d, length = a[length > 1e-6], b[length > 1e-6], d[length > 1e-6], length[length > 1e-6]
        m = len(a)
        z = lambda h: np.full(m, h)  # noqa: B023, E731
        quad = np.stack((np.column_stack((a, z(base))), np.column_stack((b, z(base))), np.column_stack((b, z(base + height))), np.column_stack((a, z(base + height)))), 1)
        positions.append(quad.reshape(-1, 3))
        normals.append(np.repeat(np.column_stack((d[:, 1] / length, -d[:, 0] / length, z(0.0))), 4, axis=0))
        first = n + 4 * np.arange(m)[:, None]
        triangles.append((first + np.array([0, 1, 2, 0, 2, 3])).ravel())
        n += 4 * m
    return np.concatenate(positions), np.concatenate(normals), np.concatenate(triangles).astype(int)


def write_glb(positions: np.ndarray, normals: np.ndarray, colours: np.ndarray, indices: np.ndarray) -> bytes:
    """A binary glTF file with one mesh, Y up: positions and normals as 32-bit floats, colours as bytes, 16-bit indices up to 65535 vertices."""
    up = lambda v: np.column_stack((v[:, 0], v[:, 2], -v[:, 1])).astype("<f4")
    p, small = up(positions), len(positions) <= 65535
    views, blob = [], b""
    for data, target in ((p, 34962), (up(normals), 34962), (np.asarray(colours, np.uint8), 34962), (indices.astype("<u2" if small else "<u4"), 34963)):
        blob += b"\0" * (-len(blob) % 4)
        views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": data.nbytes, "target": target})
        blob += data.tobytes()
    blob += b"\0" * (-len(blob) % 4)
    n = len(p)
    accessors = [
        {"bufferView": 0, "componentType": 5126, "count": n, "type": "VEC3", "min": p.min(0).tolist(), "max": p.max(0).tolist()},
        {"bufferView": 1, "componentType": 5126, "count": n, "type": "VEC3"},
        {"bufferView": 2, "componentType": 5121, "normalized": True, "count": n, "type": "VEC4"},
        {"bufferView": 3, "componentType": 5123 if small else 5125, "count": len(indices), "type": "SCALAR"},
    ]
    doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "NORMAL": 1, "COLOR_0": 2}, "indices": 3, "mode": 4}]}], "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(blob)}]}
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sII", b"glTF", 2, 12 + 8 + len(text) + 8 + len(blob)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob


def extrude_convex(xy: np.ndarray, base: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``extrude`` for many convex rings of the same number of points at once: (m, n, 2) to (m, 5 n, 3) positions and normals, and the triangles of each."""
    m, n, _ = xy.shape
    a, b = xy, np.roll(xy, -1, axis=1)
    flip = (a[..., 0] * b[..., 1] - b[..., 0] * a[..., 1]).sum(1) < 0
    a = np.where(flip[:, None, None], xy[:, ::-1], xy)
    b = np.roll(a, -1, axis=1)
    d = b - a
    length = np.hypot(d[..., 0], d[..., 1])
    positions, normals = np.empty((m, 5 * n, 3)), np.zeros((m, 5 * n, 3))
    positions[:, :n, :2], positions[:, :n, 2], normals[:, :n, 2] = a, top[:, None], 1.0
    quads = positions[:, n:].reshape(m, n, 4, 3)
    quads[:, :, (0, 3), :2], quads[:, :, (1, 2), :2] = a[:, :, None], b[:, :, None]
    quads[:, :, :2, 2], quads[:, :, 2:, 2] = base[:, None, None], top[:, None, None]
    walls = normals[:, n:].reshape(m, n, 4, 3)
    walls[..., 0], walls[..., 1] = (d[..., 1] / length)[..., None], (-d[..., 0] / length)[..., None]
    roof = np.array([(0, k, k + 1) for k in range(1, n - 1)]).ravel()
    return positions, normals, np.concatenate((roof, (n + 4 * np.arange(n)[:, None] + np.array([0, 1, 2, 0, 2, 3])).ravel()))


def _all_convex(xy: np.ndarray) -> np.ndarray:
    """Which of many rings of the same number of points turn to one side only, once round, along edges that are not tiny."""
    a = np.roll(xy, -1, axis=1) - xy
    b = np.roll(a, -1, axis=1)
    turn = np.arctan2(a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0], (a * b).sum(2))
    one_way = (turn > 1e-9).all(1) | (turn < -1e-9).all(1)
    return one_way & (np.abs(np.abs(turn.sum(1)) - 2 * math.pi) < 1e-6) & (np.hypot(a[..., 0], a[..., 1]) > 1e-6).all(1)


def part_meshes(parts: DataFrame) -> DataFrame:
    """The mesh of each building part (col, row, id, rings, base, height), where the part lies: a narrow pass.

    Columns: col, row, id, vertices, triangles, and positions, normals (64-bit floats) and indices (64-bit) as bytes, shade.
    Convex parts without holes are meshed all at once for each number of corners, others one by one.
    """
    names = ["col", "row", "id", "vertices", "triangles", "positions", "normals", "indices", "shade"]

    def batch_of(keys: list, vertices: np.ndarray, triangles: np.ndarray, data: list, shade: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*keys, pa.array(vertices, pa.int64()), pa.array(triangles, pa.int64()), *data, pa.array(shade, pa.int32())], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            rings = column["rings"]
            first = np.asarray(rings.offsets) - rings.offsets[0].as_py()
            inner = rings.flatten()
            at = np.asarray(inner.offsets) - inner.offsets[0].as_py()
            points = inner.flatten()
            xy = np.column_stack([np.asarray(points.field(c), float) for c in ("x", "y")])
            base, height = np.asarray(column["base"], float), np.asarray(column["height"], float)
            shade = np.clip(height + 90, 90, 220).astype(np.int32)
            alone = np.diff(first) == 1
            corners = np.where(alone, (at[first[:-1] + alone] - at[first[:-1]]), 0)
            slow = np.ones(batch.num_rows, bool)
            keys = lambda rows, column=column: [column[c].take(pa.array(rows)) for c in ("col", "row", "id")]
            for n in np.unique(corners[corners > 2]).tolist():
                rows = np.flatnonzero(corners == n)
                shape = xy[at[first[rows]][:, None] + np.arange(n)]
                fit = _all_convex(shape)
                rows, shape = rows[fit], shape[fit]
                if not len(rows):
                    continue
                slow[rows] = False
                p, normal, tri = extrude_convex(shape, base[rows], base[rows] + height[rows])
                m = len(rows)
                packed = lambda v, m=m: pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer((np.arange(m + 1) * (v.nbytes // m)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))])
                yield batch_of(keys(rows), np.full(m, 5 * n), np.full(m, len(tri) // 3), [packed(p), packed(normal), packed(np.tile(tri.astype(np.int64), (m, 1)))], shade[rows])
            rows = np.flatnonzero(slow)
            if len(rows):
                made = [extrude([xy[at[k] : at[k + 1]] for k in range(first[r], first[r + 1])], base[r], height[r]) for r in rows.tolist()]
                data = [pa.array([m[i].tobytes() for m in made], pa.binary()) for i in range(3)]
                yield batch_of(keys(rows), np.array([len(m[0]) for m in made]), np.array([len(m[2]) // 3 for m in made]), data, shade[rows])

    point = "array<array<struct<x:double,y:double>>>"
    typed = parts.select(*[F.col(c).cast("long").alias(c) for c in ("col", "row", "id")], F.col("rings").cast(point).alias("rings"), F.col("base").cast("double").alias("base"), F.col("height").cast("double").alias("height"))
    return typed.mapInArrow(build, "col long, row long, id long, vertices long, triangles long, positions binary, normals binary, indices binary, shade int")


def cell_meshes(parts: DataFrame, most_vertices: int = 60_000) -> DataFrame:
    """Binary glTFs of the cells of building parts (col, row, id, rings, base, height).

    Parts are meshed where they lie; a cell is cut into pieces of about ``most_vertices`` by a
    hash of the part's id, and the meshes of a piece are merged into one file, so no group grows
    with a cell.  Columns: col, row, piece, parts, vertices, triangles, glb.
    """
    meshes = Staging(parts.sparkSession, "meshes").keep(part_meshes(parts), "parts")
    # One row for each cell of the grid, 64 x 64 at most.
    cells = meshes.groupBy("col", "row").agg(F.ceil(F.sum("vertices") / most_vertices).alias("_pieces"))
    dealt = meshes.join(cells, ["col", "row"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("_pieces"))).drop("_pieces")

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        before = g["vertices"].cumsum() - g["vertices"]
        join = lambda c, kind: [np.frombuffer(x, kind) for x in g[c]]
        p, n = (np.concatenate(join(c, np.float64)).reshape(-1, 3) for c in ("positions", "normals"))
        t = np.concatenate([x + at for x, at in zip(join("indices", np.int64), before, strict=True)])
        c = np.repeat(np.array([[k, k, k, 255] for k in g["shade"]], np.uint8), g["vertices"], axis=0)
        first = g.iloc[0]
        return pd.DataFrame({"col": [first["col"]], "row": [first["row"]], "piece": [first["piece"]], "parts": [len(g)], "vertices": [len(p)], "triangles": [len(t) // 3], "glb": [write_glb(p, n, c, t)]})

    return dealt.groupBy("col", "row", "piece").applyInPandas(merge, "col long, row long, piece long, parts long, vertices long, triangles long, glb binary")


def write_files(df: DataFrame, folder: str, name_col: str, data_col: str) -> None:
    """Each row's bytes as a file in a folder, a path or an address of a file system that Arrow knows (file, hdfs, s3, gs).

    On a cluster the folder must be one that all executors share.  A file appears under its name when it is whole.
    """

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for r in rows:
            part = f"{root}/.{r[name_col]}.part"
            with system.open_output_stream(part) as out:
                out.write(bytes(r[data_col]))
            system.move(part, f"{root}/{r[name_col]}")

    df.select(name_col, data_col).foreachPartition(put)
