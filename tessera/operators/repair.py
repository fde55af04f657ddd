"""Repair of polygons whose rings cross, overlap or lie wrongly in each other.

A repaired polygon covers what an odd number of its rings encloses.  Edges are cut
where they meet, those that lie on each other an even number of times vanish,
and what is left separates inside from outside; its faces are traced into rings again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.vectors import clean_ring
from tessera.sources.geojson import once

#: Coordinates closer than this part of the polygon's size are one point.
SNAP = 1e-10

Point = tuple[int, int]


#: Up to so many segments are compared pair by pair; more are swept.
FEW = 64


def _meetings(p: tuple, q: tuple, a: tuple, b: tuple) -> tuple[list, list]:
    """Where the segments p-q and a-b meet: the points that cut the first and those that cut the second.

    An end that lies on the other segment is the meeting itself, so that both get the same point.
    """
    rx, ry, sx, sy, wx, wy = q[0] - p[0], q[1] - p[1], b[0] - a[0], b[1] - a[1], a[0] - p[0], a[1] - p[1]
    det = rx * sy - ry * sx
    if abs(det) > 1e-12 * math.hypot(rx, ry) * math.hypot(sx, sy):
        t, u = (wx * sy - wy * sx) / det, (wx * ry - wy * rx) / det
        if not (-1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9):
            return [], []
        ends = [e for e, near in ((p, abs(t) < 1e-9), (q, abs(t - 1) < 1e-9), (a, abs(u) < 1e-9), (b, abs(u - 1) < 1e-9)) if near]
        point = ends[0] if ends else (p[0] + t * rx, p[1] + t * ry)
        return [point], [point]
    if abs(wx * ry - wy * rx) > 1e-10 * max(rx * rx + ry * ry, 1e-300):
        return [], []
    within = lambda e, o, dx, dy: -1e-12 <= ((e[0] - o[0]) * dx + (e[1] - o[1]) * dy) / (dx * dx + dy * dy) <= 1 + 1e-12
    return [e for e in (a, b) if within(e, p, rx, ry)], [e for e in (p, q) if within(e, a, sx, sy)]


def _cuts(p: list[tuple], q: list[tuple]) -> list[list[tuple]]:
    """For each segment from ``p`` to ``q`` the points where others meet it: pairs of the few, a sweep over x of the many."""
    cuts: list[list[tuple]] = [[] for _ in p]
    if len(p) <= FEW:
        boxes = [(min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])) for a, b in zip(p, q, strict=True)]
        pairs = ((i, j) for i in range(len(p)) for j in range(i) if boxes[i][0] <= boxes[j][1] and boxes[j][0] <= boxes[i][1] and boxes[i][2] <= boxes[j][3] and boxes[j][2] <= boxes[i][3])
    else:
        pairs = _near_pairs(np.array(p), np.array(q))
    for i, j in pairs:
        mine, other = _meetings(p[i], q[i], p[j], q[j])
        cuts[i] += mine
        cuts[j] += other
    return cuts


def _near_pairs(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs of segments whose boxes meet, in the order of their left ends."""
    low, high = np.minimum(p, q), np.maximum(p, q)
    order = np.argsort(low[:, 0], kind="stable")
    begins = low[order, 0]
    for at, i in enumerate(order.tolist()):
        later = order[at + 1 : int(np.searchsorted(begins, high[i, 0], side="right"))]
        for j in later[(low[later, 1] <= high[i, 1]) & (high[later, 1] >= low[i, 1])].tolist():
            yield i, j


def _odd_edges(rings: list[np.ndarray], low: np.ndarray, unit: float) -> tuple[set[tuple[Point, Point]], dict[Point, tuple], bool]:
    """The undirected edges that occur an odd number of times after all are cut where they meet, the places of their ends, and whether any lie on each other."""
    p = [tuple(v) for r in rings for v in r.tolist()]
    q = [tuple(v) for r in rings for v in r[1:].tolist() + r[:1].tolist()]
    x0, y0 = low.tolist()
    key = lambda v: (round((v[0] - x0) / unit), round((v[1] - y0) / unit))
    places: dict[Point, tuple] = {}
    edges: set[tuple[Point, Point]] = set()
    changed = False
    for a, b, met in zip(p, q, _cuts(p, q), strict=True):
        dx, dy = b[0] - a[0], b[1] - a[1]
        met.sort(key=lambda e, a=a, dx=dx, dy=dy: (e[0] - a[0]) * dx + (e[1] - a[1]) * dy)
        keys = []
        for v in (a, *met, b):
            k = key(v)
            if not keys or keys[-1] != k:
                keys.append(k)
                places.setdefault(k, v)
        for m, n in zip(keys, keys[1:], strict=False):
            e = (min(m, n), max(m, n))
            changed |= e in edges
            edges ^= {e}
    return edges, places, changed


def _area(ring: list[Point]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _faces(edges: set[tuple[Point, Point]]) -> tuple[list[list[Point]], dict[tuple[Point, Point], int]]:
    """The walks around the faces, each with its face at the left, and the walk of each directed edge."""
    around: dict[Point, list[Point]] = {}
    for a, b in edges:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    follows = {}
    for v, ends in around.items():
        ends.sort(key=lambda e, v=v: math.atan2(e[1] - v[1], e[0] - v[0]))
        for k, e in enumerate(ends):
            follows[e, v] = (v, ends[k - 1])  # arriving from e, the next edge clockwise
    walks, walk_of = [], {}
    for start in follows:
        if start in walk_of:
            continue
        walk, at = [], start
        while at not in walk_of:
            walk_of[at] = len(walks)
            walk.append(at[0])
            at = follows[at]
        walks.append(walk)
    return walks, walk_of


def _extent(ring: np.ndarray) -> float:
    """The area of a ring, whichever way it runs."""
    x, y = (ring - ring[0]).T
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def _turns_left(ring: np.ndarray) -> bool:
    (ax, ay), (bx, by), (cx, cy) = ring[:3].tolist()
    return (bx - ax) * (cy - ay) > (by - ay) * (cx - ax)


def is_convex(ring: np.ndarray) -> bool:
    """Whether a ring turns to one side only, by more than rounding, and once round."""
    points = ring.tolist()
    around = list(zip(points[-2:] + points, points[-1:] + points, points, strict=False))
    turns = [(bx - ax) * (cy - by) - (by - ay) * (cx - bx) for (ax, ay), (bx, by), (cx, cy) in around]
    least = 1e-9 * max(map(abs, turns))
    if not (min(turns) > least or max(turns) < -least):
        return False
    # Once round: the direction along x changes its sign twice.
    steps = [q[0] - p[0] for p, q in zip(points, points[1:] + points[:1], strict=True)]
    signs = [s > 0 for s in steps if s]
    return sum(a != b for a, b in zip(signs, signs[1:] + signs[:1], strict=True)) == 2


def _in_convex(rings: list[np.ndarray]) -> bool:
    """Whether a convex outer ring holds convex holes that are apart from it and from each other, all by more than rounding; then nothing can meet."""
    if any(len(r) < 3 or not is_convex(r) for r in rings):
        return False
    outer, *holes = [r.tolist() for r in rings]
    boxes = [(min(x for x, _ in r), max(x for x, _ in r), min(y for _, y in r), max(y for _, y in r)) for r in (outer, *holes)]
    size = max(boxes[0][1] - boxes[0][0], boxes[0][3] - boxes[0][2])
    near, side = 1e-9 * size, 1 if _turns_left(rings[0]) else -1
    if any(abs(c - a) <= near and abs(d - b) <= near for r in (outer, *holes) for (a, b), (c, d) in zip(r, r[1:] + r[:1], strict=True)):
        return False
    if any(_extent(r) <= near * size for r in rings):
        return False
    edges = [(ax, ay, side * (bx - ax), side * (by - ay), near * math.hypot(bx - ax, by - ay)) for (ax, ay), (bx, by) in zip(outer, outer[1:] + outer[:1], strict=True)]
    if not all(dx * (y - ay) - dy * (x - ax) > least for h in holes for x, y in h for ax, ay, dx, dy, least in edges):
        return False
    inner = boxes[1:]
    return len(inner) <= FEW and all(a[1] + near < b[0] or b[1] + near < a[0] or a[3] + near < b[2] or b[3] + near < a[2] for k, a in enumerate(inner) for b in inner[:k])


def _convex(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``is_convex`` of rings of one length, a row each, and whether they turn left."""
    bx, by, cx, cy = np.roll(x, 1, 1), np.roll(y, 1, 1), np.roll(x, 2, 1), np.roll(y, 2, 1)
    with np.errstate(invalid="ignore", over="ignore"):
        turns = (bx - cx) * (y - by) - (by - cy) * (x - bx)
        least = 1e-9 * np.abs(turns).max(1)
        left, right = turns.min(1) > least, turns.max(1) < -least
        signs = np.sign(np.roll(x, -1, 1) - x)
    for k in [*range(x.shape[1])] * 2:  # a step along y goes on as the one before
        signs[:, k] = np.where(signs[:, k] == 0, signs[:, k - 1], signs[:, k])
    return (left | right) & ((signs != np.roll(signs, 1, 1)).sum(1) == 2), left


def _inside(point: Point, ring: list[Point]) -> bool:
    """Whether a point that is no vertex of it lies in a ring; whole numbers keep the sides exact."""
    x, y = point
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > y) != (b[1] > y):
            left = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
            odd ^= (left > 0) == (b[1] > a[1])
    return odd


def _simple(walk: list[Point]) -> list[list[Point]]:
    """A walk cut into loops where it comes back to a vertex."""
    loops, path, seen = [], [], {}
    for v in walk:
        if v in seen:
            k = seen[v]
            loops.append(path[k:])
            for w in path[k + 1 :]:
                del seen[w]
            path = path[: k + 1]
        else:
            seen[v] = len(path)
            path.append(v)
    return [r for r in [*loops, path] if len(r) > 2]


def repair_polygon(rings: list[np.ndarray]) -> tuple[list[list[np.ndarray]], bool]:
    """The polygons, each an outer ring with its holes, that cover what an odd number of ``rings`` encloses; and whether that differs from the rings given.

    Outer rings run counter-clockwise, holes clockwise.  Rings of fewer than three points or without area are dropped.
    """
    if len(rings) == 1 and len(rings[0]) > 2 and is_convex(rings[0]):  # most footprints: nothing can cross
        ring = rings[0]
        return [[ring if _turns_left(ring) else ring[::-1]]], False
    if len(rings) > 1 and _in_convex(rings):
        return [[r if _turns_left(r) == (k == 0) else r[::-1] for k, r in enumerate(rings)]], False
    given = [r for r in rings if len(r) > 2]
    if not given:
        return [], bool(rings)
    every = np.concatenate(given)
    low = every.min(0)
    unit = max(float((every.max(0) - low).max()), 1e-300) * SNAP
    edges, places, changed = _odd_edges(given, low, unit)
    walks, walk_of = _faces(edges)
    # Each connected part has one walk around its outside, the only one that runs clockwise; sides of an edge differ.
    part = list(range(len(walks)))

    def root(k: int) -> int:
        while part[k] != k:
            part[k] = part[part[k]]
            k = part[k]
        return k

    for a, b in edges:
        part[root(walk_of[a, b])] = root(walk_of[b, a])
    sizes = [_area(w) for w in walks]
    outside = {root(k): k for k, s in enumerate(sizes) if s <= 0}
    depth = {r: sum(o != r and _inside(walks[k][0], walks[m]) for o, m in outside.items()) for r, k in outside.items()}
    # A part lies in an inner face of those around it if an odd number of all rings encloses it.
    filled: dict[int, bool] = {}
    loops_of = {r: [e for e in edges if root(walk_of[e]) == r] for r in outside} if len(outside) > 1 else {r: list(edges) for r in outside}

    def crossed(point: Point, lines: list[tuple[Point, Point]]) -> bool:
        odd = False
        for a, b in lines:
            if (a[1] > point[1]) != (b[1] > point[1]):
                left = (b[0] - a[0]) * (point[1] - a[1]) - (b[1] - a[1]) * (point[0] - a[0])
                odd ^= (left > 0) == (b[1] > a[1])
        return odd

    neighbours: dict[int, set[int]] = {}
    for a, b in edges:
        m, n = walk_of[a, b], walk_of[b, a]
        neighbours.setdefault(m, set()).add(n)
        neighbours.setdefault(n, set()).add(m)
    for r in sorted(outside, key=depth.get):
        around = sum(crossed(walks[outside[r]][0], loops_of[o]) for o in outside if o != r) % 2 == 1
        todo = [(outside[r], around)]
        while todo:
            k, inner = todo.pop()
            if k not in filled:
                filled[k] = inner
                todo += [(n, not inner) for n in neighbours.get(k, ())]
    outers, holes = [], []
    for k, walk in enumerate(walks):
        if filled[k]:
            for loop in _simple(walk):
                (outers if _area(loop) > 0 else holes).append(loop)
    outers = [o for o in outers if _area(o) > 0]
    owned: list[list[list[Point]]] = [[] for _ in outers]
    for h in holes:
        if _area(h) == 0:
            continue
        about = [(_area(o), k) for k, o in enumerate(outers) if next((_inside(v, o) for v in h if v not in set(o)), False)]
        if about:
            owned[min(about)[1]].append(h)
    out = [[np.array([places[v] for v in ring]) for ring in (o, *hs)] for o, hs in zip(outers, owned, strict=True)]
    pinched = any(len({tuple(v) for v in r.tolist()}) < len(r) for r in given)
    # Nothing was wrong if there are as many rings as before and each has the area that it had.
    same = [len(p) for p in out] == [len(rings)] and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(sorted(map(_extent, out[0])), sorted(map(_extent, given)), strict=True))
    return out, bool(changed or pinched or not same)


def repaired_polygons(df: DataFrame, rings_col: str = "rings") -> DataFrame:
    """``df`` with its polygons repaired: a row for each polygon that comes of one, with ``part`` from 0 and ``repaired``.

    Rings are arrays of (x, y) doubles, the outer one first, closed or not; null points and repeats of the point before are left out.  A polygon of which
    nothing is left, or a null one, has one row with a null ``part`` and null rings, ``repaired`` true.
    """
    rest = [c for c in df.columns if c != rings_col]
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, whole = batch.column(len(rest)), np.array(batch.column(len(rest) + 1).to_pylist(), bool)
            ends = column.offsets.to_numpy()
            bounds = column.values.offsets.to_numpy()
            points = column.values.values
            x, y = (points.field(c).to_numpy(zero_copy_only=False) for c in "xy")
            sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends))
            # Convex footprints of one ring, most of all, are found and turned together, by their number of points.
            plain = np.zeros(len(batch), bool)
            made_at, made_rings = [], []
            single = np.flatnonzero(sizes == 1)
            lengths = np.diff(bounds)[ends[single]]
            for n in np.unique(lengths[lengths > 2]).tolist():
                rows = single[lengths == n]
                at = bounds[ends[rows]][:, None] + np.arange(n)
                convex, left = _convex(x[at], y[at])
                rows, at = rows[convex], np.where(left[:, None], at, at[:, ::-1])[convex]
                plain[rows] = True
                made_at.append(rows)
                made_rings.append((x[at].ravel(), y[at].ravel(), np.full(len(rows), n)))
            fast = sum(map(len, made_at))
            whole_of = [np.ones(fast, np.int64)]
            slow_at, parts, changes, counts, lost = [], [], [], [], []
            loops: list[np.ndarray] = []
            for k in np.flatnonzero(~plain).tolist():
                rings = [np.column_stack((x[a:b], y[a:b])) for a, b in ((bounds[r], bounds[r + 1]) for r in range(ends[k], ends[k] + sizes[k]))]
                made, changed = repair_polygon(rings)
                for j, polygon in enumerate(made or [[]]):
                    slow_at.append(k)
                    parts.append(j)
                    lost.append(not made)
                    changes.append(changed or not made)
                    counts.append(len(polygon))
                    loops += polygon
            every = np.concatenate([*made_at, np.array(slow_at, np.int64)])
            whole_of.append(np.array(counts, np.int64))
            flat = np.concatenate(loops) if loops else np.zeros((0, 2))
            xs, ys = np.concatenate([*[m[0] for m in made_rings], flat[:, 0]]), np.concatenate([*[m[1] for m in made_rings], flat[:, 1]])
            sides = np.concatenate([*[m[2] for m in made_rings], np.array([len(r) for r in loops], np.int64)])
            up_to = lambda counted: np.concatenate([[0], np.cumsum(counted)]).astype(np.int32)
            rings = pa.ListArray.from_arrays(up_to(sides), pa.StructArray.from_arrays([xs, ys], names=["x", "y"]))
            polygons = pa.ListArray.from_arrays(up_to(np.concatenate(whole_of)), rings)
            none = np.concatenate([np.zeros(fast, bool), np.array(lost, bool)])
            part = np.concatenate([np.zeros(fast, np.int32), np.array(parts, np.int32)])
            repaired = np.concatenate([np.zeros(fast, bool), np.array(changes, bool)]) | ~whole[every]
            order = np.argsort(every, kind="stable")
            taken = [batch.column(k).take(pa.array(every[order])) for k in range(len(rest))]
            shown = pa.array(order, mask=none[order])
            yield pa.RecordBatch.from_arrays([*taken, polygons.take(shown).cast(pa.list_(pa.list_(point))), pa.array(part).take(shown), pa.array(repaired[order])], [*rest, rings_col, "part", "repaired"])

    cleaned = F.filter(F.transform(rings_col, clean_ring), lambda r: r.isNotNull())
    whole = F.coalesce(F.size("_cleaned") == F.size(rings_col), F.lit(False))
    schema = StructType([*[df.schema[c] for c in rest], *StructType.fromDDL(f"`{rings_col}` array<array<struct<x:double,y:double>>>, part int, repaired boolean")])
    return df.select(*df.columns, once(cleaned).alias("_cleaned")).select(*rest, "_cleaned", whole.alias("_whole")).mapInArrow(mend, schema)
