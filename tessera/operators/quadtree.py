"""Adaptive selection of tiles under a budget: a best-first search for each view, views in parallel."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _need(z: int, x: int, y: int, fx: float, fy: float, near: float, top: int, levels: int, least: int) -> tuple[int, float]:
    """How many levels a tile lacks for its distance to the focus (in tiles of the finest level), and that distance."""
    scale = 2.0 ** (top - z)
    dx = max(x * scale - fx, 0.0, fx - (x + 1) * scale)
    dy = max(y * scale - fy, 0.0, fy - (y + 1) * scale)
    d = math.hypot(dx, dy)
    less = 0 if d <= near else min(int(math.floor(math.log2(d / near))), levels)
    return max(least, top - less) - z, d


def select_adaptive(box: tuple[float, float, float, float], focus: tuple[float, float], top: int, least: int, near: float, levels: int, budget: int) -> list[tuple[int, int, int]]:
    """Leaves (z, x, y) over a box, given with its focus in tiles of level ``top``.

    From the tiles of level ``least``, the leaf with the greatest need of detail
    is refined first (ties: the nearer one, then the smaller key), the one
    under the focus before all; a leaf whose children do not fit the budget is
    left, and others are tried.  Children outside the box are dropped.
    """
    x0, y0, x1, y1 = box

    def inside(z: int, x: int, y: int) -> bool:
        s = 2.0 ** (top - z)
        return x * s <= x1 and (x + 1) * s >= x0 and y * s <= y1 and (y + 1) * s >= y0

    s = 2.0 ** (top - least)
    n = 2**least
    lo = lambda v: max(0, int(math.floor(v / s)))
    hi = lambda v: min(n - 1, int(math.floor(v / s)))
    roots = [(least, x, y) for x in range(lo(x0), hi(x1) + 1) for y in range(lo(y0), hi(y1) + 1) if inside(least, x, y)]
    leaves, heap = set(roots), []

    def push(t: tuple[int, int, int]) -> None:
        need, d = _need(*t, *focus, near, top, levels, least)
        if need > 0:
            z, x, y = t
            w = 2.0 ** (top - z)
            under = x * w <= focus[0] < (x + 1) * w and y * w <= focus[1] < (y + 1) * w
            heapq.heappush(heap, (not under, -need, d, t))

    for t in roots:
        push(t)
    while heap:
        *_, t = heapq.heappop(heap)
        z, x, y = t
        kids = [k for k in ((z + 1, 2 * x + i, 2 * y + j) for j in (0, 1) for i in (0, 1)) if inside(*k)]
        if len(leaves) - 1 + len(kids) > budget:
            continue
        leaves.remove(t)
        leaves.update(kids)
        for k in kids:
            push(k)
    return sorted(leaves)


def adaptive_tiles(views: DataFrame, top: int, least: int = 2, near: float = 2.0, levels: int = 6, budget: int = 64) -> DataFrame:
    """(view, z, x, y) for each view (view, x0, y0, x1, y1, fx, fy in tiles of level ``top``): a narrow pass over the views."""

    def run(batches):
        for b in batches:
            rows = [(v, *t) for v, x0, y0, x1, y1, fx, fy in b[["view", "x0", "y0", "x1", "y1", "fx", "fy"]].itertuples(index=False) for t in select_adaptive((x0, y0, x1, y1), (fx, fy), top, least, near, levels, budget)]
            yield pd.DataFrame(rows, columns=["view", "z", "x", "y"]).astype({"view": np.int64, "z": np.int32, "x": np.int64, "y": np.int64})

    return views.select("view", "x0", "y0", "x1", "y1", "fx", "fy").mapInPandas(run, "view long, z int, x long, y long")
