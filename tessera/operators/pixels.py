"""Classified pixels of a picture: shares, windows, attribution; and screen samples of tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_histogram(pixels: DataFrame, cls: str, height: Column) -> DataFrame:
    """Pixels of each class, their bounds, and how many lie in the upper, middle and lower third of the picture."""
    third = F.when(F.col("y") < height / 3, 0).when(F.col("y") < height * 2 / 3, 1).otherwise(2)
    bounds = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    return pixels.groupBy(cls).agg(F.count("*").alias("n"), *bounds, *[F.count_if(third == k).alias(name) for k, name in enumerate(("upper", "middle", "lower"))])


def window_median(pixels: DataFrame, value: str, radius: int = 20, step: int = 4, least: int = 20, block: int = 64) -> DataFrame:
    """``pixels`` (x, y unique) with the upper median of ``value`` over a grid of samples around each.

    Samples lie at offsets from -radius to radius in steps; a pixel with fewer than ``least``
    samples is left out.  The picture is cut into blocks of ``block`` pixels a side; a pixel is dealt to its own and to those whose
    margin of ``radius`` it lies in, and the medians of a block's pixels are taken at once.  Null values are no samples.
    """
    kind = pixels.schema[value].dataType
    exact = kind.typeName() in ("byte", "short", "integer", "long")
    number, nothing = (np.int64, np.iinfo(np.int64).max) if exact else (np.float64, np.inf)
    offsets = np.arange(-radius, radius + 1, step)

    def medians(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        west, north = key[0] * block - radius, key[1] * block - radius
        side = block + 2 * radius
        held = np.full((side, side), nothing, number)
        x, y = g["x"].to_numpy() - west, g["y"].to_numpy() - north
        held[y, x] = g["v"].to_numpy()
        inner = (x >= radius) & (x < radius + block) & (y >= radius) & (y < radius + block)
        x, y = x[inner], y[inner]
        samples = np.sort(held[(y[:, None, None] + offsets[None, :, None]), (x[:, None, None] + offsets[None, None, :])].reshape(len(x), len(offsets) ** 2), axis=1)
        n = (samples != nothing).sum(1)
        ok = (n >= least) & (n > 0)
        return pd.DataFrame({"x": x[ok] + west, "y": y[ok] + north, "median": samples[np.flatnonzero(ok), n[ok] // 2]})

    # Every place is asked about, so pixels without a value come along as no samples.
    v = F.coalesce(F.col(value).cast("long" if exact else "double"), F.lit(nothing.item() if hasattr(nothing, "item") else nothing))
    across = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / block), F.floor((F.col(c) + radius) / block)))
    dealt = pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), v.alias("v")).withColumn("_bx", across("x")).withColumn("_by", across("y"))
    found = dealt.groupBy("_bx", "_by").applyInPandas(medians, f"x long, y long, median {'long' if exact else 'double'}")
    at = found.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("median").cast(kind).alias("median"))
    return pixels.join(at, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).drop("_x", "_y")


def attribute(normal: Column, failed: Column, loading: Column, selected: Column, covered: Column, finer: Column) -> Column:
    """Why a pixel looks as it does, the first that holds: normal, geom, loading, unselected, hole, finer."""
    return F.when(normal, "normal").when(covered & failed, "geom").when(covered & loading, "loading").when(covered & ~selected, "unselected").when(~covered, "hole").when(finer, "finer").otherwise("normal")


def sample_ratios(samples: DataFrame, boxes: DataFrame, sharp: float, cell: int) -> DataFrame:
    """(view, total, sharp, blur, uncovered): what the finest box over each sample point shows.

    ``samples`` has (view, px, py), unique; ``boxes`` (view, z, x0, x1, y0, y1, ratio), bounds
    included.  Of the finest boxes the narrowest counts, then that of the smaller ratio; it is sharp
    if its ratio is at most ``sharp``.  Boxes meet points by screen cells of ``cell`` pixels.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    dealt = boxes.withColumn("_cx", cells("x0", "x1")).withColumn("_cy", cells("y0", "y1"))
    points = samples.withColumns({"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)})
    met = points.join(dealt, ["view", "_cx", "_cy"], "left")
    over = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    best = F.min(F.when(over, F.struct((-F.col("z")).alias("z"), (F.col("x1") - F.col("x0")).alias("w"), F.col("ratio"))))
    found = met.groupBy("view", "px", "py").agg(best.alias("b"))
    return found.groupBy("view").agg(F.count("*").alias("total"), F.count_if(F.col("b.ratio") <= sharp).alias("sharp"), F.count_if(F.col("b.ratio") > sharp).alias("blur"), F.count_if(F.col("b").isNull()).alias("uncovered"))
