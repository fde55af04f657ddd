"""Metrics of views, benchmark samples and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.components import connected_components
from tessera.plans.staging import Staging


def load_state(tiles: DataFrame, view: str, key: str | None = None) -> DataFrame:
    """Loaded, pending and failed tiles of each view, and whether it is complete; with ``key`` the sorted list of failed ones."""
    n = lambda s: F.count_if(F.col("state") == s)
    counted = tiles.groupBy(view).agg(n("loaded").alias("loaded"), F.count_if(F.col("state").isin("pending", "loading")).alias("pending"), n("failed").alias("failed"), *([F.array_sort(F.collect_list(F.when(F.col("state") == "failed", F.col(key)))).alias("failed_keys")] if key else []))
    return counted.withColumn("complete", (F.col("pending") == 0) & (F.col("failed") == 0))


def duplicate_ratio(requests: DataFrame, group: str, url: str) -> DataFrame:
    """Requests, distinct addresses without their query string, and the share of repeats, by group."""
    bare = F.split_part(F.col(url), F.lit("?"), F.lit(1))
    got = requests.groupBy(group).agg(F.count("*").alias("total"), F.count_distinct(bare).alias("distinct"))
    return got.withColumn("ratio", 1 - F.col("distinct") / F.col("total"))


def scenario_summary(samples: DataFrame, scenario: str, order: str, metrics: list[str]) -> DataFrame:
    """Peak (largest) and final (last) value of each metric by scenario."""
    return samples.groupBy(scenario).agg(*[f for m in metrics for f in (F.max(m).alias(f"peak_{m}"), F.max_by(m, order).alias(f"final_{m}"))])


def check_thresholds(values: DataFrame, spec: DataFrame) -> DataFrame:
    """pass, fail or unknown for each (scenario, metric) of ``spec`` (scenario, metric, max, min) by ``values`` (scenario, metric, value)."""
    met = spec.join(values, ["scenario", "metric"], "left")
    bad = (F.coalesce(F.col("value") > F.col("max"), F.lit(False))) | F.coalesce(F.col("value") < F.col("min"), F.lit(False))
    return met.withColumn("verdict", F.when(F.col("value").isNull(), "unknown").when(bad, "fail").otherwise("pass"))


def nearest_colour(red: Column, green: Column, blue: Column, palette: list[tuple[str, int, int, int]]) -> Column:
    """Name of the palette's nearest colour (ties: the earlier one); the palette is a literal."""
    far = lambda r, g, b: (red - r) * (red - r) + (green - g) * (green - g) + (blue - b) * (blue - b)
    best = F.array_min(F.array(*[F.struct(far(r, g, b).cast("long").alias("d"), F.lit(k).alias("k")) for k, (_, r, g, b) in enumerate(palette)]))
    return F.element_at(F.array(*[F.lit(name) for name, *_ in palette]), best["k"] + 1)


def dominant(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """The commonest value of each cell and its count (ties: the smaller value)."""
    counted = df.groupBy(*cell, value).count()
    w = Window.partitionBy(*cell).orderBy(F.desc("count"), value)
    return counted.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def lod_violations(tiles: DataFrame, view: str, distance: str, zoom: str, key: str) -> DataFrame:
    """The tiles of each view beyond which a farther one is finer by more than one level."""
    return suffix_max(tiles, view, [distance, key], zoom, "_far").where(F.col("_far") > F.col(zoom) + 1).drop("_far")


def settle_index(samples: DataFrame, scenario: str, order: str, quiet: Column, needed: int = 3, slots: int = 64) -> DataFrame:
    """The first sample of each scenario that ends ``needed`` quiet ones in a row (null if none does); a null ``quiet`` is not.

    A run is counted within a slot of its scenario; of each slot remain the first sample that settles
    there, the first ``needed`` of a run from its start and the length of the run at its end, which is carried on.
    """
    marked = in_slots(samples.select(scenario, order, F.coalesce(quiet, F.lit(False)).alias("_q")), scenario, F.col(order), slots)
    run = F.sum(F.when(F.col("_q"), 0).otherwise(1)).over(Window.partitionBy(scenario, "_slot").orderBy(order))
    nth = F.sum(F.when(F.col("_q"), 1).otherwise(0)).over(Window.partitionBy(scenario, "_slot", "_run").orderBy(order))
    marked = marked.withColumn("_run", run).withColumn("_nth", nth)
    leading = F.col("_q") & (F.col("_run") == 0) & (F.col("_nth") <= needed)
    cut = marked.groupBy(scenario, "_slot").agg(
        F.min(F.when(F.col("_q") & (F.col("_nth") >= needed), F.col(order))).alias("_own"),
        F.collect_list(F.when(leading, F.struct("_nth", F.col(order).alias("_at")))).alias("_head"),
        F.max(F.struct("_run", "_nth")).alias("_tail"),
    )
    earlier = Window.partitionBy(scenario).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_sum", F.coalesce(F.sum("_tail._nth").over(earlier), F.lit(0)))
    broken = F.last(F.when(F.col("_tail._run") > 0, F.col("_sum")), ignorenulls=True).over(earlier)
    cut = cut.withColumn("_carry", F.col("_sum") - F.coalesce(broken, F.lit(0)))
    joined = F.array_min(F.transform(F.filter("_head", lambda r: r["_nth"] + F.col("_carry") >= needed), lambda r: r["_at"]))
    return cut.groupBy(scenario).agg(F.min(F.least("_own", joined)).alias("settled"))


def in_slots(df: DataFrame, group: str, order: Column, slots: int) -> DataFrame:
    """``df`` with ``_slot``: which of about ``slots`` equally filled ranges of its group's values of ``order`` a row lies in; -1 for null.

    Groups may hold most rows: windows over (group, slot) and sums of slots replace one over the group.  Cuts are approximate
    quantiles, so an outlier does not leave all others in one slot; rows of equal value share a slot.
    """
    value = order.cast("double")
    cuts = df.groupBy(group).agg(F.percentile_approx(value, [k / slots for k in range(1, slots)], 10 * slots).alias("_cuts"))
    cuts = cuts.withColumnRenamed(group, "_of")
    slot = F.when(value.isNull() | F.isnan(value), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < value)))
    return df.join(cuts, F.col(group).eqNullSafe(F.col("_of")), "left").withColumn("_slot", F.coalesce(slot, F.lit(-1)).cast("long")).drop("_of", "_cuts")


def suffix_max(df: DataFrame, group: str, order: list[str], value: str, out: str, slots: int = 64) -> DataFrame:
    """``df`` with the largest ``value`` of the rows of its group that come after it, null for the last.

    The first order column is numeric; its nulls come first.  A window goes over one slot of a
    group, and the maxima of the later slots are added.
    """
    cut = in_slots(df, group, F.col(order[0]), slots)
    later = Window.partitionBy(group).orderBy("_slot").rowsBetween(1, Window.unboundedFollowing)
    ahead = cut.groupBy(group, "_slot").agg(F.max(value).alias("_m")).withColumn("_ahead", F.max("_m").over(later)).drop("_m")
    inside = Window.partitionBy(group, "_slot").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    met = cut.withColumn("_in", F.max(value).over(inside)).join(ahead, [group, "_slot"])
    return met.withColumn(out, F.greatest("_in", "_ahead")).drop("_slot", "_in", "_ahead")


def sum_before(df: DataFrame, group: str, order: list[str], value: str, out: str, whole: str, slots: int = 64) -> DataFrame:
    """``df`` with the sum of ``value`` of the rows of its group that come before it (0 for the first) and that of all; as ``suffix_max``."""
    cut = in_slots(df, group, F.col(order[0]), slots)
    earlier = Window.partitionBy(group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(group, "_slot").agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).withColumn("_whole", F.sum("_s").over(Window.partitionBy(group))).drop("_s")
    inside = Window.partitionBy(group, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = cut.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [group, "_slot"])
    return met.withColumns({out: F.col("_in") + F.col("_before"), whole: F.col("_whole")}).drop("_slot", "_in", "_before", "_whole")


def stuck_gestures(samples: DataFrame, scenario: str, order: str, pose: list[str], near: float = 1e-3, slots: int = 64) -> DataFrame:
    """(scenario, stuck): samples during a gesture whose pose is that of the sample before.

    A window goes over one slot of a scenario; the first sample of a slot is compared with the last of the slots before.
    """
    cut = in_slots(samples, scenario, F.col(order), slots)
    inside = Window.partitionBy(scenario, "_slot").orderBy(order)
    tails = cut.groupBy(scenario, "_slot").agg(F.max_by(F.struct(*pose), order).alias("_last"))
    tails = tails.select(F.col(scenario).alias("_of"), F.col("_slot").alias("_at"), F.lag("_last").over(Window.partitionBy(scenario).orderBy("_slot")).alias("_carried"))
    met = cut.join(tails, F.col(scenario).eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_at")))
    first = F.row_number().over(inside) == 1
    same = F.lit(True)
    for c in pose:
        before = F.when(first, F.col("_carried")[c]).otherwise(F.lag(c).over(inside))
        same = same & F.coalesce(F.abs(F.col(c) - before) < near, F.lit(False))
    return met.withColumn("_s", F.col("interacting") & same).groupBy(scenario).agg(F.count_if("_s").alias("stuck"))


def watchdog(samples: DataFrame, actor: str, order: list[str], at: str, pose: str, limit: int) -> DataFrame:
    """``samples`` with ``released``: whether the actor's pose has stood still for longer than ``limit`` before the sample.

    Time counts from the last change of the pose; the first sample is a change.  One window over each actor, whose samples a device's own rate bounds.
    """
    w = Window.partitionBy(actor).orderBy(*order)
    moved = F.when(~F.col(pose).eqNullSafe(F.lag(pose).over(w)) | (F.row_number().over(w) == 1), F.col(at))
    return samples.withColumn("_moved", moved).withColumn("released", F.col(at) - F.max("_moved").over(w) > limit).drop("_moved")


def grid_components(cells: DataFrame, value: str | None = None) -> DataFrame:
    """Connected components (4 neighbours) of cells (x, y, cls) of one class: their size and bounds.

    With ``value`` also the sum (``total``) and the commonest value (``mode``, ties: the smaller) of
    that column over each component; cells must then be unique.

    Edges come from two equi-joins; labels spread by connected components.
    """
    staging = Staging(cells.sparkSession, "grid")
    key = F.struct("y", "x")
    base = staging.keep(cells.select("x", "y", "cls", value) if value else cells.select("x", "y", "cls").distinct(), "cells")
    right = base.select((F.col("x") - 1).alias("x"), "y", F.col("cls").alias("_c"))
    down = base.select("x", (F.col("y") - 1).alias("y"), F.col("cls").alias("_c"))
    edge = lambda other, dx, dy: base.join(other, ["x", "y"]).where("cls = _c").select(F.struct("y", "x").alias("a"), F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")).alias("b"))
    labels = connected_components(edge(right, 1, 0).union(edge(down, 0, 1)), staging)
    met = base.withColumn("_k", key).join(labels, F.col("_k") == F.col("v"), "left").withColumn("label", F.coalesce("label", "_k"))
    out = met.groupBy("cls", "label").agg(F.count("*").alias("size"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    if value:
        met = staging.keep(met.groupBy("cls", "label", value).agg(F.count("*").alias("n")), "values")
        modes = met.groupBy("cls", "label").agg(F.sum(F.col(value) * F.col("n")).alias("total"), F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("m"))
        out = out.join(modes.select("cls", "label", "total", (-F.col("m.v")).alias("mode")), ["cls", "label"])
    return out.select("cls", "size", "x0", "x1", "y0", "y1", *(["total", "mode"] if value else []))
