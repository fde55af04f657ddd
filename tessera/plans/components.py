"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.joins import BROADCAST_ROWS, broadcast_if_small, left_join_hot, shuffled
from tessera.plans.staging import Staging


def connected_components(edges: DataFrame, staging: Staging, name: str = "components") -> DataFrame:
    """(v, label) for each vertex of ``edges`` (a, b): label is the smallest vertex of its component.

    Each round takes the smallest label among the neighbours (summed before the
    shuffle, so a vertex with very many edges is no task's burden) and then the
    label of the label; rounds are staged and repeat until nothing changes, which
    takes about the logarithm of the longest path.  Beyond the bound of a broadcast, the
    edges of a vertex and the vertices of a component are dealt out if they are many.  Edges may repeat, run in
    both directions or be loops; vertices must not be null.  No edges give no rows.
    """
    # Beyond the bound of a broadcast, a vertex of more than this part of all edges is met by broadcast; there are at most so many.
    share = 200
    both = staging.keep(edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "w").distinct(), f"{name}-edges")
    labels = staging.keep(both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("label")).withColumnRenamed("u", "v"), f"{name}-0")
    k = 0
    while True:
        large = labels.count() > BROADCAST_ROWS
        # Labels compress well: their files and shuffles look small enough for a broadcast that is many times larger, in every round.
        apart = shuffled if large else lambda df: df
        if large:
            degrees = both.groupBy("w").agg(F.count("*").alias("n"))
            met = left_join_hot(both, degrees.join(shuffled(labels.withColumnRenamed("v", "w")), "w"), ["w"], "n", max(2, both.count() // share), F.xxhash64("u"), apart=True)
        else:
            met = both.join(broadcast_if_small(labels), both["w"] == labels["v"])
        near = met.groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(apart(near), labels["v"] == near["u"]).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = staging.keep(lower, f"{name}-{k}-lower")
        to = lower.select(F.col("v").alias("at"), F.col("label").alias("root"))
        if large:
            sizes = lower.groupBy(F.col("label").alias("at")).agg(F.count("*").alias("n"))
            found = left_join_hot(lower.withColumn("at", F.col("label")), sizes.join(shuffled(to), "at"), ["at"], "n", max(2, lower.count() // share), F.xxhash64("v"), apart=True)
        else:
            found = lower.join(broadcast_if_small(to), F.col("label") == F.col("at"), "left")
        jumped = found.select("v", "old", F.least("label", F.coalesce("root", "label")).alias("label"))
        jumped = staging.keep(jumped, f"{name}-{k + 1}")
        staging.drop(f"{name}-{k}-lower", f"{name}-{k}")
        k += 1
        labels = jumped.select("v", "label")
        if not jumped.where("old <> label").limit(1).count():
            break
    staging.drop(f"{name}-edges")
    return labels
