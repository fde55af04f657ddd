"""Request admission, bounded queues, caches and failures over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.lod import backoff_seconds
from tessera.operators.metrics import sum_before
from tessera.plans.joins import broadcast_if_small
from tessera.plans.staging import Staging


def top_per_group(df: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group with their ``rank``.

    Spark keeps only ``cap`` rows of a group on each task before the shuffle
    (a limit under the window), so a group of any size is no burden.
    """
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= cap)


def admit(requests: DataFrame, group: str, cap: int, total: int) -> DataFrame:
    """The requests that start from an empty state: by (priority, id), ``cap`` of a group and ``total`` overall at most."""
    return top_per_group(requests, group, [F.col("priority"), F.col("id")], cap).orderBy("priority", "id").limit(total)


def bounded_queue(requests: DataFrame, size: int) -> DataFrame:
    """What a queue of that size keeps: the smallest priorities (ties: smaller key)."""
    return requests.orderBy("priority", "key").limit(size)


def lru_evicted(held: DataFrame, cache: str, keep: int) -> DataFrame:
    """The entries of each cache (keys unique in it) beyond its ``keep`` most recently used.

    What is kept is found with a limit under the window; its oldest entry, one row a cache, parts the rest from it.
    """
    kept = top_per_group(held.select(cache, "last_access", "key"), cache, [F.desc("last_access"), F.desc("key")], keep)
    oldest = kept.groupBy(cache).agg(F.min(F.struct("last_access", "key")).alias("_oldest"))
    oldest = broadcast_if_small(Staging(held.sparkSession, "lru").keep(oldest, "oldest"))
    return held.join(oldest, cache).where(F.struct("last_access", "key") < F.col("_oldest")).drop("_oldest")


def lru_trim(held: DataFrame, cache: str, budget: str, share: float = 0.8) -> DataFrame:
    """The entries to delete, oldest first, until each cache that is over its budget has ``share`` of it at most; ``last_access`` is numeric."""
    target = F.floor(F.col(budget) * share)
    summed = sum_before(held, cache, ["last_access", "key"], "bytes", "freed", "total")
    return summed.where((F.col("total") > F.col(budget)) & (F.col("total") - F.col("freed") > target))


def failure_states(failures: DataFrame) -> DataFrame:
    """(key, attempts, permanent, wait_s) after all failures of a key; 404 and 410 are for ever."""
    states = failures.groupBy("key").agg(F.count("*").alias("attempts"), F.max(F.col("status").isin(404, 410)).alias("permanent"))
    return states.select("key", "attempts", "permanent", F.when(F.col("permanent"), None).otherwise(backoff_seconds(F.col("attempts"))).cast("long").alias("wait_s"))


def largest_first(candidates: DataFrame, score: Column, budget: int, key: str = "key") -> DataFrame:
    """The ``budget`` candidates of the largest score (ties: smaller key), with ``score``."""
    return candidates.withColumn("score", score).orderBy(F.desc("score"), key).limit(budget)


def upgrade_score(pixels: Column, fallback: Column) -> Column:
    """Size on the screen; a fallback tile must be four times as large to come first."""
    return F.when(fallback, pixels / 4).otherwise(pixels)


def effective_caps(requests: DataFrame, limits: DataFrame, default: int) -> DataFrame:
    """``requests`` (grp, cap) with ``effective``: the smaller of the request's cap (``default`` if null) and its group's limit (grp, group_cap), if it has one."""
    own = F.coalesce("cap", F.lit(default))
    return requests.join(limits, "grp", "left").withColumn("effective", F.least(own, F.coalesce("group_cap", own))).drop("group_cap")


def ownerless(owners: DataFrame, wanted: DataFrame) -> DataFrame:
    """The requests of which no owner (request, owner) is among ``wanted`` (owner): they are cancelled."""
    met = owners.join(wanted.select("owner").distinct().withColumn("_w", F.lit(1)), "owner", "left")
    return met.groupBy("request").agg(F.count("_w").alias("active")).where("active = 0").select("request")
