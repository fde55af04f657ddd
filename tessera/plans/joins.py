"""Joins for keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import Staging

#: A side of at most so many rows and so many bytes is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
#: Rows of a block of ``join_blocks``, few enough that a page of a file has many of its periods, and blocks of a part.
BLOCK = 256
PART = 64


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows of ``size`` bytes in all, else as it is.

    Call it with a staged frame, whose count the Parquet footers have.  Fixed-width columns take
    the size of their types; strings, binaries and arrays are measured, in one aggregate over the few rows.
    """
    n = df.count()
    if n > rows:
        return df
    fields = df.schema.fields
    wide = [f for f in fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    width = 8 * (len(fields) - len(wide))
    if wide:
        text = lambda f: F.octet_length(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("string", "binary") else F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        total = df.agg(F.sum(sum((F.coalesce(text(f), F.lit(0)) for f in wide), F.lit(0)).cast("long"))).first()[0] or 0
    else:
        total = 0
    return F.broadcast(df) if n * width + total <= size else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked for a join that shuffles both sides.

    Spark's estimate of a plan does not count the rows that ``explode`` adds, so it broadcasts a side that a
    generator has made many times larger than the table behind it; what is exploded and joined is marked by this.
    """
    return df.hint("merge")


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, pairs: int = 20_000_000) -> DataFrame:
    """Inner join for keys with very many rows on both sides, whose result is far larger than they are.

    A key of more than ``pairs`` pairs is dealt to lots of about so many: its left rows by ``spread``, its right rows to all lots.
    The pairs of all keys decide the number of tasks, which the size of the sides does not show.  The lots are broadcast; there are
    at most as many as the result has multiples of ``pairs``.  Call it with staged frames: both are counted by key first.
    """
    of = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    made = of(left, "_l").join(of(right, "_r"), keys).withColumn("_lots", F.least(F.ceil(F.col("_l") * F.col("_r") / pairs), F.col("_l")))
    tasks = made.agg(F.ceil(F.sum(F.col("_l").cast("double") * F.col("_r")) / pairs)).first()[0]
    lots = F.broadcast(made.where("_lots > 1").select(*keys, "_lots"))
    n = min(max(int(tasks or 0) * 2, 1), 20_000)
    a = left.join(lots, keys, "left").withColumn("_lot", F.pmod(spread, F.coalesce("_lots", F.lit(1)))).drop("_lots")
    b = right.join(lots, keys, "left").withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_lots", F.lit(1)) - 1))).drop("_lots")
    on = [*keys, "_lot"]
    return a.repartition(n, *on).join(shuffled(b.repartition(n, *on)), on).drop("_lot")


def join_blocks(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, staging: Staging, name: str, pairs: int = 10_000_000) -> DataFrame:
    """``join_dealt`` for a right side that is small in bytes: it is copied for no lot, and the result compresses well.

    The right rows of a key become blocks of ``BLOCK``, which are staged and broadcast.  A task sorts its left rows by the blocks that they meet and
    opens the blocks as the result is read: a block's rows follow one another again and again in the same order, of which a file keeps little, where
    all rows of a key would be too long a period.  A right side beyond the bound of a broadcast goes to ``join_dealt``.
    """
    rest = lambda df: [c for c in df.columns if c not in keys]
    of = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    rows_of = of(right, "_r")
    # Parts of a key are collected before they are cut, so that all blocks but a part's last are full; few keys have several.
    parts = F.broadcast(rows_of.where(F.col("_r") > PART * BLOCK).select(*keys, F.ceil(F.col("_r") / (PART * BLOCK)).alias("_parts")))
    part = F.pmod(F.xxhash64(*rest(right)), F.coalesce("_parts", F.lit(1)))
    whole = right.dropna(subset=keys).join(parts, keys, "left").withColumn("_part", part).groupBy(*keys, "_part").agg(F.collect_list(F.struct(*rest(right))).alias("_all"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / BLOCK).cast("int")), lambda i: F.slice("_all", i * BLOCK + 1, BLOCK))
    blocks = staging.keep(whole.select(*keys, F.col("_part"), F.posexplode(cut).alias("_k", "_rows")), name)
    small = broadcast_if_small(blocks)
    if small is blocks:
        return join_dealt(left, right, keys, spread)
    made = of(left, "_l").join(rows_of, keys).withColumn("_lots", F.least(F.ceil(F.col("_l") * F.col("_r") / pairs), F.col("_l")))
    tasks = made.agg(F.ceil(F.sum(F.col("_l").cast("double") * F.col("_r")) / pairs)).first()[0]
    n = min(max(int(tasks or 0) * 2, 1), 20_000)
    # There are at most as many keys as blocks; left rows of other keys are not shuffled.
    dealt = left.join(F.broadcast(made.select(*keys, "_lots")), keys).withColumn("_lot", F.pmod(spread, "_lots")).drop("_lots").repartition(n, *keys, "_lot")
    block = [*keys, "_part", "_k"]
    asked = dealt.join(F.broadcast(blocks.select(*block)), keys).sortWithinPartitions(*block)
    # Spark drops a sort below a join, but not below a generator.
    met = asked.withColumn("_k", F.explode(F.array("_k"))).join(small, block)
    return met.select(*left.columns, F.explode("_rows").alias("_row")).select(*keys, *rest(left), "_row.*")


def left_join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, hot: int, spread: Column, apart: bool = False) -> DataFrame:
    """Left join on keys unique in ``right``, safe for keys with very many left rows.

    ``weight`` names the column of ``right`` that has the number of left rows
    of a key.  Keys of at least ``hot`` rows are joined by broadcast: there are
    at most ``rows of left / hot`` such keys, so choose ``hot`` as a fraction of
    the left rows and the broadcast side is bounded by its inverse.  All other
    keys go through a shuffle; the rows that already have their match are dealt
    out by ``spread`` there instead of by their key.  Keys must not be null.
    ``apart`` keeps Spark from a broadcast of the other keys too, whatever size it takes them to have.
    """
    out = [c for c in right.columns if c not in keys]
    big = F.broadcast(right.where(F.col(weight) >= hot).select(*keys, F.struct(*out).alias("_hot")))
    rest = right.where(F.col(weight) < hot).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(-1).cast("long").alias("_lot"), F.struct(*out).alias("_rest"))
    found = left.join(big, keys, "left").withColumn("_deal", F.when(F.col("_hot").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(spread, F.lit(1 << 40))))
    on = F.col("_deal") == F.col("_lot")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    joined = found.join(shuffled(rest) if apart else rest, on, "left")
    return joined.select(*left.columns, *[F.coalesce(F.col("_hot")[c], F.col("_rest")[c]).alias(c) for c in out])
