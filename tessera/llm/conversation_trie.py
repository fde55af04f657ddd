"""The tree of the beginnings that conversations share.

A node is a distinct sequence of first turns, named by a digest.  The digests of a
conversation's beginnings are chained; a long conversation is chained in lots of
1024 turns by different tasks and the lots' ends are chained after that, which gives the same name to the
same beginning.  Edges lead from a node's digest to that of its parent.  Sums over
subtrees are found by pointer jumping: in round k each node hands what it has gathered
to its ancestor at distance 2**k and then learns the one at twice that
distance, so the rounds are the logarithm of the depth.

Digests are 16 bytes of SHA-256: among 10**11 nodes two differ, but for a chance of 10**-17.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._text import column
from tessera.plans.joins import broadcast_if_small, left_join_hot
from tessera.plans.staging import Staging

#: Turns of a conversation that are chained in one go.
LOT = 1024
#: Ids that are joined to one string at once.
JOINED = 4096
#: A key with more than this part of all rows is met by broadcast; there are at most so many.
HOT_SHARE = 200
ROOT = bytes(16)


def short_digest(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of the parts in a row."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def digested_turns(df: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """(conv, turn, digest, words) of each turn of a conversation; null role or text is empty, rows without a conversation go."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = short_digest(F.octet_length(r).cast("string").cast("binary"), F.lit(b":"), r.cast("binary"), t.cast("binary"))
    words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return df.select(conv.alias("conv"), turn.alias("turn"), digest.alias("digest"), words.alias("words")).where("conv is not null")


def ranked_turns(turns: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, pos, digest, words), pos from 1 by turn (null first) and digest, and the conversations (conv, n_turns).

    The turns are range-sorted, so that a conversation of any length is dealt to as many
    tasks as it takes; each numbers its own stretch, and the stretches before are added.
    """
    kind = turns.schema["conv"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = column(batch, "conv").to_numpy(zero_copy_only=False)
            index = np.arange(len(conv))
            new = np.append(conv[0] != last, conv[1:] != conv[:-1]) if last is not None else np.append(True, conv[1:] != conv[:-1])
            begin = np.maximum.accumulate(np.where(new, index, -1))
            local = np.where(begin < 0, at + index + 1, index - begin + 1)
            last, at = conv[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([column(batch, "conv"), column(batch, "lot"), pa.array(local, pa.int64()), column(batch, "digest"), column(batch, "words")], ["conv", "lot", "local", "digest", "words"])

    order = ["conv", "turn", "digest", "_row"]
    dealt = turns.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv", F.spark_partition_id().alias("lot"), "digest", "words").mapInArrow(number, f"conv {kind}, lot int, local bigint, digest binary, words bigint")
    dealt = staging.keep(dealt, "ranked")
    held = dealt.groupBy("conv", "lot").agg(F.count("*").alias("n"))
    stretches = held.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("lot")) - F.col("n"))
    stretches = staging.keep(stretches, "stretches")
    convs = stretches.groupBy("conv").agg(F.sum("n").alias("n_turns"))
    # Only a conversation that a border cuts has a later stretch: at most one for each border between tasks.
    later = staging.keep(stretches.where("before > 0").select("conv", "lot", "before"), "later")
    placed = dealt.join(broadcast_if_small(later), ["conv", "lot"], "left")
    return placed.select("conv", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words"), convs


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (conv, lot, d): the chained digest of a lot's rows so far, ``inner``, and that before, ``prior``."""
    group, state = None, b""
    for batch in batches:
        inner, prior = [], []
        for conv, lot, digest in zip(*(column(batch, c).to_pylist() for c in ("conv", "lot", "digest")), strict=True):
            if (conv, lot) != group:
                group, state = (conv, lot), b""
                prior.append(None)
            else:
                prior.append(state)
            state = hashlib.sha256(state + digest).digest()[:16]
            inner.append(state)
        kept = [column(batch, c) for c in ("conv", "lot", "d", "words", "last")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(inner, pa.binary()), pa.array(prior, pa.binary())], ["conv", "lot", "d", "words", "last", "inner", "prior"])


def _chain_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the full lots sorted by (conv, lot): the name of the beginning that ends there, for the lot that follows."""
    group, state = None, b""
    for batch in batches:
        outer = []
        for conv, inner in zip(column(batch, "conv").to_pylist(), column(batch, "inner").to_pylist(), strict=True):
            state = hashlib.sha256(state + inner).digest()[:16] if conv == group else inner
            group = conv
            outer.append(state)
        yield pa.RecordBatch.from_arrays([column(batch, "conv"), pa.compute.add(column(batch, "lot"), 1), pa.array(outer, pa.binary())], ["conv", "lot", "outer"])


def beginnings(turns: DataFrame, staging: Staging) -> DataFrame:
    """(conv, d, key, parent, words, last) of turns (conv, d, digest, words, last): the digests of the first d and d-1 turns."""
    kind = turns.schema["conv"].dataType.simpleString()
    dealt = turns.withColumn("lot", F.floor((F.col("d") - 1) / LOT).cast("long")).repartition("conv", "lot").sortWithinPartitions("conv", "lot", "d")
    chained = dealt.select("conv", "lot", "d", "words", "last", "digest").mapInArrow(_chain, f"conv {kind}, lot bigint, d bigint, words bigint, last boolean, inner binary, prior binary")
    chained = staging.keep(chained, "chained")
    short = chained.where("lot = 0").select("conv", "d", F.col("inner").alias("key"), F.coalesce("prior", F.lit(ROOT)).alias("parent"), "words", "last")
    ends = chained.where(F.col("d") % LOT == 0).select("conv", "lot", "inner").repartition("conv").sortWithinPartitions("conv", "lot")
    outer = ends.mapInArrow(_chain_lots, f"conv {kind}, lot bigint, outer binary")
    long = chained.where("lot > 0").join(outer, ["conv", "lot"])
    named = lambda c: short_digest(F.col("outer"), F.col(c))
    return short.union(long.select("conv", "d", named("inner"), F.when(F.col("prior").isNull(), F.col("outer")).otherwise(named("prior")), "words", "last"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv): the SHA-256 of a key's ids, ascending, joined by commas.

    The ids are range-sorted by key and id, so a key of any number is joined to strings by many tasks; only
    these strings, each of up to 4096 ids, meet for the digest, which takes them one after the other.
    """
    kind = ends.schema["conv"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for k, c in zip(column(batch, "key").to_pylist(), column(batch, "conv").to_pylist(), strict=True):
                if held and (k != key or len(held) >= JOINED):
                    for o, v in zip(out, (key, held[0], ",".join(map(str, held))), strict=True):
                        o.append(v)
                    held = []
                key = k
                held.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1]).cast(batch.schema.field("conv").type), pa.array(out[2], pa.string())], ["key", "first", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([held[0]], batch.schema.field("conv").type), pa.array([",".join(map(str, held))])], ["key", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, made = [], []
            for k, ids in zip(column(batch, "key").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                if state is not None and k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    keys.append(key)
                    made.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    joined = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(join, f"key binary, first {kind}, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def roll_up(nodes: DataFrame, staging: Staging, sums: list[str]) -> DataFrame:
    """``nodes`` (key, parent, depth, pointing, conv, ``sums``, ...) with each of ``sums`` added up over subtrees, and ``parent_conv``.

    ``parent`` is null for a root only, ``pointing`` is the number of children.
    """
    root = nodes.where("depth = 0").first()
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    n = nodes.count()
    current = nodes.withColumn("jump", F.col("parent")).withColumn("parent_conv", F.when(F.col("depth") == 1, F.lit(root and root["conv"])).cast(nodes.schema["conv"].dataType))
    k = 0
    while 1 << k <= deepest:
        # Each node hands its sums to the ancestor at distance 2**k.
        handed = current.where("jump is not null").groupBy(F.col("jump").alias("_to")).agg(*[F.sum(s).alias(f"_{s}") for s in sums], F.count("*").alias("_pointing"))
        met = current.join(handed, F.col("key") == F.col("_to"), "left")
        added = {s: F.col(s) + F.coalesce(f"_{s}", F.lit(0)) for s in sums} | {"pointing": F.coalesce("_pointing", F.lit(0)).cast("long")}
        current = met.withColumns(added).select(*current.columns)
        if k == 0:
            current = current.withColumn("n_children", F.col("pointing"))
        current = staging.keep(current, f"sums-{k}")
        # It learns the ancestor of that ancestor; nearer to the root there is none.
        far = current.where(F.col("depth") >= 2 << k)
        near = current.where(F.col("depth") < 2 << k).withColumn("jump", F.lit(None).cast("binary"))
        seen = current.where((F.col("depth") >= 1 << k) & (F.col("pointing") > 0)).select(F.col("key").alias("jump"), F.col("jump").alias("_next"), F.col("conv").alias("_conv"), F.col("pointing").alias("_weight"))
        jumped = left_join_hot(far, seen, ["jump"], "_weight", max(2, n // HOT_SHARE), F.xxhash64("key"))
        if k == 0:
            jumped = jumped.withColumn("parent_conv", F.col("_conv"))
        jumped = jumped.withColumn("jump", F.col("_next")).select(*current.columns)
        before, current = k, staging.keep(jumped.union(near.select(*current.columns)), f"jumps-{k}") if 2 << k <= deepest or k == 0 else near.select(*current.columns)
        if before:
            staging.drop(f"sums-{before - 1}", f"jumps-{before - 1}")
        k += 1
    return current if k else current.withColumn("n_children", F.lit(0).cast("long"))


def conversation_trie(turns: DataFrame, convs: DataFrame, staging: Staging) -> DataFrame:
    """One row per node of the tree of beginnings.

    ``turns`` has (conv, d, digest, words, last): one row for each conversation and place d = 1, 2, ...
    without gaps, ``last`` on its last turn.  ``convs`` has (conv, empty): every conversation once, ``empty`` if it has no turn.

    Columns: ``conv_id``, the smallest member; ``depth``; ``parent_conv_id`` (root: null); ``n_convs``,
    members; ``n_children``; ``n_leaves`` and ``saved_tokens``, over the subtree with its top; ``ends_sha256``,
    the digest of the members that end here.  No conversations give no nodes.
    """
    paths = staging.keep(beginnings(turns, staging), "beginnings")
    nodes = paths.groupBy("key").agg(F.min("parent").alias("parent"), F.min("d").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    root = convs.agg(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    nodes = staging.keep(nodes.union(root.where("n_convs > 0")), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("_parent")).agg(F.count("*").alias("pointing"))
    met = nodes.join(children, F.col("key") == F.col("_parent"), "left").withColumn("pointing", F.coalesce("pointing", F.lit(0)))
    own = met.select("key", "parent", "depth", "conv", "n_convs", "pointing", F.when(F.col("pointing") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    rolled = roll_up(staging.keep(own, "own"), staging, ["n_leaves", "saved_tokens"])
    ends = paths.where("last").select("key", "conv").union(convs.where("empty").select(F.lit(ROOT), "conv"))
    out = rolled.join(end_digests(ends).withColumnRenamed("key", "_end"), F.col("key") == F.col("_end"), "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
