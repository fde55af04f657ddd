"""MinHash near-dedup with b-bit signatures.

1. One narrow pass hashes the word shingles of each text, takes ``bands * rows``
   minima, keeps their low four bits packed into 64-bit words, and hashes each
   band of minima.  Texts with the same set of shingles (a 128-bit hash of the
   set) are one class, represented by its smallest id.
2. Classes that share a band bucket are candidates.  First each bucket's
   smallest id is paired with the others: a star, not all pairs.  A pair goes
   on if the similarity estimated from the bits that agree, corrected for
   chance agreement, is within six standard deviations of the threshold, and is
   then confirmed on both full sets of shingles.
3. Pairs in one component need no further look.  Where a bucket holds several
   components after that, the packed signatures of its members are compared across
   components by bit counts, in blocks of bounded size that are spread over tasks; only
   members that are likely enough to have a link there are compared on their full sets, in blocks too.

With 24 bands of 4 rows a pair of similarity 0.8 shares no bucket with a
probability of 3e-6, and one above it with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import column, forget, slices, utf8
from tessera.plans.components import connected_components
from tessera.plans.joins import broadcast_if_small, left_join_hot
from tessera.plans.staging import Staging

BANDS, ROWS, BITS = 24, 4, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of a word; forgets all words when there are very many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole text if it has fewer."""
    w = np.fromiter(map(hashes.__getitem__, (text or b"").lower().split()), np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ w[k : len(w) - n + 1 + k]) * _A
        h ^= h >> np.uint64(31)
    return np.unique(mix(h))


def _constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, count, np.uint32)[:, None]


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set, in bounded memory."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        out = np.minimum(out, (x[None, i : i + 2048] * a + b).min(1))
    return out


def packed(m: np.ndarray) -> list[int]:
    """The low ``BITS`` bits of the minima in 64-bit words."""
    per = 64 // BITS
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64).tolist()


def band_keys(m: np.ndarray, bands: int) -> list[int]:
    h = np.arange(1, bands + 1, dtype=np.uint64) * _B
    for c in m.reshape(bands, -1).T:
        h = (h ^ c.astype(np.uint64)) * _A
        h ^= h >> np.uint64(31)
    return mix(h).view(np.int64).tolist()


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(_id, n_shingles, s1, s2, sig, keys) of each row of (_id, _text); nulls for texts without words."""
    if bands * rows * BITS % 64:
        raise ValueError("bands * rows must be a multiple of 16")
    kind = docs.schema["_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = WordHashes()
        a, b = _constants(bands * rows)
        for batch in slices(batches, "_text"):
            n, s1, s2, sig, keys = [], [], [], [], []
            for text in utf8(column(batch, "_text")):
                s = shingle_set(text, words, hashes)
                n.append(len(s))
                if len(s):
                    m = minima(s, a, b)
                    s1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    s2.append(int(mix(s ^ _A).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(packed(m))
                    keys.append(band_keys(m, bands))
                else:
                    for out in (s1, s2, sig, keys):
                        out.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, longs), pa.array(keys, longs)], ["_id", "n_shingles", "s1", "s2", "sig", "keys"])

    return docs.mapInArrow(sign, f"_id {kind}, n_shingles bigint, s1 bigint, s2 bigint, sig array<bigint>, keys array<bigint>")


def agreeing(x: Column, y: Column, n: int) -> Column:
    """How many of ``n`` packed minima agree in all their bits."""
    apart = F.lit(0)
    for k in range(n * BITS // 64):
        d = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        apart = apart + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(n) - apart


#: A leader with more than this part of all pairs learns its lots by broadcast; there are at most so many.
HOT_LEADERS = 200


def least_agreeing(n: int, percent: int) -> int:
    """The agreements that a pair at the threshold has at least, but for six standard deviations."""
    j, chance = percent / 100, 2.0**-BITS
    least = j - 6 * (j * (1 - j) / n) ** 0.5
    return int(np.floor(n * (chance + (1 - chance) * max(0.0, least))))


def _sets(docs: DataFrame, ids: DataFrame, words: int, repeats: bool) -> DataFrame:
    """(_id, set) of the documents among ``ids``: their shingle hashes as bytes.  ``repeats``: ids may repeat; equal sets of one id are one row."""
    kind = docs.schema["_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = WordHashes()
        for batch in slices(batches, "_text"):
            made = [shingle_set(t, words, hashes).tobytes() for t in utf8(column(batch, "_text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(made, pa.binary())], ["_id", "set"])

    made = docs.join(broadcast_if_small(ids), "_id").select("_id", "_text").mapInArrow(build, f"_id {kind}, set binary")
    return made.distinct() if repeats else made


def with_lots(pairs: DataFrame, staging: Staging, name: str, per_lot: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, lot) with those of one ``a`` dealt to lots of about ``per_lot``, and the lots (a, lot) of every ``a``.

    What belongs to ``a`` is then met once in each lot, so the leader of very many pairs is no task's burden.
    """
    many = staging.keep(pairs.groupBy("a").agg(F.count("*").alias("n")), f"{name}-many")
    lots = F.ceil(F.col("n") / per_lot)
    known = left_join_hot(pairs, many, ["a"], "n", max(2, pairs.count() // HOT_LEADERS), F.xxhash64("b"))
    dealt = known.select("a", "b", F.pmod(F.xxhash64("b"), lots).cast("int").alias("lot"))
    return dealt, many.select("a", F.explode(F.sequence(F.lit(0), (lots - 1).cast("int"))).alias("lot"))


def confirmed(docs: DataFrame, pairs: DataFrame, staging: Staging, name: str, words: int, percent: int, repeats: bool) -> DataFrame:
    """The pairs (a, b) whose full sets meet ``100 * common >= percent * union``, staged."""
    ids = staging.keep(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    sets = staging.keep(_sets(docs, ids, words, repeats), f"{name}-sets")
    kind = pairs.schema["a"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "right"):
            ok = []
            for x, y in zip(column(batch, "left").to_pylist(), column(batch, "right").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], ["a", "b"]).filter(pa.array(ok))

    dealt, lots = with_lots(pairs, staging, name)
    left = lots.join(sets.select(F.col("_id").alias("a"), F.col("set").alias("left")), "a")
    met = dealt.join(sets.select(F.col("_id").alias("b"), F.col("set").alias("right")), "b").join(left, ["a", "lot"])
    out = staging.keep(met.select("a", "b", "left", "right").mapInArrow(check, f"a {kind}, b {kind}"), name)
    staging.drop(f"{name}-ids", f"{name}-sets", f"{name}-many")
    return out.distinct() if repeats else out


def _dealt(held: DataFrame, weight: Column, budget: int, *columns: str) -> DataFrame:
    """Each row of a bucket once for each pair of blocks (lo, hi) that its block is in; a block has about ``budget`` of ``weight``."""
    blocks = F.greatest(F.ceil(weight / budget), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")
    dealt = held.withColumn("_blocks", blocks).withColumn("_mine", mine).select("bucket", "_id", "comp", *columns, "_mine", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return dealt.withColumn("lo", F.least("_mine", "_other")).withColumn("hi", F.greatest("_mine", "_other"))


def _likely_across(held: DataFrame, n: int, least: int, block_rows: int = 2048) -> DataFrame:
    """(_id) of the members of ``held`` (bucket, held, _id, comp, sig) whose signature agrees with one of another component often enough."""
    kind = held.schema["_id"].dataType.simpleString()
    lows = np.uint64(0x1111111111111111)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        forget()
        ids, comp = g["_id"].to_numpy(), g["comp"].to_numpy()
        names, members = np.unique(comp, return_counts=True)
        found = np.zeros(len(ids), bool)
        if len(names) > 1:
            sig = np.stack(g["sig"].to_numpy()).astype(np.int64).view(np.uint64)
            for i in np.flatnonzero(comp != names[members.argmax()]):
                d = sig ^ sig[i]
                d |= d >> np.uint64(1)
                d |= d >> np.uint64(2)
                near = (n - np.bitwise_count(d & lows).sum(1, dtype=np.int64) >= least) & (comp != comp[i])
                found |= near
                found[i] |= near.any()
        return pd.DataFrame({"_id": ids[found]})

    return _dealt(held, F.col("held"), block_rows, "sig").groupBy("bucket", "lo", "hi").applyInPandas(compare, f"_id {kind}").distinct()


def _links_across(held: DataFrame, percent: int, budget: int) -> DataFrame:
    """Links (a, b) between different components within buckets that hold several.

    ``held`` has (bucket, weight, _id, comp, set), weight being all shingles of the bucket.  A bucket is dealt into blocks
    of about ``budget`` shingles, and each pair of blocks is compared by itself on
    full sets.  No pair leaves a task but links, and of those only as many as it
    takes to connect what is linked.
    """
    dealt = _dealt(held, F.col("weight"), budget, "set")
    kind = held.schema["_id"].dataType.simpleString()

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        forget()
        ids, comp = g["_id"].to_numpy(), g["comp"].to_numpy()
        root = {c: c for c in set(comp.tolist())}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        a, b = [], []
        if len(root) > 1:
            sets = [np.frombuffer(x, np.uint64) for x in g["set"]]
            sizes = np.array([len(x) for x in sets])
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            marked = np.zeros(code.max() + 1, bool)
            names, members = np.unique(comp, return_counts=True)
            for i in np.flatnonzero(comp != names[members.argmax()]):
                own = code[starts[i] : starts[i] + sizes[i]]
                marked[own] = True
                common = np.add.reduceat(marked[code], starts, dtype=np.int64)
                marked[own] = False
                for j in np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common)):
                    x, y = find(comp[i].item()), find(comp[j].item())
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(ids[i])
                        b.append(ids[j])
        return pd.DataFrame({"a": np.array(a, ids.dtype), "b": np.array(b, ids.dtype)})

    return dealt.groupBy("bucket", "lo", "hi").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, hot_share: int = 2000, block_shingles: int = 1 << 17
) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id``, ``kept``.

    Texts are lower-cased in A-Z and split at ASCII white space.  Two are linked
    if their sets of distinct shingles meet ``100 * common >= percent * union``;
    a text with fewer words is one shingle; a null text or one without words is
    linked with nothing.  A component is named by its smallest id, whose row is
    kept (all its rows, if they repeat).  Rows that share an id count as one
    document.  A null id is linked with nothing and kept.  An empty table gives
    an empty result; other columns are not read.
    """
    staging = Staging(df.sparkSession, "near-dedup")
    n, least = bands * rows, least_agreeing(bands * rows, percent)
    docs = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"))
    sigs = staging.keep(signatures(docs, words, bands, rows).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    usable = sigs.where("_id is not null and s1 is not null")
    # One row stands for all with the same shingles, however often it is repeated.
    groups = staging.keep(usable.groupBy("s1", "s2").agg(F.min("_id").alias("cls"), F.min_by("_row", "_id").alias("_row"), F.count("*").alias("size")), "classes")
    reps = staging.keep(usable.select("_row", "_id", "n_shingles", "sig", "keys").join(groups.select("_row"), "_row").select("_id", "n_shingles", "sig", "keys"), "representatives")
    # Ids repeat where rows do, and where one id has several texts.
    repeats = usable.select("_id").distinct().count() < usable.count()

    # Stars: the smallest id of each bucket with its other members.
    buckets = reps.select("_id", F.explode("keys").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("_id").alias("leader"), F.count("*").alias("held")).where("held > 1")
    leaders = staging.keep(leaders, "leaders")
    stars = left_join_hot(buckets, leaders, ["bucket"], "held", max(2, reps.count() * bands // HOT_LEADERS), F.xxhash64("_id")).where("leader is not null")
    stars = staging.keep(stars.select("bucket", "held", "leader", "_id"), "stars")
    pairs = staging.keep(stars.where("leader <> _id").select(F.col("leader").alias("a"), F.col("_id").alias("b")).distinct(), "star-pairs")
    sig = reps.select("_id", "sig")
    dealt, lots = with_lots(pairs, staging, "stars")
    with_a, with_b = lots.join(sig.toDF("a", "sig_a"), "a"), sig.toDF("b", "sig_b")
    likely = dealt.join(with_b, "b").join(with_a, ["a", "lot"]).where(agreeing(F.col("sig_a"), F.col("sig_b"), n) >= least).select("a", "b")
    likely = staging.keep(likely.distinct() if repeats else likely, "likely")
    edges = confirmed(docs, likely, staging, "links", words, percent, repeats)
    labels = connected_components(edges, staging, "first")

    # Buckets that still hold several components: all their pairs across components.
    known = labels.select(F.col("v").alias("_v"), F.col("label").alias("_label"))
    where = broadcast_if_small(known)
    placed = stars.join(where, F.col("_id") == F.col("_v"), "left").withColumn("comp", F.coalesce("_label", "_id")).drop("_v", "_label")
    placed = placed.join(where, F.col("leader") == F.col("_v"), "left").withColumn("lead_comp", F.coalesce("_label", "leader")).drop("_v", "_label")
    placed = staging.keep(placed, "placed")
    mixed = placed.where("comp <> lead_comp and held > 2").select("bucket").distinct()
    mixed = staging.keep(mixed, "mixed")
    if mixed.count():
        # The star's pairs are settled, so the leaders stay out.
        held = placed.join(broadcast_if_small(mixed), "bucket", "left_semi").where("_id <> leader").select("bucket", "held", "_id", "comp")
        held = staging.keep(held.join(sig, "_id"), "held")
        likely = staging.keep(_likely_across(held, n, least), "late-likely")
        sets = staging.keep(_sets(docs, likely, words, repeats), "held-sets")
        near = staging.keep(held.drop("sig", "held").join(sets.select("_id", (F.octet_length("set") / 8).alias("size")), "_id"), "late-held")
        near = near.join(near.groupBy("bucket").agg(F.sum("size").alias("weight")), "bucket")
        late = staging.keep(_links_across(near.join(sets, "_id"), percent, block_shingles), "late-links")
        staging.drop("held", "held-sets", "late-held")
        if late.count():
            labels = connected_components(edges.union(late), staging, "second")

    found = groups.join(labels.select(F.col("v").alias("cls"), "label"), "cls", "left").select("s1", "s2", "size", F.coalesce("label", "cls").alias("component"))
    found = staging.keep(found, "found")
    # Rows without shingles or id have no class; a key of their own keeps them apart.
    keyed = sigs.select("_id", "n_shingles", *[F.when(F.col("_id").isNotNull(), F.col(c)).alias(c) for c in ("s1", "s2")])
    lone = keyed.where("s1 is null").select("_id", "n_shingles", F.col("_id").alias("component"))
    rest = left_join_hot(keyed.where("s1 is not null"), found, ["s1", "s2"], "size", max(2, sigs.count() // hot_share), F.xxhash64("_id"))
    every = rest.select("_id", "n_shingles", "component").union(lone)
    return every.select(F.col("_id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("_id") == F.col("component"), F.lit(True)).alias("kept"))
