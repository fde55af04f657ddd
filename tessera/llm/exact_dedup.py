"""Exact dedup by composable polynomial fingerprints.

The fingerprint of a byte string s of n bytes is the sum of s[i] * B ** (n-1-i)
modulo a prime, for two primes.  A piece also carries B ** n, its shift; the
fingerprint of two pieces in a row is ``left * shift_of_right + right``, so
pieces can be hashed apart, in any task, and combined afterwards.

1. Each text is cut into pieces of ``piece_bytes``; tasks hash pieces with numpy.
   Texts of more than one piece are combined by their row in SQL.
2. Rows are grouped by fingerprint and length (partial sums first).  Keys that
   hold very many rows are joined back by broadcast, the others by shuffle.
3. Within a group every text is compared with the text of its representative,
   piece by piece: both are cut, pieces meet by (group, lot, number), and a row
   is confirmed if all its pieces are equal.  The representative of a large group
   is fetched once and then copied, in two steps, to one lot for each ``lot_rows`` rows, so no
   task gets a whole group.  Rows that differ (equal fingerprints of different texts) form a new
   group and are compared again, until none is left.

Only ids and fingerprints of all rows are shuffled; texts are shuffled only
for groups of two or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import column, slices, utf8
from tessera.plans.joins import broadcast_if_small, left_join_hot
from tessera.plans.staging import Staging

#: Two primes under 2**31, so that products of two residues fit into 63 bits; and a base for each.
PRIMES = (2147483629, 2147483587)
BASES = (1103515245, 1220703125)


def _powers(n: int, primes: tuple[int, int]) -> list[np.ndarray]:
    """B**0 ... B**(n-1) for each prime, by doubling."""
    out = []
    for p, b in zip(primes, BASES, strict=True):
        have = np.ones(1, np.int64)
        while len(have) < n:
            step = pow(b, len(have), p)
            have = np.concatenate((have, have * step % p))
        out.append(have[:n])
    return out


def fingerprint_pieces(pieces: list[bytes], powers: list[np.ndarray], primes: tuple[int, int] = PRIMES) -> list[tuple[int, ...]]:
    """(h1, shift1, h2, shift2) of each piece; ``powers`` reach beyond the longest piece."""
    out = []
    for piece in pieces:
        data = np.frombuffer(piece, np.uint8).astype(np.int64)
        row: list[int] = []
        for pw, p in zip(powers, primes, strict=True):
            row += [int((data * pw[len(data) - 1 :: -1][: len(data)]).sum() % p) if len(data) else 0, int(pw[len(data)])]
        out.append(tuple(row))
    return out


def _combined(parts: Column, h: str, shift: str, p: int) -> Column:
    """The fingerprint of all parts in a row (an array sorted by number)."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: (acc * x[shift] + x[h]) % p)


def _pieces(text: Column, size: int) -> Column:
    """(no, piece) for each ``size`` bytes of a text's UTF-8; one empty piece for an empty text."""
    raw = F.encode(text, "UTF-8")
    last = F.greatest(F.floor((F.octet_length(raw) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("no"), F.substring(raw, i * size + 1, F.lit(size)).alias("piece")))


def fingerprints(df: DataFrame, staging: Staging, piece_bytes: int, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(_id, _sha, n_bytes, f1, f2) of each row of (_id, _text), staged."""
    powers = _powers(piece_bytes + 1, primes)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece"):
            pieces = utf8(column(batch, "piece"))
            rows = fingerprint_pieces(pieces, powers, primes)
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            kept = [column(batch, c) for c in ("_id", "_sha", "_row", "n_pieces", "no")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(map(len, pieces), pa.int64()), *numbers], ["_id", "_sha", "_row", "n_pieces", "no", "n", "h1", "s1", "h2", "s2"])

    kind = df.schema["_id"].dataType.simpleString()
    cut = df.select("_id", F.sha2(F.encode("_text", "UTF-8"), 256).alias("_sha"), F.monotonically_increasing_id().alias("_row"), _pieces(F.col("_text"), piece_bytes).alias("_p"))
    cut = cut.select("_id", "_sha", "_row", F.size("_p").alias("n_pieces"), F.explode("_p").alias("_q")).select("_id", "_sha", "_row", "n_pieces", "_q.no", "_q.piece")
    hashed = cut.mapInArrow(hash_rows, f"_id {kind}, _sha string, _row bigint, n_pieces int, no int, n bigint, h1 bigint, s1 bigint, h2 bigint, s2 bigint")
    hashed = staging.keep(hashed, "pieces")
    one = hashed.where("n_pieces = 1").select("_id", "_sha", F.col("n").alias("n_bytes"), F.col("h1").alias("f1"), F.col("h2").alias("f2"))
    parts = hashed.where("n_pieces > 1").groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_sha").alias("_sha"), F.sum("n").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("no", "h1", "s1", "h2", "s2"))).alias("p"))
    many = parts.select("_id", "_sha", "n_bytes", _combined(F.col("p"), "h1", "s1", primes[0]).alias("f1"), _combined(F.col("p"), "h2", "s2", primes[1]).alias("f2"))
    return one.unionByName(many)


def _copied(heads: DataFrame) -> DataFrame:
    """(keep_id, no, piece, lot) for each of the ``lots`` of each piece of (keep_id, no, piece, lots).

    In two steps of about the square root of ``lots``, with a shuffle between them, so that no task
    writes all copies of one text.  A representative whose row is repeated is taken once.
    """
    once = heads.groupBy("keep_id", "no").agg(F.first("piece").alias("piece"), F.first("lots").alias("lots"))
    wide = once.withColumn("wide", F.ceil(F.sqrt("lots")).cast("long"))
    first = wide.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1, F.col("wide"))))
    dealt = first.repartition("keep_id", "no", "begin")
    return dealt.select("keep_id", "no", "piece", F.explode(F.sequence("begin", F.least(F.col("begin") + F.col("wide"), F.col("lots")) - 1)).alias("lot"))


def _confirm(docs: DataFrame, members: DataFrame, staged: Callable[[DataFrame, str], DataFrame], piece_bytes: int, lot_rows: int) -> DataFrame:
    """(_id, _sha, keep_id, same): whether the text of each member equals that of its representative.

    ``members`` has (_id, _sha, keep_id, keep_sha, size) of rows that are no
    representatives; ``staged`` keeps a table under a name.
    """
    lots = F.ceil(F.col("size") / lot_rows).cast("long")
    rows = members.select("_id", "_sha", "keep_id", F.pmod(F.xxhash64("_id", "_sha"), lots).alias("lot"), F.lit(None).cast("long").alias("lots"))
    heads = members.groupBy("keep_id", "keep_sha").agg(F.max(lots).alias("lots"))
    heads = heads.select(F.col("keep_id").alias("_id"), F.col("keep_sha").alias("_sha"), "keep_id", F.lit(None).cast("long").alias("lot"), "lots")
    wanted = broadcast_if_small(staged(rows.unionByName(heads), "wanted"))
    texts = docs.select("_id", F.sha2(F.encode("_text", "UTF-8"), 256).alias("_sha"), "_text")
    cut = texts.join(wanted, ["_id", "_sha"]).select("_id", "_sha", "keep_id", "lot", "lots", F.explode(_pieces(F.col("_text"), piece_bytes)).alias("q"))
    cut = staged(cut.select("_id", "_sha", "keep_id", "lot", "lots", F.col("q.no").alias("no"), F.col("q.piece").alias("piece")), "fetched")
    left = cut.where("lot is not null").drop("lots")
    right = _copied(cut.where("lots is not null").select("keep_id", "no", "piece", "lots"))
    right = right.select(F.col("keep_id").alias("_k"), F.col("lot").alias("_l"), F.col("no").alias("_n"), F.col("piece").alias("other"))
    met = left.join(right, (F.col("keep_id") == F.col("_k")) & (F.col("lot") == F.col("_l")) & (F.col("no") == F.col("_n")), "left")
    return met.groupBy("_id", "_sha", "keep_id").agg(F.min(F.coalesce(F.col("piece") == F.col("other"), F.lit(False))).alias("same"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 1 << 16, lot_rows: int = 64, hot_share: int = 2000, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are identical; null counts as empty.  Of equal texts
    the row with the largest id stays.  Ids identify rows: a repeated row (same
    id, same text) counts in ``group_size`` each time and each of its copies is
    kept or dropped alike; one id with two texts is two documents.  Null ids
    sort below all others.  Other columns are not read; an empty table gives an
    empty result.  Keys with ``1 / hot_share`` of all rows or more are treated as hot.
    """
    staging = Staging(df.sparkSession, "exact-dedup")
    kind = df.schema[id_col].dataType
    # A null id needs a value of its own for the joins; ids are compared as (null first, id).
    docs = df.select(df[id_col].alias("_id"), F.coalesce(df[text_col], F.lit("")).alias("_text"))
    marked = docs.select(F.struct(F.col("_id").isNotNull().alias("known"), F.coalesce("_id", F.lit(0).cast(kind)).alias("v")).alias("_id"), "_text")
    rows = staging.keep(fingerprints(marked, staging, piece_bytes, primes), "rows")
    staging.drop("pieces")
    key = ["n_bytes", "f1", "f2"]
    groups = rows.groupBy(*key).agg(F.max(F.struct("_id", "_sha")).alias("head"), F.count("*").alias("size")).where("size > 1")
    groups = staging.keep(groups.select(*key, F.col("head._id").alias("keep_id"), F.col("head._sha").alias("keep_sha"), "size"), "groups")
    hot = max(2, rows.count() // hot_share)
    grouped = left_join_hot(rows, groups, key, "size", hot, F.xxhash64("_id", "_sha"))
    grouped = staging.keep(grouped, "grouped")

    # Compare; what differs from its representative is grouped and compared again.
    todo = grouped.where("keep_id is not null").select("_id", "_sha", "keep_id", "keep_sha", "size", *key).distinct()
    found, k = [], 0
    while True:
        members = staging.keep(todo.where((F.col("_id") != F.col("keep_id")) | (F.col("_sha") != F.col("keep_sha"))), f"members{k}")
        if not members.count():
            break
        same = staging.keep(_confirm(marked, members, lambda x, name, k=k: staging.keep(x, f"{name}{k}"), piece_bytes, lot_rows), f"same{k}")
        staging.drop(f"fetched{k}", f"wanted{k}")
        found.append(same.where("same").select("_id", "_sha", F.col("keep_id").alias("to")))
        other = same.where("not same").select("_id", "_sha")
        if not other.count():
            break
        # Different texts with one fingerprint: they form groups of their own.
        left = members.join(other, ["_id", "_sha"]).select("_id", "_sha", *key)
        heads = left.groupBy(*key).agg(F.max(F.struct("_id", "_sha")).alias("head"), F.count("*").alias("size")).select(*key, F.col("head._id").alias("keep_id"), F.col("head._sha").alias("keep_sha"), "size")
        todo = staging.keep(left.join(heads, key), f"todo{k + 1}")
        k += 1
    out = grouped
    if k:  # there were collisions: sizes are counted anew
        moved = found[0]
        for f in found[1:]:
            moved = moved.unionByName(f)
        out = grouped.drop("keep_id", "keep_sha", "size").join(moved, ["_id", "_sha"], "left").withColumn("keep_id", F.coalesce("to", "_id")).drop("to")
        out = staging.keep(out, "moved")
        sizes = out.groupBy("keep_id", "n_bytes", "f1", "f2").agg(F.count("*").alias("size"))
        out = left_join_hot(out, staging.keep(sizes, "sizes"), ["keep_id", *key], "size", hot, F.xxhash64("_id", "_sha"))
    back = lambda c: F.when(c["known"], c["v"])
    keep = F.coalesce(F.col("keep_id"), F.col("_id"))
    return out.select(
        back(F.col("_id")).alias(id_col),
        back(keep).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (keep == F.col("_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
