"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document's tokens are its ids and one separator id.  Only documents longer
than a sequence are cut, into pieces of a whole sequence and a rest.

Packing is bulk-synchronous best-fit decreasing.  Pieces are range-sorted by
length (a distributed sort), and each gets its rank among the pieces of its
length: tasks count along their sorted rows, and the counts of each task and
length, at most tasks + ``capacity`` of them, are added up.  Pieces of one
length are interchangeable, as are sequences with the same gap, so the sweeps
go over classes: lengths with their number of pieces, gaps with their runs of
sequences, at most ``capacity`` of either whatever the corpus is.  In each
round the longest unplaced class looks for its successor, the smallest gap that
holds it, and as many pieces as that class of gaps has sequences are placed at
once; competing pieces are settled by rank; the gaps are updated; the round
repeats until nothing fits, and then the class opens sequences.  A round
yields intervals (length, ranks) -> (sequences, offset), and a last narrow pass
gives each piece the place of its rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import column, slices
from tessera.llm.tokens import STRETCH, default_vocabulary, word_ids
from tessera.plans.staging import Staging

_PIECE = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, separator: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every row, in one narrow pass.

    A null or empty text is one piece that holds the separator alone.  Each row
    is a document of its own, whatever its id; other columns are not read.
    ``vocabulary`` is the path of a tokenizer file that the executors can read.
    """
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end = np.array([separator], "<u4")
        for batch in slices(batches, "_text", STRETCH):
            texts = column(batch, "_text")
            if len(texts) == 1:  # it may be a very long one
                made = [words.encode((texts[0].as_py() or "").encode())]
            else:
                flat, begin = words.encode_all(texts)
                made = [flat[i:j] for i, j in zip(begin, begin[1:], strict=False)]
            take, rows = [], []
            for k, own in enumerate(made):
                ids = np.concatenate((own, end))
                for no, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    take.append(k)
                    rows.append((no, start, len(part), zlib.crc32(part.tobytes())))
            numbers = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_PIECE)]
            yield pa.RecordBatch.from_arrays([column(batch, "_id").take(pa.array(take)), *numbers], ["_id", *(n for n, _ in _PIECE)])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"))
    return rows.mapInArrow(cut, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("_id", id_col)


def best_fit_plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: rows (length, rank, n, sequence, offset).

    The ``n`` pieces of that length from ``rank`` on go to the sequences from
    ``sequence`` on, one each, at ``offset``.  ``counts`` has the number of
    pieces by length, 1 to ``capacity``.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, number of sequences)
    gaps: list[int] = []  # those with runs, ascending
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect.bisect_left(gaps, length)  # the successor
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
                take = min(n, total - rank)
                add(gap, first + take, n - take)
            else:
                gap, first, take = capacity, opened, -(-(total - rank) // (capacity // length))
                opened += take
            placed.append((length, rank, take, first, capacity - gap))
            rank += take
            add(gap - length, first, take)
    return pd.DataFrame(placed, columns=["length", "rank", "n", "sequence", "offset"]).astype(np.int64)


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every row is placed in full, sequences have no gaps inside.

    Lengths must be 1 to ``capacity``; a null or other length raises ValueError.
    Rows of equal length are ordered by their other columns; repeated rows
    are placed like different ones.  Sequence ids count from 0 without gaps.  An
    empty table gives an empty result.
    """
    if {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError("the table has a column sequence_id or offset")
    staging = Staging(pieces.sparkSession, "packing")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = column(batch, length_col).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.diff(lengths)) + 1
            begin = np.repeat(np.concatenate(([0], new)), np.diff(np.concatenate(([0], new, [len(lengths)]))))
            rank = np.arange(len(lengths)) - begin
            rank[: new[0] if len(new) else len(lengths)] += seen if lengths[0] == last else 0
            last, seen = lengths[-1], rank[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(rank, pa.int64())], [*batch.schema.names, "_part", "_rank"])

    names = pieces.columns
    rest = [c for c in names if c != length_col]
    ordered = pieces.repartitionByRange(length_col, *rest).sortWithinPartitions(length_col, *rest)
    wide = pieces.limit(0).withColumns({"_part": F.lit(0), "_rank": F.lit(0).cast("long")}).schema
    rows = staging.keep(ordered.mapInArrow(ranked, wide), "ranked")
    tally = rows.groupBy("_part", length_col).count().toPandas().sort_values("_part")
    if tally[length_col].isna().any() or not tally[length_col].between(1, capacity).all():
        raise ValueError(f"lengths must be 1 to {capacity}")
    tally["before"] = tally.groupby(length_col)["count"].cumsum() - tally["count"]
    plan = best_fit_plan({int(k): int(v) for k, v in tally.groupby(length_col)["count"].sum().items()}, capacity)
    before = {(int(p), int(n)): int(b) for p, n, b in zip(tally["_part"], tally[length_col], tally["before"], strict=True)}
    shared = pieces.sparkSession.sparkContext.broadcast((before, plan))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, where = shared.value
        scale = 1 << 44
        where = where.sort_values(["length", "rank"])
        keys = (where["length"] * scale + where["rank"]).to_numpy()
        at_rank, at_seq, at_off = (where[c].to_numpy() for c in ("rank", "sequence", "offset"))
        for batch in batches:
            lengths = column(batch, length_col).to_numpy(zero_copy_only=False)
            parts = column(batch, "_part").to_numpy(zero_copy_only=False)
            pairs, inverse = np.unique(np.stack((parts, lengths)), axis=1, return_inverse=True)
            base = np.fromiter((offsets[int(p), int(n)] for p, n in pairs.T), np.int64, pairs.shape[1])
            rank = column(batch, "_rank").to_numpy(zero_copy_only=False) + base[inverse.reshape(-1)]
            k = np.searchsorted(keys, lengths * scale + rank, side="right") - 1
            kept = [column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at_seq[k] + rank - at_rank[k]), pa.array(at_off[k])], [*names, "sequence_id", "offset"])

    final = pieces.limit(0).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(assign, final)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """The packed pieces of every row of ``df``: tokenized once, staged, ranked and placed."""
    staging = Staging(df.sparkSession, "tokens")
    return pack(staging.keep(token_pieces(df, id_col, text_col, capacity, vocabulary=vocabulary), "pieces"), capacity)
