"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's shingles (five words in a row, lower-cased, between white space; the
whole text if it has fewer) are hashed to 64 bits, and every hash below a fixed
fraction of the range is retained.  The threshold is the same for all texts, so
the sketch of a union is the union of the sketches, and the share of a short
text's hashes that lie in a long text's sketch estimates containment however
unequal the two are.  At a fraction of 1 all hashes are retained and the
estimates are exact; at less, short texts may have none.

DataFrame functions only: words are hashed once, a shingle's hash combines
five word hashes, and only retained hashes are sorted and stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.staging import Staging

WORDS = 5
FRACTION = 1 / 8


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text; an empty array for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(hashes: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """The sorted retained hashes of all shingles, from an array of word hashes.

    Name the array in a projection before; it is referred to several times.
    """
    retained = (lambda h: h < F.lit(int(-(1 << 63) + fraction * (1 << 64)))) if fraction < 1 else (lambda h: h.isNotNull())
    whole = F.transform(hashes, lambda h, i: F.when(i <= F.size(hashes) - words, F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, words)])))
    short = F.when(F.size(hashes) > 0, F.array(F.aggregate(hashes, F.lit(42).cast("long"), lambda acc, h: F.xxhash64(acc, h)))).otherwise(F.array().cast("array<bigint>"))
    every = F.when(F.size(hashes) >= words, whole).otherwise(short)
    return F.array_sort(F.array_distinct(F.filter(every, retained)))


def as_text(sketched: Column, fraction: float = FRACTION) -> Column:
    """A sketch as a string: its scale, then its hashes in hexadecimal."""
    return F.concat(F.lit(f"1/{round(1 / fraction)}:"), F.array_join(F.transform(sketched, lambda h: F.lower(F.hex(h))), ","))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated Jaccard similarity; without any retained hash 1 if the texts are the ``same``, else 0."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(same, 1.0).when(union > 0, both / union).otherwise(0.0)


def containment(a: Column, b: Column, same: Column) -> Column:
    """Estimated share of the first text's shingles that the second has too."""
    return F.when(same, 1.0).when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def with_sketch(df: DataFrame, text_col: str, out_col: str, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """``df`` with the sketch of each whole text; null and empty texts have an empty one."""
    return df.withColumn("_hashes", word_hashes(F.col(text_col))).withColumn(out_col, sketch(F.col("_hashes"), words, fraction)).drop("_hashes")


def successors(ids: DataFrame, staging: Staging) -> DataFrame:
    """(_id, _th, n, next_id, next_th): the next key of each in descending order, after the last the first.

    A distributed sort: the keys are range-partitioned, each range is numbered
    in itself, and the first keys of the ranges, one per partition, link them.
    """
    order = [F.col("_id").desc_nulls_last(), F.col("_th").desc()]
    ranged = staging.keep(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    key = F.struct("_id", "_th")
    inside = Window.partitionBy("part").orderBy(*order)
    linked = staging.keep(ranged.withColumn("after", F.lead(key).over(inside)).withColumn("nth", F.row_number().over(inside)), "linked")
    firsts = linked.where("nth = 1").select("part", F.struct("_id", "_th").alias("head"))
    # One row per partition of the sort, whatever the number of documents.
    ring = firsts.withColumn("follow", F.lead("head").over(Window.orderBy("part"))).withColumn("first", F.first("head").over(Window.orderBy("part")))
    ring = ring.select("part", F.coalesce("follow", "first").alias("link"))
    out = linked.join(F.broadcast(ring), "part").withColumn("to", F.coalesce("after", "link"))
    return staging.keep(out.select("_id", "_th", "n", F.col("to._id").alias("next_id"), F.col("to._th").alias("next_th")), "successors")


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness.

    The edited text has its last third (floor of a third of its code points)
    replaced by as many first code points of the next document by descending
    id, or all it has; after the last document comes the first.  A lone
    document is its own next one.  A null text is empty.  Ids should differ:
    a repeated row (same id and text) is one document in that order, with one
    result for each row; rows of one id with different texts follow one another
    in the order of a hash of the text, and null ids come last.
    """
    staging = Staging(df.sparkSession, "fingerprints")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(df[id_col].alias("_id"), text.alias("_text")).withColumn("_th", F.xxhash64("_text"))
    keys = docs.groupBy("_id", "_th").agg(F.max(F.char_length("_text")).cast("long").alias("n"), F.count("*").alias("rows"))
    keys = staging.keep(keys, "keys")
    repeated = keys.where("rows > 1").limit(1).count() > 0
    succ = successors(keys.select("_id", "_th", "n"), staging)

    # Each document is the donor of one other: it sends its text there, which is no longer than all its hashes.
    wanted = succ.select(F.col("next_id").alias("w_id"), F.col("next_th").alias("w_th"), F.col("_id").alias("to_id"), F.col("_th").alias("to_th"), F.floor(F.col("n") / 3).cast("int").alias("cut"))
    givers = docs.dropDuplicates(["_id", "_th"]) if repeated else docs
    met = givers.join(wanted, givers["_id"].eqNullSafe(F.col("w_id")) & (givers["_th"] == F.col("w_th")))
    given = met.select("to_id", "to_th", "cut", F.col("_text").alias("next_text"), F.col("_th").alias("next_th"))
    both = docs.join(given, docs["_id"].eqNullSafe(F.col("to_id")) & (docs["_th"] == F.col("to_th")))
    n = F.char_length("_text")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("_text", F.lit(1), n - F.col("cut")), F.substring("next_text", F.lit(1), F.col("cut"))))
    both = with_sketch(both, "next_text", "next_sketch", words, fraction)
    both = with_sketch(with_sketch(both, "_text", "own", words, fraction), "edited", "other", words, fraction)
    same_edit, same_next = F.col("edited") == F.col("_text"), (F.col("_th") == F.col("next_th")) & (n == F.char_length("next_text"))
    return both.select(
        F.col("_id").alias(id_col),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("own"), fraction).alias("fingerprint"),
        as_text(F.col("other"), fraction).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), same_edit).alias("near_edited"),
        likeness(F.col("own"), F.col("next_sketch"), same_next).alias("near_next"),
        containment(F.col("own"), F.col("other"), same_edit).alias("contained_in_edited"),
    )
