"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate, its share of the target over its share of
the corpus; each document draws its number of copies from the Poisson
distribution with that mean, by inverting the distribution function at a
uniform number that a hash of seed and id gives; a mean above
``MAX_RATE`` is split into equal means, each inverted at a uniform number of its own, and the
counts are added.  The copies are exploded and dealt out in the order of a hash
of seed, id and copy number.  The same seed
gives the same mixture on any cluster, and no draw depends on other documents.

DataFrame functions only.  One aggregation finds the sizes of the sources; the
table of rates is joined by broadcast if it has at most ``max_broadcast`` sources,
otherwise by a shuffle in which every source is dealt out over ``lots``
lots; the copies are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import Staging

#: Means above this are drawn in parts, or refused on request: exp(-mean) would leave the range of doubles.
MAX_RATE = 500.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the parts; nulls count as 'null'."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... far into the tail of a Poisson distribution with that mean."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, j: Column) -> Column:
        p = acc["p"] * rate / j
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def draws(seed: int, key: Column, parts: Column, cdf: Column) -> Column:
    """A number of copies: the sum of ``parts`` draws by ``cdf``, each at the uniform number of its part."""
    later = lambda k: uniform(seed, key, F.concat(F.lit("part "), k.cast("string")))
    u = F.transform(F.sequence(F.lit(1), parts), lambda k: F.when(k == 1, uniform(seed, key)).otherwise(later(k)))
    return F.aggregate(u, F.lit(0), lambda n, x: n + F.size(F.filter(cdf, lambda c: c < x)))


def source_rates(df: DataFrame, staging: Staging, source_col: str, size: Column, weights: DataFrame | None, alpha: float, volume: float) -> DataFrame:
    """(_source, _rate) with one row per source of ``df``, null among them.

    ``weights`` has (source, weight) of the target; sources that it lacks get
    no copies.  Without it the weight of a source is its size to the power ``alpha``.
    ``volume`` times the size of ``df`` is the size of the mixture.
    """
    sizes = df.groupBy(df[source_col].alias("_source")).agg(F.sum(size).alias("_size"))
    if weights is None:
        sizes = sizes.withColumn("_weight", F.pow(F.col("_size").cast("double"), F.lit(alpha)))
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_weight"))
        sizes = sizes.join(given, sizes["_source"].eqNullSafe(given["_s"]), "left").drop("_s").withColumn("_weight", F.coalesce("_weight", F.lit(0.0)))
    sizes = staging.keep(sizes, "sizes")
    whole, weight = sizes.agg(F.sum("_size"), F.sum("_weight")).first()
    if not weight:  # no rows, or none of a source with a weight
        return sizes.select("_source", F.lit(0.0).alias("_rate"))
    rate = F.col("_weight") / F.lit(float(weight)) * F.lit(float(volume) * float(whole)) / F.col("_size")
    return sizes.select("_source", rate.alias("_rate"))


def poisson_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: DataFrame | None = None,
    alpha: float = 0.5,
    volume: float = 1.0,
    seed: int = 17,
    max_broadcast: int = 10_000,
    lots: int = 64,
    in_parts: bool = True,
) -> DataFrame:
    """The mixture: the columns of ``df``, ``n_copies``, ``copy`` (from 1) and ``shuffle_key``, in shuffled order.

    The size of a document is its number of characters, 1 at least (a null text
    counts 1).  A null source is a source.  Rows with one id draw alike, so a
    repeated row has as many copies each time; a null id draws as 'null'.
    Documents that draw 0 are not in the mixture.  An empty table gives an empty
    one.  A rate above 500 is drawn as the sum of equal parts; without ``in_parts``
    it raises an error, as a clash of column names always does.
    """
    clash = {"n_copies", "copy", "shuffle_key"} & set(df.columns)
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)}")
    staging = Staging(df.sparkSession, "mixing")
    size = F.greatest(F.coalesce(F.char_length(F.col(text_col)), F.lit(1)), F.lit(1)).cast("long")
    rates = source_rates(df, staging, source_col, size, weights, alpha, volume)
    if not in_parts:
        above = F.raise_error(F.lit(f"a repetition rate is above {MAX_RATE}"))
        rates = rates.withColumn("_rate", F.when(F.col("_rate") > MAX_RATE, above).otherwise(F.col("_rate")))
    rates = rates.withColumn("_parts", F.greatest(F.ceil(F.col("_rate") / MAX_RATE), F.lit(1)).cast("int"))
    rates = staging.keep(rates.withColumn("_cdf", poisson_cdf(F.col("_rate") / F.col("_parts"))).drop("_rate"), "rates")
    names = df.columns
    same = F.col(source_col).eqNullSafe(F.col("_source"))
    if rates.count() <= max_broadcast:
        rated = df.join(F.broadcast(rates), same)
    else:
        dealt = rates.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        rated = df.withColumn("_at", F.pmod(F.xxhash64(id_col), F.lit(lots)).cast("int")).join(dealt, same & (F.col("_at") == F.col("_lot")))
    drawn = rated.withColumn("n_copies", draws(seed, F.col(id_col), F.col("_parts"), F.col("_cdf")))
    copies = drawn.where("n_copies > 0").select(*names, "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string")), "UTF-8")), 1, 15), 16, 10).cast("long")
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
