"""What filters take from a corpus in every order, from one count of their combinations.

Each row has a mask of the filters that it fails.  A part of the corpus is then 2**n
counts, one for each mask, and the subset-zeta transform, one pass for each filter, turns these
into the survivors of every set of filters: the rows whose mask lies in its
complement.  A step of an order leads from one set to its neighbour, so all orders
are differences of these numbers, and no row is looked at again.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters whose orders are all listed at most; more would be more than 40 320 orders a part.
MOST_FILTERS = 8


def repeats_of_smaller(df: DataFrame, id_col: str, key: Column, flag: str = "repeats") -> DataFrame:
    """``df`` with ``flag``: whether a row with a smaller id has the same key.

    The smallest id of each key is found by an aggregate, which sums a frequent key
    before the shuffle, and is then met by id and key together, so no key gathers its rows.  Rows
    with a null id or key repeat nothing, nor are they repeated.
    """
    keyed = df.withColumn("_key", key)
    firsts = keyed.where(F.col(id_col).isNotNull() & F.col("_key").isNotNull()).groupBy("_key").agg(F.min(id_col).alias("_first")).withColumnRenamed("_key", "_first_key")
    met = keyed.join(firsts, (F.col(id_col) == F.col("_first")) & (F.col("_key") == F.col("_first_key")), "left")
    repeated = F.col(id_col).isNotNull() & F.col("_key").isNotNull() & F.col("_first").isNull()
    return met.select(*df.columns, repeated.alias(flag))


def mask_counts(df: DataFrame, part: Column, failures: dict[str, Column], marks: dict[str, Column]) -> DataFrame:
    """One row per part: arrays of the rows of each mask, ``rows`` of all and one array for each of ``marks``.

    Bit i of a mask is set if the i-th filter fails; a null condition does not.
    Masks are counted before the arrays are made, so a large part is 2**n rows by then.
    """
    if not 0 < len(failures) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} filters")
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())])
    counts = [F.count("*").alias("rows"), *[F.count(F.when(F.col(m), 1)).alias(m) for m in marks]]
    counted = df.select(part.alias("part"), mask.alias("_mask"), *[c.alias(m) for m, c in marks.items()]).groupBy("part", "_mask").agg(*counts)
    cells = [F.array(*[F.coalesce(F.max(F.when(F.col("_mask") == m, F.col(c))), F.lit(0)) for m in range(1 << len(failures))]).alias(c) for c in ("rows", *marks)]
    return counted.groupBy("part").agg(*cells)


def zeta(counts: Column, n: int) -> Column:
    """For every mask the sum over its subsets, by one pass for each of ``n`` filters."""
    bits = F.array(*[F.lit(1 << i) for i in range(n)])

    def passed(sums: Column, bit: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.element_at(sums, i.bitwiseXOR(bit) + 1)).otherwise(0))

    return F.aggregate(bits, counts, passed)


def survivors(sums: Column, filters: Column, n: int) -> Column:
    """The rows that pass all of a set of filters: those whose mask is a subset of its complement."""
    return F.element_at(sums, F.lit(1 << n) - filters)


def over_all_orders(sums: Column, n: int) -> Column:
    """For each filter what it removes, summed over all orders.

    A set without the filter is what comes before it in |set|! * (n - 1 - |set|)! orders.
    """
    weights = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)])

    def total(bit: Column) -> Column:
        gone = lambda s: F.element_at(weights, F.bit_count(s) + 1) * (survivors(sums, s, n) - survivors(sums, s + bit, n))
        return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(bit) == 0, gone(s)).otherwise(0))

    return F.transform(F.array(*[F.lit(1 << i) for i in range(n)]), total)


def filter_interactions(df: DataFrame, part: Column, failures: dict[str, Column], marks: dict[str, Column]) -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there.

    ``failures`` names each filter by one letter and gives the condition that a row fails it;
    ``marks`` are conditions whose rows are counted apart.  Columns: ``part``,
    ``filter_order``, ``step``, and numbers of rows of the part: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (failing, but removed before), ``unique_fails`` (failing this
    filter only), ``<mark>_lost`` (removed here) and ``shapley`` (what the filter removes, summed over all orders).

    A null part is one of its own; an empty table gives no rows; repeated rows count each.
    """
    n, letters = len(failures), "".join(failures)
    counts = mask_counts(df, part, failures, marks)
    sums = counts.select("part", F.col("rows").alias("_cells"), zeta(F.col("rows"), n).alias("_rows"), *[zeta(F.col(m), n).alias(f"_{m}") for m in marks])
    sums = sums.withColumn("_all_orders", over_all_orders(F.col("_rows"), n))
    steps = sums.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bits = F.array(*[F.lit(1 << i) for i in range(n)])
    nth = lambda i: F.instr(F.lit(letters), F.substring("filter_order", i, F.lit(1)))
    before = F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(2), F.col("step") - 1), F.lit(0), lambda s, i: s + F.element_at(bits, nth(i)))
    steps = steps.withColumn("_nth", nth(F.col("step"))).withColumn("_bit", F.element_at(bits, F.col("_nth"))).withColumn("_before", before)
    left = lambda of, s: survivors(F.col(of), s, n)
    lost = lambda of: left(of, F.col("_before")) - left(of, F.col("_before") + F.col("_bit"))
    fails = left("_rows", F.lit(0)) - left("_rows", F.col("_bit"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        left("_rows", F.col("_before") + F.col("_bit")).alias("kept"),
        lost("_rows").alias("removed"),
        (fails - lost("_rows")).alias("redundant"),
        F.element_at("_cells", F.col("_bit") + 1).alias("unique_fails"),
        *[lost(f"_{m}").alias(f"{m}_lost") for m in marks],
        F.element_at("_all_orders", F.col("_nth")).alias("shapley"),
    )
