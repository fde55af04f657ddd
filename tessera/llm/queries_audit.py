"""op12: five filters over ``documents`` in all their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.filter_audit import filter_interactions, repeats_of_smaller

#: Fixed value: white space that separates words, as a class of a pattern.
SPACES = r"[\x20\x09-\x0D]+"


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, order and step.

    Texts are measured where they are read and shuffled as digests only.  A label
    counts for a document if any row of ``labels`` with its id has it; a null id has none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 or toxic = 1").groupBy("doc_id")
    labels = labels.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumnRenamed("doc_id", "_labelled")
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    told = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), text.alias("text"), words.alias("words"))
    told = told.select(
        "doc_id",
        "source",
        (F.size("words") < 50).alias("a"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 65 * F.size("words").cast("long")).alias("b"),
        (100 * F.octet_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 5 * F.length("text").cast("long")).alias("c"),
        F.col("text").rlike("[#$%&*|]").alias("d"),
        F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha"),
    )
    marked = repeats_of_smaller(told, "doc_id", F.col("sha"), "e").drop("sha").join(labels, F.col("doc_id") == F.col("_labelled"), "left")
    failures = {f.upper(): F.col(f) for f in "abcde"}
    out = filter_interactions(marked, F.col("source"), failures, {"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {
    "op12_filter_audit": r"""
WITH RECURSIVE told AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), failed AS (
  SELECT part, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(least < doc_id, false) AS E,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS bad
  FROM told
), listed AS (
  SELECT part, good, bad, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f, i: [A, B, C, D, E][i]) AS fails FROM failed
), grown(o) AS (
  SELECT '' UNION ALL SELECT o || f FROM grown, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
), orders AS (SELECT o FROM grown WHERE length(o) = 5
), patterns AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE bad) AS n_bad FROM listed GROUP BY ALL
), gone AS (
  SELECT part, o, fails, n, n_good, n_bad, coalesce(list_min(list_transform(fails, lambda f: instr(o, f))), 6) AS pos FROM patterns, orders
), steps AS (
  SELECT part, o, s, substr(o, s, 1) AS f, sum(n) FILTER (WHERE pos > s) AS kept, sum(n) FILTER (WHERE pos = s) AS removed,
    sum(n) FILTER (WHERE pos < s AND list_contains(fails, substr(o, s, 1))) AS redundant, sum(n) FILTER (WHERE fails = [substr(o, s, 1)]) AS unique_fails,
    sum(n_good) FILTER (WHERE pos = s) AS good_lost, sum(n_bad) FILTER (WHERE pos = s) AS toxic_lost
  FROM gone, (SELECT unnest(range(1, 6)) AS s) GROUP BY ALL
)
SELECT part, o AS filter_order, s::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (coalesce(sum(removed) OVER (PARTITION BY part, f), 0))::BIGINT AS shapley
FROM steps"""
}
