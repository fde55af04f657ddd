"""op9: ``documents`` mixed to the square roots of their sources' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.mixing import poisson_mix


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mixture, in shuffled order, with as many characters as the corpus in expectation."""
    mixed = poisson_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), alpha=0.5, volume=1.0, seed=17, in_parts=True)
    return mixed.select("doc_id", "source", "lang", "n_copies", "copy", "shuffle_key", "text")


QUERIES = {"op9_poisson_mix": op9_poisson_mix}
ORACLES = {
    "op9_poisson_mix": """
WITH RECURSIVE sizes AS (
  SELECT source, sum(greatest(coalesce(length(text), 1), 1))::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes
), cdf(source, rate, j, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, j + 1, p * rate / (j + 1), c + p * rate / (j + 1) FROM cdf WHERE j < ceil(rate + 12 * sqrt(rate) + 20)
), drawn AS (
  SELECT d.doc_id, d.source, d.lang, d.text, count(*) FILTER (WHERE cdf.c < ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS n
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source GROUP BY ALL
), copies AS (SELECT doc_id, source, lang, text, n, unnest(range(1, n + 1)) AS copy FROM drawn)
SELECT doc_id, source, lang, n::INTEGER AS n_copies, copy::INTEGER AS copy,
  ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key, text
FROM copies"""
}
