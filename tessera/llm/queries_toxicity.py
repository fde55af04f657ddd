"""op10: toxicity of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.queries_language import held_out_id


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from the labels whose crc32 mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out_id("doc_id", 3, 1))
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", held_out_id("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.transform(F.slice("evidence", 1, 3), lambda e: e["id"]).alias("evidence"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict = {}
