"""op4: language of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language


def held_out_id(doc_id: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit_on_documents(docs: DataFrame) -> language.LanguageModel:
    """The model of the documents that are not held out."""
    return language.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out_id("doc_id", 4, 2)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those whose crc32 mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on_documents(docs)
    scored = language.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out_id("doc_id", 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict = {}
