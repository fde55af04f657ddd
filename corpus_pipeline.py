"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir) that works on all its
predecessor kept.  All but the last return the columns of ``documents``; the
last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.mixing import poisson_mix
from tessera.llm.near_dedup import near_dedup
from tessera.llm.packing import pack_documents
from tessera.plans.joins import broadcast_if_small
from tessera.plans.staging import Staging

#: A document whose likeliest language has a smaller posterior is rejected.
LEAST_POSTERIOR = 0.5
#: So is one whose n-grams are so much less likely (nats, in the mean) than is usual in that language: text in
#: none of the languages learnt.  On documents of known languages the least value met is -2.6, that of 70 characters
#: of tokens and digits; random letters have -4.6 and less, other scripts -8 and less.
LEAST_MARGIN = -3.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, of no clear language or in none that is learnt; fills null languages.

    Without any labelled document there is nothing to learn from and nothing is rejected.
    """
    model = language.fit(docs)
    if not model.langs:
        return docs.select(COLUMNS)
    scored = language.predict(docs.select(COLUMNS), model, margin_col="lang_margin")
    clear = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= LEAST_POSTERIOR) & (F.col("lang_margin") >= LEAST_MARGIN)
    return scored.where(clear).withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of each text."""
    gone = Staging(spark, "pipeline").keep(exact_dedup(docs).where("not kept").select("doc_id", F.col("text_sha256").alias("_sha")).distinct(), "copies")
    marked = docs.select(COLUMNS).withColumn("_sha", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    return marked.join(broadcast_if_small(gone), ["doc_id", "_sha"], "left_anti").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies."""
    gone = Staging(spark, "pipeline").keep(near_dedup(docs, words=5, percent=80).where("not kept").select("doc_id").distinct(), "near")
    return docs.select(COLUMNS).join(broadcast_if_small(gone), "doc_id", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet the square roots of their sizes, in shuffled order."""
    return poisson_mix(docs.select(COLUMNS), alpha=0.5, volume=1.0, seed=17, in_parts=True).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, capacity=2048)


STAGES = [
    ("language", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    staging = Staging(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = staging.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
