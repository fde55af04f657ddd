"""op8: ``documents`` packed into sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.packing import pack_documents


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict = {}
