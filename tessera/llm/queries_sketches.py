"""op5: fingerprints of ``documents`` and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.sketches import edit_fingerprints

#: Shingles of three words, of which half the range of hashes is retained: dense enough for short texts.
SHINGLE, RETAINED = 3, 1 / 2


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketches of every document and of its edited text."""
    return edit_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=SHINGLE, fraction=RETAINED)


QUERIES = {"op5_fingerprints": op5_fingerprints}
ORACLES: dict = {}
