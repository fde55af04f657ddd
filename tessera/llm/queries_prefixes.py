"""op11: token counts of ``documents`` from the table of all prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.token_prefixes import cut_to_budget, prefix_table
from tessera.plans.staging import Staging

#: Tokens beyond which a text is over the limit.
LIMIT = 512


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, whether they exceed the limit, and the longest prefix that does not."""
    table = prefix_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cut = cut_to_budget(Staging(spark, "op11").keep(table, "prefixes"), LIMIT)
    return cut.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_chars", "cut_chars", "cut_tokens")


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLES: dict = {}
