"""op2: ``pages`` written to WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.warc import read_archives, write_archives
from tessera.plans.staging import Staging


def op2_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each page, and whether it is whole."""
    staging = Staging(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), staging.path("warc"), least_revisit=0)
    read = read_archives(spark, staging.path("warc"), keep_payload=False)
    staging.drop("warc")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
QUERIES = {"op2_warc_reassembly": op2_warc_reassembly}
ORACLES = {
    "op2_warc_reassembly": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('{_DIGITS}', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to, true AS complete
FROM p"""
}
