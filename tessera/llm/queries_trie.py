"""op13: the tree of the beginnings of ``conversations``, rebuilt with shared openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.conversation_trie import HOT_SHARE, conversation_trie, digested_turns, ranked_turns
from tessera.plans.joins import left_join_hot
from tessera.plans.staging import Staging

#: A conversation opens with up to three turns of the one whose id is the next multiple of 20 towards zero.
EVERY, MOST = 20, 3


def shared_openings(turns: DataFrame, convs: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, d, digest, words, last) of every rebuilt conversation, and the conversations (conv, empty).

    At most 39 conversations ask for one opening of three turns.  A conversation's own turns
    learn its numbers by ``left_join_hot``, as one may have very many.
    """
    known = staging.keep(convs, "convs")
    base = known.where(F.col("conv") % EVERY == 0).select(F.col("conv").alias("_base"), F.least("n_turns", F.lit(MOST)).alias("_held"))
    asked = known.withColumn("base", F.col("conv") - F.col("conv") % EVERY).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST + 1))
    asked = asked.join(base, F.col("base") == F.col("_base"), "left").withColumn("lead", F.least("h", F.coalesce("_held", F.lit(0))))
    asked = staging.keep(asked.select("conv", "n_turns", "base", "h", "lead"), "asked")
    heads = turns.where((F.col("conv") % EVERY == 0) & (F.col("pos") <= MOST)).withColumnRenamed("conv", "_base")
    opened = asked.join(heads, (F.col("base") == F.col("_base")) & (F.col("pos") <= F.col("lead")))
    opened = opened.select("conv", F.col("pos").alias("d"), "digest", "words", ((F.col("pos") == F.col("lead")) & (F.col("n_turns") <= F.col("h"))).alias("last"))
    hot = max(2, (known.agg(F.sum("n_turns")).first()[0] or 0) // HOT_SHARE)
    own = left_join_hot(turns, asked.select("conv", "n_turns", "h", "lead"), ["conv"], "n_turns", hot, F.col("pos")).where("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("d"), "digest", "words", (F.col("pos") == F.col("n_turns")).alias("last"))
    return opened.union(own), asked.select("conv", ((F.col("lead") == 0) & (F.col("n_turns") <= F.col("h"))).alias("empty"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the tree; turns with the same number are ordered by a digest of role and text, rows without conv_id are in no conversation."""
    staging = Staging(spark, "op13")
    turns = digested_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    ranked, convs = ranked_turns(turns, staging)
    return conversation_trie(*shared_openings(ranked, convs, staging), staging)


QUERIES = {"op13_conversation_trie": op13_conversation_trie}
ORACLES = {
    "op13_conversation_trie": r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), told AS (
  SELECT conv_id, list({'s': length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''), 'w': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), asked AS (
  SELECT conv_id, own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 4 AS h FROM told, tab
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS turns FROM asked a LEFT JOIN told b ON b.conv_id = a.conv_id - a.conv_id % 20
), paths AS (
  SELECT conv_id, len(turns) AS n, d, list_transform(turns[1:d], lambda x: x.s) AS key, list_transform(turns[1:d - 1], lambda x: x.s) AS up, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w
  FROM rebuilt, unnest(range(0, len(turns) + 1)) AS r(d)
), nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends
  FROM paths GROUP BY key, d
), sized AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.up = n.key) AS n_children FROM nodes n
), below AS (
  SELECT s.key[1:a] AS top, a, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM sized s, unnest(range(0, s.d + 1)) AS r(a) GROUP BY ALL
)
SELECT s.conv_id, s.d AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, s.ends AS ends_sha256
FROM sized s JOIN below b ON b.top = s.key AND b.a = s.d LEFT JOIN nodes p ON p.d = s.d - 1 AND p.key = s.up"""
}
