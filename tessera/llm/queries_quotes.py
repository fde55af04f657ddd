"""op1: ``conversations``, with replies that quote them, in reply order without quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.quotes import link_quotations

#: Digests are in conversations of their own, with this added to the number.
ELSEWHERE = 1 << 40


def with_replies(turns: DataFrame) -> DataFrame:
    """The turns and, as they quote nothing themselves, a reply to each and a digest of each first turn.

    Turn t becomes 2t.  The reply, 2t + 1, quotes the first line of the turn at
    level 2 and the others at level 1; the digest, in another conversation,
    quotes all but the first line.
    """
    text, at = F.coalesce("text", F.lit("")), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    first = F.substring_index(text, "\n", 1)
    rest = F.substring(text, F.char_length(first) + 2, F.char_length(text))
    quoted = F.concat(F.lit("> "), F.replace(rest, F.lit("\n"), F.lit("\n> ")))
    reply = F.concat(F.lit("> > "), first, F.when(rest != "", F.concat(F.lit("\n"), quoted)).otherwise(F.lit("")), F.lit("\n\nNoted in "), at)
    digest = F.concat(F.lit("From "), at, F.lit("\n\n"), quoted)
    made = F.array(
        F.struct(F.col("conv_id").alias("conv_id"), (2 * F.col("turn")).alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")),
        F.struct(F.col("conv_id").alias("conv_id"), (2 * F.col("turn") + 1).alias("turn"), F.lit("reply").alias("role"), reply.alias("text")),
        F.when(F.col("turn") == 0, F.struct((F.col("conv_id") + ELSEWHERE).alias("conv_id"), F.col("turn").alias("turn"), F.lit("digest").alias("role"), digest.alias("text"))),
    )
    return turns.select(F.explode(F.array_compact(made)).alias("m")).select("m.*")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with its own text, its links and its place among the replies."""
    return link_quotations(with_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_S = r"[ \t\n\x0B\f\r]"
#: Over a table ``messages`` (conv_id, turn, role, text).
LINKING_SQL = rf"""
raw AS (SELECT mid, conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (
  SELECT *, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS l FROM messages)),
parsed AS (SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS level,
  CASE WHEN marks <> '' THEN regexp_replace(substr(line, length(marks) + 1), '^ ', '') ELSE line END AS content
  FROM (SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS marks FROM raw)),
lines AS (SELECT mid, conv_id, turn, i, level, CASE WHEN level = 0 AND coalesce(lead(level) OVER w, 0) > 0
    AND regexp_matches(content, '(wrote|writes|schrieb|écrit|escribió){_S}*:{_S}*$') THEN '' ELSE content END AS content,
  CASE WHEN level IS DISTINCT FROM lag(level) OVER w THEN 1 ELSE 0 END AS new FROM parsed WINDOW w AS (PARTITION BY mid ORDER BY i)),
units AS (SELECT *, lower(trim(regexp_replace(content, '{_S}+', ' ', 'g'))) AS u,
  CASE WHEN level = 0 THEN -1 ELSE sum(new) OVER (PARTITION BY mid ORDER BY i) END AS run FROM lines),
-- Blank lines part paragraphs; what a message says itself is one run, whatever is quoted between.
paragraphs AS (SELECT mid, run, p, string_agg(u, ' ' ORDER BY i) AS t FROM (
  SELECT *, sum(CASE WHEN u = '' THEN 1 ELSE 0 END) OVER (PARTITION BY mid, run ORDER BY i) AS p FROM units) WHERE u <> '' GROUP BY mid, run, p),
whole AS (SELECT l.mid, l.run, l.t AS by_line, p.t AS by_paragraph
  FROM (SELECT mid, run, chr(10) || string_agg(u, chr(10) ORDER BY i) || chr(10) AS t FROM units WHERE u <> '' GROUP BY mid, run) l
  JOIN (SELECT mid, run, chr(10) || string_agg(t, chr(10) ORDER BY p) || chr(10) AS t FROM paragraphs GROUP BY mid, run) p ON p.mid = l.mid AND p.run = l.run),
quoted AS (SELECT q.*, m.conv_id, m.turn, (SELECT any_value(level) FROM units u WHERE u.mid = q.mid AND u.run = q.run) AS level
  FROM whole q JOIN messages m USING (mid) WHERE run >= 0),
said AS (SELECT w.*, m.conv_id, m.turn FROM whole w JOIN messages m USING (mid) WHERE run = -1),
candidates AS (SELECT q.mid, q.run, q.conv_id, q.turn, q.level, s.conv_id AS c, s.turn AS t FROM quoted q JOIN said s
  ON (contains(s.by_line, q.by_line) OR contains(s.by_line, q.by_paragraph) OR contains(s.by_paragraph, q.by_line) OR contains(s.by_paragraph, q.by_paragraph))
  WHERE s.conv_id < q.conv_id OR (s.conv_id = q.conv_id AND s.turn < q.turn)),
linked AS (SELECT mid, run, conv_id, turn, level, min(row(CASE WHEN c = conv_id THEN 0 ELSE 1 END, c, t)) AS b FROM candidates GROUP BY ALL),
links AS (SELECT conv_id, turn, count(*)::INTEGER AS n_linked, max(row(CASE WHEN level = 1 THEN 1 ELSE 0 END, -b[1], b[2], b[3])) AS p FROM linked GROUP BY conv_id, turn),
up(conv_id, turn, tc, tt, depth) AS (SELECT DISTINCT conv_id, turn, conv_id, turn, 0 FROM messages
  UNION ALL SELECT up.conv_id, up.turn, l.p[3], l.p[4], up.depth + 1 FROM up JOIN links l ON l.conv_id = up.tc AND l.turn = up.tt),
threads AS (SELECT conv_id, turn, max(depth)::INTEGER AS depth, arg_max(tc, depth) AS tc, arg_max(tt, depth) AS tt FROM up GROUP BY conv_id, turn),
counts AS (SELECT mid, count(*)::INTEGER AS n, max(level)::INTEGER AS m FROM quoted GROUP BY mid),
bodies AS (SELECT mid, regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^{_S}+|{_S}+$', '', 'g') AS body FROM lines GROUP BY mid)
SELECT m.conv_id, m.turn, m.role, b.body, coalesce(c.n, 0)::INTEGER AS n_quotes, coalesce(c.m, 0)::INTEGER AS max_level, coalesce(l.n_linked, 0)::INTEGER AS n_linked,
  l.p[3] AS parent_conv, l.p[4] AS parent_turn, t.tc AS thread_conv, t.tt AS thread_turn, t.depth
FROM messages m JOIN bodies b USING (mid) LEFT JOIN counts c USING (mid) LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn
JOIN threads t ON t.conv_id = m.conv_id AND t.turn = m.turn"""

QUERIES = {"op1_quotation_linking": op1_quotation_linking}
ORACLES = {
    "op1_quotation_linking": f"""
WITH RECURSIVE parts AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS x, split_part(coalesce(text, ''), chr(10), 1) AS first FROM conversations),
halves AS (SELECT *, substr(x, length(first) + 2) AS rest, conv_id || '/' || turn AS place FROM parts),
made AS (SELECT conv_id, 2 * turn AS turn, role, text FROM conversations
  UNION ALL SELECT conv_id, 2 * turn + 1, 'reply', '> > ' || first || CASE WHEN rest <> '' THEN chr(10) || '> ' || replace(rest, chr(10), chr(10) || '> ') ELSE '' END || chr(10) || chr(10) || 'Noted in ' || place FROM halves
  UNION ALL SELECT conv_id + {ELSEWHERE}, turn, 'digest', 'From ' || place || chr(10) || chr(10) || '> ' || replace(rest, chr(10), chr(10) || '> ') FROM halves WHERE turn = 0),
messages AS (SELECT row_number() OVER () AS mid, * FROM made),
{LINKING_SQL}"""
}
