"""op3: license scan of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.licenses import PHRASES, TEMPLATES, parse_template, scan_licenses


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places and template labels of every document.

    ``score`` is 1 where a template accepts, 0.75 where only a phrase stands, else 0.
    """
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, more = F.transform("phrases", lambda x: x["label"]), F.transform("accepted", lambda x: x["label"])
    starts = F.transform("phrases", lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("accepted") > 0, 1.0).when(F.size("phrases") > 0, 0.75).otherwise(0.0).alias("score"),
    )


def _pattern(parts: list[tuple]) -> str:
    """The template as a regular expression over words that each have a space behind them."""
    out = ""
    for part in parts:
        if part[0] == "word":
            out += part[1].decode() + " "
        elif part[0] == "any":
            out += f"(?:[^ ]+ ){{{part[1]},{part[2]}}}"
        else:
            out += f"(?:{_pattern(part[1])})?"
    return out


def _oracle() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    places, labels = [], []
    for label, phrase in PHRASES:
        ws = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(ws, 1))
        places.append(f"[{{'label': '{label}', 'pos': i}} FOR i IN range(0, len(w) - {len(ws) - 1}) IF {same}]")
    for label, template in TEMPLATES:
        labels.append(f"CASE WHEN regexp_matches(joined, ' {_pattern(parse_template(template))}') THEN ['{label}'] ELSE [] END")
    base = "[]::STRUCT(label VARCHAR, pos BIGINT)[]"
    for p in places:
        base = f"list_concat({base}, {p})"
    more = "[]::VARCHAR[]"
    for x in labels:
        more = f"list_concat({more}, {x})"
    text = lambda x: f"coalesce(array_to_string(list_sort(list_distinct({x})), ','), '')"
    return f"""
WITH t AS (SELECT doc_id, {words} AS w FROM documents),
u AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM t),
v AS (SELECT doc_id, len(w) AS n_words, {base} AS b, {more} AS m FROM u)
SELECT doc_id, n_words::BIGINT AS n_words, len(b)::BIGINT AS n_base,
  list_min([x.pos FOR x IN b])::BIGINT AS first_word, list_max([x.pos FOR x IN b])::BIGINT AS last_word,
  {text("[x.label FOR x IN b]")} AS base_labels, {text("list_concat([x.label FOR x IN b], m)")} AS labels,
  CASE WHEN len(m) > 0 THEN 1.0::DOUBLE WHEN len(b) > 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM v"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _oracle()}
