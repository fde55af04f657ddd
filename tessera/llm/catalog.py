"""Queries of the corpus operators with their SQL twins."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: One module of queries for each operator.
MODULES = ["queries_licenses", "queries_language", "queries_dedup", "queries_packing", "queries_mixing", "queries_sketches", "queries_toxicity", "queries_warc", "queries_quotes", "queries_prefixes", "queries_audit", "queries_trie"]

QUERIES: dict = {"pipeline": corpus_pipeline.run}
ORACLES: dict = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
for _name in MODULES:
    _module = importlib.import_module(f"tessera.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
