"""Filter audits against applying the filters one after the other."""

from __future__ import annotations

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tessera.llm.filter_audit import filter_interactions, repeats_of_smaller
from tessera.llm.queries_audit import ORACLES, op12_filter_audit
from tests.helpers import duck_rows, rows_of


def brute(rows, letters):
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_in = {}
        for order in map("".join, permutations(letters)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in mine)
                removed_in[f] = removed_in.get(f, 0) + len(gone)
                out.append([part, order, step, len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), f])
        for o in out:
            if o[0] == part:
                o[8] = removed_in.get(o[8], 0) if isinstance(o[8], str) else o[8]
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("letters", ["A", "XY", "ABCD"])
def test_all_orders(spark, letters):
    rng = random.Random(3)
    rows = [(rng.choice(["p", "q", None]), {f for f in letters if rng.random() < 0.4}, rng.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame([(p, *[f in fails or None for f in letters], m) for p, fails, m in rows], f"part string, {', '.join(f'{f} boolean' for f in letters)}, step boolean")
    got = filter_interactions(df, F.col("part"), {f: F.col(f) for f in letters}, {"m": F.col("step")})
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "m_lost", "shapley"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, letters)
    assert filter_interactions(df.limit(0), F.col("part"), {f: F.col(f) for f in letters}, {}).count() == 0


def test_filters_are_bounded(spark):
    with pytest.raises(ValueError):
        filter_interactions(spark.range(1), F.lit(""), {c: F.lit(True) for c in "ABCDEFGHI"}, {})


def test_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (1, "a"), (None, "a"), (5, None), (3, "b")], "id long, k string")
    got = sorted(((r["id"], r["k"], r["repeats"]) for r in repeats_of_smaller(df, "id", F.col("k")).collect()), key=repr)
    assert got == sorted([(1, "a", False), (2, "a", True), (2, "b", False), (1, "a", False), (None, "a", False), (5, None, False), (3, "b", True)], key=repr)


def test_odd_tables(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None, None, None, 0), (2, "", "en", "", 0), (3, words, "en", "s", 0), (4, words, "en", "s", 0), (4, words, "en", "s", 0), (5, "ABC " * 80, None, "s", 0), (None, words + " #", "en", "t", 0), (6, "a\x0bb\x85c " + "x " * 200_000, "en", "t", 0)]
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (99, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names, got = rows_of(op12_filter_audit(spark, str(tmp_path)))
    documents, labelled = (spark.read.parquet(f"{tmp_path}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    documents["doc_id"], labelled["doc_id"] = documents["doc_id"].astype("Int64"), labelled["doc_id"].astype("Int64")
    assert (names, got) == duck_rows(ORACLES["op12_filter_audit"], documents=documents, labels=labelled)
    assert len(got) == 3 * 600
