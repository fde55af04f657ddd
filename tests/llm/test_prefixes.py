"""Token counts of prefixes against the tokenizer itself."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import token_prefixes as tp
from tessera.llm.queries_prefixes import op11_token_counts
from tests.conftest import SF

SCHEMA = "doc_id long, text string, _id string, block int"
PARTS = "a,e,th,ing, ,  ,\n,\t,'s,'re,'ll,',1,23,!,...,é,ß,日本,🙂, ,　,<|endoftext|>,<|endo,|>,é,İ,Ω,̈,r,l, ','',\x1c,\x85,​".split(",")


@pytest.fixture(scope="module")
def counter():
    return tp.PrefixCounter(tp.default_vocabulary())


def brute(counter, text):
    return [len(counter.tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


def test_all_prefixes_of_random_texts(counter):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(20)) for _ in range(100)]
    counts, sizes = counter.texts(texts)
    for text, made, size in zip(texts, counts, sizes, strict=True):
        assert made.tolist() == brute(counter, text) and size == len(text.encode())


def test_stretches_and_long_words(counter, monkeypatch):
    text = " ".join(f"word{i}, it's" for i in range(60)) + "  <|endoftext|> more of it follows here and there <|endoftext|> <|endoftext|"
    want = brute(counter, text)
    monkeypatch.setattr(tp, "STRETCH", 40)
    assert counter.texts([text])[0][0].tolist() == want
    monkeypatch.undo()
    for word in ("=" * 3000, "".join(random.Random(1).choice("abcdefgh") for _ in range(3000))):
        made = counter.texts([word])[0][0]
        assert all(made[k - 1] == len(counter.tokenizer.encode(word[:k]).ids) for k in range(1, 3001, 61))


def test_table_answers(spark, counter):
    rng = random.Random(2)
    texts = [None, "", "a", "it's  \n\n so", *["".join(rng.choice(PARTS) for _ in range(60)) for _ in range(20)]]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "no id", "y", None), (3, texts[3], "x", 7)]
    table = tp.prefix_table(spark.createDataFrame(rows, SCHEMA), block=16).cache()
    for budget in (0, 3, 10, 1000):
        got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_tokens", "cut_chars", "cut_tokens")) for r in tp.cut_to_budget(table, budget).where("doc_id is not null").collect())
        want = []
        for i, t, *_ in rows:
            if i is not None:
                counts = [0, *brute(counter, t or "")]
                best = max(k for k, c in enumerate(counts) if c <= budget)
                want.append((i, len((t or "").encode()), counts[-1], best, counts[best]))
        assert got == sorted(want)
    assert tp.cut_to_budget(table, -1).count() == 0
    by_row = tp.cut_to_budget(table, F.col("doc_id") + 1)
    assert all(r["cut_tokens"] <= r["doc_id"] + 1 for r in by_row.collect())
    asked = [(i, k, "own") for i in (2, 3, 7, 99) for k in (-1, 0, 1, 15, 16, 17, 33, 10_000, None)]
    asked = spark.createDataFrame([r for r in asked if r[0] != 3], "doc_id long, at_chars long, block string")
    for r in tp.tokens_at(table, asked, block=16).collect():
        counts = [0, *brute(counter, texts[r["doc_id"]] or "")] if r["doc_id"] < 90 else None
        known = counts is not None and r["at_chars"] is not None and r["at_chars"] >= 0
        assert r["tokens"] == (counts[min(r["at_chars"], len(counts) - 1)] if known else None) and r["block"] == "own"
    assert tp.prefix_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_the_tokenizer(spark, counter):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_token_counts(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(counter.tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((docs[r["doc_id"]] or "").encode()), n > 512)
        assert r["cut_tokens"] == len(counter.tokenizer.encode(docs[r["doc_id"]][: r["cut_chars"]]).ids) <= 512


def test_other_splitters_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tp.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_a_process_keeps_one_large_thing():
    from tessera.llm import _text

    first = _text.kept("a", list)
    assert _text.kept("a", list) is first
    _text.kept("b", dict)
    assert list(_text._KEPT) == ["b"] and _text.kept("a", list) is not first
    _text.forget()
    assert not _text._KEPT
