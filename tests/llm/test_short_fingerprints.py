from __future__ import annotations

import random

import pytest

from tessera.llm.queries_sketches import RETAINED, SHINGLE, op5_fingerprints
from tessera.llm.sketches import edit_fingerprints


def shingles(text, n):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def pairs(texts):
    """Each text with its edited one and the next, by descending id."""
    for k, text in enumerate(texts):
        follow = texts[k - 1]
        cut = len(text) // 3
        yield k, text, text[: len(text) - cut] + follow[:cut], follow


def like(p, q):
    return len(p & q) / len(p | q)


def test_short_texts_have_fingerprints_and_exact_likeness_with_all_hashes(spark):
    texts = [" ".join(f"w{k * 7 + j}" for j in range(1 + k % 15)) for k in range(60)]
    texts += ["one two three four five six seven eight nine", "one two three four five six seven eight nine ten"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in edit_fingerprints(df, fraction=1).collect()}
    assert len({got[k]["fingerprint"] for k in got}) == len(texts)
    for k, text, edited, follow in pairs(texts):
        a, b = shingles(text, 5), shingles(edited, 5)
        assert got[k]["fingerprint"].count(",") + 1 == len(a)
        assert got[k]["near_edited"] == pytest.approx(like(a, b))
        assert got[k]["contained_in_edited"] == pytest.approx(len(a & b) / len(a))
        assert got[k]["near_next"] == pytest.approx(like(a, shingles(follow, 5)))


def test_query_retains_a_part_and_errs_little(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([20, 60, 300, 1200]))) for _ in range(160)]
    texts += ["", "lone", *(" ".join(f"v{j}" for j in range(60_000)),) * 1]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op5_fingerprints(spark, str(tmp_path)).collect()}
    errors = {}
    for k, text, edited, _ in pairs(texts):
        a, b = shingles(text, SHINGLE), shingles(edited, SHINGLE)
        hashes = got[k]["fingerprint"].removeprefix("1/2:")
        kept = hashes.count(",") + 1 if hashes else 0
        assert kept <= len(a) and abs(kept - RETAINED * len(a)) <= 5 * (RETAINED * (1 - RETAINED) * len(a)) ** 0.5 + 1
        if len(a) > 15:
            errors.setdefault(len(a) // 100, []).append(abs(got[k]["near_edited"] - like(a, b)))
    means = [sum(e) / len(e) for _, e in sorted(errors.items())]
    assert means[0] < 0.15 and all(m < 0.05 for m in means[1:])
