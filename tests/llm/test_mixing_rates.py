from __future__ import annotations

import corpus_pipeline
from tessera.llm.mixing import MAX_RATE, poisson_mix
from tessera.llm.queries_mixing import op9_poisson_mix

COLUMNS = "doc_id long, text string, source string"


def test_rates_beyond_one_draw(spark):
    rows = [(k, "x" * 5000, "big") for k in range(100)] + [(1000, "tiny", None)]
    weights = spark.createDataFrame([(None, 1.0), ("big", 3.0)], "source string, weight double")
    rate = 0.25 * (5000 * 100 + 4) / 4
    assert rate > 60 * MAX_RATE
    got = poisson_mix(spark.createDataFrame(rows, COLUMNS), weights=weights, in_parts=True)
    copies = [r["copy"] for r in got.where("source is null").select("copy").collect()]
    assert sorted(copies) == list(range(1, len(copies) + 1))
    assert abs(len(copies) - rate) < 5 * rate**0.5


def test_parts_are_independent_draws(spark):
    rows = [(k, "x", "tiny") for k in range(400)] + [(10_000 + k, "y" * 10_000, "big") for k in range(200)]
    weights = spark.createDataFrame([("tiny", 0.24), ("big", 0.76)], "source string, weight double")
    rate = 0.24 * (400 + 2_000_000) / 400
    assert 2 * MAX_RATE < rate < 3 * MAX_RATE
    got = poisson_mix(spark.createDataFrame(rows, COLUMNS), weights=weights, in_parts=True).where("source = 'tiny' and copy = 1")
    n = [r["n_copies"] for r in got.select("n_copies").collect()]
    mean = sum(n) / len(n)
    variance = sum((x - mean) ** 2 for x in n) / (len(n) - 1)
    assert len(n) == 400 and abs(mean - rate) < 5 * (rate / 400) ** 0.5
    # One uniform number for all three parts would give three times this variance.
    assert 0.7 * rate < variance < 1.4 * rate


def test_a_tiny_source_beside_a_large_corpus(spark, tmp_path):
    rows = [(k, "x" * 30_000, "en", f"s{k % 20}", 30_000) for k in range(400)] + [(1000, "z", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    root = 600_000**0.5
    rate = (12_000_000 + 1) / (20 * root + 1)
    assert rate > MAX_RATE
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for got in (op9_poisson_mix(spark, str(tmp_path)), corpus_pipeline.mix_sources(spark, docs, str(tmp_path))):
        assert abs(got.where("source is null").count() - rate) < 5 * rate**0.5
