from __future__ import annotations

import corpus_pipeline as p
from tessera.llm.exact_dedup import exact_dedup
from tests.conftest import SF
from tests.llm.test_dedup import near_brute


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    own = docs.where("lang = 'de' and n_chars > 500").first()["text"]
    foreign = ["Это предложение на русском языке, которое никто не учил.", "qzx vjwk pqgh xkcd bzvt qwrt mnbv zxqj kwpf gqzv xjqk wvzb", "這是一個沒有人學過的句子"]
    odd = [(9001, None, "en", "s", 0), (9002, "12345", "en", "s", 5), (9003, None, None, None, None), *((9004 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)), (9010, own + " Und", None, "s", len(own))]
    spoken = p.identify_language(spark, docs.union(spark.createDataFrame(odd, docs.schema)), SF)
    ids = {r["doc_id"]: r["lang"] for r in spoken.collect()}
    assert spoken.columns == p.COLUMNS and set(ids) == {r["doc_id"] for r in docs.collect()} | {9010} and ids[9010] == "de"
    once = p.drop_exact_copies(spark, spoken, SF)
    texts = {}
    for r in spoken.collect():
        texts[r["text"]] = max(texts.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(texts.values())
    assert exact_dedup(once).where("not kept").count() == 0
    apart = p.drop_near_copies(spark, once, SF)
    want = [i for i, _, _, kept in near_brute([(r["doc_id"], r["text"]) for r in once.collect()], 5) if kept]
    assert sorted(r["doc_id"] for r in apart.collect()) == want
    mixed = p.mix_sources(spark, apart, SF)
    assert mixed.columns == p.COLUMNS and {r["doc_id"] for r in mixed.collect()} <= set(want)
    packed = p.pack_sequences(spark, mixed, SF)
    assert packed.where("piece = 0").count() == mixed.count()


def test_run_and_empty(spark):
    assert p.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
