from __future__ import annotations

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import language, toxicity
from tessera.llm.licenses import TEMPLATES, _places, compile_template, scan_licenses
from tessera.llm.mixing import poisson_mix
from tessera.llm.packing import best_fit_plan, pack, pack_documents, token_pieces
from tessera.llm.queries_language import op4_language_id
from tessera.llm.queries_toxicity import op10_toxicity
from tessera.llm.sketches import edit_fingerprints, merge, sketch, with_sketch, word_hashes
from tests.conftest import SF

# ---- licenses


def accepts(template, text):
    words = text.lower().split()
    a = compile_template("x", template)
    return [(i, e) for i, w in enumerate(words) if w.encode() in a.first and (e := a.match([x.encode() for x in words], i)) > 0]


def test_template_regions():
    t = "licensed under <<optional>>the terms of<<end>> the X License <<any 1 2>> only"
    assert accepts(t, "foo licensed under the x license v 2 only bar") == [(1, 9)]
    assert accepts(t, "licensed under the terms of the x license v2 only")
    assert not accepts(t, "licensed under the terms the x license v2 only")
    assert not accepts(t, "licensed under the x license only")
    assert not accepts(t, "licensed under the y license v2 only")
    assert accepts("a <<optional>>b <<optional>>c<<end>><<end>> d", "a b d a d a b c d") == [(0, 3), (3, 5), (5, 9)]
    for bad in ("<<any 0 1>> a", "a <<optional>> b", "a <<end>>", "a <<what>>", "<<optional>>a<<end>>"):
        with pytest.raises(ValueError):
            compile_template("x", bad)


def filled(template, words):
    """A template as text: optional regions in, ``words`` where any words may stand."""
    return re.sub(r"<<any [^>]*>>", words, template.replace("<<optional>>", " ").replace("<<end>>", " "))


def test_places_of_a_phrase_take_one_pass():
    text = b" " + b"cc by nc " * 80_000
    began = time.perf_counter()
    found = _places(text, b" cc by nc ")
    assert found == list(range(0, 240_000, 3)) and time.perf_counter() - began < 1


def test_full_licenses_need_their_wording(spark):
    full = [(label, t) for label, t in TEMPLATES if len(t) > 400]
    assert {label for label, _ in full} == {"mit", "apache-2", "isc", "bsd"}
    rows, want = [], []
    for i, (label, t) in enumerate(full):
        text = filled(t, "Example Holders Inc")
        changed = [text.replace("ANY KIND", "SOME KIND").replace("DAMAGES", "HARM"), text.replace(" the ", " a ", 1), text.rsplit(" ", 1)[0], filled(t, "x " * 12)]
        rows += [(10 * i, "Copyright 2024\n" + text.replace(" ", "\n  * ") + " end"), *((10 * i + 1 + k, c) for k, c in enumerate(changed))]
        want.append((10 * i, label))
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=full).collect()
    assert sorted((r["doc_id"], a["label"]) for r in found for a in r["accepted"]) == want


def test_license_edge_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (None, "Under the MIT License", "k"), (3, "x" * 100_000 + " licensed under the Apache License, Version 2.0", "k"), (3, "UNDER   the\nMIT, license", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, phrases string")
    got = {(r["doc_id"], r["n_words"]): ([p["label"] for p in r["phrases"]], sorted({a["label"] for a in r["accepted"]})) for r in scan_licenses(df).collect()}
    assert got == {(1, 0): ([], []), (2, 0): ([], []), (None, 4): (["mit"], ["mit"]), (3, 9): (["apache-2"], ["apache-2"]), (3, 4): (["mit"], ["mit"])}
    assert scan_licenses(df.limit(0)).count() == 0


# ---- language


def test_language_held_out(spark):
    got = op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_grams(text):
    """The n-grams of a text, written out: letters, pairs with a letter, triples around a letter; other signs are spaces."""
    t = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "  "
    for i in range(len(t) - 2):
        if t[i] != " ":
            yield t[i]
        if t[i] != " " or t[i + 1] != " ":
            yield t[i : i + 2]
        if t[i + 1] != " ":
            yield t[i : i + 3]


def plain_bucket(gram, bits):
    a, b, c = ([ord(x) for x in gram] + [0, 0])[:3]
    h = {1: a * 0x85EBCA6B + 0x27D4EB2F, 2: a * 0xC2B2AE35 + b * 0x165667B1 + 0x51ED270B, 3: (a * 0xC2B2AE35 + b) * 0x165667B1 + c * 0x2545F491}[len(gram)] % 2**32
    return ((h ^ (h >> 15)) * 0x9E3779B1) % 2**32 >> (32 - bits)


def test_language_equals_plain_bayes(spark, monkeypatch):
    bits, smoothing = 12, 0.5
    docs = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), (None, "fr"), ("no label", None), ("the cat and the dog", "en")]
    df = spark.createDataFrame(docs, "text string, lang string")
    m = language.fit(df, bits=bits)
    assert m.langs == ["de", "en", "fr"]
    counts = {x: [0] * 2**bits for x in m.langs}
    for text, lang in docs:
        for g in plain_grams(text) if lang else ():
            counts[lang][plain_bucket(g, bits)] += 1
    prob = {x: [(n + smoothing) / (sum(c) + smoothing * 2**bits) for n in c] for x, c in counts.items()}
    prior = {x: sum(lang == x for _, lang in docs) / 5 for x in m.langs}
    texts = ["the dog", "die Katze", "le chat", "123 !", "", None, "𝔘", "x\U0001f600y", "Der HUND " * 400]
    for window in (1 << 18, 5):
        monkeypatch.setattr(language, "WINDOW", window)
        total, letters, grams = m.scores(texts)
        for t, row, k, n in zip(texts, total, letters, grams, strict=True):
            found = list(plain_grams(t))
            want = [np.log(prior[x]) + sum(np.log(prob[x][plain_bucket(g, bits)]) for g in found) for x in m.langs]
            assert np.allclose(row, want, rtol=1e-5, atol=1e-3)
            assert k == sum(c.isalpha() for c in (t or "").lower()) and n == len(found)
    scored = language.predict(spark.createDataFrame([(t, 1) for t in texts], "text string, langs int"), m, margin_col="margin").collect()
    assert [r["lang_pred"] for r in scored][:6] == ["en", "de", "fr", "und", "und", "und"]
    assert all((r["margin"] is None) == (r["lang_pred"] == "und") for r in scored)
    with pytest.raises(ValueError):
        language.predict(df.withColumnRenamed("lang", "lang_pred"), m)


def test_language_without_labels(spark):
    df = spark.createDataFrame([("some text", None), (None, None)], "text string, lang string")
    for docs in (df, df.limit(0)):
        m = language.fit(docs)
        assert m.langs == []
        got = language.predict(df, m, margin_col="margin").collect()
        assert [(r["lang_pred"], r["lang_score"], r["margin"]) for r in got] == [("und", 0.0, None)] * 2
        assert language.predict(df.limit(0), m).count() == 0


def test_very_long_text_in_bounded_memory():
    """Windows keep the arrays small however long a text is."""
    import tracemalloc

    m = language.LanguageModel(["a", "b"], np.zeros((2, 1 << 12), np.float32), np.zeros(2), 12)
    tracemalloc.start()
    _, letters, _ = m.scores(["lang text " * 1_000_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert letters[0] == 8_000_000 and peak < 60_000_000


# ---- fingerprints


def brute_sketch(text, fraction=1 / 8, words=5):
    h = lambda v, seed: xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(values):
        acc = 42
        for v in values:
            acc = h(v, acc)
        return signed(acc)

    w = [signed(h(x.encode(), 42)) for x in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if x]
    if len(w) >= words:
        every = {chain(w[i : i + words]) for i in range(len(w) - words + 1)}
    else:
        acc = 42
        for v in w:
            acc = chain([acc, v])
        every = {acc} if w else set()
    return {x for x in every if x < -(1 << 63) + fraction * (1 << 64)}


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"wört{i}" for i in range(60)]
    docs = {i * 3: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 5, 30, 200]))) for i in range(60)}
    docs[500], docs[501], docs[502] = None, "", "a"
    df = spark.createDataFrame([(i, t, "c") for i, t in docs.items()], "doc_id long, text string, other string")
    got = {r["doc_id"]: r for r in edit_fingerprints(df).collect()}
    ids = sorted(docs, reverse=True)
    for k, i in enumerate(ids):
        text, follow = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        a, b, c = brute_sketch(text), brute_sketch(edited), brute_sketch(follow)
        like = lambda p, q, same: 1.0 if same else (len(p & q) / len(p | q) if p | q else 0.0)
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "1/8:" + ",".join(f"{x & (2**64 - 1):x}" for x in sorted(a))
        assert r["edited_fingerprint"] == "1/8:" + ",".join(f"{x & (2**64 - 1):x}" for x in sorted(b))
        assert r["near_edited"] == pytest.approx(like(a, b, text == edited)) and r["near_next"] == pytest.approx(like(a, c, text == follow))


def test_fingerprints_repeats_nulls_empty(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "d e f"), (2, "g h"), (2, "i j")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert edit_fingerprints(df).count() == 5
    assert edit_fingerprints(df.limit(0)).count() == 0
    one = edit_fingerprints(df.where("text = 'g h'")).collect()
    assert [r["near_next"] for r in one] == [1.0]


def test_sketches_merge(spark):
    df = spark.createDataFrame([("a b c d e f g h i j k l m n o p q r s t u v",)], "text string")
    parts = with_sketch(df, "text", "s", fraction=1 / 2)
    assert parts.select(merge(parts["s"], parts["s"]).alias("m"), "s").where("m = s").count() == 1
    full = df.select(word_hashes(df["text"]).alias("h"))
    assert len(full.select(sketch(full["h"], fraction=1).alias("s")).first()["s"]) == 18


# ---- packing


def test_tokens_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", "Don't stop, it's O'NEIL'S 3.14 & über-große Straße İstanbul ΣΟΦΟΣ", "漢字とかな  ｆｕｌｌ é \x1c x\x85y\xa0z", "word " * 5000, "x" * 3000, "a b 👍🏽 '", "___ --- 'll 'LL"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, token_pieces(df).collect()))
    want = []
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    assert got == want


def test_tokens_of_random_texts():
    from tokenizers import Tokenizer

    from tessera.llm import tokens

    path = tokens.default_vocabulary()
    t, ours, rng = Tokenizer.from_file(path), tokens.WordIds(path), random.Random(5)
    signs, more = "abzABZ019 .,'\"-<|>sStTdDmMreve\t\n\x0b\x1c\x85\xa0éÉßİıſΑαΣς中文\u0301 ẞ🙂ñ¿´", ["<|endoftext|>", "<|startoftext|>", "'s", "'LL"]
    texts = ["".join(rng.choice(signs) if rng.random() < 0.93 else rng.choice(more) for _ in range(rng.randrange(25))) for _ in range(4000)]
    flat, begin = ours.encode_all(pa.array([*texts, None]))
    for x, i, j in zip([*texts, ""], begin, begin[1:], strict=False):
        assert t.encode(x, add_special_tokens=False).ids == flat[i:j].tolist()
    long = " ".join(texts).encode()
    for size in (10, 1000):
        assert b"".join(tokens.stretches(long, size)) == long
    assert np.concatenate([ours.encode(s) for s in tokens.stretches(long, 1000)]).tolist() == ours.encode(long).tolist()


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_every_piece_once(spark):
    got = pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len({(r["doc_id"], r["piece"]) for r in got}) == len(got)
    n = check_packing(got, 2048)
    assert n <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_packing_against_best_fit(spark):
    rng = random.Random(2)
    lengths = [rng.choice([rng.randrange(1, 101), 34, 100, 51]) for _ in range(700)]
    df = spark.createDataFrame([(i % 50, n, None) for i, n in enumerate(lengths)], "doc_id long, length long, x string")
    got = pack(df, capacity=100).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((i % 50, n) for i, n in enumerate(lengths))
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in bins if g >= n]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - n)
        else:
            bins.append(100 - n)
    assert check_packing(got, 100) == len(bins)
    assert pack(df.limit(0), capacity=100).count() == 0
    with pytest.raises(ValueError):
        pack(df, capacity=50)
    with pytest.raises(ValueError):
        pack(df.withColumnRenamed("x", "offset"), capacity=100)


def test_plan_is_complete():
    counts = {7: 5, 3: 1000, 10: 2, 1: 13}
    plan = best_fit_plan(counts, 10)
    for length, n in counts.items():
        p = plan[plan["length"] == length].sort_values("rank")
        assert p["n"].sum() == n and (p["rank"].to_numpy() == np.concatenate(([0], p["n"].cumsum().to_numpy()[:-1]))).all()


# ---- mixing


def test_mixing_paths_agree_and_means_hold(spark):
    rows = [(i, "x" * (i % 7 + 1), None if i % 3 == 0 else f"s{i % 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s1", 3.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    a = poisson_mix(df, weights=weights, volume=2.0)
    b = poisson_mix(df, weights=weights, volume=2.0, max_broadcast=0)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    chars = {r["source"]: r["c"] for r in a.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "c").collect()}
    total = sum(len(t) for _, t, _ in rows)
    share = a.selectExpr("source", "length(text) n").groupBy("source").sum("n").collect()
    share = {r["source"]: r["sum(n)"] for r in share}
    assert set(chars) == {"s1", None}
    assert share["s1"] == pytest.approx(2 * total * 0.75, rel=0.06) and share[None] == pytest.approx(2 * total * 0.25, rel=0.08)


def test_mixing_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a")], "doc_id long, text string, source string")
    got = poisson_mix(df, volume=3.0).collect()
    assert len({r["n_copies"] for r in got if r["doc_id"] == 1}) <= 1
    assert poisson_mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        poisson_mix(df.withColumnRenamed("text", "copy"), text_col="copy")
    with pytest.raises(Exception, match="repetition rate"):
        poisson_mix(df, volume=5000.0, in_parts=False).count()
    assert poisson_mix(df, volume=5000.0).count() > 5000


# ---- toxicity


def test_neighbours_are_exact(spark):
    rng = random.Random(4)
    bad, good = [f"bad{i}" for i in range(12)], [f"good{i}" for i in range(30)]
    docs, labels = [], []
    for i in range(400):
        y = i % 4 == 0
        words = rng.choices(good, k=20) + (rng.choices(bad, k=3) if y else [])
        docs.append((i, " ".join(words)))
        labels.append((i, int(y)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.learn(d, lab, block=8, k=7)
    # Written out: features of a text are its words and their beginnings; weights (1 + ln tf) ln((N + 1) / (df + 1)).
    chosen = {f: k for k, f in enumerate(index.names)}

    def tally(text):
        n = {}
        for w in re.findall(r"[0-9a-z]+", text.lower()):
            for f in (w, *(f"^{w[:k]}" for k in range(3, 8) if len(w) > k)):
                if f in chosen:
                    n[f] = n.get(f, 0) + 1
        return n

    tallies = {i: tally(t) for i, t in docs}
    frequency = {f: sum(f in n for n in tallies.values()) for f in chosen}

    def unit(n):
        v = {f: (1 + np.log(k)) * (np.log((len(docs) + 1) / (frequency[f] + 1)) + 1e-6) for f, k in n.items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()}

    units = {i: unit(n) for i, n in tallies.items() if n}
    evidence = {r["doc_id"]: r["evidence"] for r in toxicity.score(d, index).collect()}
    label = dict(labels)
    for i, _ in docs[:60]:
        if i not in units:
            assert evidence[i] == []
            continue
        cosine = {j: sum(x * v.get(f, 0.0) for f, x in units[i].items()) for j, v in units.items()}
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[:7]
        got = [(e["id"], e["cosine"]) for e in evidence[i]]
        assert np.allclose([c for _, c in got], best) and len({j for j, _ in got}) == len(got)
        assert all(abs(cosine[j] - c) < 1e-9 for j, c in got) and all(e["label"] == label[e["id"]] for e in evidence[i])
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(d, index).collect()}
    assert min(scored[i] for i, y in labels if y) > max(scored[i] for i, y in labels if not y)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "bad1"), (2, "bad1")], "doc_id long, text string")
    got = toxicity.score(odd, index).collect()
    assert len(got) == 4 and got[0]["evidence"] == [] and got[0]["score"] < 0.5 and got[2] == got[3]
    assert toxicity.score(odd.limit(0), index).count() == 0
    assert toxicity.learn(d, lab.limit(0)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    assert hit > 0.96
