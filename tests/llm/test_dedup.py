from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm.exact_dedup import BASES, PRIMES, _copied, _powers, exact_dedup, fingerprint_pieces
from tessera.llm.near_dedup import near_dedup, packed

SCHEMA = "doc_id long, text string, keep_id string, size string, label string, bucket string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", None) for i, t in rows], SCHEMA)


def exact_brute(rows):
    key = lambda t: t or ""
    out = []
    for i, t in rows:
        same = [j for j, u in rows if key(u) == key(t)]
        keep = max(same, key=lambda j: (j is not None, j or 0))
        out.append((i, keep, len(same), keep == i, hashlib.sha256(key(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_fingerprints_compose():
    rng = random.Random(3)
    data = rng.randbytes(1000)
    whole = fingerprint_pieces([data], _powers(1001, PRIMES))[0]
    for k, p in enumerate(PRIMES):
        h = 0
        for byte in data:
            h = (h * BASES[k] + byte) % p
        acc = 0
        for a, b in ((0, 7), (7, 7), (7, 500), (500, 1000)):
            part = fingerprint_pieces([data[a:b]], _powers(1001, PRIMES))[0]
            acc = (acc * part[2 * k + 1] + part[2 * k]) % p
        assert acc == h == whole[2 * k]


ROWS = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (5, "é" * 40), (6, "é" * 40), (None, "a b"), (7, "solo"), (8, "é" * 39 + "x"), (7, "other"), (9, "x" * 5000), (10, "x" * 5000)]


@pytest.mark.parametrize("options", [{}, {"piece_bytes": 7}, {"piece_bytes": 16, "primes": (3, 3), "lot_rows": 1}, {"hot_share": 1}])
def test_exact_against_brute_force(spark, options):
    got = exact_dedup(table(spark, ROWS), **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == exact_brute(ROWS)


def test_exact_many_collisions_and_copies(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["aa", "ab", "ba", "bb", "ccc", "cdc", ""])) for i in range(300)]
    got = exact_dedup(table(spark, rows), primes=(2, 2), piece_bytes=1, lot_rows=5, hot_share=3).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == exact_brute(rows)


def test_exact_large_group_beyond_broadcast(spark, monkeypatch):
    """A representative of many lots, itself a repeated row, where no join is a broadcast."""
    monkeypatch.setattr("tessera.llm.exact_dedup.broadcast_if_small", lambda df: df)
    rows = [(i, "hot text") for i in range(101)] + [(100, "hot text")] * 3 + [(200, "one"), (201, None), (202, "")]
    got = exact_dedup(table(spark, rows), piece_bytes=3, lot_rows=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == exact_brute(rows)


def test_copies_reach_every_lot(spark):
    lots = {1: 1, 2: 2, 3: 3, 4: 10, 5: 17, 6: 1000}
    heads = spark.createDataFrame([(k, 0, b"p", n) for k, n in lots.items()] * 2, "keep_id long, no int, piece binary, lots long")
    got = sorted((r.keep_id, r.lot) for r in _copied(heads).collect())
    assert got == [(k, i) for k, n in lots.items() for i in range(n)]


def shingles(text, n):
    words = [w for w in re.split(r"[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return set()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {" ".join(words)}


def near_brute(rows, n=4, percent=80):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def varied(rng, words, rate):
    return " ".join(rng.choice("abcdefgh") * 3 + str(rng.random())[:5] if rng.random() < rate else w for w in words)


def test_near_against_brute_force(spark):
    rng = random.Random(7)
    rows, k = [], 0
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 40, 150]))]
        for _ in range(25):
            rows.append((k, varied(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n\t "), (k + 3, "One two"), (k + 4, "one  TWO"), (k + 5, "é É"), (k + 6, "é é")]
    rng.shuffle(rows)
    for options in ({}, {"block_shingles": 400, "hot_share": 5}):
        got = near_dedup(table(spark, rows), words=4, percent=80, **options)
        assert sorted(map(tuple, got.collect())) == near_brute(rows)


def test_near_repeated_rows_with_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    other = [*base[:-1], "changed"]
    rows = [(1, " ".join(base))] * 200 + [(2, " ".join(other))] * 200 + [(3, "quite another text with some words")]
    got = near_dedup(table(spark, rows), words=4, percent=80).groupBy("doc_id", "component_id", "kept").count()
    assert sorted(map(tuple, got.collect())) == [(1, 1, True, 200), (2, 1, False, 200), (3, 3, True, 1)]


def test_near_many_copies_of_one_leader(spark, monkeypatch):
    from tessera.llm import near_dedup as module

    monkeypatch.setattr(module.with_lots, "__defaults__", (8,))
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if k != i % 150 else f"x{i}" for k, w in enumerate(base))) for i in range(120)]
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    assert sorted(map(tuple, near_dedup(table(spark, rows), words=4, percent=80).collect())) == near_brute(rows)


def test_near_null_ids_and_repeats(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, None)]
    got = sorted(map(tuple, near_dedup(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 1, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)], key=repr)


def test_empty_tables(spark):
    empty = table(spark, [(1, "a")]).limit(0)
    assert exact_dedup(empty).count() == 0
    assert near_dedup(empty).count() == 0


def test_packed_keeps_low_bits():
    m = np.arange(32, dtype=np.uint32) * 7
    words = [w & (2**64 - 1) for w in packed(m)]
    assert [(words[i // 16] >> (4 * (i % 16))) & 15 for i in range(32)] == [(7 * i) & 15 for i in range(32)]
