"""The tree of beginnings against a tree of Python tuples."""

from __future__ import annotations

import hashlib
import random
from binascii import crc32

import pytest

from tessera.llm import conversation_trie as trie
from tessera.llm.queries_trie import op13_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c, ts in own.items():
        base, h = own.get(int(c / 20) * 20, []), crc32(str(c).encode()) % 4
        made = tuple(base[:h] + ts[h:])
        for d in range(len(made) + 1):
            nodes.setdefault(made[:d], []).append((c, len(made) == d))
    words = lambda s: len(s.translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).replace("\x00", "x").split(" ")) - s.translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).split(" ").count("")
    out = []
    children = {}
    for k in nodes:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        gain = (len(members) - 1) * words(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += gain
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, e in members if e)))
        up = min(c for c, _ in nodes[k[:-1]]) if k else None
        out.append((min(c for c, _ in members), len(k), up, len(members), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/conversations.parquet")
    got = op13_conversation_trie(spark, str(path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_shared_and_odd_conversations(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t if t != 1 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d\te\x0b f g"]), "x") for c in [*range(-30, 70, 3), *range(0, 61, 20)] for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "nobody", "x"), (7, 2, "user", "tie", "x"), (7, 2, "user", "eit", "x"), (7, 2, "user", "tie", "x"), (500, 0, "user", "no base", None)]
    rows += [(c, t, "user", f"same {t}", None) for c in range(1000, 1200) for t in range(4)]
    assert result(spark, rows, tmp_path) == brute(rows)


def test_long_conversations_in_lots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "LOT", 4)
    monkeypatch.setattr(trie, "JOINED", 3)
    rows = [(c, t, "user", f"turn {t if t < stop else (c, t)}", None) for c, stop in ((0, 40), (1, 9), (2, 40), (20, 8), (21, 12), (40, 3), (3, 4)) for t in range(37)]
    rows += [(c, 0, "user", "turn 0", None) for c in range(100, 130)]
    assert result(spark, rows, tmp_path) == brute(rows)


def test_empty(spark, tmp_path):
    assert result(spark, [], tmp_path) == []


@pytest.mark.parametrize("rows", [[(5, 0, "user", "one", None)], [(20, 0, None, None, None), (5, 0, None, None, None)]])
def test_tiny(spark, tmp_path, rows):
    assert result(spark, rows, tmp_path) == brute(rows)
