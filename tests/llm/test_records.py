from __future__ import annotations

import base64
import gzip
import hashlib
import random
import time

import pandas as pd
import pytest

from tessera.llm.queries_quotes import LINKING_SQL, op1_quotation_linking
from tessera.llm.quotes import RunHashes, link_quotations, run_hash, runs_of
from tessera.llm.warc import chunked, dechunked, digest32, inflated, page_records, parse_records, read_archives, record_id, write_archives
from tests.conftest import SF
from tests.helpers import duck_rows, rows_of

# ---- WARC


def test_chunked_round_trip():
    for body in (b"", b"a", b"\r\n\r\n" * 50, bytes(range(256)) * 9):
        for size in (1, 7, 4096):
            framed = chunked(body, size)
            assert dechunked(framed) == body
            assert dechunked(framed[:-3]) is None
    assert dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert dechunked(b"zz\r\nabc") is None


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, first string")


ROWS = [(5, "http://a/ é\n", "héllo" * 2000), (3, None, "héllo" * 2000), (9, "u", None), (8, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (3, None, "héllo" * 2000), (None, "n", ""), (11, "v", "x" * 200_000), (12, "w", "€" * 7)]


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 300, "chunk_bytes": 7, "records_per_file": 2}, {"least_revisit": 100}, {"hot_share": 1}])
def test_archives_round_trip(spark, tmp_path, options):
    path = f"file://{tmp_path}/w"
    write_archives(pages(spark, ROWS), path, **options)
    got = read_archives(spark, path).collect()
    assert len(got) == len(ROWS) and all(r["complete"] for r in got)
    want = []
    least = options.get("least_revisit", 0)
    for i, _, h in ROWS:
        data = (h or "").encode()
        first = min((j for j, _, g in ROWS if (g or "") == (h or "") and j is not None), default=None)
        again = len(data) >= least and first is not None and i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None, None if again else data))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def records_of(page, payload, refers=None):
    return page_records(record_id(page, "u", digest32(payload)), page, "u", payload, refers, 500, 100)


def packed(records):
    return b"".join(r + b"\r\n\r\n" for r in records)


def test_missing_segments_are_noticed(spark, tmp_path):
    records, whole = records_of(1, b"abc" * 1000), records_of(2, b"ok")
    (tmp_path / "a.warc").write_bytes(packed([*reversed(records[:3]), *records[4:], *whole]))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(packed(records_of(3, b"abc" * 999)[::-1])))
    lost = (record_id(1, "u", digest32(b"abc" * 1000)), None)
    (tmp_path / "c.warc").write_bytes(packed([*records_of(4, b"abc" * 1000, lost), *records_of(5, b"ok", (record_id(2, "u", digest32(b"ok")), None)), *records_of(6, b"ok", ("<urn:uuid:none>", "u"))]))
    rows = {r["page_id"]: r for r in read_archives(spark, f"file://{tmp_path}").collect()}
    got = {i: (r["complete"], r["payload_bytes"], r["payload"] and bytes(r["payload"])) for i, r in rows.items()}
    assert got == {1: (False, None, None), 2: (True, 2, b"ok"), 3: (True, 2997, b"abc" * 999), 4: (False, None, None), 5: (True, 2, None), 6: (False, None, None)}
    assert [rows[i]["refers_to"] for i in (4, 5, 6)] == [1, 2, None]
    for broken in (records[0][:-5], b"WARC/1.1\r\nx", b"junk\r\n\r\n", packed(whole) + b"more"):
        with pytest.raises(ValueError):
            list(parse_records([broken]))


def test_all_gzip_members_are_read(spark, tmp_path):
    every = [r for i in range(5) for r in records_of(i, b"%d" % i * 700)]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(packed([r])) for r in every) + b"\0" * 100)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(packed(records_of(7, b"seven"))) + gzip.compress(packed(records_of(8, b"eight"))))
    got = read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == [*((i, b"%d" % i * 700) for i in range(5)), (7, b"seven"), (8, b"eight")]
    data = (tmp_path / "two.warc.gz").read_bytes()
    for step in (1, 7, 1000):
        assert b"".join(inflated(data, step)) == packed([*records_of(7, b"seven"), *records_of(8, b"eight")])
        assert [b for _, b in parse_records(inflated(data, step))] == [r.split(b"\r\n\r\n", 1)[1] for r in [*records_of(7, b"seven"), *records_of(8, b"eight")]]
    with pytest.raises(ValueError):
        list(inflated(data[:-5]))


def test_archive_of_others(spark, tmp_path):
    """No fields of our own; other record types and plain blocks; identifiers by chance repeated."""
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello"
    rec = lambda *fields, block: b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"Content-Length: %d\r\n\r\n" % len(block) + block
    info = rec(("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>"), block=b"software: y\r\n")
    response = rec(("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http;msgtype=response"), block=http)
    resource = rec(("WARC-Type", "resource"), ("WARC-Record-ID", "<s>"), ("content-type", "text/plain"), block=b"plain")
    revisit = rec(("WARC-Type", "revisit"), ("WARC-Record-ID", "<v>"), ("WARC-Refers-To", "<r>"), block=b"")
    (tmp_path / "x.warc").write_bytes(packed([info, response, response, resource, revisit]))
    got = sorted((r["record_id"], r["record_type"], r["uri"], r["payload_bytes"], r["refers_to_record"], r["complete"]) for r in read_archives(spark, f"file://{tmp_path}").collect())
    assert got == [("<r>", "response", "http://a/", 5, None, True)] * 2 + [("<s>", "resource", None, 5, None, True), ("<v>", "revisit", None, 5, "<r>", True)]


def test_empty_pages(spark, tmp_path):
    write_archives(pages(spark, ROWS).limit(0), f"file://{tmp_path}/w")
    assert read_archives(spark, f"file://{tmp_path}/w").count() == 0


# ---- quotations

CONVERSATIONS = [
    (1, 0, "user", "Hello there\nHow are you?\n\nSecond   paragraph of mine"),
    (1, 1, "assistant", "> How are you?\nFine, thanks."),
    (1, 2, "user", "Bob wrote:\n>> How ARE you?\n> Fine,  thanks.\nGood to hear."),
    (1, 3, "assistant", "> second paragraph of mine\n\nNoted."),
    (1, 4, "user", "> nobody said this\nReally?"),
    (1, 5, "user", "> Good to hear.\n> > Fine, thanks.\nIndeed\r\n> Noted.\rEnd"),
    (2, 0, "user", "> How are you?\n"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 3, "user", "Fine, thanks."),
    (3, 7, "user", "x"),
    (3, 8, "user", ">x\n>\n>x"),
    (3, 9, "user", "> > > x\n>x"),
    (4, 0, "user", "One line\nwrapped here\n\nthen more\n\nand more"),
    (4, 1, "user", "> one line wrapped here\n>\n> then more\nTwo paragraphs, wrapped otherwise"),
    (4, 2, "user", "> wrapped here\n> then more\nLines of two paragraphs"),
    (4, 3, "user", "> line\n> wrapped here\nNot a whole line"),
    (0, 9, "user", "> then more\nBefore it was said"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def compare(spark, rows):
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    linked = link_quotations(spark.createDataFrame(rows, SCHEMA))
    want_names, want = duck_rows(f"WITH RECURSIVE {LINKING_SQL}", messages=frame.assign(mid=range(len(frame))))
    names, got = rows_of(linked)
    assert names == want_names and got == want
    return linked


def test_quotations_equal_sql(spark):
    rows = compare(spark, CONVERSATIONS).collect()
    by = {(r["conv_id"], r["turn"]): r for r in rows}
    parent = lambda *k: (by[k]["parent_conv"], by[k]["parent_turn"], by[k]["depth"])
    assert parent(1, 2) == (1, 1, 2) and by[1, 2]["body"] == "Good to hear."
    assert parent(1, 3) == (1, 0, 1) and parent(1, 4) == (None, None, 0) and parent(1, 5) == (1, 3, 2)
    assert parent(2, 0) == (1, 0, 1) and by[2, 0]["thread_conv"] == 1  # another conversation's
    assert parent(4, 1) == parent(4, 2) == (4, 0, 1) and parent(4, 3) == parent(0, 9) == (None, None, 0)
    order = [(r["conv_id"], r["turn"]) for r in rows]
    for k, r in by.items():
        assert r["parent_turn"] is None or order.index((r["parent_conv"], r["parent_turn"])) < order.index(k)


def test_random_quotations_equal_sql(spark):
    rng, rows = random.Random(11), []
    said = [[]]
    for conv in range(12):
        for turn in range(10):
            lines = [rng.choice(["", "", *(f"Line {i}" for i in range(14))]) for _ in range(rng.randrange(7))]
            text = []
            for _ in range(rng.randrange(3)):
                source = rng.choice(said)
                i = rng.randrange(len(source) + 1)
                marks = rng.choice(["> ", ">", ">> ", "> > > "])
                text += [marks + x for x in source[i : i + rng.randrange(1, 5)]] + rng.choice([[], ["Indeed"]])
            said.append(lines)
            rows.append((conv, turn, "user", "\n".join([*text, *lines])))
    linked = compare(spark, rows)
    assert linked.where("n_linked > 0").count() > 40 and linked.where("parent_conv <> conv_id").count() > 5 and linked.where("depth > 2").count() > 0


def test_runs_of_a_repeated_line_take_little_time():
    rng = random.Random(3)
    seq = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(40)]
    every = RunHashes(seq)
    assert all(every.run(a, n) == run_hash(seq[a : a + n]) for a in range(40) for n in range(1, 41 - a))
    assert len({every.run(a, n) for a in range(40) for n in range(1, 41 - a)}) == 820
    began = time.perf_counter()
    found = runs_of([[7] * 5000], [{"seq": 0, "pos": k} for k in range(5000)], [{"first": 7, "lengths": list(range(1, 21))}])
    assert len(found) == 20 and time.perf_counter() - began < 0.5


def test_common_lines_are_dealt_out(spark):
    rows = [(c, t, "u", f"Hello\nsame\nnumber {c}" if t == 0 else "> hello\n> same\nyes") for c in range(30) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain, hot = (sorted(map(tuple, link_quotations(df, hot_share=h).collect())) for h in (1, 10**6))
    assert plain == hot and sum(r[6] for r in plain) == 60


def test_quotations_edges(spark):
    df = spark.createDataFrame([(None, 1, "a", "> x"), (1, None, "b", "x"), (1, 1, "c", "x"), (1, 1, "d", "x"), (1, 2, "e", "> x"), (1, 2, "e", "> x")], "conv_id long, turn int, rid string, text string")
    got = link_quotations(df)
    assert got.count() == 6 and got.where("parent_turn = 1").count() == 2 and "rid" in got.columns
    assert link_quotations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        link_quotations(df.withColumnRenamed("rid", "body"))


def test_query_links_what_its_replies_quote(spark):
    got = op1_quotation_linking(spark, SF)
    assert got.count() == got.select("conv_id", "turn").distinct().count()
    assert got.where("role = 'reply' and n_quotes > 0 and n_linked = 0").count() == 0
    assert got.where("role = 'digest' and n_linked > 0 and parent_conv <> conv_id").count() > 0
