"""WARC archives: writing pages with revisits and segments, and reassembling them.

Writing.  Payload digests are grouped (partial sums first; payloads that very
many pages share are joined back by broadcast) and every page whose payload an
earlier page has becomes a revisit record that refers to the record of that page.
A response holds an HTTP message whose body is framed in chunks; a block longer
than ``segment_bytes`` becomes a first record and continuation records.  Spark's text
writer with the record separator of WARC as line separator puts the records into
compressed files.

Reading.  Each file is inflated as a stream, all its gzip members one after
another, and parsed once by the lengths its records state.  Whole records are
decoded at once; segments are grouped by their origin's identifier, put in
order of their segment numbers, checked against the stated total length and
decoded.  A group is one record's segments, never more.  Revisits find their
response by a join on record identifiers; a response that very many revisit is
joined by broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._text import column, slices, utf8
from tessera.plans.joins import broadcast_if_small, left_join_hot
from tessera.plans.staging import Staging

CRLF = b"\r\n"
SEPARATOR = "\r\n\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("8a1f2b52-5f0c-4d54-9d0e-0d0f6f8f3b11")


def digest32(payload: bytes) -> str:
    """The payload's SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    """The body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c := body[i : i + size]), c) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes | None:
    """The body of a chunked message; None if the framing is broken or cut short."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        size = framed[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            # Trailer fields may follow; an empty line ends the message.
            return b"".join(out) if framed[at : at + 2] == CRLF or framed.find(SEPARATOR.encode(), at) >= 0 else None
        if framed[at + n : at + n + 2] != CRLF:
            return None
        out.append(framed[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes | None:
    """The decoded body of an HTTP message; None if it is broken."""
    end = block.find(SEPARATOR.encode())
    if end < 0:
        return None
    head, body = block[:end].lower(), block[end + 4 :]
    return dechunked(body) if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head) else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the separator behind it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def record_id(page: object, url: str | None, sha: str) -> str:
    """The identifier of a page's record; repeated rows have one and the same."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, repr((page, url, sha)))}>"


def page_records(origin: str, page: object, url: str | None, payload: bytes, refers_to: tuple[str, str | None] | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """All records of one page: a response with its continuations, or a revisit of (record, address)."""
    clean = lambda u: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u)
    common = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    if url is not None:
        common.append(("WARC-Target-URI", clean(url)))
    if page is not None:
        common.append(("WARC-X-Page", str(page)))
    kind = "application/http; msgtype=response"
    if refers_to:
        to, address = refers_to
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", to)]
        own += [("WARC-Refers-To-Target-URI", clean(address))] if address is not None else []
        return [_record([*own, ("WARC-Refers-To-Date", DATE), ("Content-Type", kind)], HEAD + CRLF)]
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    own = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("Content-Type", kind)]
    if len(block) <= segment_bytes:
        return [_record(own, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([*own, ("WARC-Segment-Number", "1")], parts[0])]
    for no, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{origin}/{no}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(no))]
        out.append(_record([*fields, *([("WARC-Segment-Total-Length", str(len(block)))] if no == len(parts) else [])], part))
    return out


def inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file in parts of about ``step``: of all its gzip members, or as they are without gzip."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + step] for i in range(0, len(content), step))
        return
    member, begun = zlib.decompressobj(31), False
    for i in range(0, len(content), step):
        piece = content[i : i + step]
        while piece:
            if not begun:
                piece = piece.lstrip(b"\0")  # padding between members
                if not piece:
                    break
            begun = True
            out = member.decompress(piece, step)
            if out:
                yield out
            piece = member.unconsumed_tail
            if member.eof:
                piece, member, begun = member.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("a gzip member is cut short")


def parse_records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive; ValueError if it is broken.

    Holds one record and one part at a time.
    """
    source, held, at = iter(parts), bytearray(), 0

    def more() -> bool:
        nonlocal at
        part = next(source, None)
        del held[:at]
        at = 0
        held.extend(part or b"")
        return part is not None

    while at < len(held) or more():
        if at == len(held):
            continue
        while (end := held.find(SEPARATOR.encode(), at)) < 0:
            if not more():
                raise ValueError("a header is cut short")
        if not held.startswith(b"WARC/", at):
            raise ValueError("no WARC record")
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        at, n = end + 4, int(fields["content-length"])
        while len(held) - at < n + 4:
            if not more():
                break
        if len(held) - at < n:
            raise ValueError("a record is cut short")
        yield fields, bytes(held[at : at + n])
        if held[at + n : at + n + 4] not in (SEPARATOR.encode(), b""):
            raise ValueError("no separator behind a record")
        at = min(at + n + 4, len(held))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0, segment_bytes: int = 1 << 15, chunk_bytes: int = 1 << 12, records_per_file: int = 2000, hot_share: int = 2000
) -> None:
    """Writes a record (with continuations) per row into gzip files under ``path``.

    The payload is the HTML in UTF-8; null counts as empty.  Of equal payloads
    of at least ``least_revisit`` bytes that of the smallest id is a response and
    those of other ids revisit it; a repeated row of that id is a response too, with the same
    identifier.  A null id is larger than all others and no row refers to it.  Null addresses are left
    out.  An empty table writes no record.  Other columns are not read.  A record's block has at
    most ``segment_bytes``, so a file has at most ``records_per_file`` times that and the headers.
    """
    staging = Staging(pages.sparkSession, "warc")
    rows = pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"), F.coalesce(pages[html_col], F.lit("")).alias("_html"))
    rows = rows.withColumn("_sha", F.sha1(F.encode("_html", "UTF-8")))
    size = F.octet_length("_html").cast("long")
    sums = staging.keep(rows.select("_id", "_url", "_sha", size.alias("n")).where(F.col("n") >= least_revisit), "digests")
    head = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_url")))
    groups = staging.keep(sums.groupBy("_sha", "n").agg(head.alias("first"), F.count("*").alias("size")).where("size > 1 and first is not null"), "groups")
    members = left_join_hot(sums, groups, ["_sha", "n"], "size", max(2, sums.count() // hot_share), F.xxhash64("_id"))
    again = members.where(F.col("first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("first._id"))).select(F.col("_id").alias("_rid"), F.col("_sha").alias("_rsha"), "first").distinct()
    again = staging.keep(again, "revisits")
    marked = rows.join(broadcast_if_small(again), rows["_id"].eqNullSafe(F.col("_rid")) & (F.col("_sha") == F.col("_rsha")), "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            out = []
            given = (column(batch, c).to_pylist() for c in ("_id", "_url", "_sha", "first"))
            for page, url, sha, first, html in zip(*given, utf8(column(batch, "_html")), strict=True):
                to = first and (record_id(first["_id"], first["_url"], sha), first["_url"])
                out += page_records(record_id(page, url, sha), page, url, html, to, segment_bytes, chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = marked.select("_id", "_url", "_sha", "_html", "first").mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.mode("overwrite").option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    staging.drop("digests", "groups", "revisits")


def _decoded(block: bytes, kind: str | None, digest: str | None) -> tuple[bytes | None, str | None, bool]:
    """Payload of a record's block, its digest, and whether the framing is whole and the digest the stated one."""
    payload = http_payload(block) if (kind or "").startswith("application/http") else block
    found = None if payload is None else digest32(payload)
    ok = found is not None and digest in (None, found)
    return (payload, found, True) if ok else (None, digest, False)


_PARSED = {"record_id": pa.string(), "type": pa.string(), "page": pa.string(), "uri": pa.string(), "refers": pa.string(), "kind": pa.string(), "digest": pa.string(), "n": pa.int64(), "payload": pa.binary(), "ok": pa.bool_(), "no": pa.int32(), "total": pa.int64(), "block": pa.binary()}
_SCHEMA = "record_id string, type string, page string, uri string, refers string, kind string, digest string, n bigint, payload binary, ok boolean, no int, total bigint, block binary"


def _batches(rows: Iterator[dict], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of the parsed table in batches of about ``limit`` bytes."""

    def batch(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], t) for c, t in _PARSED.items()], list(_PARSED))

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row.get("payload") or b"") + len(row.get("block") or b"")
        if size > limit:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint", keep_payload: bool = True, hot_share: int = 2000) -> DataFrame:
    """One row per response, resource or revisit record of the files (*.gz, *.warc) under ``path``.

    Columns: ``page_id`` (null in archives of others), ``record_id``, ``uri``, ``record_type``,
    ``refers_to`` and ``refers_to_record`` (page and record that a revisit refers to),
    ``payload_digest``, ``payload_bytes``, ``payload`` and ``complete``.  Of a response they
    are those of its decoded payload; ``complete`` says whether all segments are
    there, their total length is as stated, the framing is whole and the digest is
    the stated one; otherwise the payload and its length are null and the digest is the stated one.  A revisit has the
    length of the response it refers to, no payload, and is complete if that one is there, complete and of
    the stated digest.  Records with one identifier count each, and must be the same.  Continuations
    without a first record are dropped as they belong to no page; a broken file
    raises ValueError.  Spark hands over a file's content in one value, so files have at most 2 GB.
    """
    staging = Staging(spark, "warc-read")

    def rows_of(content: bytes) -> Iterator[dict]:
        for f, block in parse_records(inflated(content)):
            kind = f["warc-type"]
            if kind not in ("response", "resource", "revisit", "continuation"):
                continue
            row = {"record_id": f.get("warc-segment-origin-id", f["warc-record-id"]), "type": kind, "page": f.get("warc-x-page"), "uri": f.get("warc-target-uri"), "refers": f.get("warc-refers-to"), "kind": f.get("content-type")}
            row["digest"] = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if "warc-segment-number" in f:
                total = f.get("warc-segment-total-length")
                row |= {"no": int(f["warc-segment-number"]), "total": int(total) if total else None, "block": block}
            elif kind != "revisit":
                payload, row["digest"], row["ok"] = _decoded(block, row["kind"], row["digest"])
                row |= {"n": len(payload) if row["ok"] else None, "payload": payload if keep_payload else None}
            yield row

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in column(batch, "content"):
                yield from _batches(rows_of(content.as_py()))

    files = spark.read.format("binaryFile").load(path).where("path like '%.gz' or path like '%.warc'").select("content")
    parsed = staging.keep(files.mapInArrow(parse, _SCHEMA), "parsed")
    kept = ["type", "page", "uri", "refers", "kind", "digest"]
    first = [F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in kept]
    # A record that stands twice has each segment twice: they count once, and the record as often as its first segment.
    parts = F.array_sort(F.collect_set(F.struct("no", "total", "block"))).alias("parts")
    segmented = parsed.where("no is not null").groupBy("record_id").agg(*first, F.count_if(F.col("no") == 1).alias("copies"), parts).where("type is not null")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[dict]:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                parts = row.pop("parts")
                block, total = b"".join(p["block"] for p in parts), parts[-1]["total"]
                whole = [p["no"] for p in parts] == list(range(1, len(parts) + 1)) and (total == len(block) if len(parts) > 1 else total in (None, len(block)))
                payload, row["digest"], row["ok"] = _decoded(block, row["kind"], row["digest"]) if whole else (None, row["digest"], False)
                row |= {"n": len(payload) if row["ok"] else None, "payload": payload if keep_payload else None}
                yield from [row] * row.pop("copies")

        for batch in batches:
            yield from _batches(rows(batch))

    whole = parsed.where("no is null").select("record_id", *kept, "n", "payload", "ok")
    records = staging.keep(whole.unionByName(segmented.mapInArrow(joined, _SCHEMA).select("record_id", *kept, "n", "payload", "ok")), "records")
    staging.drop("parsed")

    # Revisits and their responses.
    again = records.where("type = 'revisit'").drop("n", "payload", "ok").withColumn("to", F.coalesce("refers", F.lit("")))
    asked = again.groupBy("to").agg(F.count("*").alias("asked"))
    answers = records.where("type <> 'revisit'").groupBy(F.col("record_id").alias("to")).agg(F.min("page").alias("to_page"), F.min("digest").alias("to_digest"), F.min("n").alias("n"), F.min("ok").alias("ok"))
    answers = staging.keep(asked.join(answers, "to"), "answers")
    found = left_join_hot(again, answers, ["to"], "asked", max(2, records.count() // hot_share), F.xxhash64("record_id"))
    ok = F.coalesce(F.col("ok") & (F.col("digest").isNull() | (F.col("digest") == F.col("to_digest"))), F.lit(False))
    revisits = found.select("record_id", *kept, "n", F.lit(None).cast("binary").alias("payload"), ok.alias("ok"), "to_page")
    every = records.where("type <> 'revisit'").withColumn("to_page", F.lit(None).cast("string")).unionByName(revisits)
    return every.select(
        F.col("page").cast(id_type).alias("page_id"),
        "record_id",
        "uri",
        F.col("type").alias("record_type"),
        F.col("to_page").cast(id_type).alias("refers_to"),
        F.col("refers").alias("refers_to_record"),
        F.col("digest").alias("payload_digest"),
        F.col("n").alias("payload_bytes"),
        "payload",
        F.col("ok").alias("complete"),
    )
