"""WARC writing and reading, with segment reassembly.

Writing: one record for each row of pages. Of rows with equal payloads the one with the smallest page_id is a
``response``; the others are ``revisit`` records that refer to it. A response's block is an HTTP head and the
payload in chunked transfer framing. A block over the segment size is split: the first segment stays a response
with number 1, the rest become ``continuation`` records that carry the first one's identifier as their origin;
the last one states the total length. A revisit's block is the HTTP head alone, with the length of the payload that it leaves out. A
``warcinfo`` record opens each archive. Spark's text writer stores the records, so a lost task writes its file
again and nothing half-written is published. An archive is one gzip member: any WARC reader reads it from its start, none can seek in it.

Reading: archives are unpacked and parsed as a stream and cut by each record's stated length, never by
searching for separators. Segments are then grouped by origin, ordered by number, checked for gaps and against
the total length, joined, and freed from the chunked framing. A payload whose digest is not the stated one, and a record cut short, raise.

A payload that a third of all pages share is one row of the digest plan, from each task; its pages meet that row in a join whose
skewed side adaptive execution splits.

Edge cases: a null payload is empty; a null url becomes an empty target. Every row has a record of its own, whether its page_id is
null or repeated. Ids are compared where they are known: a row without one is a response only if no row of its payload has one, and
revisits refer to the smallest known one. Equal rows that share the smallest page_id are all responses. Empty
tables write no record and read as no rows. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.shared import materialize, shared_folder

#: Payload characters in one chunk of the transfer framing, characters of a block in one segment, records in one archive.
CHUNK_CHARS, SEGMENT_CHARS, ARCHIVE_RECORDS = 4096, 32768, 2000
#: Bytes unpacked at a time; records handed on at a time, and their bytes.
UNPACK, TOGETHER, TOGETHER_BYTES = 1 << 20, 500, 8 << 20
END = "\r\n\r\n"
RECORDS = "kind string, record_id string, origin string, number int, total long, page_id long, refers_to long, digest string, block binary"
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = "urn:evifuse:page:"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def dedupe_plan(pages: DataFrame) -> DataFrame:
    """hex, first, n_first of payloads that several rows have: their SHA-1, the smallest page_id and how many rows have both.

    Only digests travel, and counts are added up before they do.
    """
    keyed = pages.select("page_id", payload_hex().alias("hex")).groupBy("hex", "page_id").agg(F.count(F.lit(1)).alias("n"))
    plan = keyed.groupBy("hex").agg(F.sum("n").alias("rows"), F.min("page_id").alias("first"), F.min_by("n", F.coalesce("page_id", F.lit((1 << 63) - 1))).alias("n_first"))
    return materialize(plan.where("rows > 1").drop("rows"), "warc-plan")


def payload_hex() -> F.Column:
    return F.sha1(F.coalesce("html", F.lit("")))


def head(kind: str, record_id: str, length: int, more: list[tuple[str, object]]) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    return "\r\n".join([*lines, *(f"{k}: {v}" for k, v in more), f"Content-Length: {length}"]) + END


def chunked(payload: str) -> str:
    """The payload in chunked transfer framing; sizes are bytes in hexadecimal."""
    parts = [payload[i : i + CHUNK_CHARS] for i in range(0, len(payload), CHUNK_CHARS)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0" + END


def records_of(page_id: int | None, url: str | None, html: str | None, revisits: bool, first: int | None, lone: bool) -> Iterator[str]:
    """The records of one page, without the blank lines that end each. A record that is not ``lone`` under its id and digest gets a number of its own."""
    html = html or ""
    payload = html.encode()
    digest = base32_sha1(payload)
    record_id = f"{NAMESPACE}{'none' if page_id is None else page_id}:{digest}" + ("" if lone else f":{uuid.uuid4().hex}")
    target = re.sub(r"[\r\n]", " ", url or "")
    base = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisits:
        block = f"{http}Content-Length: {len(payload)}{END}"
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        refers = [] if first is None else [("WARC-Refers-To", f"<{NAMESPACE}{first}:{digest}>")]
        yield head("revisit", record_id, len(block.encode()), [*base, ("WARC-Profile", profile), *refers]) + block
        return
    block = f"{http}Transfer-Encoding: chunked{END}{chunked(html)}"
    segments = [block[i : i + SEGMENT_CHARS] for i in range(0, len(block), SEGMENT_CHARS)]
    total = len(block.encode())
    for i, segment in enumerate(segments):
        more = list(base) if i == 0 else [("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", f"<{record_id}>")]
        if len(segments) > 1:
            more.append(("WARC-Segment-Number", i + 1))
            if i == len(segments) - 1:
                more.append(("WARC-Segment-Total-Length", total))
        yield head("continuation" if i else "response", record_id if i == 0 else f"{record_id}/{i + 1}", len(segment.encode()), more) + segment


def info() -> str:
    """The record that opens an archive."""
    block = "software: evifuse\r\nformat: WARC File Format 1.1\r\n"
    return head("warcinfo", f"urn:uuid:{uuid.uuid4()}", len(block), [("Content-Type", "application/warc-fields")]) + block


def write(pages: DataFrame, path: str) -> str:
    """Write a record for each row of (page_id, url, html) under ``path``; returns it."""
    pages = pages.select("page_id", "url", "html")
    per_file = ARCHIVE_RECORDS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for row in batch.to_pylist():
                lines = []
                for record in records_of(**row):
                    if written % per_file == 0:  # the writer begins a file after as many lines
                        lines.append(info())
                        written += 1
                    lines.append(record)
                    written += 1
                yield pa.record_batch({"value": lines})

    joined = pages.withColumn("hex", payload_hex()).join(dedupe_plan(pages), "hex", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first")) | F.col("n_first").isNull()
    lone = F.col("n_first").isNull() | (F.col("n_first") == 1) & is_first & F.col("page_id").isNotNull()
    rows = joined.select("page_id", "url", "html", (~is_first).alias("revisits"), "first", lone.alias("lone"))
    records = rows.mapInArrow(task, "value string")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def unpacked(raw: bytes) -> Iterator[bytes]:
    """An archive's bytes, a part at a time: as they are, or all members of a gzip file."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + UNPACK] for i in range(0, len(raw), UNPACK))
        return
    while raw:
        member, left = zlib.decompressobj(31), raw
        while left and not member.eof:
            yield member.decompress(left, UNPACK)
            left = member.unconsumed_tail
        if not member.eof:
            raise ValueError("an archive is cut short")
        raw = member.unused_data


def parse(parts: Iterator[bytes]) -> Iterator[tuple]:
    """The records of one archive, by their stated lengths, as its bytes come."""
    held, at, offset = bytearray(), 0, 0

    def more(size: int) -> bool:
        """Have ``size`` bytes from ``at``."""
        nonlocal held, at, offset
        while len(held) - at < size:
            part = next(parts, None)
            if part is None:
                return False
            offset += at
            del held[:at]
            at = 0
            held += part
        return True

    while more(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + max(seen - 3, 0))) < 0:
            seen = len(held) - at
            if not more(seen + 1):
                raise ValueError(f"record at byte {offset + at} is cut short")
        lines = held[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {offset + at}")
        named = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        size, head_size = int(named["content-length"]), end + 4 - at
        if not more(head_size + size + 4) or held[at + head_size + size : at + head_size + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {offset + at} is cut short")
        block = bytes(held[at + head_size : at + head_size + size])
        at += head_size + size + 4
        kind = named["warc-type"]
        if kind == "warcinfo":
            continue
        record_id = named["warc-record-id"].strip("<>")
        origin = named.get("warc-segment-origin-id", "").strip("<>") or record_id
        total = named.get("warc-segment-total-length")
        yield (
            kind, record_id, origin, int(named.get("warc-segment-number", 1)), int(total) if total else (None if kind == "continuation" or "warc-segment-number" in named else size), page_of(origin),
            page_of(named.get("warc-refers-to", "").strip("<>")), named.get("warc-payload-digest", "").removeprefix("sha1:") or None, block,
        )


def page_of(record_id: str) -> int | None:
    """The page_id in a record's identifier."""
    page = record_id.removeprefix(NAMESPACE).partition(":")[0]
    return int(page) if page not in ("", "none") else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``: see ``RECORDS``."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for row in parse(unpacked(archive.as_py())):
                    rows.append(row)
                    held += len(row[-1])
                    if len(rows) >= TOGETHER or held >= TOGETHER_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(task, RECORDS)


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked transfer framing."""
    at, out = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk of another length than stated")
        at = end + 4 + size


def payload_of(block: bytes) -> tuple[bytes, int]:
    """The payload of an HTTP response, and its length; a revisit states that without the payload."""
    http, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" in http.lower():
        body = unchunk(body)
    stated = re.search(rb"(?im)^content-length: *(\d+)", http)
    return body, int(stated[1]) if stated else len(body)


def reassemble(records: DataFrame) -> DataFrame:
    """page_id, kind, refers_to, digest, payload, payload_bytes: whole records again.

    Records of one segment pass straight through; only segmented ones are grouped by their origin. A set
    with a gap, or of another length than stated, raises.
    """
    lone = records.where("number = 1 and total is not null")
    parts = records.where("number > 1 or total is null")
    gathered = (
        parts.groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("segments"),
            F.max("total").alias("total"),
            F.min_by("page_id", "number").alias("page_id"),
            F.max("digest").alias("digest"),
        )
        .select(F.lit("response").alias("kind"), "page_id", F.lit(None).cast("long").alias("refers_to"), "digest", "segments", "total")
    )
    whole = lone.select("kind", "page_id", "refers_to", "digest", F.array(F.struct("number", "block")).alias("segments"), "total")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, sizes = [], []
            for page_id, kind, digest, segments, total in zip(*(batch.column(c).to_pylist() for c in ("page_id", "kind", "digest", "segments", "total"))):
                block = b"".join(s["block"] for s in segments)
                if [s["number"] for s in segments] != list(range(1, len(segments) + 1)) or len(block) != total:
                    raise ValueError(f"segments of page {page_id} are missing or of another length than stated")
                payload, size = payload_of(block)
                payloads.append(payload)
                sizes.append(size)
                if kind == "response" and digest != base32_sha1(payloads[-1]):
                    raise ValueError(f"the payload of page {page_id} has another digest than stated")
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("kind", "page_id", "refers_to", "digest")] + [pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64())], names)

    schema = "kind string, page_id long, refers_to long, digest string, payload binary, payload_bytes long"
    names = [c.split()[0] for c in schema.split(", ")]
    return whole.unionByName(gathered).mapInArrow(task, schema)


def write_and_read(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the written archives."""
    spark = pages.sparkSession
    path = write(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return reassemble(read_records(spark, path)).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
