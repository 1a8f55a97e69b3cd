"""Line deduplication over all documents, as compressed keep bitmaps.

A line's key is the line without white space at both ends, A-Z lower-cased; only its 128-bit digest travels. Digests are
parted by ranges of (digest, document) and sorted within each part by document, the largest first, and position, so
a task streams a digest's occurrences, the first document of each ahead. A digest that lies within one part is decided there, a
few rows held at most. The first and the last digest of a part may go on in its neighbours: of these each part states
how many documents it saw and the first, two rows a part, which are summed and told to the rows left open. So a line that
a third of all documents hold is dealt over many parts. What is dropped becomes a bitmap of the lines that each document keeps; texts are
met again only where somebody wants the text.

Edge cases: a null or empty text is one empty line. Shorter keys and those of fewer documents stay. Equal lines within the
document that keeps a key all stay. Documents are told by doc_id: repeated rows and different texts under one doc_id count as one
document, and each row gets the bitmap of its own text. Rows without a doc_id count as no document and lose what others make
them lose. An empty table gives no rows. Other columns of the input are left out, so clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.llm.shared import materialize, raw_texts

#: Code points of a key, documents that hold it.
LEAST_CHARS, LEAST_DOCS = 40, 5

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CONTINUATION = bytes(range(0x80, 0xC0))
WHITE = b" \t\n\v\f\r"

LINES = "hi long, lo long, doc_id long, row long, place long"
DECIDED = "hi long, lo long, doc_id long, row long, place long, n long, first long"
INTS = pa.int64()


def key_of(line: bytes) -> bytes:
    return line.strip(WHITE).translate(LOWER)


def long_lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A row for each line whose key is long enough. place: lines of the text, then the line's number, in the halves of a long."""
    for batch in batches:
        for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), raw_texts(batch)):
            lines = (text or b"").split(b"\n")
            digests, places = [], []
            for i, line in enumerate(lines):
                key = key_of(line)
                if len(key) >= least and len(key.translate(None, CONTINUATION)) >= least:
                    digests.append(blake2b(key, digest_size=16).digest())
                    places.append(len(lines) << 32 | i)
            if places:
                halves, n = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), len(places)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([doc_id] * n, INTS), pa.array([row] * n, INTS), pa.array(places, INTS)], ["hi", "lo", "doc_id", "row", "place"])


@dataclass
class Rows:
    """Occurrences as arrays; where ``known`` is false the document has no id."""

    hi: np.ndarray
    lo: np.ndarray
    doc: np.ndarray
    known: np.ndarray
    row: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Rows:
        plain = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id")
        return cls(plain("hi"), plain("lo"), doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False), plain("row"), plain("place"))

    def take(self, which) -> Rows:
        return Rows(*(getattr(self, name)[which] for name in self.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.hi)


@dataclass
class Run:
    """One digest's occurrences so far: its documents, the first of them, and the rows that wait for the decision."""

    key: tuple[int, int]
    edge: bool
    n: int = 0
    first: int | None = None
    last: int | None = None
    waiting: list[Rows] = field(default_factory=list)


def _batch(rows: Rows, keyed: bool) -> pa.RecordBatch:
    """Rows to drop, or with their digests rows left open."""
    n = len(rows)
    digest = [pa.array(rows.hi), pa.array(rows.lo)] if keyed else [pa.nulls(n, INTS)] * 2
    docs = pa.array(rows.doc, INTS, mask=~rows.known)
    return pa.RecordBatch.from_arrays([*digest, docs, pa.array(rows.row), pa.array(rows.place), pa.nulls(n, INTS), pa.nulls(n, INTS)], ["hi", "lo", "doc_id", "row", "place", "n", "first"])


def _stated(run: Run) -> pa.RecordBatch:
    values = [run.key[0], run.key[1], None, None, None, run.n, run.first]
    return pa.RecordBatch.from_arrays([pa.array([v], INTS) for v in values], ["hi", "lo", "doc_id", "row", "place", "n", "first"])


def _others(rows: Rows, first: int) -> Rows:
    return rows.take(~rows.known | (rows.doc != first))


def _extended(run: Run, rows: Rows, least: int) -> Iterator[pa.RecordBatch]:
    """More occurrences of an open run, documents descending, those without an id last."""
    docs = rows.doc[rows.known]
    if len(docs):
        run.n += int((docs[1:] != docs[:-1]).sum()) + (docs[0] != run.last)
        run.first, run.last = (int(docs[0]) if run.first is None else run.first), int(docs[-1])
    if run.edge:
        yield _batch(rows, True)
        return
    run.waiting.append(rows)
    if run.n >= least:
        for held in run.waiting:
            yield _batch(_others(held, run.first), False)
        run.waiting = []


def _closed(run: Run, at_end: bool) -> Iterator[pa.RecordBatch]:
    if run.edge or at_end:
        yield _stated(run)
        for held in run.waiting:
            yield _batch(held, True)


def first_occurrences(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Stream a part sorted by (digest, document descending, place): rows to drop, rows left open, statements on the part's edges."""
    run: Run | None = None
    for batch in batches:
        rows = Rows.of(batch)
        if not len(rows):
            continue
        fresh = np.concatenate([[True], (rows.hi[1:] != rows.hi[:-1]) | (rows.lo[1:] != rows.lo[:-1])])
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(rows))
        key = lambda i: (int(rows.hi[i]), int(rows.lo[i]))
        if run is None or run.key != key(0):
            if run is not None:
                yield from _closed(run, False)
            run = Run(key(0), run is None)
        yield from _extended(run, rows.take(slice(0, ends[0])), least)
        if len(starts) == 1:
            continue
        yield from _closed(run, False)
        if len(starts) > 2:  # digests that begin and end within this batch
            changed = fresh | np.concatenate([[True], rows.doc[1:] != rows.doc[:-1]])
            lengths = ends - starts
            heavy = np.add.reduceat((changed & rows.known).astype(np.int64), starts) >= least
            heavy[[0, -1]] = False
            first = np.repeat(rows.doc[starts], lengths)
            gone = np.repeat(heavy, lengths) & (~rows.known | (rows.doc != first))
            if gone.any():
                yield _batch(rows.take(gone), False)
        run = Run(key(starts[-1]), False)
        yield from _extended(run, rows.take(slice(starts[-1], len(rows))), least)
    if run is not None:
        yield from _closed(run, True)


def dropped(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, row, place: every line that goes. docs: doc_id, row, text."""
    lines = materialize(docs.mapInArrow(lambda batches: long_lines(batches, least_chars), LINES), "lines")
    order = ["hi", "lo", F.desc_nulls_last("doc_id")]
    parted = lines.repartitionByRange(*order).sortWithinPartitions(*order, "row", "place")
    decided = materialize(parted.mapInArrow(lambda batches: first_occurrences(batches, least_docs), DECIDED), "lines-decided")
    edges = decided.where("n IS NOT NULL").groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("first").alias("first"))  # two rows for each part at most
    heavy = F.broadcast(edges.where(F.col("n") >= least_docs).select("hi", "lo", F.col("first").alias("kept")))
    left_open = decided.where("n IS NULL AND hi IS NOT NULL").select("hi", "lo", "doc_id", "row", "place")
    told = left_open.join(heavy, ["hi", "lo"]).where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("kept")))
    return decided.where("hi IS NULL").select("doc_id", "row", "place").unionByName(told.select("doc_id", "row", "place"))


def keep_bitmap(places: list[int]) -> bytes:
    """zlib of a bit for each line, the first in the highest place: 1 where the line stays."""
    keep = np.ones(places[0] >> 32, bool)
    keep[np.array(places, np.int64) & 0xFFFFFFFF] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, list[bytes]]:
    """Lines of a text, and those that its bitmap keeps."""
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return len(lines), [line for line, k in zip(lines, keep) if k]


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text")


def bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, row, keep: a bitmap for each document that loses lines; ``row`` is the hash that ``rows_of`` gives a text."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([keep_bitmap(x) for x in batch.column("places").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), keep], ["doc_id", "row", "keep"])

    places = dropped(rows_of(docs), least_chars, least_docs).groupBy("doc_id", "row").agg(F.collect_set("place").alias("places"))  # a document's own lines
    return places.mapInArrow(packed, "doc_id long, row long, keep binary")


def with_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text, keep; ``keep`` is null where nothing goes."""
    found = bitmaps(docs, least_chars, least_docs).withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    rows = rows_of(docs)
    return rows.join(found, rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["row"] == F.col("_row")), "left").select("doc_id", "text", "keep")


def texts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text: the lines that stay, joined by \\n."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b"\n".join(kept_lines(t or b"", k)[1]) for t, k in zip(raw_texts(batch), batch.column("keep").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return with_bitmaps(docs, least_chars, least_docs).mapInArrow(joined, "doc_id long, text string")


def digests(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, keep: what each document's bitmap leaves of it."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, keep in zip(raw_texts(batch), batch.column("keep").to_pylist()):
                n, kept = kept_lines(text or b"", keep)
                out.append((n, n - len(kept), sha256(b"\n".join(kept)).hexdigest()))
            n, gone, digest = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, INTS), pa.array(gone, INTS), pa.array(digest, pa.string()), batch.column("keep")], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep"])

    return with_bitmaps(docs, least_chars, least_docs).mapInArrow(told, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep binary")


SQL = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
heavy AS (SELECT key, max(doc_id) AS kept FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT doc_id, pos, line, coalesce(doc_id <> kept, false) AS gone FROM k LEFT JOIN heavy USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
