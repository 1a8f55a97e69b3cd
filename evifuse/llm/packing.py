"""Best-fit packing by hierarchical residuals.

Documents become token sequences' pieces where they are read: a document over the sequence length is cut, the
first piece taking what is left over. Each task packs its own pieces best-fit (the longest first, each into
the fullest bin it fits), in rounds of bounded size. Bins that are nearly full are done. All underfull bins
go on: they are taken apart and their pieces dealt anew, evenly and differently each time, over partitions of about
``SHARE`` pieces, for another round of best-fit, until a round saves less than a bin for each task. Of what is
then left no two bins over half full can share a sequence, and a task leaves one other bin at most; these few meet
as many of the emptiest bins, which is all that they could still join, in one last task.

Only piece lengths, ids' checksums and places travel; tokens stay where they were made.

Edge cases: a null or empty text is its end token alone. Texts are tokenized whole; an added token of the vocabulary
(<|endoftext|>) inside a text is its one id. Ties are broken by doc_id
(null last) and piece, so equal input packs alike. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.llm.shared import materialize

LENGTH, END_ID = 2048, 0
#: A bin with at least so many tokens is done; pieces packed together in one round; underfull bins a task holds for its next round; pieces dealt to one task.
NEARLY_FULL, ROUND, CARRY, SHARE = 2040, 50_000, 4000, 50_000
ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = "done boolean, fill long, items array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"
Bin = tuple[int, list[dict]]


def tokenizer_of(path: str, pattern: str, kept: dict = {}):  # noqa: B006  one for each worker process
    """Encoder of a text to ids with the vocabulary and the added tokens of a tokenizers file.

    The file's own library takes over twice the CPU time that packing may use; tiktoken gives the same ids
    from the same vocabulary, which the tests hold against the file's library.
    """
    if path not in kept:
        import tiktoken

        with open(path) as file:
            told = json.load(file)
        vocabulary, added = told["model"]["vocab"], {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are found as they stand alone")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and token not in added}
        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        kept[path] = functools.partial(encoding.encode, allowed_special="all")  # as the library does, wherever an added token stands
    return kept[path]


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text) of Arrow batches, a few hundred texts in Python at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())


def pieces_of(doc_id: int, ids: list[int], length: int) -> list[dict]:
    """Whole if it fits; else pieces of the full length, the first one shorter by what is left over."""
    raw = np.array(ids, "<u4")
    cuts = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
    return [{"doc_id": doc_id, "piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(raw[a:b].tobytes())} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def best_fit(items: list[Bin], length: int) -> list[Bin]:
    """Bins of at most ``length``: the longest item first, each into the fullest bin that holds it."""
    items = sorted(items, key=lambda x: (-x[0], x[1][0]["doc_id"] is None, x[1][0]["doc_id"] or 0, x[1][0]["piece"]))
    room: list[list[int]] = [[] for _ in range(length + 1)]  # bins by their free tokens
    free: list[int] = []  # sizes of free room that some bin has, ascending
    bins: list[list] = []
    for size, parts in items:
        at = bisect.bisect_left(free, size)
        if at == len(free):
            bins.append([size, list(parts)])
            number, left = len(bins) - 1, length - size
        else:
            had = free[at]
            number = room[had].pop()
            if not room[had]:
                del free[at]
            bins[number][0] += size
            bins[number][1] += parts
            left = had - size
        if not room[left]:
            bisect.insort(free, left)
        room[left].append(number)
    return [(size, parts) for size, parts in bins]


def settle(bins: list[Bin], nearly: int) -> tuple[list[Bin], list[Bin]]:
    """Bins that are done; the others, the emptiest first."""
    return [b for b in bins if b[0] >= nearly], sorted((b for b in bins if b[0] < nearly), key=lambda b: b[0])


def bin_batches(bins: list[Bin], done: bool) -> Iterator[pa.RecordBatch]:
    """Rows of bins, with each piece's place in its bin."""
    for i in range(0, len(bins), 2000):
        part = bins[i : i + 2000]
        for _, pieces in part:
            at = 0
            for piece in pieces:
                piece["offset"] = at
                at += piece["length"]
        yield pa.RecordBatch.from_arrays([pa.array([done] * len(part)), pa.array([b[0] for b in part], pa.int64()), pa.array([b[1] for b in part], pa.list_(ITEM))], ["done", "fill", "items"])


def rounds(incoming: Iterator[list[Bin]], length: int, nearly: int, most: int, carry: int) -> Iterator[pa.RecordBatch]:
    """Best-fit over a task's items, ``most`` at a time; the ``carry`` emptiest bins stay for the next round."""
    held: list[Bin] = []
    for items in incoming:
        held += items
        if len(held) >= max(most, 2 * carry):
            done, rest = settle(best_fit(held, length), nearly)
            held = rest[:carry]
            yield from bin_batches(done, True)
            yield from bin_batches(rest[carry:], False)
    done, rest = settle(best_fit(held, length), nearly)
    yield from bin_batches(done, True)
    yield from bin_batches(rest, False)


def refit(batches: Iterator[pa.RecordBatch], length: int, nearly: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Best-fit over all bins of a task, as they are or taken apart."""
    items: list[Bin] = []
    for batch in batches:
        for fill, parts in zip(batch.column("fill").to_pylist(), batch.column("items").to_pylist()):
            items += [(fill, parts)] if whole else [(p["length"], [p]) for p in parts]
    done, rest = settle(best_fit(items, length), nearly)
    yield from bin_batches(done, True)
    yield from bin_batches(rest, False)


def totals(bins: DataFrame) -> tuple[int, int]:
    """Bins, pieces in them."""
    row = bins.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    return row[0], row[1]


def last_bins(rest: DataFrame, length: int, nearly: int) -> DataFrame:
    """Underfull bins of which no two over half full go together: join the others wherever one can be joined.

    k others can use no more than the k emptiest of the rest, so only these meet, in one task.
    """
    small = F.col("fill") <= length // 2
    rest = materialize(rest.withColumn("number", F.monotonically_increasing_id()), "packing-rest")
    k = rest.where(small).count()
    emptiest = rest.where(~small).select("fill", "number").orderBy("fill", "number").limit(k)
    bound = emptiest.agg(F.max(F.struct("fill", "number")).alias("bound")).first().bound
    meets = small if bound is None else F.struct("fill", "number") <= F.struct(F.lit(bound.fill), F.lit(bound.number))
    met = rest.where(meets).drop("number").repartition(1).mapInArrow(lambda batches: refit(batches, length, nearly, True), BIN)
    return rest.where(~meets).drop("number").unionByName(materialize(met, "packing-last"))


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, nearly: int = NEARLY_FULL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of (doc_id, text)."""

    nearly, most, carry, share = min(nearly, length), ROUND, CARRY, SHARE

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_of(path, pattern)

        def items():
            for doc_id, text in pairs(batches):
                ids = encode(text or "")
                ids.append(END_ID)
                yield [(p["length"], [p]) for p in pieces_of(doc_id, ids, length)]

        yield from rounds(items(), length, nearly, most, carry)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from refit(batches, length, nearly, False)

    level = materialize(docs.select("doc_id", "text").mapInArrow(first, BIN), "packing-0")
    bins, rest = level.where("done"), level.where("not done")
    n, pieces = totals(rest)
    depth = 0
    while pieces > share:
        depth += 1
        parts = -(-pieces // share)
        place = F.xxhash64(F.monotonically_increasing_id(), F.lit(depth))  # the same when a task is run again, as the files are written
        dealt = rest.withColumn("place", place).repartition(parts, "place").drop("place")
        level = materialize(dealt.mapInArrow(again, BIN), f"packing-{depth}")
        saved = n - level.count()
        if saved > 0:
            bins, rest = bins.unionByName(level.where("done")), level.where("not done")
            n, pieces = totals(rest)
        if saved <= parts:
            bins = bins.unionByName(last_bins(rest, length, nearly))
            break
    else:
        bins = bins.unionByName(materialize(rest.repartition(1).mapInArrow(again, BIN), "packing-last"))
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "items")
    return numbered.select("sequence_id", F.explode("items").alias("item")).select("item.doc_id", "item.piece", "item.start", "item.length", "item.ids_crc32", "sequence_id", "item.offset")
