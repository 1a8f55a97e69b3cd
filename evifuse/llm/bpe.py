"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is an element of a monoid: its list of pattern matches, scanned from its start. Halves are encoded
recursively and joined by scanning again a window around the seam. Every match that ends ``LOOKAHEAD``
characters before the seam was decided by text that the left half holds, so it stands; the new scan stops
where it meets a match boundary of the right half, as from a common boundary both scans go alike. Windows
grow until that happens.

Inside one match the tokens are joined likewise: a window of the last tokens of the left and the first of the
right half is encoded again, and grows until its outermost tokens come out as they were. Then each pair of
neighbours in the joined sequence is a pair that byte-pair merging leaves alone, and such a sequence is the
encoding (each neighbouring pair encodes to itself). Decoding concatenates up the same tree.

Edge cases: a null or empty text has no tokens and decodes to no bytes. Texts of any length are encoded
whole. Repeated rows get equal results, empty tables no rows. Other columns are untouched: where a column has the name
of the new one already, in any case, ``encode`` and ``decode`` raise. There are no ties.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern's longest look beyond a match: after an apostrophe it may need two more letters.
LOOKAHEAD = 3
#: Texts up to this many characters, and matches up to this many bytes, are leaves of the tree.
LEAF_CHARS, LEAF_BYTES = 4096, 32
#: The rank of a pair that is no token.
NONE = 1 << 62
#: Distinct matches that a task remembers.
MEMORY = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder over one rank table and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.matches = regex.compile(pattern).findall
        self.scan = regex.compile(pattern).match
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.known = _Known(self)

    # -- tokens of one match ------------------------------------------------------------------------
    def merge(self, piece: bytes) -> list[int]:
        """Byte-pair merging of a leaf: the lowest rank first, the leftmost on ties."""
        ranks = self.ranks
        rank_of = ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank_of(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != NONE:
            i = pairs.index(best)
            parts[i : i + 2] = [self.bytes_of[best]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank_of(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = rank_of(parts[i] + parts[i + 1], NONE)
        return [ranks[p] for p in parts]

    def tree(self, piece: bytes) -> list[int]:
        """Tokens of a match of any length, by halves."""
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both halves' bytes."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.window(left[-a:], right[:b])
            fixed_left = a == len(left) or window[0] == left[-a]
            fixed_right = b == len(right) or window[-1] == right[b - 1]
            if fixed_left and fixed_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = a + (0 if fixed_left else a), b + (0 if fixed_right else b)

    def window(self, left: list[int], right: list[int]) -> list[int]:
        piece = b"".join(self.bytes_of[t] for t in left + right)
        return self.merge(piece) if len(piece) <= 512 else self.long_window(piece)

    def long_window(self, piece: bytes) -> list[int]:
        """A window that has grown far: split elsewhere than at the seam, where joining failed to settle."""
        third = len(piece) // 3
        return self.join(self.tree(piece[:third]), self.tree(piece[third:]))

    # -- matches of a text --------------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.matches(text)
        half = len(text) // 2
        return self.seam(self.pieces(text[:half]), self.pieces(text[half:]))

    def seam(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of both halves' text, from those of the halves."""
        cut, tail = len(left), 0
        while cut and tail < LOOKAHEAD:  # matches that the seam may change
            cut -= 1
            tail += len(left[cut])
        take = 2
        while True:
            window = "".join(left[cut:]) + "".join(right[:take])
            whole = take >= len(right)
            bounds, at = {}, tail
            for i, piece in enumerate(right[:take]):
                bounds[at] = i
                at += len(piece)
            found, pos = [], 0
            while pos < len(window):
                if pos in bounds and (whole or pos + LOOKAHEAD <= len(window)):
                    return left[:cut] + found + right[bounds[pos] :]
                end = self.scan(window, pos).end()
                if not whole and end + LOOKAHEAD > len(window):
                    break
                found.append(window[pos:end])
                pos = end
            else:
                return left[:cut] + found
            take *= 2

    # -- texts --------------------------------------------------------------------------------------
    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > MEMORY:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        """Concatenation up the tree; a leaf is a run of tokens."""
        tokens = np.frombuffer(ids, "<u4")
        if len(tokens) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, tokens.tolist()))
        half = len(tokens) // 2 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Known(dict):
    """Match to its ids' bytes; a match that is itself a token is that token."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.codec.ranks.get(raw)
        ids = self.codec.tree(raw) if rank is None else [rank]
        self[piece] = found = np.array(ids, "<u4").tobytes()
        return found


def codec_of(path: str, pattern: str, kept: dict = {}) -> Codec:  # noqa: B006  one codec for each worker process
    key = (path, pattern)
    if key not in kept:
        kept[key] = Codec(read_ranks(path), pattern)
    return kept[key]


def unused(df: DataFrame, name: str) -> str:
    """The name of a new column, which no other may have."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {name} already; name another with into=")
    return name


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the column ``into``: the text's ids as little-endian unsigned 32-bit integers (binary)."""

    @F.pandas_udf("binary")
    def ids(texts):
        codec = codec_of(path, pattern)
        return texts.map(lambda t: codec.encode(t or ""))

    return df.withColumn(unused(df, into), ids(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the column ``into``: the bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def raw(columns):
        codec = codec_of(path, pattern)
        return columns.map(lambda x: codec.decode(x or b""))

    return df.withColumn(unused(df, into), raw(F.col(ids)))


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one pass, so that ids need not travel between stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = codec_of(path, pattern), hashlib.sha256
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": [sha(x).hexdigest() for x in ids],
                    "decoded_sha256": [sha(codec.decode(x)).hexdigest() for x in ids],
                }
            )

    return df.select("doc_id", "text").mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
