"""Phrase collocation mining by contiguous pattern growth.

Words, then pairs, then triples, that occur often enough bound the search: every part of a frequent phrase is frequent. An occurrence of a
frequent pair is a pointer, carried as the words that stand to its right as long as the last three are a frequent triple, five at most. So few
pointers differ that a task sums them over all that it reads, which is a core's share of the table (``spark.default.parallelism``, where executors
come and go) but no more than ``SHARE``. Pointers are
parted by ranges of (lang, prefix) and sorted, so that a prefix's pointers lie together in one task, which grows
it to the right depth-first: the stack of the open prefixes is all that the task holds. A prefix with more pointers than a task should
have lies in several: what is open at a task's edge is stated in part and summed, eight phrases a task at most. Every
phrase below that is then counted in whole.

Three bitmaps of fixed size hold the hashes of frequent words, pairs and triples. They only shorten pointers, as a hash in doubt stays in; the counts are of the
words themselves. Products of counts are decimals of 38 digits, so scores are exact up to 10^13 words for each language.

Edge cases: a null lang is ``und``, a null text empty. Words that stand in different pieces or documents are never
neighbours. Ties of cuts go to the shortest first part, ties of ranks by count, then phrase in UTF-8 order. Repeated rows count
each time. Languages without a candidate, and empty tables, give no rows. Long texts are cut into slices that overlap by the words
that a phrase may reach into. Other columns of the input are left out, so clashing names do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evifuse.llm.shared import materialize, raw_texts

#: Occurrences of a phrase, words of a phrase, phrases reported for each language.
LEAST, MOST, TOP = 100, 5, 2000
#: Bits of a bitmap as a power of two, words worked on at once, bytes of a long text's slice, distinct words counted before they are handed on, distinct pointers likewise, triples.
BITS, CHUNK, SLICE, HELD, SUMMED, THREES = 27, 1 << 20, 1 << 20, 1 << 18, 1 << 19, 1 << 20
#: Words that a task sums over at most, about.
SHARE = 1 << 26
#: Parts in which a language's candidates are ranked before the last.
SALTS = 32

BREAK = b"\xff"  # occurs in no UTF-8
FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\v\f\r\t", bytes(range(97, 123)) + BREAK * 10 + b" ")
SEED = 42  # of the hash that Spark's xxhash64 computes


def tokens(folded: bytes) -> list[bytes]:
    return folded.replace(BREAK, b" \xff ").split()


def cut(text: bytes) -> Iterator[tuple[list[bytes], int | None]]:
    """Words with breaks between pieces. A long text comes in slices, of which only the first so many words begin a phrase, or (None) all."""
    folded = text.translate(FOLD)
    at, size = 0, SLICE
    while len(folded) - at > size:
        end = folded.rfind(BREAK, at, at + size)
        if end >= 0:
            yield tokens(folded[at:end]), None
            at, size = end + 1, SLICE
            continue
        words = folded[at : at + size].rsplit(None, MOST)  # the last of them may be cut
        if len(words) <= MOST:
            size *= 2
            continue
        head = words[0].split()
        yield head + words[1:MOST], len(head)
        at, size = at + len(words[0]), SLICE
    yield tokens(folded[at:]), None


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[str, list[bytes], int]]:
    """Language, words with breaks (of all languages ``size`` at a time), how many of them begin phrases."""
    held: dict[str, list[bytes]] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), raw_texts(batch)):
            for words, starts in cut(text or b""):
                if starts is not None:
                    yield lang, words, starts
                    continue
                kept = held.setdefault(lang, [])
                kept += words
                kept.append(BREAK)
                n += len(words) + 1
                if n >= size:
                    for key, value in held.items():
                        yield key, value, len(value)
                    held, n = {}, 0
    for key, value in held.items():
        yield key, value, len(value)


def _phrases(lang: str, phrases: pa.Array, counts: np.ndarray | list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word, and of all words under a null."""
    held: dict[str, Counter] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            found.pop(BREAK, None)
            yield _phrases(lang, pa.array([None, *found], pa.binary()), [found.total(), *found.values()])

    for lang, words, starts in chunks(batches):
        held.setdefault(lang, Counter()).update(words[:starts] if starts < len(words) else words)
        if sum(map(len, held.values())) >= HELD:
            yield from told()
            held = {}
    yield from told()


class Numbered:
    """A chunk's words as numbers, the hashes of its distinct words, and of its neighbours where both are frequent."""

    def __init__(self, lang: str, words: list[bytes], starts: int, frequent: np.ndarray):
        self.names = list(dict.fromkeys(words))
        index = {w: i for i, w in enumerate(self.names)}
        self.ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        prefix, digest = lang.encode() + b"\t", xxhash.xxh64_intdigest
        hashes = np.array([digest(prefix + w, SEED) for w in self.names], np.uint64)
        often = held(frequent, hashes)
        if BREAK in index:
            often[index[BREAK]] = False
        marks = often[self.ids]
        self.neighbours = marks[:-1] & marks[1:]
        self.pairs = mixed(hashes[self.ids])
        self.starts = starts

    def triples(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where frequent pairs stand, the hashes of three neighbours, and where these are two frequent pairs."""
        pairs = self.neighbours & held(often, self.pairs)
        return pairs, mixed(self.pairs), pairs[:-1] & pairs[1:]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A hash of each two neighbours."""
    return (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] + (hashes[:-1] >> np.uint64(29)))


def held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is in a bitmap of 64-bit words."""
    slots = hashes & np.uint64((1 << BITS) - 1)
    return (bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The column ``hash`` as bits: a fixed size, however many there are."""
    slot = F.col("hash").bitwiseAND(F.lit((1 << BITS) - 1))
    words = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def counted_pairs(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """Occurrences of hashed pairs of frequent words."""
    for lang, words, starts in chunks(batches):
        chunk = Numbered(lang, words, starts, frequent.value)
        pairs, n = np.unique(chunk.pairs[:starts][chunk.neighbours[:starts]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n, pa.int64())], ["hash", "n"])


def counted_triples(batches: Iterator[pa.RecordBatch], frequent, often) -> Iterator[pa.RecordBatch]:
    """Occurrences of hashed triples of two frequent pairs."""
    for lang, words, starts in chunks(batches, CHUNK // 4):
        _, hashes, which = Numbered(lang, words, starts, frequent.value).triples(often.value)
        triples, n = np.unique(hashes[:starts][which[:starts]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(triples.view(np.int64)), pa.array(n, pa.int64())], ["triple", "n"])


def summed(batches: Iterator[pa.RecordBatch], by: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Equal ones as one row, as long as a task then holds fewer than ``most``; else these are handed on."""
    waiting: list[pa.RecordBatch] = []
    rows = 0

    def total() -> pa.Table:
        return pa.Table.from_batches(waiting).group_by(by, use_threads=False).aggregate([("n", "sum")]).select([*by, "n_sum"]).rename_columns([*by, "n"])

    for batch in batches:
        waiting.append(batch)
        rows += len(batch)
        if rows >= 2 * most:
            table = total()
            waiting, rows = table.to_batches(), len(table)
            pa.default_memory_pool().release_unused()
            if rows >= most:
                yield from waiting
                waiting, rows = [], 0
    if waiting:
        yield from total().to_batches()


def pointers(batches: Iterator[pa.RecordBatch], frequent, often, triples) -> Iterator[pa.RecordBatch]:
    """Occurrences of frequent pairs with what may be grown from them, equal ones of a chunk as one row. Each word ends with a blank."""
    for lang, words, starts in chunks(batches, CHUNK // 4):
        chunk = Numbered(lang, words, starts, frequent.value)
        pairs, hashes, which = chunk.triples(often.value)
        good = np.zeros(len(words) + MOST, bool)
        good[: len(which)] = which & held(triples.value, hashes)
        at = np.flatnonzero(pairs[:starts])
        length = np.full(len(at), 2)
        for step in range(MOST - 2):
            length += (length == step + 2) & good[at + step]
        ids = np.concatenate([chunk.ids, np.zeros(MOST, np.int64)]) + 1
        columns = [np.where(length > i, ids[at + i], 0) for i in range(MOST)]
        keys = [columns[i] << 32 | columns[i + 1] if i + 1 < MOST else columns[i] for i in range(0, MOST, 2)]
        order = np.lexsort(keys)
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        firsts = np.flatnonzero(fresh)
        n = np.diff(np.append(firsts, len(at)))
        one, names, empty = order[firsts], pa.array(chunk.names, pa.binary()), pa.scalar(b"", pa.binary())
        for size in range(2, MOST + 1):
            which = length[one] == size
            if which.any():
                parts = [names.take(pa.array(columns[i][one][which] - 1)) for i in range(size)]
                yield _phrases(lang, pc.binary_join_element_wise(*parts, empty, pa.scalar(b" ", pa.binary())), n[which])


def grown(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Depth-first growth over sorted pointers: phrases that reach the count here, and parts of those open at the task's edges."""
    path: list[list] = []  # word, occurrences, whether open since the task began
    at_lang, last, begun = None, None, False
    out: list[tuple[str, str, int]] = []

    def close(depth: int, at_end: bool) -> None:
        while len(path) > depth:
            _, n, edge = path[-1]
            if len(path) >= 2 and (n >= least or edge or at_end):
                out.append((at_lang, b" ".join(w for w, _, _ in path).decode(), n))
            path.pop()
            if path:
                path[-1][1] += n

    def told() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["lang", "phrase", "n"])
            out.clear()

    for batch in batches:
        for lang, window, n in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist(), batch.column("n").to_pylist()):
            if lang != at_lang:
                close(0, False)
                at_lang, last = lang, None
            if window != last:
                words = window.split(b" ")[:-1]
                same = 0
                while same < len(path) and same < len(words) and path[same][0] == words[same]:
                    same += 1
                close(same, False)
                path += [[w, 0, not begun] for w in words[same:]]
                last, begun = window, True
            path[-1][1] += n
        yield from told()
    close(0, True)
    yield from told()


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n): phrases of one to five words with at least ``least`` occurrences; and all words' number as (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = "lang string, phrase string, n long"
    words = rows.mapInArrow(counted_words, counts).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = materialize(words.where(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases-words")
    totals, words = words.where("phrase IS NULL").select("lang", "n"), words.where("phrase IS NOT NULL")
    frequent = spark.sparkContext.broadcast(bitmap(words.select(F.xxhash64(F.concat("lang", F.lit("\t"), "phrase")).alias("hash"))))
    pairs = rows.mapInArrow(lambda batches: counted_pairs(batches, frequent), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    often = spark.sparkContext.broadcast(bitmap(pairs.where(F.col("n") >= least)))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    shares = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-n_words // SHARE)))
    threes = shares.mapInArrow(lambda batches: summed(counted_triples(batches, frequent, often), ["triple"], THREES), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    triples = spark.sparkContext.broadcast(bitmap(threes.where(F.col("n") >= least).withColumnRenamed("triple", "hash")))
    found = materialize(shares.mapInArrow(lambda batches: summed(pointers(batches, frequent, often, triples), ["lang", "phrase"], SUMMED), counts), "phrases-pointers")
    parted = found.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
    phrases = parted.mapInArrow(lambda batches: grown(batches, least), counts).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    phrases = materialize(phrases.where(F.col("n") >= least), "phrases-grown")
    return words.unionByName(phrases), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, k, l, r, n, score of every phrase of two words or more, at its worst cut."""
    many = phrases.select("lang", "phrase", F.col("n").alias("a"), F.size(F.split("phrase", " ")).alias("m")).where("m > 1").join(totals, "lang")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - m)")})
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    score = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"]).alias("score"))
    worst = score.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "k", "l", "r", "n", "score"), F.struct("score", "k")).alias("x"))
    return worst.select("lang", "phrase", "x.*")


def longest(rows: DataFrame) -> DataFrame:
    """Without phrases that stand inside a longer one as often as anywhere. Such a one is longer by a single word, as what lies between is as frequent."""
    ends = F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)")))
    inner = rows.withColumn("m", F.size(F.split("phrase", " "))).where("m > 2").select("lang", ends.alias("phrase"), F.col("a").alias("most"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return rows.join(inner, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` of each language."""
    phrases, totals = frequent_phrases(docs, least)
    rows = longest(scored(phrases, totals))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)  # of each language SALTS * top at most
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
s AS (SELECT lang, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, ws[i + 3] AS d, ws[i + 4] AS e FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
g AS (SELECT lang, a AS p FROM s UNION ALL SELECT lang, a || ' ' || b FROM s UNION ALL SELECT lang, a || ' ' || b || ' ' || c FROM s
  UNION ALL SELECT lang, a || ' ' || b || ' ' || c || ' ' || d FROM s UNION ALL SELECT lang, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e FROM s),
f AS (SELECT lang, p, string_split(p, ' ') AS ws, len(string_split(p, ' ')) AS m, count(*) AS f FROM g WHERE p IS NOT NULL GROUP BY lang, p HAVING count(*) >= 100),
t AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
cuts AS (SELECT c.lang, c.p, c.m, c.f AS a, t.n, k, l.f AS l, r.f AS r, CAST(1000 * CAST(c.f AS HUGEINT) * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM f c JOIN t USING (lang) JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON k < c.m
  JOIN f l ON l.lang = c.lang AND l.p = array_to_string(list_slice(c.ws, 1, k), ' ') JOIN f r ON r.lang = c.lang AND r.p = array_to_string(list_slice(c.ws, k + 1, c.m), ' ')),
x AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM f d WHERE d.lang = x.lang AND d.m > x.m AND 100 * d.f >= 100 * x.a AND contains(' ' || d.p || ' ', ' ' || x.p || ' '))),
z AS (SELECT *, p AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM y)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""
