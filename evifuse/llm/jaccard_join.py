"""N-gram Jaccard join as a T-occurrence search with DivideSkip.

A document is the set of its distinct shingles; a shingle's inverted list names the documents that hold it. Two sets
link if their Jaccard similarity reaches ``SIMILAR``, so they occur together in at least T lists, T being known from
the sizes. DivideSkip parts a document's lists: the L longest, L = T / (1 + MU * log2 M) with M the longest list, are
set aside. Whatever reaches T must turn up in T - L of the short ones, as the first common shingles in the
order of lists lie among either set's shortest n - L. Those are merged with a heap that skips what cannot reach T - L; what does reach it is
probed by binary search in the long lists, and retained if it reaches T in all. Which lists are long is told by a count sketch over all
documents, larger for larger tables within a bound; it orders lists only, so its errors cost time and never a link.

The short lists are (shingle, document) rows that Spark sorts and joins. The long ones are by far the most and never travel: a posting
(shingle, document) of theirs is stored with its document, sorted, and "is s in list t" is a binary search for t in the postings of s.

Work stays in proportion to the documents:

* Equal sets are one class, which its smallest doc_id stands for.
* Places count: shingles before a common one lie in one set alone, so late places rule a pair out.
* A candidate pair is judged by its sets' parity bits, about one bit for each shingle: they give a lower
  bound of the difference, so most pairs fall without their sets being fetched and none falls wrongly.
* Large groups of copies settle first: in each short list, neighbours in a hashed order are probed as candidates,
  and links join classes into components. Lists of two are done with that.
* The heap then merges the lists that still hold several components, for documents of other components alone, as two documents of
  one component need no further link. So groups of near copies never unfold into their pairs, and this second step goes
  to the last pair: no list and no partner is capped.
* Lists of over ``PART`` postings are dealt over parts by the document's hash, in both steps: a chain in each part and
  one through the parts' heads; then each part of a list meets each other in another task.

Shingles are 64-bit hashes. Edge cases: a null or empty text, or white space alone, has an empty set and links
with nothing; a text of fewer words than a shingle is one shingle. Texts are taken whole. A doc_id names a
document: repeated rows give a row each, with equal results, and links of any row with that id are its links. A row without an id joins the class
of its set, and has a null component if no row with an id has that set. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.llm.shared import materialize, raw_texts

WORDS, SIMILAR = 3, 90  # words of a shingle; least similarity in hundredths
#: Counters of the sketch as a power of two: by the bytes of all texts for each, within these bounds, as they pass through the driver.
SKETCH_BITS, MOST_BITS, BYTES_EACH, CHUNK_BITS = 21, 24, 72, 16
#: DivideSkip's coefficient: merging costs a shuffle and probing does not, so most lists are set aside. Postings of a list that stay together.
MU, PART = 0.001, 4096
#: Links, or ids, for each file between the rounds: a file costs more than its rows where there are few, as many as the shuffle has parts.
EACH = 1 << 20
#: Slots of the short parities that go with the lists.
FOLD = 256
#: Distinct words whose hashes a task remembers; pairs compared together.
MEMORY = 200_000
SETS = "doc_id long, n_shingles long, key_a long, key_b long, bits binary, fold array<long>, short array<long>, cuts array<tinyint>"


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingles(raw: bytes | None, hashes: Hashes, size: int) -> np.ndarray:
    """The sorted distinct shingles of a text. ``bytes.split`` parts at ASCII white space, ``bytes.lower`` lowers A-Z."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    if len(hashes) > MEMORY:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    total = np.full(len(h) - width + 1, np.uint64(width * 0x5851F42D4C957F2D & (1 << 64) - 1))
    for i in range(width):
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - width + 1 + i])
    return np.unique(total)


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Counters of all documents' shingles: their number is bounded, so they may pass through the driver. With too few for a table, lists of some length are not told from noise."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((total // BYTES_EACH).bit_length(), SKETCH_BITS), MOST_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, hashes = np.zeros(1 << bits, np.uint32), Hashes()
        for batch in batches:
            found = [shingles(raw, hashes, size) for raw in raw_texts(batch)]
            if found:
                np.add.at(counters, np.concatenate(found) >> np.uint64(64 - bits), 1)
        for i in range(0, 1 << bits, 1 << CHUNK_BITS):
            part = counters[i : i + (1 << CHUNK_BITS)]
            if part.any():
                yield pa.record_batch({"chunk": pa.array([i], pa.int64()), "counts": [zlib.compress(part.astype("<u4" if part.max() > 255 else "u1").tobytes(), 1)]})

    def add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for batch in rows:
            for raw in batch.column("counts").to_pylist():
                counts = zlib.decompress(raw)
                total += np.frombuffer(counts, "u1" if len(counts) == len(total) else "<u4")
        yield pa.record_batch({"chunk": pa.array([key[0].as_py()], pa.int64()), "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    counted = docs.select("text").mapInArrow(count, "chunk long, counts binary")
    out = np.zeros(1 << bits, np.uint32)
    for row in counted.groupBy("chunk").applyInArrow(add, "chunk long, counts binary").collect():
        out[row.chunk : row.chunk + (1 << CHUNK_BITS)] = np.frombuffer(bytes(row.counts), "<u4")
    return out


def weights_of(counters: np.ndarray) -> np.ndarray:
    """List length classes: 0 for what the sketch can't tell from its noise, else the logarithm of the count beyond it."""
    mean = float(np.median(counters[: 1 << SKETCH_BITS])) if len(counters) else 0.0  # any part of them stands for all
    out = np.zeros(len(counters), np.uint8)
    for i in range(0, len(counters), 1 << SKETCH_BITS):
        beyond = counters[i : i + (1 << SKETCH_BITS)] - mean - 8 * np.sqrt(mean + 1) - 8
        out[i : i + (1 << SKETCH_BITS)] = np.where(beyond > 0, np.log2(np.maximum(beyond, 1)) + 1, 0)
    return out


@dataclass
class Divide:
    """DivideSkip's parting of a set's lists, for one worker."""

    weights: np.ndarray
    similar: int

    @cached_property
    def longest(self) -> int:
        """The logarithm of the longest list's length."""
        return max(int(self.weights.max(initial=0)), 1)

    def overlap(self, n: int) -> int:
        """T: the least overlap of a set of ``n`` with any set that it links with."""
        return -(-self.similar * n // 100)

    def short(self, n: int) -> int:
        """n - L: how many lists are short."""
        t = self.overlap(n)
        return n - min(int(t / (1 + MU * self.longest)), t - 1)

    def reach(self, n: int) -> int:
        """T - L: in how many short lists a partner occurs at least."""
        return self.overlap(n) - (n - self.short(n))

    def reach_of(self, n: Column) -> Column:
        """``reach`` of a column of sizes, so that it need not travel."""
        t = F.ceil(n * self.similar / 100)
        return t - F.least(F.floor(t / F.lit(1 + MU * self.longest)), t - 1)

    def weight(self, found: np.ndarray) -> np.ndarray:
        return self.weights[(found >> np.uint64(65 - len(self.weights).bit_length())).astype(np.int64)]

    def parted(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Short and long lists of a set, the shortest first; all sets order lists alike."""
        order = np.argsort(self.weight(found), kind="stable")
        p = self.short(len(found))
        return found[order[:p]], found[order[p:]]


def short_lists(docs: DataFrame, divide, size: int) -> DataFrame:
    """Per document: the set's size and 128-bit key, parities, the shingles whose lists are short, and each list's parts as a power of 2."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part = Hashes(), divide.value
        for batch in batches:
            sizes, keys, bits, folds, short, cuts = [], [], [], [], [], []
            for raw in raw_texts(batch):
                found = shingles(raw, hashes, size)
                n = len(found)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                bits.append(parities(found, max(64, 1 << max(n - 1, 0).bit_length())))
                folds.append(np.frombuffer(parities(found, FOLD), "<i8"))
                mine = part.parted(found)[0] if n else found
                short.append(mine.view(np.int64))
                hot = np.maximum(part.weight(mine).astype(np.int8) - PART.bit_length(), 0)
                cuts.append(hot if hot.any() else [])
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            long, longs = pa.int64(), pa.list_(pa.int64())
            columns = [pa.array(sizes, long), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bits, pa.binary()), pa.array(folds, longs), pa.array(short, longs)]
            columns.append(pa.array(cuts, pa.list_(pa.int8())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], NAMES)

    return docs.select("doc_id", "text").mapInArrow(task, SETS)


NAMES = [c.split()[0] for c in SETS.split(", ")]


def parities(found: np.ndarray, slots: int) -> bytes:
    """A bit for each slot: whether it holds an odd number of shingles. Sets have as many slots as shingles, or up to twice as many."""
    return np.packbits((np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(bool)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """How many shingles two sets differ in at least: each slot of different parity holds one. The longer is folded."""
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        half = len(b) // 2
        b = (int.from_bytes(b[:half]) ^ int.from_bytes(b[half:])).to_bytes(half)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def near(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """The pairs that their parities allow to link: others are dropped for sure, before their sets are fetched."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "m")))
            keep = [least_difference(a, b) * (100 + similar) <= (n + m) * (100 - similar) for a, b, n, m in rows]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    of = lambda name, bits, n: classes.select(F.col("id").alias(name), F.col("bits").alias(bits), F.col("n_shingles").alias(n))
    both = pairs.join(of("x", "a", "n"), "x").join(of("y", "b", "m"), "y")
    return both.select("x", "y", "a", "b", "n", "m").mapInArrow(task, "x long, y long")


def bitmap(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """Hashed ids as bits: a fixed size, however many ids there are. Used to skip texts early, never to decide."""
    width = 1 << 16
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    rows = ids.select(slot.alias("slot")).select((F.col("slot") / width).cast("long").alias("chunk"), F.col("slot") % width)

    def mark(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, bool)
        for batch in batches:
            held[batch.column(1).to_numpy()] = True
        yield pa.record_batch({"chunk": pa.array([key[0].as_py()], pa.int64()), "held": [np.packbits(held).tobytes()]})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.toDF("chunk", "at").distinct().groupBy("chunk").applyInArrow(mark, "chunk long, held binary").collect():
        out[row.chunk * width // 8 : (row.chunk + 1) * width // 8] = np.frombuffer(bytes(row.held), np.uint8)
    return out


def held_in(docs: DataFrame, ids: DataFrame, bits: int = 24):
    """Functions from an Arrow batch with the column ``slot`` to its mask, and that column: whether its hashed id is in ``ids``."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids, bits))

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        slots = batch.column("slot").to_numpy()
        return (wanted.value[slots >> 3] >> (7 - (slots & 7))) & 1 == 1

    return mask, F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("slot")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids``: others are skipped before their text is cut."""
    mask, slot = held_in(docs, ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            batch = batch.filter(pa.array(mask(batch)))
            yield pa.record_batch({"id": batch.column("doc_id"), "shingles": pa.array([shingles(raw, hashes, size).tobytes() for raw in raw_texts(batch)], pa.binary())})

    found = docs.select("doc_id", "text", slot).mapInArrow(task, "id long, shingles binary")
    return found.join(ids, "id", "left_semi")


def held(lists: np.ndarray, postings: np.ndarray) -> int:
    """In how many of the lists a document is: a binary search in its sorted postings for each."""
    at = np.searchsorted(postings, lists)
    return int((postings[np.minimum(at, len(postings) - 1)] == lists).sum())


def links(few: np.ndarray, many: np.ndarray, divide: Divide) -> bool:
    """Whether two sets link: the smaller one's long lists are probed, and its short ones if T can still be reached."""
    short, long = divide.parted(few)
    n, similar = len(few) + len(many), divide.similar
    reached = held(long, many)
    if (100 + similar) * (reached + len(short)) < similar * n:
        return False
    return (100 + similar) * (reached + held(short, many)) >= similar * n


def probe(pairs: DataFrame, sets: DataFrame, divide) -> DataFrame:
    """The pairs (x, y) whose sets link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            keep = [links(*sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len), divide.value) for a, b in both]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("a")), "x")
    both = left.join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("b")), "y")
    return both.select("x", "y", "a", "b").mapInArrow(task, "x long, y long")


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(document, count) of those that stand in ``least`` or more of the ascending lists.

    A heap holds each list's head. Heads that cannot reach ``least`` are skipped: with the least - 1 smallest set
    aside, the next head is the first document that can, so those lists go on from there by binary search.
    """
    at = [0] * len(lists)
    heap = [(rows[0], i) for i, rows in enumerate(lists) if rows]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield top, len(popped)
            for i in popped:
                at[i] += 1
        else:
            while len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            for i in popped:
                at[i] = bisect_left(lists[i], heap[0][0], at[i])
        for i in popped:
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def merged(postings: DataFrame) -> DataFrame:
    """(x, y): documents y that stand in enough of x's lists, from rows (x, shingle, y, reach) of those lists."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for x, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            lists, reach = [], {}
            for _, own in groupby(rows, key=lambda r: r[1]):
                own = list(own)
                lists.append([r[2] for r in own])
                reach.update((r[2], r[3]) for r in own)
            for y, count in merge_skip(lists, min(reach.values())):
                if count >= reach[y]:
                    xs.append(x)
                    ys.append(y)
            if len(xs) >= 10_000:
                yield pa.record_batch({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})
                xs, ys = [], []
        yield pa.record_batch({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    dealt = postings.select("x", "shingle", "y", "reach").repartition("x").sortWithinPartitions("x", "shingle", "y")
    return dealt.mapInArrow(task, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in the links (x, y), by alternating stars.

    Each round hangs neighbours on the least one; rounds grow with the logarithm of the links. A round at most doubles its links,
    so those of the one before tell how many files are enough.
    """
    edges = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()
    n = links.count()
    edges = materialize(edges.coalesce(n // EACH + 1), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(2 * n // EACH + 1), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before, n = now, now[0]
    labels = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = labels.select(F.col("component").alias("id"), "component").distinct()
    return labels.unionByName(roots).coalesce(2 * n // EACH + 1)


def possible(divide: Divide) -> Column:
    """Whether a common shingle can be among the first ``reach`` ones that two linked sets share.

    All else before it, in the common order of lists, is in one of the sets alone; with what is left of either the overlap must
    come to T. n, m: sizes; at, to: places in them.
    """
    left = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) + divide.reach_of(F.least("n", "m")) - 1
    return F.lit(100 + divide.similar) * left >= F.lit(divide.similar) * (F.col("n") + F.col("m"))


def alike(similar: int):
    """``near`` by the short parities alone, inside a join."""
    differ = sum((F.bit_count(F.col("fold")[i].bitwiseXOR(F.col("fold2")[i])) for i in range(1, FOLD // 64)), F.bit_count(F.col("fold")[0].bitwiseXOR(F.col("fold2")[0])))
    return differ * (100 + similar) <= (F.col("n") + F.col("m")) * (100 - similar)


def postings(classes: DataFrame) -> DataFrame:
    """shingle, id, n, at, part of all short lists with several members, and each posting's neighbour before it (y, m, to).

    Neighbours are told in an order of each list's own, in a list of over ``PART`` postings within a part of it.
    """
    rows = classes.select("id", F.col("n_shingles").cast("int").alias("n"), "cuts", F.posexplode("short").alias("at", "shingle"))
    rows = rows.withColumn("cut", F.get("cuts", F.col("at")).cast("int"))
    rows = rows.withColumn("part", F.when(F.col("cut") > 0, F.expr("pmod(xxhash64(id), 1L << cut)"))).drop("cuts", "cut")
    order = Window.partitionBy("shingle", "part").orderBy(F.xxhash64("shingle", "id"))
    before = F.lag(F.struct("id", "n", "at")).over(order)
    chained = rows.select("*", before.alias("before"), F.lead("id").over(order).alias("after")).where("before IS NOT NULL OR after IS NOT NULL OR part IS NOT NULL")
    neighbour = [F.col(f"before.{c}").alias(name) for c, name in (("id", "y"), ("n", "m"), ("at", "to"))]
    return chained.select("shingle", "id", "n", "at", "part", *neighbour)


def chain(lists: DataFrame, divide: Divide) -> DataFrame:
    """(x, y): neighbours in a list, and the heads of neighbouring parts of a list."""
    order = Window.partitionBy("shingle").orderBy("part")  # a row for each part
    before = F.lag(F.struct("id", "n", "at")).over(order)
    heads = lists.where("part IS NOT NULL AND y IS NULL").select("shingle", "id", "n", "at", "part", before.alias("b"))
    heads = heads.select("id", "n", "at", F.col("b.id").alias("y"), F.col("b.n").alias("m"), F.col("b.at").alias("to"))
    both = lists.select(heads.columns).unionByName(heads).where("y IS NOT NULL").where(possible(divide))
    return both.select(F.least("id", "y").alias("x"), F.greatest("id", "y").alias("y")).distinct()


def search(lists: DataFrame, classes: DataFrame, joined: DataFrame, divide: Divide) -> DataFrame:
    """(x, y): candidates of different components, by merging the lists that hold several."""
    marked = lists.select("shingle", "id", "n", "at").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = marked.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    parts = F.ceil(F.col("members") / PART).cast("int").alias("parts")
    unsettled = marked.join(several.where("low <> high AND members > 2").select("shingle", parts), "shingle")
    left = materialize(unsettled.join(classes.select("id", "fold"), "id"), "jaccard-mixed")
    # every part of a list meets each part in a task of its own
    query = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    other = left.select("shingle", F.expr("CAST(pmod(xxhash64(id), parts) AS INT)").alias("part"), F.col("fold").alias("fold2"), F.col("id").alias("y"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("component").alias("other"))
    met = query.join(other, ["shingle", "part"]).where((F.col("id") < F.col("y")) & (F.col("component") != F.col("other")) & possible(divide) & alike(divide.similar))
    return merged(met.select(F.col("id").alias("x"), "shingle", "y", divide.reach_of(F.least("n", "m")).cast("int").alias("reach")))


def join(docs: DataFrame, size: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id for (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    divide = docs.sparkSession.sparkContext.broadcast(Divide(weights_of(sketch(docs, size)), similar))
    all_sets = materialize(short_lists(docs, divide, size), "jaccard-sets")
    grouped = all_sets.where("n_shingles > 0").groupBy("key_a", "key_b", "n_shingles")
    classes = grouped.agg(F.min("doc_id").alias("id"))
    owners = all_sets.join(classes.select(F.col("id").alias("doc_id"), "key_a", "key_b"), ["doc_id", "key_a", "key_b"], "left_semi")
    classes = materialize(owners.dropDuplicates(["doc_id", "key_a", "key_b"]).withColumnRenamed("doc_id", "id"), "jaccard-classes")
    lists = materialize(postings(classes), "jaccard-lists")
    pairs = materialize(chain(lists, divide.value), "jaccard-chain")
    found = materialize(verified(docs, pairs, classes, size, divide), "jaccard-links")
    joined = materialize(components(found), "jaccard-components")
    rest = materialize(search(lists, classes, joined, divide.value).join(pairs, ["x", "y"], "left_anti"), "jaccard-rest")
    if not rest.isEmpty():
        more = materialize(verified(docs, rest, classes, size, divide), "jaccard-more")
        if not more.isEmpty():
            joined = materialize(components(found.unionByName(more)), "jaccard-components")
    named = classes.select("key_a", "key_b", "n_shingles", "id").join(joined, "id", "left").select("key_a", "key_b", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    full = all_sets.where("n_shingles > 0").select("doc_id", "key_a", "key_b", "n_shingles").join(named, ["key_a", "key_b", "n_shingles"], "left").select("doc_id", "n_shingles", "component_id")
    empty = all_sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def firsts(docs: DataFrame, size: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, one for each doc_id and text, all columns.

    Only rows that a bitmap of fixed size cannot clear are joined with the ids to drop, so most texts stay where
    they are. Rows with a null doc_id stay. Of rows with equal ids and texts the one whose JSON sorts first stays.
    """
    found = materialize(join(docs, size, similar), "jaccard-found").where("doc_id IS NOT NULL")
    each = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    doubtful = materialize(each.where("component_id <> doc_id OR n > 1").select(F.col("doc_id").alias("id"), (F.col("component_id") == F.col("doc_id")).alias("stays")), "jaccard-doubtful")
    mask, slot = held_in(docs, doubtful.select("id"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), slot)

    def part(doubted: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(mask(batch) == doubted))

        return row.mapInArrow(task, row.schema)

    verdicts = part(True).join(doubtful.hint("merge"), "id", "left").where("stays OR stays IS NULL")
    once = verdicts.where("stays").groupBy("id", F.sha1("row.text")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return part(False).select("row.*").unionByName(verdicts.where("stays IS NULL").select("row.*")).unionByName(once.select("row.*"))


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, divide) -> DataFrame:
    """The pairs that link, by their parities first and then by probing."""
    left = materialize(near(pairs, classes, divide.value.similar), "jaccard-near")
    ids = materialize(left.select(F.explode(F.array("x", "y")).alias("id")).distinct().coalesce(2 * left.count() // EACH + 1), "jaccard-ids")
    return probe(left, materialize(sets_of(docs, ids, size), "jaccard-held"), divide)


#: ``join`` in DuckDB's SQL, for three words and 90 hundredths; lists of all shingles are joined, so it is for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS ss FROM w
), c AS (SELECT ss, min(doc_id) AS id, len(ss) AS n FROM s WHERE len(ss) > 0 GROUP BY ss),
e AS (SELECT id, n, unnest(ss) AS shingle FROM c),
links AS (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT id AS x, id AS y FROM c UNION SELECT r.x, ways.y FROM reach r JOIN ways ON r.y = ways.x),
least_id AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)
SELECT doc_id, len(s.ss) AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN c ON s.ss = c.ss LEFT JOIN least_id USING (id)
"""
