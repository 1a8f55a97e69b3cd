"""Document fingerprints from closed syncmers, in DataFrame operations alone.

``SMER`` neighbouring code points make an s-mer, ``KMER`` a k-mer. A k-mer is chosen if the least
hash of its s-mers stands at its first place, or at its last and nowhere before. Whether it is chosen depends on its own characters
alone, so an edit moves no choice beyond the k-mers it touches. That also lets a text be cut into overlapping blocks
of ``BLOCK`` characters, and the anchors of an edited text be put together from those of its parts and of the seam.

An anchor is a chosen k-mer's 32-bit hash and its place; the fingerprint writes both, in text order, as eight
hexadecimal digits each. Fingerprints are matched by position: equal anchors of both texts are paired place by place, and those
pairs count whose shift (the difference of places) lies in the densest band of two neighbouring ``BAND`` characters. The likeness is their
number over that of all anchors of both texts. Words in another order, moved paragraphs and repeated passages make texts
less alike, though the anchors are the same.

Edge cases: a null or empty text has the empty fingerprint; two of them are alike (1), one and another are not (0). A
text without a chosen k-mer (any under ``KMER`` characters) has one anchor, of the whole text. Equal texts are alike (1), however often they repeat
a passage. Texts are taken whole. Rows of one doc_id are ordered by their text; null ids come first. A single document is
its own next one. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.functions.ranges import cut, range_of
from evifuse.llm.quality import let

KMER, SMER = 20, 5
#: Code points of a block; width of half the band in which shifts agree.
BLOCK, BAND = 4096, 256
#: Ranges of doc_id for each shuffle partition.
RANGES = 4
LOW = 0xFFFFFFFF
NONE = "array<bigint>"


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(LOW))


def of_block(text: Column) -> Column:
    """Chosen k-mers of a short text: hash in the upper half of each number, place in the lower."""
    width = KMER - SMER + 1

    def lower(v: Column, step: int) -> Column:
        """The lower of each number and of the one ``step`` behind it; null where there is none."""
        return F.zip_with(v, F.slice(v, step + 1, F.size(v)), lambda x, y: F.when(x <= y, x).otherwise(y))

    def chosen(smers: Column, fours: Column) -> Column:
        """``fours`` holds the least of each four neighbours, so a k-mer is told by a few comparisons, mostly by the first. The steps cover 14 to 18 s-mers of a k-mer."""
        four = lambda i, step: F.get(fours, i + step)

        def start(x: Column, i: Column) -> Column:
            """Of two neighbours, the first can be the least of the k-mer that it starts, or the second of the one that it ends."""
            after = F.get(smers, i + 1)
            first = (x <= four(i, 2)) & ((x <= four(i, 6)) & ((x <= four(i, 10)) & ((x <= four(i, width - 4)) & (i <= F.size(smers) - width))))
            end = (after < four(i, -4)) & ((after < four(i, -8)) & ((after < four(i, -12)) & ((after < four(i, 2 - width)) & (i >= width - 2))))
            return F.when(x <= after, F.when(first, i)).when(end, i + 2 - width)

        places = F.sort_array(F.array_distinct(F.array_compact(F.transform(smers, start))))
        kmer = lambda i: F.xxhash64(*(F.get(smers, i + at) for at in range(0, width, SMER)))
        return F.transform(places, lambda i: kmer(i).bitwiseAND(F.lit(~LOW)) + i)

    smers = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{SMER}}}))."), F.lit(1)), lambda s: F.xxhash64(s))
    return let(smers, lambda v: let(lower(v, 1), lambda pairs: let(lower(pairs, 2), lambda fours: chosen(v, fours))))


def chosen_in(text: Column) -> Column:
    """Chosen k-mers of a text of any length, block by block."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{BLOCK + KMER - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    return F.flatten(F.transform(blocks, lambda b, j: F.transform(of_block(b), lambda v: v + j.cast("long") * BLOCK)))


def completed(found: Column, text: Column) -> Column:
    """The anchors: the chosen k-mers, or one for the whole text where there is none."""
    whole = F.array(F.xxhash64(text).bitwiseAND(F.lit(~LOW)))
    return F.when((F.size(found) > 0) | (text == ""), found).otherwise(whole)


def written(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Pairs of equal anchors in the densest band over all anchors. Anchors at one place in both texts are pairs with shift 0."""
    hashes = lambda v: F.transform(v, lambda x: F.shiftright(x, 32))

    def shared(same: Column) -> Column:
        left = lambda x, y: F.array_except(x, y)  # noqa: E731  no anchor stands twice at a place
        rest = F.struct(left(a, b).alias("a"), left(b, a).alias("b"))
        return let(rest, lambda r: F.when(F.arrays_overlap(hashes(r["a"]), hashes(r["b"])), densest(r["a"], r["b"], same)).otherwise(same))

    share = let(let(F.size(F.array_intersect(a, b)), shared), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def densest(a: Column, b: Column, same: Column) -> Column:
    """How many pairs have a shift in the densest band, ``same`` further ones having shift 0."""
    keyed = lambda v, side: F.transform(v, lambda x: x + place_of(x) + side)  # noqa: E731  hash, place, side
    merged = F.sort_array(F.concat(keyed(a, 0), keyed(b, 1)))
    place = lambda x: F.shiftright(place_of(x), 1)
    side = lambda x: x.bitwiseAND(F.lit(1))

    def shift(x: Column, y: Column) -> Column:
        equal = (F.shiftright(x, 32) == F.shiftright(y, 32)) & (side(x) != side(y))  # neighbours in order of hash and place
        return F.when(equal, F.floor((place(x) - place(y)) * (1 - 2 * side(x)) / BAND))

    bands = lambda m: F.array_compact(F.zip_with(F.slice(m, 1, F.size(m) - 1), F.slice(m, 2, F.size(m) - 1), shift))
    start = F.struct(F.lit(-(1 << 62)).alias("band"), F.lit(0).alias("n"), F.lit(0).alias("below"), F.lit(0).alias("best"))

    def count(acc: Column, band: Column) -> Column:
        stays = band == acc["band"]
        n = F.when(stays, acc["n"] + 1).when(band == 0, same).otherwise(1)  # one 0 was put in for ``same``
        below = F.when(stays, acc["below"]).when(band == acc["band"] + 1, acc["n"]).otherwise(0)
        return F.struct(band.alias("band"), n.alias("n"), below.alias("below"), F.greatest(acc["best"], n + below).alias("best"))

    zero = F.array(F.lit(0).cast("long"))
    found = let(merged, lambda m: F.aggregate(F.sort_array(F.concat(bands(m), zero)), start, count, lambda acc: acc["best"]))
    return F.least(found, same + F.size(a), same + F.size(b))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, chosen, and next_text, next_chosen of the next doc_id; after the last, of the first.

    Rows are dealt by ranges of doc_id, so no task orders them all. The first row of a range joins the range
    before as a guest behind its last row; only the ranges' bounds and first ids pass through the driver.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
    count = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = cut(ids, "key", count)
    part = range_of(bounds, F.col("key")).alias("part")
    firsts = sorted((r.first, r.part) for r in ids.select("key", part).groupBy("part").agg(F.min("key").alias("first")).collect())
    before = {first: firsts[i - 1][1] for i, (first, _) in enumerate(firsts)}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
    own = rows.select("*", F.lit(0).alias("guest"), part)
    places = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map().cast("map<bigint,int>")
    guests = rows.where(F.col("key").isin(list(before))).select("*", F.lit(1).alias("guest"), places[F.col("key")].alias("part"))
    dealt = own.unionByName(guests).repartition("part").withColumn("chosen", chosen_in(F.col("text")))
    order = Window.partitionBy("part").orderBy("guest", "key", "text")
    led = dealt.select("doc_id", "text", "chosen", "guest", F.lead("text").over(order).alias("next_text"), F.lead("chosen").over(order).alias("next_chosen"))
    return led.where("guest = 0")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_anchors for (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", let(chosen_in(text), lambda v: completed(v, text)).alias("anchors"))
    return found.select("doc_id", written(F.col("anchors")).alias("fingerprint"), F.size("anchors").alias("n_anchors"))


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Each text beside an edited one, whose second half is taken from the next document, and beside that document."""
    c, ends = F.col, lambda v: place_of(v) + KMER
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).withColumns({"kept": F.length("text") - half, "taken": F.least(half, F.length("next_text"))})
    rows = rows.withColumn("edited", F.concat(F.substring(c("text"), F.lit(1), c("kept")), F.substring(c("next_text"), F.lit(1), c("taken"))))
    # k-mers over the seam start before it, and less than a k-mer's length before
    at = F.greatest(c("kept") - (KMER - 1), F.lit(0))
    seam = F.transform(of_block(F.substring(c("edited"), at + 1, c("kept") + (KMER - 1) - at)), lambda v: v + at)
    left = F.filter("chosen", lambda v: ends(v) <= c("kept"))
    right = F.transform(F.filter("next_chosen", lambda v: ends(v) <= c("taken")), lambda v: v + c("kept"))
    rows = rows.withColumn("edited_chosen", F.concat(left, seam, right))
    named = {"a": completed(c("chosen"), c("text")), "e": completed(c("edited_chosen"), c("edited")), "n": completed(c("next_chosen"), c("next_text"))}
    return rows.withColumns(named).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(c("a")).alias("fingerprint"), written(c("e")).alias("edited_fingerprint"), likeness(c("a"), c("e")).alias("near_edited"), likeness(c("a"), c("n")).alias("near_next"),
    )
