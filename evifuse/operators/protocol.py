"""Evaluation protocol: hashed partitions of whole groups, leakage, manifests and their reconciliation, fixed pools."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a piece of a manifest's text, buckets of its digest tree as a power of two for each level.
PIECE, LEVELS = 1 << 16, (4, 8, 12)


def bucket(value: Column, n: int = 10) -> Column:
    """The first eight hexadecimal digits of the SHA-256, modulo ``n``."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("bigint") % n


def partition_of(group: Column) -> Column:
    """Seven, one and two of ten buckets for training, validation and test; a group is never parted."""
    b = bucket(F.coalesce(group, F.lit("ungrouped")))
    return F.when(b <= 6, "train").when(b == 7, "validation").otherwise("test")


def block_group(sample: Column, size: int = 100) -> Column:
    """Group of consecutive frames: ids are digits and a D or N for day or night; null for other ids."""
    number, kind = F.regexp_extract(sample, r"^(\d+)[DN]$", 1), F.regexp_extract(sample, r"^\d+([DN])$", 1)
    block = F.floor(F.when(number != "", number).cast("bigint") / size).cast("string")
    return F.when(number != "", F.concat(F.lower(kind), F.lit("-block-"), F.when(F.length(block) < 3, F.lpad(block, 3, "0")).otherwise(block)))


def leaks(items: DataFrame) -> DataFrame:
    """Groups that occur in several partitions; there should be none."""
    return items.groupBy("grp").agg(F.count_distinct("partition").alias("n_partitions"), F.count(F.lit(1)).alias("n")).where("n_partitions > 1")


def manifest(items: DataFrame, keys: list[str], token: str) -> DataFrame:
    """n and SHA-256 of the sorted tokens, one on a line. Null tokens count nowhere.

    Tokens are sorted by ranges and joined to pieces of text there; the digest reads a group's pieces as a stream in their order, with one piece in memory.
    """
    order = [*keys, token]
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        told = lambda: pa.RecordBatch.from_pylist([dict(zip(keys, at)) | {"first": held[0], "n": len(held), "text": "\n".join(held).encode()}], kept)
        for batch in batches:
            kept = pa.schema([batch.schema.field(k) for k in keys] + [pa.field("first", pa.string()), pa.field("n", pa.int64()), pa.field("text", pa.binary())])
            for *key, word in zip(*(batch.column(c).to_pylist() for c in order)):
                if held and (key != at or size >= PIECE):
                    yield told()
                    held, size = [], 0
                at = key
                held.append(word)
                size += len(word) + 1
        if held:
            yield told()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, n = None, None, 0
        told = lambda: pa.RecordBatch.from_pylist([dict(zip(keys, at)) | {"n": n, "digest": state.hexdigest()}], kept)
        for batch in batches:
            kept = pa.schema([batch.schema.field(k) for k in keys] + [pa.field("n", pa.int64()), pa.field("digest", pa.string())])
            for *key, count, text in zip(*(batch.column(c).to_pylist() for c in [*keys, "n", "text"])):
                if key != at:
                    if at is not None:
                        yield told()
                    at, state, n = key, hashlib.sha256(), 0
                elif n:
                    state.update(b"\n")
                state.update(text)
                n += count
        if at is not None:
            yield told()

    parted = items.select(*order).where(F.col(token).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = parted.mapInArrow(pieces, f"{schema}, first string, n long, text binary")
    return texts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{schema}, n long, digest string")


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON with sorted keys, no blanks, nulls written out, as text. For structs, arrays, maps with text keys, whole numbers, texts, booleans, and doubles from 0.001 to 10 millions."""

    def sorted_(x: Column, of: T.DataType) -> Column:
        if isinstance(of, T.StructType):
            return F.when(x.isNotNull(), F.struct(*(sorted_(x.getField(f.name), f.dataType).alias(f.name) for f in sorted(of.fields, key=lambda f: f.name))))
        if isinstance(of, T.ArrayType):
            return F.transform(x, lambda e: sorted_(e, of.elementType))
        if isinstance(of, T.MapType):
            return F.map_from_entries(F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("key"), sorted_(e["value"], of.valueType).alias("value")))))
        return x

    return F.to_json(sorted_(value, kind), {"ignoreNullFields": "false"})


def digest_tree(items: DataFrame, token: str) -> DataFrame:
    """level, bucket, n, and four sums of 32 bits of the hashed tokens in it: equal for equal multisets of tokens, whatever their order.

    A bucket is the first bits of a token's SHA-256; each level parts the buckets of the one before, so a difference is followed downwards.
    """
    digest = F.sha2(token, 256)
    lanes = [F.conv(F.substring(digest, 17 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    leaves = items.where(F.col(token).isNotNull()).groupBy(F.shiftright(first, 32 - LEVELS[-1]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"),
        *(F.sum(x).alias(f"s{i}") for i, x in enumerate(lanes)))
    sums = [F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3")]
    levels = [leaves.groupBy(F.shiftright("bucket", LEVELS[-1] - bits).alias("bucket")).agg(*sums).select(F.lit(i).alias("level"), "*") for i, bits in enumerate((0, *LEVELS))]
    return reduce(DataFrame.unionByName, levels)


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """level, bucket where two digest trees differ."""
    names = ["n", "s0", "s1", "s2", "s3"]
    both = ours.select("level", "bucket", F.struct(*names).alias("a")).join(theirs.select("level", "bucket", F.struct(*names).alias("b")), ["level", "bucket"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("level", "bucket")


def reconciled(expected: DataFrame, outputs: DataFrame, failures: DataFrame) -> DataFrame:
    """sample, reason, failure_class of what an external run's outputs lack or have too much: only the buckets where both sides differ are compared id by id.

    expected: sample. outputs: sample (repeated ones count as invalid). failures: sample, reason, of which the first by text counts.
    """
    leaf = len(LEVELS)
    odd = differing(digest_tree(expected.distinct(), "sample"), digest_tree(outputs, "sample")).where(F.col("level") == leaf).select("bucket")
    bucket = F.shiftright(F.conv(F.substring(F.sha2("sample", 256), 1, 8), 16, 10).cast("long"), 32 - LEVELS[-1])
    within = lambda df: df.where("sample IS NOT NULL").withColumn("bucket", bucket).join(F.broadcast(odd), "bucket", "left_semi")  # noqa: E731  4096 buckets at most
    counted = within(outputs.select("sample")).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    both = within(expected.select("sample").distinct()).drop("bucket").withColumn("wanted", F.lit(True)).join(counted, "sample", "full")
    told = both.join(failures.groupBy("sample").agg(F.min("reason").alias("declared")), "sample", "left")
    wanted, n, declared = F.coalesce("wanted", F.lit(False)), F.coalesce("n", F.lit(0)), F.col("declared")
    reason = F.when(wanted & (n == 0) & declared.isNotNull(), F.concat(F.lit("external runtime failure: "), declared)).when(wanted & (n == 0),
        "missing output entry").when(~wanted, "unexpected output entry").when(n > 1, "invalid or duplicate sample_id")
    kind = F.when(wanted & (n == 0) & declared.isNotNull(), "runtime").otherwise("integrity_or_completeness")
    return told.select("sample", reason.alias("reason"), kind.alias("failure_class")).where("reason IS NOT NULL")


def hash_pool(items: DataFrame, keys: list[str], token: str, n: int) -> DataFrame:
    """The first ``n`` of each key by hashed token; the limit is the feature."""
    order = Window.partitionBy(*keys).orderBy(F.sha2(F.col(token), 256), token)
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def set_comparison(items: DataFrame, member: str, kind: str) -> DataFrame:
    """How many members occur in exactly which kinds."""
    held = items.groupBy(member).agg(F.array_join(F.array_sort(F.collect_set(kind)), "+").alias("kinds"))
    return held.groupBy("kinds").agg(F.count(F.lit(1)).alias("n"))
