"""Prefix trie of rebuilt conversations, by smallest-member ownership.

A node is a sequence of first turns. Its key is made of the sums of four 32-bit hashes of (place, role, text) up to
its last turn, 128 bits in all, so that a conversation's keys are running sums and a node's parent is known by
subtraction. A node belongs to its smallest member; as deeper nodes have fewer members, a conversation owns the nodes at the end
of its path. In a subtree each occurrence of a turn that its conversation does not own is one that the trie saves, so
running sums along each conversation and one group-by over keys, which adds them up over members, give the tokens saved, the leaves and the children.

Nodes that a third of all conversations share are partial sums, never a window or a list: the smallest member is an
aggregate joined back, not a window over the node. Windows run over a conversation in blocks of turns, whose sums go on from block to block, so a very long conversation
is several tasks. Which conversations end in a node is hashed from texts of up to 4096 ids each, streamed in order.

Edge cases: null roles and texts are empty, a null turn comes first, turns of equal number are ordered by role, then text. Rows without a conv_id belong to
no conversation. Repeated rows are turns of their own. Conversations without turns end in the root. An empty table has no
nodes. Other columns of the input are left out, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.llm.shared import materialize

#: Conversations that share their beginnings, and the bound of a shared beginning's turns.
GROUP, HEADS = 5, 9
#: Binary logarithms of the turns in a block and of the range of ids in one text.
BLOCK, IDS = 10, 12

KEY = ["depth", "s0", "s1", "s2", "s3"]
PARENT = ["parent_depth", "p0", "p1", "p2", "p3"]
EMPTY = sha256(b"").hexdigest()


def running(rows: DataFrame, place: Column, order: list, values: dict[str, Column]) -> DataFrame:
    """Sums of ``values`` up to each row of its conversation, and (``all_`` before the name) over all of it. ``place`` ascends with the order."""
    blocked = rows.withColumn("_block", F.coalesce(F.shiftright(place, BLOCK), F.lit(-1 << 60)))
    so_far = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("conv_id", "_block").agg(*(F.sum(v).alias(name) for name, v in values.items()))
    ahead = sums.select("conv_id", "_block", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}") for name in values), *(F.sum(name).over(whole).alias(f"all_{name}") for name in values))
    summed = blocked.withColumns({name: F.sum(v).over(so_far) for name, v in values.items()}).join(ahead, ["conv_id", "_block"])
    return summed.withColumns({name: F.col(name) + F.col(f"_{name}") for name in values}).drop("_block", *(f"_{name}" for name in values))


def halves(name: str, *of: Column) -> dict[str, Column]:
    """Four 32-bit numbers from two hashes of 64 bits."""
    hashes = [F.xxhash64(F.lit(seed), *of) for seed in (0, 1)]
    return {f"{name}{2 * i + j}": F.shiftrightunsigned(h, 32) if j else h.bitwiseAND(F.lit(0xFFFFFFFF)) for i, h in enumerate(hashes) for j in (0, 1)}


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, i (from 1), hash0 to hash3 of role and text, bytes."""
    told = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    ordered = running(told, F.col("turn"), order, {"i": F.lit(1)})
    return ordered.select("conv_id", "i", *(h.alias(n) for n, h in halves("hash", F.col("role"), F.col("text")).items()), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, depth, lane0 to lane3, bytes: the first turns of the group's first conversation, then one's own, and a row of depth 0."""
    head = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    named = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("root"), head.alias("head"))
    roots = named.join(convs.select(F.col("conv_id").alias("root"), F.col("n").alias("n_root")), "root", "left")
    first = turns.where(F.col("i") < heads).withColumnRenamed("conv_id", "root")  # so many rows for each conversation at most
    hashes = [f"hash{i}" for i in range(4)]
    taken = named.join(first, "root").where("i <= head").select("conv_id", F.col("i").alias("depth"), *hashes, "bytes")
    own = turns.join(roots.select("conv_id", "head", "n_root"), "conv_id").where("i > head")
    own = own.select("conv_id", (F.col("i") - F.col("head") + F.least("head", F.coalesce("n_root", F.lit(0)))).alias("depth"), *hashes, "bytes")
    both = taken.unionByName(own)
    steps = both.select("conv_id", "depth", *(h.alias(n) for n, h in halves("lane", F.col("depth"), *map(F.col, hashes)).items()), "bytes")
    zero = convs.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ["depth", "lane0", "lane1", "lane2", "lane3", "bytes"]))
    return zero.unionByName(steps)


def paths(steps: DataFrame) -> DataFrame:
    """A row for each conversation and node on its path: the node's key and its parent's, bytes, whether the conversation ends here."""
    summed = running(steps, F.col("depth"), ["depth"], {f"s{i}": F.col(f"lane{i}") for i in range(4)} | {"rows": F.lit(1)})
    parents = [(F.col("depth") - 1).alias("parent_depth"), *((F.col(f"s{i}") - F.col(f"lane{i}")).alias(f"p{i}") for i in range(4))]
    return summed.select("conv_id", *KEY, *parents, "bytes", (F.col("rows") == F.col("all_rows")).alias("ends"))


def ends_digest(rows: DataFrame) -> DataFrame:
    """Key and ends_sha256 of the nodes where conversations end: ids ascending, joined by commas, as a stream of short texts."""
    texts = rows.where("ends").groupBy(*KEY, F.shiftright("conv_id", IDS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    parted = texts.repartition(*KEY).sortWithinPartitions(*KEY, "range")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"])):
                if key == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append([*at, state.hexdigest()])
                at, state = key, sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], [*KEY, "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in [*at, state.hexdigest()]], [*KEY, "ends_sha256"])

    return parted.mapInArrow(digest, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string")


def trie(rows: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialize(numbered(rows), "trie-turns")
    path = materialize(paths(rebuilt(turns, group, heads)), "trie-paths")
    owners = path.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.bool_and("ends").alias("childless"))
    owned = F.col("conv_id") == F.col("owner")
    marked = path.join(materialize(owners, "trie-owners"), KEY).withColumn("owned", owned)
    values = {"saved": F.when(~F.col("owned"), F.col("bytes")).otherwise(0), "leaves": (F.col("owned") & F.col("ends") & F.col("childless")).cast("long")}
    along = materialize(running(marked, F.col("depth"), ["depth"], values), "trie-along")
    here = F.when(~F.col("owned"), F.col("bytes")).otherwise(0)
    member = along.select(*KEY, F.col("conv_id").alias("owner"), F.lit(1).alias("n_convs"), F.lit(0).alias("n_children"), F.col("all_leaves").alias("n_leaves"), (F.col("all_saved") - F.col("saved") + here).alias("saved_tokens"), *PARENT[1:])
    none = [F.lit(None).cast("long").alias(c) for c in PARENT[1:]]
    child = along.where("owned AND depth > 0").select(*(F.col(p).alias(k) for p, k in zip(PARENT, KEY)), F.lit(None).cast("long").alias("owner"), F.lit(0).alias("n_convs"), F.lit(1).alias("n_children"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), *none)
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = member.unionByName(child).groupBy(*KEY).agg(F.min("owner").alias("owner"), *sums, *(F.min(c).alias(c) for c in PARENT[1:]))
    nodes = materialize(nodes.withColumn("parent_depth", F.col("depth") - 1), "trie-nodes")
    parents = nodes.select(*(F.col(k).alias(p) for p, k in zip(PARENT, KEY)), F.col("owner").alias("parent_conv_id"))
    named = nodes.join(parents, PARENT, "left").join(ends_digest(path), KEY, "left")
    return named.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


SQL = r"""
WITH RECURSIVE ids AS (SELECT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
crc(c, s, i, x) AS (SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT c, s, i + 1, xor(x >> 1, ((x + (ascii(s[i // 8 + 1]) >> (i % 8))) % 2) * CAST(3988292384 AS BIGINT)) FROM crc WHERE i < 8 * length(s)),
h AS (SELECT c, xor(x, 4294967295) % 9 AS h, c - c % 5 AS root FROM crc WHERE i = 8 * length(s)),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
r AS (SELECT h.c, t.i AS d, role, text FROM h JOIN t ON t.c = h.root AND t.i <= h.h
  UNION ALL SELECT t.c, t.i - h.h + least(h.h, coalesce(n.n, 0)), role, text FROM t JOIN h ON h.c = t.c LEFT JOIN n ON n.c = h.root WHERE t.i > h.h),
p AS (SELECT c, d, text, string_agg(md5(role || chr(10) || text), '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, count(*) OVER (PARTITION BY c) AS size FROM r),
m AS (SELECT c, d, path, size, strlen(text) AS bytes FROM p UNION ALL SELECT h.c, 0, '', (SELECT count(*) FROM r WHERE r.c = h.c), 0 FROM h),
v AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '')) AS ends FROM m GROUP BY path, d),
k AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (path)),
u AS (SELECT left(path, 32 * top) AS path, sum(n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS top FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN u USING (path) LEFT JOIN v o ON w.d > 0 AND o.path = left(w.path, 32 * (w.d - 1))
"""
