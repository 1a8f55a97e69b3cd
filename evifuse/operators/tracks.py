"""Object tracks: segments, latest points, retention of tracks and of whole layers, freshness."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.functions.ranges import cut, range_of
from evifuse.sources.scratch import written

#: Points that a layer keeps.
LAYER_CAP = 10_000


def segments(points: DataFrame, gap_ns: int) -> DataFrame:
    """Number of the connected run each point lies in: a run breaks where time steps back or by more than the gap."""
    order = Window.partitionBy("track").orderBy("t", "seq")
    step = F.col("t") - F.lag("t").over(order)
    broken = F.when(step.isNull() | (step < 0) | (step > gap_ns), 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("broken", broken).withColumn("segment", F.sum("broken").over(running)).drop("broken")


def latest(points: DataFrame) -> DataFrame:
    """The newest point of each track; the later arrival wins ties."""
    others = [c for c in points.columns if c != "track"]
    return points.groupBy("track").agg(F.max_by(F.struct(*others), F.struct("t", "seq")).alias("p")).select("track", "p.*")


def retained(points: DataFrame, keep_ns: int, cap: int) -> DataFrame:
    """Points no older than the bound before their track's newest time, of these the newest ``cap``; the cap is the feature."""
    newest = F.max("t").over(Window.partitionBy("track"))
    order = Window.partitionBy("track").orderBy(F.desc("t"), F.desc("seq"))
    young = points.withColumn("newest", newest).where(F.col("t") >= F.col("newest") - keep_ns).drop("newest")
    return young.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


class Layer:
    """The points that a layer holds: in the order of arrival, and by time for those that may age."""

    def __init__(self, newest: int | None):
        self.newest, self.n, self.order, self.aging = newest, 0, deque(), []

    def add(self, seq: int, t: int | None, keep_ns: int, cap: int) -> int | None:
        """The first arrival left, if the cap pushed one out."""
        node = [seq, t, True]
        self.order.append(node)
        self.n += 1
        if t is not None:
            self.newest = t if self.newest is None else max(self.newest, t)
            heappush(self.aging, (t, seq, node))
        while self.aging and self.aging[0][0] < self.newest - keep_ns:
            self.drop(heappop(self.aging)[2])
        over = self.n > cap
        while self.n > cap:
            self.drop(self.order.popleft())
        while self.order and not self.order[0][2]:
            self.order.popleft()
        if len(self.aging) > 2 * cap + 1000:  # without those that the cap has pushed out
            self.aging = [x for x in self.aging if x[2][2]]
            heapify(self.aging)
        return self.order[0][0] if over else None

    def drop(self, node: list) -> None:
        if node[2]:
            node[2] = False
            self.n -= 1


def layer_retained(points: DataFrame, keep_ns: int, cap: int = LAYER_CAP) -> DataFrame:
    """What a layer holds after its last arrival: points (layer, seq, t, ...) in the order of seq, which is unique in a layer.

    With each arrival the points fall that are older than ``keep_ns`` before the layer's newest time, then the first arrivals beyond ``cap``, which is
    the feature. Points without a time (unlocated) do not age. What is left can only be among the last ``cap`` points that are young at the end: they
    are found by counting ranges of arrivals, without a sort of the layer. Which of them an earlier moment has pushed out is told by
    walking through the arrivals since the oldest of them, with ``cap`` places in memory.
    """
    newest = points.groupBy("layer").agg(F.max("t").alias("newest"))
    young = points.join(newest, "layer").where(F.col("t").isNull() | (F.col("t") >= F.col("newest") - keep_ns)).drop("newest")
    bounds = cut(points, "seq", int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = young.withColumn("range", range_of(bounds, F.col("seq")))
    later = Window.partitionBy("layer").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("layer", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("beyond", F.coalesce(F.sum("n").over(later), F.lit(0)))
    wanted = ranged.join(counts.where(F.col("beyond") < cap).select("layer", "range", "beyond"), ["layer", "range"])
    place = F.col("beyond") + F.row_number().over(Window.partitionBy("layer", "range").orderBy(F.desc("seq")))
    last = written(wanted.withColumn("place", place).where(F.col("place") <= cap).drop("range", "beyond", "place"), "layer-last")
    since = last.groupBy("layer").agg(F.min("seq").alias("since"))
    first = points.join(since, "layer").groupBy("layer").agg(F.max(F.when(F.col("seq") < F.col("since"), F.col("t"))).alias("before"), F.min("since").alias("since"))
    arrivals = points.select("layer", "seq", "t").join(first, "layer").where("seq >= since").select("layer", "seq", "t", "before")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first arrival that each layer still holds, a row for every layer that lost one to the cap."""
        layer, held, bound = None, None, None
        for batch in batches:
            for name, seq, t, before in zip(*(batch.column(c).to_pylist() for c in ("layer", "seq", "t", "before"))):
                if name != layer:
                    if bound is not None:
                        yield told(layer, bound)
                    layer, held, bound = name, Layer(before), None
                bound = held.add(seq, t, keep_ns, cap) or bound
        if bound is not None:
            yield told(layer, bound)

    kind = points.schema["layer"].dataType.simpleString()
    told = lambda layer, bound: pa.record_batch({"layer": [layer], "bound": pa.array([bound], pa.int64())})
    walked = arrivals.repartition("layer").sortWithinPartitions("layer", "seq").mapInArrow(walk, f"layer {kind}, bound long")
    return last.join(walked, "layer", "left").where("bound IS NULL OR seq >= bound").drop("bound")


def freshness(t: Column, now: int, stale_ns: int, future_ns: int = 5_000_000_000) -> Column:
    """State of a record's time against a given now."""
    return F.when(t.isNull(), "unverified").when(t > now + future_ns, "future").when(t < now - stale_ns, "stale").otherwise("fresh")
