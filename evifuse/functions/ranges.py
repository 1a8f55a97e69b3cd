"""Ranges of an ordered column, to work on in parallel what would else be one long order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.sources.scratch import written

#: Rows that a task groups or sorts at once.
PART = 1 << 18


def parts(rows: DataFrame) -> int:
    """Into how many tasks rows are dealt: as many more as there are more rows. They are counted, so they should be cheap to read."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART))


def cut(rows: DataFrame, key: str, count: int) -> list:
    """Ascending bounds of at most ``count`` ranges with about equally many rows."""
    cuts = rows.agg(F.percentile_approx(key, [i / count for i in range(1, count)] or [0.5], 100 * count).alias("cuts")).first().cuts
    return sorted(set(cuts or []))


def range_of(bounds: list, key: Column) -> Column:
    """How many of the ascending bounds are at most the key, by binary search."""
    if not bounds:
        return F.lit(0)
    held, n = F.lit(bounds), len(bounds)
    steps = [1 << i for i in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) <= key), at + step).otherwise(at))


def numbered(rows: DataFrame, *order, name: str = "number") -> DataFrame:
    """``rows`` with their places (from 0) in the order, counted within ranges; of the ranges only the sizes are summed up."""
    marked = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each range
    placed = marked.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_start")
