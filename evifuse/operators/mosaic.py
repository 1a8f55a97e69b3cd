"""Mosaics: bilinear splats into grid cells, winners, dominant sources, snapshots.

Cells are sums, so partial aggregation combines them where they arise and any order of frames gives the same
result; ties are broken by the lowest class and the first arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def splat_weight(support: Column, cosine: Column, uncertainty: Column, resolution: float) -> Column:
    return support * cosine / (1 + F.pow(uncertainty / resolution, 2))


def splat(samples: DataFrame, rows: int, columns: int) -> DataFrame:
    """Each sample (east, north in cells, weight) to the four cells around it; weights of zero and cells outside fall."""
    r, c = F.floor("north").cast("int"), F.floor("east").cast("int")
    fr, fc = F.col("north") - F.floor("north"), F.col("east") - F.floor("east")
    corners = F.array(*(F.struct((r + i).alias("row"), (c + j).alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc) * F.col("weight")).alias("w")) for i in (0, 1) for j in (0, 1)))
    spread = samples.withColumn("corner", F.explode(corners)).select("*", "corner.*").drop("corner")
    return spread.where((F.col("w") > 0) & (F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < columns))


def accumulate(parts: DataFrame) -> DataFrame:
    """Cell sums. A missing thermal value adds to neither of its sums; coverage counts contributions, frames their frames."""
    heat = F.when(F.col("thermal").isNotNull(), F.col("w"))
    return parts.groupBy("row", "col").agg(
        F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("value")).alias("value_sum"), F.sum(heat).alias("thermal_weight"), F.sum(heat * F.col("thermal")).alias("thermal_sum"),
        F.count(F.lit(1)).alias("coverage_count"), F.count_distinct("frame").alias("frame_count"),
    )


def snapshot(cells: DataFrame) -> DataFrame:
    """Weighted means, null without weight, and the support 1 - exp(-weight)."""
    mean = lambda s, w: F.when(F.col(w) > 0, F.col(s) / F.col(w))
    return cells.select("row", "col", mean("value_sum", "weight").alias("value"), mean("thermal_sum", "thermal_weight").alias("thermal"),
        (1 - F.exp(-F.col("weight"))).alias("support"), "coverage_count", "frame_count")


def semantic_winner(parts: DataFrame) -> DataFrame:
    """The class with the most evidence in a cell, the lowest on ties, and its share; negative classes are unknown."""
    held = parts.where("class >= 0").groupBy("row", "col", "class").agg(F.sum("w").alias("w"))
    return held.groupBy("row", "col").agg(F.max_by("class", F.struct("w", -F.col("class"))).alias("class"), (F.max("w") / F.sum("w")).alias("confidence"))


def dominant_source(parts: DataFrame) -> DataFrame:
    """The frame with the largest weight in a cell; the first arrival wins ties."""
    each = parts.groupBy("row", "col", "frame", "seq").agg(F.sum("w").alias("w"))
    return each.groupBy("row", "col").agg(F.max_by("frame", F.struct("w", -F.col("seq"))).alias("frame"), F.max("w").alias("w"))
