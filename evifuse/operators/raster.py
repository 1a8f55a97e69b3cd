"""Raster operators over long pixels (frame, y, x, v): normalization, neighbourhoods, fusion.

The long form is the query form; frames are independent, so each operator shuffles by frame at most. Borders are
reflected without repeating the edge pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.functions import raster as values
from evifuse.functions.raster import clip


def frame():
    """All pixels of a frame."""
    return Window.partitionBy("frame")


def robust_normalize(pixels: DataFrame, value: str = "v", valid: Column | None = None, eps: float = 1e-8, into: str = "norm") -> DataFrame:
    """Exact first and last percentiles of the valid pixels to 0 and 1; a flat or empty frame is 0."""
    chosen = F.col(value) if valid is None else F.when(valid, F.col(value))
    low, high = (F.percentile(chosen, F.lit(p)).over(frame()) for p in (0.01, 0.99))
    flat = low.isNull() | (high <= low + eps)
    return pixels.withColumn(into, F.when(flat, F.lit(0.0)).otherwise(clip((F.col(value) - low) / (high - low))))


def scale_by_p99(pixels: DataFrame, value: str, into: str) -> DataFrame:
    scale = F.greatest(F.percentile(value, F.lit(0.99)).over(frame()), F.lit(1e-7))
    return pixels.withColumn(into, clip(F.col(value) / scale))


def _axis_blur(pixels: DataFrame, axis: str, n: int, radius: int, value: str) -> DataFrame:
    """Each pixel gives its value to the 2 radius + 1 around it, and around its mirror images beyond the borders. The radius is less than n."""
    others, own = "x" if axis == "y" else "y", F.col(axis)
    images = F.array_distinct(F.array(own, -own, 2 * (n - 1) - own))
    inside = lambda i: F.filter(F.sequence(i - radius, i + radius), lambda j: (j >= 0) & (j < n))
    spread = pixels.select("frame", others, F.col(value).alias("v"), F.explode(F.flatten(F.transform(images, inside))).alias(axis))
    return spread.groupBy("frame", "y", "x").agg((F.sum("v") / (2 * radius + 1)).alias(value))


def box_blur(pixels: DataFrame, height: int, width: int, radius: int, value: str = "v") -> DataFrame:
    """Mean over a square, in two passes. For rasters small enough to be rows; see kernels.blur for packed frames."""
    return _axis_blur(_axis_blur(pixels, "x", width, radius, value), "y", height, radius, value)


def gradient_energy(pixels: DataFrame, height: int, width: int, value: str = "v", into: str = "energy") -> DataFrame:
    """Length of the central differences. At a border the mirrored neighbours are equal, so the difference is 0."""
    row, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    gx = 0.5 * (F.lead(value).over(row) - F.lag(value).over(row))
    gy = 0.5 * (F.lead(value).over(column) - F.lag(value).over(column))
    inside = lambda g: F.coalesce(g, F.lit(0.0))
    return pixels.withColumn(into, F.sqrt(F.pow(inside(gx), 2) + F.pow(inside(gy), 2)))


def shift(pixels: DataFrame, dy: int, dx: int, height: int, width: int) -> DataFrame:
    """Pixels moved; those that leave the frame are lost and those that appear are unknown."""
    moved = pixels.withColumn("y", F.col("y") + dy).withColumn("x", F.col("x") + dx)
    return moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def fuse(pixels: DataFrame, gain: float = 1.0, floor: float = values.FLOOR, ceiling: float = values.CEILING, least_support: float = 0.5) -> DataFrame:
    """Machine channels of aligned pixels.

    Needs per pixel: visible (luminance), thermal (normalized), visible_detail, thermal_detail, contrast, support
    (registration), valid, eligible (the frame's synchronization gate). An ineligible frame keeps its visible
    signal; its thermal and support channels are 0.
    """
    night = clip((0.48 - F.avg("visible").over(frame())) / 0.38)
    saliency = clip(values.DETAIL * F.col("thermal_detail") + values.CONTRAST * F.col("contrast"))
    exposure = clip(1.0 - values.EXPOSURE_FALL * F.abs(F.col("visible") - 0.5), values.EXPOSURE_LEAST, 1.0)
    trusted = F.when(F.col("support") >= least_support, F.col("support")).otherwise(0.0) * F.col("valid").cast("double")
    named = pixels.withColumns({"night": night, "saliency": saliency, "trusted": trusted})
    weight = clip(gain * (floor + values.DARKNESS * F.col("night") + values.SALIENCY * F.col("saliency")), 0.0, ceiling) * F.col("trusted")
    reliable = F.greatest(clip(values.EXPOSED * exposure + values.DETAILED * F.col("visible_detail")), clip(values.SALIENT_START + values.SALIENT_GAIN * F.col("saliency")))
    gated = lambda x: F.when(F.col("eligible"), x).otherwise(0.0)
    tone = clip((F.col("visible") - 0.5) * values.TONE + 0.5)
    rows = named.withColumns({"thermal_contribution": gated(weight), "fusion_support": gated(clip(reliable * F.col("trusted")))})
    fused = (1 - F.col("thermal_contribution")) * tone + F.col("thermal_contribution") * F.col("thermal")
    return rows.withColumn("fused", F.when(F.col("eligible"), fused).otherwise(F.col("visible")))


def statistics(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Mean and exact 5th, 50th and 95th percentile of each channel of each frame."""
    long = pixels.select("frame", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels))).alias("c"))
    found = long.groupBy("frame", "c.channel").agg(F.avg("c.v").alias("mean"), *(F.percentile("c.v", F.lit(p / 100)).alias(f"p{p:02d}") for p in (5, 50, 95)))
    return found
