"""Kernels over packed frames or small groups, vectorized in Arrow batches: what column expressions cannot say.

A packed frame is (frame, height, width, data): float32 rows, row after row. Frames are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.functions import raster as values
from evifuse.operators.detection import lists_of, taken


def mean_square(image: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square with mirrored borders, from running sums."""
    if radius <= 0:
        return image
    side, wide = 2 * radius + 1, np.pad(image.astype(np.float64), radius, mode="reflect")
    rows = np.zeros((wide.shape[0] + 1, wide.shape[1]))
    np.cumsum(wide, axis=0, out=rows[1:])
    tall = rows[side:] - rows[:-side]
    columns = np.zeros((tall.shape[0], tall.shape[1] + 1))
    np.cumsum(tall, axis=1, out=columns[:, 1:])
    return (columns[:, side:] - columns[:, :-side]) / side**2


def blur(frames: DataFrame, radius: int) -> DataFrame:
    @F.pandas_udf("binary")
    def packed(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([mean_square(np.frombuffer(d, "<f4").reshape(h, w), radius).astype("<f4").tobytes() for d, h, w in zip(data, height, width)])

    return frames.withColumn("data", packed("data", "height", "width"))


def edges(image: np.ndarray) -> np.ndarray:
    wide = np.pad(image.astype(np.float64), 1, mode="reflect")
    return np.hypot(0.5 * (wide[1:-1, 2:] - wide[1:-1, :-2]), 0.5 * (wide[2:, 1:-1] - wide[:-2, 1:-1]))


def phase_shift(reference: np.ndarray, moving: np.ndarray, reach: int, least_energy: float = 1e-4, least_confidence: float = 0.05) -> tuple[int, int, float]:
    """Shift that lays ``moving`` on ``reference`` and a confidence, from how far the peak stands out; 0 and no shift where either's mean edge is too weak."""
    a, b = edges(reference), edges(moving)
    if min(a.mean(), b.mean()) < least_energy:
        return 0, 0, 0.0
    window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    cross = np.fft.rfft2((a - a.mean()) * window) * np.conj(np.fft.rfft2((b - b.mean()) * window))
    peaks = np.abs(np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-8), a.shape))
    near = np.roll(peaks, (reach, reach), (0, 1))[: 2 * reach + 1, : 2 * reach + 1]
    dy, dx = np.unravel_index(int(near.argmax()), near.shape)
    ratio = near.max() / max(float(np.percentile(peaks, 99)), 1e-8)
    return int(dy) - reach, int(dx) - reach, float(np.clip((ratio - 1) / 4, least_confidence, 1))


def register(pairs: DataFrame, reach: int = 16) -> DataFrame:
    """dy, dx, confidence for pairs of packed frames (frame, height, width, reference, moving)."""

    @F.pandas_udf("dy int, dx int, confidence double")
    def shift(reference: pd.Series, moving: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        read = lambda d, h, w: np.frombuffer(d, "<f4").reshape(h, w)
        return pd.DataFrame([phase_shift(read(a, h, w), read(b, h, w), min(reach, (min(h, w) - 1) // 2)) for a, b, h, w in zip(reference, moving, height, width)], columns=["dy", "dx", "confidence"])

    return pairs.withColumn("s", shift("reference", "moving", "height", "width")).select("frame", "s.*")


def match(boxes: DataFrame, threshold: float) -> DataFrame:
    """Greedy matching per image: predictions by falling score, each to the best free truth at the threshold or above.

    boxes: image, id, is_truth, score, x, y, w, h. Truths are per image, so images are matched independently, a batch of them at a time.
    """
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in "xywh"))
    falling = F.coalesce(-F.col("score"), F.lit(float("nan"))).alias("falling")
    images = boxes.groupBy("image").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_truth"), F.struct("id", box.alias("box"))))).alias("held"),
        F.array_sort(F.collect_list(F.when(~F.col("is_truth"), F.struct(falling, "id", F.col("score").cast("double").alias("score"), box.alias("box"))))).alias("found"),
    )
    rows = images.select("image", "held", "found", F.transform("held", lambda s: s["box"]).alias("truth"), F.transform("found", lambda s: s["box"]).alias("boxes"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = taken(lists_of(batch.column("boxes")), lists_of(batch.column("truth")), (threshold,))[:, 0]
            found, held = batch.column("found"), batch.column("held").flatten()
            own, flat = pa.array(np.repeat(np.arange(len(batch)), found.value_lengths().to_numpy(zero_copy_only=False))), found.flatten()
            truth = held.field("id").take(pa.array(np.where(place < 0, 0, place), mask=place < 0))
            yield pa.RecordBatch.from_arrays([batch.column("image").take(own), flat.field("id"), flat.field("score"), pa.array((place >= 0).astype(np.int32)), truth],
                ["image", "id", "score", "hit", "truth"])

    return rows.mapInArrow(task, "image long, id long, score double, hit int, truth long")


def sample_grid(grid: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Bilinear values; unknown where a needed neighbour is unknown or outside."""
    r, c = (np.where(np.isfinite(v), np.floor(v), -2).astype(int) for v in (row, col))
    fr, fc = row - r, col - c
    total = np.zeros(len(row))
    for i in (0, 1):
        for j in (0, 1):
            weight = (fr if i else 1 - fr) * (fc if j else 1 - fc)
            inside = (r + i >= 0) & (r + i < grid.shape[0]) & (c + j >= 0) & (c + j < grid.shape[1])
            value = np.where(inside, grid[np.clip(r + i, 0, grid.shape[0] - 1), np.clip(c + j, 0, grid.shape[1] - 1)], np.nan)
            total = np.where(weight > 0, total + weight * value, total)
    return total


def march(grid: np.ndarray, origin: np.ndarray, rays: np.ndarray, most: float, step: float, rounds: int = 40) -> np.ndarray:
    """First range at which each unit ray meets the height field; unknown terrain on the way hides what lies behind."""
    above = lambda t: origin[2] + t * rays[:, 2] - sample_grid(grid, origin[1] + t * rays[:, 1], origin[0] + t * rays[:, 0])
    low, high = np.full(len(rays), np.nan), np.full(len(rays), np.nan)
    open_, before = np.ones(len(rays), bool), np.zeros(len(rays))
    for t in np.arange(step, most + step / 2, step):
        gap = above(np.full(len(rays), t))
        hit = open_ & (gap <= 0)
        low[hit], high[hit] = before[hit], t
        open_ &= ~hit & ~np.isnan(gap)
        before[:] = t
    for _ in range(rounds):
        mid = (low + high) / 2
        under = above(mid) <= 0
        high, low = np.where(under, mid, high), np.where(under, low, mid)
    return (low + high) / 2


def terrain_hits(rays: DataFrame, grid: np.ndarray, most: float, step: float) -> DataFrame:
    """reach, east, north, up of rays (ray, ox, oy, oz, dx, dy, dz) in cell units; null where nothing is met.

    The height field is broadcast: it is one tile of a mission's map and must fit into a worker.
    """
    held = rays.sparkSession.sparkContext.broadcast(np.asarray(grid, float))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for _, group in b.groupby(["ox", "oy", "oz"], sort=False):
                origin = group[["ox", "oy", "oz"]].to_numpy()[0]
                unit = group[["dx", "dy", "dz"]].to_numpy()
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                reach = march(held.value, origin, unit, most, step)
                out.append(pd.DataFrame({"ray": group.ray.to_numpy(), "reach": reach, **{n: origin[i] + reach * unit[:, i] for i, n in enumerate(("east", "north", "up"))}}))
            yield pd.concat(out).replace({np.nan: None}) if out else pd.DataFrame({c: [] for c in ("ray", "reach", "east", "north", "up")})

    return rays.mapInPandas(task, "ray long, reach double, east double, north double, up double")


def colored(image: np.ndarray, stops) -> np.ndarray:
    """Palette colors of [0, 1] values, halves to even; unknown is black."""
    at = np.array([s[0] for s in stops])
    out = np.stack([np.interp(image, at, [s[i] for s in stops]) for i in (1, 2, 3)], axis=-1)
    return np.rint(np.where(np.isnan(image)[..., None], 0, out)).astype(np.uint8)


def palette(frames: DataFrame, stops) -> DataFrame:
    """frame and its packed RGB bytes; the long form is functions.raster.palette."""

    @F.pandas_udf("binary")
    def packed(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([colored(np.frombuffer(d, "<f4").reshape(h, w), stops).tobytes() for d, h, w in zip(data, height, width)])

    return frames.select("frame", packed("data", "height", "width").alias("rgb"))


def by_p99(image: np.ndarray) -> np.ndarray:
    return np.clip(image / max(float(np.percentile(image, 99)), 1e-7), 0, 1)


def fused(visible: np.ndarray, thermal: np.ndarray, support: float, gain: float = 1.0, floor: float = values.FLOOR, ceiling: float = values.CEILING) -> dict[str, np.ndarray]:
    """Machine channels of an aligned pair: normalization, details, contrast, and the expressions of raster.fuse."""
    low, high = np.percentile(thermal, (1, 99))
    heat = np.clip((thermal - low) / (high - low), 0, 1) if high > low + 1e-8 else np.zeros_like(thermal)
    detail, heat_detail = by_p99(edges(visible)), by_p99(edges(heat))
    saliency = np.clip(values.DETAIL * heat_detail + values.CONTRAST * by_p99(np.abs(heat - mean_square(heat, 3))), 0, 1)
    night = np.clip((0.48 - visible.mean()) / 0.38, 0, 1)
    weight = np.clip(gain * (floor + values.DARKNESS * night + values.SALIENCY * saliency), 0, ceiling) * support
    exposure = np.clip(1 - values.EXPOSURE_FALL * np.abs(visible - 0.5), values.EXPOSURE_LEAST, 1)
    reliable = np.maximum(np.clip(values.EXPOSED * exposure + values.DETAILED * detail, 0, 1), np.clip(values.SALIENT_START + values.SALIENT_GAIN * saliency, 0, 1))
    tone = np.clip((visible - 0.5) * values.TONE + 0.5, 0, 1)
    return {"saliency": saliency, "thermal_contribution": weight, "fusion_support": np.clip(reliable * support, 0, 1), "fused": (1 - weight) * tone + weight * heat}


def fuse(pairs: DataFrame, channels: tuple[str, ...] = ("saliency", "thermal_contribution", "fusion_support", "fused")) -> DataFrame:
    """Packed channels of pairs (frame, height, width, visible, thermal, support); a support under one half counts as none."""
    schema = ", ".join(f"{c} binary" for c in channels)

    @F.pandas_udf(schema)
    def packed(visible: pd.Series, thermal: pd.Series, height: pd.Series, width: pd.Series, support: pd.Series) -> pd.DataFrame:
        rows = []
        for v, t, h, w, s in zip(visible, thermal, height, width, support):
            found = fused(np.frombuffer(v, "<f4").reshape(h, w), np.frombuffer(t, "<f4").reshape(h, w), s if s >= 0.5 else 0.0)
            rows.append([found[c].astype("<f4").tobytes() for c in channels])
        return pd.DataFrame(rows, columns=list(channels))

    return pairs.select("frame", packed("visible", "thermal", "height", "width", "support").alias("c")).select("frame", "c.*")


def hull(points: np.ndarray) -> np.ndarray:
    """Rows of the points (x, y) on the convex hull."""
    order = np.lexsort((points[:, 1], points[:, 0]))

    def chain(indexes) -> list[int]:
        kept: list[int] = []
        for i in indexes:
            while len(kept) > 1:
                a, b, c = points[kept[-2]], points[kept[-1]], points[i]
                if (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0:
                    break
                kept.pop()
            kept.append(i)
        return kept

    return np.unique(chain(order) + chain(order[::-1])) if len(points) else np.empty(0, int)


def outermost(points: DataFrame) -> DataFrame:
    """The points (id, x, y) on the convex hull: each task's own hull first, so the last task gets few points."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"id": [], "x": [], "y": []})
        for b in batches:
            both = pd.concat([held, b], ignore_index=True) if len(held) else b
            held = both.iloc[hull(both[["x", "y"]].to_numpy())]
        yield held.astype({"id": "int64"})

    schema = "id long, x double, y double"
    return points.select("id", "x", "y").mapInPandas(task, schema).repartition(1).mapInPandas(task, schema)
