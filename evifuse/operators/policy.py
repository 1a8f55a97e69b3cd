"""Fusion policy: scene features, a linear model behind a hard evidence gate, scene digests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    presets: tuple[str, ...]
    bias: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    gain_bias: float
    gain_weights: tuple[float, ...]
    gain_limits: tuple[float, float] = (0.0, 1.5)
    least_support: float = 0.5
    least_valid: float = 0.5


def linear(bias: float, weights: tuple[float, ...], features: tuple[str, ...]) -> Column:
    out = F.lit(bias)
    for w, name in zip(weights, features):
        out = out + w * F.col(name)
    return out


def recommend(frames: DataFrame, model: Model) -> DataFrame:
    """Preset, gain, confidence, status and reasons. Needs the features, support, valid_fraction and applied.

    A frame that fails a gate gets the integrity view with gain 0, confidence 1 and every reason. Else the preset
    of the highest softmax score, the first on ties; support limits the gain.
    """
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("applied"), "pixel_fusion_unavailable"),
            F.when(F.col("support") < model.least_support, "registration_below_minimum"),
            F.when(F.col("valid_fraction") < model.least_valid, "coverage_below_minimum"),
        )
    )
    logits = F.array(*(linear(b, w, model.features) for b, w in zip(model.bias, model.weights)))
    envelope = F.least(F.lit(1.0), F.col("support") / model.least_support, F.col("valid_fraction") / model.least_valid)
    low, high = model.gain_limits
    rows = frames.withColumns({"reasons": reasons, "logits": logits, "raw_gain": linear(model.gain_bias, model.gain_weights, model.features), "envelope": envelope})
    top = F.array_max("logits")
    rows = rows.withColumn("exps", F.transform("logits", lambda x: F.exp(x - F.array_max("logits"))))
    total = F.aggregate("exps", F.lit(0.0), lambda a, x: a + x)
    index = F.array_position("logits", top).cast("int")
    failed = F.size("reasons") > 0
    gain = F.least(F.greatest(F.col("raw_gain"), F.lit(low)), high * F.col("envelope"))
    return rows.select(
        "frame",
        F.when(failed, "integrity").otherwise(F.element_at(F.array(*map(F.lit, model.presets)), index)).alias("preset"),
        F.when(failed, 0.0).otherwise(F.round(gain, 4)).alias("gain"),
        F.when(failed, 1.0).otherwise(1.0 / total).alias("confidence"),
        F.when(failed, "safety_override").otherwise("recommended").alias("status"),
        F.array_join("reasons", ",").alias("reasons"),
    )


def digest(statistics: DataFrame, digits: int = 6) -> DataFrame:
    """One JSON text for each frame: its channels in order with their statistics."""
    entry = F.struct("channel", *(F.round(c, digits).alias(c) for c in ("mean", "p05", "p50", "p95")))
    return statistics.groupBy("frame").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("digest"))
