"""Selective prediction over capture groups: every metric of a score against a risk, and resampling of whole groups.

The estimate is the mean over groups with equal weights, so a long capture counts no more than a short one. A group's
metrics come from sums over score ranges; a replicate only weighs the groups' numbers, no row of theirs is drawn again.
Scores and risks are clipped to [0, 1]; rows where either is null are left out. A metric that a group lacks (no positives or no negatives) is null,
and left out of the means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.operators import metrics
from evifuse.sources.scratch import written

#: The metrics' names.
NAMES = (
    "brier", "expected_calibration_error", "risk_coverage_area", "oracle_risk_coverage_area", "random_order_expected_risk_coverage_area", "excess_risk_coverage_area",
    "generalized_risk_coverage_area", "oracle_generalized_risk_coverage_area", "random_order_expected_generalized_risk_coverage_area", "excess_generalized_risk_coverage_area",
    "selective_risk_at_80_percent_requested_coverage", "realized_coverage_at_80_percent_requested_coverage", "uncertainty_auroc", "mean_target_risk", "mean_uncertainty",
)
COVERAGE, POSITIVE, BINS = 0.8, 0.5, 15


def clipped(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def group_metrics(rows: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """keys, samples and NAMES for (keys, score, risk). Keys are not null."""
    held = rows.select(*keys, clipped(F.col("score").cast("double")).alias("score"), clipped(F.col("risk").cast("double")).alias("risk")).where("score IS NOT NULL AND risk IS NOT NULL")
    # one row for each distinct pair of score and risk carries all there is
    pairs = written(held.groupBy(*keys, "score", "risk").agg(F.count(F.lit(1)).alias("n")), "selective-pairs")
    curve = written(weighted_blocks(pairs, keys, "score"), "selective-curve")
    ideal = weighted_blocks(pairs, keys, "risk")
    n, s, r = F.col("n"), F.col("score"), F.col("risk")
    means = pairs.groupBy(*keys).agg(F.sum(n).alias("samples"), (F.sum(n * F.pow(s - r, 2)) / F.sum(n)).alias("brier"),
        (F.sum(n * r) / F.sum(n)).alias("mean_target_risk"), (F.sum(n * s) / F.sum(n)).alias("mean_uncertainty"))
    binned = pairs.groupBy(*keys, metrics.bin_of(s, bins).alias("bin")).agg(F.sum(n).alias("n"), (F.sum(n * s) / F.sum(n)).alias("mean_score"), (F.sum(n * r) / F.sum(n)).alias("mean_truth"))
    at = metrics.working_point(curve, keys, COVERAGE).select(*keys, F.col("risk").alias(NAMES[10]), F.col("coverage").alias(NAMES[11]))
    is_hit = (r >= POSITIVE).cast("double")
    hits = weighted_blocks(pairs.withColumn("risk", is_hit), keys, "score")
    wide = [
        means,
        metrics.calibration_error(binned, keys).withColumnRenamed("ece", NAMES[1]),
        metrics.aurc(curve, keys).withColumnRenamed("aurc", NAMES[2]),
        metrics.aurc(ideal, keys).withColumnRenamed("aurc", NAMES[3]),
        metrics.augrc(curve, keys).withColumnRenamed("augrc", NAMES[6]),
        metrics.augrc(ideal, keys).withColumnRenamed("augrc", NAMES[7]),
        at,
        metrics.auroc(hits, keys).withColumnRenamed("auroc", NAMES[12]),
    ]
    joined = reduce(lambda a, b: a.join(b, keys, "left"), wide)
    whole = joined.withColumns({NAMES[4]: F.col("mean_target_risk"), NAMES[5]: F.col(NAMES[2]) - F.col(NAMES[3]), NAMES[8]: F.col("mean_target_risk") / 2, NAMES[9]: F.col(NAMES[6]) - F.col(NAMES[7])})
    return whole.select(*keys, "samples", *NAMES)


def weighted_blocks(pairs: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``metrics.blocks`` of (keys, score, risk, n) ranked by ``by``."""
    rows = pairs.select(*keys, F.col(by).alias("score"), (F.col("n") * F.col("risk")).alias("risk"), "n")
    return metrics.blocks(rows, keys, count="n")


def bootstrap(wide: DataFrame, keys: list[str], replicates: int, seed: str, names=NAMES, level: float = 0.95) -> DataFrame:
    """keys, metric, groups, point, low, high: intervals of the mean over drawn groups. wide: keys, grp and a column for each name.

    Replicates draw with replacement from all groups, as many as there are, the same ones for every key.
    """
    value = F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("double"))))).alias("metric", "value")
    long = written(wide.select(*keys, F.col("grp").cast("string").alias("grp"), value).where("value IS NOT NULL"), "selective-values")
    groups = written(wide.select("grp").distinct(), "selective-groups")
    drawn = metrics.draws(groups, replicates, seed)
    drawn = written(drawn.select("rep", F.col("grp").cast("string").alias("grp"), "times"), "selective-draws")
    sums = long.join(drawn, "grp").groupBy(*keys, "metric", "rep").agg((F.sum(F.col("times") * F.col("value")) / F.sum("times")).alias("value"))
    ends = sums.groupBy(*keys, "metric").agg(F.percentile("value", F.lit((1 - level) / 2)).alias("low"), F.percentile("value", F.lit((1 + level) / 2)).alias("high"))
    points = long.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("groups"), F.avg("value").alias("point"))
    return points.join(ends, [*keys, "metric"], "left").select(*keys, "metric", "groups", "point", "low", "high")
