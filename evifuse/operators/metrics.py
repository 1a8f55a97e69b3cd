"""Evaluation metrics as aggregates and windows: calibration, selective risk, detection, segmentation, resampling.

Lower scores are kept first, except where confidence is named. Rows of equal score enter together. A metric over
nothing is null. Each global curve is first reduced to one row for each distinct score by a partial aggregate;
only those rows are ordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evifuse.functions.ranges import cut, numbered, parts, range_of
from evifuse.sources.scratch import written

Keys = list[str]


def brier(score: Column, truth: Column) -> Column:
    return F.avg(F.pow(score - truth, 2))


def bin_of(score: Column, n: int) -> Column:
    """Index of the equal-width bin by its bounds, the last one closed."""
    out = F.lit(n - 1)
    for i in range(n - 1, 0, -1):
        out = F.when(score < i / n, i - 1).otherwise(out)
    return out


def reliability(rows: DataFrame, keys: Keys, n: int = 15) -> DataFrame:
    """Per bin: size, mean score, mean truth."""
    binned = rows.withColumn("bin", bin_of(F.col("score"), n))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("truth").alias("mean_truth"))


def calibration_error(bins: DataFrame, keys: Keys) -> DataFrame:
    """Expected calibration error: the bins' gaps weighted by their sizes."""
    gap = F.col("n") * F.abs(F.col("mean_score") - F.col("mean_truth"))
    return bins.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def blocks(rows: DataFrame, keys: Keys, score: str = "score", risk: str = "risk", count: str | None = None) -> DataFrame:
    """One row for each distinct score: block size and risk, and both summed up to and with it. Where rows stand for several, ``count`` has their number.

    Scores are summed within ranges first, then the ranges' sums are added, so no task orders all scores. Keys are
    not null.
    """
    size = F.sum(count) if count else F.count(F.lit(1))
    grouped = rows.groupBy(*keys, F.col(score).alias("score")).agg(size.alias("n"), F.sum(F.col(risk).cast("double")).alias("risk"))
    bounds = cut(grouped, "score", int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = grouped.withColumn("part", range_of(bounds, F.col("score")))
    within = Window.partitionBy(*keys, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    before, whole = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    sums = parted.groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.sum("risk").alias("risk"))  # a row for each key and range
    sooner = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = sums.select(*keys, "part", sooner("n").alias("n0"), sooner("risk").alias("risk0"), F.sum("n").over(whole).alias("total"))
    running = parted.select(*keys, "part", "score", "n", "risk", F.sum("n").over(within).alias("kept"), F.sum("risk").over(within).alias("lost"))
    joined = running.join(starts, [*keys, "part"])
    return joined.select(*keys, "score", "n", "risk", (F.col("kept") + F.col("n0")).alias("kept"), (F.col("lost") + F.col("risk0")).alias("lost"), "total")


def aurc(curve: DataFrame, keys: Keys) -> DataFrame:
    """Area under risk and coverage: each block's conditional risk weighted by its coverage."""
    return curve.groupBy(*keys).agg(F.sum(F.col("n") / F.col("total") * F.col("lost") / F.col("kept")).alias("aurc"))


def augrc(curve: DataFrame, keys: Keys) -> DataFrame:
    """Trapezoids under generalized risk and coverage, from the origin."""
    lost, total = F.col("lost"), F.col("total")  # a block's sums less its own are those before it
    area = curve.select(*keys, (F.col("n") / total * (lost + lost - F.col("risk")) / total / 2).alias("area"))
    return area.groupBy(*keys).agg(F.sum("area").alias("augrc"))


def working_point(curve: DataFrame, keys: Keys, coverage: float) -> DataFrame:
    """The first complete block that reaches the coverage."""
    reached = curve.where(F.col("kept") / F.col("total") >= coverage)
    found = reached.groupBy(*keys).agg(F.min_by(F.struct("score", "kept", "lost", "total"), "kept").alias("p"))
    return found.select(*keys, F.col("p.score").alias("threshold"), (F.col("p.kept") / F.col("p.total")).alias("coverage"), (F.col("p.lost") / F.col("p.kept")).alias("risk"))


def auroc(curve: DataFrame, keys: Keys) -> DataFrame:
    """Mann-Whitney statistic with averaged ranks of ties; null if one class is absent."""
    rank = F.col("kept") - (F.col("n") - 1) / 2
    sums = curve.groupBy(*keys).agg(F.sum(F.col("risk") * rank).alias("ranks"), F.sum("risk").alias("p"), F.sum(F.col("n") - F.col("risk")).alias("q"))
    area = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), area).alias("auroc"))


def precision_curve(rows: DataFrame, keys: Keys) -> DataFrame:
    """Ranked hits (confidence first, then id) with running precision, recall and misses. rows: confidence, id, hit.

    Rows are dealt by ranges of (keys, falling confidence, id) of a bounded size; a sorted range is passed once, holding the last sums alone.
    """
    running = _by_confidence(rows.select(*keys, "confidence", "id", "hit"), keys)
    sums = running.groupBy(*keys, "part").agg(F.sum("hit").alias("tp"), F.count(F.lit(1)).alias("n"))  # a row for each key and range
    before, whole = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    starts = written(sums.select(*keys, "part", F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("tp0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.sum("tp").over(whole).alias("positives")), "confidence-starts")
    joined = running.join(starts, [*keys, "part"])
    ranked = joined.select(*keys, "confidence", "id", "hit", "part", (F.col("tp") + F.col("tp0")).alias("tp"), (F.col("rank") + F.col("n0")).alias("rank"), "positives")
    return ranked.withColumn("precision", F.col("tp") / F.col("rank")).withColumn("recall", F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")))


def _by_confidence(rows: DataFrame, keys: Keys) -> DataFrame:
    """Adds part: ranges of (keys, falling confidence, id), so that rows of one confidence may lie in several; and tp, rank within key and part."""
    rows = written(rows, "detections")
    order = [*keys, F.desc("confidence"), "id"]
    parted = rows.repartitionByRange(parts(rows), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tp, n = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            hit, at = batch.column("hit").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), np.arange(len(batch))
            fresh = np.zeros(len(batch), bool)
            for c in keys:
                codes = batch.column(c).dictionary_encode("encode").indices.to_numpy()
                fresh[1:] |= codes[1:] != codes[:-1]
            ends = [repr([batch.column(c)[i].as_py() for c in keys]) for i in (0, len(batch) - 1)]
            fresh[0], last = ends[0] != last, ends[1]
            start, sums = np.maximum.accumulate(np.where(fresh, at, -1)), np.cumsum(hit)
            own = start >= 0  # of a key that begins in this batch
            so_far = sums + np.where(own, hit[start] - sums[start], tp)
            rank = at + 1 + np.where(own, -start, n)
            tp, n = int(so_far[-1]), int(rank[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(so_far), pa.array(rank)], [*batch.schema.names, "tp", "rank"])

    return written(parted.mapInArrow(summed, StructType([*parted.schema.fields, StructField("tp", LongType()), StructField("rank", LongType())])), "by-confidence")


def average_precision(curve: DataFrame, keys: Keys) -> DataFrame:
    """Step integral of the precision envelope: the best precision at this recall or beyond, which a hit has. Of a key without hits the first row stays."""
    hits = curve.where("hit <> 0 OR rank = 1").select(*keys, "part", "rank", "hit", "precision", "positives")
    within = Window.partitionBy(*keys, "part").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    tops = written(hits.groupBy(*keys, "part").agg(F.max("precision").alias("top")), "precision-tops")
    ahead = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    later = written(tops.select(*keys, "part", F.max("top").over(ahead).alias("later")), "precision-later")
    dealt = hits.repartition(max(1, tops.count()), *keys, "part")  # as many tasks as parts
    enveloped = dealt.withColumn("best", F.max("precision").over(within)).join(later, [*keys, "part"])
    best = F.greatest("best", "later")
    return enveloped.groupBy(*keys).agg(F.when(F.max("positives") > 0, F.sum(best * F.col("hit")) / F.max("positives")).alias("ap"))


def log_average_miss_rate(curve: DataFrame, keys: Keys, images: int) -> DataFrame:
    """Geometric mean of the least miss rate within nine log-spaced false-positive rates per image, floored at 1e-10."""
    miss, fppi = 1 - F.col("recall"), (F.col("rank") - F.col("tp")) / images
    least = [F.log(F.greatest(F.coalesce(F.min(F.when(fppi <= 10 ** (-2 + i / 4), miss)), F.lit(1.0)), F.lit(1e-10))) for i in range(9)]
    return curve.groupBy(*keys).agg(F.exp(reduce(lambda a, b: a + b, least) / 9).alias("lamr"))


def confusion(rows: DataFrame, classes: list[int], ignore: list[int], keys: Keys) -> DataFrame:
    """Per class: tp, truth, predicted. Pixels whose truth is ignored count nowhere."""
    seen = rows.where(~F.col("truth").isin(ignore))
    cells = seen.groupBy(*keys, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    named = cells.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    is_truth, is_predicted = F.col("truth") == F.col("class"), F.col("predicted") == F.col("class")
    return named.groupBy(*keys, "class").agg(of(is_truth & is_predicted).alias("tp"), of(is_truth).alias("truth"), of(is_predicted).alias("predicted"))


def iou(counts: DataFrame) -> DataFrame:
    """Intersection over union, null for classes that occur nowhere."""
    union = F.col("truth") + F.col("predicted") - F.col("tp")
    return counts.withColumn("iou", F.when(union > 0, F.col("tp") / union))


def draws(groups: DataFrame, replicates: int, seed: str) -> DataFrame:
    """Hashed resampling of whole groups: (rep, grp, times). Each replicate draws as many groups as there are.

    Groups are numbered by name; draw i of replicate r takes the group whose number the hash of (seed, r, i) names.
    """
    spark = groups.sparkSession
    named = numbered(groups.select("grp").distinct(), "grp")
    n = named.count()
    slots = spark.range(replicates * n).select((F.col("id") / n).cast("long").alias("rep"), (F.col("id") % n).alias("draw"))
    digest = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "rep", "draw"), 256), 1, 8)
    drawn = slots.select("rep", (F.conv(digest, 16, 10).cast("long") % n).alias("number"))
    return drawn.join(named, "number").groupBy("rep", "grp").agg(F.count(F.lit(1)).alias("times"))


def resampled(groups: DataFrame, drawn: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Per replicate: the ratio of the drawn groups' sums. groups: grp and additive columns."""
    times = F.col("times")
    sums = drawn.join(groups, "grp").groupBy("rep").agg(F.sum(times * F.col(numerator)).alias("a"), F.sum(times * F.col(denominator)).alias("b"))
    return sums.select("rep", F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("value"))


def interval(values: DataFrame, level: float = 0.95) -> DataFrame:
    ends = [(1 - level) / 2, (1 + level) / 2]
    return values.agg(*(F.percentile("value", F.lit(p)).alias(name) for p, name in zip((ends[0], 0.5, ends[1]), ("low", "median", "high"))))


def smooth_l1(difference: Column) -> Column:
    """Quadratic near zero, linear beyond one."""
    return F.when(F.abs(difference) < 1, 0.5 * difference * difference).otherwise(F.abs(difference) - 0.5)
