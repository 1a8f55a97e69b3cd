"""Calibration, selective risk, detection, segmentation and resampling queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evifuse.functions.ranges import parts
from evifuse.operators import metrics
from evifuse.sources.tables import PIXELS, SCORED, pixels, read, scored

BLOCKS = f"""WITH {SCORED}, g AS (SELECT score, count(*) AS n, CAST(sum(risk) AS DOUBLE) AS risk FROM scored GROUP BY score),
b AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS kept, sum(risk) OVER w AS lost, CAST(sum(n) OVER () AS DOUBLE) AS total FROM g WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING))
"""


def rounded(df, *names, digits: int = 6):
    """Named columns rounded; a negative zero becomes zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns))


def _curve(spark, sf_dir):
    return metrics.blocks(scored(spark, sf_dir), [])


def aurc_ties(spark, sf_dir):
    return rounded(metrics.aurc(_curve(spark, sf_dir), []), "aurc")


def augrc_trapezoid(spark, sf_dir):
    return rounded(metrics.augrc(_curve(spark, sf_dir), []), "augrc")


def working_point_80(spark, sf_dir):
    return rounded(metrics.working_point(_curve(spark, sf_dir), [], 0.8), "threshold", "coverage", "risk")


def auroc_midrank(spark, sf_dir):
    return rounded(metrics.auroc(_curve(spark, sf_dir), []), "auroc")


def oracle_risk(spark, sf_dir):
    """Areas of the given, the ideal (ranked by the risk itself) and the random ranking (the mean risk), and the excess."""
    rows = scored(spark, sf_dir)
    given = metrics.aurc(metrics.blocks(rows, []), []).select(F.col("aurc").alias("given"))
    best = metrics.aurc(metrics.blocks(rows.withColumn("score", F.col("risk").cast("double")), []), []).select(F.col("aurc").alias("ideal"))
    mean = rows.agg(F.avg("risk").alias("random"))
    one = lambda df, key: df.withColumn("k", F.lit(key))
    wide = one(given, 1).join(one(best, 1), "k").join(one(mean, 1), "k")
    return rounded(wide.select("given", "ideal", "random", (F.col("given") - F.col("ideal")).alias("excess")), "given", "ideal", "random", "excess")


def brier_ece(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.lit(1).alias("k"), "score", F.col("risk").alias("truth"))
    error = metrics.calibration_error(metrics.reliability(rows, ["k"]), ["k"])
    both = rows.groupBy("k").agg(metrics.brier(F.col("score"), F.col("truth")).alias("brier"), F.count(F.lit(1)).alias("n")).join(error, "k").drop("k")
    return rounded(both, "brier", "ece")


def reliability_curve(spark, sf_dir):
    rows = scored(spark, sf_dir).select("score", F.col("risk").alias("truth"))
    return rounded(metrics.reliability(rows, []), "mean_score", "mean_truth")


def diagnostic_curve(spark, sf_dir):
    """Risk at twenty coverages: the first complete block that reaches each."""
    curve = _curve(spark, sf_dir).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(20))))
    found = curve.where(F.col("kept") * 20 >= F.col("step") * F.col("total")).groupBy("step").agg(F.min_by(F.struct("kept", "lost", "total"), "kept").alias("p"))
    return rounded(found.select("step", (F.col("p.kept") / F.col("p.total")).alias("coverage"), (F.col("p.lost") / F.col("p.kept")).alias("risk")), "coverage", "risk")


BIN = "CASE " + " ".join(f"WHEN score < {i / 15!r} THEN {i - 1}" for i in range(1, 15)) + " ELSE 14 END"
RELIABLE = f"""WITH {SCORED}, r AS (SELECT {BIN} AS bin, count(*) AS n, avg(score) AS mean_score, CAST(avg(risk) AS DOUBLE) AS mean_truth FROM scored GROUP BY 1)
"""


DETECTIONS = """d AS (
  SELECT DISTINCT ON (cls, confidence, id) cls, confidence, id, hit FROM (
    SELECT l_returnflag AS cls, l_quantity / 50e0 AS confidence, l_orderkey * 10 + l_linenumber AS id,
      CASE WHEN (l_partkey + CAST(l_quantity AS BIGINT)) % 50 < l_quantity THEN 1 ELSE 0 END AS hit FROM lineitem)
  ORDER BY cls, confidence, id, hit),
c AS (SELECT *, sum(hit) OVER w AS tp, row_number() OVER w AS rank, sum(hit) OVER (PARTITION BY cls) AS positives FROM d
  WINDOW w AS (PARTITION BY cls ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING))
"""


def _detected(spark, sf_dir):
    """The lower hit stands for repeated ids."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("cls"),
        (F.col("l_quantity") / F.lit(50.0)).alias("confidence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when((F.col("l_partkey") + F.col("l_quantity").cast("long")) % 50 < F.col("l_quantity"), 1).otherwise(0).alias("hit"),
    )
    key = ["cls", "confidence", "id"]
    return rows.repartition(parts(read(spark, sf_dir, "lineitem")), *key).groupBy(*key).agg(F.min("hit").alias("hit"))


def _ranked(spark, sf_dir):
    return metrics.precision_curve(_detected(spark, sf_dir), ["cls"])


def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(_ranked(spark, sf_dir), ["cls"]), "ap")


def log_avg_miss_rate(spark, sf_dir):
    return rounded(metrics.log_average_miss_rate(_ranked(spark, sf_dir), ["cls"], 10_000), "lamr")


def top_detections(spark, sf_dir):
    """The first hundred detections of each class above the score floor; the limit is the feature."""
    rows = _detected(spark, sf_dir).where("confidence > 0.001").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "id"))
    few = rows.withColumn("place", place("cls", "salt")).where("place <= 100")  # sixteen hundred of each class at most
    return few.withColumn("place", place("cls")).where("place <= 100").select("cls", "id", "place")


def _masks(spark, sf_dir):
    """Rasters as truth and prediction masks of four classes, class 3 ignored; class 9 never occurs."""
    rows = pixels(spark, sf_dir).select("frame", "y", "x", F.floor(F.col("v") * 8).cast("int").alias("q"))
    return rows.select("frame", (F.col("q") % 4).alias("truth"), F.when((F.col("x") + F.col("y")) % 5 == 0,
        (F.col("q") + 1) % 4).otherwise(F.col("q") % 4).alias("predicted"), (F.col("frame") % 20).alias("grp"))


MASKS = f"""{PIXELS}, q AS (SELECT frame, y, x, CAST(floor(v * 8) AS INTEGER) AS q FROM px),
m AS (SELECT frame, q % 4 AS truth, CASE WHEN (x + y) % 5 = 0 THEN (q + 1) % 4 ELSE q % 4 END AS predicted, frame % 20 AS grp FROM q),
k AS (SELECT class, count(*) FILTER (truth = class AND predicted = class) AS tp, count(*) FILTER (truth = class) AS truth, count(*) FILTER (predicted = class) AS predicted
  FROM m, (SELECT unnest([0, 1, 2, 9]) AS class) WHERE m.truth <> 3 GROUP BY class)
"""


def iou_confusion(spark, sf_dir):
    counts = metrics.confusion(_masks(spark, sf_dir), [0, 1, 2, 9], [3], [])
    return rounded(metrics.iou(counts), "iou")


def iou_summary(spark, sf_dir):
    """Mean over the classes that occur, and pixel accuracy."""
    held = metrics.iou(metrics.confusion(_masks(spark, sf_dir), [0, 1, 2, 9], [3], []))
    return rounded(held.agg(F.avg("iou").alias("mean_iou"), (F.sum("tp") / F.sum("truth")).alias("accuracy")), "mean_iou", "accuracy")


def class_weights(spark, sf_dir):
    """Inverse square-root frequencies, normalized to mean one over the classes present."""
    counts = _masks(spark, sf_dir).groupBy("truth").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    raw = counts.withColumn("raw", F.sqrt(F.sum("n").over(every) / F.col("n")))
    return rounded(raw.select("truth", "n", (F.col("raw") / F.avg("raw").over(every)).alias("weight")), "weight")


def _groups(spark, sf_dir):
    rows = _masks(spark, sf_dir).where("truth <> 3")
    baseline = F.col("truth") == (F.col("frame") % 3)
    return rows.groupBy("grp").agg(
        F.sum((F.col("truth") == F.col("predicted")).cast("long")).alias("right"), F.sum(baseline.cast("long")).alias("base"), F.count(F.lit(1)).alias("n")
    )


DRAWN = f"""WITH {MASKS}, g AS (SELECT grp, count(*) FILTER (truth = predicted) AS right_, count(*) FILTER (truth = frame % 3) AS base, count(*) AS n FROM m WHERE truth <> 3 GROUP BY grp),
num AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS number, count(*) OVER () AS size FROM g),
s AS (SELECT rep, draw, CAST('0x' || substr(sha256('evifuse:' || rep || ':' || draw), 1, 8) AS BIGINT) AS h FROM range(200) r(rep), range((SELECT count(*) FROM g)) d(draw)),
v AS (SELECT rep, sum(right_) / sum(n) AS value, sum(base) / sum(n) AS base FROM s JOIN num ON s.h % num.size = num.number GROUP BY rep)
"""


def bootstrap_hashdraw(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    values = metrics.resampled(groups, metrics.draws(groups, 200, "evifuse"), "right", "n")
    return rounded(metrics.interval(values), "low", "median", "high")


def paired_delta(spark, sf_dir):
    """Candidate less baseline over the same draws, its interval and how often it is positive."""
    groups = _groups(spark, sf_dir)
    drawn = metrics.draws(groups, 200, "evifuse")
    ours = metrics.resampled(groups, drawn, "right", "n")
    theirs = metrics.resampled(groups, drawn, "base", "n").withColumnRenamed("value", "base")
    delta = ours.join(theirs, "rep").select((F.col("value") - F.col("base")).alias("value"))
    return rounded(delta.agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"),
        F.avg((F.col("value") > 0).cast("double")).alias("better")), "low", "high", "better")


def latency_summary(spark, sf_dir):
    """Latencies (event values) per stream: mean, population deviation, exact quantiles, missing ones."""
    rows = read(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("ms"))
    quantiles = [F.percentile("ms", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.95, 0.99)]
    found = rows.groupBy("event_type").agg(F.count("ms").alias("n"), F.sum(F.col("ms").isNull().cast("long")).alias("missing"), F.avg("ms").alias("mean"),
        F.stddev_pop("ms").alias("std"), F.min("ms").alias("low"), F.max("ms").alias("high"), *quantiles)
    return rounded(found, "mean", "std", "p50", "p90", "p95", "p99")


def throughput_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("ms"))
    return rounded(rows.select("event_type", "n", (F.col("n") / F.col("ms") * 1000).alias("per_second")), "per_second")


R6 = lambda x, name: f"round({x}, 6) AS {name}"
AURC = "sum(n / total * lost / kept)"
QUERIES = {
    "aurc_ties": (aurc_ties, BLOCKS + f"SELECT {R6(AURC, 'aurc')} FROM b"),
    "augrc_trapezoid": (
        augrc_trapezoid,
        BLOCKS + ", l AS (SELECT kept / total AS c, lost / total AS r, coalesce(lag(kept / total) OVER (ORDER BY score), 0) AS c0, coalesce(lag(lost / total) OVER (ORDER BY score), 0) AS r0 FROM b) SELECT round(sum((c - c0) * (r + r0) / 2), 6) AS augrc FROM l",
    ),
    "working_point_80": (working_point_80, BLOCKS + "SELECT round(arg_min(score, kept), 6) AS threshold, round(arg_min(kept / total, kept), 6) AS coverage, round(arg_min(lost / kept, kept), 6) AS risk FROM b WHERE kept / total >= 0.8"),
    "auroc_midrank": (
        auroc_midrank,
        f"WITH {SCORED}, r AS (SELECT risk, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rk FROM scored), s AS (SELECT sum(rk) FILTER (risk = 1) AS ranks, CAST(sum(risk) AS DOUBLE) AS p, CAST(count(*) - sum(risk) AS DOUBLE) AS q FROM r) SELECT CASE WHEN p > 0 AND q > 0 THEN round((ranks - p * (p + 1) / 2) / (p * q), 6) END AS auroc FROM s",
    ),
    "oracle_risk": (
        oracle_risk,
        BLOCKS + f""", g2 AS (SELECT CAST(risk AS DOUBLE) AS score, count(*) AS n, CAST(sum(risk) AS DOUBLE) AS risk FROM scored GROUP BY 1),
b2 AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS kept, sum(risk) OVER w AS lost, CAST(sum(n) OVER () AS DOUBLE) AS total FROM g2 WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
x AS (SELECT (SELECT {AURC} FROM b) AS given, (SELECT {AURC} FROM b2) AS ideal, (SELECT CAST(avg(risk) AS DOUBLE) FROM scored) AS random)
SELECT round(given, 6) AS given, round(ideal, 6) AS ideal, round(random, 6) AS random, round(given - ideal, 6) AS excess FROM x""",
    ),
    "brier_ece": (
        brier_ece,
        RELIABLE + "SELECT (SELECT round(avg(pow(score - risk, 2)), 6) FROM scored) AS brier, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(mean_score - mean_truth)) / sum(n), 6) AS ece FROM r",
    ),
    "reliability_curve": (reliability_curve, RELIABLE + "SELECT bin, n, round(mean_score, 6) AS mean_score, round(mean_truth, 6) AS mean_truth FROM r"),
    "diagnostic_curve": (
        diagnostic_curve,
        BLOCKS + "SELECT CAST(step AS INTEGER) AS step, round(arg_min(kept / total, kept), 6) AS coverage, round(arg_min(lost / kept, kept), 6) AS risk FROM b, range(1, 21) s(step) WHERE kept * 20 >= step * total GROUP BY step",
    ),
    "average_precision": (
        average_precision,
        f"WITH {DETECTIONS}, e AS (SELECT *, max(tp / rank) OVER (PARTITION BY cls ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS best FROM c) SELECT cls, CASE WHEN max(positives) > 0 THEN round(sum(best * hit) / max(positives), 6) END AS ap FROM e GROUP BY cls",
    ),
    "log_avg_miss_rate": (
        log_avg_miss_rate,
        f"""WITH {DETECTIONS}, p AS (SELECT pow(10e0, -2 + i / 4e0) AS point FROM range(9) r(i)),
l AS (SELECT cls, point, coalesce(min(1 - tp / positives) FILTER ((rank - tp) / 10000e0 <= point), 1) AS miss FROM c, p GROUP BY cls, point)
SELECT cls, round(exp(avg(ln(greatest(miss, 1e-10)))), 6) AS lamr FROM l GROUP BY cls""",
    ),
    "top_detections": (top_detections, f"WITH {DETECTIONS}, r AS (SELECT cls, id, CAST(row_number() OVER (PARTITION BY cls ORDER BY confidence DESC, id) AS INTEGER) AS place FROM c WHERE confidence > 0.001) SELECT * FROM r WHERE place <= 100"),
    "iou_confusion": (iou_confusion, f"WITH {MASKS} SELECT class, tp, truth, predicted, CASE WHEN truth + predicted - tp > 0 THEN round(tp / (truth + predicted - tp), 6) END AS iou FROM k"),
    "iou_summary": (
        iou_summary,
        f"WITH {MASKS} SELECT round(avg(CASE WHEN truth + predicted - tp > 0 THEN tp / (truth + predicted - tp) END), 6) AS mean_iou, round(sum(tp) / sum(truth), 6) AS accuracy FROM k",
    ),
    "class_weights": (
        class_weights,
        f"WITH {MASKS}, n AS (SELECT truth, count(*) AS n FROM m GROUP BY truth), r AS (SELECT *, sqrt(sum(n) OVER () / n) AS raw FROM n) SELECT truth, n, round(raw / avg(raw) OVER (), 6) AS weight FROM r",
    ),
    "bootstrap_hashdraw": (bootstrap_hashdraw, DRAWN + "SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.975), 6) AS high FROM v"),
    "paired_delta": (
        paired_delta,
        DRAWN + "SELECT round(quantile_cont(value - base, 0.025), 6) AS low, round(quantile_cont(value - base, 0.975), 6) AS high, round(avg(CASE WHEN value - base > 0 THEN 1e0 ELSE 0e0 END), 6) AS better FROM v",
    ),
    "latency_summary": (
        latency_summary,
        """WITH l AS (SELECT event_type, CASE WHEN event_id % 13 <> 0 THEN value END AS ms FROM events)
SELECT event_type, count(ms) AS n, count(*) - count(ms) AS missing, round(avg(ms), 6) AS mean, round(stddev_pop(ms), 6) AS std, min(ms) AS low, max(ms) AS high,
  round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM l GROUP BY 1""",
    ),
    "throughput_summary": (throughput_summary, "SELECT event_type, count(*) AS n, round(count(*) / sum(value) * 1000, 6) AS per_second FROM events GROUP BY 1"),
}
