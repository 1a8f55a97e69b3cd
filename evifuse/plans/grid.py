"""Grid queries: frames judged by computed gates in arrival order, the whole map as a snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.operators import grid
from evifuse.plans.evaluation import rounded
from evifuse.sources.scratch import scratch, written
from evifuse.sources.tables import read
from evifuse.streaming import mosaic

MAP = grid.Settings(east_min=0.0, north_max=20.0, resolution=0.5, rows=40, columns=30, stride=2, max_uncertainty=3.0, max_pose_offset_ns=90, max_pixels=5000,
    max_classes=9, max_bytes=40 * 30 * (192 + 12 * 8) + 5000 * 384)


def _frames(spark, sf_dir):
    """orders as frames of twelve missions; some come twice, some lack a time, a calibration or a pose."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey"))
    size = F.when(k % 31 == 7, 170).otherwise(100)
    return rows.select(
        (c % 12).alias("mission"), k.alias("seq"), (k % 300).alias("frame"), F.when(k % 41 != 3, k * 1000).alias("t"), F.when(k % 43 == 5, " ").when(k % 43 != 6, "c1").alias("calibration"),
        F.when(k % 47 != 8, "p").alias("pose"), F.when(k % 53 != 9, k * 1000 + c % 100).alias("pose_t"), size.alias("height"), size.alias("width"), F.when(k % 59 == 1,
        99).otherwise(size).alias("image_height"), size.alias("image_width"),
    )


def _samples(spark, sf_dir):
    """lineitem as sampled pixels of their order's frame."""
    k, p, s, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"),
        F.min("l_quantity").alias("l_quantity"))
    own = read(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg((F.min("o_custkey") % 12).alias("mission"))
    return rows.join(own, "l_orderkey").select(
        "mission", k.alias("seq"), (k % 11 != 2).alias("valid"), (k % 13 != 4).alias("validity"), (p % 5 / F.lit(4.0)).alias("support"), F.when(k % 17 == 6, -0.5).otherwise(0.75).alias("incidence"),
        F.when(k % 19 == 5, 4.0).otherwise(s % 7 / F.lit(2.0)).alias("sigma"), (F.when(k % 23 == 3, 90.0).otherwise(0.0) + p % 160 / F.lit(10.0) - 0.4).alias("east"),
        (s % 210 / F.lit(10.0) - 0.3).alias("north"), (n / F.lit(8.0)).alias("up"),
        F.col("l_quantity").alias("value"), F.when(n % 3 != 0, p % 64 / F.lit(64.0)).alias("thermal"), F.when(k % 3 == 0, (p * n) % (k % 97 % 4 * 4 + 1) - 1).alias("class"),
    )


def _judged(spark, sf_dir):
    frames, samples = _frames(spark, sf_dir), _samples(spark, sf_dir)
    return written(grid.judged(grid.summaries(frames, samples, MAP), MAP), "grid-judged"), samples


def grid_gates(spark, sf_dir):
    """Each frame's reason, with the numbers that the gates saw."""
    judged, _ = _judged(spark, sf_dir)
    found = judged.select("mission", "seq", "frame", "safe", "mean_uncertainty", "max_uncertainty", "uncertainty", "candidates", "inside", "integrated",
        F.array_join("classes", ",").alias("classes"), "reject_reason")
    return rounded(found, "mean_uncertainty", "max_uncertainty", "uncertainty")


def grid_snapshot(spark, sf_dir):
    judged, samples = _judged(spark, sf_dir)
    accepted = judged.where("reject_reason IS NULL")
    parts = written(grid.contributions(accepted, samples, MAP), "grid-parts")
    return rounded(grid.snapshot(accepted, parts, MAP), "value", "up", "sigma", "thermal", "support", "thermal_support", "semantic_support", "confidence")


def grid_stream(spark, sf_dir):
    """The same frames judged as they arrive, in a stream that is read to its end."""
    summed = grid.summaries(_frames(spark, sf_dir), _samples(spark, sf_dir), MAP)
    arrived, out, marks = (scratch(spark, f"grid-{n}") for n in ("arrived", "rows", "marks"))
    summed.write.parquet(arrived)
    found = mosaic.accepted(spark.readStream.schema(summed.schema).parquet(arrived), MAP)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


JUDGED = f"""RECURSIVE f AS (SELECT c % 12 AS mission, k AS seq, k % 300 AS frame, CASE WHEN k % 41 <> 3 THEN k * 1000 END AS t, CASE WHEN k % 43 = 5 THEN ' '
  WHEN k % 43 <> 6 THEN 'c1' END AS calibration,
    CASE WHEN k % 47 <> 8 THEN 'p' END AS pose, CASE WHEN k % 53 <> 9 THEN k * 1000 + c % 100 END AS pose_t, CASE WHEN k % 31 = 7 THEN 170 ELSE 100 END AS size, k % 59 = 1 AS other
  FROM (SELECT o_orderkey AS k, min(o_custkey) AS c FROM orders GROUP BY 1)),
l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
x AS (SELECT f.mission, f.seq, k % 11 <> 2 AS valid, k % 13 <> 4 AS validity, p % 5 / 4e0 AS support, CASE WHEN k % 17 = 6 THEN -0.5e0 ELSE 0.75e0 END AS incidence, CASE
  WHEN k % 19 = 5 THEN 4e0 ELSE s % 7 / 2e0 END AS sigma,
    CASE WHEN k % 23 = 3 THEN 90e0 ELSE 0e0 END + p % 160 / 10e0 - 0.4e0 AS east, s % 210 / 10e0 - 0.3e0 AS north, n / 8e0 AS up, value, CASE
    WHEN n % 3 <> 0 THEN p % 64 / 64e0 END AS thermal, CASE WHEN k % 3 = 0 THEN (p * n) % (k % 97 % 4 * 4 + 1) - 1 END AS class
  FROM l JOIN f ON f.seq = l.k),
w AS (SELECT *, (east - 0e0) / 0.5e0 - 0.5e0 AS col, (20e0 - north) / 0.5e0 - 0.5e0 AS row, support * least(greatest(incidence, 0), 1) / (1 + pow(sigma / 0.5e0,
  2)) AS weight, valid AND validity AND support > 0 AND sigma <= 3 AS candidate FROM x),
c AS (SELECT *, candidate AND EXISTS (SELECT 1 FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) WHERE floor(row) + i BETWEEN 0 AND 39 AND floor(col) + j BETWEEN 0 AND 29
    AND (CASE WHEN i = 1 THEN row - floor(row) ELSE 1 - (row - floor(row)) END) * (CASE WHEN j = 1 THEN col - floor(col) ELSE 1 - (col - floor(col)) END) > 0) AS inside FROM w),
a AS (SELECT mission, seq, count(*) FILTER (valid) AS safe, avg(sigma) FILTER (valid) AS mean_uncertainty, max(sigma) FILTER (valid) AS max_uncertainty,
  quantile_cont(sigma, 0.95) FILTER (valid) AS uncertainty, count(*) FILTER (candidate) AS candidates,
    count(*) FILTER (inside) AS inside, count(*) FILTER (inside AND weight > 0) AS integrated, list_sort(list(DISTINCT class) FILTER (inside AND weight > 0
    AND class >= 0)) AS classes FROM c GROUP BY 1, 2),
g AS (SELECT f.*, coalesce(safe, 0) AS safe, mean_uncertainty, max_uncertainty, uncertainty, coalesce(candidates, 0) AS candidates, coalesce(inside, 0) AS inside,
  coalesce(integrated, 0) AS integrated, coalesce(classes, []) AS classes FROM f LEFT JOIN a USING (mission, seq)),
r AS (SELECT *, CASE WHEN t IS NULL THEN 'unknown_capture_time' WHEN trim(coalesce(calibration, '')) = '' THEN 'unknown_camera_calibration'
  WHEN pose IS NULL THEN 'unknown_vehicle_camera_pose' WHEN pose_t IS NULL THEN 'unknown_pose_time' END AS early,
    CASE WHEN other THEN 'calibration_geometry_mismatch' WHEN abs(t - pose_t) > 90 THEN 'pose_time_offset_exceeds_limit'
    WHEN ((size + 1) // 2) * ((size + 1) // 2) > 5000 THEN 'sampled_pixel_limit_exceeded' WHEN safe = 0 THEN 'no_safe_ground_intersections'
      WHEN uncertainty > 3 THEN 'projected_uncertainty_exceeds_limit' WHEN candidates = 0 THEN 'no_supported_samples_after_uncertainty_gate'
      WHEN inside = 0 THEN 'projected_footprint_outside_map' WHEN integrated = 0 THEN 'zero_weight_after_splat' END AS late,
    row_number() OVER (PARTITION BY mission ORDER BY seq) AS k FROM g),
walk AS (SELECT mission, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS held, CAST(NULL AS VARCHAR) AS reason FROM r GROUP BY mission
  UNION ALL
  SELECT mission, k, CASE WHEN reason IS NULL THEN list_append(taken, frame) ELSE taken END, CASE WHEN reason IS NULL THEN both_ ELSE held END, reason FROM (
    SELECT r.mission, r.k, taken, held, frame, list_distinct(list_concat(held, r.classes)) AS both_, coalesce(early, CASE WHEN list_contains(taken, frame) THEN 'duplicate_frame_id' END, late,
      CASE WHEN len(r.classes) > 0 AND len(list_distinct(list_concat(held, r.classes))) > {MAP.max_classes} THEN 'semantic_class_limit_exceeded'
        WHEN len(r.classes) > 0 AND 40 * 30 * (192 + 12 * len(list_distinct(list_concat(held, r.classes)))) + 5000 * 384 > {MAP.max_bytes} THEN 'semantic_memory_budget_exceeded' END) AS reason
    FROM walk JOIN r ON r.mission = walk.mission AND r.k = walk.k + 1)),
j AS (SELECT r.*, reason AS reject_reason FROM r JOIN walk USING (mission, k))"""
SNAPSHOT = """, p AS (SELECT c.*, CAST(floor(c.row) AS INTEGER) + i AS r_, CAST(floor(c.col) AS INTEGER) + j_ AS c_, (CASE WHEN i = 1 THEN c.row - floor(c.row)
  ELSE 1 - (c.row - floor(c.row)) END) * (CASE WHEN j_ = 1 THEN c.col - floor(c.col) ELSE 1 - (c.col - floor(c.col)) END) * c.weight AS w
  FROM c JOIN j USING (mission, seq), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j_) WHERE reject_reason IS NULL AND c.inside AND c.weight > 0),
q AS (SELECT * FROM p WHERE w > 0 AND r_ BETWEEN 0 AND 39 AND c_ BETWEEN 0 AND 29),
s AS (SELECT mission, r_, c_, sum(w) AS weight, sum(w * value) / sum(w) AS value, sum(w * up) / sum(w) AS up, sum(w * sigma) / sum(w) AS sigma, count(*) AS n,
  sum(w) FILTER (thermal IS NOT NULL) AS tw, sum(w * thermal) AS ts FROM q GROUP BY 1, 2, 3),
e AS (SELECT mission, r_, c_, class, sum(w) AS w FROM q WHERE class >= 0 GROUP BY 1, 2, 3, 4),
k AS (SELECT mission, r_, c_, arg_max(class, {'w': w, 'c': -class}) AS class, max(w) / sum(w) AS confidence, sum(w) AS sw FROM e GROUP BY 1, 2, 3),
n AS (SELECT mission, seq, row_number() OVER (PARTITION BY mission ORDER BY seq) - 1 AS source_index FROM j WHERE reject_reason IS NULL),
d AS (SELECT mission, r_, c_, arg_max(source_index, {'w': w, 's': -source_index}) AS source_index FROM (SELECT mission, r_, c_, seq, sum(w) AS w FROM q GROUP BY 1, 2, 3,
  4) JOIN n USING (mission, seq) GROUP BY 1, 2, 3)
SELECT m.mission, CAST(y.r AS INTEGER) AS row, CAST(z.c AS INTEGER) AS col, round(value, 6) AS value, round(up, 6) AS up, round(sigma, 6) AS sigma, round(ts / tw,
  6) AS thermal, round(1 - exp(-coalesce(weight, 0)), 6) AS support, round(1 - exp(-coalesce(tw, 0)), 6) AS thermal_support, round(1 - exp(-coalesce(sw, 0)), 6) AS semantic_support,
  coalesce(s.n, 0) AS coverage_count, CAST(coalesce(k.class, -1) AS INTEGER) AS class, round(coalesce(confidence, 0), 6) AS confidence, coalesce(d.source_index, -1) AS source_index
FROM (SELECT DISTINCT mission FROM n) m CROSS JOIN range(40) y(r) CROSS JOIN range(30) z(c) LEFT JOIN s ON s.mission = m.mission AND s.r_ = y.r AND s.c_ = z.c LEFT
  JOIN k ON k.mission = m.mission AND k.r_ = y.r AND k.c_ = z.c LEFT JOIN d ON d.mission = m.mission AND d.r_ = y.r AND d.c_ = z.c"""
QUERIES = {
    "grid_gates": (
        grid_gates,
        f"WITH {JUDGED} SELECT mission, seq, frame, safe, round(mean_uncertainty, 6) + 0 AS mean_uncertainty, round(max_uncertainty, 6) + 0 AS max_uncertainty, round(uncertainty, 6) + 0 AS uncertainty, candidates, inside, integrated, array_to_string(classes, ',') AS classes, reject_reason FROM j",
    ),
    "grid_stream": (grid_stream, f"WITH {JUDGED} SELECT mission, seq, CAST(frame AS VARCHAR) AS frame, reject_reason FROM j"),
    "grid_snapshot": (grid_snapshot, f"WITH {JUDGED}{SNAPSHOT}"),
}
