"""Streaming and kernel queries, run to the end of their input."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from evifuse.functions.raster import THERMAL
from evifuse.operators import gates, kernels
from evifuse.plans.rasters import BLUR, PALETTE
from evifuse.plans.sync import OTHERS, POLICY
from evifuse.sources.scratch import scratch
from evifuse.sources.tables import nanoseconds, pixels, read
from evifuse.streaming import synchronizer


def stream_sync_state(spark, sf_dir):
    """events as a stream through the stateful synchronizer; all that is available is read, then the sink's table."""
    schema = read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    n = F.col("event_id")
    rows = events.select(
        n.alias("seq"), F.col("user_id").alias("rig"), F.col("event_type").alias("stream"), nanoseconds(F.col("ts")).alias("t"),
        F.when(n % 11 != 0, (n % 7) * 60_000_000_000).alias("unc"), F.when(n % 17 == 0, "ptp-b").otherwise("ptp-a").alias("domain"),
    )
    found = synchronizer.synchronize(rows, "click", OTHERS, POLICY)
    out, marks = scratch(spark, "sync-rows"), scratch(spark, "sync-marks")
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def _frames(spark, sf_dir):
    """Rasters as packed frames."""
    rows = pixels(spark, sf_dir).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"]).alias("vs"))

    @F.pandas_udf("binary")
    def packed(values):
        return values.map(lambda v: np.asarray(v, "<f4").tobytes())

    return rows.select("frame", F.lit(8).alias("height"), F.lit(8).alias("width"), packed("vs").alias("data"))


def blur_packed(spark, sf_dir):
    """The mean of each blurred frame; the long form is box_blur_r3."""

    @F.pandas_udf("double")
    def mean(data):
        return data.map(lambda d: float(np.frombuffer(d, "<f4").mean()))

    return kernels.blur(_frames(spark, sf_dir), 3).select("frame", F.round(mean("data"), 4).alias("mean"))


def palette_packed(spark, sf_dir):
    """Digest of each frame's colors; the long form is palette_thermal."""
    return kernels.palette(_frames(spark, sf_dir), THERMAL).select("frame", F.sha2("rgb", 256).alias("digest"))


def fuse_packed(spark, sf_dir):
    """Mean channels of packed frames, each fused with its negative."""
    frames = _frames(spark, sf_dir)

    @F.pandas_udf("binary")
    def negative(data):
        return data.map(lambda d: (1 - np.frombuffer(d, "<f4")).tobytes())

    @F.pandas_udf("double")
    def mean(data):
        return data.map(lambda d: float(np.frombuffer(d, "<f4").mean()))

    pairs = frames.select("frame", "height", "width", F.col("data").alias("visible"), negative("data").alias("thermal"), (F.col("frame") % 10 / F.lit(10.0)).alias("support"))
    return kernels.fuse(pairs).select("frame", *(F.round(mean(c), 5).alias(c) for c in ("saliency", "thermal_contribution", "fusion_support", "fused")))


def phase_registration(spark, sf_dir):
    frames = _frames(spark, sf_dir)

    @F.pandas_udf("binary")
    def moved(frame, height, width, data):
        each = zip(frame, height, width, data)
        return pd.Series([np.roll(np.frombuffer(d, "<f4").reshape(h, w), (i % 3, -(i % 4)), (0, 1)).tobytes() for i, h, w, d in each])

    pairs = frames.select("frame", "height", "width", F.col("data").alias("reference"), moved("frame", "height", "width", "data").alias("moving"))
    return kernels.register(pairs).select("frame", "dy", "dx", (F.col("confidence") > 0).alias("trusted"))


def iou_matching(spark, sf_dir):
    """Boxes from lineitem, one image for each part of a hundred; even lines are truths."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 10).cast("long").alias("image"), (F.col("l_orderkey") * 1000 + F.col("l_partkey") % 100 * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_linenumber") % 2 == 0).alias("is_truth"),
        F.col("l_tax").alias("score"), (F.col("l_suppkey") % 10 / F.lit(20.0)).alias("x"), (F.col("l_partkey") % 10 / F.lit(20.0)).alias("y"), F.lit(0.4).alias("w"),
        (F.col("l_quantity") / 100 + 0.1).alias("h"),
    )
    return kernels.match(rows.dropDuplicates(["image", "id"]), 0.5)


def terrain_march(spark, sf_dir):
    """Rays from above a sloped height field."""
    north, east = np.mgrid[0:40, 0:40]
    grid = 1.0 + 0.05 * east + 0.02 * north
    k = F.col("p_partkey")
    rays = read(spark, sf_dir, "part").select(
        k.alias("ray"), F.lit(20.0).alias("ox"), F.lit(20.0).alias("oy"), F.lit(15.013).alias("oz"), ((k % 21 - 10) / F.lit(10.0)).alias("dx"),
        ((k % 17 - 8) / F.lit(10.0)).alias("dy"), F.lit(-1.0).alias("dz")
    )
    found = kernels.terrain_hits(rays, grid, 40.0, 0.25)
    return found.select("ray", *(F.round(c, 4).alias(c) for c in ("reach", "east", "north", "up")))


# a plane: z = 1 + .05 e + .02 n, so 15.013 - t a = 1 + .05 (20 + t b) + .02 (20 + t c) for the unit ray (b, c, -a)
TERRAIN = """WITH r AS (SELECT p_partkey AS ray, (p_partkey % 21 - 10) / 10e0 AS dx, (p_partkey % 17 - 8) / 10e0 AS dy FROM part), u AS (SELECT *, sqrt(dx * dx + dy * dy + 1) AS len FROM r),
t AS (SELECT *, 12.613e0 / (1 / len + 0.05e0 * dx / len + 0.02e0 * dy / len) AS reach FROM u)
SELECT ray, round(reach, 4) AS reach, round(20 + reach * dx / len, 4) AS east, round(20 + reach * dy / len, 4) AS north, round(15.013 - reach / len, 4) AS up FROM t"""


def mission_gates(spark, sf_dir):
    """orders as frames of missions: the first failing gate names the reason; contracts and frame ids are checked in arrival order."""
    rows = read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("mission"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 1400).alias("frame"),
        (F.col("o_orderkey") % 13 == 0).alias("capture_time_uncertainty_unknown"), (F.col("o_totalprice") > 400000).alias("camera_agl_outside_limits"),
        (F.col("o_custkey") % 29 == 0).alias("navigation_fix_unknown"),
        F.when(F.col("o_orderkey") % 3 == 0, F.substring("o_orderpriority", 1, 1)).alias("contract"),
    )
    judged = gates.in_order(rows, gates.MISSION, "contract", "thermal_mission_contract_changed", "frame", "duplicate_frame_id")
    return judged.select("mission", "seq", "frame", "reject_reason")


GATES = """WITH r AS (
  SELECT o_custkey % 50 AS mission, o_orderkey AS seq, o_orderkey % 1400 AS frame, CASE WHEN o_orderkey % 3 = 0 THEN substr(o_orderpriority, 1, 1) END AS contract,
    CASE WHEN o_orderkey % 13 = 0 THEN 'capture_time_uncertainty_unknown' END AS early,
    CASE WHEN o_custkey % 29 = 0 THEN 'navigation_fix_unknown' WHEN o_totalprice > 400000 THEN 'camera_agl_outside_limits' END AS late
  FROM orders
), p AS (SELECT *, row_number() OVER (PARTITION BY mission, frame ORDER BY seq) AS nth FROM r WHERE early IS NULL AND late IS NULL),
f AS (SELECT mission, min(seq) AS fixed_at, arg_min(contract, seq) AS fixed FROM p WHERE nth = 1 AND contract IS NOT NULL GROUP BY mission),
c AS (SELECT r.*, coalesce(seq > fixed_at AND contract <> fixed, false) AS changed FROM r LEFT JOIN f USING (mission)),
a AS (SELECT mission, frame, min(seq) AS taken FROM c WHERE early IS NULL AND late IS NULL AND NOT changed GROUP BY mission, frame)
SELECT mission, seq, frame, coalesce(early, CASE WHEN changed THEN 'thermal_mission_contract_changed' END, late, CASE WHEN seq > taken THEN 'duplicate_frame_id' END) AS reject_reason
FROM c LEFT JOIN a USING (mission, frame)"""

#: The long forms over the single precision of packed frames.
SINGLE = lambda sql: sql.replace("least(greatest(CAST(e AS DOUBLE) + 0.5, 0), 1) AS v", "CAST(CAST(least(greatest(CAST(e AS DOUBLE) + 0.5, 0), 1) AS FLOAT) AS DOUBLE) AS v")
BLURRED = f"SELECT frame, round(avg(v), 4) AS mean FROM ({SINGLE(BLUR)}) GROUP BY frame"
COLORED = f"SELECT frame, sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY y, x))) AS digest FROM ({SINGLE(PALETTE)}) GROUP BY frame"

QUERIES = {
    "stream_sync_state": (stream_sync_state, None),
    "blur_packed": (blur_packed, BLURRED),
    "palette_packed": (palette_packed, COLORED),
    "fuse_packed": (fuse_packed, None),
    "phase_registration": (phase_registration, None),
    "iou_matching": (iou_matching, None),
    "terrain_march": (terrain_march, TERRAIN),
    "mission_gates": (mission_gates, GATES),
}
