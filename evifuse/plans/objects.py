"""Objects located through accepted frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.operators import objects
from evifuse.plans.evaluation import rounded
from evifuse.sources.tables import read

CAMERA = {"fx": 500.0, "fy": 520.0, "cx": 319.5, "cy": 239.5, "rms": 0.4, "calibration": "c1"}
ORIGIN, GEOID, LEAST_COSINE, MOST_RANGE, MOST_SIGMA = (46.05, 7.04, 400.0), 47.5, 0.7, 150.0, 1.6


def object_positions(spark, sf_dir):
    """lineitem as boxes seen in frames (orders, two of three accepted) of nine missions, by a camera that looks down."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = read(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey"))
    half = F.radians(k % 360 * F.lit(0.5))
    accepted = orders.where("o_orderkey % 3 <> 1").select(
        (k % 9).alias("mission"), k.alias("seq"), k.alias("frame"), (k * 1000).alias("t"), (k * 1000 + c % 50 * 10_000_000).alias("pose_t"),
        (c % 100 / F.lit(2.0)).alias("e"), (c % 77 * 1.0).alias("n"), (k % 90 + 30.0).alias("up"),
        F.array(F.lit(0.0), F.cos(half), F.sin(half), F.lit(0.0)).alias("optical"), F.lit(0.3).alias("se"), F.lit(0.4).alias("sn"), F.lit(0.6).alias("su"),
        F.lit(2.0).alias("speed"), F.lit(0.02).alias("turn"), F.lit(0.003).alias("attitude_sigma"),
    )
    n, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    boxes = lines.select(
        (n % 9).alias("mission"), (n * 10 + F.col("l_linenumber")).alias("object"), (n + F.col("l_linenumber") - 2).alias("arrival"), n.alias("frame"),
        F.when(p % 17 != 3, "c1").otherwise("c0").alias("calibration"),
        (p % 600 * 1.0).alias("x"), (s * 37 % 440 * 1.0).alias("y"), F.when(p % 41 == 0, 0.0).otherwise(40.0).alias("w"), F.lit(40.0).alias("h"), (p % 4 * 0.5).alias("pixel_sigma"),
    )
    found = objects.located(objects.anchored(boxes), objects.contexts(accepted), CAMERA, ORIGIN, 0.0, GEOID, LEAST_COSINE, MOST_RANGE, MOST_SIGMA)
    return rounded(found, "lat", "lon", digits=7).withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("altitude_msl", "east", "north", "sigma")})


A, B, E2 = 6378137.0, 6356752.314245179, 0.0066943799901413165
SQL = f"""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 9 AS mission, min(o_custkey) AS c FROM orders GROUP BY 1),
a AS (SELECT *, row_number() OVER (PARTITION BY mission ORDER BY k) - 1 AS source_index FROM f WHERE k % 3 <> 1),
b AS (SELECT l_orderkey AS k, l_linenumber AS line, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
o AS (SELECT b.k, line, p, b.k % 9 AS mission, c, source_index, p % 4 * 0.5e0 AS ps, CASE WHEN p % 41 <> 0 THEN (p % 600 + 20e0 - 319.5e0) / 500 END AS x, CASE
  WHEN p % 41 <> 0 THEN (s * 37 % 440 + 40e0 - 239.5e0) / 520 END AS y, radians(CAST(b.k % 360 AS DOUBLE)) AS h, b.k % 90 + 30e0 AS up
  FROM b LEFT JOIN a ON a.k = b.k AND a.k < b.k + line - 2),
l AS (SELECT *, sqrt(x * x + y * y + 1) AS len, c % 50 * 0.01e0 AS dt FROM o),
g AS (SELECT *, CASE WHEN 1 / len >= {LEAST_COSINE} AND up * len <= {MOST_RANGE} THEN up * len END AS reach, c % 100 / 2e0 + up * (x * cos(h) + y * sin(h)) AS east,
  c % 77 + up * (x * sin(h) - y * cos(h)) AS north FROM l),
u AS (SELECT *, sqrt(0.25e0 + 4 * dt * dt + (x * x + y * y) * 0.36e0 + reach * reach * (0.000009e0 + 0.0004e0 * dt * dt + (ps * ps + 0.16e0) / {510.0 ** 2})) AS sigma FROM g),
r AS (SELECT *, CASE WHEN p % 17 = 3 THEN 'object_reference_calibration_mismatch' WHEN source_index IS NULL THEN 'source_frame_was_not_accepted_into_atlas'
  WHEN reach IS NULL THEN 'object_anchor_has_no_safe_ground_intersection' WHEN sigma > {MOST_SIGMA} THEN 'object_projected_uncertainty_exceeds_limit' END AS reason FROM u),
q AS (SELECT *, radians({ORIGIN[0]}) AS p0, radians({ORIGIN[1]}) AS l0, {A} / sqrt(1 - {E2} * pow(sin(radians({ORIGIN[0]})), 2)) AS n0 FROM r),
e AS (SELECT *, (n0 + {ORIGIN[2]}) * cos(p0) * cos(l0) - sin(l0) * east - sin(p0) * cos(l0) * north AS ex,
  (n0 + {ORIGIN[2]}) * cos(p0) * sin(l0) + cos(l0) * east - sin(p0) * sin(l0) * north AS ey, (n0 * (1 - {E2}) + {ORIGIN[2]}) * sin(p0) + cos(p0) * north AS ez FROM q),
t AS (SELECT *, sqrt(ex * ex + ey * ey) AS d, atan2(ez * {A}, sqrt(ex * ex + ey * ey) * {B}) AS th FROM e),
w AS (SELECT *, atan2(ez + {A * A / (B * B) - 1!r} * {B} * pow(sin(th), 3), d - {E2} * {A} * pow(cos(th), 3)) AS phi FROM t)
SELECT mission, k * 10 + line AS object, k AS frame, CASE WHEN reason IS NULL THEN round(degrees(phi), 7) END AS lat, CASE WHEN reason IS NULL THEN round(degrees(atan2(ey, ex)), 7) END AS lon,
  CASE WHEN reason IS NULL THEN round(d / cos(phi) - {A} / sqrt(1 - {E2} * pow(sin(phi),
  2)) - {GEOID}, 3) END AS altitude_msl, CASE WHEN reason IS NULL THEN round(east, 3) + 0 END AS east, CASE WHEN reason IS NULL THEN round(north, 3) + 0 END AS north,
  CASE WHEN reason IS NULL THEN round(sigma, 3) END AS sigma, CASE WHEN reason IS NULL THEN k * 1000 END AS t, CASE WHEN reason IS NULL THEN source_index END AS source_index, reason FROM w"""
QUERIES = {"object_positions": (object_positions, SQL)}
