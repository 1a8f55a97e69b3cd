"""Telemetry to poses, and pixels to the ground, with closed forms as their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.functions import frames, geo
from evifuse.operators import poses
from evifuse.sources.tables import OBSERVATIONS, observations, read

HOUR = 3_600_000_000_000
#: What the queries assume: UTC ahead of the boot clocks, the shutter's lag, the widest gap, bounds of the motion.
UTC_AHEAD, LAG, LAG_UNCERTAINTY, MAX_GAP = 37_000_000_000, 2_000_000_000, 50_000_000, 48 * HOUR
ACCELERATION, TURNING = 1e-7, 1e-9


def telemetry_pose(spark, sf_dir):
    """views are telemetry, clicks captures of a camera that looks along its rig's yaw; some know one clock, some both, some another."""
    n = F.col("seq")
    rows = observations(spark, sf_dir).withColumn("mono", F.when(n % 6 != 0, F.col("t"))).withColumn("utc", F.when(n % 4 != 1, F.col("t") + UTC_AHEAD))
    half = F.radians(n * 7 % 170 / F.lit(2.0))
    q = F.when(n % 29 != 0, F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)))
    lat = F.when(n % 23 != 0, n % 80 / F.lit(1.0))
    values = [lat.alias("lat"), (n * 11 % 360 - 180.0).alias("lon"), (n % 50 * 2.0).alias("alt"), q.alias("q")]
    samples = rows.where("stream = 'view'").select("rig", "seq", "mono", "domain", "utc", *values)
    captures = rows.where("stream = 'click'").select("rig", n.alias("target"), "mono", F.when(n % 19 != 0, F.col("domain")).alias("domain"), "utc", "unc")
    found = poses.poses(poses.shifted(captures, -LAG, LAG_UNCERTAINTY), samples, ["rig"], MAX_GAP, ACCELERATION, TURNING)
    forward = geo.rotate([F.col("flu")[i] for i in range(4)], (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    down = geo.rotate([F.col("optical")[i] for i in range(4)], (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    places = {"lat": F.col("lat"), "alt": F.col("alt"), "lon_cos": F.cos(F.radians("lon")), "lon_sin": F.sin(F.radians("lon")), "yaw_deg": F.col("yaw_deg")}
    places |= {"forward_east": forward[0], "forward_north": forward[1], "down_up": down[2], "position_bound": F.col("position_bound_m"), "attitude_bound": F.col("attitude_bound_deg")}
    shown = [F.round(F.when(F.col("reason").isNull(), value), 4).alias(name) for name, value in places.items()]
    return found.select("target", "rig", "basis", "unc", "span_ns", *shown, "reason")


POSES = f"""WITH {OBSERVATIONS}, o AS (SELECT *, CASE WHEN seq % 6 <> 0 THEN t END AS mono, CASE WHEN seq % 4 <> 1 THEN t + {UTC_AHEAD} END AS utc FROM obs),
s AS (SELECT rig, seq, mono, domain, utc, CASE WHEN seq % 23 <> 0 THEN CAST(seq % 80 AS DOUBLE) END AS lat, CAST(seq * 11 % 360 - 180 AS DOUBLE) AS lon,
  seq % 50 * 2e0 AS alt, CASE WHEN seq % 29 <> 0 THEN CAST(seq * 7 % 170 AS DOUBLE) END AS yaw FROM o WHERE stream = 'view'),
c AS (SELECT rig, seq AS target, mono - {LAG} AS mono, CASE WHEN seq % 19 <> 0 THEN domain END AS domain, utc - {LAG} AS utc, unc + {LAG_UNCERTAINTY} AS unc FROM o WHERE stream = 'click'),
k AS (SELECT rig, bool_or(utc IS NOT NULL) AS has_utc, bool_or(mono IS NOT NULL) AS has_boot FROM s GROUP BY rig),
b AS (SELECT c.*, has_boot, CASE WHEN mono IS NOT NULL AND domain IS NULL THEN NULL
    WHEN mono IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE s.rig = c.rig AND s.domain = c.domain AND s.mono IS NOT NULL) THEN 'boot'
    WHEN utc IS NOT NULL AND has_utc THEN 'utc' END AS basis FROM c LEFT JOIN k USING (rig)),
w AS (SELECT *, CASE basis WHEN 'boot' THEN domain WHEN 'utc' THEN 'UTC' END AS clock, CASE basis WHEN 'boot' THEN mono WHEN 'utc' THEN utc END AS tt FROM b),
z AS (SELECT rig, 'boot' AS basis, domain AS clock, mono AS tt, seq, lat, lon, alt, yaw FROM s WHERE mono IS NOT NULL
  UNION ALL SELECT rig, 'utc', 'UTC', utc, seq, lat, lon, alt, yaw FROM s WHERE utc IS NOT NULL),
lo AS (SELECT w.*, z.tt AS t0, z.lat AS lat0, z.lon AS lon0, z.alt AS alt0, z.yaw AS yaw0 FROM w ASOF LEFT JOIN z ON w.rig = z.rig AND w.basis = z.basis AND w.clock = z.clock AND w.tt >= z.tt),
hi AS (SELECT w.target, z.tt AS t1, z.lat AS lat1, z.lon AS lon1, z.alt AS alt1, z.yaw AS yaw1 FROM w ASOF LEFT JOIN z ON w.rig = z.rig AND w.basis = z.basis AND w.clock = z.clock AND w.tt <= z.tt),
r AS (SELECT *, CASE WHEN mono < 0 OR utc < 0 THEN 'before_clock_origin' WHEN mono IS NOT NULL AND domain IS NULL THEN 'boot_domain_missing'
    WHEN basis IS NULL THEN CASE WHEN mono IS NOT NULL AND has_boot THEN 'boot_clocks_differ' ELSE 'no_common_time_basis' END
    WHEN t0 IS NULL THEN 'no_sample_before' WHEN t1 IS NULL THEN 'no_sample_after' WHEN t1 - t0 > {MAX_GAP} THEN 'gap_exceeds_limit'
    WHEN lat0 IS NULL OR lat1 IS NULL THEN 'invalid_position' WHEN yaw0 IS NULL OR yaw1 IS NULL THEN 'invalid_attitude' END AS reason FROM lo JOIN hi USING (target)),
f AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN t1 = t0 THEN 0e0 ELSE CAST(tt - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE) END END AS share, CASE
  WHEN reason IS NULL THEN t1 - t0 END AS span_ns FROM r),
g AS (SELECT *, CASE WHEN abs(lon1 - lon0) < 180 THEN lon1 - lon0 WHEN lon1 > lon0 THEN lon1 - lon0 - 360 WHEN lon1 - lon0 = -180 THEN -180 ELSE lon1 - lon0 + 360 END AS way,
  CASE WHEN cos(radians((yaw1 - yaw0) / 2)) <= 0.9995e0 THEN yaw0 + (yaw1 - yaw0) * share -- nearly equal attitudes are mixed linearly
    ELSE 2 * degrees(atan2((1 - share) * sin(radians(yaw0 / 2)) + share * sin(radians(yaw1 / 2)),
    (1 - share) * cos(radians(yaw0 / 2)) + share * cos(radians(yaw1 / 2)))) END AS yaw, (span_ns / 1e9) * (span_ns / 1e9) * share * (1 - share) / 2 AS bow FROM f)
SELECT target, rig, basis, unc, span_ns, round(lat0 + (lat1 - lat0) * share, 4) AS lat, round(alt0 + (alt1 - alt0) * share, 4) AS alt,
  round(cos(radians(lon0 + way * share)), 4) AS lon_cos, round(sin(radians(lon0 + way * share)), 4) AS lon_sin, round(yaw, 4) AS yaw_deg,
  round(-sin(radians(yaw)), 4) AS forward_east, round(cos(radians(yaw)), 4) AS forward_north, CASE WHEN reason IS NULL THEN -1e0 END AS down_up,
  round({ACCELERATION!r} * bow, 4) AS position_bound, round({TURNING!r} * bow, 4) AS attitude_bound, reason FROM g"""

#: A camera of 640 by 480 pixels that looks down, turned by its rig's heading.
FX, FY, CX, CY, CALIBRATION = 500.0, 520.0, 319.5, 239.5, 0.4
LEAST_COSINE, MOST_RANGE = 0.7, 150.0


def pixel_ground(spark, sf_dir):
    """lineitem as pixels of cameras above a level ground: where they lie and how surely, null where nothing safe is met."""
    n, k = F.col("l_orderkey"), F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem").select(
        n.alias("image"), F.col("l_linenumber").cast("long").alias("line"), (k % 700 - 20.0).alias("u"), (F.col("l_suppkey") * 37 % 500 - 5.0).alias("v"),
        F.radians(n % 360 * F.lit(0.5)).alias("half"), (n % 90 + 30.0).alias("agl"), (n % 7 * 0.01).alias("seconds"), (k % 4 * 0.5).alias("pixel_sigma"),
    )
    optical = [F.lit(0.0), F.cos("half"), F.sin("half"), F.lit(0.0)]
    ray = frames.pixel_ray(F.col("u"), F.col("v"), *map(F.lit, (FX, FY, CX, CY)), optical)
    zero = F.lit(0.0)
    rows = rows.withColumns(dict(zip(("ray_e", "ray_n", "ray_u"), ray)))  # columns, as the hit uses each many times
    reach, east, north = geo.ground_hit((zero, zero, F.col("agl")), (F.col("ray_e"), F.col("ray_n"), F.col("ray_u")), zero, LEAST_COSINE, MOST_RANGE)
    seen = F.col("u").between(0, 639) & F.col("v").between(0, 479)
    rows = rows.withColumns({name: F.when(seen, value) for name, value in (("reach", reach), ("east", east), ("north", north))})
    sigma = frames.ground_uncertainty(
        (F.col("east"), F.col("north")), F.col("agl"), F.col("reach"), (F.lit(0.3), F.lit(0.4), F.lit(0.6)), F.lit(12.0), F.lit(0.2),
        F.lit(0.003), F.col("pixel_sigma"), F.lit(CALIBRATION), F.lit((FX + FY) / 2), F.lit(0.1), F.col("seconds"),
    )
    return rows.select("image", "line", *(F.round(value, 4).alias(name) for name, value in (("reach", F.col("reach")), ("east", F.col("east")), ("north", F.col("north")), ("sigma", sigma))))


GROUND = f"""WITH p AS (SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) AS line, l_partkey % 700 - 20e0 AS u, l_suppkey * 37 % 500 - 5e0 AS v, radians(CAST(l_orderkey % 360 AS DOUBLE)) AS h,
  l_orderkey % 90 + 30e0 AS agl, l_orderkey % 7 * 0.01e0 AS dt, l_partkey % 4 * 0.5e0 AS ps FROM lineitem),
r AS (SELECT *, (u - {CX}) / {FX} AS a, (v - {CY}) / {FY} AS b FROM p), l AS (SELECT *, sqrt(a * a + b * b + 1) AS len FROM r),
g AS (SELECT *, CASE WHEN u >= 0 AND u <= 639 AND v >= 0 AND v <= 479 AND 1 / len >= {LEAST_COSINE} AND agl * len <= {MOST_RANGE} THEN agl * len END AS reach FROM l)
SELECT image, line, round(reach, 4) AS reach, round(CASE WHEN reach IS NOT NULL THEN agl * (a * cos(h) + b * sin(h)) END, 4) AS east,
  round(CASE WHEN reach IS NOT NULL THEN agl * (a * sin(h) - b * cos(h)) END, 4) AS north,
  round(sqrt(0.25e0 + 144 * dt * dt + (a * a + b * b) * 0.37e0 + reach * reach * (0.000009e0 + 0.04e0 * dt * dt + (ps * ps + {CALIBRATION} * {CALIBRATION}) / {((FX + FY) / 2) ** 2})), 4) AS sigma FROM g"""

QUERIES = {
    "telemetry_pose": (telemetry_pose, POSES),
    "pixel_ground": (pixel_ground, GROUND),
}
