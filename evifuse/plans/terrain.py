"""Rays of many cameras onto a tiled height field, with the uncertainty of where they land."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evifuse.functions import frames
from evifuse.operators import terrain
from evifuse.plans.evaluation import rounded
from evifuse.sources.tables import read

FIELD = terrain.Surface(east_min=0.0, north_max=100.0, resolution=0.5, rows=200, columns=200, max_range=120.0, tolerance=1e-7, step=1.0, tile=64)
IMAGE = math.hypot(0.5, 0.2) / 800


def _field(spark):
    """A sloped plane, as sure as it lies east."""
    at = spark.range(FIELD.rows * FIELD.columns).select(F.floor(F.col("id") / FIELD.columns).cast("int").alias("row"), (F.col("id") % FIELD.columns).cast("int").alias("col"))
    east, north = (F.col("col") + 0.5) * FIELD.resolution, FIELD.north_max - (F.col("row") + 0.5) * FIELD.resolution
    return at.select("row", "col", (1 + 0.05 * east + 0.02 * north).alias("height"), (0.05 + 0.001 * east).alias("sigma"))


def _rays(spark, sf_dir):
    """orders as rays of cameras above the plane; some look nearly level or beyond the field."""
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.min("o_custkey").alias("p"))
    k, p = F.col("k"), F.col("p")
    s = k * 3 + p
    return rows.select(
        k.alias("ray"), (20.0137 + k % 61).alias("ox"), (25.0291 + p % 53).alias("oy"), (30.0173 + s % 11).alias("oz"),
        (p % 21 / F.lit(10.0) - 1.003717).alias("dx"), (s % 17 / F.lit(8.0) - 0.987131).alias("dy"), F.lit(-1.0).alias("dz"),
        (k % 3 / F.lit(10.0)).alias("se"), F.lit(0.2).alias("sn"), F.when(p % 4 != 0, 0.1).alias("su"), F.hypot(k % 5 * 0.001, F.lit(IMAGE)).alias("angle"),
    )


def terrain_uncertainty(spark, sf_dir):
    """Landings, the field's own deviation there, the farthest of the probes, and the larger of it and the first-order deviation."""
    both = terrain.projected(_rays(spark, sf_dir), terrain.tiles(_field(spark), FIELD), FIELD, ("ox", "oy", "oz", "se", "sn", "su"))
    zero = F.lit(0.0)
    level = frames.ground_uncertainty(
        (F.col("east") - F.col("ox"), F.col("north") - F.col("oy")), F.col("oz") - F.col("up"), F.col("reach"), (F.col("se"), F.col("sn"), F.col("su")), zero, zero,
        F.col("ray") % 5 * 0.001, F.lit(0.5), F.lit(0.2), F.lit(800.0), F.col("ground_sigma"), zero,
    )
    return rounded(both.withColumn("sigma", F.greatest(level, "probe")).select("ray", "reach", "east", "north", "up", "ground_sigma", "probe", "sigma"), "reach", "east",
        "north", "up", "ground_sigma", "probe", "sigma", digits=4)


#: A plane in closed form. The first sample beyond the landing must lie on the field too, or what the ray meets is unknown.
SQL = f"""WITH r AS (SELECT k AS ray, 20.0137e0 + k % 61 AS ox, 25.0291e0 + p % 53 AS oy, 30.0173e0 + s % 11 AS oz, p % 21 / 10e0 - 1.003717e0 AS dx,
  s % 17 / 8e0 - 0.987131e0 AS dy, k % 3 / 10e0 AS se, 0.2e0 AS sn,
    CASE WHEN p % 4 <> 0 THEN 0.1e0 ELSE 0e0 END AS su, k % 5 * 0.001e0 AS turn, sqrt(pow(k % 5 * 0.001e0, 2) + pow({IMAGE!r}, 2)) AS angle
  FROM (SELECT o_orderkey AS k, min(o_custkey) AS p, o_orderkey * 3 + min(o_custkey) AS s FROM orders GROUP BY 1)),
u AS (SELECT *, dx / sqrt(dx * dx + dy * dy + 1) AS x, dy / sqrt(dx * dx + dy * dy + 1) AS y, -1 / sqrt(dx * dx + dy * dy + 1) AS z FROM r),
a AS (SELECT *, CASE WHEN x * x + y * y > 1e-18 THEN y / sqrt(x * x + y * y) ELSE 0 END AS fx, CASE WHEN x * x + y * y > 1e-18 THEN -x / sqrt(x * x + y * y) ELSE -1e0 END AS fy FROM u),
b AS (SELECT *, -z * fy AS sx, z * fx AS sy, x * fy - y * fx AS sz FROM a),
v(i, me, mn, mu, f, s) AS (VALUES (0, 0, 0, 0, 0e0, 0e0), (1, 1, 0, 0, 0, 0), (2, -1, 0, 0, 0, 0), (3, 0, 1, 0, 0, 0), (4, 0, -1, 0, 0, 0), (5, 0, 0, 1, 0, 0), (6, 0, 0,
  -1, 0, 0), (7, 0, 0, 0, 0, -1), (8, 0, 0, 0, 0, 1), (9, 0, 0, 0, 1, 0), (10, 0, 0, 0, -1, 0),
  (11, 0, 0, 0, sqrt(0.5e0), -sqrt(0.5e0)), (12, 0, 0, 0, -sqrt(0.5e0), sqrt(0.5e0)), (13, 0, 0, 0, -sqrt(0.5e0), -sqrt(0.5e0)), (14, 0, 0, 0, sqrt(0.5e0), sqrt(0.5e0))),
m AS (SELECT ray, i, se, sn, su, turn, ox AS x0, oy AS y0, oz AS z0, ox + me * se AS ox, oy + mn * sn AS oy, oz + mu * su AS oz,
    CASE WHEN i < 7 THEN x ELSE x * cos(angle) + (f * fx + v.s * sx) * sin(angle) END AS x, CASE WHEN i < 7 THEN y
    ELSE y * cos(angle) + (f * fy + v.s * sy) * sin(angle) END AS y, CASE WHEN i < 7 THEN z ELSE z * cos(angle) + v.s * sz * sin(angle) END AS z
  FROM b, v WHERE i = 0 OR i > 6 OR abs(me) * se + abs(mn) * sn + abs(mu) * su > 0),
t AS (SELECT *, CASE WHEN -z >= 0.2 THEN (oz - 1 - 0.05e0 * ox - 0.02e0 * oy) / (0.05e0 * x + 0.02e0 * y - z) END AS t0, least(120e0, (oz - 1.0175e0) / -z) AS last FROM m),
k AS (SELECT *, least(ceil(t0), last) AS tk FROM t),
h AS (SELECT *, CASE WHEN t0 <= 120 AND ox + tk * x BETWEEN 0.25 AND 99.75 AND oy + tk * y BETWEEN 0.25 AND 99.75 THEN t0 END AS reach FROM k),
n AS (SELECT ray, se, sn, su, turn, x0, y0, z0, reach, ox + reach * x AS east, oy + reach * y AS north, oz + reach * z AS up FROM h WHERE i = 0),
o AS (SELECT h.ray, max(CASE WHEN h.reach IS NULL THEN 'infinity'::DOUBLE ELSE sqrt(pow(h.ox + h.reach * h.x - n.east, 2) + pow(h.oy + h.reach * h.y - n.north,
  2)) END) AS probe FROM h JOIN n USING (ray) WHERE h.i > 0 AND n.reach IS NOT NULL GROUP BY 1),
g AS (SELECT *, 0.05e0 + 0.001e0 * east AS ground_sigma FROM n LEFT JOIN o USING (ray)),
l AS (SELECT *, sqrt(se * se + sn * sn + (pow(east - x0, 2) + pow(north - y0, 2)) / pow(greatest(abs(z0 - up), 1e-9),
  2) * (su * su + ground_sigma * ground_sigma) + pow(reach * turn, 2) + pow(reach * {IMAGE!r}, 2)) AS level FROM g)
SELECT ray, round(reach, 4) AS reach, round(east, 4) AS east, round(north, 4) AS north, round(up, 4) AS up, round(ground_sigma, 4) AS ground_sigma, round(probe,
  4) AS probe, CASE WHEN reach IS NOT NULL THEN round(greatest(level, probe), 4) END AS sigma FROM l"""
QUERIES = {"terrain_uncertainty": (terrain_uncertainty, SQL)}
