"""Raster, policy, geodesy and mosaic queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from evifuse.functions import geo
from evifuse.functions.raster import CLASSES, SUPPORT, THERMAL, baseline, blend, class_color, luma601, luma709, palette, palette_sql, recolor
from evifuse.operators import kernels, metrics, mosaic, policy, raster
from evifuse.plans.evaluation import rounded
from evifuse.sources.scratch import scratch, written
from evifuse.sources.tables import PIXELS, pixels, read

CLIP = lambda x: f"CASE WHEN {x} < 0 THEN 0 WHEN {x} > 1 THEN 1 ELSE {x} END"


def robust_normalize(spark, sf_dir):
    """Every ninth pixel is invalid and stays out of the percentiles."""
    rows = raster.robust_normalize(pixels(spark, sf_dir), valid=(F.col("y") * 8 + F.col("x")) % 9 != 0)
    return rounded(rows.select("frame", "y", "x", "norm"), "norm")


ROBUST = f"""WITH {PIXELS}, q AS (SELECT *, quantile_cont(v, 0.01) FILTER ((y * 8 + x) % 9 <> 0) OVER w AS lo, quantile_cont(v,
  0.99) FILTER ((y * 8 + x) % 9 <> 0) OVER w AS hi FROM px WINDOW w AS (PARTITION BY frame))
SELECT frame, y, x, round(CASE WHEN lo IS NULL OR hi <= lo + 1e-8 THEN 0 ELSE {CLIP('((v - lo) / (hi - lo))')} END, 6) AS norm FROM q"""


def normalize_map_p99(spark, sf_dir):
    return rounded(raster.scale_by_p99(pixels(spark, sf_dir), "v", "scaled").select("frame", "y", "x", "scaled"), "scaled")


def gradient_energy(spark, sf_dir):
    return rounded(raster.gradient_energy(pixels(spark, sf_dir), 8, 8).select("frame", "y", "x", "energy"), "energy")


GRADIENT = f"""WITH {PIXELS}, g AS (SELECT *, 0.5e0 * (lead(v) OVER r - lag(v) OVER r) AS gx, 0.5e0 * (lead(v) OVER c - lag(v) OVER c) AS gy FROM px
  WINDOW r AS (PARTITION BY frame, y ORDER BY x), c AS (PARTITION BY frame, x ORDER BY y))
SELECT frame, y, x, round(sqrt(pow(coalesce(gx, 0), 2) + pow(coalesce(gy, 0), 2)), 6) AS energy FROM g"""


def box_blur_r3(spark, sf_dir):
    return rounded(raster.box_blur(pixels(spark, sf_dir), 8, 8, 3), "v", digits=9)


BLUR = f"""WITH {PIXELS}, o AS (SELECT unnest(range(-3, 4)) AS d),
i AS (SELECT a.v AS c, d, CASE WHEN a.v + d < 0 THEN -(a.v + d) WHEN a.v + d >= 8 THEN 14 - (a.v + d) ELSE a.v + d END AS j FROM range(8) a(v), o)
SELECT f.frame, CAST(iy.c AS INTEGER) AS y, CAST(ix.c AS INTEGER) AS x, round(sum(f.v) / 49e0, 9) AS v FROM i iy, i ix, px f WHERE f.y = iy.j AND f.x = ix.j GROUP BY f.frame, iy.c, ix.c"""


def _colors(spark, sf_dir):
    """Three neighbouring frames as the channels of one image."""
    rows = pixels(spark, sf_dir)
    return rows.groupBy((F.floor(F.col("frame") / 3)).cast("long").alias("image"), "y", "x").agg(*(F.max(F.when(F.col("frame") % 3 == i, F.col("v"))).alias(c) for i,
        c in enumerate("rgb"))).where("b IS NOT NULL")


COLORS = f"""WITH {PIXELS}, col AS (SELECT * FROM (SELECT frame // 3 AS image, y, x, max(v) FILTER (frame % 3 = 0) AS r, max(v) FILTER (frame % 3 = 1) AS g,
  max(v) FILTER (frame % 3 = 2) AS b FROM px GROUP BY 1, 2, 3) WHERE b IS NOT NULL)
"""


def recolor_luma(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    out = recolor(r, g, b, luma709(r, g, b), 0.7)
    rows = _colors(spark, sf_dir).select("image", "y", "x", luma601(r, g, b).alias("luma"), *(c.alias(f"out_{n}") for c, n in zip(out, "rgb")))
    return rounded(rows, "luma", "out_r", "out_g", "out_b")


RECOLOR = COLORS + f""", l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS t, 0.299 * r + 0.587 * g + 0.114 * b AS l6 FROM col), k AS (SELECT *,
  (b - l6) * 0.564 * 0.7 AS cb, (r - l6) * 0.713 * 0.7 AS cr FROM l)
SELECT image, y, x, round(l6, 6) AS luma, round({CLIP('(t + 1.403 * cr)')}, 6) AS out_r,
  round({CLIP('(t - 0.344 * cb - 0.714 * cr)')}, 6) AS out_g, round({CLIP('(t + 1.773 * cb)')}, 6) AS out_b FROM k"""


def palette_thermal(spark, sf_dir):
    v = F.col("v")
    return pixels(spark, sf_dir).select("frame", "y", "x", *(palette(v, THERMAL, i + 1).alias(c) for i, c in enumerate("rgb")), palette(v, SUPPORT, 2).alias("support_g"))


PALETTE = f"""WITH {PIXELS} SELECT frame, y, x, {', '.join(f'{palette_sql("v", THERMAL, i + 1)} AS {c}' for i, c in enumerate('rgb'))}, {palette_sql('v', SUPPORT, 2)} AS support_g FROM px"""


def _inputs(spark, sf_dir):
    """Aligned pixels with the inputs of fusion; every fifth frame is ineligible, support falls with the frame number."""
    rows = pixels(spark, sf_dir).withColumnRenamed("v", "visible")
    named = rows.withColumns(
        {
            "thermal": 1 - F.col("visible"), "visible_detail": F.col("visible") * F.col("visible"), "thermal_detail": F.abs(F.col("visible") - 0.5), "contrast": F.col("visible") / 2,
            "support": (F.col("frame") % 10) / F.lit(10.0), "valid": (F.col("x") + F.col("y")) % 7 != 0, "eligible": F.col("frame") % 5 != 0,
        }
    )
    return raster.fuse(named)


FUSED = f"""WITH {PIXELS}, n AS (SELECT frame, y, x, v AS visible, 1 - v AS thermal, v * v AS visible_detail, abs(v - 0.5) AS thermal_detail, v / 2 AS contrast,
  (frame % 10) / 10e0 AS support, (x + y) % 7 <> 0 AS valid, frame % 5 <> 0 AS eligible,
    avg(v) OVER (PARTITION BY frame) AS mean FROM px),
s AS (SELECT *, {CLIP('((0.48 - mean) / 0.38)')} AS night, {CLIP('(0.55 * thermal_detail + 0.45 * contrast)')} AS saliency, greatest(1 - 1.7 * abs(visible - 0.5),
  0.08) AS exposure, CASE WHEN support >= 0.5 AND valid THEN support ELSE 0 END AS trusted FROM n),
w AS (SELECT *, CASE WHEN eligible THEN least(greatest(0.12 + 0.22 * night + 0.58 * saliency, 0), 0.82) * trusted ELSE 0 END AS thermal_contribution,
  CASE WHEN eligible THEN least(greatest(least(0.45 * least(exposure, 1) + 0.55 * visible_detail, 1), least(0.3 + 0.7 * saliency, 1)) * trusted, 1) ELSE 0 END AS fusion_support,
  {CLIP('((visible - 0.5) * 1.08 + 0.5)')} AS tone FROM s),
f AS (SELECT *, CASE WHEN eligible THEN (1 - thermal_contribution) * tone + thermal_contribution * thermal ELSE visible END AS fused FROM w)
"""


def fuse_channels(spark, sf_dir):
    rows = _inputs(spark, sf_dir).select("frame", "y", "x", "saliency", "thermal_contribution", "fusion_support", "fused")
    return rounded(rows, "saliency", "thermal_contribution", "fusion_support", "fused")


def no_fusion_zone(spark, sf_dir):
    """Ineligible frames: the visible signal is kept, thermal and support are zero."""
    rows = _inputs(spark, sf_dir).where("NOT eligible")
    return rounded(rows.groupBy("frame").agg(F.max("thermal_contribution").alias("thermal"), F.max("fusion_support").alias("support"),
        F.max(F.abs(F.col("fused") - F.col("visible"))).alias("changed"), F.count(F.lit(1)).alias("n")), "thermal", "support", "changed")


MODEL = policy.Model(
    features=("visible", "saliency", "support"),
    presets=("balanced", "thermal", "visible"),
    bias=(0.1, -0.2, 0.0),
    weights=((0.5, 0.1, 0.2), (-1.0, 2.0, 0.4), (1.2, -0.5, 0.1)),
    gain_bias=0.6,
    gain_weights=(-0.4, 0.8, 0.3),
)


def policy_softmax(spark, sf_dir):
    rows = _inputs(spark, sf_dir).groupBy("frame").agg(
        F.avg("visible").alias("visible"), F.avg("saliency").alias("saliency"), F.avg("support").alias("support"),
        F.avg(F.col("valid").cast("double")).alias("valid_fraction"), F.bool_and("eligible").alias("applied")
    )
    return rounded(policy.recommend(rows, MODEL), "confidence")


def _dot(bias, weights):
    return f"{bias!r}::DOUBLE" + "".join(f" + {w!r}::DOUBLE * {n}" for w, n in zip(weights, MODEL.features))


POLICY = FUSED + f""", a AS (SELECT frame, avg(visible) AS visible, avg(saliency) AS saliency, avg(support) AS support, avg(CASE WHEN valid THEN 1e0
  ELSE 0 END) AS valid_fraction, bool_and(eligible) AS applied FROM f GROUP BY frame),
z AS (SELECT *, {', '.join(f'{_dot(b, w)} AS z{i}' for i, (b, w) in enumerate(zip(MODEL.bias, MODEL.weights)))}, {_dot(MODEL.gain_bias, MODEL.gain_weights)} AS raw,
  concat_ws(',', CASE WHEN NOT applied THEN 'pixel_fusion_unavailable' END, CASE WHEN support < 0.5 THEN 'registration_below_minimum' END, CASE
  WHEN valid_fraction < 0.5 THEN 'coverage_below_minimum' END) AS reasons FROM a)
SELECT frame, CASE WHEN reasons <> '' THEN 'integrity' WHEN z0 >= z1 AND z0 >= z2 THEN 'balanced' WHEN z1 >= z2 THEN 'thermal' ELSE 'visible' END AS preset,
  CASE WHEN reasons <> '' THEN 0 ELSE round(least(greatest(raw, 0), 1.5e0 * least(1, support / 0.5e0, valid_fraction / 0.5e0)), 4) END AS gain,
  round(CASE WHEN reasons <> '' THEN 1 ELSE 1 / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))) END, 6) AS confidence,
  CASE WHEN reasons <> '' THEN 'safety_override' ELSE 'recommended' END AS status, reasons FROM z"""


def scene_digest_stats(spark, sf_dir):
    found = raster.statistics(_inputs(spark, sf_dir), ["visible", "thermal", "saliency"])
    return rounded(found, "mean", "p05", "p50", "p95")


STATS = FUSED + """, u AS (SELECT frame, unnest(['visible', 'thermal', 'saliency']) AS channel, unnest([visible, thermal, saliency]) AS v FROM f)
SELECT frame, channel, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95
  FROM u GROUP BY frame, channel"""


def _positions(spark, sf_dir):
    """customers as geodetic points near an origin, suppliers likewise."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), (46.0 + (k % 997) / F.lit(10000.0)).alias("lat"), (7.0 + (k % 883) / F.lit(10000.0)).alias("lon"),
        (F.col("c_acctbal") / 100).alias("h"))


POSITIONS = "pos AS (SELECT c_custkey AS id, 46 + (c_custkey % 997) / 10000e0 AS lat, 7 + (c_custkey % 883) / 10000e0 AS lon, c_acctbal / 100 AS h FROM customer)"
ORIGIN = (46.05, 7.04, 400.0)


def geodetic_enu(spark, sf_dir):
    """Local coordinates of each point, and how far the way back misses it in metres."""
    origin = tuple(map(F.lit, ORIGIN))
    rows = _positions(spark, sf_dir)
    e, n, u = geo.geodetic_to_enu((F.col("lat"), F.col("lon"), F.col("h")), origin)
    rows = rows.select("id", "lat", "lon", "h", e.alias("east"), n.alias("north"), u.alias("up"))
    lat, lon, h = geo.enu_to_geodetic((F.col("east"), F.col("north"), F.col("up")), origin)
    near = (F.abs(lat - F.col("lat")) < 1e-9) & (F.abs(lon - F.col("lon")) < 1e-9) & (F.abs(h - F.col("h")) < 1e-4)
    return rounded(rows.select("id", "east", "north", "up", near.alias("returns")), "east", "north", "up", digits=4)


def _ecef(lat, lon, h):
    n = f"({geo.SEMI_MAJOR!r} / sqrt(1 - {geo.E2!r}::DOUBLE * pow(sin(radians({lat})), 2)))"
    return f"({n} + {h}) * cos(radians({lat})) * cos(radians({lon}))", f"({n} + {h}) * cos(radians({lat})) * sin(radians({lon}))", f"({n} * (1 - {geo.E2!r}::DOUBLE) + {h}) * sin(radians({lat}))"


A, B = _ecef("lat", "lon", "h"), _ecef(*(f"{x!r}::DOUBLE" for x in ORIGIN))
SP, CP, SL, CL = (f"{f}(radians({x!r}::DOUBLE))" for f, x in (("sin", ORIGIN[0]), ("cos", ORIGIN[0]), ("sin", ORIGIN[1]), ("cos", ORIGIN[1])))
ENU = f"""WITH {POSITIONS}, d AS (SELECT id, {A[0]} - ({B[0]}) AS dx, {A[1]} - ({B[1]}) AS dy, {A[2]} - ({B[2]}) AS dz FROM pos)
SELECT id, round(-{SL} * dx + {CL} * dy, 4) + 0e0 AS east, round(-{SP} * {CL} * dx - {SP} * {SL} * dy + {CP} * dz, 4) + 0e0 AS north,
  round({CP} * {CL} * dx + {CP} * {SL} * dy + {SP} * dz, 4) + 0e0 AS up, true AS returns FROM d"""


def plane_intersect(spark, sf_dir):
    """Rays from lineitem: those that look up, are too flat or too far have no hit."""
    ray = (F.col("l_discount") * 10 - 0.5, F.col("l_tax") * 10 - 0.4, 0.2 - F.col("l_quantity") / 25)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c.alias(n) for c, n in zip(ray, ("rx", "ry", "rz"))))
    r, e, n = geo.ground_hit((F.lit(0.0), F.lit(0.0), F.lit(50.0)), (F.col("rx"), F.col("ry"), F.col("rz")), F.lit(10.0), 0.2, 150.0)
    hits = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.alias("reach"), e.alias("east"), n.alias("north"))
    return rounded(hits, "reach", "east", "north")


PLANE = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 - 0.5 AS rx, l_tax * 10 - 0.4 AS ry, 0.2 - l_quantity / 25 AS rz FROM lineitem),
n AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS len FROM r), d AS (SELECT *, CASE WHEN len > 1e-12 THEN -rz / len END AS down FROM n),
g AS (SELECT *, CASE WHEN down >= 0.2 AND 40 / down > 0 AND 40 / down <= 150 THEN 40e0 / down END AS reach FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(reach, 6) AS reach, round(reach * rx / len, 6) AS east, round(reach * ry / len, 6) AS north FROM g"""


#: Positions that a cell should hold, as a position meets it, and how often the cells may be halved twice for that.
CELL_POINTS, FINEST = 8, 6


def _cells(n: int) -> dict:
    """Cell of a position (lat, lon), n cells around the globe."""
    width = 360.0 / n
    return {"cy": F.floor(F.col("lat") / width).cast("long"), "cx": F.pmod(F.floor(F.col("lon") / width).cast("long"), F.lit(n))}


def _fine_cells(places) -> int:
    """Cells around the globe (0.005 degrees each, or finer) so that a position shares its cell with few others."""
    n = 72_000
    for _ in range(FINEST):
        met = places.withColumns(_cells(n)).groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("k")).agg((F.sum(F.col("k") * F.col("k")) / F.sum("k")).alias("met")).first().met
        if met is None or met <= CELL_POINTS:
            break
        n *= 4
    return n


def nearest_distances(points):
    """id and metres to the nearest other point of (id, lat, lon), however far; null for a lone point or an unknown position.

    A position that several points hold is settled at once and searched for no more than once. Positions meet those of the cells around theirs,
    cells as fine as the points are dense. Whoever's best is not within the width of a cell, which nothing farther off can beat, looks again in
    cells twice as wide, up to one cell for the whole globe. Those who look again lie a cell apart, so a wide cell holds few of them.
    """
    spark, found = points.sparkSession, None
    points = points.select("id", "lat", "lon")
    at = points.groupBy("lat", "lon").agg(F.min("id").alias("id"), (F.min("id") < F.max("id")).alias("shared"))
    places = written(at, "nearest-places")
    known = places.where("lat IS NOT NULL AND lon IS NOT NULL")
    n = _fine_cells(known)
    todo = known.where("NOT shared").drop("shared")
    while True:
        width = 360.0 / n
        around = F.explode(F.array_distinct(F.array(*(F.struct((F.col("cy") + i).alias("cy"), F.pmod(F.col("cx") + j, F.lit(n)).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))))
        wide = todo.withColumns(_cells(n)).select("id", "lat", "lon", around.alias("o")).select("id", "lat", "lon", "o.cy", "o.cx")
        others = known.withColumns(_cells(n)).select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "cy", "cx")
        met = wide.join(others, ["cy", "cx"]).where(F.col("id") != F.col("other"))
        best = met.groupBy("id").agg(F.min(geo.distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("metres"))
        path = scratch(spark, "nearest")
        todo.join(best, "id", "left").write.parquet(path)
        level = spark.read.parquet(path)
        sure = geo.EARTH_RADIUS * math.radians(width) * F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + width / 2))) * (1 - 1e-9)
        proven = F.lit(True) if n == 1 else F.coalesce(F.col("metres") <= sure, F.lit(False))
        settled = level.where(proven).select("lat", "lon", "metres")
        found = settled if found is None else found.unionByName(settled)
        todo = level.where(~proven).drop("metres")
        if n == 1 or todo.isEmpty():
            break
        n //= 2
    apart = places.where("shared AND lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", F.lit(0.0).alias("metres"))
    placed = points.join(found.unionByName(apart).withColumnsRenamed({"lat": "_lat", "lon": "_lon"}), F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon")), "left")
    return placed.select("id", "metres")


def nearest_neighbor(spark, sf_dir):
    """Distance of each point to its nearest other one, by grid cells."""
    return rounded(nearest_distances(_positions(spark, sf_dir)), "metres", digits=4)


NEIGHBOR = f"""WITH {POSITIONS},
m AS (SELECT a.id, min({geo.EARTH_RADIUS!r} * sqrt(pow(radians(b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(radians(b.lat - a.lat), 2))) AS d FROM pos a
  JOIN pos b ON a.id <> b.id GROUP BY a.id)
SELECT pos.id, round(d, 4) AS metres FROM pos LEFT JOIN m USING (id)"""


def _parts(spark, sf_dir):
    """lineitem as samples on a 50 by 34 grid; some lie outside, some have no weight or no thermal value."""
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 5100 / F.lit(100.0) - 0.3).alias("east"), (F.col("l_suppkey") * 7 % 101 / F.lit(3.0)).alias("north"),
        mosaic.splat_weight(F.col("l_tax") * 10, F.col("l_quantity") / 50, F.col("l_discount") * 10, 0.5).alias("weight"), F.col("l_quantity").alias("value"),
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / 1000).alias("thermal"), (F.col("l_linenumber") - 2).alias("class"),
        (F.col("l_orderkey") % 40).alias("frame"), (F.col("l_orderkey") % 40).alias("seq"),
    )
    return mosaic.splat(rows, 34, 50)


PARTS = """s AS (SELECT l_partkey % 5100 / 100e0 - 0.3 AS east, l_suppkey * 7 % 101 / 3e0 AS north, l_tax * 10 * (l_quantity / 50) / (1 + pow(l_discount * 10 / 0.5, 2)) AS weight, l_quantity AS value,
  CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / 1000 END AS thermal, l_linenumber - 2 AS class, l_orderkey % 40 AS frame FROM lineitem),
parts AS (SELECT *, CAST(floor(north) AS INTEGER) + i AS row, CAST(floor(east) AS INTEGER) + j AS col,
  (CASE WHEN i = 1 THEN north - floor(north) ELSE 1 - (north - floor(north)) END) * (CASE WHEN j = 1 THEN east - floor(east) ELSE 1 - (east - floor(east)) END) * weight AS w
  FROM s, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j)),
kept AS (SELECT * FROM parts WHERE w > 0 AND row >= 0 AND row < 34 AND col >= 0 AND col < 50),
cells AS (SELECT row, col, sum(w) AS weight, sum(w * value) AS value_sum, sum(w) FILTER (thermal IS NOT NULL) AS tw, sum(w * thermal) AS ts, count(*) AS coverage_count,
  count(DISTINCT frame) AS frame_count FROM kept GROUP BY row, col)
"""


def splat_mosaic(spark, sf_dir):
    return rounded(mosaic.accumulate(_parts(spark, sf_dir)), "weight", "value_sum", "thermal_weight", "thermal_sum", digits=5)


def snapshot_support(spark, sf_dir):
    return rounded(mosaic.snapshot(mosaic.accumulate(_parts(spark, sf_dir))), "value", "thermal", "support")


def semantic_winner(spark, sf_dir):
    return rounded(mosaic.semantic_winner(_parts(spark, sf_dir)), "confidence")


def dominant_source(spark, sf_dir):
    return rounded(mosaic.dominant_source(_parts(spark, sf_dir)), "w")


def footprint(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", geo.footprint(F.col("p_size") * 2, 64.0).alias("width"), geo.footprint(F.col("p_size") * 2, 48.0).alias("height"))
    return rounded(rows, "width", "height")


def attitude_slerp(spark, sf_dir):
    """Yaw, pitch and roll halfway between two yaws, and the heading vector turned by it."""
    half = lambda deg: F.radians(deg / 2)
    a, b = (F.col("c_custkey") % 360).cast("double"), (F.col("c_custkey") * 7 % 170).cast("double")
    q1, q2 = [F.cos(half(a)), F.lit(0.0), F.lit(0.0), F.sin(half(a))], [F.cos(half(a + b)), F.lit(0.0), F.lit(0.0), F.sin(half(a + b))]
    named = {f"{n}{i}": c for n, q in (("p", geo.normalized(q1)), ("q", geo.normalized(q2))) for i, c in enumerate(q)}
    rows = read(spark, sf_dir, "customer").select("c_custkey", *(c.alias(n) for n, c in named.items()))
    mid = geo.slerp([F.col(f"p{i}") for i in range(4)], [F.col(f"q{i}") for i in range(4)], F.lit(0.5))
    rows = rows.select("c_custkey", *(c.alias(f"m{i}") for i, c in enumerate(mid)))
    m = [F.col(f"m{i}") for i in range(4)]
    x, y, _ = geo.rotate(m, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    yaw, pitch, roll = geo.euler_zyx(m)
    # away from the seam at 180 degrees, where the last bit decides the sign
    return rounded(rows.select("c_custkey", x.alias("x"), y.alias("y"), F.round(F.pmod(yaw + 0.25, F.lit(360.0)), 4).alias("yaw"),
        (F.abs(pitch) + F.abs(roll) < 1e-6).alias("level")), "x", "y", digits=5)


SLERP = """WITH h AS (SELECT c_custkey, c_custkey % 360 + (c_custkey * 7 % 170) / 2e0 AS deg FROM customer)
SELECT c_custkey, round(cos(radians(deg)), 5) + 0e0 AS x, round(sin(radians(deg)), 5) + 0e0 AS y, round((deg + 0.25) % 360, 4) AS yaw, true AS level FROM h"""



def semantic_coverage(spark, sf_dir):
    """Share and color of each class of the labels' rasters, classes beyond the listed ones included."""
    rows = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return rounded(rows.select("class", "n", (F.col("n") / total).alias("coverage"), *(class_color(F.col("class"), i + 1).alias(c) for i, c in enumerate("rgb"))), "coverage")


COLOR = lambda i: f"CASE WHEN class < 12 THEN [{', '.join(str(c[i]) for c in CLASSES)}][CAST(class + 1 AS BIGINT)] ELSE CAST(96 + (((class * 2654435761) & 16777215) >> {8 * i} & 127) AS INTEGER) END"
COVERAGE = f"WITH c AS (SELECT l_suppkey % 40 AS class, count(*) AS n FROM lineitem GROUP BY 1) SELECT class, n, round(n / sum(n) OVER (), 6) AS coverage, {COLOR(0)} AS r, {COLOR(1)} AS g, {COLOR(2)} AS b FROM c"


def semantic_view(spark, sf_dir):
    """Pixels under half-transparent class colors; class 3 is unknown and leaves the pixel as it is."""
    rows = pixels(spark, sf_dir).select("frame", "y", "x", F.rint(F.col("v") * 255).alias("base"), F.when(F.col("x") % 4 != 3, F.col("x") % 4).alias("class"))
    return rows.select("frame", "y", "x", *(blend(F.col("base"), F.when(F.col("class").isNotNull(), class_color(F.col("class"), i + 1)), 0.4).alias(c) for i, c in enumerate("rgb")))


VIEW = f"""WITH {PIXELS}, m AS (SELECT frame, y, x, round_even(v * 255, 0) AS base, CASE WHEN x % 4 <> 3 THEN x % 4 END AS class FROM px)
SELECT frame, y, x, {', '.join(f"CAST(CASE WHEN class IS NULL THEN base ELSE round_even(base * 0.6::DOUBLE + [{', '.join(str(k[i]) for k in CLASSES)}][CAST(class + 1 AS BIGINT)] * 0.4::DOUBLE, 0) END AS INTEGER) AS {c}" for i, c in enumerate('rgb'))} FROM m"""


def fusion_baselines(spark, sf_dir):
    """Each comparison method's mean and its distance from the fused signal."""
    rows = _inputs(spark, sf_dir)
    names = ("rgb_only", "thermal_only", "average", "maximum")
    values = {n: baseline(n, F.col("visible"), F.col("thermal"), F.col("support")) for n in names}
    found = rows.groupBy("frame").agg(*(F.avg(c).alias(n) for n, c in values.items()), F.avg(metrics.smooth_l1(3 * (F.col("fused") - values["average"]))).alias("smooth_l1"))
    return rounded(found, *names, "smooth_l1")


BASELINES = FUSED + """, b AS (SELECT frame, visible AS rgb_only, visible * (1 - support) + thermal * support AS thermal_only, visible * (1 - 0.5e0 * support) + thermal * 0.5e0 * support AS average,
  visible * (1 - support) + greatest(visible, thermal) * support AS maximum, fused FROM f), d AS (SELECT *, 3 * (fused - average) AS gap FROM b)
SELECT frame, round(avg(rgb_only), 6) AS rgb_only, round(avg(thermal_only), 6) AS thermal_only, round(avg(average), 6) AS average, round(avg(maximum), 6) AS maximum,
  round(avg(CASE WHEN abs(gap) < 1 THEN 0.5e0 * gap * gap ELSE abs(gap) - 0.5 END), 6) AS smooth_l1 FROM d GROUP BY frame"""


def overlap_report(spark, sf_dir):
    """Share of positions with a neighbour near enough, the largest baseline, and what fails.

    The farthest pair lies on the convex hull, so only hull points are compared with each other.
    """
    near = nearest_neighbor(spark, sf_dir).agg(F.avg((F.coalesce("metres", F.lit(1e9)) <= 60).cast("double")).alias("passing"), F.count(F.lit(1)).alias("n"))
    rim = kernels.outermost(_positions(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")))
    other = rim.toDF("other", "x2", "y2")
    pairs = rim.join(other, F.col("id") < F.col("other"))
    far = pairs.agg(F.max(geo.distance(F.col("y"), F.col("x"), F.col("y2"), F.col("x2"))).alias("baseline"))
    both = near.withColumn("k", F.lit(1)).join(far.withColumn("k", F.lit(1)), "k").drop("k")
    reason = F.when(F.col("baseline") < 500, "insufficient_spatial_extent").when(F.col("passing") < 0.9, "positions_too_sparse")
    return rounded(both.select("n", "passing", "baseline", reason.alias("reject_reason")), "passing", digits=6).withColumn("baseline", F.round("baseline", 3))


OVERLAP = NEIGHBOR.replace("SELECT pos.id, round(d, 4)", ", near AS (SELECT pos.id, round(d, 4)").replace("LEFT JOIN m USING (id)", "LEFT JOIN m USING (id))") + f""",
far AS (SELECT max({geo.EARTH_RADIUS!r} * sqrt(pow(radians(b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(radians(b.lat - a.lat), 2))) AS baseline FROM pos a JOIN pos b ON a.id < b.id),
s AS (SELECT count(*) AS n, avg(CASE WHEN coalesce(metres, 1e9) <= 60 THEN 1e0 ELSE 0e0 END) AS passing FROM near)
SELECT n, round(passing, 6) AS passing, round(baseline, 3) AS baseline, CASE WHEN baseline < 500 THEN 'insufficient_spatial_extent'
  WHEN passing < 0.9 THEN 'positions_too_sparse' END AS reject_reason FROM s, far"""

QUERIES = {
    "semantic_coverage": (semantic_coverage, COVERAGE),
    "semantic_view": (semantic_view, VIEW),
    "fusion_baselines": (fusion_baselines, BASELINES),
    "overlap_report": (overlap_report, OVERLAP),
    "robust_normalize": (robust_normalize, ROBUST),
    "normalize_map_p99": (normalize_map_p99, f"WITH {PIXELS}, q AS (SELECT *, greatest(quantile_cont(v, 0.99) OVER (PARTITION BY frame), 1e-7) AS s FROM px) SELECT frame, y, x, round({CLIP('(v / s)')}, 6) AS scaled FROM q"),
    "gradient_energy": (gradient_energy, GRADIENT),
    "box_blur_r3": (box_blur_r3, BLUR),
    "recolor_luma": (recolor_luma, RECOLOR),
    "palette_thermal": (palette_thermal, PALETTE),
    "fuse_channels": (fuse_channels, FUSED + "SELECT frame, y, x, round(saliency, 6) AS saliency, round(thermal_contribution, 6) AS thermal_contribution, round(fusion_support, 6) AS fusion_support, round(fused, 6) AS fused FROM f"),
    "no_fusion_zone": (no_fusion_zone, FUSED + "SELECT frame, round(max(thermal_contribution), 6) AS thermal, round(max(fusion_support), 6) AS support, round(max(abs(fused - visible)), 6) AS changed, count(*) AS n FROM f WHERE NOT eligible GROUP BY frame"),
    "policy_softmax": (policy_softmax, POLICY),
    "scene_digest_stats": (scene_digest_stats, STATS),
    "geodetic_enu": (geodetic_enu, ENU),
    "plane_intersect": (plane_intersect, PLANE),
    "nearest_neighbor": (nearest_neighbor, NEIGHBOR),
    "splat_mosaic": (splat_mosaic, f"WITH {PARTS} SELECT row, col, round(weight, 5) AS weight, round(value_sum, 5) AS value_sum, round(tw, 5) AS thermal_weight, round(ts, 5) AS thermal_sum, coverage_count, frame_count FROM cells"),
    "snapshot_support": (snapshot_support, f"WITH {PARTS} SELECT row, col, round(value_sum / weight, 6) AS value, round(ts / tw, 6) AS thermal, round(1 - exp(-weight), 6) AS support, coverage_count, frame_count FROM cells"),
    "semantic_winner": (
        semantic_winner,
        f"WITH {PARTS}, e AS (SELECT row, col, class, sum(w) AS w FROM kept WHERE class >= 0 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY w DESC, class) AS rn, sum(w) OVER (PARTITION BY row, col) AS t FROM e) SELECT row, col, class, round(w / t, 6) AS confidence FROM r WHERE rn = 1",
    ),
    "dominant_source": (
        dominant_source,
        f"WITH {PARTS}, e AS (SELECT row, col, frame, sum(w) AS w FROM kept GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY w DESC, frame) AS rn FROM e) SELECT row, col, frame, round(w, 6) AS w FROM r WHERE rn = 1",
    ),
    "footprint": (footprint, "SELECT p_partkey, round(2 * p_size * 2 * tan(radians(32e0)), 6) AS width, round(2 * p_size * 2 * tan(radians(24e0)), 6) AS height FROM part"),
    "attitude_slerp": (attitude_slerp, SLERP),
}
