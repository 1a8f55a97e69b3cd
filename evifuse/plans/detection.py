"""Detection queries: mean average precision over overlaps, resampled capture groups, paired views."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.operators import detection
from evifuse.plans.evaluation import rounded
from evifuse.sources.scratch import written
from evifuse.sources.tables import read

#: Replicates of the query, whose SQL has a row for each prediction and replicate.
REPLICATES = 20
VIEWS = {"visible": (3, 5), "thermal": (5, 11), "fused": (7, 2)}


def _boxes(spark, sf_dir):
    """orders as boxes of images of eight orders, fourteen capture groups."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").groupBy(k.alias("id")).agg(F.min("o_custkey").alias("c"))
    return rows.select(
        F.floor(F.col("id") / 8).cast("long").alias("image"), "id", "c",
        (F.col("c") % 16 / F.lit(8.0)).alias("x"), (F.col("id") % 4 / F.lit(4.0)).alias("y"), (F.lit(0.5) + F.col("c") % 3 / F.lit(8.0)).alias("w"), F.lit(0.5).alias("h"),
    )


def _group(image):
    return F.concat(F.lit("g"), F.lpad((image % 14).cast("string"), 2, "0"))


def _evidence(spark, sf_dir):
    """Matched predictions of every view, and the sizes of the groups. Some truths are missed, some predictions are strays."""
    boxes = _boxes(spark, sf_dir)
    truth = boxes.where("c % 9 <> 0")
    views = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.lit(a).alias("a"), F.lit(b).alias("b")) for v, (a, b) in VIEWS.items())))
    seen = boxes.select("*", views.alias("v")).select("*", "v.*").where("(id + a) % 7 <> 0")
    moved = lambda c, by: F.col(c) + (by - 2) / F.lit(32.0)
    predictions = seen.select(
        "view", "image", "id", ((F.col("id") * F.col("a") + F.col("c") * F.col("b")) % 1009 / F.lit(1009.0)).alias("score"),
        moved("x", F.col("c") * F.col("a") % 5).alias("x"), moved("y", F.col("id") * F.col("b") % 5).alias("y"), "w", "h",
    )
    bits = written(detection.matched(truth, predictions, ["view"]), "detection-bits").withColumn("grp", _group(F.col("image")))
    sizes = boxes.groupBy(_group(F.col("image")).alias("grp")).agg(F.count_distinct("image").alias("images"), F.count_if(F.col("c") % 9 != 0).alias("boxes"))
    return bits, written(sizes, "detection-groups")


def detection_matching(spark, sf_dir):
    """At how many of the ten overlaps each prediction takes a truth, counted."""
    bits, _ = _evidence(spark, sf_dir)
    return bits.groupBy("view", F.bit_count("bits").alias("thresholds")).agg(F.count(F.lit(1)).alias("n"))


def detection_map(spark, sf_dir):
    return rounded(detection.detection_metrics(*_evidence(spark, sf_dir)), *detection.NAMES)


def detection_bootstrap(spark, sf_dir):
    """Intervals of each view over resampled groups, and of its difference to the visible one."""
    bits, sizes = _evidence(spark, sf_dir)
    found = detection.bootstrap(bits, sizes, "visible", REPLICATES, "detection")
    return rounded(found, "low", "high", "delta_low", "delta_high", "better")


LISTED = ", ".join(f"('{v}', {a}, {b})" for v, (a, b) in VIEWS.items())
MATCHED = f"""b AS (SELECT o_orderkey // 8 AS image, o_orderkey AS id, min(o_custkey) AS c FROM orders GROUP BY 1, 2),
box AS (SELECT image, id, c, c % 16 / 8e0 AS x, id % 4 / 4e0 AS y, 0.5e0 + c % 3 / 8e0 AS w, 0.5e0 AS h, 'g' || lpad(CAST(image % 14 AS VARCHAR), 2, '0') AS grp FROM b),
v(view, a, b) AS (VALUES {LISTED}),
p AS (SELECT view, image, id, grp, (id * a + c * b) % 1009 / 1009e0 AS score, x + (c * a % 5 - 2) / 32e0 AS x, y + (id * b % 5 - 2) / 32e0 AS y, w, h FROM box, v WHERE (id + a) % 7 <> 0),
o AS (SELECT p.view, p.image, p.id, t.id AS truth, greatest(least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x), 0) * greatest(least(p.y + p.h, t.y + t.h) - greatest(p.y,
  t.y), 0) AS shared, p.w * p.h + t.w * t.h AS area
  FROM p JOIN box t ON t.image = p.image AND t.c % 9 <> 0),
l AS (SELECT view, image, id, list({{'truth': truth, 'iou': shared / greatest(area - shared, 1e-12)}} ORDER BY shared / greatest(area - shared, 1e-12) DESC, truth) AS near FROM o GROUP BY 1, 2, 3),
q AS (SELECT p.*, near, row_number() OVER (PARTITION BY view, image ORDER BY score DESC, id) AS k FROM p LEFT JOIN l USING (view, image, id)),
"""


#: Greedy matching as a fold over an image's predictions in order: taken truths so far, hits so far.
FOLDED = f"""{MATCHED}seq AS (SELECT view, image, list({{'id': id, 'near': near}} ORDER BY k) AS predictions FROM q GROUP BY 1, 2),
fold AS (SELECT view, image, t, list_reduce(list_transform(predictions, lambda e: {{'used': CAST([] AS BIGINT[]), 'hits': CAST([] AS BIGINT[]), 'id': e.id, 'near': e.near}}),
    lambda acc, e: {{'used': list_concat(acc.used, list_transform(list_filter(e.near, lambda n: n.iou >= 0.5e0 + 0.05e0 * t AND NOT list_contains(acc.used, n.truth))[1:1], lambda n: n.truth)),
      'hits': list_concat(acc.hits, list_transform(list_filter(e.near, lambda n: n.iou >= 0.5e0 + 0.05e0 * t AND NOT list_contains(acc.used, n.truth))[1:1],
      lambda n: e.id)), 'id': e.id, 'near': e.near}},
    {{'used': CAST([] AS BIGINT[]), 'hits': CAST([] AS BIGINT[]), 'id': CAST(0 AS BIGINT), 'near': predictions[1].near}}).hits AS hits FROM seq, range(10) r(t)),
hit AS (SELECT DISTINCT view, image, t, unnest(hits) AS id FROM fold),
d AS (SELECT q.view, q.image, q.id, q.grp, q.score, r.t, CASE WHEN hit.id IS NULL THEN 0 ELSE 1 END AS hit FROM q, range(10) r(t) LEFT JOIN hit ON hit.view = q.view
  AND hit.image = q.image AND hit.id = q.id AND hit.t = r.t),
g AS (SELECT grp, count(DISTINCT image) AS images, count(*) FILTER (c % 9 <> 0) AS boxes FROM box GROUP BY grp),
"""
#: Curves of replicates from a table z (rep, grp, times).
CURVES = """m AS (SELECT rep, sum(times * images) AS images, sum(times * boxes) AS boxes FROM z JOIN g USING (grp) GROUP BY rep),
c AS (SELECT d.view, z.rep, d.t, d.hit, z.times, d.score, d.image, d.id, sum(times * hit) OVER w AS tp, sum(times) OVER w AS n FROM d JOIN z USING (grp)
  WINDOW w AS (PARTITION BY d.view, z.rep, d.t ORDER BY d.score DESC, d.image, d.id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(CAST(tp AS DOUBLE) / CAST(n AS DOUBLE)) OVER (PARTITION BY view, rep, t ORDER BY score, image DESC, id DESC ROWS UNBOUNDED PRECEDING) AS best FROM c),
ap AS (SELECT view, rep, t, sum(times * hit * best) / any_value(boxes) AS ap FROM e JOIN m USING (rep) GROUP BY 1, 2, 3),
mr AS (SELECT view, rep, i, 1 - coalesce(max(CAST(tp AS DOUBLE)) FILTER (CAST(n - tp AS DOUBLE) / images <= pow(10e0, -2 + i / 4e0)), 0) / any_value(boxes) AS miss FROM c
  JOIN m USING (rep), range(9) s(i) WHERE t = 0 GROUP BY 1, 2, 3),
x AS (SELECT view, rep, avg(ap) AS ap_50_95, max(ap) FILTER (t = 0) AS ap50 FROM ap GROUP BY 1, 2),
y AS (SELECT view, rep, exp(avg(ln(greatest(miss, 1e-10)))) AS miss_rate FROM mr GROUP BY 1, 2)
"""
DRAWS = f"""num AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS number, count(*) OVER () AS size FROM g),
h AS (SELECT rep, draw, CAST('0x' || substr(sha256('detection:' || rep || ':' || draw), 1, 8) AS BIGINT) AS h FROM range({REPLICATES}) a(rep), range((SELECT count(*) FROM g)) b(draw)),
z AS (SELECT rep, grp, count(*) AS times FROM h JOIN num ON h.h % num.size = num.number GROUP BY 1, 2),
"""
QUERIES = {
    "detection_matching": (
        detection_matching,
        f"WITH {FOLDED[:FOLDED.rindex('g AS (')].rstrip().rstrip(',')}, u AS (SELECT view, image, id, sum(hit) AS n FROM d GROUP BY 1, 2, 3) SELECT view, CAST(n AS INTEGER) AS thresholds, count(*) AS n FROM u GROUP BY u.view, u.n",
    ),
    "detection_map": (
        detection_map,
        f"WITH {FOLDED}z AS (SELECT 0 AS rep, grp, 1 AS times FROM g), {CURVES}SELECT view, round(ap_50_95, 6) AS ap_50_95, round(ap50, 6) AS ap50, round(miss_rate, 6) AS miss_rate FROM x JOIN y USING (view, rep)",
    ),
    "detection_bootstrap": (
        detection_bootstrap,
        f"""WITH {FOLDED}{DRAWS}{CURVES}, long AS (SELECT view, rep, 'ap_50_95' AS metric, ap_50_95 AS value, 1 AS way FROM x UNION ALL SELECT view, rep, 'ap50', ap50, 1
        FROM x UNION ALL SELECT view, rep, 'miss_rate', miss_rate, -1 FROM y),
both_ AS (SELECT a.*, a.value - b.value AS delta FROM long a JOIN long b ON a.rep = b.rep AND a.metric = b.metric AND b.view = 'visible'),
r AS (SELECT view, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high, quantile_cont(delta, 0.025) AS dl, quantile_cont(delta, 0.975) AS dh,
  avg(CASE WHEN way * delta > 0 THEN 1e0 ELSE 0e0 END) AS better FROM both_ GROUP BY 1, 2)
SELECT view, metric, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN view <> 'visible' THEN round(dl, 6) END AS delta_low, CASE
  WHEN view <> 'visible' THEN round(dh, 6) END AS delta_high, CASE WHEN view <> 'visible' THEN round(better, 6) END AS better FROM r""",
    ),
}
