"""Captures matched with images, and the sources of missions' telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evifuse.operators import images
from evifuse.sources.tables import read


def _captures(spark, sf_dir):
    """events as captures of forty rigs, with an index, a file, both or neither."""
    n = F.col("event_id")
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("rig"), "event_id")
    order = (F.row_number().over(Window.partitionBy("rig").orderBy("event_id")) - 1).cast("long")
    return rows.withColumn("order", order).select("rig", "order", F.when(n % 5 < 3, (F.col("order") + n % 3) % 60).alias("image_index"), F.when(n % 4 != 1,
        F.concat(F.lit("IMG"), F.when(n % 5 < 3, F.floor((F.col("order") + n % 3) % 60 / 2)).otherwise(n % 50).cast("string"), F.lit(".jpg"))).alias("file"))


def _pictures(spark, sf_dir):
    """customers as images; some have one index or one name in common."""
    rows = read(spark, sf_dir, "customer").select(((F.col("c_custkey") * 7) % 39).alias("rig"), "c_custkey")
    place = (F.row_number().over(Window.partitionBy("rig").orderBy("c_custkey")) - 1).cast("long")
    k = F.col("c_custkey")
    return rows.withColumn("position", place).select("rig", "position", F.when(k % 11 != 5, F.col("position") - (k % 8 == 0).cast("long")).alias("image_index"),
        F.concat(F.lit("img"), F.floor(F.col("position") / 2).cast("string"), F.lit(".JPG")).alias("file"))


def image_match(spark, sf_dir):
    """Both ways of matching."""
    found = [images.match(_captures(spark, sf_dir), _pictures(spark, sf_dir), ["rig"], strict).withColumn("strict", F.lit(strict)) for strict in (False, True)]
    return found[0].unionByName(found[1])


WALK = """WITH RECURSIVE c0 AS (SELECT user_id % 40 AS rig, event_id AS n, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1 AS o FROM events),
c AS (SELECT rig, o, CASE WHEN n % 5 < 3 THEN (o + n % 3) % 60 END AS ix, CASE WHEN n % 4 <> 1 THEN 'IMG' || CASE WHEN n % 5 < 3 THEN ((o + n % 3) % 60) // 2
  ELSE n % 50 END || '.jpg' END AS file FROM c0),
p0 AS (SELECT c_custkey * 7 % 39 AS rig, c_custkey AS k, row_number() OVER (PARTITION BY c_custkey * 7 % 39 ORDER BY c_custkey) - 1 AS pos FROM customer),
p AS (SELECT rig, pos, CASE WHEN k % 11 <> 5 THEN pos - (k % 8 = 0)::BIGINT END AS ix, 'img' || pos // 2 || '.JPG' AS image FROM p0),
m AS (SELECT c.*, strict, (SELECT list(pos ORDER BY pos) FROM p WHERE p.rig = c.rig AND p.ix = c.ix) AS by_index, (SELECT list(pos ORDER BY pos) FROM p
  WHERE p.rig = c.rig AND lower(p.image) = lower(c.file)) AS by_name, (SELECT count(*) FROM p WHERE p.rig = c.rig) AS size
  FROM c, (SELECT unnest([true, false]) AS strict)),
a AS (SELECT *, CASE WHEN strict AND size > 0 THEN CASE WHEN ix IS NOT NULL AND file IS NOT NULL THEN list_filter(coalesce(by_index, []),
  lambda x: list_contains(coalesce(by_name, []), x)) WHEN ix IS NOT NULL THEN coalesce(by_index, []) ELSE coalesce(by_name, []) END
    ELSE list_concat(list_concat(coalesce(by_index, []), coalesce(by_name, [])), CASE WHEN o < size THEN [o] ELSE [] END) END AS wanted FROM m),
w AS (SELECT rig, strict, CAST(-1 AS BIGINT) AS o, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pos FROM a GROUP BY rig, strict
  UNION ALL
  SELECT rig, strict, o, CASE WHEN pos IS NULL THEN used ELSE list_append(used, pos) END, pos FROM (
    SELECT a.rig, a.strict, a.o, used, CASE WHEN NOT a.strict OR size = 0 OR len(list_filter(wanted, lambda x: NOT list_contains(used, x))) = 1 THEN list_filter(wanted,
    lambda x: NOT list_contains(used, x))[1] END AS pos
    FROM w JOIN a ON a.rig = w.rig AND a.strict = w.strict AND a.o = w.o + 1))
SELECT a.rig, a.o AS "order", w.pos AS position, a.strict,
  CASE WHEN a.strict AND size > 0 THEN CASE WHEN w.pos IS NOT NULL THEN CASE WHEN a.ix IS NOT NULL AND file IS NOT NULL THEN 'image_index+file_url'
  WHEN a.ix IS NOT NULL THEN 'image_index' ELSE 'file_url' END END
    WHEN w.pos IS NULL THEN CASE WHEN file IS NOT NULL THEN 'event_file_url' ELSE 'generated_event_index' END
    WHEN list_contains(by_index, w.pos) THEN 'image_index' WHEN list_contains(by_name, w.pos) THEN 'file_url' ELSE 'list_order_fallback' END AS basis,
  coalesce(p.image, CASE WHEN NOT (a.strict AND size > 0) THEN coalesce(file, printf('image_%06d.jpg', coalesce(a.ix, a.o))) END) AS image,
  CASE WHEN a.strict AND size > 0 AND w.pos IS NULL THEN CASE WHEN a.ix IS NOT NULL AND file IS NOT NULL AND len(by_index) > 0 AND len(by_name) > 0
  AND len(wanted) = 0 THEN 'capture_index_conflicts_with_file' ELSE 'no_unique_image_match' END END AS reason
FROM a JOIN w ON w.rig = a.rig AND w.strict = a.strict AND w.o = a.o LEFT JOIN p ON p.rig = a.rig AND p.pos = w.pos"""


def _messages(spark, sf_dir):
    """events as messages of a thousand missions, each with sources of its own; some missions hold several."""
    n, u = F.col("event_id"), F.col("user_id")
    m = u % 199
    kind = F.element_at(F.array(*map(F.lit, ("CAMERA_IMAGE_CAPTURED", "GLOBAL_POSITION_INT", "ATTITUDE_QUATERNION", "GPS_RAW_INT", "GPS2_RAW", "CAMERA_TRIGGER",
        "HEARTBEAT"))), (1 + n % F.when(m % 3 == 0, 4).otherwise(7)).cast("int"))
    several = lambda of, field: F.when(m % 10 == of, 1 + n % 2).otherwise(1).alias(field)
    component = F.when(kind.isin(*images.CAPTURES), F.when(m % 10 == 3, 100 + n % 2).otherwise(100)).when(kind.isin(*images.POSES), F.when(m % 10 == 4, n % 2).otherwise(1)).otherwise(F.lit(1))
    return read(spark, sf_dir, "events").select(m.alias("mission"), n.alias("seq"), kind.alias("kind"), several(1, "system"), component.cast("long").alias("component"),
        F.when(m % 10 == 2, n % 3).when(m % 10 == 5, F.lit(None)).otherwise(F.lit(0)).cast("long").alias("camera"))


def source_selection(spark, sf_dir):
    """Each mission's sources or why there is no one, and how many messages are theirs."""
    rows = _messages(spark, sf_dir)
    chosen = images.sources(rows)
    kept = images.of_sources(rows, chosen).groupBy("mission").agg(F.count(F.lit(1)).alias("kept"))
    return chosen.join(kept, "mission", "left").select("*").fillna(0, ["kept"])


CHOSEN = """WITH m AS (SELECT user_id % 199 AS mission, event_id AS n, list_extract(['CAMERA_IMAGE_CAPTURED', 'GLOBAL_POSITION_INT', 'ATTITUDE_QUATERNION', 'GPS_RAW_INT',
  'GPS2_RAW', 'CAMERA_TRIGGER', 'HEARTBEAT'], 1 + event_id % CASE WHEN user_id % 199 % 3 = 0 THEN 4 ELSE 7 END) AS kind FROM events),
x AS (SELECT *, kind LIKE 'CAMERA%' AS shot, kind IN ('GLOBAL_POSITION_INT', 'ATTITUDE_QUATERNION') AS pose, kind LIKE 'GPS%' AS gps, CASE WHEN mission % 10 = 1 THEN 1 + n % 2 ELSE 1 END AS system,
  CASE WHEN kind LIKE 'CAMERA%' THEN CASE WHEN mission % 10 = 3 THEN 100 + n % 2 ELSE 100 END WHEN kind IN ('GLOBAL_POSITION_INT', 'ATTITUDE_QUATERNION') THEN CASE
  WHEN mission % 10 = 4 THEN n % 2 ELSE 1 END ELSE 1 END AS component,
  CASE WHEN mission % 10 = 2 THEN n % 3 WHEN mission % 10 = 5 THEN NULL ELSE 0 END AS camera FROM m),
g AS (SELECT mission, count(DISTINCT system) AS systems, min(system) AS system, count(DISTINCT camera) FILTER (shot) AS cameras, min(camera) FILTER (shot) AS camera FROM x GROUP BY 1),
y AS (SELECT x.*, g.camera AS one, cameras = 1 AS sure FROM x JOIN g USING (mission) WHERE NOT shot OR cameras <> 1 OR coalesce(x.camera = g.camera, false)),
h AS (SELECT mission, count(DISTINCT component) FILTER (shot) AS components, min(component) FILTER (shot) AS component, count(DISTINCT {'s': system,
  'c': component}) FILTER (pose) AS poses, count(DISTINCT {'k': kind, 's': system, 'c': component}) FILTER (gps) AS receivers, count(*) AS kept FROM y GROUP BY 1),
r AS (SELECT *, CASE WHEN systems > 1 THEN 'several_systems' WHEN cameras > 1 THEN 'several_cameras' WHEN components > 1 THEN 'several_capture_components'
  WHEN poses > 1 THEN 'several_navigation_sources' WHEN receivers > 1 THEN 'several_gps_sources' END AS reason FROM g JOIN h USING (mission))
SELECT mission, CASE WHEN systems = 1 THEN system END AS system, CASE WHEN cameras = 1 THEN camera END AS camera, CASE
  WHEN components = 1 THEN CAST(component AS BIGINT) END AS capture_component, reason, CASE WHEN reason IS NULL THEN kept ELSE 0 END AS kept FROM r"""
QUERIES = {"image_match": (image_match, WALK), "source_selection": (source_selection, CHOSEN)}
