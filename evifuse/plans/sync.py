"""Synchronization and telemetry queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evifuse.operators import sync
from evifuse.sources.tables import OBSERVATIONS, observations, read

HOUR = 3_600_000_000_000
POLICY = sync.Policy(exact=10 * 60_000_000_000, fusion=4 * HOUR, stale=6 * HOUR)
OTHERS = ["error", "purchase", "signup", "view"]


def sync_nearest_state(spark, sf_dir):
    return sync.nearest(observations(spark, sf_dir), "click", POLICY)


NEAREST = f"""WITH {OBSERVATIONS}, refs AS (SELECT * FROM obs WHERE stream = 'click'),
streams AS (SELECT DISTINCT stream FROM obs WHERE stream <> 'click'),
met AS (
  SELECT r.seq AS ref, o.stream, o.seq, o.t, o.unc,
    row_number() OVER (PARTITION BY r.seq, o.stream ORDER BY abs(o.t - r.t) + coalesce(o.unc + r.unc, {POLICY.stale + 1}), o.seq) AS rn
  FROM refs r JOIN obs o ON o.rig = r.rig AND o.domain = r.domain AND o.stream <> 'click' AND abs(o.t - r.t) <= {POLICY.stale}),
sel AS (
  SELECT r.seq AS ref, r.rig, s.stream, m.seq, m.t - r.t AS skew_ns, abs(m.t - r.t) + m.unc + r.unc AS effective_ns,
    CASE WHEN m.seq IS NULL THEN CASE WHEN (r.rig, s.stream) IN (SELECT (rig, stream) FROM obs) AND (r.rig, s.stream, r.domain) NOT IN (SELECT (rig, stream, domain)
    FROM obs) THEN 'incompatible_clock_domain' ELSE 'missing' END WHEN m.unc + r.unc IS NULL THEN 'unsynchronized'
      WHEN abs(m.t - r.t) + m.unc + r.unc > {POLICY.stale} THEN 'missing' WHEN abs(m.t - r.t) + m.unc + r.unc <= {POLICY.exact} THEN 'exact'
      WHEN m.t < r.t THEN 'late' WHEN m.t > r.t THEN 'future' ELSE 'bounded_skew' END AS state
  FROM refs r CROSS JOIN streams s LEFT JOIN met m ON m.ref = r.seq AND m.stream = s.stream AND m.rn = 1)
"""


def sync_required_rollup(spark, sf_dir):
    return sync.rollup(sync.nearest(observations(spark, sf_dir), "click", POLICY), ["view", "error"], POLICY)


ROLLUP = NEAREST + f""", c AS (
  SELECT ref, count(*) FILTER (state NOT IN ('missing', 'incompatible_clock_domain')) AS n_present, count(effective_ns) AS n_bounded,
    max(abs(skew_ns)) AS skew, max(effective_ns) AS effective FROM sel WHERE stream IN ('view', 'error') GROUP BY ref)
SELECT ref, n_present, CASE WHEN n_present = 2 AND n_bounded = 2 THEN skew END AS max_skew_ns,
  CASE WHEN n_present = 2 AND n_bounded = 2 THEN effective END AS max_effective_ns,
  coalesce(CASE WHEN n_present = 2 AND n_bounded = 2 THEN effective END <= {POLICY.fusion}, false) AS eligible FROM c"""


def domain_incompatible(spark, sf_dir):
    rows = observations(spark, sf_dir).groupBy("rig", "stream")
    mixed = rows.agg(F.count_distinct("domain").alias("n_domains"), F.count(F.lit(1)).alias("n"), F.count("unc").alias("n_known"))
    reason = sync.first_reason((F.col("n_domains") > 1, "mixed_clock_domains"), (F.col("n_known") < F.col("n"), "unknown_uncertainty"))
    return mixed.withColumn("reason", reason)


DOMAIN = f"""WITH {OBSERVATIONS} SELECT *, CASE WHEN n_domains > 1 THEN 'mixed_clock_domains' WHEN n_known < n THEN 'unknown_uncertainty' END AS reason
FROM (SELECT rig, stream, count(DISTINCT domain) AS n_domains, count(*) AS n, count(unc) AS n_known FROM obs GROUP BY rig, stream)"""


def _bracketed(spark, sf_dir):
    rows = observations(spark, sf_dir)
    targets = rows.where("stream = 'click'").select("rig", F.col("seq").alias("target"), "t")
    found = sync.brackets(rows.where("stream = 'view'").select("rig", "seq", "t", "v"), targets, ["rig"])
    return sync.interpolated(found, 24 * HOUR)


BRACKET = f"""WITH {OBSERVATIONS}, c AS (SELECT * FROM obs WHERE stream = 'click'), s AS (SELECT * FROM obs WHERE stream = 'view'),
lo AS (SELECT c.rig, c.seq AS target, c.t, s.t AS lo_t, s.v AS lo_v FROM c ASOF LEFT JOIN s ON c.rig = s.rig AND c.t >= s.t),
hi AS (SELECT c.seq AS target, s.t AS hi_t, s.v AS hi_v FROM c ASOF LEFT JOIN s ON c.rig = s.rig AND c.t <= s.t),
b AS (SELECT *, hi_t - lo_t AS span FROM lo JOIN hi USING (target)),
r AS (SELECT *, CASE WHEN lo_t IS NULL THEN 'no_sample_before' WHEN hi_t IS NULL THEN 'no_sample_after' WHEN span > {24 * HOUR} THEN 'gap_exceeds_limit' END AS reason FROM b),
i AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN span = 0 THEN 0e0 ELSE CAST(t - lo_t AS DOUBLE) / CAST(span AS DOUBLE) END END AS fraction FROM r)
"""


def bracket_interpolate(spark, sf_dir):
    value = F.round(F.col("value"), 6)
    return _bracketed(spark, sf_dir).where("reason IS NULL").select("target", "rig", "lo_t", "hi_t", value.alias("value"))


def motion_bound(spark, sf_dir):
    rows = _bracketed(spark, sf_dir).where("reason IS NULL")
    hours = F.col("span") / F.lit(float(HOUR))
    return rows.select("target", F.round(sync.motion_bound(hours, F.col("fraction"), 40.0), 6).alias("bound"))


def gap_rejects(spark, sf_dir):
    return _bracketed(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def worst_quality_pair(spark, sf_dir):
    """Endpoint qualities of a bracket combine to the worse one; one unknown endpoint makes the pair unknown."""
    rows = observations(spark, sf_dir).where("stream = 'view'").select("rig", "seq", "t", F.col("unc").cast("double").alias("v"))
    targets = observations(spark, sf_dir).where("stream = 'click'").select("rig", F.col("seq").alias("target"), "t")
    known = (F.col("lo_v") + F.col("hi_v")).isNotNull()
    found = sync.brackets(rows, targets, ["rig"])
    return found.select("target", F.when(known, F.greatest("lo_v", "hi_v")).alias("worst_unc"), F.when(known, F.least("lo_v", "hi_v")).alias("best_unc"))


WORST = f"""WITH {OBSERVATIONS}, c AS (SELECT * FROM obs WHERE stream = 'click'), s AS (SELECT * FROM obs WHERE stream = 'view'),
lo AS (SELECT c.seq AS target, CAST(s.unc AS DOUBLE) AS a FROM c ASOF LEFT JOIN s ON c.rig = s.rig AND c.t >= s.t),
hi AS (SELECT c.seq AS target, CAST(s.unc AS DOUBLE) AS b FROM c ASOF LEFT JOIN s ON c.rig = s.rig AND c.t <= s.t)
SELECT target, CASE WHEN a + b IS NOT NULL THEN greatest(a, b) END AS worst_unc, CASE WHEN a + b IS NOT NULL THEN least(a, b) END AS best_unc FROM lo JOIN hi USING (target)"""


def conflict_samples(spark, sf_dir):
    """Minutes in which a source reports different values."""
    rows = observations(spark, sf_dir).withColumn("minute", F.floor(F.col("t") / 3_600_000_000_000).cast("long"))
    return sync.conflicts(rows, ["rig", "stream", "minute"], "v")


def boot_reset_detect(spark, sf_dir):
    """Clock resets, with the records arriving in another order than they were taken."""
    rows = observations(spark, sf_dir).withColumn("seq", F.col("seq") * 7919 % 100003)
    return sync.went_back(rows, ["rig", "stream"]).select("seq", "rig", "stream", (F.col("before") - F.col("t")).alias("back_ns"))


def capture_supersede(spark, sf_dir):
    """Triggers (views) without a capture (purchase) of the same index or the same hour."""
    rows = observations(spark, sf_dir).select("seq", "rig", "stream", (F.col("seq") % 97).alias("idx"), F.floor(F.col("t") / HOUR).cast("long").alias("hour"))
    triggers, captures = rows.where("stream = 'view'").drop("stream"), rows.where("stream = 'purchase'")
    return sync.superseded(triggers, captures, [["rig", "idx"], ["rig", "hour"]])


def image_pose_fullouter(spark, sf_dir):
    """Exact one-to-one match of images (labels) and poses (documents), both sides' misses and repeats counted."""
    images = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("name")).agg(F.count(F.lit(1)).alias("n_images"))
    poses = read(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("name")).agg(F.count(F.lit(1)).alias("n_poses"))
    both = images.join(poses, "name", "full_outer")
    status = sync.first_reason((F.col("n_poses").isNull(), "missing_pose"), (F.col("n_images").isNull(), "missing_image"), ((F.col("n_images") > 1) | (F.col("n_poses") > 1), "duplicate"))
    return both.groupBy(F.coalesce(status, F.lit("matched")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def pair_presence(spark, sf_dir):
    """How many rigs report which number of streams each day."""
    rows = observations(spark, sf_dir).withColumn("day", F.floor(F.col("t") / (24 * HOUR)).cast("long"))
    each = rows.groupBy("rig", "day").agg(F.count_distinct("stream").alias("n_streams"))
    return each.groupBy("n_streams").agg(F.count(F.lit(1)).alias("n_pairs"), (F.sum((F.col("n_streams") == 5).cast("long"))).alias("n_complete"))


def json_payload_extract(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"))


def html_tag_strip(spark, sf_dir):
    """Text of a page's annotations: tags removed, runs of white space made one."""
    bare = F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"[ \n\r\t]+", " ")
    return read(spark, sf_dir, "pages").select("page_id", F.length(bare).cast("long").alias("n_chars"), F.sha2(bare, 256).alias("digest"))


def failure_summary(spark, sf_dir):
    """Count and the first examples of each reason: the first eight of each part of a reason, then of those the first eight."""
    rows = _bracketed(spark, sf_dir).where("reason IS NOT NULL").select("reason", "target", F.pmod(F.xxhash64("target"), F.lit(64)).alias("part"))
    part = Window.partitionBy("reason", "part")
    numbered = rows.select("*", F.row_number().over(part.orderBy("target")).alias("place"))
    parts = numbered.groupBy("reason", "part").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("place") <= 8, F.col("target"))).alias("first"))
    first = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 8)
    return parts.groupBy("reason").agg(F.sum("n").alias("n"), F.array_join(first, ",").alias("examples"))


QUERIES = {
    "sync_nearest_state": (sync_nearest_state, NEAREST + "SELECT * FROM sel"),
    "sync_required_rollup": (sync_required_rollup, ROLLUP),
    "domain_incompatible": (domain_incompatible, DOMAIN),
    "bracket_interpolate": (bracket_interpolate, BRACKET + "SELECT target, rig, lo_t, hi_t, round(lo_v + (hi_v - lo_v) * fraction, 6) AS value FROM i WHERE reason IS NULL"),
    "motion_bound": (motion_bound, BRACKET + f"SELECT target, round(20e0 * (span / {HOUR}e0) * (span / {HOUR}e0) * fraction * (1 - fraction), 6) AS bound FROM i WHERE reason IS NULL"),
    "gap_rejects": (gap_rejects, BRACKET + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1"),
    "worst_quality_pair": (worst_quality_pair, WORST),
    "conflict_samples": (
        conflict_samples,
        f"WITH {OBSERVATIONS} SELECT rig, stream, t // 3600000000000 AS minute, count(*) AS n, count(DISTINCT v) AS n_values FROM obs GROUP BY ALL HAVING count(DISTINCT v) > 1",
    ),
    "boot_reset_detect": (
        boot_reset_detect,
        f"WITH {OBSERVATIONS}, a AS (SELECT * REPLACE (seq * 7919 % 100003 AS seq) FROM obs), l AS (SELECT *, lag(t) OVER (PARTITION BY rig, stream ORDER BY seq) AS before FROM a) SELECT seq, rig, stream, before - t AS back_ns FROM l WHERE before > t",
    ),
    "capture_supersede": (
        capture_supersede,
        f"""WITH {OBSERVATIONS}, e AS (SELECT seq, rig, stream, seq % 97 AS idx, t // {HOUR} AS hour FROM obs)
SELECT seq, rig, idx, hour FROM e a WHERE stream = 'view'
  AND NOT EXISTS (SELECT 1 FROM e b WHERE b.stream = 'purchase' AND b.rig = a.rig AND b.idx = a.idx)
  AND NOT EXISTS (SELECT 1 FROM e b WHERE b.stream = 'purchase' AND b.rig = a.rig AND b.hour = a.hour)""",
    ),
    "image_pose_fullouter": (
        image_pose_fullouter,
        """WITH i AS (SELECT doc_id AS name, count(*) AS n_images FROM labels GROUP BY 1), p AS (SELECT doc_id AS name, count(*) AS n_poses FROM documents GROUP BY 1)
SELECT CASE WHEN n_poses IS NULL THEN 'missing_pose' WHEN n_images IS NULL THEN 'missing_image' WHEN n_images > 1 OR n_poses > 1 THEN 'duplicate' ELSE 'matched' END AS status, count(*) AS n
FROM i FULL JOIN p USING (name) GROUP BY 1""",
    ),
    "pair_presence": (
        pair_presence,
        f"""WITH {OBSERVATIONS}, e AS (SELECT rig, t // {24 * HOUR} AS day, count(DISTINCT stream) AS n_streams FROM obs GROUP BY 1, 2)
SELECT n_streams, count(*) AS n_pairs, count(*) FILTER (n_streams = 5) AS n_complete FROM e GROUP BY 1""",
    ),
    "json_payload_extract": (
        json_payload_extract,
        """WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS low, max(k) AS high FROM e GROUP BY 1""",
    ),
    "html_tag_strip": (
        html_tag_strip,
        r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \n\r\t]+', ' ', 'g') AS bare FROM pages)
SELECT page_id, length(bare) AS n_chars, sha256(bare) AS digest FROM p""",
    ),
    "failure_summary": (failure_summary, BRACKET + "SELECT reason, count(*) AS n, array_to_string(list_slice(list_sort(list(target)), 1, 8), ',') AS examples FROM r WHERE reason IS NOT NULL GROUP BY 1"),
}
