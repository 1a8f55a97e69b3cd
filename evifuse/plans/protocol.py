"""Protocol, track and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.operators import protocol, tracks
from evifuse.sources.tables import OBSERVATIONS, observations, read

S = 1_000_000_000


def _items(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.when(F.col("doc_id") % 2 == 0,
        "D").otherwise("N")).alias("sample"))
    grouped = rows.withColumn("grp", protocol.block_group(F.col("sample")))
    return grouped.withColumn("partition", protocol.partition_of(F.col("grp")))


BUCKET = lambda x, n=10: f"(CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT) % {n})"
ITEMS = f"""items AS (SELECT *, CASE WHEN {BUCKET('grp')} <= 6 THEN 'train' WHEN {BUCKET('grp')} = 7 THEN 'validation' ELSE 'test' END AS partition FROM (
  SELECT doc_id, lang, source, lpad(CAST(doc_id AS VARCHAR), 6, '0') || CASE WHEN doc_id % 2 = 0 THEN 'D' ELSE 'N' END AS sample,
    CASE WHEN doc_id % 2 = 0 THEN 'd' ELSE 'n' END || '-block-' || CASE WHEN doc_id < 100000 THEN lpad(CAST(doc_id // 100 AS VARCHAR), 3, '0')
    ELSE CAST(doc_id // 100 AS VARCHAR) END AS grp FROM documents))"""


def hash_partition(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("partition", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("n_groups"))


def leakage_check(spark, sf_dir):
    """Partitions of single samples part their groups; those of groups do not."""
    rows = _items(spark, sf_dir)
    by_sample = protocol.leaks(rows.withColumn("partition", protocol.partition_of(F.col("sample")))).agg(F.count(F.lit(1)).alias("n_leaks"))
    by_group = protocol.leaks(rows).agg(F.count(F.lit(1)).alias("n_leaks"))
    return by_sample.withColumn("rule", F.lit("sample")).unionByName(by_group.withColumn("rule", F.lit("group")))


LEAK = f"""WITH {ITEMS}, b AS (SELECT grp, {BUCKET('sample')} AS k FROM items), s AS (SELECT grp FROM b GROUP BY grp HAVING count(DISTINCT CASE WHEN k <= 6 THEN 'a'
  WHEN k = 7 THEN 'b' ELSE 'c' END) > 1),
g AS (SELECT grp FROM items GROUP BY grp HAVING count(DISTINCT partition) > 1)
SELECT (SELECT count(*) FROM s) AS n_leaks, 'sample' AS rule UNION ALL SELECT (SELECT count(*) FROM g), 'group'"""


def manifest_digest(spark, sf_dir):
    return protocol.manifest(_items(spark, sf_dir), ["partition"], "sample")


def hash_rank_pool(spark, sf_dir):
    return protocol.hash_pool(_items(spark, sf_dir).withColumn("token", F.concat_ws(":", "lang", "sample")), ["lang"], "token", 16).select("lang", "sample", "place")


def set_comparison(spark, sf_dir):
    """Which rigs report which streams."""
    return protocol.set_comparison(observations(spark, sf_dir).select("rig", "stream"), "rig", "stream")


def union_repartition(spark, sf_dir):
    """Two published splits are united and dealt anew by group."""
    rows = _items(spark, sf_dir).drop("partition")
    first, second = rows.where("doc_id % 4 = 0").withColumn("split", F.lit("test")), rows.where("doc_id % 4 <> 0").withColumn("split", F.lit("train"))
    both = first.unionByName(second).withColumn("partition", protocol.partition_of(F.col("grp")))
    return both.groupBy("split", "partition").agg(F.count(F.lit(1)).alias("n"))


def set_difference(spark, sf_dir):
    """Labelled documents in both, in one and in neither of two selections."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    labels = read(spark, sf_dir, "labels").select("doc_id")
    both, only = docs.intersect(labels).agg(F.count(F.lit(1)).alias("n")), docs.exceptAll(labels).agg(F.count(F.lit(1)).alias("n"))
    return both.withColumn("kind", F.lit("both")).unionByName(only.withColumn("kind", F.lit("unlabelled")))


def _points(spark, sf_dir):
    return observations(spark, sf_dir).select(F.col("rig").alias("track"), "t", "seq", "v")


POINTS = "pts AS (SELECT rig AS track, t, seq, v FROM obs)"


def track_segments(spark, sf_dir):
    rows = tracks.segments(_points(spark, sf_dir), 6 * 3600 * S)
    return rows.groupBy("track", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


SEGMENTS = f"""WITH {OBSERVATIONS}, {POINTS}, b AS (SELECT *, CASE WHEN t - lag(t) OVER w BETWEEN 0
  AND {6 * 3600 * S} THEN 0 ELSE 1 END AS broken FROM pts WINDOW w AS (PARTITION BY track ORDER BY t, seq)),
s AS (SELECT *, CAST(sum(broken) OVER (PARTITION BY track ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM b)
SELECT track, segment, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY 1, 2"""


def track_latest(spark, sf_dir):
    return tracks.latest(_points(spark, sf_dir))


def object_retention(spark, sf_dir):
    """The newest eight points of the last week of each track; cap and age are the feature."""
    return tracks.retained(_points(spark, sf_dir), 7 * 86400 * S, 8).select("track", "seq", "place")


def layer_retention(spark, sf_dir):
    """What each layer of points (a stream's events, some unlocated) holds at its end: the last week, fifty at most; cap and age are the feature."""
    rows = observations(spark, sf_dir).select(F.col("stream").alias("layer"), "seq", F.when(F.col("seq") % 23 != 0, F.col("t") + (F.col("seq") % 7) * (86400 * S)).alias("t"), "rig")
    return tracks.layer_retained(rows, 7 * 86400 * S, LAYER)


LAYER = 50
#: Arrivals one after another: what is too old falls, then what is too much.
LAYERED = f"""WITH RECURSIVE {OBSERVATIONS}, p AS (SELECT stream AS layer, seq, rig, CASE
  WHEN seq % 23 <> 0 THEN t + (seq % 7) * {86400 * S} END AS t, row_number() OVER (PARTITION BY stream ORDER BY seq) AS k, max(CASE
  WHEN seq % 23 <> 0 THEN t + (seq % 7) * {86400 * S} END) OVER (PARTITION BY stream ORDER BY seq) AS newest FROM obs),
w AS (SELECT layer, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(seq BIGINT, t BIGINT)[]) AS held FROM p GROUP BY layer
  UNION ALL
  SELECT p.layer, p.k, list_slice(list_filter(list_append(w.held,
  {{'seq': p.seq, 't': p.t}}), lambda x: x.t IS NULL OR x.t >= newest - {7 * 86400 * S}), -{LAYER}, -1) FROM w JOIN p ON p.layer = w.layer AND p.k = w.k + 1),
e AS (SELECT layer, unnest(arg_max(held, k)) AS x FROM w GROUP BY layer)
SELECT e.layer, e.x.seq AS seq, p.t, p.rig FROM e JOIN p ON p.layer = e.layer AND p.seq = e.x.seq"""


def record_digest(spark, sf_dir):
    """SHA-256 of each conversation turn as canonical JSON, nested."""
    rows = read(spark, sf_dir, "conversations")
    value = F.struct(F.col("turn").alias("turn"), F.struct("text", "role", F.lit(None).cast("string").alias("note")).alias("message"),
        F.array(F.struct(F.col("conv_id").alias("id"), (F.col("turn") / F.lit(4.0)).alias("at"))).alias("chain"))
    kind = rows.select(value.alias("v")).schema["v"].dataType
    return rows.select("conv_id", "turn", F.sha2(protocol.canonical_json(value, kind), 256).alias("digest"))


RECORD = """SELECT conv_id, turn, sha256('{"chain":[{"at":' || CAST(turn / 4e0 AS VARCHAR) || ',"id":' || conv_id || '}],"message":{"note":null,"role":' || CAST(to_json(role) AS VARCHAR) || ',"text":' || CAST(to_json(text) AS VARCHAR) || '},"turn":' || turn || '}') AS digest FROM conversations"""


def manifest_reconciliation(spark, sf_dir):
    """Labelled documents as expected samples, all documents but some as outputs; some come twice, some failures are declared."""
    name = lambda c: F.concat(F.lit("sample-"), F.col(c).cast("string"))
    labels, docs = read(spark, sf_dir, "labels").select(name("doc_id").alias("sample"), "doc_id"), read(spark, sf_dir, "documents").select(name("doc_id").alias("sample"), "doc_id")
    outputs = docs.where("doc_id % 13 <> 5").join(labels.select("sample").distinct(), "sample", "left_semi").unionByName(docs.where("doc_id % 29 = 3"))
    failures = labels.where("doc_id % 2 = 1").select("sample", F.concat(F.lit("code "), F.col("doc_id") % 4).alias("reason"))
    return protocol.reconciled(labels.select("sample"), outputs.select("sample"), failures)


RECONCILED = """WITH e AS (SELECT DISTINCT doc_id FROM labels), o AS (SELECT doc_id, sum(n) AS n FROM (
    SELECT doc_id, count(*) AS n FROM documents WHERE doc_id % 13 <> 5 AND doc_id IN (SELECT doc_id FROM e) GROUP BY 1 UNION ALL SELECT doc_id, count(*) FROM documents
    WHERE doc_id % 29 = 3 GROUP BY 1) GROUP BY 1),
b AS (SELECT coalesce(e.doc_id, o.doc_id) AS d, e.doc_id IS NOT NULL AS wanted, coalesce(n, 0) AS n FROM e FULL JOIN o ON e.doc_id = o.doc_id)
SELECT 'sample-' || d AS sample, CASE WHEN wanted AND n = 0 THEN CASE WHEN d % 2 = 1 THEN 'external runtime failure: code ' || d % 4 ELSE 'missing output entry' END
  WHEN NOT wanted THEN 'unexpected output entry' ELSE 'invalid or duplicate sample_id' END AS reason,
  CASE WHEN wanted AND n = 0 AND d % 2 = 1 THEN 'runtime' ELSE 'integrity_or_completeness' END AS failure_class FROM b WHERE NOT (wanted AND n = 1)"""
NOW = 1_706_000_000 * S


def freshness_state(spark, sf_dir):
    rows = _points(spark, sf_dir).withColumn("t", F.when(F.col("seq") % 19 != 0, F.col("t")))
    state = tracks.freshness(F.col("t"), NOW, 3 * 86400 * S)
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def geo_txt_format(spark, sf_dir):
    """Lines of a georeferencing text file."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(k.alias("id"), F.regexp_replace("s_name", "#", "_").alias("name"), (7 + k / F.lit(1000.0)).alias("lon"),
        (46 + k / F.lit(2000.0)).alias("lat"), (F.col("s_acctbal") / 10).alias("alt"))
    return rows.select("id", F.format_string("%s.jpg %.10f %.10f %.3f", "name", "lon", "lat", "alt").alias("line"))


def geojson_features(spark, sf_dir):
    """Point features; nanoseconds are texts, as JSON numbers would lose digits."""
    rows = _points(spark, sf_dir)
    geometry = F.struct(F.lit("Point").alias("type"), F.array((F.col("track") / F.lit(8.0)), F.col("seq") / F.lit(16.0)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("t").cast("string").alias("t_ns")).alias("properties"))
    return rows.select("seq", F.sha2(F.to_json(feature), 256).alias("digest"))


GEOJSON = f"""WITH {OBSERVATIONS}, {POINTS}
SELECT seq, sha256('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(track / 8e0 AS VARCHAR) || ',' || CAST(seq / 16e0 AS VARCHAR) || ']}},"properties":{{"t_ns":"' || CAST(t AS VARCHAR) || '"}}}}') AS digest FROM pts"""

QUERIES = {
    "hash_partition": (hash_partition, f"WITH {ITEMS} SELECT partition, lang, count(*) AS n, count(DISTINCT grp) AS n_groups FROM items GROUP BY 1, 2"),
    "leakage_check": (leakage_check, LEAK),
    "manifest_digest": (manifest_digest, f"WITH {ITEMS} SELECT partition, count(*) AS n, sha256(string_agg(sample, chr(10) ORDER BY sample)) AS digest FROM items GROUP BY 1"),
    "hash_rank_pool": (
        hash_rank_pool,
        f"WITH {ITEMS}, r AS (SELECT lang, sample, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256(lang || ':' || sample), lang || ':' || sample) AS INTEGER) AS place FROM items) SELECT * FROM r WHERE place <= 16",
    ),
    "set_comparison": (set_comparison, f"WITH {OBSERVATIONS}, h AS (SELECT rig, string_agg(DISTINCT stream, '+' ORDER BY stream) AS kinds FROM obs GROUP BY rig) SELECT kinds, count(*) AS n FROM h GROUP BY 1"),
    "union_repartition": (
        union_repartition,
        f"WITH {ITEMS}, u AS (SELECT *, 'test' AS split FROM items WHERE doc_id % 4 = 0 UNION ALL SELECT *, 'train' FROM items WHERE doc_id % 4 <> 0) SELECT split, partition, count(*) AS n FROM u GROUP BY 1, 2",
    ),
    "set_difference": (
        set_difference,
        "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n, 'both' AS kind UNION ALL SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)), 'unlabelled'",
    ),
    "track_segments": (track_segments, SEGMENTS),
    "track_latest": (track_latest, f"WITH {OBSERVATIONS}, {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t DESC, seq DESC) AS rn FROM pts) SELECT track, t, seq, v FROM r WHERE rn = 1"),
    "object_retention": (
        object_retention,
        f"WITH {OBSERVATIONS}, {POINTS}, y AS (SELECT *, max(t) OVER (PARTITION BY track) AS newest FROM pts), r AS (SELECT track, seq, CAST(row_number() OVER (PARTITION BY track ORDER BY t DESC, seq DESC) AS INTEGER) AS place FROM y WHERE t >= newest - {7 * 86400 * S}) SELECT * FROM r WHERE place <= 8",
    ),
    "layer_retention": (layer_retention, LAYERED),
    "record_digest": (record_digest, RECORD),
    "manifest_reconciliation": (manifest_reconciliation, RECONCILED),
    "freshness_state": (
        freshness_state,
        f"WITH {OBSERVATIONS}, f AS (SELECT CASE WHEN seq % 19 = 0 THEN 'unverified' WHEN t > {NOW + 5 * S} THEN 'future' WHEN t < {NOW - 3 * 86400 * S} THEN 'stale' ELSE 'fresh' END AS state FROM obs) SELECT state, count(*) AS n FROM f GROUP BY 1",
    ),
    "geo_txt_format": (
        geo_txt_format,
        "SELECT s_suppkey AS id, printf('%s.jpg %.10f %.10f %.3f', replace(s_name, '#', '_'), 7 + s_suppkey / 1000e0, 46 + s_suppkey / 2000e0, s_acctbal / 10) AS line FROM supplier",
    ),
    "geojson_features": (geojson_features, GEOJSON),
}
