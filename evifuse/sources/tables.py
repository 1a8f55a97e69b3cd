"""Driver tables in the engine's own terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts) * 1000


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sensor observations: seq, rig, stream, t (ns), unc (ns or unknown), domain, v.

    Uncertainties and clock domains follow from the event's number, so that unknown ones and a second domain occur.
    """
    n = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        n.alias("seq"),
        F.col("user_id").alias("rig"),
        F.col("event_type").alias("stream"),
        nanoseconds(F.col("ts")).alias("t"),
        F.when(n % 11 != 0, (n % 7) * 60_000_000_000).alias("unc"),
        F.when(n % 17 == 0, "ptp-b").otherwise("ptp-a").alias("domain"),
        F.col("value").alias("v"),
    )


#: The same for DuckDB.
OBSERVATIONS = """obs AS (
  SELECT event_id AS seq, user_id AS rig, event_type AS stream, epoch_us(ts) * 1000 AS t,
    CASE WHEN event_id % 11 <> 0 THEN (event_id % 7) * 60000000000 END AS unc,
    CASE WHEN event_id % 17 = 0 THEN 'ptp-b' ELSE 'ptp-a' END AS domain, value AS v
  FROM events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8x8 rasters: frame, y, x, v in [0, 1]."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return rows.select(
        F.col("vec_id").alias("frame"),
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        (F.col("i") % 8).cast("int").alias("x"),
        F.least(F.greatest(F.col("e").cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)).alias("v"),
    )


#: The same for DuckDB.
PIXELS = """px AS (
  SELECT vec_id AS frame, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, least(greatest(CAST(e AS DOUBLE) + 0.5, 0), 1) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to documents as risks and scores: id, grp, score (ties occur), risk (0 or 1)."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("grp"),
        ((F.col("n_chars") % 37) / F.lit(36.0)).alias("score"),
        F.when((F.col("n_chars") + F.col("doc_id")) % 37 < F.col("n_chars") % 37, 1).otherwise(0).alias("risk"),
    )


#: The same for DuckDB.
SCORED = """scored AS (
  SELECT doc_id AS id, source AS grp, CAST(n_chars % 37 AS DOUBLE) / 36e0 AS score,
    CASE WHEN (n_chars + doc_id) % 37 < n_chars % 37 THEN 1 ELSE 0 END AS risk
  FROM labels JOIN documents USING (doc_id))"""
