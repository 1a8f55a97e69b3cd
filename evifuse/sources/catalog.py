"""Dataset catalogs from file listings, annotations, prediction cases and pose records.

A listing is a table (path). A missing partner never drops a record silently: inner joins are what pairing means,
optional annotations stay null, and cases without a prediction carry a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def split_path(files: DataFrame) -> DataFrame:
    """path with its folder names counted from the end (parent, grandparent), stem and lower-cased suffix."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select("path", F.try_element_at(parts, F.lit(-2)).alias("parent"), F.try_element_at(parts, F.lit(-3)).alias("grandparent"), F.regexp_replace(name,
        r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"))


def common_id(stem: Column) -> Column:
    """Stems of one capture differ by their modality only."""
    return F.regexp_replace(stem, r"_(?:eo|thermal|mask)-", "_frame-")


def pair(files: DataFrame, visible: str, thermal: str, attached: str | None = None, key=lambda stem: stem) -> DataFrame:
    """split, sample, visible, thermal, annotation: pairs by stem within a split; the annotation may be null.

    Folders are named split/modality or modality/split; ``parent`` must be the modality.
    """
    named = split_path(files).withColumn("sample", key(F.col("stem"))).withColumnRenamed("grandparent", "split")
    of = lambda kind, name: named.where(F.col("parent") == kind).select("split", "sample", F.col("path").alias(name))
    both = of(visible, "visible").join(of(thermal, "thermal"), ["split", "sample"])
    return both.join(of(attached, "annotation"), ["split", "sample"], "left") if attached else both.withColumn("annotation", F.lit(None).cast("string"))


def numbered(records: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Positions of the records in their path's order, from 0."""
    return records.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy(path)) - 1)


def voc_boxes(annotations: DataFrame) -> DataFrame:
    """Boxes of VOC XML texts (sample, xml): clamped to the image and normalized; malformed and empty ones fall."""
    number = lambda tag: F.xpath("xml", F.lit(f"//object/bndbox/{tag}/text()"))
    size = lambda tag: F.xpath_double("xml", F.lit(f"//size/{tag}"))
    zipped = F.arrays_zip(F.xpath("xml", F.lit("//object/name/text()")).alias("label"), *(number(t).alias(t) for t in ("xmin", "ymin", "xmax", "ymax")))
    rows = annotations.select("sample", size("width").alias("w"), size("height").alias("h"), F.posexplode(zipped).alias("place", "o"))
    x = lambda c: F.least(F.greatest(F.col(f"o.{c}").try_cast("double"), F.lit(0.0)), F.col("w"))
    y = lambda c: F.least(F.greatest(F.col(f"o.{c}").try_cast("double"), F.lit(0.0)), F.col("h"))
    boxes = rows.select("sample", "place", "o.label", (x("xmin") / F.col("w")).alias("x"), (y("ymin") / F.col("h")).alias("y"),
        ((x("xmax") - x("xmin")) / F.col("w")).alias("width"), ((y("ymax") - y("ymin")) / F.col("h")).alias("height"))
    return boxes.where("width > 0 AND height > 0")


def yolo_boxes(annotations: DataFrame, classes: list[str]) -> DataFrame:
    """Boxes of YOLO texts (sample, text): centres to corners, clipped; only lines of five fields; unknown ids are ``class N``."""
    lines = annotations.select("sample", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    fields = lines.select("sample", "place", F.split(F.trim("line"), r"\s+").alias("f")).where(F.size("f") == 5)
    v = [F.col("f")[i].try_cast("double") for i in range(5)]
    number = F.col("f")[0].try_cast("int")
    known = F.array(*map(F.lit, classes))
    label = F.coalesce(F.when(number >= 0, F.get(known, number)), F.concat(F.lit("class "), number.cast("string")))
    low = lambda c, s: F.greatest(c - s / 2, F.lit(0.0))
    high = lambda c, s: F.least(c + s / 2, F.lit(1.0))
    boxes = fields.select("sample", "place", label.alias("label"), low(v[1], v[3]).alias("x"), low(v[2], v[4]).alias("y"), (high(v[1], v[3]) - low(v[1],
        v[3])).alias("width"), (high(v[2], v[4]) - low(v[2], v[4])).alias("height"))
    return boxes.where("width > 0 AND height > 0 AND label IS NOT NULL")


def prediction_cases(truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every truth with its prediction or the reason why there is none; repeated stems are a reason, too."""
    once = predictions.groupBy("stem").agg(F.min("path").alias("prediction"), F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("n").isNull(), "missing_prediction").when(F.col("n") > 1, "duplicate_prediction")
    joined = truths.join(once, "stem", "left").withColumn("failure_reason", reason).drop("n")
    return joined.withColumn("prediction", F.when(F.col("failure_reason").isNull(), F.col("prediction")))


POSE = "image_name string, image_index bigint, latitude_deg double, longitude_deg double, altitude_msl_m double, capture_utc_ns bigint, capture_monotonic_ns bigint, clock_domain string, horizontal_accuracy_m double, vertical_accuracy_m double, fix_type int"


def pose_records(spark: SparkSession, path: str) -> DataFrame:
    """Pose rows of JSON files: a list, or a list under ``records``, flat or with a nested position; with a reject reason."""
    position = "position struct<latitude_deg:double,longitude_deg:double,altitude_msl_m:double>"
    schema = f"{POSE}, {position}, records array<struct<{POSE.replace(' ', ':').replace(',:', ',')},{position.replace(' ', ':', 1)}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    own = raw.where("records IS NULL").drop("records")
    rows = own.unionByName(raw.where("records IS NOT NULL").select(F.explode("records").alias("r")).select("r.*"))
    for c in ("latitude_deg", "longitude_deg", "altitude_msl_m"):
        rows = rows.withColumn(c, F.coalesce(c, F.col("position")[c]))
    reason = F.coalesce(
        F.when(F.col("image_name").isNull(), "unknown_image"),
        F.when(F.col("latitude_deg").isNull() | (F.abs("latitude_deg") > 90), "latitude_outside_limits"),
        F.when(F.col("longitude_deg").isNull() | (F.abs("longitude_deg") > 180), "longitude_outside_limits"),
        F.when(F.col("capture_utc_ns").isNull() & F.col("capture_monotonic_ns").isNull(), "unknown_capture_time"),
    )
    return rows.drop("position").withColumn("reject_reason", reason)
