"""Detected objects through the frames that a map accepted: where they lie on the ground, how surely, or why not.

Accepted frames are a relation of their own: who was taken when, as which source, with which pose. An object looks up the frame that it was seen
in, as it was when the object arrived: a frame accepted later does not count. A mission's frames are never gathered; the
lookup is an equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.functions import frames, geo
from evifuse.functions.ranges import numbered
from evifuse.operators.sync import first_reason


def contexts(accepted: DataFrame) -> DataFrame:
    """``accepted`` (mission, seq, frame, ...) with source_index, a frame's place among its mission's by arrival."""
    places = numbered(accepted.select("mission", "seq"), "mission", "seq")
    first = places.groupBy("mission").agg(F.min("number").alias("_first"))
    return accepted.join(places.join(first, "mission").select("mission", "seq", (F.col("number") - F.col("_first")).alias("source_index")), ["mission", "seq"])


def anchored(boxes: DataFrame) -> DataFrame:
    """Adds u and v: the middle of a box's lower edge, where an object stands. Boxes (x, y, w, h) without an area have none."""
    real = (F.col("w") > 0) & (F.col("h") > 0)
    return boxes.withColumns({"u": F.when(real, F.col("x") + F.col("w") / 2), "v": F.when(real, F.col("y") + F.col("h"))})


def located(objects: DataFrame, context: DataFrame, camera: dict, origin: tuple, ground: float, geoid: float, least_cosine: float, most_range: float, most_sigma: float) -> DataFrame:
    """A row for each object (mission, object, arrival, frame, calibration, u, v, pixel_sigma): reason, or source_index, t, east, north, lat, lon, altitude above the sea and sigma.

    context: ``contexts`` of rows with mission, seq, frame, t, pose_t, e, n, up, optical (w, x, y, z), se, sn, su, speed, turn, attitude_sigma. camera: fx, fy, cx, cy, rms, calibration.
    Only frames that arrived before the object count. origin: latitude, longitude, height of the local plane.
    """
    known = context.select("mission", "frame", F.col("seq").alias("_seq"), "source_index", "t", *(F.col(c).alias(f"_{c}") for c in ("pose_t", "e", "n", "up", "optical",
        "se", "sn", "su", "speed", "turn", "attitude_sigma")))
    rows = objects.join(known, ["mission", "frame"], "left").withColumn("_known", F.coalesce(F.col("_seq") < F.col("arrival"), F.lit(False)))
    q = [F.col("_optical")[i] for i in range(4)]
    ray = frames.pixel_ray(F.col("u"), F.col("v"), *(F.lit(float(camera[c])) for c in ("fx", "fy", "cx", "cy")), q)
    rows = rows.withColumns(dict(zip(("_re", "_rn", "_ru"), ray)))
    reach, east, north = geo.ground_hit((F.col("_e"), F.col("_n"), F.col("_up")), (F.col("_re"), F.col("_rn"), F.col("_ru")), F.lit(ground), least_cosine, most_range)
    rows = rows.withColumns({"_reach": reach, "east": east, "north": north})
    seconds = F.abs(F.col("t") - F.col("_pose_t")) / F.lit(1e9)
    sigma = frames.ground_uncertainty(
        (F.col("east") - F.col("_e"), F.col("north") - F.col("_n")), F.col("_up") - ground, F.col("_reach"), (F.col("_se"), F.col("_sn"), F.col("_su")), F.col("_speed"), F.col("_turn"),
        F.col("_attitude_sigma"), F.col("pixel_sigma"), F.lit(float(camera["rms"])), F.lit((camera["fx"] + camera["fy"]) / 2), F.lit(0.0), seconds,
    )
    rows = rows.withColumn("sigma", sigma)
    reason = first_reason(
        (~F.col("calibration").eqNullSafe(F.lit(camera["calibration"])), "object_reference_calibration_mismatch"),
        (~F.col("_known"), "source_frame_was_not_accepted_into_atlas"),
        (F.col("_reach").isNull(), "object_anchor_has_no_safe_ground_intersection"),
        (F.coalesce(F.col("sigma") > most_sigma, F.lit(True)), "object_projected_uncertainty_exceeds_limit"),
    )
    rows = rows.withColumn("reason", reason)
    lat, lon, height = geo.enu_to_geodetic((F.col("east"), F.col("north"), F.lit(ground)), tuple(map(F.lit, origin)))
    found = {"lat": lat, "lon": lon, "altitude_msl": height - geoid, "east": F.col("east"), "north": F.col("north"), "sigma": F.col("sigma"), "t": F.col("t"), "source_index": F.col("source_index")}
    shown = [F.when(F.col("reason").isNull(), v).alias(c) for c, v in found.items()]
    return rows.select("mission", "object", "frame", *shown, "reason")
