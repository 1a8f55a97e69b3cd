"""Record contracts over the driver tables: every reason occurs, alone and together with later ones.

The records' fields are stated once, in expressions that both dialects read; what they are judged by is stated twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.operators import contracts
from evifuse.sources.tables import read


def bad(k: int) -> str:
    """Two kinds of records get fault ``k``, so some records have two faults."""
    return f"(n % 41 = {k} OR n % 53 = {k})"


def _records(spark, sf_dir, table: str, key: str, fields: dict[str, str]):
    return read(spark, sf_dir, table).selectExpr(f"{key} AS n").selectExpr("n", *(f"{e} AS {name}" for name, e in fields.items()))


def _cte(table: str, key: str, fields: dict[str, str]) -> str:
    return f"WITH k AS (SELECT {key} AS n FROM {table}), r AS (SELECT n, " + ", ".join(f"{e} AS {name}" for name, e in fields.items()) + " FROM k)"


def _case(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {broken} THEN '{reason}'" for reason, broken in rules) + " END AS reject_reason"


def _array(*names: str):
    return F.array(*(F.col(n).cast("int") for n in names))


TIME = {
    "tai_ns": f"CASE WHEN n % 7 = 0 THEN NULL WHEN {bad(1)} THEN -n ELSE n END",
    "uncertainty_ns": f"CASE WHEN n % 7 = 0 AND n % 5 <> 0 THEN NULL WHEN {bad(2)} THEN -1 ELSE n % 1000 END",
    "clock_id": f"CASE WHEN {bad(4)} THEN '' ELSE 'camera' END",
    "clock_domain": f"CASE WHEN n % 3 = 0 THEN NULL WHEN {bad(5)} THEN '' ELSE 'ptp-a' END",
}


def contract_timestamp(spark, sf_dir):
    return contracts.timestamps(_records(spark, sf_dir, "events", "event_id", TIME)).select("n", "effective_domain", "reject_reason")


TIME_RULES = [
    ("timestamp_negative", "tai_ns < 0"), ("uncertainty_negative", "uncertainty_ns < 0"),
    ("uncertainty_of_unknown_time", "tai_ns IS NULL AND uncertainty_ns IS NOT NULL"), ("clock_id_missing", "clock_id = ''"), ("clock_domain_empty", "clock_domain = ''"),
]
TIME_SQL = _cte("events", "event_id", TIME) + f" SELECT n, coalesce(nullif(clock_domain, ''), clock_id) AS effective_domain, {_case(TIME_RULES)} FROM r"

OBSERVED = {
    "sensor": f"CASE WHEN {bad(1)} THEN '' ELSE 'rgb' END",
    "modality": f"CASE WHEN {bad(2)} THEN NULL ELSE 'visible' END",
    "h": "10 + n % 5",
    "w": "20 + n % 3",
    "ndim": f"CASE WHEN {bad(3)} THEN 5 ELSE 1 + n % 4 END",
    "vh": f"CASE WHEN n % 4 = 1 THEN NULL WHEN {bad(4)} THEN 7 ELSE 10 + n % 5 END",
    "vdim": "1 + n % 2",
    "least": f"CASE WHEN {bad(5)} THEN -0.5e0 ELSE 0.1e0 END",
    "most": f"CASE WHEN {bad(6)} THEN CAST('NaN' AS DOUBLE) WHEN {bad(7)} THEN CAST('Infinity' AS DOUBLE) ELSE 0.2e0 END",
    "uh": f"CASE WHEN n % 3 = 1 THEN NULL WHEN {bad(8)} THEN 7 ELSE 10 + n % 5 END",
}


def contract_observation(spark, sf_dir):
    """Observations with 1 to 5 dimensions; validity by row or by image; uncertainty by row."""
    rows = _records(spark, sf_dir, "orders", "o_orderkey", OBSERVED)
    shape = F.slice(F.array(F.col("h"), F.col("w"), F.lit(3), F.lit(2), F.lit(2)), F.lit(1), F.col("ndim").cast("int"))
    validity = F.when(F.col("vh").isNotNull(), F.slice(F.array("vh", "w"), F.lit(1), F.col("vdim").cast("int")))
    rows = rows.select(
        "n", F.col("sensor").alias("sensor_id"), "modality", F.lit("camera").alias("frame_id"), shape.alias("shape"), validity.alias("validity_shape"),
        F.when(F.col("uh").isNotNull(), F.array("uh")).alias("uncertainty_shape"), F.col("least").alias("uncertainty_min"), F.col("most").alias("uncertainty_max"),
    )
    return contracts.observations(rows).select("n", "reject_reason")


OBSERVED_RULES = [
    ("identity_missing", "sensor = '' OR modality IS NULL"), ("dimensions_unsupported", "ndim > 4"),
    ("validity_geometry_mismatch", "vh IS NOT NULL AND (vh <> h OR (ndim = 1 AND vdim = 2))"),
    ("uncertainty_not_finite_or_negative", "uh IS NOT NULL AND (least < 0 OR isnan(most) OR isinf(most))"), ("uncertainty_geometry_mismatch", "uh <> h"),
]
OBSERVED_SQL = _cte("orders", "o_orderkey", OBSERVED) + f" SELECT n, {_case(OBSERVED_RULES)} FROM r"

BOX = {
    "confidence": f"CASE WHEN {bad(1)} THEN 1.5e0 WHEN {bad(2)} THEN CAST('NaN' AS DOUBLE) ELSE n % 11 * 0.1e0 * 0.99e0 END",
    "x": f"CASE WHEN {bad(3)} THEN -0.1e0 ELSE n % 13 * 0.05e0 END",
    "y": f"CASE WHEN {bad(4)} THEN NULL ELSE n % 17 * 0.05e0 END",
    "width": f"CASE WHEN {bad(5)} THEN 1.2e0 ELSE n % 7 * 0.06e0 END",
    "height": f"CASE WHEN {bad(6)} THEN -1e0 ELSE n % 5 * 0.07e0 END",
}


def contract_detection(spark, sf_dir):
    return contracts.detections(_records(spark, sf_dir, "lineitem", "l_orderkey * 8 + l_linenumber", BOX)).select("n", "reject_reason")


BOX_RULES = [(f"{c}_outside_unit", f"{c} IS NULL OR {c} < 0 OR {c} > 1") for c in BOX] + [("box_beyond_image", "x + width > 1.000001e0 OR y + height > 1.000001e0")]
BOX_SQL = _cte("lineitem", "l_orderkey * 8 + l_linenumber", BOX) + f" SELECT n, {_case(BOX_RULES)} FROM r"

FRAME = {
    "n_seen": f"CASE WHEN {bad(1)} THEN 0 ELSE 2 END",
    "second": f"CASE WHEN {bad(2)} THEN 'depth' ELSE 'thermal' END",
    "side": f"CASE WHEN {bad(3)} THEN 5 ELSE 3 + n % 2 END",
    "reference": f"CASE WHEN {bad(4)} THEN 'nowhere' ELSE 'camera' END",
    "mask_h": f"CASE WHEN n % 3 = 0 THEN NULL WHEN {bad(5)} THEN 9 ELSE 8 END",
    "domain": "CASE WHEN n % 5 = 0 THEN 'live' ELSE 'site_archive' END",
    "other": "CASE WHEN n % 7 = 0 THEN 'old_archive' WHEN n % 5 = 0 THEN 'live' ELSE 'site_archive' END",
    "state": "CASE WHEN n % 11 = 0 THEN 'stale' ELSE 'unknown' END",
    "alignment": "CASE WHEN n % 4 = 0 THEN NULL ELSE 'publisher_provided_rectification' END",
}


def contract_frame(spark, sf_dir):
    """Frames of two sensors; publishers' rectified archives become declared alignments."""
    rows = _records(spark, sf_dir, "orders", "o_orderkey", FRAME)

    def seen(key, sensor, frame, domain):
        parts = {"key": F.lit(key), "sensor_id": sensor, "frame_id": F.lit(frame), "height": F.lit(8), "width": F.lit(6), "domain": F.col(domain)}
        return F.struct(*(value.alias(name) for name, value in parts.items()))

    both = F.array(seen("rgb", F.lit("rgb"), "camera", "domain"), seen("thermal", F.col("second"), "infrared", "other"))
    rows = rows.select(
        "n", F.slice(both, F.lit(1), F.col("n_seen").cast("int")).alias("observations"), F.array(_array("side", "side")).alias("transform_shapes"), F.col("reference").alias("reference_frame"),
        F.when(F.col("mask_h").isNotNull(), F.array(F.col("mask_h").cast("int"), F.lit(6))).alias("mask_shape"), "state", F.lit(False).alias("eligible"), "alignment", F.lit("site").alias("dataset"),
    )
    return contracts.evidence_frames(rows).select("n", "reject_reason", "declared")


FRAME_RULES = [
    ("observations_missing", "n_seen = 0"), ("observation_key_mismatch", "second <> 'thermal'"), ("transform_shape_unsupported", "side NOT IN (3, 4)"),
    ("reference_without_observation", "mask_h IS NOT NULL AND reference <> 'camera'"), ("mask_geometry_mismatch", "mask_h <> 8"),
]
FRAME_SQL = _cte("orders", "o_orderkey", FRAME) + f""", j AS (SELECT *, {_case(FRAME_RULES)} FROM r)
SELECT n, reject_reason, reject_reason IS NULL AND state = 'unknown' AND alignment IS NOT NULL AND domain = other AND domain = 'site_archive' AS declared FROM j"""

STATUS = {
    "state": f"CASE WHEN {bad(1)} THEN 'soon' WHEN n % 6 = 0 THEN 'exact' WHEN n % 6 = 1 THEN 'declared_replay_aligned' WHEN n % 6 = 2 THEN 'interpolated' WHEN n % 6 = 3 THEN 'stale' ELSE 'bounded_skew' END",
    "basis": f"CASE WHEN {bad(2)} THEN 'hoped' WHEN n % 6 = 1 AND NOT {bad(3)} THEN 'declared' WHEN n % 6 = 3 OR n % 43 = 9 THEN 'unknown' ELSE 'measured' END",
    "eligible": "n % 6 <> 3 OR n % 47 = 5",
    "performed": "n % 12 = 2",
    "measured_ns": f"CASE WHEN {bad(4)} THEN -1 WHEN n % 5 = 0 THEN NULL ELSE n % 100 END",
    "effective_ns": f"CASE WHEN {bad(5)} THEN -5 WHEN {bad(6)} THEN 0 ELSE n % 100 + 7 END",
    "physical_ns": f"CASE WHEN {bad(7)} THEN -2 ELSE n % 9 END",
    "sensor_state": f"CASE WHEN {bad(8)} THEN 'odd' ELSE 'exact' END",
    "sensor_ns": f"CASE WHEN {bad(9)} THEN -3 WHEN n % 8 = 0 THEN NULL ELSE 4 END",
}


def contract_status(spark, sf_dir):
    rows = _records(spark, sf_dir, "orders", "o_orderkey", STATUS)
    rows = rows.withColumn("interpolation_performed", F.col("performed")).withColumn("sensor_states", F.array(F.lit("late"), "sensor_state")).withColumn("sensor_effective_ns", F.array("sensor_ns"))
    return contracts.statuses(rows).select("n", "reject_reason")


STATUS_RULES = [
    ("state_unsupported", "state = 'soon'"), ("basis_unsupported", "basis = 'hoped'"), ("eligible_state_required", "eligible AND state = 'stale'"),
    ("eligible_basis_required", "eligible AND basis = 'unknown'"), ("declared_basis_required", "state = 'declared_replay_aligned' AND basis <> 'declared'"),
    ("interpolation_not_performed", "state = 'interpolated' AND eligible AND NOT performed"), ("measured_ns_negative", "measured_ns < 0"),
    ("effective_ns_negative", "effective_ns < 0"), ("physical_ns_negative", "physical_ns < 0"), ("effective_below_measured", "effective_ns < measured_ns"),
    ("sensor_state_unsupported", "sensor_state = 'odd'"), ("sensor_effective_negative", "sensor_ns < 0"),
]
STATUS_SQL = _cte("orders", "o_orderkey", STATUS) + f" SELECT n, {_case(STATUS_RULES)} FROM r"

OUTPUT = {
    "bands": f"CASE WHEN {bad(1)} THEN 4 ELSE 3 END",
    "channels": f"CASE WHEN {bad(2)} THEN 10 ELSE 11 END",
    "th": f"CASE WHEN {bad(3)} THEN 9 ELSE 8 END",
    "sh": f"CASE WHEN {bad(4)} THEN 9 ELSE 8 END",
    "s_most": f"CASE WHEN {bad(5)} THEN 1.01e0 WHEN {bad(6)} THEN CAST('NaN' AS DOUBLE) ELSE 1e0 END",
    "rh": f"CASE WHEN {bad(7)} THEN 9 ELSE 8 END",
    "r_least": f"CASE WHEN {bad(8)} THEN -0.01e0 ELSE 0e0 END",
    "ih": f"CASE WHEN {bad(9)} THEN 9 ELSE 8 END",
    "vh": f"CASE WHEN {bad(10)} THEN 9 ELSE 8 END",
    "mh": f"CASE WHEN n % 3 = 0 THEN NULL WHEN {bad(11)} THEN 9 ELSE 8 END",
    "state": f"CASE WHEN {bad(12)} THEN 'soon' ELSE 'exact' END",
    "physical_ns": f"CASE WHEN {bad(13)} THEN -1 WHEN n % 4 = 0 THEN NULL ELSE 3 END",
}


def contract_output(spark, sf_dir):
    rows = _records(spark, sf_dir, "orders", "o_orderkey", OUTPUT).withColumn("w", F.lit(6))
    rows = rows.select(
        "n", F.array(F.lit(8), F.lit(6), F.col("bands")).alias("operator_shape"), F.array(F.lit(11), F.col("th"), F.col("w")).alias("tensor_shape"), F.col("channels").alias("n_channels"),
        _array("sh", "w").alias("support_shape"), F.lit(0.0).alias("support_least"), F.col("s_most").alias("support_greatest"),
        _array("rh", "w").alias("registration_shape"), F.col("r_least").alias("registration_least"), F.lit(0.5).alias("registration_greatest"),
        _array("ih", "w").alias("thermal_shape"), _array("vh", "w").alias("visible_shape"), F.when(F.col("mh").isNotNull(), _array("mh", "w")).alias("semantic_shape"), "state", "physical_ns",
    )
    return contracts.outputs(rows).select("n", "reject_reason")


OUTPUT_RULES = [
    ("operator_view_not_rgb", "bands <> 3"), ("channels_not_named", "channels <> 11"), ("tensor_geometry_mismatch", "th <> 8"), ("support_geometry_mismatch", "sh <> 8"),
    ("support_outside_unit", "isnan(s_most) OR s_most > 1"), ("registration_geometry_mismatch", "rh <> 8"), ("registration_outside_unit", "r_least < 0"),
    ("thermal_geometry_mismatch", "ih <> 8"), ("visible_geometry_mismatch", "vh <> 8"), ("semantic_geometry_mismatch", "mh <> 8"),
    ("state_unsupported", "state = 'soon'"), ("physical_ns_negative", "physical_ns < 0"),
]
OUTPUT_SQL = _cte("orders", "o_orderkey", OUTPUT) + f" SELECT n, {_case(OUTPUT_RULES)} FROM r"

ANGLES = ("latitude_deg", "longitude_deg", "altitude_msl_m", "yaw_deg", "pitch_deg", "roll_deg")
ACCURACIES = ("horizontal_accuracy_m", "vertical_accuracy_m", "attitude_accuracy_deg")
COUNTS = ("event_monotonic_ns", "event_utc_ns", "time_uncertainty_ns", "interpolation_span_ns")
C, S = "cos(n % 360 * 0.0174e0)", "sin(n % 360 * 0.0174e0)"
POSE = {
    "image_name": f"CASE WHEN {bad(1)} THEN '  ' ELSE 'a.jpg' END",
    "image_index": f"CASE WHEN {bad(2)} THEN -1 WHEN n % 3 = 0 THEN NULL ELSE n END",
    "latitude_deg": f"CASE WHEN {bad(3)} THEN NULL WHEN {bad(9)} THEN 90.5e0 ELSE n % 90 * 1e0 END",
    "longitude_deg": f"CASE WHEN {bad(4)} THEN CAST('NaN' AS DOUBLE) WHEN {bad(10)} THEN -181e0 ELSE n % 180 * -1e0 END",
    "altitude_msl_m": f"CASE WHEN {bad(5)} THEN CAST('Infinity' AS DOUBLE) ELSE 5e0 END",
    "yaw_deg": f"CASE WHEN {bad(6)} THEN NULL ELSE 1e0 END",
    "pitch_deg": f"CASE WHEN {bad(7)} THEN NULL ELSE 1e0 END",
    "roll_deg": f"CASE WHEN {bad(8)} THEN NULL ELSE 1e0 END",
    "relative_altitude_m": f"CASE WHEN n % 2 = 0 THEN NULL WHEN {bad(11)} THEN CAST('NaN' AS DOUBLE) ELSE 3e0 END",
    "len": f"CASE WHEN {bad(12)} THEN 2e0 ELSE 1e0 END",
    "olen": f"CASE WHEN {bad(13)} THEN 0.5e0 ELSE 1e0 END",
    "turned": bad(14),
    "c": C,
    "s": S,
    **{n: f"CASE WHEN n % 4 = 0 THEN NULL WHEN {bad(15 + i)} THEN -0.1e0 ELSE 0.1e0 END" for i, n in enumerate(ACCURACIES)},
    "capture_monotonic_ns": f"CASE WHEN {bad(18)} THEN -1 WHEN n % 3 = 1 OR {bad(25)} THEN NULL ELSE n END",
    "capture_utc_ns": f"CASE WHEN {bad(19)} THEN -1 WHEN n % 3 = 0 OR {bad(25)} THEN NULL ELSE n END",
    **{n: f"CASE WHEN {bad(20 + i)} THEN -1 WHEN n % 5 = 0 THEN NULL ELSE n END" for i, n in enumerate(COUNTS)},
    "time_basis": f"CASE WHEN {bad(24)} THEN 'sun' WHEN n % 3 = 0 OR n % 47 = 8 THEN 'mavlink_system_boot' WHEN n % 3 = 1 THEN 'utc' ELSE 'mavlink_system_boot+utc' END",
    "clock_domain": f"CASE WHEN {bad(26)} THEN ' ' ELSE 'boot-1' END",
    "fix_type": f"CASE WHEN {bad(27)} THEN 12 WHEN n % 10 = 9 THEN NULL ELSE n % 9 END",
    "relative_altitude_reference": f"CASE WHEN {bad(28)} THEN 'sea' ELSE 'home' END",
    "position_reference": f"CASE WHEN {bad(29)} THEN 'tail' ELSE 'unspecified' END",
}


def contract_pose(spark, sf_dir):
    """Camera pose records that turn about the vertical; the optical rotation follows or is a multiple, or another one."""
    rows = _records(spark, sf_dir, "orders", "o_orderkey", POSE)
    c, s, turned = F.col("c"), F.col("s"), F.col("turned")
    flu = F.array(*(F.col("len") * x for x in (c, F.lit(0.0), F.lit(0.0), s)))
    follows = ((c + s) / 2, -(c + s) / 2, (c - s) / 2, (s - c) / 2)
    optical = F.array(*(F.col("olen") * F.when(turned, other).otherwise(x) for x, other in zip(follows, (c, s, F.lit(0.0), F.lit(0.0)))))
    return contracts.pose_records(rows.withColumn("flu", flu).withColumn("optical", optical)).select("n", "reject_reason")


POSE_RULES = [
    ("image_name_missing", "trim(image_name) = ''"), ("image_index_negative", "image_index < 0"),
    *((f"{n}_not_finite", f"{n} IS NULL OR isnan({n}) OR isinf({n})") for n in ANGLES),
    ("relative_altitude_m_not_finite", "isnan(relative_altitude_m)"), ("latitude_outside", "abs(latitude_deg) > 90"), ("longitude_outside", "abs(longitude_deg) > 180"),
    ("flu_not_normalized", "len <> 1"), ("optical_not_normalized", "olen <> 1"), ("rotations_contradict", "turned"),
    *((f"{n}_negative", f"{n} < 0") for n in (*ACCURACIES, "capture_monotonic_ns", "capture_utc_ns", *COUNTS)),
    ("time_basis_unsupported", "time_basis = 'sun'"), ("capture_time_missing", "coalesce(capture_monotonic_ns, capture_utc_ns) IS NULL"),
    ("time_basis_contradicts_times", "(capture_monotonic_ns IS NOT NULL) <> (time_basis <> 'utc') OR (capture_utc_ns IS NOT NULL) <> (time_basis <> 'mavlink_system_boot')"),
    ("clock_domain_missing", "trim(clock_domain) = ''"), ("fix_type_unknown", "fix_type > 8"),
    ("altitude_reference_unsupported", "relative_altitude_reference = 'sea'"), ("position_reference_unsupported", "position_reference = 'tail'"),
]
POSE_SQL = _cte("orders", "o_orderkey", POSE) + f" SELECT n, {_case(POSE_RULES)} FROM r"

LIMITS = ("max_cells", "max_semantic_classes", "max_peak_memory_bytes", "max_sampled_pixels", "surface_ray_max_work")
MAP = {
    "east_min_m": f"CASE WHEN {bad(1)} THEN CAST('NaN' AS DOUBLE) ELSE 0e0 END",
    "east_max_m": f"CASE WHEN {bad(2)} THEN -1e0 ELSE 10e0 + n % 7 END",
    "north_min_m": "0e0",
    "north_max_m": f"CASE WHEN {bad(3)} THEN 0e0 ELSE 10e0 + n % 5 END",
    "resolution_m": f"CASE WHEN {bad(4)} THEN 0e0 WHEN {bad(5)} THEN 0.3e0 ELSE 0.5e0 END",
    "ground_elevation_m": f"CASE WHEN {bad(6)} THEN NULL ELSE 0e0 END",
    "intersection_tolerance_m": f"CASE WHEN {bad(7)} THEN 0e0 ELSE 0.05e0 END",
    "surface_ray_step_m": f"CASE WHEN n % 2 = 0 THEN NULL WHEN {bad(8)} THEN -1e0 ELSE 1e0 END",
    "intersection_max_iterations": f"CASE WHEN {bad(9)} THEN 0 ELSE 20 END",
    "surface_ray_max_steps": f"CASE WHEN {bad(10)} THEN 0 ELSE 8192 END",
    "min_downward_cosine": f"CASE WHEN {bad(11)} THEN 0e0 WHEN {bad(12)} THEN 1.1e0 ELSE 0.1e0 END",
    "max_slant_range_m": f"CASE WHEN {bad(13)} THEN 0e0 ELSE 2000e0 END",
    "max_projected_uncertainty_m": f"CASE WHEN {bad(14)} THEN -1e0 ELSE 5e0 END",
    "uncertainty_percentile": f"CASE WHEN {bad(15)} THEN 101e0 ELSE 95e0 END",
    "max_pose_time_offset_ns": f"CASE WHEN {bad(16)} THEN -1 ELSE 100 END",
    **{name: f"CASE WHEN {bad(17 + i)} THEN 0 ELSE 700 END" for i, name in enumerate(LIMITS)},
    "max_peak_memory_bytes": f"CASE WHEN {bad(19)} THEN 0 ELSE 300000 + n % 11 * 30000 END",
}


def contract_mosaic(spark, sf_dir):
    rows = _records(spark, sf_dir, "orders", "o_orderkey", MAP)
    return contracts.mosaic_settings(rows).select("n", "width", "height", "reject_reason")


REALS = ("east_min_m", "ground_elevation_m")
MAP_RULES = [
    *((f"{n}_not_finite", f"{n} IS NULL OR isnan({n})") for n in REALS), ("bounds_without_area", "east_max_m <= 0 OR north_max_m <= 0"), ("resolution_not_positive", "resolution_m <= 0"),
    ("tolerance_not_positive", "intersection_tolerance_m <= 0"), ("ray_step_not_positive", "surface_ray_step_m <= 0"), ("iterations_not_positive", "intersection_max_iterations <= 0"),
    ("ray_steps_not_positive", "surface_ray_max_steps <= 0"), ("downward_cosine_outside", "min_downward_cosine <= 0 OR min_downward_cosine > 1"),
    ("limits_not_positive", "max_slant_range_m <= 0 OR max_projected_uncertainty_m <= 0"), ("percentile_outside", "uncertainty_percentile > 100"),
    ("pose_offset_negative", "max_pose_time_offset_ns < 0"),
    *((f"{n}_not_positive", f"{n} <= 0") for n in LIMITS),
    ("spans_not_multiples", "abs(east_max_m / resolution_m - round(east_max_m / resolution_m)) > 1e-3 OR abs(north_max_m / resolution_m - round(north_max_m / resolution_m)) > 1e-3"),
    ("cells_exceed_limit", "(east_max_m / resolution_m) * (north_max_m / resolution_m) > max_cells + 1e-6"),
    ("memory_estimate_exceeds_limit", "round(east_max_m / resolution_m) * round(north_max_m / resolution_m) * 192 + max_sampled_pixels * 384 > max_peak_memory_bytes"),
]
MAP_SQL = _cte("orders", "o_orderkey", MAP) + f""", j AS (SELECT *, {_case(MAP_RULES)} FROM r)
SELECT n, CASE WHEN reject_reason IS NULL THEN CAST(round(east_max_m / resolution_m) AS BIGINT) END AS width,
  CASE WHEN reject_reason IS NULL THEN CAST(round(north_max_m / resolution_m) AS BIGINT) END AS height, reject_reason FROM j"""

QUERIES = {
    "contract_timestamp": (contract_timestamp, TIME_SQL),
    "contract_observation": (contract_observation, OBSERVED_SQL),
    "contract_detection": (contract_detection, BOX_SQL),
    "contract_frame": (contract_frame, FRAME_SQL),
    "contract_status": (contract_status, STATUS_SQL),
    "contract_output": (contract_output, OUTPUT_SQL),
    "contract_pose": (contract_pose, POSE_SQL),
    "contract_mosaic": (contract_mosaic, MAP_SQL),
}
