"""Mission and grid gates: the first failing gate, in a fixed order, names the reason.

Gates are given as boolean columns of the reasons' names; a null gate has not failed. Sequential gates depend on the rows
that a mission accepted before: its contract is fixed by the first accepted row that has one, and a frame is accepted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The mission gates in their order.
MISSION = [
    "boot_clock_domain_mismatch",
    "utc_boot_time_anchors_disagree",
    "capture_time_has_no_explicit_tai_anchor",
    "capture_time_uncertainty_unknown",
    "capture_time_uncertainty_exceeds_limit",
    "thermal_contract_without_thermal_frame",
    "thermal_registration_contract_unknown",
    "thermal_reference_calibration_mismatch",
    "thermal_time_offset_exceeds_limit",
    "thermal_time_uncertainty_exceeds_limit",
    "thermal_registration_error_exceeds_limit",
    "thermal_mission_contract_changed",
    "semantic_contract_without_semantic_frame",
    "semantic_contract_unknown",
    "semantic_reference_calibration_mismatch",
    "semantic_mission_contract_changed",
    "navigation_fix_unknown",
    "navigation_fix_below_minimum",
    "rtk_fixed_required",
    "capture_position_reference_unknown",
    "camera_extrinsic_calibration_unknown",
    "horizontal_accuracy_unknown",
    "vertical_accuracy_unknown",
    "attitude_accuracy_unknown",
    "timing_velocity_bound_unknown",
    "timing_angular_rate_bound_unknown",
    "thermal_velocity_bound_unknown",
    "thermal_angular_rate_bound_unknown",
    "camera_ground_elevation_unknown",
    "camera_agl_outside_limits",
    "rgb_geometry_does_not_match_calibration",
    "thermal_registered_geometry_mismatch",
    "semantic_geometry_mismatch",
    "semantic_values_must_be_integers",
    "semantic_values_outside_int32",
    "semantic_class_not_in_taxonomy",
    "static_validity_geometry_mismatch",
    "dynamic_mask_geometry_mismatch",
]

#: The grid gates in their order.
GRID = [
    "unknown_capture_time",
    "unknown_camera_calibration",
    "unknown_vehicle_camera_pose",
    "unknown_pose_time",
    "duplicate_frame_id",
    "calibration_geometry_mismatch",
    "pose_time_offset_exceeds_limit",
    "sampled_pixel_limit_exceeded",
    "no_safe_ground_intersections",
    "projected_uncertainty_exceeds_limit",
    "no_supported_samples_after_uncertainty_gate",
    "projected_footprint_outside_map",
    "zero_weight_after_splat",
    "semantic_class_limit_exceeded",
    "semantic_memory_budget_exceeded",
]


def first_failure(rows: DataFrame, gates: list[str], into: str = "reject_reason") -> DataFrame:
    """The first gate of the list that is true; gates without a column count as passed."""
    known = [F.when(F.col(g), F.lit(g)) for g in gates if g in rows.columns]
    return rows.withColumn(into, F.coalesce(*known, F.lit(None).cast("string")))


def in_order(rows: DataFrame, gates: list[str], contract: str, gate: str, frame: str, duplicate: str, into: str = "reject_reason") -> DataFrame:
    """Rows (mission, seq) judged as they arrive: ``gates`` in their order with the contract's ``gate`` among them, then ``duplicate``.

    Only a row that passes everything fixes its mission's contract. Until one does, no row fails ``gate``, so the one that does is the
    first with a contract among those that pass the other gates and bring a new frame. With the contract known, a frame's first row that
    passes is accepted. So two passes over a mission's rows settle what depends on all rows before.
    """
    at = gates.index(gate)
    judged = first_failure(first_failure(rows, gates[:at], "_before"), gates[at + 1 :], "_after")
    passes = F.col("_before").isNull() & F.col("_after").isNull()
    own = Window.partitionBy("mission", frame).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    brought = lambda passing: F.coalesce(F.max(passing).over(own), F.lit(False))  # noqa: E731  whether an earlier row of the frame passed
    fixing = passes & F.col(contract).isNotNull() & ~F.col("_again")
    fixed = F.min(F.when(fixing, F.struct("seq", F.col(contract).alias("contract")))).over(Window.partitionBy("mission"))
    judged = judged.withColumn("_again", brought(passes)).withColumn("_fixed", fixed)
    changed = F.coalesce((F.col("seq") > F.col("_fixed.seq")) & (F.col(contract) != F.col("_fixed.contract")), F.lit(False))
    judged = judged.withColumn("_changed", changed).withColumn("_again", brought(passes & ~changed))
    reason = F.coalesce("_before", F.when(F.col("_changed"), F.lit(gate)), "_after", F.when(F.col("_again"), F.lit(duplicate)))
    return judged.withColumn(into, reason).drop("_before", "_after", "_again", "_fixed", "_changed")
