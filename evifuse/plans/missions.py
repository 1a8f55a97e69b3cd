"""Captures of missions judged by all gates, computed from records."""

from __future__ import annotations

from evifuse.operators import gates, missions
from evifuse.plans.contracts import _cte, _records

MISSION = missions.Mission(
    "c1", 48, 64, boot_epoch_tai_ns=5_000, boot_epoch_uncertainty_ns=300, boot_clock_domain="boot-a", max_time_uncertainty_ns=1000, max_thermal_offset_ns=500,
    max_thermal_uncertainty_ns=200, max_thermal_rms_px=1.5, require_rtk_fixed=True,
    velocity_bound=2.0, turn_bound=None, origin=(46.0, 7.0, 300.0), lever_arm=(0.0, 0.0, 1.0), agl=(20.0, 120.0), surface=True, taxonomy=(0, 1, 2, 3),
)


def bad(k: int) -> str:
    """A few records get fault ``k``; some have two."""
    return f"(n % 211 = {k} OR n % 307 = {k})"


FIELDS = {
    "mission": "n % 7", "frame": "CASE WHEN n % 3 = 0 THEN n % 500 ELSE n END",
    "utc": f"CASE WHEN {bad(2)} OR n % 5 = 1 THEN NULL ELSE n * 1000000 END",
    "boot": f"CASE WHEN {bad(1)} THEN n * 1000000 + 36999999000 WHEN {bad(0)} OR n % 5 = 1 AND NOT {bad(2)} THEN n * 1000000 + 36999995000 END",
    "clock_domain": f"CASE WHEN {bad(0)} THEN 'boot-b' ELSE 'boot-a' END",
    "time_unc": f"CASE WHEN {bad(3)} THEN NULL WHEN {bad(4)} THEN 5000 WHEN {bad(5)} OR {bad(24)} THEN 7 ELSE 0 END",
    "thermal": f"n % 4 <> 0 AND NOT {bad(6)}",
    "thermal_fingerprint": f"CASE WHEN {bad(6)} OR n % 4 <> 0 AND NOT {bad(7)} THEN CASE WHEN n % 97 = 5 THEN 'b' ELSE 'a' END END",
    "thermal_calibration": f"CASE WHEN {bad(8)} THEN 'c0' ELSE 'c1' END",
    "thermal_offset": f"CASE WHEN {bad(9)} THEN -490 WHEN {bad(25)} THEN 3 ELSE 0 END",
    "thermal_unc": f"CASE WHEN {bad(9)} THEN 20 WHEN {bad(10)} THEN 300 ELSE 0 END",
    "thermal_rms": f"CASE WHEN {bad(11)} THEN 2e0 ELSE 1e0 END",
    "semantic": f"n % 6 <> 0 AND NOT {bad(12)}",
    "semantic_fingerprint": f"CASE WHEN {bad(12)} OR n % 6 <> 0 AND NOT {bad(13)} THEN CASE WHEN n % 89 = 7 THEN 'y' ELSE 'x' END END",
    "semantic_calibration": f"CASE WHEN {bad(14)} THEN NULL ELSE 'c1' END",
    "fix": f"CASE WHEN {bad(15)} THEN 'good' WHEN {bad(16)} THEN '2' WHEN {bad(17)} THEN ' RTK Float' WHEN n % 2 = 0 THEN 'rtk_fixed' ELSE '6' END",
    "position_reference": f"CASE WHEN {bad(18)} THEN 'unspecified' WHEN {bad(19)} THEN 'vehicle_navigation_origin' ELSE 'camera_center' END",
    "attitude_source": f"CASE WHEN {bad(20)} THEN 'ATTITUDE_QUATERNION+mount' ELSE 'CAMERA_IMAGE_CAPTURED' END",
    "h_acc": f"CASE WHEN {bad(21)} THEN NULL ELSE 1e0 END", "v_acc": f"CASE WHEN {bad(22)} THEN NULL ELSE 1e0 END", "a_acc": f"CASE WHEN {bad(23)} THEN NULL ELSE 1e0 END",
    "lat": "46e0", "lon": "7e0", "alt_msl": f"CASE WHEN {bad(27)} THEN 600e0 ELSE 350e0 + n % 30 END",
    "ground": f"CASE WHEN {bad(26)} THEN NULL ELSE n % 20 * 1e0 END",
    "rgb_h": f"CASE WHEN {bad(28)} THEN 47 ELSE 48 END", "rgb_w": "64",
    "thermal_h": f"CASE WHEN {bad(28)} THEN 47 ELSE 48 END", "thermal_w": f"CASE WHEN {bad(29)} THEN 63 ELSE 64 END",
    "semantic_h": f"CASE WHEN {bad(30)} THEN NULL WHEN {bad(28)} THEN 47 ELSE 48 END", "semantic_w": "64",
    "semantic_whole": f"NOT {bad(31)}", "semantic_min": f"CASE WHEN {bad(32)} THEN -3000000000 ELSE 0 END", "semantic_max": "3", "odd_class": f"{bad(33)}",
    "static_h": f"CASE WHEN {bad(34)} THEN 47 WHEN {bad(28)} THEN 47 WHEN n % 8 = 0 THEN 48 END", "static_w": f"CASE WHEN {bad(34)} OR {bad(28)} OR n % 8 = 0 THEN 64 END",
    "dynamic_h": f"CASE WHEN {bad(35)} THEN 48 END", "dynamic_w": f"CASE WHEN {bad(35)} THEN 65 END",
}


def mission_integration(spark, sf_dir):
    """orders as captures of seven missions: each record's reason, in the order of arrival."""
    rows = _records(spark, sf_dir, "orders", "o_orderkey", FIELDS).withColumnRenamed("n", "seq").dropDuplicates(["seq"])
    rows = rows.selectExpr("*", "array(0.0D, 1.0D, 0.0D, 0.0D) AS optical", "if(odd_class, array(0L, 9L), array(0L, 3L)) AS semantic_classes")
    return missions.judged(missions.checked(rows, MISSION))


TIMES = "utc + 37000000000 AS by_utc, boot + 5000 AS by_boot"
RULES = {
    "boot_clock_domain_mismatch": "boot IS NOT NULL AND clock_domain <> 'boot-a'", "utc_boot_time_anchors_disagree": "abs(by_utc - by_boot) > 1000",
    "capture_time_has_no_explicit_tai_anchor": "coalesce(by_utc, by_boot) IS NULL", "capture_time_uncertainty_unknown": "time_unc IS NULL", "capture_time_uncertainty_exceeds_limit": "unc > 1000",
    "thermal_contract_without_thermal_frame": "NOT thermal AND thermal_fingerprint IS NOT NULL",
    "thermal_registration_contract_unknown": "thermal AND thermal_fingerprint IS NULL", "thermal_reference_calibration_mismatch": "thermal AND thermal_calibration <> 'c1'",
    "thermal_time_offset_exceeds_limit": "thermal AND abs(thermal_offset) + thermal_unc > 500", "thermal_time_uncertainty_exceeds_limit": "thermal AND thermal_unc > 200",
    "thermal_registration_error_exceeds_limit": "thermal AND thermal_rms > 1.5",
    "thermal_mission_contract_changed": "thermal AND thermal_fingerprint <> state.th",
    "semantic_contract_without_semantic_frame": "NOT semantic AND semantic_fingerprint IS NOT NULL",
    "semantic_contract_unknown": "semantic AND semantic_fingerprint IS NULL", "semantic_reference_calibration_mismatch": "semantic AND coalesce(semantic_calibration, '') <> 'c1'",
    "semantic_mission_contract_changed": "semantic AND semantic_fingerprint <> state.se",
    "navigation_fix_unknown": "fix = 'good'", "navigation_fix_below_minimum": "fix = '2'", "rtk_fixed_required": "fix = ' RTK Float'",
    "capture_position_reference_unknown": "position_reference = 'unspecified'",
    "camera_extrinsic_calibration_unknown": "position_reference LIKE 'vehicle%' OR attitude_source LIKE '%QUATERNION%'", "horizontal_accuracy_unknown": "h_acc IS NULL",
    "vertical_accuracy_unknown": "v_acc IS NULL", "attitude_accuracy_unknown": "a_acc IS NULL",
    "timing_angular_rate_bound_unknown": "unc > 0", "thermal_angular_rate_bound_unknown": "thermal AND abs(thermal_offset) + thermal_unc > 0",
    "camera_ground_elevation_unknown": "ground IS NULL", "camera_agl_outside_limits": "alt_msl - 300 - ground NOT BETWEEN 20 AND 120", "rgb_geometry_does_not_match_calibration": "rgb_h <> 48",
    "thermal_registered_geometry_mismatch": "thermal AND (thermal_h <> rgb_h OR thermal_w <> rgb_w)",
    "semantic_geometry_mismatch": "semantic AND coalesce(semantic_h, 0) <> rgb_h", "semantic_values_must_be_integers": "semantic AND NOT semantic_whole",
    "semantic_values_outside_int32": "semantic AND semantic_min < -2147483648", "semantic_class_not_in_taxonomy": "semantic AND odd_class",
    "static_validity_geometry_mismatch": "static_h <> rgb_h", "dynamic_mask_geometry_mismatch": "dynamic_w <> rgb_w",
    "duplicate_frame_id": "list_contains(state.taken, c.frame)",
}


def _first(names) -> str:
    return "CASE " + " ".join(f"WHEN {RULES[g]} THEN {i}" for i, g in names) + " END"


ORDER = [(i, g) for i, g in enumerate([*gates.MISSION, "duplicate_frame_id"]) if g in RULES]
SQL = _cte("(SELECT DISTINCT o_orderkey FROM orders)", "o_orderkey", FIELDS).replace("WITH k", "WITH RECURSIVE k", 1) + f""",
a AS (SELECT *, {TIMES} FROM r), b AS (SELECT *, CASE WHEN by_utc IS NOT NULL AND by_boot IS NOT NULL THEN greatest(time_unc, abs(by_utc - by_boot)) WHEN by_utc IS NULL
  AND by_boot IS NOT NULL THEN time_unc + 300 ELSE time_unc END AS unc FROM a),
c AS (SELECT mission, n, frame, thermal, thermal_fingerprint, semantic, semantic_fingerprint, row_number() OVER (PARTITION BY mission ORDER BY n) AS k,
  {_first([x for x in ORDER if 'state.' not in RULES[x[1]]])} AS own FROM b),
w AS (SELECT mission, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS frame, CAST(NULL AS INTEGER) AS at_, CAST(NULL AS VARCHAR) AS th,
  CAST(NULL AS VARCHAR) AS se, CAST([] AS BIGINT[]) AS taken FROM c GROUP BY mission
  UNION ALL
  SELECT mission, k, n, frame, at_, CASE WHEN at_ IS NULL THEN coalesce(th, thermal_fingerprint) ELSE th END, CASE WHEN at_ IS NULL THEN coalesce(se,
  semantic_fingerprint) ELSE se END, CASE WHEN at_ IS NULL AND frame < 500 THEN list_append(taken, frame) ELSE taken END FROM (
    SELECT c.*, state.th, state.se, state.taken, CAST(least(own,
    {_first([x for x in ORDER if 'state.' in RULES[x[1]]][:1])},
    {_first([x for x in ORDER if 'state.' in RULES[x[1]]][1:2])}, {_first([x for x in ORDER if 'state.' in RULES[x[1]]][2:])}) AS INTEGER) AS at_
    FROM w state JOIN c ON c.mission = state.mission AND c.k = state.k + 1))
SELECT mission, n AS seq, frame, list_extract([{', '.join(repr(g) for g in [*gates.MISSION, 'duplicate_frame_id'])}], at_ + 1) AS reject_reason FROM w WHERE k > 0"""
QUERIES = {"mission_integration": (mission_integration, SQL)}
