"""Captures of a mission judged by gates that are computed from their records, in the order of arrival.

What a record says of itself is a boolean for each gate. Three gates ask what was accepted before: the thermal and the semantic contract of the
first accepted record that has one hold for the mission, and a frame is taken once. They are settled in rounds for all missions at
a time: with the contracts and frames known so far every record is judged, and what the accepted ones then fix is known in the
next round. The first records are right after one round, those that depend on them after the next, until nothing changes. Only sums
by mission and frame are shuffled, so a mission may hold any share of all records.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import geo
from evifuse.operators import gates
from evifuse.operators.poses import FIXES
from evifuse.sources.scratch import written

SECOND = 1_000_000_000
#: The gates that depend on what was accepted before, and the column that each compares with the mission's.
CONTRACTS = {"thermal_mission_contract_changed": "thermal_fingerprint", "semantic_mission_contract_changed": "semantic_fingerprint"}


@dataclass(frozen=True)
class Mission:
    """Anchors of the clocks, limits, and what stands in for values that a record lacks (None: nothing does)."""

    calibration: str
    height: int
    width: int
    tai_minus_utc_s: int | None = 37
    boot_epoch_tai_ns: int | None = None
    boot_epoch_uncertainty_ns: int | None = None
    boot_clock_domain: str | None = None
    default_time_uncertainty_ns: int | None = None
    max_time_uncertainty_ns: int = 50_000_000
    max_thermal_offset_ns: int = 50_000_000
    max_thermal_uncertainty_ns: int = 20_000_000
    max_thermal_rms_px: float = 2.0
    minimum_fix: int = 3
    require_rtk_fixed: bool = False
    extrinsic_calibration: str | None = None
    default_accuracies: tuple[float | None, float | None, float | None] = (None, None, None)
    velocity_bound: float | None = None
    turn_bound: float | None = None
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    geoid_separation_m: float = 0.0
    lever_arm: tuple[float, float, float] = (0.0, 0.0, 0.0)
    agl: tuple[float, float] = (5.0, 200.0)
    surface: bool = False
    taxonomy: tuple[int, ...] = field(default=())


def tai_candidates(mission: Mission, utc: Column, boot: Column) -> tuple[Column, Column]:
    """TAI nanoseconds by the UTC anchor and by the boot anchor; null where the time or its anchor is not known."""
    none = F.lit(None).cast("long")
    return none if mission.tai_minus_utc_s is None else utc + mission.tai_minus_utc_s * SECOND, none if mission.boot_epoch_tai_ns is None else boot + mission.boot_epoch_tai_ns


def fix_rank(fix: Column) -> Column:
    """Rank of a fix given as a number or by name, in any case and with blanks; null is unknown."""
    name = F.replace(F.lower(F.trim(fix)), F.lit(" "), F.lit("_"))
    return F.coalesce(fix.try_cast("int"), *(F.when(name == n, k) for k, n in FIXES.items()))


def checked(records: DataFrame, mission: Mission) -> DataFrame:
    """Adds t (TAI), time_uncertainty, agl and a boolean column for each mission gate that a record decides by itself.

    Records: mission, seq, frame, utc, boot, clock_domain, time_unc; thermal (whether there is a frame), thermal_calibration, thermal_offset, thermal_unc, thermal_rms,
    thermal_fingerprint (null: no contract), semantic likewise with semantic_calibration, semantic_fingerprint; fix, position_reference, attitude_source, h_acc, v_acc, a_acc, lat, lon,
    alt_msl, optical, ground (elevation below, of a surface); heights and widths rgb_h, rgb_w, thermal_h, thermal_w, semantic_h, semantic_w, static_h, static_w, dynamic_h, dynamic_w;
    semantic_whole (integers), semantic_min, semantic_max, semantic_classes.
    """
    m, c = mission, F.col
    utc, boot = tai_candidates(m, c("utc"), c("boot"))
    apart = F.abs(utc - boot)
    own = F.coalesce(c("time_unc"), F.lit(m.default_time_uncertainty_ns).cast("long"))
    spread = F.when(apart.isNotNull(), F.greatest(own, apart)).when(boot.isNotNull() & utc.isNull(), own + (m.boot_epoch_uncertainty_ns or 0)).otherwise(own)
    late = F.abs("thermal_offset") + c("thermal_unc")
    hot, marked = c("thermal") & c("thermal_fingerprint").isNotNull(), c("semantic") & c("semantic_fingerprint").isNotNull()
    rank = fix_rank(c("fix"))
    vehicle = c("position_reference") == "vehicle_navigation_origin"
    mounted = vehicle | c("attitude_source").contains("ATTITUDE_QUATERNION")
    unknown = lambda name, stand_in: F.coalesce(c(name), F.lit(stand_in).cast("double")).isNull()
    enu = geo.geodetic_to_enu((c("lat"), c("lon"), c("alt_msl") + m.geoid_separation_m), tuple(map(F.lit, m.origin)))
    arm = geo.rotate([c("optical")[i] for i in range(4)], tuple(map(F.lit, m.lever_arm)))
    ground = c("ground") if m.surface else F.lit(0.0)
    other = lambda h, w, a="rgb_h", b="rgb_w": ~(c(h).eqNullSafe(c(a)) & c(w).eqNullSafe(c(b)))
    given = lambda name: c(f"{name}_h").isNotNull() | c(f"{name}_w").isNotNull()
    rows = records.withColumns({"t": F.coalesce(utc, boot), "time_uncertainty": spread, "agl": enu[2] + F.when(vehicle, arm[2]).otherwise(0.0) - ground})
    timed = rows["time_uncertainty"] > 0
    tests = {
        "boot_clock_domain_mismatch": c("boot").isNotNull() & F.lit(m.boot_epoch_tai_ns is not None) & ~c("clock_domain").eqNullSafe(F.lit(m.boot_clock_domain)),
        "utc_boot_time_anchors_disagree": apart > m.max_time_uncertainty_ns,
        "capture_time_has_no_explicit_tai_anchor": c("t").isNull(),
        "capture_time_uncertainty_unknown": own.isNull(),
        "capture_time_uncertainty_exceeds_limit": c("time_uncertainty") > m.max_time_uncertainty_ns,
        "thermal_contract_without_thermal_frame": ~c("thermal") & c("thermal_fingerprint").isNotNull(),
        "thermal_registration_contract_unknown": c("thermal") & c("thermal_fingerprint").isNull(),
        "thermal_reference_calibration_mismatch": hot & ~c("thermal_calibration").eqNullSafe(F.lit(m.calibration)),
        "thermal_time_offset_exceeds_limit": hot & (late > m.max_thermal_offset_ns),
        "thermal_time_uncertainty_exceeds_limit": hot & (c("thermal_unc") > m.max_thermal_uncertainty_ns),
        "thermal_registration_error_exceeds_limit": hot & (c("thermal_rms") > m.max_thermal_rms_px),
        "semantic_contract_without_semantic_frame": ~c("semantic") & c("semantic_fingerprint").isNotNull(),
        "semantic_contract_unknown": c("semantic") & c("semantic_fingerprint").isNull(),
        "semantic_reference_calibration_mismatch": marked & ~c("semantic_calibration").eqNullSafe(F.lit(m.calibration)),
        "navigation_fix_unknown": rank.isNull(),
        "navigation_fix_below_minimum": rank < m.minimum_fix,
        "rtk_fixed_required": F.lit(m.require_rtk_fixed) & (rank != 6),
        "capture_position_reference_unknown": F.coalesce(c("position_reference") == "unspecified", F.lit(True)),
        "camera_extrinsic_calibration_unknown": mounted & F.lit(not m.extrinsic_calibration),
        "horizontal_accuracy_unknown": unknown("h_acc", m.default_accuracies[0]),
        "vertical_accuracy_unknown": unknown("v_acc", m.default_accuracies[1]),
        "attitude_accuracy_unknown": unknown("a_acc", m.default_accuracies[2]),
        "timing_velocity_bound_unknown": timed & F.lit(m.velocity_bound is None),
        "timing_angular_rate_bound_unknown": timed & F.lit(m.turn_bound is None),
        "thermal_velocity_bound_unknown": hot & (late > 0) & F.lit(m.velocity_bound is None),
        "thermal_angular_rate_bound_unknown": hot & (late > 0) & F.lit(m.turn_bound is None),
        "camera_ground_elevation_unknown": ground.isNull(),
        "camera_agl_outside_limits": ~F.coalesce(c("agl").between(*m.agl), F.lit(False)),
        "rgb_geometry_does_not_match_calibration": ~(c("rgb_h").eqNullSafe(F.lit(m.height)) & c("rgb_w").eqNullSafe(F.lit(m.width))),
        "thermal_registered_geometry_mismatch": c("thermal") & other("thermal_h", "thermal_w"),
        "semantic_geometry_mismatch": c("semantic") & other("semantic_h", "semantic_w"),
        "semantic_values_must_be_integers": c("semantic") & ~F.coalesce("semantic_whole", F.lit(False)),
        "semantic_values_outside_int32": c("semantic") & ((c("semantic_min") < -(1 << 31)) | (c("semantic_max") >= 1 << 31)),
        "semantic_class_not_in_taxonomy": c("semantic") & (F.size(F.array_except("semantic_classes", F.array(*map(F.lit, m.taxonomy)).cast("array<bigint>"))) > 0),
        "static_validity_geometry_mismatch": given("static") & other("static_h", "static_w"),
        "dynamic_mask_geometry_mismatch": given("dynamic") & other("dynamic_h", "dynamic_w"),
    }
    return rows.withColumns(tests)


def judged(rows: DataFrame, duplicate: str = "duplicate_frame_id", order: list[str] = gates.MISSION) -> DataFrame:
    """mission, seq, frame, reject_reason for ``checked`` records: the first failing gate, as if records arrived one after another by seq, which is unique in a mission."""
    names = [*order, duplicate]
    place = {g: i for i, g in enumerate(names)}
    own = [F.when(F.col(g), i) for g, i in place.items() if g in rows.columns]
    static = F.least(*own, F.lit(None).cast("int")) if own else F.lit(None).cast("int")
    narrow = written(rows.select("mission", "seq", "frame", static.alias("own"), *CONTRACTS.values()), "mission-rows")
    fixed, taken, known = None, None, None
    while True:
        found, later = narrow, []
        if fixed is not None:
            found = found.join(fixed, "mission", "left").join(taken, ["mission", "frame"], "left")
            for gate, name in CONTRACTS.items():
                later.append(F.when((F.col("seq") > F.col(f"_{name}.seq")) & (F.col(name) != F.col(f"_{name}.value")), place[gate]))
            later.append(F.when(F.col("seq") > F.col("taken"), place[duplicate]))
        found = found.withColumn("at", F.least("own", *later, F.lit(None).cast("int")))
        accepted = found.where("at IS NULL")
        first = [F.min(F.when(F.col(name).isNotNull(), F.struct("seq", F.col(name).alias("value")))).alias(f"_{name}") for name in CONTRACTS.values()]
        fixed = written(accepted.groupBy("mission").agg(*first), "mission-contracts")
        taken = written(accepted.groupBy("mission", "frame").agg(F.min("seq").alias("taken")), "mission-frames")
        marks = [df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first() for df in (fixed, taken)]
        if marks == known:
            reason = F.coalesce(*(F.when(F.col("at") == i, name) for name, i in place.items()))
            return found.select("mission", "seq", "frame", reason.alias("reject_reason"))
        known = marks
