"""Record contracts as reject reasons: the first rule that a record breaks names the reason, null means accepted.

Each function takes the record's columns by name from ``rows`` and adds ``reject_reason``. Arrays hold geometries
(``shape`` of an image is height, width, channels), so no pixel is read to judge a record. A missing or NaN value of a
required number breaks its rule; a missing optional value does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import frames
from evifuse.operators.grid import peak_bytes

#: The states of synchronization, those that allow pixels to be fused, and what a state may rest on.
STATES = (
    "unknown", "exact", "bounded_skew", "interpolated", "declared_replay_aligned", "late", "future", "missing", "stale",
    "incompatible_clock_domain", "unsynchronized",
)
ELIGIBLE = ("exact", "bounded_skew", "interpolated", "declared_replay_aligned")
BASES = ("unknown", "measured", "declared")

#: Which capture times each basis promises (boot, UTC).
TIME_BASES = {"mavlink_system_boot": (True, False), "utc": (False, True), "mavlink_system_boot+utc": (True, True)}
ALTITUDE_REFERENCES = ("ground", "home", "unspecified", "not_available")
POSITION_REFERENCES = ("camera_optical_center", "vehicle_navigation_origin", "unspecified")

Rule = tuple[str, Column]


def judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    return rows.withColumn("reject_reason", F.coalesce(*(F.when(broken, F.lit(reason)) for reason, broken in rules), F.lit(None).cast("string")))


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(name) == "", F.lit(True))


def _negative(name: str) -> Column:
    return F.coalesce(F.col(name) < 0, F.lit(False))


def _outside(name: str, low: float, high: float) -> Column:
    return ~F.coalesce(F.col(name).between(low, high), F.lit(False))


def _unlike(name: str, names: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(name).isin(*names), F.lit(False))


def _not_finite(value: Column) -> Column:
    return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(True))


def _differ(a: Column, b: Column) -> Column:
    """Two geometries are not the same; a missing one agrees with anything."""
    return F.coalesce(a != b, F.lit(False))


def timestamps(rows: DataFrame) -> DataFrame:
    """tai_ns, uncertainty_ns, clock_id, clock_domain; adds ``effective_domain``, the one in which times compare."""
    rules = [
        ("timestamp_negative", _negative("tai_ns")),
        ("uncertainty_negative", _negative("uncertainty_ns")),
        ("uncertainty_of_unknown_time", F.col("tai_ns").isNull() & F.col("uncertainty_ns").isNotNull()),
        ("clock_id_missing", F.coalesce(F.col("clock_id") == "", F.lit(True))),
        ("clock_domain_empty", F.coalesce(F.col("clock_domain") == "", F.lit(False))),
    ]
    return judged(rows, rules).withColumn("effective_domain", F.coalesce(F.when(F.col("clock_domain") != "", F.col("clock_domain")), "clock_id"))


def observations(rows: DataFrame) -> DataFrame:
    """sensor_id, modality, frame_id, shape, validity_shape, uncertainty_shape, uncertainty_min, uncertainty_max.

    Validity follows rows or the image's height and width; uncertainty follows the sample, its rows, its image, or is one
    number (an empty shape). Its extremes stand for all of its values.
    """
    shape, validity, spread = F.col("shape"), F.col("validity_shape"), F.col("uncertainty_shape")
    image, height = F.slice(shape, 1, 2), F.slice(shape, 1, 1)
    fits = F.when(F.size(shape) == 1, validity == shape).otherwise((validity == height) | (F.slice(validity, 1, 2) == image))
    spread_fits = (F.size(spread) == 0) | (spread == shape) | (spread == height) | ((F.size(shape) >= 2) & (spread == image))
    bad = _not_finite(F.col("uncertainty_min")) | _not_finite(F.col("uncertainty_max")) | _negative("uncertainty_min")
    rules = [
        ("identity_missing", F.coalesce((F.col("sensor_id") == "") | (F.col("modality") == "") | (F.col("frame_id") == ""), F.lit(True))),
        ("dimensions_unsupported", F.coalesce(~F.size(shape).between(1, 4), F.lit(True))),
        ("validity_geometry_mismatch", F.coalesce(~fits, F.lit(False))),
        ("uncertainty_not_finite_or_negative", spread.isNotNull() & bad),
        ("uncertainty_geometry_mismatch", F.coalesce(~spread_fits, F.lit(False))),
    ]
    return judged(rows, rules)


def detections(rows: DataFrame) -> DataFrame:
    """confidence, x, y, width, height, all normalized."""
    rules = [(f"{name}_outside_unit", _outside(name, 0.0, 1.0)) for name in ("confidence", "x", "y", "width", "height")]
    beyond = (F.col("x") + F.col("width") > 1.000001) | (F.col("y") + F.col("height") > 1.000001)
    return judged(rows, [*rules, ("box_beyond_image", beyond)])


def evidence_frames(rows: DataFrame) -> DataFrame:
    """observations (key, sensor_id, frame_id, height, width, domain), transform_shapes, reference_frame, mask_shape, state,
    eligible, alignment, dataset.

    Adds ``declared``: an unknown state becomes a declared alignment if the publisher states the rectification and all
    observations come from one archive's clock.
    """
    seen = F.col("observations")
    reference = F.filter(seen, lambda o: o["frame_id"] == F.col("reference_frame"))
    geometry = F.when(F.size(reference) > 0, F.array(reference[0]["height"], reference[0]["width"]))
    masked = F.col("mask_shape").isNotNull()
    square = lambda s: (s == F.array(F.lit(3), F.lit(3))) | (s == F.array(F.lit(4), F.lit(4)))
    rules = [
        ("observations_missing", F.coalesce(F.size(seen), F.lit(0)) <= 0),
        ("observation_key_mismatch", F.exists(seen, lambda o: o["key"] != o["sensor_id"])),
        ("transform_shape_unsupported", F.coalesce(F.exists("transform_shapes", lambda s: ~square(s)), F.lit(False))),
        ("reference_without_observation", masked & (F.size(reference) == 0)),
        ("mask_geometry_mismatch", masked & _differ(geometry, F.col("mask_shape"))),
    ]
    domains = F.array_distinct(F.transform(seen, lambda o: o["domain"]))
    stated = (F.col("alignment") == "publisher_provided_rectification") & (F.col("dataset") != "")
    archive = (F.size(domains) == 1) & F.endswith(domains[0], F.lit("_archive"))
    declared = (F.col("state") == "unknown") & ~F.col("eligible") & stated & archive
    found = judged(rows, rules)
    return found.withColumn("declared", F.col("reject_reason").isNull() & F.coalesce(declared, F.lit(False)))


def statuses(rows: DataFrame) -> DataFrame:
    """state, eligible, basis, interpolation_performed, measured_ns, effective_ns, physical_ns, sensor_states, sensor_effective_ns."""
    state, eligible = F.col("state"), F.coalesce("eligible", F.lit(False))
    strange = F.exists("sensor_states", lambda s: ~F.coalesce(s.isin(*STATES), F.lit(False)))
    rules = [
        ("state_unsupported", _unlike("state", STATES)),
        ("basis_unsupported", _unlike("basis", BASES)),
        ("eligible_state_required", eligible & ~state.isin(*ELIGIBLE)),
        ("eligible_basis_required", eligible & (F.col("basis") == "unknown")),
        ("declared_basis_required", (state == "declared_replay_aligned") & (F.col("basis") != "declared")),
        ("interpolation_not_performed", (state == "interpolated") & eligible & ~F.coalesce("interpolation_performed", F.lit(False))),
        *((f"{name}_negative", _negative(name)) for name in ("measured_ns", "effective_ns", "physical_ns")),
        ("effective_below_measured", F.coalesce(F.col("effective_ns") < F.col("measured_ns"), F.lit(False))),
        ("sensor_state_unsupported", F.coalesce(strange, F.lit(False))),
        ("sensor_effective_negative", F.coalesce(F.exists("sensor_effective_ns", lambda n: F.coalesce(n < 0, F.lit(False))), F.lit(False))),
    ]
    return judged(rows, rules)


def outputs(rows: DataFrame) -> DataFrame:
    """operator_shape, tensor_shape, n_channels, support and registration (shape, least, greatest), view shapes, state, physical_ns."""
    operator, tensor = F.col("operator_shape"), F.col("tensor_shape")
    image = F.slice(operator, 1, 2)
    rules = [
        ("operator_view_not_rgb", F.coalesce((F.size(operator) != 3) | (operator[2] != 3), F.lit(True))),
        ("channels_not_named", F.coalesce((F.size(tensor) != 3) | (tensor[0] != F.col("n_channels")), F.lit(True))),
        ("tensor_geometry_mismatch", _differ(F.slice(tensor, 2, 2), image)),
    ]
    for name in ("support", "registration"):
        unit = F.col(f"{name}_least").between(0, 1) & F.col(f"{name}_greatest").between(0, 1)
        rules.append((f"{name}_geometry_mismatch", F.coalesce(F.col(f"{name}_shape") != image, F.lit(True))))
        rules.append((f"{name}_outside_unit", ~F.coalesce(unit, F.lit(False))))
    rules += [(f"{name}_geometry_mismatch", _differ(F.slice(f"{name}_shape", 1, 2), image)) for name in ("thermal", "visible", "semantic")]
    return judged(rows, [*rules, ("state_unsupported", _unlike("state", STATES)), ("physical_ns_negative", _negative("physical_ns"))])


def pose_records(rows: DataFrame) -> DataFrame:
    """Camera poses of images: names, angles, the two quaternions (arrays w, x, y, z), accuracies, times and their basis.

    ``flu`` and ``optical`` are the camera's rotations into east, north, up from its forward-left-up and from its
    right-down-forward axes; the second must follow from the first.
    """
    flu, optical = ([F.col(name)[i] for i in range(4)] for name in ("flu", "optical"))
    length = lambda q: F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    expected, told = frames.matrix([F.col(f"_e{i}") for i in range(4)]), frames.matrix([F.col(f"_o{i}") for i in range(4)])
    apart = F.greatest(*(F.abs(a - b) for a, b in zip(sum(expected, []), sum(told, []))))
    boot, utc = F.col("capture_monotonic_ns").isNotNull(), F.col("capture_utc_ns").isNotNull()
    promised = [(F.col("time_basis") == basis) & ((boot != has_boot) | (utc != has_utc)) for basis, (has_boot, has_utc) in TIME_BASES.items()]
    plain = [(f"{n}_not_finite", _not_finite(F.col(n))) for n in ("latitude_deg", "longitude_deg", "altitude_msl_m", "yaw_deg", "pitch_deg", "roll_deg")]
    relative = F.col("relative_altitude_m")
    accuracies = ("horizontal_accuracy_m", "vertical_accuracy_m", "attitude_accuracy_deg")
    wrong = lambda n: F.col(n).isNotNull() & (_not_finite(F.col(n)) | (F.col(n) < 0))
    times = ("capture_monotonic_ns", "capture_utc_ns", "event_monotonic_ns", "event_utc_ns", "time_uncertainty_ns", "interpolation_span_ns")
    rules = [
        ("image_name_missing", _blank("image_name")),
        ("image_index_negative", _negative("image_index")),
        *plain,
        ("relative_altitude_m_not_finite", relative.isNotNull() & _not_finite(relative)),
        ("latitude_outside", _outside("latitude_deg", -90, 90)),
        ("longitude_outside", _outside("longitude_deg", -180, 180)),
        *((f"{n}_not_normalized", ~F.coalesce(F.abs(length(q) - 1) <= 1e-6, F.lit(False))) for n, q in (("flu", flu), ("optical", optical))),
        ("rotations_contradict", apart > 1e-6),
        *((f"{n}_negative", wrong(n)) for n in accuracies),
        *((f"{n}_negative", _negative(n)) for n in times),
        ("time_basis_unsupported", _unlike("time_basis", tuple(TIME_BASES))),
        ("capture_time_missing", ~boot & ~utc),
        ("time_basis_contradicts_times", promised[0] | promised[1] | promised[2]),
        ("clock_domain_missing", _blank("clock_domain")),
        ("fix_type_unknown", F.col("fix_type").isNotNull() & ~F.col("fix_type").between(0, 8)),
        ("altitude_reference_unsupported", _unlike("relative_altitude_reference", ALTITUDE_REFERENCES)),
        ("position_reference_unsupported", _unlike("position_reference", POSITION_REFERENCES)),
    ]
    steps = {f"_e{i}": x for i, x in enumerate(frames.optical_of(flu))} | {f"_o{i}": x for i, x in enumerate(optical)}
    return judged(rows.withColumns(steps), rules).drop(*steps)


def mosaic_settings(rows: DataFrame) -> DataFrame:
    """Bounds, resolution and limits of a north-up map; adds ``width`` and ``height`` of accepted ones."""
    reals = (
        "east_min_m", "east_max_m", "north_min_m", "north_max_m", "resolution_m", "ground_elevation_m", "intersection_tolerance_m",
        "min_downward_cosine", "max_slant_range_m", "max_projected_uncertainty_m", "uncertainty_percentile",
    )
    counts = ("max_cells", "max_semantic_classes", "max_peak_memory_bytes", "max_sampled_pixels", "surface_ray_max_work")
    positive = lambda n: ~F.coalesce(F.col(n) > 0, F.lit(False))
    across = (F.col("east_max_m") - F.col("east_min_m")) / F.nullif(F.col("resolution_m"), F.lit(0.0))
    along = (F.col("north_max_m") - F.col("north_min_m")) / F.nullif(F.col("resolution_m"), F.lit(0.0))
    whole = lambda n: F.abs(n - F.round(n)) <= 1e-9 + 1e-5 * F.abs(F.round(n))
    rules = [
        *((f"{n}_not_finite", _not_finite(F.col(n))) for n in reals),
        ("bounds_without_area", (F.col("east_max_m") <= F.col("east_min_m")) | (F.col("north_max_m") <= F.col("north_min_m"))),
        ("resolution_not_positive", positive("resolution_m")),
        ("tolerance_not_positive", positive("intersection_tolerance_m")),
        ("ray_step_not_positive", F.col("surface_ray_step_m").isNotNull() & (positive("surface_ray_step_m") | _not_finite(F.col("surface_ray_step_m")))),
        ("iterations_not_positive", positive("intersection_max_iterations")),
        ("ray_steps_not_positive", positive("surface_ray_max_steps")),
        ("downward_cosine_outside", positive("min_downward_cosine") | (F.col("min_downward_cosine") > 1)),
        ("limits_not_positive", positive("max_slant_range_m") | positive("max_projected_uncertainty_m")),
        ("percentile_outside", positive("uncertainty_percentile") | (F.col("uncertainty_percentile") > 100)),
        ("pose_offset_negative", ~F.coalesce(F.col("max_pose_time_offset_ns") >= 0, F.lit(False))),
        *((f"{n}_not_positive", positive(n)) for n in counts),
        ("spans_not_multiples", ~(whole(across) & whole(along))),
        ("cells_exceed_limit", F.round(across) * F.round(along) > F.col("max_cells")),
        ("memory_estimate_exceeds_limit", peak_bytes(F.round(across) * F.round(along), 0, F.col("max_sampled_pixels")) > F.col("max_peak_memory_bytes")),
    ]
    kept = F.col("reject_reason").isNull()
    found = judged(rows, rules)
    return found.withColumn("width", F.when(kept, F.round(across).cast("long"))).withColumn("height", F.when(kept, F.round(along).cast("long")))
