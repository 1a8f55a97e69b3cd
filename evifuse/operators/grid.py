"""Frames integrated into a map: gates computed from each frame's own samples, acceptance in arrival order, the whole grid as a snapshot.

A frame is one row (mission, seq, frame, ...), its sampled pixels are rows (mission, seq, ...) already cast onto the ground. Everything that a gate asks
about pixels is a partial sum, so frames of any size are reduced where they are read. Two gates ask what was accepted before: a frame is taken once,
and the classes on the map are limited. A class set that was refused once stays refused, as the map's classes only grow, and one that was
accepted stays accepted. So a mission's order matters only for the first row of each class set: these few rows are judged in
order, the rest follows by joins. A refused frame changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions.ranges import numbered
from evifuse.operators import gates, mosaic
from evifuse.sources.scratch import written

#: Fixed values of the memory estimate: bytes of a cell, of a cell for each class, of a sampled pixel.
CELL_BYTES, CLASS_BYTES, PIXEL_BYTES = 192, 12, 384


def peak_bytes(cells: Column | int, classes: Column | int, pixels: Column | int):
    """Estimated bytes that a dense map of so many cells and classes needs with the largest frame."""
    return cells * (CELL_BYTES + CLASS_BYTES * classes) + pixels * PIXEL_BYTES


@dataclass(frozen=True)
class Settings:
    """A north-up map and its limits."""

    east_min: float
    north_max: float
    resolution: float
    rows: int
    columns: int
    stride: int = 1
    percentile: float = 95.0
    max_uncertainty: float = 5.0
    max_pose_offset_ns: int = 100_000_000
    max_pixels: int = 131_072
    max_classes: int = 256
    max_bytes: int = 536_870_912

    def refusal(self, classes: int) -> str | None:
        """Why a map may not hold so many classes."""
        if classes > self.max_classes:
            return "semantic_class_limit_exceeded"
        if peak_bytes(self.rows * self.columns, classes, self.max_pixels) > self.max_bytes:
            return "semantic_memory_budget_exceeded"
        return None


ROW = ["mission", "seq"]


def placed(samples: DataFrame, settings: Settings) -> DataFrame:
    """Adds the place in cells (east, north as ``col``, ``row``), whether any of the four cells around is on the map, whether the sample may count, its weight."""
    s = settings
    col, row = (F.col("east") - s.east_min) / s.resolution - 0.5, (s.north_max - F.col("north")) / s.resolution - 0.5
    near = lambda at, n: (F.floor(at) >= -1) & (F.floor(at) < n) & ~((F.floor(at) == -1) & (at == -1))  # noqa: E731  a neighbour without a share does not count
    weight = mosaic.splat_weight(F.col("support"), F.least(F.greatest("incidence", F.lit(0.0)), F.lit(1.0)), F.col("sigma"), s.resolution)
    counted = F.col("valid") & F.col("validity") & (F.col("support") > 0) & (F.col("sigma") <= s.max_uncertainty)
    found = samples.withColumns({"col": col, "row": row, "weight": weight, "candidate": F.coalesce(counted, F.lit(False))})
    return found.withColumn("inside", F.coalesce(F.col("candidate") & near(F.col("col"), s.columns) & near(F.col("row"), s.rows), F.lit(False)))


def summaries(frames: DataFrame, samples: DataFrame, settings: Settings) -> DataFrame:
    """``frames`` with what their samples come to: safe, mean, largest and percentile uncertainty, samples that count, that lie on the map, that weigh anything, their classes."""
    s = settings
    safe = F.coalesce(F.col("valid"), F.lit(False))
    sigma, weighing = F.when(safe, F.col("sigma")), F.col("inside") & (F.col("weight") > 0)
    found = placed(samples, s).groupBy(*ROW).agg(
        F.count_if(safe).alias("safe"), F.avg(sigma).alias("mean_uncertainty"), F.max(sigma).alias("max_uncertainty"), F.percentile(sigma, F.lit(s.percentile / 100)).alias("uncertainty"),
        F.count_if("candidate").alias("candidates"), F.count_if("inside").alias("inside"), F.count_if(weighing).alias("integrated"),
        F.array_sort(F.collect_set(F.when(weighing & (F.col("class") >= 0), F.col("class").cast("long")))).alias("classes"),
    )
    along = lambda c: F.ceil(F.col(c) / s.stride)
    whole = frames.join(found, ROW, "left").fillna(0, ["safe", "candidates", "inside", "integrated"])
    return whole.withColumn("classes", F.coalesce("classes", F.array().cast("array<bigint>"))).withColumn("sampled", along("height") * along("width"))


def checked(rows: DataFrame, settings: Settings) -> DataFrame:
    """Adds a boolean column for each gate that a frame fails or passes by itself."""
    s = settings
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    tests = {
        "unknown_capture_time": F.col("t").isNull(),
        "unknown_camera_calibration": blank("calibration"),
        "unknown_vehicle_camera_pose": blank("pose"),
        "unknown_pose_time": F.col("pose_t").isNull(),
        "calibration_geometry_mismatch": ~(F.col("image_height").eqNullSafe(F.col("height")) & F.col("image_width").eqNullSafe(F.col("width"))),
        "pose_time_offset_exceeds_limit": F.abs(F.col("t") - F.col("pose_t")) > s.max_pose_offset_ns,
        "sampled_pixel_limit_exceeded": F.col("sampled") > s.max_pixels,
        "no_safe_ground_intersections": F.col("safe") == 0,
        "projected_uncertainty_exceeds_limit": F.col("uncertainty") > s.max_uncertainty,
        "no_supported_samples_after_uncertainty_gate": F.col("candidates") == 0,
        "projected_footprint_outside_map": F.col("inside") == 0,
        "zero_weight_after_splat": F.col("integrated") == 0,
    }
    return rows.withColumns(tests)


def _class_decisions(firsts: DataFrame, settings: Settings) -> DataFrame:
    """mission, classes, refused: the first rows of each class set judged in order, the map's classes being all that is remembered."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mission, held = None, set()
        for batch in batches:
            out = []
            for m, classes in zip(batch.column("mission").to_pylist(), batch.column("classes").to_pylist()):
                if m != mission:
                    mission, held = m, set()
                refused = settings.refusal(len(held | set(classes))) if classes else None
                if refused is None:
                    held |= set(classes)
                out.append(refused)
            yield pa.RecordBatch.from_arrays([batch.column("mission"), batch.column("classes"), pa.array(out, pa.string())], ["mission", "classes", "refused"])

    kind = firsts.schema["mission"].dataType.simpleString()
    parted = firsts.repartition("mission").sortWithinPartitions("mission", "seq").select("mission", "classes")
    return parted.mapInArrow(task, f"mission {kind}, classes array<bigint>, refused string")


#: Where in the gates' order the frame must be new.
NEW = gates.GRID.index("duplicate_frame_id")


def judged(rows: DataFrame, settings: Settings) -> DataFrame:
    """Adds reject_reason to ``summaries``: the first failing gate, as if frames arrived one after another by seq. Missions and frames are not null."""
    first = gates.first_failure(gates.first_failure(checked(rows, settings), gates.GRID[:NEW], "_before"), gates.GRID[NEW + 1 :], "_after")
    rows = written(first.drop(*gates.GRID), "grid-frames")
    passing = rows.where("_before IS NULL AND _after IS NULL").select(*ROW, "frame", "classes")
    taken, known = None, None
    while True:
        new = passing if taken is None else passing.join(taken, ["mission", "frame"], "left").where("taken IS NULL OR seq <= taken").drop("taken")
        firsts = written(new.groupBy("mission", "classes").agg(F.min("seq").alias("seq")), "grid-firsts")
        mark = firsts.agg(F.count(F.lit(1)), F.sum(F.xxhash64("mission", "classes", "seq").cast("decimal(20,0)"))).first()
        if mark == known:  # the same first rows are judged alike, so nothing changes any more
            break
        known, decided = mark, written(_class_decisions(firsts, settings), "grid-classes")
        allowed = passing.join(decided.where("refused IS NULL"), ["mission", "classes"])
        taken = written(allowed.groupBy("mission", "frame").agg(F.min("seq").alias("taken")), "grid-taken")
    told = rows.join(taken, ["mission", "frame"], "left").join(decided, ["mission", "classes"], "left")
    reason = F.coalesce("_before", F.when(F.col("seq") > F.col("taken"), F.lit("duplicate_frame_id")), "_after", "refused")
    return told.withColumn("reject_reason", reason).drop("_before", "_after", "taken", "refused")


def contributions(accepted: DataFrame, samples: DataFrame, settings: Settings) -> DataFrame:
    """A row for each sample of an accepted frame and each cell that it adds to: mission, seq, frame, row, col, w and the sample's values."""
    own = placed(samples, settings).where("inside AND weight > 0").withColumnsRenamed({"col": "_col", "row": "_row"})
    near = own.withColumns({"east": F.col("_col"), "north": F.col("_row")}).drop("_col", "_row", "inside", "candidate").join(accepted.select(*ROW, "frame"), ROW)
    return mosaic.splat(near, settings.rows, settings.columns)


def snapshot(accepted: DataFrame, parts: DataFrame, settings: Settings) -> DataFrame:
    """Every cell of every mission's map, contributions or none: mean values (null where nothing adds to them), supports, coverage, the winning class
    (-1: none) with its confidence, the source with the most weight as its place among the accepted frames (-1: none)."""
    sums = parts.groupBy("mission", "row", "col").agg(
        F.sum("w").alias("weight"), *((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in ("value", "up", "sigma")), F.count(F.lit(1)).alias("coverage_count"),
        F.sum(F.when(F.col("thermal").isNotNull(), F.col("w"))).alias("thermal_weight"), F.sum(F.col("w") * F.col("thermal")).alias("thermal_sum"),
    )
    evidence = parts.where("class >= 0").groupBy("mission", "row", "col", "class").agg(F.sum("w").alias("w"))
    classes = evidence.groupBy("mission", "row", "col").agg(F.max_by("class", F.struct("w", -F.col("class"))).alias("class"),
        (F.max("w") / F.sum("w")).alias("confidence"), F.sum("w").alias("semantic_weight"))
    places = numbered(accepted.select(*ROW), "mission", "seq")
    first = places.groupBy("mission").agg(F.min("number").alias("start"))
    indexed = places.join(first, "mission").select(*ROW, (F.col("number") - F.col("start")).alias("source_index"))
    each = parts.groupBy("mission", "row", "col", "seq").agg(F.sum("w").alias("w"))
    dominant = each.groupBy("mission", "row", "col").agg(F.max_by("seq", F.struct("w", -F.col("seq"))).alias("seq")).join(indexed, ROW).drop("seq")
    missions = accepted.select("mission").distinct()
    cells = missions.select("mission", F.explode(F.sequence(F.lit(0), F.lit(settings.rows - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(settings.columns - 1))).alias("col"))
    at = ["mission", "row", "col"]
    whole = cells.join(sums, at, "left").join(classes, at, "left").join(dominant, at, "left")
    support = lambda c: 1 - F.exp(-F.coalesce(F.col(c), F.lit(0.0)))
    return whole.select(
        *at, "value", "up", "sigma", (F.col("thermal_sum") / F.col("thermal_weight")).alias("thermal"), support("weight").alias("support"),
        support("thermal_weight").alias("thermal_support"), support("semantic_weight").alias("semantic_support"),
        F.coalesce("coverage_count", F.lit(0)).alias("coverage_count"), F.coalesce("class", F.lit(-1)).cast("int").alias("class"), F.coalesce("confidence",
        F.lit(0.0)).alias("confidence"), F.coalesce("source_index", F.lit(-1)).alias("source_index"),
    )

