"""From telemetry to camera poses: capture times, a clock that both sides share, positions and attitudes in between.

Samples have keys, seq, mono (ns since boot or null), domain (of the boot clock), utc (ns or null), lat, lon, alt and q (w, x, y, z,
north-east-down to the body). Captures have keys, target, mono, domain, utc and unc. Nulls are unknown and never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions import frames, geo
from evifuse.operators import sync

#: What the types of a satellite fix are called.
FIXES = {0: "no_gps", 1: "no_fix", 2: "2d_fix", 3: "3d_fix", 4: "dgps", 5: "rtk_float", 6: "rtk_fixed", 7: "static", 8: "ppp"}
RTK = {0: "no_gps", 1: "no_fix", 5: "float", 6: "fixed"}


def fix_quality(fix: Column) -> tuple[Column, Column]:
    """Name of a fix and whether it is corrected by a base station; null is unknown."""
    named = F.coalesce(*(F.when(fix == k, name) for k, name in FIXES.items()), F.concat(F.lit("fix_type_"), fix.cast("string")))
    rtk = F.coalesce(*(F.when(fix == k, name) for k, name in RTK.items()), F.lit("not_rtk"))
    return F.when(fix.isNull(), "unknown").otherwise(named), F.when(fix.isNull(), "unknown").otherwise(rtk)


def shifted(captures: DataFrame, lag_ns: int, lag_uncertainty_ns: int) -> DataFrame:
    """Times of exposure, the shutter's lag after the event. Uncertainties add up; before a clock's origin there is no time."""
    moved = {name: F.col(name) + lag_ns for name in ("mono", "utc")}
    early = F.coalesce(moved["mono"] < 0, F.lit(False)) | F.coalesce(moved["utc"] < 0, F.lit(False))
    reason = F.when(early, F.lit("before_clock_origin"))
    return captures.withColumns({**moved, "unc": F.col("unc") + lag_uncertainty_ns, "reason": reason})


def with_basis(captures: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Adds basis, clock and t: the boot clock if any sample has the same, else UTC if both sides know it, else a reason.

    Only the distinct clocks of the samples are joined.
    """
    booted = F.col("mono").isNotNull() & F.col("domain").isNotNull()
    clocks = samples.where(booted).select(*keys, "domain").distinct().withColumn("_same", F.lit(True))
    known = samples.groupBy(*keys).agg(F.bool_or(F.col("utc").isNotNull()).alias("_utc"), F.bool_or(booted).alias("_boot"))
    both = captures.join(clocks, [*keys, "domain"], "left").join(known, keys, "left")
    unnamed = F.col("mono").isNotNull() & F.col("domain").isNull()
    open_ = F.col("reason").isNull() & ~unnamed
    basis = F.when(open_ & F.col("mono").isNotNull() & F.coalesce("_same", F.lit(False)), "boot")
    basis = F.coalesce(basis, F.when(open_ & F.col("utc").isNotNull() & F.coalesce("_utc", F.lit(False)), "utc"))
    strangers = F.col("mono").isNotNull() & F.coalesce("_boot", F.lit(False))
    reason = F.coalesce(
        "reason",
        F.when(unnamed, "boot_domain_missing"),
        F.when(F.col("basis").isNull(), F.when(strangers, "boot_clocks_differ").otherwise("no_common_time_basis")),
    )
    chosen = both.withColumn("basis", basis).withColumn("reason", reason)
    clock = F.when(F.col("basis") == "boot", F.col("domain")).when(F.col("basis") == "utc", "UTC")
    t = F.when(F.col("basis") == "boot", F.col("mono")).when(F.col("basis") == "utc", F.col("utc"))
    return chosen.withColumns({"clock": clock, "t": t}).drop("_same", "_utc", "_boot")


def by_clock(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Each sample once for each clock that it knows: basis, clock, t and the values as v."""
    boot = F.when(F.col("domain").isNotNull(), F.struct(F.lit("boot").alias("basis"), F.col("domain").alias("clock"), F.col("mono").alias("t")))
    utc = F.struct(F.lit("utc").alias("basis"), F.lit("UTC").alias("clock"), F.col("utc").alias("t"))
    clocks = F.explode(F.filter(F.array(boot, utc), lambda c: c["t"].isNotNull()))
    rows = samples.select(*keys, "seq", F.struct("lat", "lon", "alt", "q").alias("v"), clocks.alias("c"))
    return rows.select(*keys, "seq", "c.basis", "c.clock", "c.t", "v")


def _unit(rows: DataFrame, name: str, q: frames.Quaternion) -> tuple[DataFrame, frames.Quaternion]:
    """A quaternion normalized, before and after as columns of their own: each step uses the one before many times, and as one expression would repeat it."""
    rows = rows.withColumns({f"{name}{i + 4}": x for i, x in enumerate(q)})
    unit = geo.normalized([F.col(f"{name}{i + 4}") for i in range(4)])
    return rows.withColumns({f"{name}{i}": x for i, x in enumerate(unit)}), [F.col(f"{name}{i}") for i in range(4)]


def poses(captures: DataFrame, samples: DataFrame, keys: list[str], max_gap: int, acceleration: float, turning: float) -> DataFrame:
    """A row for each capture: position and attitude between its samples, the bounds of both, or a reason.

    A capture goes through the brackets as a whole, so targets may repeat, within a key or among keys, or be null.
    Latitude and altitude are linear, longitude goes the shorter way round, attitude along the shorter arc. Nothing is
    extrapolated. ``acceleration`` (m/s2) and ``turning`` (degrees/s2) bound what the motion between samples can add.
    """
    chosen = with_basis(captures, samples, keys)
    clocked = [*keys, "basis", "clock"]
    whole = F.struct(*(F.col(f"`{c}`") for c in chosen.columns)).alias("target")
    clocks = [F.col(c) for c in clocked]
    found = sync.brackets(by_clock(samples, keys), chosen.select(*clocks, whole, "t"), clocked)
    rows = found.select("target.*", *(F.col(c).alias(f"_{c}") for c in ("lo_t", "lo_v", "hi_t", "hi_v")))
    span = F.col("_hi_t") - F.col("_lo_t")
    ends = [F.col(f"_{end}_v") for end in ("lo", "hi")]
    unplaced = F.greatest(*(e[name].isNull() | F.isnan(e[name]) for e in ends for name in ("lat", "lon", "alt")))
    turns = []
    for end, e in zip("ab", ends):
        rows, turn = _unit(rows, f"_{end}", [e["q"][i] for i in range(4)])
        turns.append(turn)
    reason = F.coalesce(
        "reason",
        sync.first_reason(
            (F.col("_lo_t").isNull(), "no_sample_before"),
            (F.col("_hi_t").isNull(), "no_sample_after"),
            (span > max_gap, "gap_exceeds_limit"),
            (unplaced, "invalid_position"),
            (F.greatest(*(q[0].isNull() for q in turns)), "invalid_attitude"),
        ),
    )
    share = F.when(span == 0, F.lit(0.0)).otherwise((F.col("t") - F.col("_lo_t")) / span)
    rows = rows.withColumn("reason", reason).withColumn("share", F.when(F.col("reason").isNull(), share)).withColumn("span_ns", F.when(F.col("reason").isNull(), span))
    f, seconds = F.col("share"), F.col("span_ns") / F.lit(1e9)
    linear = lambda name: ends[0][name] + (ends[1][name] - ends[0][name]) * f
    placed = {"lat": linear("lat"), "lon": geo.wrapped_between(ends[0]["lon"], ends[1]["lon"], f), "alt": linear("alt")}
    bounds = {"position_bound_m": sync.motion_bound(seconds, f, acceleration), "attitude_bound_deg": sync.motion_bound(seconds, f, turning)}
    rows, attitude = _unit(rows.withColumns({**placed, **bounds}), "_q", geo.mixed(*turns, f))
    rows, flu = _unit(rows, "_f", frames.enu_flu_of(attitude))
    rows, optical = _unit(rows, "_o", frames.optical_of(flu))
    yaw, pitch, roll = geo.euler_zyx(attitude)
    full = {"flu": F.array(*flu), "optical": F.array(*optical), "yaw_deg": yaw, "pitch_deg": pitch, "roll_deg": roll}
    rows = rows.withColumns({name: F.when(F.col("reason").isNull(), value) for name, value in full.items()})
    return rows.drop("_lo_t", "_lo_v", "_hi_t", "_hi_v", *(f"_{step}{i}" for step in "abqfo" for i in range(8)))
