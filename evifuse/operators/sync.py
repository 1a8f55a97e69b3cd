"""Synchronization of asynchronous streams: nearest selection, brackets, clock gates.

Null times, uncertainties and clocks mean unknown. They never match and never count as zero. A failed gate gives
a row with a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.functions.ranges import cut, range_of


@dataclass(frozen=True)
class Policy:
    """Tolerances in nanoseconds."""

    exact: int = 0
    fusion: int = 3_600_000_000_000
    stale: int = 7_200_000_000_000


def first_reason(*gates: tuple[Column, str]) -> Column:
    """The reason of the first failing gate, in this order; null if none fails."""
    return F.coalesce(*(F.when(fails, F.lit(reason)) for fails, reason in gates))


def state_of(delta: Column, pair_unc: Column, is_reference: Column, policy: Policy) -> Column:
    """Label of a selected pair: its worst case is the nominal gap and both uncertainties."""
    worst = F.abs(delta) + pair_unc
    return (
        F.when(is_reference, "exact")
        .when(delta.isNull(), "missing")
        .when(pair_unc.isNull(), "unsynchronized")
        .when(worst > policy.stale, "missing")
        .when(worst <= policy.exact, "exact")
        .when(delta < 0, "late")
        .when(delta > 0, "future")
        .otherwise("bounded_skew")
    )


def nearest(observations: DataFrame, reference: str, policy: Policy) -> DataFrame:
    """For each observation of the reference stream (``ref``, unique) and each other stream of its rig: the cheapest partner.

    The cost is the time gap plus both uncertainties; a pair of unknown uncertainty costs one more than the
    staleness bound, so it is chosen last but not excluded. The first arrival wins ties. Candidates lie within
    the staleness bound: times are cut into cells of that width, so all before a reference are the end of one cell and the
    start of its own, and likewise all after. Running minima from either end of each cell tell the best of them; nothing is paired.

    Without a candidate the state is ``missing``, but ``incompatible_clock_domain`` where the rig's stream has no observation of the
    reference's clock, and ``unknown`` where those that it has lack times.
    """
    stale = policy.stale
    refs = observations.where((F.col("stream") == reference) & F.col("t").isNotNull()).select("rig", "domain", F.col("seq").alias("ref"), F.col("t").alias("ref_t"), F.col("unc").alias("ref_unc"))
    others = observations.where(F.col("stream") != reference)
    names = [r.stream for r in others.select("stream").distinct().collect()]  # as many as there are sensors
    wanted = refs.withColumn("stream", F.explode(F.array(*map(F.lit, sorted(names))).cast("array<string>")))
    cell = lambda t: ((t - F.pmod(t, F.lit(stale))) / stale).cast("long")
    own = others.where("t IS NOT NULL AND domain IS NOT NULL")
    own = own.select("rig", "domain", "stream", "t", cell(F.col("t")).alias("cell"), F.struct("t", "seq", "unc").alias("o"), *(F.lit(None).cast(k).alias(c) for c,
        k in (("ref", "long"), ("end", "int"), ("ref_t", "long"), ("ref_unc", "long"))))
    # the start of the own cell and the end of the one before hold what was earlier, the end of the own and the start of the next what came later
    ends = ((0, True, -1), (-stale, False, -1), (0, False, 1), (stale, True, 1))
    shift = F.element_at(F.array(*(F.lit(s).cast("long") for s, _, _ in ends)), F.col("end") + 1)
    asked = wanted.where("domain IS NOT NULL").withColumn("end", F.explode(F.array(*map(F.lit, range(len(ends)))))).withColumn("t", F.col("ref_t") + shift)
    asked = asked.select("rig", "domain", "stream", "t", cell(F.col("t")).alias("cell"), F.lit(None).cast(own.schema["o"].dataType).alias("o"), "ref", "end", "ref_t", "ref_unc")
    t, unc = F.col("o.t"), F.col("o.unc")
    lane = Window.partitionBy("rig", "domain", "stream", "cell")
    both, sides = own.unionByName(asked), ([], [], [])
    for i, (_, rising, sign) in enumerate(ends):
        frame = lane.orderBy(F.col("t") if rising else F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
        for side, key, which in zip(sides, (sign * t + unc, sign * t, sign * t), (unc.isNotNull(), unc.isNull(), F.lit(True))):
            best = F.min(F.when(F.col("o").isNotNull() & which, F.struct(key.alias("key"), F.col("o.seq").alias("seq"), "o"))).over(frame)
            side.append(F.when(F.col("end") == i, best["o"]))
    told = both.select("ref", "stream", "ref_t", "ref_unc", *(F.coalesce(*side).alias(name) for side, name in zip(sides, ("sure", "unsure", "any")))).where("ref IS NOT NULL")
    gap = lambda o: F.abs(F.col(f"{o}.t") - F.col("ref_t"))
    priced = lambda o, more: F.when(F.col(o).isNotNull(), F.struct((gap(o) + more).alias("cost"), F.col(f"{o}.seq").alias("seq"), F.col(f"{o}.t").alias("t"),
        F.col(f"{o}.unc").alias("unc")))
    price = F.when(F.col("ref_unc").isNull(), priced("any", F.lit(stale + 1))).otherwise(F.least(priced("sure", F.col("sure.unc") + F.col("ref_unc")), priced("unsure", F.lit(stale + 1))))
    best = told.select("ref", "stream", price.alias("best")).groupBy("ref", "stream").agg(F.min("best").alias("best"))
    seen = others.groupBy("rig", "stream", "domain").agg(F.bool_or(F.col("t").isNotNull()).alias("timed"))
    rows = wanted.join(best, ["ref", "stream"], "left").join(seen, ["rig", "stream", "domain"], "left").join(seen.select("rig", "stream",
        F.lit(True).alias("there")).distinct(), ["rig", "stream"], "left")
    delta = F.col("best.t") - F.col("ref_t")
    pair = F.col("best.unc") + F.col("ref_unc")
    absent = F.when(F.col("best").isNull() & F.col("there"), F.when(F.col("timed").isNull(), "incompatible_clock_domain").when(~F.col("timed"), "unknown"))
    return rows.select(
        "ref", "rig", "stream", F.col("best.seq").alias("seq"), delta.alias("skew_ns"), (F.abs(delta) + pair).alias("effective_ns"),
        F.coalesce(absent, state_of(delta, pair, F.lit(False), policy)).alias("state"),
    )


def rollup(selected: DataFrame, required: list[str], policy: Policy) -> DataFrame:
    """Per reference: largest skews of the required streams, null unless all are present, and eligibility."""
    mine = selected.where(F.col("stream").isin(required))
    present = ~F.col("state").isin("missing", "incompatible_clock_domain")
    counted = mine.groupBy("ref").agg(
        F.count(F.when(present, 1)).alias("n_present"),
        F.count("effective_ns").alias("n_bounded"),
        F.max(F.abs("skew_ns")).alias("skew"),
        F.max("effective_ns").alias("effective"),
    )
    all_there = (F.col("n_present") == len(required)) & (F.col("n_bounded") == len(required))
    skew, effective = F.when(all_there, F.col("skew")), F.when(all_there, F.col("effective"))
    return counted.select("ref", "n_present", skew.alias("max_skew_ns"), effective.alias("max_effective_ns"), F.coalesce(effective <= policy.fusion, F.lit(False)).alias("eligible"))


def brackets(samples: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Each target (keys, target, t) with the last sample at or before and the first at or after it.

    Both sides are one sorted stream of rows within a key and a range of times, passed once in either direction and never paired up:
    both frames grow from the start of their order, as one that shrinks would be added up anew for each row. Of each range only
    its first and last sample go on to others, so a key with very many samples is several tasks.
    Values v and targets may be of any type; a target may be null or occur several times. Keys that are null match each other. Columns: lo_t, lo_v, hi_t, hi_v.
    """
    sample = samples.select(F.struct("t", "v").alias("s")).schema["s"].dataType
    own = samples.select(*keys, "t", F.struct("t", "v").alias("s"), F.lit(None).cast(targets.schema["target"].dataType).alias("target"), "seq", F.lit(False).alias("asked"))
    asked = targets.select(*keys, "t", F.lit(None).cast(sample).alias("s"), "target", F.lit(None).cast("long").alias("seq"), F.lit(True).alias("asked"))
    bounds = cut(samples, "t", int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = own.unionByName(asked).withColumn("range", F.coalesce(range_of(bounds, F.col("t")), F.lit(0)))
    is_sample = ~F.col("asked") & F.col("t").isNotNull()
    last, first = F.when(is_sample, F.struct("t", (-F.col("seq")).alias("o"), "s")), F.when(is_sample, F.struct("t", F.col("seq").alias("o"), "s"))
    past = Window.partitionBy(*keys, "range").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "range").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    found = both.select(*keys, "range", "target", "t", "asked", F.max(last).over(past).alias("lo"), F.min(first).over(ahead).alias("hi")).where("asked")
    ends = both.groupBy(*keys, "range").agg(F.max(last).alias("last"), F.min(first).alias("first"))  # a row for each key and range
    ranges = Window.partitionBy(*keys).orderBy("range")
    before, beyond = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(1, Window.unboundedFollowing)
    edges = ends.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("range").alias("_range"), F.max("last").over(before).alias("sooner"), F.min("first").over(beyond).alias("later"))
    same = F.col("range") == F.col("_range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    timed = F.col("t").isNotNull()  # a target without a time lies nowhere
    rows = found.join(edges, same, "left").select(*keys, "target", "t", F.when(timed, F.coalesce("lo", "sooner")).alias("lo"), F.when(timed, F.coalesce("hi", "later")).alias("hi"))
    return rows.select(*keys, "target", "t", F.col("lo.s.t").alias("lo_t"), F.col("lo.s.v").alias("lo_v"), F.col("hi.s.t").alias("hi_t"), F.col("hi.s.v").alias("hi_v"))


def interpolated(bracketed: DataFrame, max_gap: int) -> DataFrame:
    """Linear interpolation with the fraction; no extrapolation, spans over ``max_gap`` rejected."""
    span = F.col("hi_t") - F.col("lo_t")
    reason = first_reason((F.col("lo_t").isNull(), "no_sample_before"), (F.col("hi_t").isNull(), "no_sample_after"), (span > max_gap, "gap_exceeds_limit"))
    fraction = F.when(span == 0, F.lit(0.0)).otherwise((F.col("t") - F.col("lo_t")) / span)
    value = F.col("lo_v") + (F.col("hi_v") - F.col("lo_v")) * F.col("fraction")
    rows = bracketed.withColumn("span", span).withColumn("reason", reason).withColumn("fraction", F.when(F.col("reason").isNull(), fraction))
    return rows.withColumn("value", value)


def motion_bound(span_s: Column, fraction: Column, acceleration: float) -> Column:
    """Remainder of linear interpolation under bounded acceleration: a/2 T^2 f (1 - f)."""
    return F.lit(0.5 * acceleration) * span_s * span_s * fraction * (1 - fraction)


def went_back(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Observations whose clock is behind an earlier arrival's of the same source. Of those that arrive at once the older comes first; unnumbered ones come last."""
    before = F.lag("t").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("seq"), "t"))
    return observations.withColumn("before", before).where(F.col("before") > F.col("t"))


def conflicts(observations: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that hold different values at the same time."""
    grouped = observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("n_values"))
    return grouped.where("n_values > 1")


def superseded(triggers: DataFrame, captures: DataFrame, by: list[list[str]]) -> DataFrame:
    """Triggers that no successful capture replaces under any of the keys."""
    for keys in by:
        triggers = triggers.join(captures.select(*keys).distinct(), keys, "left_anti")
    return triggers
