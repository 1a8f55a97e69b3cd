"""Poses where targets repeat, and brackets over several ranges of times."""

import random

from pyspark.sql import functions as F

from evifuse.operators import poses, sync

S = 1_000_000_000
SAMPLES = "rig long, seq long, mono long, domain string, utc long, lat double, lon double, alt double, q array<double>"
CAPTURES = "rig long, target long, mono long, domain string, utc long, unc long"


def test_captures_of_two_rigs_with_one_target(spark):
    unit = [1.0, 0.0, 0.0, 0.0]
    samples = spark.createDataFrame([(rig, 10 * rig + i, i * S, "d", None, 40.0 + rig + i / 100, 7.0, 100.0 * rig, unit) for rig in (1, 2) for i in range(3)], SAMPLES)
    captures = spark.createDataFrame([(1, 7, S // 2, "d", None, 0), (2, 7, S // 2, "d", None, 0), (2, 7, S, "d", None, 0), (2, None, S, "d", None, 0), (1, None, None,
        None, None, 0), (3, 7, S, "d", None, 0)], CAPTURES)
    found = poses.poses(captures.withColumn("reason", F.lit(None).cast("string")), samples, ["rig"], 10 * S, 1.0, 1.0).collect()
    got = sorted(((r.rig, r.target, r.mono, r.alt and round(r.alt, 6), r.lat and round(r.lat, 6), r.reason) for r in found), key=repr)
    assert got == sorted(
        [
            (1, 7, S // 2, 100.0, 41.005, None), (2, 7, S // 2, 200.0, 42.005, None), (2, 7, S, 200.0, 42.01, None), (2, None, S, 200.0, 42.01, None),
            (1, None, None, None, None, "no_common_time_basis"), (3, 7, S, None, None, "no_common_time_basis"),
        ],
        key=repr,
    )


def test_brackets_over_ranges(spark):
    """Against a search, with one rig that holds most samples, equal times, lone rigs and targets outside."""
    rng = random.Random(4)
    samples = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.randint(0, 60) * 10 if i % 3 else 300, float(i)) for i in range(400)]
    targets = [(rng.choice([1, 2, 3, 4, None]), rng.choice([i, None, 5]), rng.choice([rng.randint(-20, 640), 300, None])) for i in range(200)]
    found = sync.brackets(spark.createDataFrame(samples, "rig long, seq long, t long, v double").repartition(5), spark.createDataFrame(targets, "rig long, target long, t long"), ["rig"]).collect()
    want = []
    for rig, target, t in targets:
        own = [s for s in samples if s[0] == rig and t is not None]
        lo = max((s for s in own if s[2] <= t), key=lambda s: (s[2], -s[1]), default=None)
        hi = min((s for s in own if s[2] >= t), key=lambda s: (s[2], s[1]), default=None)
        want.append((rig, target, t, lo and lo[2], lo and lo[3], hi and hi[2], hi and hi[3]))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
