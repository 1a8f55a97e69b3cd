"""Every mission gate against the plain walk; anchors of time and ranks of fixes."""

import dataclasses
import random

from pyspark.sql import functions as F

from evifuse.operators import gates, missions
from evifuse.plans import missions as queries


def walked(rows):
    """Reasons of ``checked`` rows, one arrival after another."""
    fixed, taken, out = {}, set(), {}
    for r in sorted(rows, key=lambda r: (r["mission"], r["seq"])):
        held = fixed.setdefault(r["mission"], {})
        reason = None
        for gate in gates.MISSION:
            name = missions.CONTRACTS.get(gate)
            if r.get(gate) or name and r[name] is not None and held.get(name, r[name]) != r[name]:
                reason = gate
                break
        if reason is None and (r["mission"], r["frame"]) in taken:
            reason = "duplicate_frame_id"
        if reason is None:
            taken.add((r["mission"], r["frame"]))
            for name in missions.CONTRACTS.values():
                if r[name] is not None:
                    held.setdefault(name, r[name])
        out[r["mission"], r["seq"]] = reason
    return out


def records(spark, n):
    fields = queries.FIELDS
    rows = spark.range(n).selectExpr("id AS n").selectExpr("n", *(f"{e} AS {name}" for name, e in fields.items())).withColumnRenamed("n", "seq")
    return rows.selectExpr("*", "array(0.0D, 1.0D, 0.0D, 0.0D) AS optical", "if(odd_class, array(0L, 9L), array(0L, 3L)) AS semantic_classes").repartition(4)


def test_judged_equal_the_walk_and_all_gates_occur(spark):
    seen = set()
    without = dataclasses.replace(queries.MISSION, velocity_bound=None, turn_bound=1.0, tai_minus_utc_s=None, boot_epoch_uncertainty_ns=0, require_rtk_fixed=False)
    for mission in (queries.MISSION, without):
        rows = missions.checked(records(spark, 2500).withColumn("frame", F.col("seq") % 210), mission).persist()
        want = walked([r.asDict() for r in rows.collect()])
        got = {(r.mission, r.seq): r.reject_reason for r in missions.judged(rows).collect()}
        assert got == want
        seen |= set(want.values())
    assert seen == {None, "duplicate_frame_id", *gates.MISSION}


def test_contracts_are_fixed_by_accepted_records_only(spark):
    """A chain: whoever would fix the contract is refused by what an earlier round fixes."""
    rng = random.Random(5)
    rows = [(m, s, rng.randint(0, 30), rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.random() < 0.2) for m in range(40) for s in range(25)]
    df = spark.createDataFrame(rows, "mission long, seq long, frame long, thermal_fingerprint string, semantic_fingerprint string, capture_time_uncertainty_unknown boolean")
    got = {(r.mission, r.seq): r.reject_reason for r in missions.judged(df).collect()}
    assert got == walked([r.asDict() for r in df.collect()])
    assert missions.judged(df.limit(0)).count() == 0


def test_anchors_and_ranks(spark):
    mission = missions.Mission("c", 1, 1, tai_minus_utc_s=37, boot_epoch_tai_ns=100)
    rows = spark.createDataFrame([(5, None), (None, 7), (None, None)], "utc long, boot long")
    assert [tuple(r) for r in rows.select(*missions.tai_candidates(mission, F.col("utc"), F.col("boot"))).collect()] == [(37_000_000_005, None), (None, 107), (None, None)]
    names = spark.createDataFrame([("6",), (" RTK Fixed ",), ("dgps",), ("ppp",), ("?",), (None,)], "fix string")
    assert [r[0] for r in names.select(missions.fix_rank(F.col("fix"))).collect()] == [6, 6, 4, 8, None, None]
