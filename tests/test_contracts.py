"""The record contracts: their SQL reaches every reason, so the comparison with it covers every rule."""

from pathlib import Path

import duckdb
import pytest

from evifuse.plans import contracts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are absent")
CASES = [
    (contracts.TIME_SQL, contracts.TIME_RULES), (contracts.OBSERVED_SQL, contracts.OBSERVED_RULES), (contracts.BOX_SQL, contracts.BOX_RULES),
    (contracts.FRAME_SQL, contracts.FRAME_RULES), (contracts.STATUS_SQL, contracts.STATUS_RULES), (contracts.OUTPUT_SQL, contracts.OUTPUT_RULES),
    (contracts.POSE_SQL, contracts.POSE_RULES), (contracts.MAP_SQL, contracts.MAP_RULES),
]


@pytest.mark.parametrize("sql, rules", CASES)
def test_every_reason_occurs(sql, rules):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = {r[0] for r in con.execute(f"SELECT DISTINCT reject_reason FROM ({sql})").fetchall()}
    assert found == {None, *(reason for reason, _ in rules)}


def test_matrices_and_quaternions_agree(spark):
    """There and back for rotations about each axis by half a turn and less, where a different square is the largest."""
    import math

    from pyspark.sql import functions as F

    from evifuse.functions import frames

    h = math.sqrt(0.5)
    cases = [(1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (h, h, 0.0, 0.0), (0.5, -0.5, 0.5, -0.5)]
    rows = spark.createDataFrame(cases, "w double, x double, y double, z double")
    m = rows.select("*", *(e.alias(f"m{i}{j}") for i, row in enumerate(frames.matrix([F.col(c) for c in "wxyz"])) for j, e in enumerate(row)))
    back = frames.from_matrix([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    for row in m.select(*"wxyz", F.array(*back).alias("q")).collect():
        assert row.q == pytest.approx([row.w, row.x, row.y, row.z], abs=1e-12)


def test_axis_conventions(spark):
    """A level vehicle that heads north: forward is north, left is west; the camera's down is the world's."""
    from pyspark.sql import functions as F

    from evifuse.functions import frames, geo

    one, zero = F.lit(1.0), F.lit(0.0)
    columns = lambda q: [x.alias(n) for x, n in zip(q, "wxyz")]
    turn = [F.col(n) for n in "wxyz"]
    flu = spark.range(1).select(*columns(frames.enu_flu_of([one, zero, zero, zero])))
    found = flu.select(F.array(*geo.rotate(turn, (one, zero, zero))), F.array(*geo.rotate(turn, (zero, one, zero)))).first()
    down = flu.select(*columns(frames.optical_of(turn))).select(F.array(*geo.rotate(turn, (zero, one, zero)))).first()
    assert [pytest.approx(v, abs=1e-12) for v in (*found, *down)] == [[0, 1, 0], [-1, 0, 0], [0, 0, -1]]


def test_fix_quality(spark):
    from pyspark.sql import functions as F

    from evifuse.operators.poses import fix_quality

    rows = spark.createDataFrame([(None,), (1,), (3,), (5,), (6,), (40,)], "fix int")
    want = [("unknown", "unknown"), ("no_fix", "no_fix"), ("3d_fix", "not_rtk"), ("rtk_float", "float"), ("rtk_fixed", "fixed"), ("fix_type_40", "not_rtk")]
    assert [tuple(r) for r in rows.select(*fix_quality(F.col("fix"))).collect()] == want
