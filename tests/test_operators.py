"""Golden values, formulas in numpy, batch against stream, tampering."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evifuse.functions import geo
from evifuse.operators import gates, kernels, metrics, mosaic, protocol, raster, sync, tracks
from evifuse.plans import rasters
from evifuse.sources import catalog, publish, telemetry
from evifuse.streaming import synchronizer

OBS = "rig long, seq long, stream string, t long, unc long, domain string"


def states(spark, rows, policy):
    df = spark.createDataFrame([(1, *r) for r in rows], OBS)
    return {r.stream: r for r in sync.nearest(df, "rgb", policy).collect()}


def test_nearest_states(spark):
    policy = sync.Policy(exact=1000, fusion=5000, stale=20000)
    late = states(spark, [(0, "thermal", 97000, 100, "a"), (1, "rgb", 100000, 100, "a")], policy)["thermal"]
    assert (late.state, late.skew_ns, late.effective_ns) == ("late", -3000, 3200)
    assert states(spark, [(0, "thermal", 70000, 100, "a"), (1, "rgb", 100000, 100, "a")], policy)["thermal"].state == "missing"
    assert states(spark, [(0, "thermal", 100000, 0, "b"), (1, "rgb", 100000, 0, "a")], policy)["thermal"].seq is None
    assert states(spark, [(0, "thermal", 100000, None, "a"), (1, "rgb", 100000, 0, "a")], policy)["thermal"].state == "unsynchronized"
    wide = states(spark, [(0, "thermal", 100000, 800, "a"), (1, "rgb", 100000, 800, "a")], policy)["thermal"]
    assert (wide.state, wide.skew_ns, wide.effective_ns) == ("bounded_skew", 0, 1600)


def live_rows(spark, folder, df, *how):
    """The stream's output after all of its input."""
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    out = synchronizer.synchronize(stream, *how).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def test_stream_equals_batch_selection(spark, tmp_path):
    policy = sync.Policy(exact=0, fusion=5000, stale=10**9)
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), i, ["rgb", "thermal"][int(rng.integers(2))], i * 1000, int(rng.integers(5)), "a") for i in range(60)]
    df = spark.createDataFrame(rows, OBS)
    live = {(r.ref, r.stream): (r.seq, r.state) for r in live_rows(spark, tmp_path, df, "rgb", ["thermal"], policy)}
    for (ref, _), (seq, state) in live.items():
        rig, t, unc = next((r[0], r[3], r[4]) for r in rows if r[1] == ref)
        past = [r for r in rows if r[0] == rig and r[2] == "thermal" and r[1] <= ref]
        best = min(past, key=lambda r: (abs(r[3] - t) + r[4] + unc, r[1]), default=None)
        assert seq == (best[1] if best else None) and (state == "missing") == (best is None)


def test_stream_rejects_out_of_order(spark, tmp_path):
    rows = [(1, 0, "rgb", 5000, 0, "a"), (1, 1, "rgb", 4000, 0, "a")]
    out = live_rows(spark, tmp_path, spark.createDataFrame(rows, OBS), "rgb", [], sync.Policy())
    assert [(r.ref, r.state) for r in out] == [(1, "rejected_out_of_order")]


def test_selective_metrics_of_ties(spark):
    rows = spark.createDataFrame([(0.1, 0.0), (0.5, 1.0), (0.5, 0.0), (0.9, 1.0)], "score double, risk double")
    curve = metrics.blocks(rows, [])
    assert metrics.aurc(curve, []).first().aurc == pytest.approx(0.25 * 0 + 0.5 * (1 / 3) + 0.25 * 0.5)
    assert metrics.augrc(curve, []).first().augrc == pytest.approx(0.5 * (0 + 0.25) / 2 + 0.25 * (0.25 + 0.5) / 2)
    assert metrics.auroc(curve, []).first().auroc == pytest.approx(0.875)
    one = metrics.blocks(rows.where("risk = 0"), [])
    assert metrics.auroc(one, []).first().auroc is None


def test_order_of_rows_does_not_matter(spark):
    rows = [(i, float(i % 7) / 7, float(i % 3 == 0)) for i in range(50)]
    values = [metrics.aurc(metrics.blocks(spark.createDataFrame(order, "id long, score double, risk double"), []), []).first().aurc for order in (rows, rows[::-1])]
    assert values[0] == pytest.approx(values[1], abs=1e-12)


def test_blur_and_gradient_equal_numpy(spark):
    image = np.random.default_rng(2).random((7, 11))
    rows = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(7) for x in range(11)], "frame long, y int, x int, v double")
    got = np.zeros_like(image)
    for r in raster.box_blur(rows, 7, 11, 3).collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, kernels.mean_square(image, 3))
    padded = np.pad(image, 3, mode="reflect")
    assert np.allclose(got, [[padded[y : y + 7, x : x + 7].mean() for x in range(11)] for y in range(7)])
    for r in raster.gradient_energy(rows, 7, 11).collect():
        got[r.y, r.x] = r.energy
    assert np.allclose(got, kernels.edges(image))


def test_thermal_never_exceeds_its_evidence(spark):
    rows = spark.createDataFrame([(f, 0, x, x / 9, 1 - x / 9, 0.5, 0.9, 0.9, x / 9, x % 4 != 0, f == 0) for f in (0, 1) for x in range(10)],
        "frame long, y int, x int, visible double, thermal double, visible_detail double, thermal_detail double, contrast double, support double, valid boolean, eligible boolean")
    for r in raster.fuse(rows).collect():
        assert 0 <= r.thermal_contribution <= r.support and (r.valid or r.thermal_contribution == 0)
        assert r.eligible or (r.fused == r.visible and r.fusion_support == 0)
    assert raster.fuse(rows, gain=0.0).agg(F.max("thermal_contribution")).first()[0] == 0


def test_mosaic_of_two_frames(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 3.0, 1.0, 1.0, 0.4, 1), (2, 2, 2.0, 3.0, 0.25, 0.0, 0.2, 0)],
        "frame long, seq long, east double, north double, weight double, value double, thermal double, class int")
    parts = mosaic.splat(rows, 10, 10)
    cell = mosaic.snapshot(mosaic.accumulate(parts)).first()
    assert (cell.row, cell.col, cell.coverage_count, cell.frame_count) == (3, 2, 2, 2)
    assert cell.value == pytest.approx(0.8) and cell.thermal == pytest.approx(0.36) and cell.support == pytest.approx(1 - np.exp(-1.25))
    assert mosaic.dominant_source(parts).first().frame == 1 and mosaic.semantic_winner(parts).first()["class"] == 1


def test_geodesy_round_trip_and_pole(spark):
    rows = spark.createDataFrame([(10.0, 20.0, 300.0), (-89.0, 179.0, 0.0), (0.0, -180.0, 9000.0)], "lat double, lon double, h double")
    back = geo.ecef_to_geodetic(*geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h")))
    for r in rows.select("lat", "h", back[0].alias("a"), back[2].alias("c")).collect():
        assert r.a == pytest.approx(r.lat, abs=1e-9) and r.c == pytest.approx(r.h, abs=1e-4)
    pole = spark.range(1).select(*geo.ecef_to_geodetic(F.lit(0.0), F.lit(0.0), F.lit(-6356752.0))).first()
    assert pole[0] == -90.0


def test_gate_order(spark):
    rows = spark.createDataFrame([(0, True, True), (1, False, True), (2, False, None)], "seq long, horizontal_accuracy_unknown boolean, rtk_fixed_required boolean")
    assert [r.reject_reason for r in gates.first_failure(rows, gates.MISSION).orderBy("seq").collect()] == ["rtk_fixed_required", "rtk_fixed_required", None]
    assert len(gates.MISSION) == 38 and len(gates.GRID) == 15


def test_missions_are_judged_in_the_order_of_arrival(spark):
    """Against one row after another: only an accepted frame fixes a contract, and the contract's gate comes before later ones."""
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(4), i, rng.randrange(25), rng.choice([None, "a", "b"]), rng.random() < 0.3, rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "mission long, seq long, frame long, contract string, early boolean, late boolean")
    fixed, taken, want = {}, set(), []
    for mission, seq, frame, contract, early, late in rows:
        changed = contract is not None and mission in fixed and fixed[mission] != contract
        reason = "early" if early else "changed" if changed else "late" if late else "again" if (mission, frame) in taken else None
        if reason is None:
            taken.add((mission, frame))
            if contract is not None:
                fixed.setdefault(mission, contract)
        want.append(reason)
    got = gates.in_order(df.repartition(3), ["early", "changed", "late"], "contract", "changed", "frame", "again")
    assert [r.reject_reason for r in got.orderBy("seq").collect()] == want and set(want) == {"early", "changed", "late", "again", None}


def test_a_rig_with_many_samples_is_bracketed_in_linear_time(spark):
    import time

    n = 100_000
    samples = spark.range(n).select(F.lit(1).alias("rig"), (F.col("id") * 10).alias("t"), F.col("id").cast("double").alias("v"), F.col("id").alias("seq"))
    targets = spark.range(n).select(F.lit(1).alias("rig"), (F.col("id") * 10 + 5).alias("t"), F.col("id").alias("target"))
    began = time.time()
    row = sync.brackets(samples, targets, ["rig"]).agg(F.sum(F.col("t") - F.col("lo_t")).alias("lo"), F.sum(F.col("hi_t") - F.col("t")).alias("hi"), F.count("hi_t").alias("n")).first()
    assert (row.lo, row.hi, row.n) == (5 * n, 5 * (n - 1), n - 1) and time.time() - began < 60


def test_tracks_protocol_and_matching(spark):
    points = spark.createDataFrame([(1, 0, 0), (1, 4, 1), (1, 10, 2), (1, 10, 3)], "track long, t long, seq long")
    assert [r.segment for r in tracks.segments(points, 5).orderBy("seq").collect()] == [1, 1, 2, 2]
    assert tracks.latest(points).first().seq == 3
    ids = spark.createDataFrame([("00042D",), ("12345N",), ("x",)], "s string").select(protocol.block_group(F.col("s"))).collect()
    assert [r[0] for r in ids] == ["d-block-000", "n-block-123", None]
    boxes = spark.createDataFrame([(1, 1, True, None, 0.0, 0.0, 1.0, 1.0), (1, 2, False, 0.9, 0.0, 0.0, 1.0, 0.9), (1, 3, False, 0.8, 0.0, 0.0, 1.0, 1.0)],
        "image long, id long, is_truth boolean, score double, x double, y double, w double, h double")
    assert {(r.id, r.hit) for r in kernels.match(boxes, 0.5).collect()} == {(2, 1), (3, 0)}


def test_phase_shift_finds_and_abstains():
    image = np.zeros((96, 128))
    image[20:40, 30:60], image[50:80, 70:90], image[10:18, 90:110] = 1, 0.7, 0.4
    dy, dx, confidence = kernels.phase_shift(image, np.roll(image, (7, -11), (0, 1)), 20)
    assert (dy, dx) == (-7, 11) and confidence > 0.5
    assert kernels.phase_shift(np.ones((64, 64)), np.ones((64, 64)), 10) == (0, 0, 0.0)


def test_terrain_first_ridge_and_gap():
    grid = np.zeros((20, 20))
    grid[:, 8], grid[:, 14] = 3, 5
    ray = np.array([[1.0, 0.0, -0.2]])
    reach = kernels.march(grid, np.array([1.0, 10.0, 4.0]), ray / np.linalg.norm(ray), 30, 0.1)
    assert 5 < reach[0] < 8
    grid[:, 4] = np.nan
    assert np.isnan(kernels.march(grid, np.array([1.0, 10.0, 4.0]), ray / np.linalg.norm(ray), 30, 0.1)[0])


def test_annotations(spark):
    xml = "<a><size><width>100</width><height>50</height></size><object><name>p</name><bndbox><xmin>-5</xmin><ymin>5</ymin><xmax>50</xmax><ymax>60</ymax></bndbox></object><object><name>q</name><bndbox><xmin>9</xmin><ymin>5</ymin><xmax>9</xmax><ymax>60</ymax></bndbox></object></a>"
    box = catalog.voc_boxes(spark.createDataFrame([("s", xml)], "sample string, xml string")).collect()
    assert [(b.label, b.x, b.y, b.width, b.height) for b in box] == [("p", 0.0, 0.1, 0.5, 0.9)]
    lines = catalog.yolo_boxes(spark.createDataFrame([("s", "1 0.5 0.5 0.2 0.4\nbad\n7 0 0 0.2 0.2")], "sample string, text string"), ["a", "b"]).orderBy("place").collect()
    assert [(b.label, round(b.x, 6), round(b.width, 6)) for b in lines] == [("b", 0.4, 0.2), ("class 7", 0.0, 0.1)]
    files = spark.createDataFrame([(f"/d/train/{m}/FLIR_{k}-1.png", 1) for m, k in (("rgb", "eo"), ("ir", "thermal"))], "path string, length long")
    assert catalog.pair(files, "rgb", "ir", key=catalog.common_id).first().sample == "FLIR_frame-1"


def test_telemetry_source(spark, tmp_path):
    log = tmp_path / "a.jsonl"
    messages = [{"type": "GPS_RAW_INT", "lat": 11000000, "lon": 2147483647, "fix_type": 5, "time_usec": 2 * 10**15, "sysid": 1, "compid": 2}, {"type": "BAD_DATA"},
        {"type": "CAMERA", "time_boot_ms": 1500, "file_url": "ftp://x/a%20b.jpg?q"}]
    log.write_text("\n".join(map(json.dumps, messages)))
    telemetry.register(spark)
    a, b = telemetry.normalized(spark.read.format("telemetry_log").option("path", str(log)).load()).orderBy("seq").collect()
    assert (a.latitude_deg, a.longitude_deg, a.fix_quality, a.utc_ns, a.boot_ns, a.boot_domain) == (1.1, None, "rtk_float", 2 * 10**18, None, "mavlink:system:1:component:2:boot")
    assert (b.boot_ns, b.filename, b.boot_domain) == (1_500_000_000, "a b.jpg", None)


def test_pose_records(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"records": [{"image_name": "a", "position": {"latitude_deg": 1.0, "longitude_deg": 2.0}, "capture_utc_ns": 5},
        {"image_name": "b", "latitude_deg": 91.0}]}))
    rows = {r.image_name: (r.latitude_deg, r.reject_reason) for r in catalog.pose_records(spark, str(tmp_path)).collect()}
    assert rows == {"a": (1.0, None), "b": (91.0, "latitude_outside_limits")}


def test_publication_is_locked_and_detects_tampering(spark, tmp_path):
    folder = str(tmp_path / "out")
    name = publish.publish(folder, {"cells": spark.range(5).toDF("row")}, {"mission": "m"})
    assert publish.verify(spark, folder).count() == 0
    with pytest.raises(FileExistsError):
        publish.publish(folder, {"cells": spark.range(5).toDF("row")}, {})
    with publish.locked(folder), pytest.raises(FileExistsError):
        publish.publish(folder, {"cells": spark.range(5).toDF("row")}, {}, overwrite=True)
    part = next((tmp_path / "out" / name / "cells").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(part.read_bytes() + b"x")
    assert [r.fault for r in publish.verify(spark, folder).collect()] == ["changed"]


def test_packed_kernels_equal_long_form(spark):
    from evifuse.functions.raster import THERMAL, palette

    image = np.random.default_rng(3).random((9, 12)).astype(np.float32)
    rows = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(9) for x in range(12)], "frame long, y int, x int, v double")
    long = {(r.y, r.x): (r.r, r.g, r.b) for r in rows.select("y", "x", *(palette(F.col("v"), THERMAL, i + 1).alias(c) for i, c in enumerate("rgb"))).collect()}
    colors = kernels.colored(image.astype(np.float64), THERMAL)
    assert all(tuple(map(int, colors[y, x])) == v for (y, x), v in long.items())
    v = F.col("v")
    steps = raster.robust_normalize(rows.withColumn("visible", v), "v", into="thermal")
    steps = raster.gradient_energy(raster.gradient_energy(steps, 9, 12, "visible", "ve"), 9, 12, "thermal", "te")
    blurred = raster.box_blur(steps.select("frame", "y", "x", "thermal"), 9, 12, 3, "thermal").withColumnRenamed("thermal", "local")
    steps = steps.join(blurred, ["frame", "y", "x"]).withColumn("gap", F.abs(F.col("thermal") - F.col("local")))
    for a, b in (("ve", "visible_detail"), ("te", "thermal_detail"), ("gap", "contrast")):
        steps = raster.scale_by_p99(steps, a, b)
    want = raster.fuse(steps.withColumns({"support": F.lit(0.9), "valid": F.lit(True), "eligible": F.lit(True)}))
    got = kernels.fused(image.astype(np.float64), image.astype(np.float64), 0.9)
    for r in want.collect():
        for c in got:
            assert r[c] == pytest.approx(got[c][r.y, r.x], abs=1e-6)


def test_farthest_pair_lies_on_the_hull(spark):
    rng = np.random.default_rng(5)
    points = rng.standard_normal((300, 2))
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double").repartition(5)
    ids = [r.id for r in kernels.outermost(rows).collect()]
    span = lambda p: max(np.hypot(*(a - b)) for a in p for b in p)
    assert len(ids) < 40 and span(points[ids]) == pytest.approx(span(points))
    assert kernels.outermost(rows.limit(0)).count() == 0


def test_nearest_neighbor_however_far(spark):
    """A cluster, points some cells off, outliers, both sides of the date line and near a pole, against all pairs."""
    rng = np.random.default_rng(8)
    places = [(46 + a, 7 + b) for a, b in rng.uniform(0, 0.01, (30, 2))] + [(46.3, 7.3), (46.0, 7.0199), (46.0149, 7.0), (46.5, 9.0), (-33.0, 151.0), (10.0, 179.9999),
        (10.0, -179.9999), (89.9, 0.0), (89.9, 120.0), (-60.0, -70.0)]
    places += [(46.2 + a, 8 + b) for a, b in rng.uniform(0, 0.2, (40, 2))]
    lat, lon = np.array(places).T
    x = np.radians((lon[None] - lon[:, None] + 180) % 360 - 180) * np.cos(np.radians((lat[None] + lat[:, None]) / 2))
    d = geo.EARTH_RADIUS * np.sqrt(x**2 + np.radians(lat[None] - lat[:, None]) ** 2)
    np.fill_diagonal(d, np.inf)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "id long, lat double, lon double")
    got = dict(rasters.nearest_distances(points).collect())
    assert len(got) == len(places) and np.allclose([got[i] for i in range(len(places))], d.min(axis=1), rtol=1e-9)
    assert rasters.nearest_distances(points.limit(1)).collect()[0].metres is None


def test_nearest_neighbor_of_dense_points_meets_few(spark):
    """Points denser than the widest cells: copies are settled at once, the cells are fine, the distances those of all pairs."""
    rng = np.random.default_rng(9)
    places = [(46 + a, 7 + b) for a, b in rng.uniform(0, 0.004, (600, 2))] + [(46.001, 7.001)] * 50 + [(46.7, 7.7)]
    lat, lon = np.array(places).T
    x = np.radians(lon[None] - lon[:, None]) * np.cos(np.radians((lat[None] + lat[:, None]) / 2))
    d = geo.EARTH_RADIUS * np.sqrt(x**2 + np.radians(lat[None] - lat[:, None]) ** 2)
    np.fill_diagonal(d, np.inf)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)] + [(9001, None, 7.0), (9002, None, 7.0)], "id long, lat double, lon double")
    got = dict(rasters.nearest_distances(points).collect())
    assert len(got) == len(places) + 2 and got[9001] is None and got[9002] is None
    assert np.allclose([got[i] for i in range(len(places))], d.min(axis=1), rtol=1e-9)
    n = rasters._fine_cells(points.where("lat IS NOT NULL").dropDuplicates(["lat", "lon"]))
    held = points.where("lat IS NOT NULL").dropDuplicates(["lat", "lon"]).withColumns(rasters._cells(n)).groupBy("cy", "cx").count().collect()
    assert n > 72_000 and max(r["count"] for r in held) < 60


def test_matching_takes_many_images_at_once(spark):
    """Images of any sizes, ties, none of a kind: as one by one, without a call for each image."""
    rng = np.random.default_rng(3)
    rows = []
    for image in range(60):
        for i in range(int(rng.integers(1, 12))):
            rows.append((image, image * 100 + i, bool(rng.integers(0, 2)), float(rng.integers(0, 4)) / 4, *(float(v) for v in rng.integers(0, 3, 2) / 4), 0.5, float(rng.integers(1, 3)) / 2))
    want = set()
    for image in range(60):
        own = [r for r in rows if r[0] == image]
        truth, used = sorted(r for r in own if r[2]), set()
        for p in sorted((r for r in own if not r[2]), key=lambda r: (-r[3], r[1])):
            best = None
            for t in truth:
                if t[1] not in used:
                    shared = max(min(p[4] + p[6], t[4] + t[6]) - max(p[4], t[4]), 0) * max(min(p[5] + p[7], t[5] + t[7]) - max(p[5], t[5]), 0)
                    iou = shared / max(p[6] * p[7] + t[6] * t[7] - shared, 1e-12)
                    if best is None or iou > best[0]:
                        best = iou, t[1]
            hit = best is not None and best[0] >= 0.5
            used |= {best[1]} if hit else set()
            want.add((image, p[1], p[3], int(hit), best[1] if hit else None))
    df = kernels.match(spark.createDataFrame(rows, "image long, id long, is_truth boolean, score double, x double, y double, w double, h double"), 0.5)
    assert set(map(tuple, df.collect())) == want and len({w[3] for w in want}) == 2
    plan = df._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
