"""Publication that fails leaves nothing, readers see whole generations; every reason of an object's position occurs."""

import os

import pytest
from pyspark.sql import functions as F

from evifuse.operators import objects
from evifuse.plans import objects as queries
from evifuse.sources import publish


def test_a_failed_publication_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    good = spark.range(5).withColumn("v", F.col("id") * 2)
    bad = spark.range(5).select(F.expr("assert_true(id < 3, 'broken')").alias("x"))
    with pytest.raises(Exception, match="broken"):
        publish.publish(folder, {"a": good, "b": bad}, {"note": "x"})
    assert os.listdir(folder) == []
    first = publish.publish(folder, {"a": good}, {"note": "x"})
    before = sorted(os.listdir(folder))
    with pytest.raises(Exception, match="broken"):
        publish.publish(folder, {"a": good, "b": bad}, {"note": "y"}, overwrite=True)
    assert sorted(os.listdir(folder)) == before and publish.current(folder)["generation"] == first
    with pytest.raises(FileExistsError):
        publish.publish(folder, {"a": good}, {})
    for layers, metadata in (({"a": good}, {"rows": 1}), ({"../a": good}, {}), ({}, {}), ({"a": good}, {"x": float("nan")})):
        with pytest.raises(ValueError):
            publish.publish(folder, layers, metadata, overwrite=True)
    assert sorted(os.listdir(folder)) == before and publish.verify(spark, folder).count() == 0


def test_readers_keep_their_generation(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    publish.publish(folder, {"a": spark.range(5), "b": spark.range(2)}, {"note": "x"})
    held = publish.layer(spark, folder, "a")
    publish.publish(folder, {"a": spark.range(9), "c": spark.range(1)}, {"note": "y"}, overwrite=True)
    assert held.count() == 5 and publish.layer(spark, folder, "a").count() == 9
    told = publish.payload(spark, folder, 1)
    assert told["note"] == "y" and told["layers"] == [{"name": "a", "rows": 9, "columns": {"id": "bigint"}}] and told["omitted"] == 1
    with pytest.raises(KeyError):
        publish.layer(spark, folder, "b")


def test_objects_before_their_frame_and_without_a_box(spark):
    frame = (1, 5, "f", 0, 0, 0.0, 0.0, 50.0, [0.0, 1.0, 0.0, 0.0], 0.1, 0.1, 0.1, 0.0, 0.0, 0.001)
    context = objects.contexts(spark.createDataFrame([frame],
        "mission long, seq long, frame string, t long, pose_t long, e double, n double, up double, optical array<double>, se double, sn double, su double, speed double, turn double, attitude_sigma double"))
    box = lambda i, arrival, name="f", calibration="c1", w=40.0, sigma=0.5, mission=1: (mission, i, arrival, name, calibration, 300.0, 200.0, w, 40.0, sigma)
    rows = [box(1, 6), box(2, 5), box(3, 4), box(4, 6, "g"), box(5, 6, calibration=None), box(6, 6, w=0.0), box(7, 6, sigma=900.0), box(8, 6, name=None), box(9, 6, mission=2), box(10, 6)]
    boxes = spark.createDataFrame(rows, "mission long, object long, arrival long, frame string, calibration string, x double, y double, w double, h double, pixel_sigma double")
    found = objects.located(objects.anchored(boxes), context, queries.CAMERA, queries.ORIGIN, 0.0, 47.5, 0.7, 150.0, 1.6).collect()
    short = {"object_reference_calibration_mismatch": "calibration", "source_frame_was_not_accepted_into_atlas": "frame",
        "object_anchor_has_no_safe_ground_intersection": "ground", "object_projected_uncertainty_exceeds_limit": "sigma"}
    assert {r.object: short.get(r.reason) for r in found} == {1: None, 2: "frame", 3: "frame", 4: "frame", 5: "calibration", 6: "ground", 7: "sigma", 8: "frame", 9: "frame", 10: None}
    assert all((r.lat is None) == (r.reason is not None) for r in found)
    assert objects.located(objects.anchored(boxes.limit(0)), context, queries.CAMERA, queries.ORIGIN, 0.0, 47.5, 0.7, 150.0, 1.6).count() == 0
