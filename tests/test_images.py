"""Matching against the walk through captures, chains of displaced captures, selectors of sources."""

import random

from pyspark.sql import functions as F

from evifuse.operators import images

CAPTURES, IMAGES = "rig long, order long, image_index long, file string", "rig long, position long, image_index long, file string"


def walked(captures, pictures, strict):
    out, used = {}, set()
    for rig, order, index, file in sorted(captures):
        own = sorted(p for p in pictures if p[0] == rig)
        by_index = [p[1] for p in own if index is not None and p[2] == index]
        by_name = [p[1] for p in own if file is not None and p[3] is not None and p[3].lower() == file.lower()]
        if strict and own:
            wanted = [p for p in by_index if p in by_name] if index is not None and file is not None else by_index if index is not None else by_name
            left = [p for p in wanted if (rig, p) not in used]
            conflict = index is not None and file is not None and by_index and by_name and not wanted
            taken, reason = (left[0], None) if len(left) == 1 and not conflict else (None, images.CONFLICT if conflict else images.UNMATCHED)
        else:
            left = [p for p in [*by_index, *by_name, *([order] if order < len(own) else [])] if (rig, p) not in used]
            taken, reason = (left[0] if left else None), None
        used |= {(rig, taken)} if taken is not None else set()
        out[rig, order] = (taken, reason)
    return out


def test_matches_equal_the_walk(spark):
    rng = random.Random(7)
    pictures = [(rig, p, rng.choice([None, p, p + 1, p // 2]), rng.choice([None, f"A{p}.jpg", f"a{p // 2}.JPG"])) for rig in range(6) for p in range(rng.randint(0, 14))]
    captures = [(rig, o, rng.choice([None, o, o + 1, o // 2]), rng.choice([None, f"a{o}.JPG", f"A{o // 2}.jpg"])) for rig in range(7) for o in range(14)]
    frame = spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(pictures, IMAGES)
    reasons = set()
    for strict in (False, True):
        got = {(r.rig, r.order): (r.position, r.reason) for r in images.match(*frame, ["rig"], strict).collect()}
        assert got == walked(captures, pictures, strict)
        reasons |= {r for _, r in got.values()}
    assert reasons == {None, images.CONFLICT, images.UNMATCHED}


def test_a_chain_of_displaced_captures(spark):
    """Each capture asks for the image of the next, the first for one that somebody has."""
    pictures = [(1, p, p, None) for p in range(9)]
    captures = [(1, 0, 1, None), (1, 1, 1, None), (1, 2, 2, None), (1, 3, 2, None), (1, 4, 4, None), (1, 5, 4, None), (1, 6, 6, "name.jpg"), (1, 7, 6, "name.jpg"), (1, 8, 7, None)]
    got = {(r.rig, r.order): (r.position, r.reason) for r in images.match(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(pictures, IMAGES), ["rig"], False).collect()}
    assert got == walked(captures, pictures, False)
    none = spark.createDataFrame([], IMAGES)
    assert [(r.image, r.basis) for r in images.match(spark.createDataFrame([(1, 0, None, None), (1, 1, 5, "x.jpg")], CAPTURES), none, ["rig"],
        True).orderBy("order").collect()] == [("image_000000.jpg", "generated_event_index"), ("x.jpg", "event_file_url")]
    assert images.match(spark.createDataFrame([], CAPTURES), none, ["rig"], False).count() == 0


def test_captures_that_cannot_get_an_image_take_no_part(spark):
    """A long mission's captures ask for few images over and over; the rounds hold about as many captures as images, with the same matches."""
    pictures = [(1, p, p, f"a{p}.jpg") for p in range(6)]
    captures = [(1, o, o * 7 % 5 if o % 3 else None, f"A{o * 7 % 5}.jpg" if o % 4 else None) for o in range(200)]
    frame = spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(pictures, IMAGES)
    named = [d.withColumn("name", F.lower("file")) for d in frame]
    for strict in (False, True):
        assert images.contenders(*named, ["rig"], strict).where("may").count() <= 3 * len(pictures)
        got = {(r.rig, r.order): (r.position, r.reason) for r in images.match(*frame, ["rig"], strict).collect()}
        assert got == walked(captures, pictures, strict)


def test_selectors_choose_among_several(spark):
    shot, pose, gps = "CAMERA_IMAGE_CAPTURED", "GLOBAL_POSITION_INT", "GPS_RAW_INT"
    rows = [
        (1, shot, 1, 100, 0), (1, pose, 2, 1, None), (2, shot, 1, 100, 0), (2, shot, 1, 100, 1), (3, shot, 1, 100, 0), (3, "CAMERA_TRIGGER", 1, 101, 0), (4, pose, 1, 1, None), (4, pose, 1, 2, None),
        (5, gps, 1, 1, None), (5, "GPS2_RAW", 1, 1, None), (6, shot, 1, 100, 0), (6, pose, 1, 1, None), (6, gps, None, 1, None), (7, shot, None, None, None),
    ]
    df = spark.createDataFrame(rows, "mission long, kind string, system long, component long, camera long")
    of = lambda **options: {r.mission: r.reason for r in images.sources(df, **options).collect()}
    assert of() == {1: "several_systems", 2: "several_cameras", 3: "several_capture_components", 4: "several_navigation_sources", 5: "several_gps_sources", 6: None, 7: None}
    chosen = of(system=1, camera=0, capture_component=100, navigation_component=1, gps_type=gps)
    none = "no_captures_of_component"
    assert chosen == {1: None, 2: None, 3: None, 4: none, 5: none, 6: None, 7: "no_messages_of_system"}
    assert of(system=9)[1] == "no_messages_of_system" and of(navigation_component=7)[4] == "no_telemetry_of_component" and of(capture_component=7)[2] == "several_cameras"
    kept = images.of_sources(df, images.sources(df)).groupBy("mission").count().collect()
    assert {r.mission: r["count"] for r in kept} == {6: 2, 7: 1}
