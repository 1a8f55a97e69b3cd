"""Frames judged against the plain walk through arrivals, in batch and as a stream; all reasons occur."""

import random
import weakref

import pandas as pd
from pyspark.sql import functions as F

from evifuse.operators import gates, grid
from evifuse.streaming import mosaic as stream

FRAMES = "mission long, seq long, frame string, t long, calibration string, pose string, pose_t long, height long, width long, image_height long, image_width long"
SAMPLES = "mission long, seq long, valid boolean, validity boolean, support double, incidence double, sigma double, east double, north double, up double, value double, thermal double, class long"
MAP = grid.Settings(0.0, 10.0, 1.0, 10, 10, max_uncertainty=2.0, max_pose_offset_ns=10, max_pixels=100, max_classes=6, max_bytes=100 * (192 + 12 * 5) + 100 * 384)


def scene(seed, n=240):
    rng = random.Random(seed)
    frames, samples = [], []
    for seq in range(n):
        odd, size = rng.randint(0, 24), 10
        frames.append((seq % 3, seq, f"f{rng.randint(0, 90)}", None if odd == 0 else 100, [" ", None, "c"][min(odd - 1, 2)] if odd in (1, 2) else "c",
            None if odd == 3 else "p", None if odd == 4 else 120 if odd == 5 else 105, 40 if odd == 6 else size, size, 39 if odd == 7 else 40 if odd == 6 else size, size))
        for _ in range(rng.randint(0, 5)):
            samples.append((seq % 3, seq, odd != 8, odd != 9, 0.0 if odd == 10 else 0.5, -1.0 if odd == 11 else 0.9, 5.0 if odd == 12 or rng.random() < 0.02 else 0.5,
                50.0 if odd == 13 else rng.uniform(0, 10), rng.uniform(0, 10), 1.0, rng.random(), rng.choice([None, 0.5]), rng.choice([None, -1, 0, 1, 2, 3, 4, 5, 6,
                7]) if seq % 4 == 0 else rng.choice([0, -1, None])))
    return frames, samples


def walked(rows):
    """Reasons of summarized frames, one arrival after another."""
    taken, held, out = set(), {}, {}
    for r in sorted(rows, key=lambda r: (r["mission"], r["seq"])):
        failing = [g for g in gates.GRID if r.get(g)]
        early = [g for g in failing if gates.GRID.index(g) < grid.NEW]
        classes = held.setdefault(r["mission"], set())
        reason = early[0] if early else "duplicate_frame_id" if (r["mission"],
            r["frame"]) in taken else failing[0] if failing else MAP.refusal(len(classes | set(r["classes"]))) if r["classes"] else None
        if reason is None:
            taken.add((r["mission"], r["frame"]))
            classes |= set(r["classes"])
        out[r["mission"], r["seq"]] = reason
    return out


def test_batch_and_stream_equal_the_walk(spark, tmp_path):
    frames, samples = scene(5)
    seen = set()
    summed = grid.summaries(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(samples, SAMPLES), MAP).persist()
    rows = [r.asDict() for r in grid.checked(summed, MAP).collect()]
    want = walked(rows)
    got = {(r.mission, r.seq): r.reject_reason for r in grid.judged(summed, MAP).collect()}
    assert got == want
    seen |= {r for r in want.values() if r}
    assert seen == set(gates.GRID)
    # the same frames as a stream, in files that arrive one after another
    folder = str(tmp_path / "in")
    for i in range(0, 240, 60):
        summed.where(F.col("seq").between(i, i + 59)).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(summed.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.accepted(arriving, MAP).writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation",
        str(tmp_path / "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.mission, r.seq): r.reject_reason for r in spark.table("judged").collect()} == want


def test_class_sets_are_judged_by_their_first_row_that_is_no_copy(spark):
    """The first row of a class set is a copy of an accepted frame, so a later row decides; a refused frame leaves no class behind."""
    base = lambda seq, frame, classes: {"mission": 0, "seq": seq, "frame": frame, "classes": classes}
    rows = [base(0, "a", [0, 1]), base(1, "a", [2, 3]), base(2, "b", [4, 5, 6]), base(3, "c", [2, 3]), base(4, "d", [7]), base(5, "d", [2]), base(6, "e", [7]), base(7, "b", [0])]
    fixed = ["t", "pose_t", "height", "width", "image_height", "image_width", "safe", "candidates", "inside", "integrated", "sampled"]
    df = spark.createDataFrame(rows, "mission long, seq long, frame string, classes array<bigint>").withColumns({c: F.lit(1).cast("long") for c in fixed} | {"calibration": F.lit("c"), "pose": F.lit("p"), "uncertainty": F.lit(0.1)})
    got = {(r.mission, r.seq): r.reject_reason for r in grid.judged(df, MAP).collect()}
    full, budget = "semantic_class_limit_exceeded", "semantic_memory_budget_exceeded"
    assert got == walked(rows_of(df)) and [got[0, i] for i in range(8)] == [None, "duplicate_frame_id", None, full, budget, budget, budget, "duplicate_frame_id"]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_empty_map(spark):
    frames, samples = scene(6, 3)
    none = spark.createDataFrame([], FRAMES)
    judged = grid.judged(grid.summaries(none, spark.createDataFrame(samples, SAMPLES), MAP), MAP)
    assert judged.count() == 0
    assert grid.snapshot(judged, grid.contributions(judged, spark.createDataFrame(samples, SAMPLES), MAP), MAP).count() == 0


def test_stream_holds_no_batch(monkeypatch):
    """Rows of a mission wait for their turn as numbers: of the batches only the last is held, and the results go out in pieces."""
    seen, state = [], {}

    def batches():
        for start in (200, 100, 0):  # the last to arrive come first
            assert all(ref() is None for ref in seen[:-1])
            seqs = range(start, start + 100)
            df = pd.DataFrame({"seq": seqs, "frame": [str(s % 150) for s in seqs], "classes": [[s % 4] if s % 3 else [] for s in seqs], "before": [None if s % 7 else "early" for s in seqs], "after": None})
            seen.append(weakref.ref(df))
            yield df
            del df

    class State:
        exists = False

        def update(self, value):
            state["held"] = value

    monkeypatch.setattr(stream, "CHUNK", 64)
    out = list(stream.stepping(grid.Settings(0, 0, 1, 4, 4, max_classes=2))((1,), batches(), State()))
    assert max(map(len, out)) == 64 and sum(map(len, out)) == 300
    frames, classes, want = set(), set(), []
    for s in range(300):
        own = {s % 4} if s % 3 else set()
        reason = "early" if s % 7 == 0 else "duplicate_frame_id" if str(s % 150) in frames else "semantic_class_limit_exceeded" if own and len(classes | own) > 2 else None
        if reason is None:
            frames.add(str(s % 150))
            classes |= own
        want.append((s, reason))
    got = pd.concat(out)
    assert [(s, r) for s, r in zip(got.seq, got.reject_reason)] == want
    assert state["held"] == (sorted(frames), sorted(classes))
