"""Detection statistics against the plain definition: copied rows, one image after another."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evifuse.operators import detection

BOXES = "image long, id long, x double, y double, w double, h double"


def greedy(truth, predictions, threshold):
    """Hits of the predictions of one image in their order."""
    free, out = [True] * len(truth), []
    for p in predictions:
        near = [float(detection.overlap(np.array(p), np.array(t))) if ok else -1.0 for t, ok in zip(truth, free)]
        best = int(np.argmax(near)) if near else -1
        out.append(best >= 0 and near[best] >= threshold)
        if out[-1]:
            free[best] = False
    return out


def curve_numbers(hits, boxes, images):
    """Average precision and miss rate of hits in their order."""
    hits = np.array(hits, float)
    if not boxes or not len(hits):
        return 0.0, 1.0
    tp, n = np.cumsum(hits), np.arange(1, len(hits) + 1)
    best = np.maximum.accumulate((tp / n)[::-1])[::-1]
    missed = [1 - max([0, *tp[(n - tp) / images <= rate]]) / boxes for rate in detection.RATES]
    return float((best * hits).sum() / boxes), float(np.exp(np.mean(np.log(np.maximum(missed, 1e-10)))))


def random_boxes(rng, n):
    return [[rng.randint(0, 6) / 8, rng.randint(0, 6) / 8, rng.choice([0.25, 0.5]), rng.choice([0.25, 0.5])] for _ in range(n)]


def test_match_bits_equal_greedy():
    rng = random.Random(1)
    images = [(random_boxes(rng, rng.choice([0, 1, 2, 3, 5, 9, 17])), random_boxes(rng, rng.randint(0, 14))) for _ in range(80)]
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in "xywh"]))
    column = lambda i: detection.lists_of(pa.array([[dict(zip("xywh", b)) for b in image[i]] for image in images], kind))
    for cells in (1 << 22, 60):  # also in small groups of images
        detection.CELLS, kept = cells, detection.CELLS
        bits = detection.match_bits(column(1), column(0))
        detection.CELLS = kept
        want = [[greedy(t, p, x) for x in detection.THRESHOLDS] for t, p in images]
        assert bits.tolist() == [sum(w[t][k] << t for t in range(10)) for w, (_, p) in zip(want, images) for k in range(len(p))]
    assert len(detection.match_bits(detection.lists_of(pa.array([[]], kind)), detection.lists_of(pa.array([[]], kind)))) == 0


def test_replicates_equal_copied_groups(spark):
    rng = random.Random(2)
    truth, predictions, group = [], [], {}
    for image in range(60):
        group[image] = f"g{image % 7}"
        truth += [(image, i, *b) for i, b in enumerate(random_boxes(rng, rng.randint(0, 4)))]
        predictions += [("ab"[i % 2], image, image * 100 + i, rng.random(), *b) for i, b in enumerate(random_boxes(rng, rng.randint(0, 12)))]
    t = spark.createDataFrame(truth, BOXES)
    p = spark.createDataFrame(predictions, "view string, image long, id long, score double, x double, y double, w double, h double")
    bits = detection.matched(t, p, ["view"]).withColumn("grp", F.concat(F.lit("g"), F.col("image") % 7))
    sizes = {g: (sum(x == g for x in group.values()), sum(group[r[0]] == g for r in truth)) for g in set(group.values())}
    sized = spark.createDataFrame([(g, *v) for g, v in sizes.items()], "grp string, images long, boxes long")
    drawn = {r: [rng.choice(sorted(sizes)) for _ in sizes] for r in range(300)}  # beyond one chunk of replicates
    times = spark.createDataFrame([(r, g, d.count(g)) for r, d in drawn.items() for g in set(d)], "rep long, grp string, times long")
    got = {(r.view, r.rep): r for r in detection.curves(bits, sized, times, 300, size=16).collect()}
    assert len(got) == 600
    rows = {(view, i): (score, image) for view, image, i, score, *_ in predictions}
    order = {v: sorted((k for k in rows if k[0] == v), key=lambda k: (-rows[k][0], rows[k][1], k[1])) for v in "ab"}
    hits = {(r.view, r.id): r.bits for r in bits.collect()}
    for rep in [*range(12), 255, 256, 299]:
        images, boxes = (sum(sizes[g][i] for g in drawn[rep]) for i in (0, 1))
        for view in "ab":
            copies = [k for k in order[view] for _ in range(drawn[rep].count(group[rows[k][1]]))]
            told = [curve_numbers([hits[k] >> t & 1 for k in copies], boxes, images) for t in range(10)]
            r = got[view, rep]
            assert np.allclose([r.ap_50_95, r.ap50, r.miss_rate], [np.mean([a for a, _ in told]), told[0][0], told[0][1]])


def test_nothing_to_find(spark):
    """No truths: precision 0, every truth missed by definition."""
    p = spark.createDataFrame([("v", 1, 1, 0.5, 0.0, 0.0, 1.0, 1.0)], "view string, image long, id long, score double, x double, y double, w double, h double")
    bits = detection.matched(spark.createDataFrame([], BOXES), p, ["view"]).withColumn("grp", F.lit("g"))
    sizes = spark.createDataFrame([("g", 1, 0)], "grp string, images long, boxes long")
    assert [tuple(r) for r in detection.detection_metrics(bits, sizes).collect()] == [("v", 0.0, 0.0, 1.0)]
    assert detection.detection_metrics(bits.limit(0), sizes).count() == 0


def test_weights_have_no_more_columns_than_replicates(spark):
    drawn = spark.createDataFrame([(0, "a", 2), (1, "a", 1), (2, "b", 4)], "rep long, grp string, times int")
    got = {(r.grp, r.chunk): list(np.frombuffer(r.weights, "<u4")) for r in detection.weights_of(drawn, 2).collect()}
    assert got == {("a", 0): [2, 1], ("b", 1): [4, 0]}
    bits = spark.createDataFrame([("v", "a", 1, 1, 0.5, 1)], "view string, grp string, image long, id long, score double, bits long")
    sizes = spark.createDataFrame([("a", 1, 1)], "grp string, images long, boxes long")
    assert [r.rep for r in detection.curves(bits, sizes, spark.createDataFrame([(0, "a", 1)], "rep long, grp string, times int"), 1, (0.5,)).collect()] == [0]
