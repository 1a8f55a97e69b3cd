"""Retention of layers, streamed manifests, digest trees and curves in ranges against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evifuse.functions import ranges
from evifuse.functions.ranges import numbered
from evifuse.operators import metrics, protocol, tracks


def held(arrivals, keep, cap):
    """Seqs that a layer holds after its arrivals (seq, t)."""
    out, newest = [], None
    for seq, t in arrivals:
        out.append((seq, t))
        if t is not None:
            newest = t if newest is None else max(newest, t)
        out = [x for x in out if x[1] is None or x[1] >= newest - keep][-cap:]
    return [seq for seq, _ in out]


@pytest.mark.parametrize("cap", [1, 4, 30])
def test_layers_hold_what_arrivals_leave(spark, cap):
    rng = random.Random(cap)
    layers = {name: [(i, None if rng.random() < 0.1 else rng.choice([i, i, rng.randint(0, 300),
        290 if i == 199 else i])) for i in range(200)] for name in "abc"} | {"d": [(5, None)], "e": [(1, 10), (2, 0), (3, 10)]}
    points = spark.createDataFrame([(name, i, t, "x") for name, rows in layers.items() for i, t in rows], "layer string, seq long, t long, v string").repartition(4)
    got = tracks.layer_retained(points, 40, cap).collect()
    assert sorted((r.layer, r.seq) for r in got) == sorted((n, s) for n, rows in layers.items() for s in held(rows, 40, cap))
    assert tracks.layer_retained(points.limit(0), 40, cap).count() == 0


def test_manifest_of_many_pieces(spark):
    protocol.PIECE, kept = 40, protocol.PIECE
    try:
        rows = [("en", f"s{i % 90}é") for i in range(200)] + [("de", "one"), ("de", None), (None, "two"), (None, "ten")]
        got = {r.lang: (r.n, r.digest) for r in protocol.manifest(spark.createDataFrame(rows, "lang string, token string").repartition(3), ["lang"], "token").collect()}
    finally:
        protocol.PIECE = kept
    words = lambda lang: sorted(t for l, t in rows if l == lang and t is not None)  # noqa: E731,E741
    assert got == {lang: (len(words(lang)), hashlib.sha256("\n".join(words(lang)).encode()).hexdigest()) for lang in ("en", "de", None)}


def test_canonical_json(spark):
    values = [{"b": 1, "a": {"z": "é\"\\\n", "y": None}, "c": [{"q": 0.5, "p": True}, None], "d": {"k2": 2, "k1": 1}}, {"b": None, "a": None, "c": [], "d": None}]
    kind = "struct<b:long,a:struct<z:string,y:string>,c:array<struct<q:double,p:boolean>>,d:map<string,long>>"
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    got = {r.i: r.j for r in rows.select("i", protocol.canonical_json(F.col("v"), rows.schema["v"].dataType).alias("j")).collect()}
    assert [got[i] for i in range(2)] == [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in values]


def test_trees_differ_where_tokens_do(spark):
    ours, theirs = [f"t{i}" for i in range(500)], [f"t{i}" for i in range(500) if i != 77] + ["t3", "new"]
    frame = lambda words: spark.createDataFrame([(w,) for w in words], "sample string")
    trees = [protocol.digest_tree(frame(w), "sample") for w in (ours, random.Random(1).sample(ours, 500), theirs)]
    assert protocol.differing(trees[0], trees[1]).count() == 0
    odd = protocol.differing(trees[0], trees[2]).collect()
    leaf = lambda w: int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) >> 20
    assert {r.bucket for r in odd if r.level == 3} == {leaf("t77"), leaf("t3"), leaf("new")} and {r.level for r in odd} == {0, 1, 2, 3}
    failures = spark.createDataFrame([("t77", "b"), ("t77", "a"), ("t3", "x")], "sample string, reason string")
    told = {r["sample"]: (r.reason, r.failure_class) for r in protocol.reconciled(frame(ours), frame(theirs), failures).collect()}
    assert told == {"t77": ("external runtime failure: a", "runtime"), "t3": ("invalid or duplicate sample_id", "integrity_or_completeness"),
        "new": ("unexpected output entry", "integrity_or_completeness")}


def test_curves_over_ranges_with_one_hot_confidence(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.choice([0.5, 0.5, 0.5, rng.random()]), i, int(rng.random() < 0.4)) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        curve = metrics.precision_curve(spark.createDataFrame(rows, "k string, confidence double, id long, hit int").repartition(3), ["k"])
        ap = {r.k: r.ap for r in metrics.average_precision(curve, ["k"]).collect()}
        lamr = {r.k: r.lamr for r in metrics.log_average_miss_rate(curve, ["k"], 200).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in "ab":
        hits = np.array([h for _, _, _, h in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))], float)
        tp, n = np.cumsum(hits), np.arange(1, len(hits) + 1)
        best = np.maximum.accumulate((tp / n)[::-1])[::-1]
        missed = [min([1.0, *(1 - tp / hits.sum())[(n - tp) / 200 <= 10 ** (-2 + i / 4)]]) for i in range(9)]
        assert abs(ap[k] - (best * hits).sum() / hits.sum()) < 1e-12 and abs(lamr[k] - np.exp(np.mean(np.log(np.maximum(missed, 1e-10))))) < 1e-12


def test_ranges_of_a_curve_are_bounded(spark):
    """Ranges are as many as the rows need, whatever is coalesced; keys go on from batch to batch, and one without hits has no average."""
    rows = [(k, i % 7 / 7, i, int(k != "c" and i % 3 == 0)) for k in "abc" for i in range(1000)]
    ranges.PART, kept = 250, ranges.PART
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        curve = metrics.precision_curve(spark.createDataFrame(rows, "k string, confidence double, id long, hit int"), ["k"])
        sizes = [r.n for r in curve.groupBy("part").agg(F.count("*").alias("n")).collect()]
        got = {(r.k, r.id): (r.tp, r["rank"]) for r in curve.collect()}
        ap = {r.k: r.ap for r in metrics.average_precision(curve, ["k"]).collect()}
    finally:
        ranges.PART = kept
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(sizes) >= 8 and max(sizes) < 750 and len(got) == 3000
    for k in "abc":
        tp = 0
        for rank, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            tp += r[3]
            assert got[k, r[2]] == (tp, rank)
    assert ap["c"] is None and ap["a"] > 0 and abs(ap["a"] - ap["b"]) < 1e-12


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(1000), 300)], "v long").repartition(5)
    got = sorted((r.number, r.v) for r in numbered(rows, "v").collect())
    assert [n for n, _ in got] == list(range(300)) and [v for _, v in got] == sorted(v for _, v in got)
