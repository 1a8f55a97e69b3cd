"""Detection statistics: matching at many thresholds in one pass, mean average precision, resampled groups by weighted ranks.

A replicate that draws a group k times counts each of its predictions, truths and images k times. Copies of a prediction stand
next to each other in the order of scores and are all hits or all misses, so the best precision within them is at their
end: weights in place of copies give the same curve. Predictions are ordered once, by ranges, and packed into blocks of at
most ``BLOCK``; a block is multiplied with the weights of its own groups in all replicates at a time. What lies before a block
(sums) and beyond it (the best precision) is carried from block to block, so no task orders all predictions and no row is copied.

Of equal scores the smaller image, then the smaller id comes first. Without truths the precision is 0 and the miss rate 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.operators import metrics
from evifuse.sources.scratch import written

#: Overlaps at which a match counts, and false positives per image at which miss rates are read.
THRESHOLDS = tuple(0.5 + 0.05 * i for i in range(10))
RATES = tuple(float(x) for x in np.logspace(-2, 0, 9))
#: Predictions in a block, replicates worked on at once, cells of a padded group of images.
BLOCK, REPLICATES, CELLS = 1 << 12, 1 << 8, 1 << 22

BOX = "array<struct<x:double,y:double,w:double,h:double>>"
Lists = tuple[np.ndarray, np.ndarray]


def lists_of(column: pa.ListArray, names: str = "xywh") -> Lists:
    """Offsets, and the fields of all structs as columns of one array."""
    flat = column.flatten()
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return offsets.astype(np.int64), np.stack([flat.field(n).to_numpy(zero_copy_only=False) for n in names], 1) if len(flat) else np.zeros((0, len(names)))


def overlap(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (.., x, y, w, h)."""
    x, y, w, h = np.moveaxis(box, -1, 0)
    a, b, c, d = np.moveaxis(boxes, -1, 0)
    shared = np.maximum(np.minimum(x + w, a + c) - np.maximum(x, a), 0) * np.maximum(np.minimum(y + h, b + d) - np.maximum(y, b), 0)
    return shared / np.maximum(w * h + c * d - shared, 1e-12)


def taken(predicted: Lists, truth: Lists, thresholds=THRESHOLDS) -> np.ndarray:
    """The truth, as its row, that each prediction takes at each threshold; -1 for none.

    Predictions of an image stand in order; each takes the free truth that it overlaps most, the first of equal ones, if that reaches the
    threshold. All images with about as many truths go together, prediction by prediction, all thresholds at once.
    """
    (starts, boxes), (at, held) = predicted, truth
    counts, sizes = np.diff(starts), np.diff(at)
    least = np.array(thresholds)
    rows = np.full((len(boxes), len(least)), -1, np.int64)
    for width in sorted({1 << int(s - 1).bit_length() for s in sizes if s}):
        alike = np.flatnonzero((sizes <= width) & (sizes > width // 2) & (counts > 0))
        most = max(1, CELLS // (width * len(least)))
        for images in (alike[i : i + most] for i in range(0, len(alike), most)):
            images = images[np.argsort(-counts[images], kind="stable")]
            cells = at[images][:, None] + np.arange(width)
            real = np.arange(width) < sizes[images][:, None]
            boxed = held[np.where(real, cells, 0)]
            free = np.repeat(real[:, :, None], len(least), 2)
            for k in range(int(counts[images[0]])):
                n = int((counts[images] > k).sum())
                row = starts[images[:n]] + k
                near = np.where(free[:n], overlap(boxes[row][:, None], boxed[:n])[:, :, None], -1.0)
                best = near.argmax(1)
                hit = np.take_along_axis(near, best[:, None], 1)[:, 0] >= least
                rows[row] = np.where(hit, at[images[:n]][:, None] + best, -1)
                i, t = np.nonzero(hit)
                free[i, best[i, t], t] = False
    return rows


def match_bits(predicted: Lists, truth: Lists, thresholds=THRESHOLDS) -> np.ndarray:
    """Bit t of each prediction: whether it takes a truth of its image at threshold t, as ``taken`` tells."""
    return ((taken(predicted, truth, thresholds) >= 0) << np.arange(len(thresholds))).sum(1)


def matched(truth: DataFrame, predictions: DataFrame, keys: list[str], thresholds=THRESHOLDS) -> DataFrame:
    """keys, image, id, score, bits for predictions (keys, image, id, score, x, y, w, h) and truths (image, id, x, y, w, h). An image's boxes meet in one row."""
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in "xywh"))
    held = truth.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", box.alias("box")))), lambda s: s["box"]).alias("truth"))
    found = predictions.groupBy(*keys, "image").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("falling"), "id", box.alias("box")))).alias("found"))
    rows = found.join(held, "image", "left").select(*keys, "image", F.transform("found", lambda s: s["box"]).alias("boxes"), "found", F.coalesce("truth", F.array().cast(BOX)).alias("truth"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = match_bits(lists_of(batch.column("boxes")), lists_of(batch.column("truth")), thresholds)
            found = batch.column("found")
            rows, flat = pa.array(np.repeat(np.arange(len(batch)), found.value_lengths().to_numpy(zero_copy_only=False))), found.flatten()
            score = pa.array(-flat.field("falling").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in [*keys, "image"]), flat.field("id"), score, pa.array(bits)], [*keys, "image", "id", "score", "bits"])

    kinds = {f.name: f.dataType.simpleString() for f in predictions.schema}
    return rows.mapInArrow(task, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "image", "id"]) + ", score double, bits long")


def blocks(bits: DataFrame, size: int = BLOCK) -> DataFrame:
    """view, part, grps, codes, bits: predictions (view, grp, image, id, score, bits) by falling score, a block a row. Parts ascend with the order."""
    order = ["view", F.desc("score"), "image", "id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, view = TaskContext.get().partitionId() << 32, [], None

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            if held:
                number += 1
                groups = list(dict.fromkeys(g for g, _ in held))
                place = {g: i for i, g in enumerate(groups)}
                codes, marks = np.array([place[g] for g, _ in held], "<i4"), np.array([b for _, b in held], "<i8")
                yield pa.record_batch({"view": [view], "part": pa.array([number], pa.int64()), "grps": pa.array([groups], pa.list_(pa.string())),
                    "codes": [codes.tobytes()], "bits": [marks.tobytes()]})
                held = []

        for batch in batches:
            for v, g, b in zip(*(batch.column(c).to_pylist() for c in ("view", "grp", "bits"))):
                if v != view or len(held) >= size:
                    yield from told()
                    view = v
                held.append((g, b))
        yield from told()

    rows = bits.select("view", F.col("grp").cast("string").alias("grp"), "image", "id", "score", "bits").repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(packed, "view string, part long, grps array<string>, codes binary, bits binary")


def weights_of(drawn: DataFrame, width: int) -> DataFrame:
    """grp, chunk, weights: how often each of ``width`` replicates draws a group, from (rep, grp, times)."""
    of = drawn.select(F.col("grp").cast("string").alias("grp"), F.expr(f"CAST(rep DIV {width} AS INT)").alias("chunk"),
        (F.col("rep") % width).cast("int").alias("slot"), F.col("times").cast("int").alias("times"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for entries in batch.column("entries").to_pylist():
                row = np.zeros(width, "<u4")
                for e in entries:
                    row[e["slot"]] += e["times"]
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("chunk"), pa.array(out, pa.binary())], ["grp", "chunk", "weights"])

    return of.groupBy("grp", "chunk").agg(F.collect_list(F.struct("slot", "times")).alias("entries")).mapInArrow(packed, "grp string, chunk int, weights binary")


def _block(row: dict, thresholds: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (predictions x replicates) and hits (thresholds x predictions) of a block."""
    none = bytes(4 * width)
    table = np.stack([np.frombuffer(w if w is not None else none, "<u4") for w in row["weights"]]).astype(np.float64)
    marks = np.frombuffer(row["bits"], "<i8")
    return table[np.frombuffer(row["codes"], "<i4")], (marks >> np.arange(thresholds)[:, None] & 1).astype(np.float64)


def _floats(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(*shape, -1)


KEYS = "view string, chunk int, part long"


def _per_block(rows: DataFrame, names: list[str], work) -> DataFrame:
    """view, chunk, part and binaries of the given names, by ``work`` on each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("view", "chunk", "part")} | {n: np.ascontiguousarray(x, "<f8").tobytes() for n, x in zip(names,
                    work(row))}], pa.schema([("view", pa.string()), ("chunk", pa.int32()), ("part", pa.int64()), *((n, pa.binary()) for n in names)]))

    return rows.mapInArrow(task, KEYS + "".join(f", {n} binary" for n in names))


def carried(rows: DataFrame, names: list[str], add, falling: bool = False) -> DataFrame:
    """For each block what the blocks before it (or beyond it) come to, ``add`` taking two arrays; a stream of sums, one for each block."""
    parted = rows.repartition("view", "chunk").sortWithinPartitions("view", "chunk", F.desc("part") if falling else "part")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = [np.frombuffer(row[n], "<f8") for n in names]
                if at != (row["view"], row["chunk"]):
                    at, held = (row["view"], row["chunk"]), [np.zeros_like(x) for x in own]
                out.append(row | {n: x.tobytes() for n, x in zip(names, held)})
                held = [add(a, b) for a, b in zip(held, own)]
            if out:
                yield pa.RecordBatch.from_pylist(out, batch.schema)

    return parted.mapInArrow(task, rows.schema)


def curves(bits: DataFrame, sizes: DataFrame, drawn: DataFrame, replicates: int, thresholds=THRESHOLDS, size: int = BLOCK) -> DataFrame:
    """view, rep, ap_50_95, ap50, miss_rate of each replicate.

    bits: view, grp, image, id, score, bits. sizes: grp, images, boxes. drawn: rep, grp, times. ap_50_95 is the mean over all
    thresholds, ap50 that of the first, miss_rate the log-average miss rate at the first.
    """
    width, many = min(REPLICATES, max(replicates, 1)), len(thresholds)  # no more columns than replicates
    n_chunks = -(-replicates // width)
    chunk = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")
    packed = written(blocks(bits, size), "detection-blocks")
    weights = written(weights_of(drawn, width), "detection-weights")
    named = packed.select("view", "part", F.posexplode("grps").alias("at", "grp")).select("*", chunk).join(weights, ["grp", "chunk"], "left")
    held = named.groupBy("view", "part", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "weights"))), lambda s: s["weights"]).alias("weights"))  # the groups of one block
    woven = written(packed.drop("grps").join(held, ["view", "part"]), "detection-woven")

    def totals(row: dict):
        w, hits = _block(row, many, width)
        return hits @ w, w.sum(0)

    sums = written(_per_block(woven, ["tp", "n"], totals), "detection-sums")
    before = written(carried(sums, ["tp", "n"], np.add), "detection-before")
    begun = woven.join(before, ["view", "chunk", "part"])

    def running(row: dict):
        w, hits = _block(row, many, width)
        n, tp = _floats(row["n"])[None] + np.cumsum(w, 0), _floats(row["tp"], many)
        for t in range(many):
            yield w, hits[t] > 0, n, tp[t][None] + np.cumsum(w * hits[t][:, None], 0)

    def tops(row: dict):
        yield np.stack([(tp[hit] / np.maximum(n[hit], 1e-12)).max(0, initial=0) for _, hit, n, tp in running(row)])

    beyond = written(carried(_per_block(begun, ["top"], tops), ["top"], np.maximum, True), "detection-beyond")
    whole = sizes.select(F.col("grp").cast("string").alias("grp"), "images", "boxes").join(drawn.select(F.col("grp").cast("string").alias("grp"), "rep", "times"), "grp")
    whole = whole.groupBy("rep").agg(F.sum(F.col("times") * F.col("boxes")).alias("boxes"), F.sum(F.col("times") * F.col("images")).alias("images"))
    whole = written(whole, "detection-sizes")
    images = whole.select(F.expr(f"CAST(rep DIV {width} AS INT)").alias("chunk"), F.struct((F.col("rep") % width).alias("slot"),
        "images").alias("s")).groupBy("chunk").agg(F.collect_list("s").alias("per_image"))

    def areas(row: dict):
        last, per = _floats(row["top"], many), np.full(width, np.inf)
        for s in row["per_image"]:
            per[s["slot"]] = s["images"]
        area, found = np.zeros((many, width)), np.zeros((len(RATES), width))
        for t, (w, hit, n, tp) in enumerate(running(row)):
            best = np.vstack([(tp[hit] / np.maximum(n[hit], 1e-12)), last[t][None]])
            area[t] = (w[hit] * np.maximum.accumulate(best[::-1], 0)[::-1][:-1]).sum(0)
            if t == 0:
                rate = (n - tp) / per[None]
                ends = np.vstack([np.zeros((1, width)), tp])
                for i, most in enumerate(RATES):
                    found[i] = np.take_along_axis(ends, (rate <= most).sum(0)[None], 0)[0]
        return area, found

    ended = begun.join(beyond, ["view", "chunk", "part"]).join(F.broadcast(images), "chunk")  # as many numbers as replicates
    parts = _per_block(ended, ["area", "found"], areas)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                area, found = _floats(row["area"], many), _floats(row["found"], len(RATES))
                at = held.setdefault((row["view"], row["chunk"]), [np.zeros_like(area), np.zeros_like(found)])
                at[0], at[1] = at[0] + area, np.maximum(at[1], found)
        for (view, number), (area, found) in held.items():
            rows = [(view, number * width + r, kind, i, float(x[i, r])) for kind, x in (("area", area), ("found", found)) for r in range(width) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["view", "rep", "kind", "i", "value"])

    each = parts.mapInArrow(told, "view string, rep long, kind string, i long, value double").groupBy("view", "rep", "i").agg(F.sum(F.when(F.col("kind") == "area",
        F.col("value"))).alias("area"), F.max(F.when(F.col("kind") == "found", F.col("value"))).alias("found"))
    per = each.join(whole, "rep")
    precision = F.when(F.col("boxes") > 0, F.col("area") / F.col("boxes")).otherwise(F.when(F.col("area").isNotNull(), 0.0))
    missed = F.when((F.col("boxes") > 0) & (F.col("images") > 0), 1 - F.col("found") / F.col("boxes")).otherwise(F.when(F.col("found").isNotNull(), 1.0))
    return per.groupBy("view", "rep").agg(F.avg(precision).alias("ap_50_95"), F.max(F.when(F.col("i") == 0, precision)).alias("ap50"),
        F.exp(F.avg(F.when(missed.isNotNull(), F.log(F.greatest(missed, F.lit(1e-10)))))).alias("miss_rate"))


NAMES = ("ap_50_95", "ap50", "miss_rate")


def detection_metrics(bits: DataFrame, sizes: DataFrame, **options) -> DataFrame:
    """view, ap_50_95, ap50, miss_rate over everything: one replicate that draws each group once."""
    once = sizes.select(F.lit(0).cast("long").alias("rep"), "grp", F.lit(1).alias("times"))
    return curves(bits, sizes, once, 1, **options).drop("rep")


def bootstrap(bits: DataFrame, sizes: DataFrame, baseline: str, replicates: int, seed: str, level: float = 0.95, **options) -> DataFrame:
    """view, metric, low, high, and over the same draws the difference to the baseline: delta_low, delta_high, better (the share of replicates)."""
    drawn = written(metrics.draws(sizes, replicates, seed), "detection-draws")
    values = curves(bits, sizes, drawn, replicates, **options)
    long = written(values.select("view", "rep", F.explode(F.create_map(*(x for n in NAMES for x in (F.lit(n), F.col(n))))).alias("metric", "value")), "detection-values")
    base = long.where(F.col("view") == baseline).select("rep", "metric", F.col("value").alias("base"))
    both = long.join(base, ["rep", "metric"]).withColumn("delta", F.col("value") - F.col("base"))
    rising = F.when(F.col("metric") == "miss_rate", -F.col("delta")).otherwise(F.col("delta"))
    ends = ((1 - level) / 2, (1 + level) / 2)
    of = lambda c, p: F.percentile(c, F.lit(p))
    found = both.groupBy("view", "metric").agg(of("value", ends[0]).alias("low"), of("value", ends[1]).alias("high"), of("delta", ends[0]).alias("delta_low"), of("delta",
        ends[1]).alias("delta_high"), F.avg((rising > 0).cast("double")).alias("better"))
    other = F.col("view") != baseline
    return found.select("view", "metric", "low", "high", *(F.when(other, F.col(c)).alias(c) for c in ("delta_low", "delta_high", "better")))
