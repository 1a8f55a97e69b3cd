"""Line deduplication against brute force and SQL, over many parts, with odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evifuse.llm import line_dedup

DOCS = "doc_id long, text string, row long, keep string, place long, hi long"
STRIP = " \t\n\v\f\r"


def brute(docs, least_chars, least_docs):
    """Kept text of each (doc_id, text)."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(STRIP))
    held = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars and doc_id is not None:
                held[key(line)].add(doc_id)
    gone = lambda doc_id, line: len(held.get(key(line), ())) >= least_docs and doc_id != max(held[key(line)])
    return [(doc_id, text, [x for x in (text or "").split("\n") if not gone(doc_id, x)]) for doc_id, text in docs]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3) for i, t in docs], DOCS).repartition(3)


def corpus(n, seed):
    rng = random.Random(seed)
    common = ["Shared line é %d " % i + "x" * rng.randint(0, 40) for i in range(30)]
    out = []
    for i in range(n):
        lines = [rng.choice(["", " ", "\t", "\r"]) + rng.choice([str.upper, str.lower, str])(rng.choice(common)) + rng.choice(["", "\r", "  "]) for _ in range(rng.randint(0, 6))]
        out.append((i, "\n".join(lines + ["hot line that everybody holds, in every single text"] * rng.randint(0, 3) + [str(rng.random())])))
    return out


ODD = [(1000, None), (1001, ""), (1002, "\n\n"), (None, "hot line that everybody holds, in every single text\nown"), (None, None), (3, "other text\nhot line that everybody holds, in every single text"), (5, "x" * 300_000), (1003, "日本語" * 20), (1004, "日本語" * 20)]


@pytest.mark.parametrize("parts", [1, 13])
def test_kept_lines_equal_brute_force(spark, parts):
    docs = corpus(150, 3) + ODD + [(7, "same"), (7, "same"), *[(2000 + i, "日本語" * 20) for i in range(5)]]
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # a common line then lies in several parts
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        digests = line_dedup.digests(frame(spark, docs), 20, 5).collect()
        texts = line_dedup.texts(frame(spark, docs), 20, 5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute(docs, 20, 5)
    assert any(len(kept) < len((text or "").split("\n")) for _, text, kept in want)
    told = lambda rows: sorted(rows, key=repr)
    assert told((r.doc_id, r.text) for r in texts) == told((i, "\n".join(kept)) for i, _, kept in want)
    sha = lambda kept: hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert told((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in digests) == told((i, n := len((t or "").split("\n")), n - len(kept), sha(kept)) for i, t, kept in want)
    assert all((r.keep is None) == (r.n_dropped == 0) for r in digests)


def test_streamed_parts_agree_wherever_they_are_cut(spark):
    """Rows in order, cut into parts and batches at any place between documents."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted({(h, 0, -rng.randint(0, 12), rng.randint(0, 2), p) for h in range(12) for p in range(rng.choice([1, 3, 40]))})
    names = ["hi", "lo", "doc_id", "row", "place"]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([(-r[2] or None) if j == 2 else r[j] for r in part], pa.int64()) for j in range(5)], names)
    rows.sort(key=lambda r: (r[0], r[2] == 0, r[2], r[3], r[4]))
    held = defaultdict(set)
    for h, _, d, _, _ in rows:
        held[h] |= {-d} - {0}
    want = sorted((-d or -1, r, p) for h, _, d, r, p in rows if len(held[h]) >= 3 and -d != max(held[h]))
    for _ in range(60):
        free = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]]
        cuts = [0, *sorted(rng.sample(free, rng.randint(0, 6))), len(rows)]
        out, sums = [], defaultdict(lambda: [0, -1])
        for a, b in zip(cuts, cuts[1:]):
            steps = [a, *sorted(rng.sample(range(a, b), min(b - a, 3))), b]
            out += [x for piece in line_dedup.first_occurrences((batch(rows[i:j]) for i, j in zip(steps, steps[1:])), 3) for x in piece.to_pylist()]
        for x in out:
            if x["n"] is not None:
                sums[x["hi"]][0] += x["n"]
                sums[x["hi"]][1] = max(sums[x["hi"]][1], x["first"] if x["first"] is not None else -1)
        gone = [x for x in out if x["n"] is None and (x["hi"] is None or sums[x["hi"]][0] >= 3 and x["doc_id"] != sums[x["hi"]][1])]
        assert sorted((x["doc_id"] or -1, x["row"], x["place"]) for x in gone) == want
        assert len([x for x in out if x["n"] is not None]) <= 2 * (len(cuts) - 1)


def test_empty_table(spark):
    assert line_dedup.digests(frame(spark, []).limit(0)).count() == 0
    assert line_dedup.texts(frame(spark, [(1, "a")]).where("doc_id = 2")).count() == 0


def test_bitmaps_are_short(spark):
    docs = frame(spark, [(i, "\n".join(["one very common line that stands in each of the documents"] * 5000)) for i in range(6)])
    rows = line_dedup.bitmaps(docs).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3, 4] and max(len(r.keep) for r in rows) < 100
    assert docs.join(line_dedup.bitmaps(docs), "doc_id", "left_anti").agg(F.max("doc_id")).first()[0] == 5
