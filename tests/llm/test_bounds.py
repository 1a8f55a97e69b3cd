"""What holds where labels are few, ids repeat, names clash or rules tie."""

import random
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evifuse.llm import bpe, packing, quality, shared, toxicity, url_filter

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_toxicity_sample_is_bounded_where_ids_repeat(spark):
    ids = [i for i in range(60)]
    docs = spark.createDataFrame([(i, f"text {i}", 1) for i in ids] + [(ids[7], "again", 2)] * 3000 + [(ids[8], f"other {k}", 3) for k in range(500)] + [(ids[9], None, 4)] * 5, "doc_id long, text string, digest long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    rows = toxicity.sample(docs, labels, 10).collect()
    assert len(rows) == 20 and sum(r.toxic for r in rows) == 10
    every = toxicity.sample(docs, labels, 10_000).collect()
    assert len({(r.doc_id, bytes(r.raw) if r.raw is not None else None) for r in every}) == len(every)
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    assert len(every) == docs.where(~F.col("doc_id").isin(list(held))).select("doc_id", "text").distinct().count()


def test_packing_ends_in_one_task_after_a_shuffle(spark):
    """The last underfull bins meet in one task, but are read by many."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', CAST(1 + id % 37 AS INT))").alias("text")).repartition(8)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 64).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) and max(used.values()) <= 64
    assert len(used) <= 1.05 * sum(r.length for r in rows) / 64 + 2


def test_longest_rule_in_characters_wins_either_way(spark):
    rules = [("com/ééé", "block"), ("ab.com/é", "allow"), ("ab.com/éé", "block"), ("com/x/y", "allow"), ("b.com/x", "block"), ("b.com", "block")]
    urls = ["http://ab.com/ééé/x", "http://ab.com/é", "http://a.b.com/x/y/z", "https://B.com", "http://ab.com/" + "é" * 5000, "x://" + "a." * 300 + "com/x/y", None, "no url"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    large = {r.page_id: r for r in url_filter.judge_large(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    assert got == large
    assert [got[i].rule for i in range(8)] == ["ab.com/éé", "ab.com/é", "com/x/y", "b.com", "ab.com/éé", "com/x/y", None, None]
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, rules).count() == url_filter.judge_large(none, spark.createDataFrame(rules, "rule string, verdict string")).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_bpe_takes_no_name_that_is_there(spark):
    docs = spark.createDataFrame([(1, "some text", "mine"), (2, None, "mine"), (1, "some text", "mine")], "doc_id long, text string, IDS string")
    for call in (lambda: bpe.encode(docs, PATH, public_tokenizers.PATTERN), lambda: bpe.decode(docs.withColumn("decoded", F.lit(1)), PATH, public_tokenizers.PATTERN)):
        with pytest.raises(ValueError, match="already"):
            call()
    named = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN, into="coded"), PATH, public_tokenizers.PATTERN, "coded")
    assert sorted((r.IDS, bytes(r.decoded)) for r in named.collect()) == [("mine", b""), ("mine", b"some text"), ("mine", b"some text")]
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN, into="coded").count() == bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_digests_are_those_of_tiktoken(spark):
    import hashlib

    import numpy as np
    import tiktoken

    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    texts = ["", "Plain words, and more.", "日本語 ünïcode\n\n  don't", "x" * 4000, "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_quality_pools_strata_with_few_labels(spark):
    """No stratum of forty labels can prove 0.05; five of them together can, at the rate that two hundred labels prove."""
    rng = random.Random(3)
    text = lambda mark: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + mark for _ in range(60))
    langs = ["a", "b", "c", "d", None]
    rows = [(i, text(""), langs[i % 5]) for i in range(300)] + [(1000 + i, text("%%"), langs[i % 5]) for i in range(30)] + [(2000, text("%%"), "unlabelled")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == {*range(300), 2000}
    few = {r.doc_id for r in quality.judge(docs, labels.where("doc_id < 100")).where("kept").collect()}
    assert few == {r[0] for r in rows}
    own = quality.thresholds(quality.measures_of(docs), labels).collect()
    assert {r.stratum for r in own} == {"=a", "=b", "=c", "=d", ""} and len({r.cutoff for r in own if r.measure == "symbol_rate"}) == 1


def test_shared_folder_is_never_one_machine_s_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default: None)

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://head:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(Cluster())


def test_kept_rows_are_stored_smaller_than_snappy(spark, tmp_path):
    """The rows that the quality rules store beside their measures stay in the shared folder."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=400)), "en") for i in range(400)], "doc_id long, text string, lang string").coalesce(1)
    docs.write.option("compression", "snappy").parquet(f"{tmp_path}/docs")
    folder = Path(shared.shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("quality-measures-*"))
    kept = quality.keep(spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert sorted(kept.columns) == ["doc_id", "lang", "text"] and kept.count() <= 400
    (stored,) = set(folder.glob("quality-measures-*")) - before
    size = lambda of: sum(p.stat().st_size for p in of.glob("*.parquet"))
    assert 0 < size(stored) < 0.85 * size(tmp_path / "docs")
