"""Phrase mining against brute force, slices of long texts, parts cut anywhere."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from evifuse.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, n long, a double, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 0.5, "r") for i, (lang, t) in enumerate(rows)], DOCS).repartition(3)


def brute(rows, least, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    often = {k: v for k, v in counts.items() if v >= least}
    out = {}
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        inside = any(lang == other and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in often.items())
        if not inside:
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, totals[lang], -score) for lang, found in out.items() for i, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def told(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["a", "b", "the", "The", "é", "Ünder", "x\x01y", "new", "york", "\x00", "a b", "日本"]
    fixed = ["New York times", "a b a b a b a b", "the the the the the the the", "日本 é Ünder a b the"]
    text = lambda: "".join(rng.choice([rng.choice(words), rng.choice(fixed)]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "!? "]) for _ in range(rng.randint(0, 40)))
    return [(rng.choice(["en", "en", "en", "de", None]), text()) for _ in range(n)]


ODD = [(None, None), ("en", ""), ("fr", "alone"), ("", "a b. a b"), ("en", " \t .,\n"), ("de", "long " * 3000), ("x\ty", "q w e r t " * 9)]


@pytest.mark.parametrize("parts", [1, 11])
def test_collocations_equal_brute_force(spark, parts):
    rows = corpus(90, 6) + ODD
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert told(phrases.collocations(frame(spark, rows), 7, 25)) == brute(rows, 7, 25)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits, and a score that a double would miss."""
    rows = [("l", "x", 9_007_199_254_740_993), ("l", "y", 3_000_000_019), ("l", "x y", 2_999_999_999)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, n long"), spark.createDataFrame([("l", 9_223_372_036_854_775_783)], "lang string, n long")).first()
    assert got.score == 1000 * 2_999_999_999 * 9_223_372_036_854_775_783 // (9_007_199_254_740_993 * 3_000_000_019)


def test_slices_hold_every_window(monkeypatch):
    rng = random.Random(8)
    for size in (16, 40, 100):
        monkeypatch.setattr(phrases, "SLICE", size)
        for _ in range(80):
            text = "".join(rng.choice(["a", "bb", "ccc", "é", "w" * rng.randint(1, 90)]) + rng.choice([" "] * 9 + ["  ", ". ", "\n"]) for _ in range(rng.randint(0, 120))).encode()
            windows = lambda words, starts: [tuple(words[i : i + 5]) for i in range(starts)]
            whole = lambda found: Counter(w[: w.index(phrases.BREAK)] if phrases.BREAK in w else w for w in found if w[0] != phrases.BREAK)
            got = [w for words, starts in phrases.cut(text) for w in windows(words, len(words) if starts is None else starts)]
            all_words = phrases.tokens(text.translate(phrases.FOLD))
            assert whole(got) == whole(windows(all_words, len(all_words)))


def test_growth_agrees_wherever_parts_are_cut():
    rng = random.Random(9)
    pointers = sorted({"".join(rng.choice("ab") + " " for _ in range(rng.randint(2, 5))): rng.randint(1, 9) for _ in range(70)}.items())
    rows = [(lang, p, n) for lang in ("x", "y") for p, n in pointers]
    want = Counter()
    for lang, p, n in rows:
        words = p.split()
        want.update({(lang, " ".join(words[:m])): n for m in range(2, len(words) + 1)})
    for _ in range(50):
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), rng.randint(0, 5))), len(rows)]
        got = Counter()
        for a, b in zip(cuts, cuts[1:]):
            batches = [pa.record_batch({"lang": [r[0] for r in rows[i:j]], "phrase": [r[1] for r in rows[i:j]], "n": [r[2] for r in rows[i:j]]}) for i, j in ((a, (a + b) // 2), ((a + b) // 2, b)) if i < j]
            for piece in phrases.grown(iter(batches), 20):
                for r in piece.to_pylist():
                    got[r["lang"], r["phrase"]] += r["n"]
        assert {k: v for k, v in got.items() if v >= 20} == {k: v for k, v in want.items() if v >= 20}


def test_pointers_are_as_few_as_the_phrases(spark, monkeypatch):
    """Every pair is frequent, no triple is: a task hands on each pair once, not each window of five words."""
    rng, made = random.Random(10), {}
    rows = [("en", " ".join(rng.choice("abcdefghijkl") for _ in range(200))) for _ in range(100)]
    real = phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df, name, *more: made.setdefault(name, real(df, name, *more)))
    assert told(phrases.collocations(frame(spark, rows), 60, 500)) == brute(rows, 60, 500)
    assert 12 * 12 <= made["phrases-pointers"].count() <= 3 * 12 * 12  # of three tasks


def test_sums_are_the_same_however_few_are_held():
    rng = random.Random(11)
    rows = [(rng.choice("xy"), rng.choice("abcdefgh"), rng.randint(1, 9)) for _ in range(300)]
    want = Counter()
    for lang, p, n in rows:
        want[lang, p] += n
    batches = [pa.record_batch(dict(zip(("lang", "phrase", "n"), map(list, zip(*rows[i : i + 7]))))) for i in range(0, len(rows), 7)]
    for most in (1, 5, 12, 17, 1000):
        told = [(r["lang"], r["phrase"], r["n"]) for piece in phrases.summed(iter(batches), ["lang", "phrase"], most) for r in piece.to_pylist()]
        got = Counter()
        for lang, p, n in told:
            got[lang, p] += n
        assert got == want
        assert len(told) == len(want) or most <= len(want)
    assert list(phrases.summed(iter([]), ["lang", "phrase"], 5)) == []


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, [("en", "a")]).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [("en", "a b"), (None, None)])).count() == 0
