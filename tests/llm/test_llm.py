"""The training-data operators against brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from evifuse.llm import bpe, chat, fingerprint, jaccard_join, license_scan, packing, quality, shared, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, score double, kept boolean, id long, n long"


def docs_of(spark, texts):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1.0, True, 5, 6) for i, t in enumerate(texts)], DOCS).repartition(3)


def rows_of(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: (r[key] is None, r[key]))


ODD = [None, "", " \n\t ", "one", "One", "x" * 5000, "日本 é ü", "a b", "A\u00a0b c", "same text here now", "same text here now"]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(words, rng, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(n))


# -- op1 -----------------------------------------------------------------------------------------------------
def brute_license(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    return len(found), places


def test_license_scan(spark, words):
    rng = random.Random(1)
    texts = [*ODD, "Released under the MIT License.", "MIT license MIT License mit LICENSE", "MIT\nLicense; GNU General Public-License", "the mit, and license"]
    texts += [f"{prose(words, rng, 60)} {license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)][1].upper() if i % 2 else license_scan.TEMPLATES[i % 17][1]} {prose(words, rng, 60)}" for i in range(34)]
    texts += [prose(words, rng, 80) for _ in range(30)]
    for row, text in zip(rows_of(license_scan.scan(docs_of(spark, texts))), texts):
        n, places = brute_license(text)
        starts = [i for i, _ in places]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        base = sorted({label for _, label in places})
        assert row["base_labels"] == ",".join(base) and set(base) <= set(row["labels"].split(",")) | {""} and 0 <= row["score"] <= 1
        clean = "license" not in (text or "").lower() and not any(t[1] in (text or "").lower() for t in license_scan.TEMPLATES)
        assert not clean or row["labels"] == ""
    for i, row in enumerate(rows_of(license_scan.scan(docs_of(spark, texts)))[len(ODD) + 4 : len(ODD) + 38]):
        template = license_scan.TEMPLATES[i % 17 if not i % 2 else i % len(license_scan.TEMPLATES)]
        assert template[0].removesuffix("-notice") in row["labels"].split(",")


def test_licenses_are_found_whatever_else_the_file_holds(spark, words):
    """All notices one after another, and each in a very long text that holds every licence word by chance."""
    rng = random.Random(21)
    notices = [t[1] for t in license_scan.TEMPLATES]
    every = sorted({w for t in notices for w in t.split()})
    long = [" ".join(rng.choice(every if i % 9 == 0 else words) for i in range(20_000)) for _ in notices]
    gap = f" {prose(words, rng, 30)} "
    texts = [*notices, gap.join(notices), *(f"{text} {notice} {text}" for notice, text in zip(notices, long))]
    rows = rows_of(license_scan.scan(docs_of(spark, texts)))
    scores = [dict(x.split(":") for x in r["templates"].split(",")) for r in rows]
    alone, n = scores[: len(notices)], len(notices)
    for i, (label, _, _) in enumerate(license_scan.TEMPLATES):
        assert alone[i][label] == scores[n][label] == scores[n + 1 + i][label] == "1.000"


def test_license_places_equal_those_of_all_positions():
    """Against verification at every position, on texts with words put in, left out and moved."""
    rng = random.Random(22)
    weights = {w: rng.uniform(0.01, 9) for _, text, _ in license_scan.TEMPLATES for w in text.encode().split()}
    index = license_scan.Index((*license_scan.TEMPLATES, ("keyless", "seven plain words without any key phrase", ())), weights | {w: 1.0 for w in b"seven plain words without any key phrase".split()})
    for _ in range(150):
        words = []
        for _, text, _ in rng.sample(license_scan.TEMPLATES, 3) + [("", "seven plain words without any key phrase", ())]:
            for w in text.encode().split():
                words += rng.choice([[w]] * 30 + [[], [w, b"zz"], [b"zz"]])
            words += [b"the", b"license"] * rng.randint(0, 3)
        want = {}
        for t, (label, template, keys) in enumerate(index.templates):
            for place in range(-len(template) - 4, len(words) + 4):
                if all(index.stands(words, place, template, key) for key in keys):
                    got = sum(index.weights[w] for i, w in enumerate(template) if w in words[max(0, place + i - 3) : max(0, place + i + 4)]) / index.total[t]
                    if got >= license_scan.LEAST:
                        want[label] = max(want.get(label, 0), got)
        assert index.matches(words) == want


# -- op2 -----------------------------------------------------------------------------------------------------
CHAT = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", " ", "\n", "ok", "é", "[", "]", "<", ">", "/", "$1", "s"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<s>", "a\\", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])) for c in range(150) for t in range(rng.randint(1, 5))]
    rows += [(900, 0, "user", "x"), (900, 0, "user", "x"), (901, 5, "assistant", "</s> [INST] \\</s>"), (902, 0, "user", " [/INST]<s>x [INST] y"), (903, 0, "assistant", "\\<s>")]
    df = spark.createDataFrame(rows, CHAT).withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert set(got) == {r[0] for r in rows}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for c, r in got.items():
        turns = sorted((t, role or "", text or "") for cc, t, role, text in rows if cc == c)
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    made = chat.render(df).collect()
    holds = lambda r: any(m in (t.text + t.role) for t in r.turns for m in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert {holds(r) for r in made} == {True, False} and all(r.escaped == holds(r) for r in made)
    for r in chat.read_back(chat.render(df).select("conv_id", "formatted")).collect():
        at, taken = 0, []
        for run in r.loss_runs:
            taken.append(r.formatted[at + run.skip : at + run.skip + run.take])
            at += run.skip + run.take + run.rest
        assert at == len(r.formatted) and re.sub(r"(?<!\\)\\(\\*)(<s>|</s>|\[INST\]|\[/INST\])", r"\1\2", "\0".join(taken)).replace("\0", "") == r.loss
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "user", "a")]
    got = sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in chat.digests(spark.createDataFrame(rows, CHAT)).collect())
    assert got == [(0, 1, 0), (0, 1, 1), (3, 1, 0)]


def test_chat_is_linear_in_long_texts(spark):
    """A million backslashes, many unclosed marks and many turns take seconds."""
    import time

    n = 1_000_000
    rows = [(1, 0, "user", "\\" * n), (1, 1, "assistant", "\\" * n + "<s>"), (2, 0, "user", "x [/INST]" + "<s>" * (n // 4)), (3, 0, "assistant", "</s> " * (n // 5))] + [(4, t, "assistant", "<s>ok") for t in range(5000)]
    began = time.time()
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, CHAT)).collect()}
    assert time.time() - began < 60
    assert got[1].loss_chars == n + 3 and got[3].loss_chars == n and got[4].n_turns == 5000 and got[4].loss_chars == 25000
    assert got[1].formatted_chars == 2 * n + 3 + 1 + 4 + 9 + 16 + 19 and got[2].n_turns == 1


# -- op3 -----------------------------------------------------------------------------------------------------
def brute_components(texts, size, similar):
    sets, parent = {}, {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a):
            shared_ = len(sets[a] & sets[b])
            if shared_ and 100 * shared_ >= similar * (len(sets[a]) + len(sets[b]) - shared_):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(len(sets[i]), root(i)) for i in sets]


@pytest.mark.parametrize(("size", "similar"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, words, size, similar):
    rng = random.Random(3)
    texts, base = list(ODD), [prose(words, rng, n) for n in (30, 80, 200)]
    passage = prose(words, rng, 60)
    for text in base:  # a drifting chain and a crowd of near copies
        parts = text.split(" ")
        for i in range(25):
            edited = list(parts)
            edited[rng.randrange(len(edited))] = f"z{rng.randrange(6)}"
            parts = edited if i % 3 == 0 else parts
            texts.append(" ".join(edited))
    texts += [f"{prose(words, rng, 25)} {passage} {prose(words, rng, 25)}" for _ in range(40)]
    got = [(r["n_shingles"], r["component_id"]) for r in rows_of(jaccard_join.join(docs_of(spark, texts), size, similar))]
    assert got == brute_components(texts, size, similar)


def test_one_row_of_each_component_stays(spark, words):
    rng = random.Random(31)
    base = prose(words, rng, 120)
    texts = [*ODD, base, base + " more", prose(words, rng, 50), base]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.where("doc_id IN (0, 3, 12)"))
    groups = brute_components(texts, 3, 90)
    kept = jaccard_join.firsts(docs, 3, 90)
    assert kept.columns == docs.columns
    assert [(r["doc_id"], r["text"]) for r in rows_of(kept)] == [(i, t) for i, t in enumerate(texts) if groups[i][1] == i]


def test_null_ids_with_texts_of_their_own_keep_a_row(spark):
    docs = docs_of(spark, ["a b c d", "e f g h"]).unionByName(docs_of(spark, ["a b c d", "only here it is", "only here it is", "x y z", ""]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = [tuple(r) for r in jaccard_join.join(docs).collect()]
    assert sorted(rows, key=str) == sorted([(0, 2, 0), (1, 2, 1), (None, 2, 0), (None, 2, None), (None, 2, None), (None, 1, None), (None, 0, None)], key=str)


def test_rows_without_an_id_never_stand_for_document_0(spark, words):
    rng = random.Random(32)
    text, other = prose(words, rng, 80), prose(words, rng, 80)
    docs = docs_of(spark, [text, text, other]).unionByName(docs_of(spark, [text, other, prose(words, rng, 9)]).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs_of(spark, [prose(words, rng, 70)]).withColumn("doc_id", F.lit(2).cast("long")))
    kept = rows_of(jaccard_join.firsts(docs, 3, 90))
    assert [r["doc_id"] for r in kept] == [0, 2, 2, None, None, None] and len({r["text"] for r in kept if r["doc_id"] == 2}) == 2


def test_few_links_go_to_few_files(spark, monkeypatch):
    """However many parts the shuffle has; where links are many, they go to several."""
    files, write = [], jaccard_join.materialize

    def counted(df, name):
        made = write(df, name)
        files.append(len(made.inputFiles()))
        return made

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100 + i, 200) for i in range(30)] + [(7, 7), (0, 1)], "x long, y long")
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 100}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = counted(jaccard_join.components(links), "components")
        assert dict(map(tuple, found.collect())) == want and found.count() == len(want) and set(files) == {1}
        files.clear()
        monkeypatch.setattr(jaccard_join, "EACH", 50)
        found = counted(jaccard_join.components(links), "components")
        assert dict(map(tuple, found.collect())) == want and found.count() == len(want) and min(files) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_merging_skips_and_loses_nothing():
    """Against plain counting; skipping reads fewer postings than the lists hold."""
    rng = random.Random(33)

    class Read(list):
        looked = 0

        def __getitem__(self, i):
            Read.looked += 1
            return list.__getitem__(self, i)

    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 30))) for _ in range(rng.randint(0, 12))]
        least = rng.randint(1, 6)
        want = [(d, n) for d in range(60) if (n := sum(d in rows for rows in lists)) >= least]
        assert list(jaccard_join.merge_skip(lists, least)) == want
    lists = [Read(range(i, 100_000, 7)) for i in (6, 0)] + [Read([50_000]), Read([50_000])]
    assert list(jaccard_join.merge_skip(lists, 3)) == [(50_000, 3)] and Read.looked < 2000


def test_division_and_probes(spark, monkeypatch):
    """Short lists hold T - L first common shingles of linked sets; long lists alone can rule a pair out."""
    rng = np.random.default_rng(34)
    weights = rng.integers(0, 14, 1 << jaccard_join.SKETCH_BITS).astype(np.uint8)
    divide, probed = jaccard_join.Divide(weights, 90), []
    original = jaccard_join.held
    monkeypatch.setattr(jaccard_join, "held", lambda lists, postings: probed.append(len(lists)) or original(lists, postings))
    for n in (1, 2, 9, 10, 60, 400, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for share in (0.02, 0.05, 0.08, 0.4):
            b = np.unique(np.concatenate([a[rng.random(len(a)) >= share / 2], rng.integers(0, 2**63, int(n * share / 2)).astype(np.uint64)]))
            if not len(b):
                continue
            few, many = sorted((a, b), key=len)
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 90 * (len(a) + len(b) - both)
            probed.clear()
            assert jaccard_join.links(few, many, divide) == linked
            short = divide.short(len(few))
            assert probed in ([len(few) - short], [len(few) - short, short])
            reach = min(divide.reach(len(a)), divide.reach(len(b)))
            met = len(np.intersect1d(divide.parted(a)[0], divide.parted(b)[0]))
            assert 1 <= reach and (not linked or met >= reach)
    sizes = list(range(1, 3000, 7))
    assert [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n int").coalesce(1).select(divide.reach_of(F.col("n"))).collect()] == [divide.reach(n) for n in sizes]
    assert divide.reach(3000) > 3 and divide.short(3000) < 400


def test_hot_lists_are_parted(spark, words, monkeypatch):
    """One shingle in half of the documents, as all that short texts hold and inside longer ones; lists of over 4 postings are parted."""
    monkeypatch.setattr(jaccard_join, "PART", 4)
    monkeypatch.setattr(jaccard_join, "weights_of", lambda counters: np.where(counters > 4, np.log2(np.maximum(counters, 1)) + 1, 0).astype(np.uint8))
    rng = random.Random(35)
    passage, base = prose(words, rng, 30).replace("\n", " "), prose(words, rng, 60).split()
    texts = [f"{passage} {w}" for w in words[:30]] + [f"{w} {passage} {v}" for w, v in zip(words[30:60], words[60:90])]
    texts += [" ".join(base[:i] + [rng.choice(words)] + base[i + 1 :]) for i in range(2, 58)] + ["hot words here"] * 20 + [prose(words, rng, 30) for _ in range(60)]
    rng.shuffle(texts)
    for size, similar in ((3, 90), (5, 80)):
        got = [(r["n_shingles"], r["component_id"]) for r in rows_of(jaccard_join.join(docs_of(spark, texts), size, similar))]
        assert got == brute_components(texts, size, similar)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 5, 70, 300, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, n // 9 + 1).astype(np.uint64)]))
        bits = [jaccard_join.parities(x, max(64, 1 << max(len(x) - 1, 0).bit_length())) for x in (a, b)]
        assert jaccard_join.least_difference(*bits) <= len(np.setxor1d(a, b))


# -- op4 -----------------------------------------------------------------------------------------------------
def test_packing(spark, words):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [*ODD, prose(words, rng, 3000), "  x  \n\n 's 're" * 20] + [prose(words, rng, rng.randint(1, 400)) for _ in range(150)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs_of(spark, texts), path, public_tokenizers.PATTERN, 512, 508).collect()
    pieces, room = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 512 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(room) <= 1.03 * -(-sum(r.length for r in rows) // 512) + 1
    assert packing.pack(docs_of(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_packing_finds_added_tokens(spark):
    from tokenizers import Tokenizer

    end, path = "<|endoftext|>", public_tokenizers.path("byte_bpe_50k.json")
    texts = [end, end * 3, f"a{end}b", f"one {end} two  {end}\n{end}", f"wo{end}rd's  {end}", end[:-1], f"<{end}>", end.upper(), f"  {end}  ", f"é{end}日本 " * 200, f"{end[:7]}{end}{end[7:]}"]
    rows = packing.pack(docs_of(spark, texts), path, public_tokenizers.PATTERN, 64, 60).collect()
    tokenizer = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own]
        assert sum(r.length for r in own) == len(ids) and (50256 in ids) == (end in text)


@pytest.mark.parametrize("share", [50_000, 1500])
def test_packing_of_tables_sorted_by_length(spark, monkeypatch, share):
    """Underfull bins of all partitions meet, however many there are: as few sequences as one global best-fit makes."""
    monkeypatch.setattr(packing, "CARRY", 100)
    monkeypatch.setattr(packing, "SHARE", share, raising=False)
    sizes = [35] * 5500 + [28] * 5400 + [40, 50] * 20
    docs = spark.createDataFrame([(i, " the" * (n - 1)) for i, n in enumerate(sizes)], "doc_id long, text string").coalesce(1).repartitionByRange(3, "doc_id")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 64, 64).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    best = packing.best_fit([(n, [{"doc_id": i, "piece": 0}]) for i, n in enumerate(sizes)], 64)
    assert max(fills.values()) <= 64 and len(fills) <= 1.01 * len(best)
    if share >= len(sizes):
        assert len(fills) == len(best)
    low, high = sorted(fills.values())[:2]
    assert low + high > 64


# -- op5 -----------------------------------------------------------------------------------------------------
def test_gradients_are_those_of_the_loss():
    weights = {k: v.astype(np.float64) for k, v in toxicity.new_weights().items()}
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3, toxicity.WINDOW, 6 * toxicity.HIDDEN)) * 0.5
    mask = np.ones((3, toxicity.WINDOW))
    mask[1, 20:] = 0
    slope = rng.standard_normal(3)
    grads, d_x = toxicity.backward(weights, x, mask, toxicity.forward(weights, x, mask, keep=True), slope)
    loss = lambda: float(slope @ toxicity.forward(weights, x, mask))
    for array, grad in ((weights["re0"], grads["re0"]), (weights["re1"], grads["re1"]), (weights["attend"], grads["attend"]), (weights["out"], grads["out"]), (x, d_x)):
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in array.shape)
            kept, step = array[at], 1e-3
            array[at] = kept + step
            high = loss()
            array[at] = kept - step
            low = loss()
            array[at] = kept
            assert (high - low) / (2 * step) == pytest.approx(grad[at], abs=2e-3, rel=2e-2)


def test_toxicity_on_held_out_rows(spark, words):
    rng = random.Random(6)
    texts, truth = [], []
    for i in range(500):
        tokens = prose(words, rng, rng.randint(20, 120)).split(" ")
        truth.append(int(i % 3 == 0))
        for _ in range(3 * truth[-1]):
            tokens.insert(rng.randrange(len(tokens)), rng.choice(["zoxgrub", "zoxgrubbed", "vilkrat"]))
        texts.append(" ".join(tokens))
    texts += ODD
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(truth)], "doc_id long, quality int, toxic int")
    rows = rows_of(toxicity.score(docs_of(spark, texts), labels))
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] < 500]
    assert np.mean([p == y for p, y in held]) > 0.9
    assert {r["predicted"] for r in rows[500:503]} == {0}
    kept = {r.doc_id for r in toxicity.keep_clean(docs_of(spark, texts), labels).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}
    assert all(r["score"] == pytest.approx(0.02) for r in rows_of(toxicity.score(docs_of(spark, ODD), labels.limit(0))))


def test_training_drops_equal_texts_alone():
    """Texts that share their least words but differ all teach, with their own labels; very long ones are read whole."""
    seen = []
    original = toxicity.windows_of
    toxicity.windows_of = lambda numbers: seen.append(len(numbers)) or original(numbers)
    try:
        toxicity.train([(b"same words here", 0), (b"same words here", 0), (b"same words here too", 1), (b"same words here", 1), (b"a b " * 400, 0)])
    finally:
        toxicity.windows_of = original
    assert sorted(seen) == [3, 3, 4, 800]
    index, rows = np.array([1, 0, 1, 2]), np.array([[1.0], [2.0], [3.0], [4.0]])
    assert toxicity.summed(index, rows).tolist() == [[2.0], [4.0], [4.0]]


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        windows = toxicity.windows_of(list(range(1, n + 1)))
        assert set(windows.ravel().tolist()) - {0} == set(range(1, n + 1)) and windows.shape[1] == toxicity.WINDOW


# -- op6 -----------------------------------------------------------------------------------------------------
def brute_quality(text):
    words_, text = re.findall(r"[^\x20\x09-\x0D]+", text or ""), text or ""
    windows = [tuple(words_[i : i + 3]) for i in range(len(words_) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(words_), sum(map(len, words_)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, words):
    rng = random.Random(7)
    texts = [*ODD, "a b c a b c a b c", "a a a a a", "x\nx\n \n\nx\ny", "a b c d a b c d b c d", "\x0b#*$%&|<>\x0c" * 3]
    texts += [prose(words[:12], rng, rng.randint(3, 90)) for _ in range(40)] + [prose(words, rng, 80) for _ in range(400)] + [" ".join(f"{w}%%%" for w in prose(words, rng, 60).split(" ")) for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i < len(texts) - 60), 0) for i in range(len(ODD) + 45, len(texts))], "doc_id long, quality int, toxic int")
    # a few hundred labels can prove no less than 0.05
    rows = rows_of(quality.judge(docs_of(spark, texts), labels, 0.05))
    kept = sorted(r.doc_id for r in quality.keep(docs_of(spark, texts), labels, 0.05).collect())
    for r, text in zip(rows, texts):
        counts = brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts, text
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["kept"] and r["base_failed"])
    assert kept == [r["doc_id"] for r in rows if r["kept"]]
    assert not any(r["kept"] for r in rows[-60:]) and np.mean([r["kept"] for r in rows[-460:-60]]) > 0.95
    assert all(r["kept"] == (not r["base_failed"]) for r in rows_of(quality.judge(docs_of(spark, texts), labels.limit(0))))


def test_quality_cutoffs_equal_those_of_sql(spark, words):
    """Where labels prove cutoffs in some strata and not in others; audited labels select nothing and measure the false rejections."""
    import duckdb

    rng = random.Random(71)
    texts = [" ".join(w + ("!" if i % 4 == 0 and rng.random() < 0.3 else "%%" if i % 7 == 0 and rng.random() < 0.5 else "") for w in prose(words, rng, 70).split()) for i in range(1500)]
    langs = [rng.choice(["en", "en", "en", "en", "de", "de", "de", "", "", "fr", None, None]) for _ in texts]
    quality_of = [int(i % 4 != 0 and i % 7 != 0 or rng.random() < 0.01) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality_of)], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    for name, df in (("documents", docs.toPandas()), ("labels", labels.toPandas())):
        con.register(name, df)
    for risk in (0.05, 0.08):
        got = quality.judge(docs, labels, risk)
        told = con.execute(quality.sql(risk))
        want = [dict(zip([c[0] for c in told.description], row)) for row in told.fetchall()]
        rows = rows_of(got)
        assert rows == [{k: r[k] for k in rows[0]} for r in sorted(want, key=lambda r: r["doc_id"])]
        chosen = {(r.stratum, r.measure): r.cutoff for r in quality.thresholds(quality.measures_of(docs), labels, risk).collect()}
        assert ("=en", "bang_rate") in chosen and (risk > 0.05 or "=fr" in {s for s, _ in chosen})  # a language with labels enough, one in the pool
    held = {i for i, q in enumerate(quality_of) if q and hashlib.md5(str(i).encode()).hexdigest()[0] in "012"}
    failed = {r["doc_id"] for r in rows if r["base_failed"]}
    kept = {r["doc_id"] for r in rows if r["kept"]}
    for r in quality.audit(docs, labels, 0.08).collect():
        own = {i for i in held - failed if langs[i] == r.lang}
        assert (r.n, r.rejected) == (len(own), len(own - kept)) and r.rate == r.rejected / r.n <= 0.2


def test_binomial_tail_is_exact(spark):
    from math import comb

    for n, k, p in ((10, 0, 0.1), (50, 3, 0.05), (200, 10, 0.1)):
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


# -- op7 -----------------------------------------------------------------------------------------------------
def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/en/1", "x://com/en/", "http://xcom/en/", "http://example.com/en/7?x", "http://example.com/en/8", "http://a.example.net/de/8#z", "http://net/de/1", "a://b://c/d", "http://org/es", "http://m.org/es/x", "http://b.org?/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for rules in (url_filter.RULES, (), (("com/en/", "allow"), ("com/en/", "block"), ("a.com/e", "allow"))):
        want = []
        for i, u in enumerate(urls):
            rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
            host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
            fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
            rule = max(fits, key=len, default=None)
            verdict = url_filter.DEFAULT if rule is None else "block" if any(v == "block" for r, v in rules if r == rule) else "allow"
            want.append((i, host, path, rule, verdict))
        for _ in range(2):  # the list is there already the second time
            assert [tuple(r.values()) for r in rows_of(url_filter.judge(pages, rules), "page_id")] == want
        if rules:
            large = url_filter.judge_large(pages, spark.createDataFrame(list(rules), "rule string, verdict string"))
            assert [tuple(r.values()) for r in rows_of(large, "page_id")] == want


def test_equal_keys_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda raw: len(raw))
    digests = url_filter.Digests(url_filter.compile_rules([("aa/", "block"), ("bb/", "allow"), ("cc/", "block")], str(tmp_path / "x")))
    found = digests.find([b"bb/", b"dd/", b"cc/", b"a"])
    assert [int(f) >= 0 for f in found] == [True, False, True, False] and len(set(found[[0, 2]])) == 2


# -- op8 -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("leaf", [7, 4096])
def test_bpe_equals_tiktoken(monkeypatch, leaf):
    import tiktoken

    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(8)
    for alphabet in ("ab '", "aeiourstln", "  \n\t'sreldvmé0 9!?", "a", "'s", " \n", "日本語 а́б", "<|endoftext|> "):
        for n in (0, 1, 5, 40, 300, 2500):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = ours.encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
            assert ours.decode(ids) == text.encode()


def test_bpe_queries(spark):
    rows = rows_of(bpe.round_trip(docs_of(spark, ODD), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    assert [r["decoded_sha256"] for r in rows] == [hashlib.sha256((t or "").encode()).hexdigest() for t in ODD]
    both = bpe.decode(bpe.encode(docs_of(spark, ODD), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [bytes(r["decoded"]).decode() for r in rows_of(both)] == [t or "" for t in ODD]


# -- op9 -----------------------------------------------------------------------------------------------------
def brute_anchors(text):
    """(hash, place) of every closed syncmer, by looking at each k-mer alone."""

    def chain(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v, h)
        return h

    long = lambda h: h.to_bytes(8, "little")
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    s, k, out = fingerprint.SMER, fingerprint.KMER, []
    smers = [chain(text[i : i + s].encode()) for i in range(len(text) - s + 1)]
    for i in range(len(text) - k + 1):
        own = [signed(h) for h in smers[i : i + k - s + 1]]
        if own.index(min(own)) in (0, k - s):
            out.append((chain(*(long(h) for h in smers[i : i + k - s + 1 : s])) >> 32, i))
    return out or ([(chain(text.encode()) >> 32, 0)] if text else [])


def brute_likeness(a, b):
    if a == b:
        return 1.0
    same = len(set(a) & set(b))
    rest = [[v for v in x if v not in y] for x, y in ((a, b), (b, a))]
    merged = sorted((h - 2**32 if h >= 2**31 else h, p, side) for side, v in enumerate(rest) for h, p in v)
    bands = [0] * same + [(p - q if s == 0 else q - p) // fingerprint.BAND for (h, p, s), (g, q, t) in zip(merged, merged[1:]) if h == g and s != t]
    best = min(max((bands.count(x) + bands.count(x - 1) for x in bands), default=0), same + len(rest[0]), same + len(rest[1]))
    return best / (len(a) + len(b) - best) if best else 0.0


@pytest.mark.parametrize("block", [7, 4096])
def test_fingerprints(spark, words, monkeypatch, block):
    monkeypatch.setattr(fingerprint, "BLOCK", block)
    rng = random.Random(9)
    texts = [*ODD, *(prose(words, rng, rng.randint(5, 200)) for _ in range(40)), "日本語の文章は空白なしで続く" * 9, "ab" * 300, "\U0001f600 smile " * 30, prose(words, rng, 900)]
    clean = [t or "" for t in texts]
    for i, r in enumerate(rows_of(fingerprint.compare_with_edit(docs_of(spark, texts)))):
        text, after = clean[i], clean[(i + 1) % len(clean)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, n = map(brute_anchors, (text, edited, after))
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{h:08x}{p:08x}" for h, p in a) and r["edited_fingerprint"] == "".join(f"{h:08x}{p:08x}" for h, p in e)
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(brute_likeness(a, e)), pytest.approx(brute_likeness(a, n)))
    assert fingerprint.compare_with_edit(docs_of(spark, [])).count() == 0
    assert fingerprint.compare_with_edit(docs_of(spark, ["a b"])).first().near_next == 1.0


def test_likeness_goes_by_place(spark, words):
    """Short texts, scripts without spaces and small edits stay alike; moved and repeated passages do not count in full."""
    rng = random.Random(19)
    parts = [prose(words, rng, 120) for _ in range(4)]
    japanese = "".join(rng.choice("あいうえおかきくけこ日月火水木金土") for _ in range(105))
    seven = "seven quite ordinary words stand here alone"
    cases = [(" ".join(parts), " ".join(parts[::-1])), (" ".join(parts), " ".join([parts[0] + " one more", *parts[1:]])), (parts[0], " ".join([parts[0]] * 4)), (japanese, japanese[:60] + "犬" + japanese[60:]), (seven, seven + " now"), (parts[0], parts[1])]
    df = spark.createDataFrame(cases, "x string, y string")
    made = df.select(fingerprint.likeness(*(fingerprint.completed(fingerprint.chosen_in(F.col(c)), F.col(c)) for c in "xy")).alias("near"))
    moved, edited, repeated, script, short, other = [r.near for r in made.collect()]
    assert moved < 0.3 and edited > 0.9 and repeated < 0.5 and script > 0.4 and short > 0.3 and other < 0.05


# -- op10 ----------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(10)
    texts = [None, "", "a", "a", "WARC/1.1\r\n\r\n0\r\n\r\n", "é" * 9000, "x" * 200_000, "x" * 200_000, *("".join(rng.choice("ab\r\né0") for _ in range(rng.randint(0, 300))) for _ in range(40))]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i}\r\nX: y", t, "k") for i, t in enumerate(texts)], "page_id long, url string, html string, kind string").repartition(3)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    for r, t in zip(rows_of(warc.write_and_read(pages), "page_id"), texts):
        raw, origin = (t or "").encode(), first[t or ""]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), warc.base32_sha1(raw))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if origin == r["page_id"] else ("revisit", origin))
    path = warc.write(pages, f"{shared.shared_folder(spark)}/warc-test")
    records = warc.read_records(spark, path)
    assert records.where("kind = 'continuation'").count() > 3
    whole = {r.page_id: bytes(r.payload).decode() for r in warc.reassemble(records).where("kind = 'response'").collect()}
    assert whole == {i: t for t, i in first.items()}
    with pytest.raises(Exception, match="missing or of another length"):
        warc.reassemble(records.where("number <> 2")).collect()
    assert warc.write_and_read(pages.limit(0)).count() == 0

    # every row has its record: repeated ids with equal and other payloads, null ids with payloads of their own and of others
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "a"), (None, "c"), (None, "c"), (None, "d" * 70_000), (5, "e" * 70_000), (5, "e" * 70_000), (6, None), (7, "")]
    odd = spark.createDataFrame([(i, None, t, "k") for i, t in rows], pages.schema).repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.write_and_read(odd).collect()), key=str)
    want = [(1, 1, "response", None)] * 3 + [(2, 1, "revisit", 1), (None, 1, "revisit", 1), (None, 1, "response", None), (None, 1, "response", None), (None, 70_000, "response", None)]
    want += [(5, 70_000, "response", None)] * 2 + [(6, 0, "response", None), (7, 0, "revisit", 6)]
    assert got == sorted(want, key=str)
    ids = warc.read_records(spark, warc.write(odd, f"{shared.shared_folder(spark)}/warc-odd")).select("record_id").collect()
    assert len(ids) == len(set(ids)) == 12 + 2 * 3


def test_archives_are_read_as_streams(spark, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "UNPACK", 7)
    records = [warc.info(), *warc.records_of(3, "u", "x" * 40_000, False, None, True), *warc.records_of(4, "u", "y", True, 3, True)]
    raw = "".join(r + warc.END for r in records).encode()
    for form in (raw, gzip.compress(raw), b"".join(gzip.compress((r + warc.END).encode()) for r in records)):
        assert [(r[0], r[5], r[6]) for r in warc.parse(warc.unpacked(form))] == [("response", 3, None), ("continuation", 3, None), ("revisit", 4, 3)]
    for cut in (gzip.compress(raw)[:-30], raw[:-3], raw[:100]):
        with pytest.raises(ValueError, match="cut short"):
            list(warc.parse(warc.unpacked(cut)))


def test_null_ids_and_repeated_rows_do_no_harm(spark):
    docs = docs_of(spark, [*ODD, "a b c d e"] * 2).unionByName(docs_of(spark, ODD).withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    path, n = public_tokenizers.path("byte_bpe_50k.json"), docs.count()
    assert license_scan.scan(docs).count() == n
    assert jaccard_join.join(docs).count() == n
    assert packing.pack(docs, path, public_tokenizers.PATTERN).where("piece = 0").count() == n
    assert toxicity.score(docs, labels).count() == n and toxicity.keep_clean(docs, labels).count() <= n
    assert quality.judge(docs, labels).count() == n and quality.keep(docs, labels).count() <= n
    assert fingerprint.compare_with_edit(docs).count() == n and fingerprint.fingerprint(docs).count() == n
    assert bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == n
    empty = docs.limit(0)
    for made in (license_scan.scan(empty), jaccard_join.join(empty), jaccard_join.firsts(empty), toxicity.score(empty, labels), quality.judge(empty, labels), quality.keep(empty, labels)):
        assert made.count() == 0
