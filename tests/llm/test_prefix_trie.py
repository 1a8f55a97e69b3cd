"""The trie of conversations against brute force."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

from evifuse.llm import prefix_trie

CHAT = "conv_id long, turn long, role string, text string, depth long, owner string, ends string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "o", "e") for r in rows], CHAT).repartition(3)


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    nodes = defaultdict(list)
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        root = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(root, [])[:h] + turns[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            nodes[rebuilt[c][:d]].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if rebuilt[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=repr)


def test_trie_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "é", "a", "ab"])) for c in [*range(60), 97, 250, -3, -5, -12, 5001, 10**12] for t in range(rng.randint(1, 12))]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (7, 3, "user", "twice"), (7, 3, "a", "twice"), (None, 1, "user", "x"), (None, None, None, None)]
    rows += [(c, t, "user", "all the same") for c in range(300, 340) for t in range(4)]
    rows += [(400 + c, t, "user", "all the same") for c in range(0, 50, 5) for t in range(2)]
    assert told(prefix_trie.trie(frame(spark, rows))) == brute(rows)


def test_conversation_over_several_blocks(spark, monkeypatch):
    """Running sums go on from block to block; blocks of four turns here."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    rng = random.Random(12)
    rows = [(c, t * 3 - 7, "user", rng.choice(["a", "b"])) for c in range(12) for t in range(rng.choice([1, 5, 40]))]
    assert told(prefix_trie.trie(frame(spark, rows))) == brute(rows)


def test_ids_in_several_texts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(c, 0, "user", "hello") for c in [*range(-20, 100), 10**9, 10**9 + 1, 10**15]]
    assert told(prefix_trie.trie(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie.trie(frame(spark, [(1, 1, "u", "x")]).limit(0)).count() == 0
    assert prefix_trie.trie(frame(spark, [(None, 1, "u", "x")])).count() == 0


def test_conversations_without_turns_end_in_the_root(spark):
    """Only turns of a conversation that shares more than it has: the root is a leaf."""
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    assert told(prefix_trie.trie(frame(spark, [(c, 0, "u", "x")]))) == [(c, 0, None, 1, 0, 1, 0, sha256(str(c).encode()).hexdigest())]
