"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed word vector and the mean of its hashed character-trigram vectors. Overlapping windows
of ``WINDOW`` words, ``STRIDE`` apart, cover every text; each runs through one gated recurrent layer in either
direction, attention pools the states, and a linear unit gives the window's logit. A text's logit is its
highest window's, as one passage is enough; it is shifted so that training texts kept aside are parted best.

Training takes a bounded sample of labelled rows, ``SAMPLE`` of each class with the smallest hashed ids, and
never a held-out row. Of equal texts in it one is used. In the first epochs all windows carry their text's label; later only the highest of
a toxic text does, against all windows of clean ones, of which each text's ``HARD`` highest count once more. The trained weights have a fixed
size (about 5 MB) and are broadcast.

Edge cases: a null or empty text is a window of padding alone and gets the score of that. Texts are scored
whole. Repeated rows get equal scores. Where a class has no labelled row every score is 0.02. Of labels given
twice the higher counts. Empty tables give no rows. Inputs of a score are texts alone;
``score`` leaves other columns out, ``keep_clean`` passes them on.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.llm.shared import raw_texts

SAMPLE, WINDOW, STRIDE = 1500, 32, 16
WORD_ROWS, GRAM_ROWS, PART, HIDDEN = 1 << 16, 1 << 14, 8, 8
EPOCHS, BATCH, RATE, SEED = 5, 256, 0.01, 7
#: A clean text's windows that look most toxic, which count once more in later epochs.
HARD = 3
#: Words a task remembers; windows that run together.
MEMORY, TOGETHER = 200_000, 2048
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def words_of(raw: bytes | None) -> list[bytes]:
    return WORDS.findall(raw.lower()) if raw else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word; rows of all trigrams of ``<word>``; where each word's trigrams start."""
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16)
    inside = np.ones(len(codes), bool)
    ends = begins[1:]
    inside[ends - 1] = False
    inside[ends - 2] = False
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(begins, sizes)[: len(codes)].astype(np.uint64)
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    starts = np.concatenate([[0], np.cumsum(sizes - 2)[:-1]]).astype(np.int64)
    placed = (mixed + place * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    rows = np.add.reduceat((placed ^ placed >> np.uint64(32))[inside], starts)
    return (rows >> np.uint64(20)) % np.uint64(WORD_ROWS), (mixed[inside] >> np.uint64(13)) % np.uint64(GRAM_ROWS), starts


class Words(dict):
    """Word to its number from 1 on; 0 is padding. ``fresh`` are those without a vector yet."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        self.fresh.append(word)
        return number


def windows_of(numbers: list[int]) -> np.ndarray:
    """All overlapping windows of a text, padded with 0."""
    count = max(1, -(-(len(numbers) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((count - 1) * STRIDE + WINDOW, np.int32)
    padded[: len(numbers)] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def new_weights() -> dict[str, np.ndarray]:
    draw = np.random.default_rng(SEED)
    normal = lambda scale, *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
    d, h = 2 * PART, HIDDEN
    return {
        "word": normal(0.05, WORD_ROWS, PART), "gram": normal(0.3, GRAM_ROWS, PART), "in": normal(0.4, d, 6 * h), "in_bias": np.zeros(6 * h, np.float32),
        "re0": normal(0.3, h, 3 * h), "re1": normal(0.3, h, 3 * h), "attend": normal(0.5, 2 * h), "out": normal(0.5, 2 * h), "bias": np.zeros(1, np.float32),
    }


def vectors(weights: dict, words: list[bytes]) -> np.ndarray:
    rows, grams, starts = hashed(words)
    sums = np.add.reduceat(weights["gram"][grams], starts)
    counts = np.diff(np.append(starts, len(grams)))[:, None]
    return np.hstack([weights["word"][rows], sums / counts]).astype(np.float32)


def forward(weights: dict, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. projected: (windows, WINDOW, 6 * HIDDEN), both directions' inputs; mask: 1 for words."""
    n, steps, h = len(projected), WINDOW, HIDDEN
    states = np.empty((n, steps, 2 * h), np.float32)
    caches = []
    for side, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
        own, u = projected[:, :, side * 3 * h : (side + 1) * 3 * h], weights[f"re{side}"]
        state, cache = np.zeros((n, h), np.float32), []
        for t in order:
            x, lent = own[:, t], state @ u
            gates = sigmoid(x[:, : 2 * h] + lent[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            fresh = np.tanh(x[:, 2 * h :] + r * lent[:, 2 * h :])
            m = mask[:, t : t + 1]
            after = state + m * (1 - z) * (fresh - state)
            if keep:
                cache.append((t, state, z, r, fresh, lent[:, 2 * h :]))
            state = after
            states[:, t, side * h : (side + 1) * h] = state
        caches.append(cache)
    drawn = states @ weights["attend"] + (mask - 1) * 30
    share = np.exp(drawn - drawn.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", share, states)
    logits = pooled @ weights["out"] + weights["bias"][0]
    return (logits, states, caches, share, pooled) if keep else logits


def backward(weights: dict, projected: np.ndarray, mask: np.ndarray, kept, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of ``projected`` for the logits' gradient ``slope``."""
    _, states, caches, share, pooled = kept
    h, grads = HIDDEN, {"out": slope @ pooled, "bias": np.array([slope.sum()], np.float32)}
    d_pooled = slope[:, None] * weights["out"]
    d_share = np.einsum("nh,nth->nt", d_pooled, states)
    d_drawn = share * (d_share - (share * d_share).sum(1, keepdims=True))
    grads["attend"] = np.einsum("nt,nth->h", d_drawn, states)
    d_states = share[:, :, None] * d_pooled[:, None] + d_drawn[:, :, None] * weights["attend"]
    d_projected = np.zeros_like(projected)
    for side, cache in enumerate(caches):
        u, d_u = weights[f"re{side}"], np.zeros_like(weights[f"re{side}"])
        d_next = np.zeros((len(slope), h), np.float32)
        for t, state, z, r, fresh, lent in reversed(cache):
            d_after = d_next + d_states[:, t, side * h : (side + 1) * h]
            m = mask[:, t : t + 1]
            d_fresh = d_after * m * (1 - z) * (1 - fresh * fresh)
            d_z = -d_after * m * (fresh - state) * z * (1 - z)
            d_r = d_fresh * lent * r * (1 - r)
            d_x = np.hstack([d_z, d_r, d_fresh])
            d_lent = np.hstack([d_z, d_r, d_fresh * r])
            d_u += state.T @ d_lent
            d_next = d_after * (1 - m * (1 - z)) + d_lent @ u.T
            d_projected[:, t, side * 3 * h : (side + 1) * 3 * h] = d_x
        grads[f"re{side}"] = d_u
    return grads, d_projected


def summed(index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each index; every index up to the largest occurs."""
    order = np.argsort(index, kind="stable")
    return np.add.reduceat(rows[order], np.searchsorted(index[order], np.arange(index[order[-1]] + 1)))


def train(texts: list[tuple[bytes | None, int]]) -> dict[str, np.ndarray]:
    """Weights from labelled texts, equal ones with equal labels once; every fifth text is kept aside for the shift."""
    weights = new_weights()
    words = Words()
    texts = list(dict.fromkeys(texts))  # copies of one text would teach its accidental words
    tokens = [windows_of([words[w] for w in words_of(raw)]) for raw, _ in texts]
    labels = np.array([y for _, y in texts])
    if len(set(labels.tolist())) < 2:
        return {k: v * 0 for k, v in weights.items()} | {"scale": np.array([0.0, np.log(0.02 / 0.98)])}
    rows, grams, starts = hashed([b" ", *words])  # the first stands for padding
    sizes = np.diff(np.append(starts, len(grams)))
    aside = np.arange(len(texts)) % 5 == 4
    draw = np.random.default_rng(SEED)
    small = [k for k in weights if k not in ("word", "gram")]
    first, second, step = {k: 0 for k in small}, {k: 0 for k in small}, 0
    spent = {k: np.full(len(weights[k]), 1e-3, np.float32) for k in ("word", "gram")}

    def inputs(index: np.ndarray):
        used, inverse = np.unique(index, return_inverse=True)
        mine = np.concatenate([np.arange(starts[u], starts[u] + sizes[u]) for u in used.tolist()])
        begins = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
        x = np.hstack([weights["word"][rows[used]], np.add.reduceat(weights["gram"][grams[mine]], begins) / sizes[used][:, None]]).astype(np.float32)
        return used, inverse.reshape(index.shape), grams[mine], x

    def logits_of(chosen) -> list[np.ndarray]:
        every = np.concatenate([tokens[i] for i in chosen])
        out = []
        for i in range(0, len(every), TOGETHER):
            index = every[i : i + TOGETHER]
            _, inverse, _, x = inputs(index)
            out.append(forward(weights, (x @ weights["in"] + weights["in_bias"])[inverse], (index > 0).astype(np.float32)))
        return np.split(np.concatenate(out), np.cumsum([len(tokens[i]) for i in chosen])[:-1])

    toxic, clean = np.flatnonzero((labels == 1) & ~aside), np.flatnonzero((labels == 0) & ~aside)
    for epoch in range(EPOCHS):
        if epoch < 2:
            positive = np.concatenate([tokens[i] for i in toxic])
        else:
            positive = np.stack([tokens[i][int(np.argmax(s))] for i, s in zip(toxic, logits_of(toxic))])
        negative = [tokens[i] for i in clean]
        if epoch >= 2:  # and once more the windows of clean texts that look most toxic
            negative += [tokens[i][np.argsort(s)[-HARD:]] for i, s in zip(clean, logits_of(clean))]
        negative = np.concatenate([*negative, np.zeros((16, WINDOW), np.int32)])  # a text without words is clean
        index = np.concatenate([positive, negative])
        truth = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))]).astype(np.float32)
        weight = np.where(truth == 1, 0.5 / len(positive), 0.5 / len(negative)).astype(np.float32) * len(truth)
        order = draw.permutation(len(truth))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            mask = (index[at] > 0).astype(np.float32)
            used, inverse, own, x = inputs(index[at])
            projected = (x @ weights["in"] + weights["in_bias"])[inverse]
            kept = forward(weights, projected, mask, keep=True)
            slope = (weight[at] * (sigmoid(kept[0]) - truth[at]) / len(at)).astype(np.float32)
            grads, d_projected = backward(weights, projected, mask, kept, slope)
            flat = summed(inverse.ravel(), d_projected.reshape(-1, d_projected.shape[2]))
            grads["in"], grads["in_bias"] = x.T @ flat, flat.sum(0)
            d_x = flat @ weights["in"].T
            step += 1
            for k in small:
                g = grads[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            for k, where, g in (("word", rows[used], d_x[:, :PART]), ("gram", own, np.repeat(d_x[:, PART:] / sizes[used][:, None], sizes[used], axis=0))):
                where, inner = np.unique(where, return_inverse=True)
                total = summed(inner, g)
                spent[k][where] += (total * total).mean(1)
                weights[k][where] -= 0.1 * total / np.sqrt(spent[k][where])[:, None]
    # shift: between the classes' highest windows, where the kept-aside texts are parted best
    chosen = np.flatnonzero(aside) if len(set(labels[aside].tolist())) == 2 else np.arange(len(texts))
    top = np.array([s.max() for s in logits_of(chosen)])
    cuts = np.unique(np.quantile(top, np.linspace(0, 1, 200)))
    right = [((top >= c) == (labels[chosen] == 1)) for c in cuts]
    fit = np.array([0.5 * r[labels[chosen] == 1].mean() + 0.5 * r[labels[chosen] == 0].mean() for r in right])
    cut = float(np.median(cuts[fit >= fit.max() - 1e-9]))
    return weights | {"scale": np.array([1.0, -cut])}


class Scorer:
    """Scores texts with trained weights; remembers words' projected inputs."""

    def __init__(self, weights: dict):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.words, self.table, self.size = Words(), np.zeros((4096, 6 * HIDDEN), np.float32), 1

    def learn(self) -> None:
        fresh, self.words.fresh = self.words.fresh, []
        if not fresh:
            return
        need = self.size + len(fresh)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, len(self.table)), 6 * HIDDEN), np.float32)])[: max(need, 2 * len(self.table))]
        self.table[self.size : need] = vectors(self.weights, fresh) @ self.weights["in"] + self.weights["in_bias"]
        self.size = need

    def scores(self, raws: list[bytes | None]) -> np.ndarray:
        """The score of each text, from all of its windows."""
        logits = np.full(len(raws), -np.inf, np.float32)
        held, owners, count = [], [], 0
        for i, raw in enumerate(raws):
            found = windows_of(list(map(self.words.__getitem__, words_of(raw))))
            held.append(found)
            owners.append(np.full(len(found), i))
            count += len(found)
            if count >= TOGETHER or i == len(raws) - 1:
                self.learn()
                self.run(np.concatenate(held), np.concatenate(owners), logits)
                held, owners, count = [], [], 0
                if len(self.words) > MEMORY:
                    self.clear()
        scale = self.weights["scale"]
        return sigmoid(scale[0] * logits.astype(np.float64) + scale[1])

    def run(self, index: np.ndarray, owner: np.ndarray, logits: np.ndarray) -> None:
        for i in range(0, len(index), TOGETHER):
            part = index[i : i + TOGETHER]
            np.maximum.at(logits, owner[i : i + TOGETHER], forward(self.weights, self.table[part], (part > 0).astype(np.float32)))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, raw, toxic: at most ``size`` labelled texts of each class that are not held out, those with the smallest hashed ids.

    A row is an id and a text: repeated rows count once, each text of a repeated id by itself.
    """
    truth = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL").where(~held_out())
    digest = F.xxhash64("text").alias("digest")
    present = docs.select("doc_id", digest).distinct().join(truth, "doc_id")
    picked = [present.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(size) for y in (1, 0)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * size rows at most
    rows = docs.select("doc_id", digest, "text").join(few, ["doc_id", "digest"])
    once = rows.groupBy("doc_id", "digest").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # copies of a row are merged where they are read
    return once.select("doc_id", F.encode("text", "UTF-8").alias("raw"), F.col("toxic").cast("long").alias("toxic"))


def ordered(rows: list[tuple]) -> list[tuple[bytes | None, int]]:
    """(raw, toxic) of (doc_id, raw, toxic) in a mixed order that does not depend on where the rows came from."""
    rows = sorted(rows, key=lambda r: (r[0] * 2654435761 % 2**32, r[0], r[1] or b""))
    return [(raw or None, y) for _, raw, y in rows]


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights trained in one task on the bounded sample; only they come to the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "toxic")))]
        weights = train(ordered(rows))
        yield pa.record_batch({"weights": [pickle.dumps(weights)]})

    # a shuffle to one partition, so that reading stays parallel
    found = sample(docs, labels, size).repartition(1).mapInArrow(task, "weights binary").collect()
    return pickle.loads(bytes(found[0].weights)) if found else train([])


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of (doc_id, text)."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, size))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights.value)
        for batch in batches:
            scores = scorer.scores(raw_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(task, SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns, filtered where they are scored."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, size))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(raw_texts(batch)) < 0.5))

    return docs.mapInArrow(task, docs.schema)
