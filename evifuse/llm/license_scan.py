"""Licence scan by a positional index of rare words.

Templates are short licence texts and notices, cut to words. Their inverted index holds (template, position)
postings. A word's weight is its inverse document frequency over all scanned files. Of each template the two words
of its first key phrase with the highest weights are looked up; each occurrence votes, through its postings, for a
(template, place) pair, the place being the file position less the template position. Around a place that both
agree on, and where the phrase stands, every place within the slack is verified: every mandatory key phrase of the
template must stand there, within a few words of where it belongs. No other place can be, so what is found does not
depend on what else a file holds. The score is the share of the template's weight found in order at the place.

The frequencies are gathered for the words of the templates only, a fixed set of a few hundred, so what is
broadcast is bounded by the template list and not by the files.

Edge cases: a null or empty text has no words, no places, empty labels and score 0. Texts are read whole.
Of equal scores the template that sorts first is reported first; labels are distinct and sorted. An empty
table gives no rows. Other columns of the input are left out, so clashing names do no harm.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.llm.shared import raw_texts

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence notices; label, notice text, mandatory key phrases.
TEMPLATES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("apache-notice", "licensed under the apache license version 2 0", ("licensed under the apache license", "version 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-notice", "use of this source code is governed by a bsd style license that can be found in the license file", ("bsd style license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0", ("waived all copyright",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", ("licensed under the gnu general public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mit-notice", "released under the mit license", ("under the mit license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Words of a template's key phrase that are looked up, words of slack around a place, share of a template's weight that a match needs.
RARE_WORDS, SLACK, LEAST = 2, 3, 0.7

#: Words of lower-cased UTF-8: ASCII digits and letters, and all bytes beyond ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates string"


def want(template: list[bytes], key: list[bytes]) -> int:
    """Where the template has the key phrase."""
    return next(i for i in range(len(template)) if template[i : i + len(key)] == key)


class Index:
    """Templates, their postings and weights, for one worker."""

    def __init__(self, templates, weights: dict[bytes, float]):
        self.templates = [(label, text.encode().split(), [p.encode().split() for p in keys]) for label, text, keys in templates]
        self.weights = weights
        self.postings = defaultdict(list)
        self.needed = []
        for t, (_, words, keys) in enumerate(self.templates):
            rare = self.rare(words, keys)
            self.needed.append(len(rare) if keys else 1)
            for i in rare:
                self.postings[words[i]].append((t, i))
        self.total = [sum(weights[w] for w in words) for _, words, _ in self.templates]

    def rare(self, words: list[bytes], keys: list[list[bytes]]) -> list[int]:
        """Positions that vote: the rarest of the first key phrase; without one, those of which every match holds one."""
        first = want(words, keys[0]) if keys else 0
        order = sorted(range(first, first + len(keys[0])) if keys else range(len(words)), key=lambda i: (-self.weights[words[i]], words[i], i))
        if keys:
            return order[:RARE_WORDS]
        left, total = sum(self.weights[w] for w in words), sum(self.weights[w] for w in words)
        for n, i in enumerate(order):
            if left < LEAST * total:
                return order[:n]
            left -= self.weights[words[i]]
        return order

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Template label to its best score in the file."""
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for p, word in enumerate(words):
            if word in self.postings:
                for t, i in self.postings[word]:
                    votes[t, p - i] += 1
        places = set()
        for (t, place), n in votes.items():
            _, template, keys = self.templates[t]
            if n < self.needed[t]:
                continue
            if keys:
                at = place + want(template, keys[0])
                if at < 0 or words[at : at + len(keys[0])] != keys[0]:
                    continue
            places.update((t, place + d) for d in range(-SLACK, SLACK + 1))
        found: dict[str, float] = {}
        for t, place in places:
            label, template, keys = self.templates[t]
            if not all(self.stands(words, place, template, key) for key in keys):
                continue
            got = sum(self.weights[w] for i, w in enumerate(template) if w in words[max(0, place + i - SLACK) : max(0, place + i + SLACK + 1)])
            score = got / self.total[t]
            if score >= LEAST and score > found.get(label, 0):
                found[label] = score
        return found

    @staticmethod
    def stands(words: list[bytes], place: int, template: list[bytes], key: list[bytes]) -> bool:
        """The key phrase stands where the template has it, give or take the slack."""
        at = place + want(template, key)
        return any(words[p : p + len(key)] == key for p in range(max(0, at - SLACK), at + SLACK + 1))


def base_places(words: list[bytes], phrases: list[tuple[list[bytes], str]], first: set[bytes]) -> tuple[list[int], set[str]]:
    places, labels = [], set()
    if not first.isdisjoint(words):
        for phrase, label in phrases:
            head, at = phrase[0], -1
            while True:
                try:
                    at = words.index(head, at + 1)
                except ValueError:
                    break
                if words[at : at + len(phrase)] == phrase:
                    places.append(at)
                    labels.add(label)
    return places, labels


def words_of(raw: bytes | None) -> list[bytes]:
    """``bytes.lower`` lowers A-Z alone."""
    return WORDS.findall(raw.lower()) if raw else []


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Over all files: how many hold each template word, and how many files there are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, defaultdict(int)
        for batch in batches:
            for raw in raw_texts(batch):
                n += 1
                for word in vocabulary.intersection(words_of(raw)):
                    counts[word] += 1
        yield pa.record_batch({"word": ["", *(w.decode() for w in counts)], "n": pa.array([n, *counts.values()], pa.int64())})

    rows = docs.select("text").mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word.encode(): r.n for r in rows}  # one row for each template word at most
    return counts, counts.pop(b"", 0)


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row for each file of (doc_id, text): see ``SCHEMA``; ``templates`` lists label:score."""
    vocabulary = {w for _, text, _ in templates for w in text.encode().split()}
    counts, n = document_frequencies(docs, vocabulary)
    weights = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 0.01 for w in vocabulary}
    base = [(p.encode().split(), label) for p, label in phrases.items()]
    first = {p[0] for p, _ in base}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, weights)
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                words = words_of(raw)
                places, labels = base_places(words, base, first)
                found = index.matches(words)
                every = labels | {label.removesuffix("-notice") for label in found}
                rows.append(
                    (
                        doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)),
                        min(1.0, max([*found.values(), 0.5 if labels else 0.0])), ",".join(f"{k}:{v:.3f}" for k, v in sorted(found.items())),
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(TYPES), TYPES)], NAMES)

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in SCHEMA.split(", ")]
