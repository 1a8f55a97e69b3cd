"""URL filter over a sorted digest array.

Rules are strings ``host/path`` that allow or block a host, all its subdomains and every path that starts with
theirs. The list is compiled into one file: the sorted 64-bit xxhash keys of the rules, followed by what a key
stands for. Workers memory-map it, so all workers of a machine share one copy. A batch of urls is turned into
candidate keys (each suffix of the host with each prefix of the path that is as long as some rule's path), all
probed at once by vectorised binary search; every hit is then compared with the stored full string, so a
collision of keys cannot decide. The longest fitting rule in characters wins, of equal ones the last in UTF-8 order. Urls that no rule fits get the default verdict.

The file goes to every machine, so its size is checked against ``MOST_BYTES``. A longer list is filtered by
``judge_large``, which joins the candidates with the rules instead.

Edge cases: null urls and urls without ``://`` have an empty host and path, fit no rule and get the default.
Rules given twice count once; if one is both allowed and blocked, it blocks. An empty list judges by the default
alone, and empty tables give no rows. Urls are read whole. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifuse.llm.shared import A_Z, a_z

MOST_BYTES = 256 << 20
DEFAULT = "allow"
ENTRY = np.dtype([("key", "<u8"), ("start", "<u8"), ("length", "<u4"), ("block", "<u4")])
#: The base rules of the query.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """After the first ``://`` up to ``/ ? #``, lower-cased A-Z; then up to ``? #``. Both empty without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), parts, 1), A_Z, a_z)
    return host, F.regexp_extract(F.coalesce(url, F.lit("")), parts, 2)


def compile_rules(rules, path: str) -> str:
    """Write the sorted digest array of (rule, verdict) pairs; returns the path."""
    verdicts: dict[str, bool] = {}
    for rule, verdict in rules:
        verdicts[rule] = verdicts.get(rule, False) or verdict == "block"
    strings = [r.encode() for r in verdicts]
    starts = np.cumsum([0, *map(len, strings)])
    table = np.zeros(len(strings), ENTRY)
    for i, (raw, block) in enumerate(zip(strings, verdicts.values())):
        table[i] = (xxhash.xxh64_intdigest(raw), starts[i], len(raw), block)
    table.sort(order=["key", "start"])
    lengths = sorted({len(r.partition("/")[2]) + 1 for r in verdicts if "/" in r} | ({0} if any("/" not in r for r in verdicts) else set()))
    with open(path, "wb") as out:
        out.write(np.array([len(table), len(lengths), *lengths], "<u8").tobytes())
        out.write(table.tobytes())
        out.writelines(strings)
    return path


class Digests:
    """A memory-mapped digest array."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = raw[:16].view("<u8").tolist()
        self.lengths = raw[16 : 16 + 8 * m].view("<u8").tolist()
        at = 16 + 8 * m
        self.table = raw[at : at + n * ENTRY.itemsize].view(ENTRY)
        self.keys, self.strings = self.table["key"], raw[at + n * ENTRY.itemsize :]

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """For each candidate the row of its entry, or -1."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(keys), -1)
        while len(hits := np.flatnonzero((found < 0) & (at < len(self.keys)))):
            hits = hits[self.keys[at[hits]] == keys[hits]]
            if not len(hits):
                break
            for i in hits.tolist():
                entry = self.table[at[i]]
                start = int(entry["start"])
                if self.strings[start : start + int(entry["length"])].tobytes() == candidates[i]:
                    found[i] = at[i]
            left = hits[found[hits] < 0]  # an equal key with another string: try the next entry
            at[left] += 1
            at[np.setdiff1d(np.arange(len(at)), left)] = len(self.keys)
        return found


def candidates_of(host: str, path: str, lengths: list[int]) -> list[str]:
    labels = host.split(".")
    starts = [path[:n] for n in lengths if n <= len(path)]
    return [".".join(labels[i:]) + p for i in range(len(labels)) for p in starts] if host else []


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of (page_id, url)."""
    spark = pages.sparkSession
    listed = sorted(set(rules))
    if sum(len(r) + ENTRY.itemsize for r, _ in listed) > MOST_BYTES:
        raise ValueError("the list is over MOST_BYTES; use judge_large")
    name = f"urls-{hashlib.sha256(repr(listed).encode()).hexdigest()[:16]}.bin"
    context = spark.sparkContext
    if name not in (sent := vars(context).setdefault("_evifuse_lists", set())):  # a list is sent once
        context.addFile(compile_rules(listed, os.path.join(os.path.realpath(tempfile.mkdtemp()), name)))
        sent.add(name)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            owned, candidates = [], []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                mine = candidates_of(host, path, digests.lengths)
                owned += [i] * len(mine)
                candidates += mine
            best: dict[int, tuple[int, bytes, int]] = {}
            raws = [c.encode() for c in candidates]
            found = digests.find(raws)
            for j in np.flatnonzero(found >= 0).tolist():
                hit = (len(candidates[j]), raws[j], int(digests.table[found[j]]["block"]))
                best[owned[j]] = max(best.get(owned[j], hit), hit)
            fits = [best.get(i) for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array([f and f[1].decode() for f in fits], pa.string()),
                    pa.array([default if f is None else "block" if f[2] else "allow" for f in fits], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(F.col("url"))
    schema = "page_id long, host string, path string, rule string, verdict string"
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(task, schema)


def judge_large(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """As ``judge``, for a table (rule, verdict) of any size: candidates are joined by their strings."""
    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = rules.groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("block"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    slash = F.locate("/", F.col("rule"))
    lengths = [r.n for r in listed.select(F.when(slash > 0, F.length("rule") - slash + 1).otherwise(0).alias("n")).distinct().orderBy("n").collect()]  # no more than the longest rule has characters
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    starts = F.transform(fitting, lambda n: F.substring("path", F.lit(1), n))
    wanted = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    named = parted.where("host <> ''").select("page_id", F.explode(F.array_distinct(wanted)).alias("rule"))
    best = named.join(listed, "rule").groupBy("page_id").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "block")).alias("best"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block"), "block").otherwise("allow")
    return parted.join(best, "page_id", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
