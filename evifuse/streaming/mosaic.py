"""Frames accepted into maps as they arrive.

What a frame's own samples decide is found without state; the state of a mission is the frames and classes it has accepted. A refused frame
leaves the state as it was. A micro-batch is taken in the order of arrival, seq; what waits for its turn is twenty bytes a frame, beside the distinct names and
class sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evifuse.operators import gates, grid

OUT = "mission long, seq long, frame string, reject_reason string"
HELD = "frames array<string>, classes array<long>"
#: Frames of a mission that are handed on at once.
CHUNK = 10_000


def stepping(settings: grid.Settings):
    """Judges a mission's frames of a micro-batch by what the state holds."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, classes = (set(x) for x in state.get) if state.exists else (set(), set())
        seqs, codes, known = [], [], [{}, {}, {}]  # a frame is its number and three codes while it waits for its turn
        for b in batches:
            seqs.append(np.array(b["seq"], np.int64))
            values = b["frame"], map(tuple, b["classes"]), zip(b["before"], b["after"])
            codes.append(np.array([[of.setdefault(v, len(of)) for v in column] for of, column in zip(known, values)], np.int32))
        seq, code = np.concatenate(seqs), np.concatenate(codes, 1)
        names, held, failed = (list(of) for of in known)
        sets = [frozenset(map(int, c)) for c in held]
        order = np.argsort(seq, kind="stable")
        for start in range(0, len(order), CHUNK):
            at, out = order[start : start + CHUNK], []
            for s, frame, own, gate in zip(seq[at].tolist(), *code[:, at].tolist()):
                (before, after), own = failed[gate], sets[own]
                refused = settings.refusal(len(classes | own)) if own else None
                reason = before or ("duplicate_frame_id" if names[frame] in frames else None) or after or refused
                if reason is None:
                    frames.add(names[frame])
                    classes |= own
                out.append((key[0], s, names[frame], reason))
            if start + CHUNK >= len(order):
                state.update((sorted(frames), sorted(classes)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return step


def accepted(summaries: DataFrame, settings: grid.Settings) -> DataFrame:
    """Reasons of a stream of ``grid.summaries`` rows, null for accepted ones."""
    rows = grid.checked(summaries, settings)
    rows = gates.first_failure(gates.first_failure(rows, gates.GRID[: grid.NEW], "before"), gates.GRID[grid.NEW + 1 :], "after")
    narrow = rows.select("mission", "seq", F.col("frame").cast("string").alias("frame"), "classes", "before", "after")
    return narrow.groupBy("mission").applyInPandasWithState(stepping(settings), OUT, HELD, "append", GroupStateTimeout.NoTimeout)
