"""The synchronizer as a stream: bounded buffers per rig, one row for each reference observation and other stream.

State is the last ``BUFFER`` observations of each stream of a rig, so it is bounded. A micro-batch is sorted by
arrival; an observation older than its stream's last one in the same domain is told as a reject and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evifuse.operators.sync import Policy

BUFFER = 32
OUT = "ref long, rig long, stream string, seq long, skew_ns long, effective_ns long, state string"
HELD = "streams array<string>, seqs array<long>, times array<long>, uncs array<long>, domains array<string>"


def label(delta: int, pair: int | None, policy: Policy) -> str:
    if pair is None:
        return "unsynchronized"
    worst = abs(delta) + pair
    if worst > policy.stale:
        return "missing"
    return "exact" if worst <= policy.exact else "late" if delta < 0 else "future" if delta > 0 else "bounded_skew"


def select(held: list[tuple], ref: tuple, stream: str, policy: Policy) -> tuple:
    """Partner of the reference in one stream: cheapest by gap and uncertainties, the first arrival on ties."""
    mine = [o for o in held if o[0] == stream]
    if not mine:
        return None, None, None, "missing"
    same = [o for o in mine if o[4] == ref[4] and o[2] is not None]
    if not same:
        return None, None, None, "unknown" if any(o[4] == ref[4] for o in mine) else "incompatible_clock_domain"
    pair = lambda o: None if o[3] is None or ref[3] is None else o[3] + ref[3]
    best = min(same, key=lambda o: (abs(o[2] - ref[2]) + (policy.stale + 1 if pair(o) is None else pair(o)), o[1]))
    delta, unc = best[2] - ref[2], pair(best)
    return best[1], delta, None if unc is None else abs(delta) + unc, label(delta, unc, policy)


def synchronize(observations: DataFrame, reference: str, streams: list[str], policy: Policy) -> DataFrame:
    """Rows of a stream (rig, seq, stream, t, unc, domain) as selections, see ``OUT``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(o) for o in zip(*state.get)] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            value = lambda x: None if x is None or x != x else int(x)
            seen = (r.stream, int(r.seq), value(r.t), value(r.unc), r.domain)
            last = [o[2] for o in held if o[0] == r.stream and o[4] == r.domain and o[2] is not None]
            if seen[2] is not None and last and last[-1] > seen[2]:
                out.append((seen[1], key[0], r.stream, seen[1], None, None, "rejected_out_of_order"))
                continue
            held.append(seen)
            mine = [i for i, o in enumerate(held) if o[0] == r.stream]
            if len(mine) > BUFFER:
                del held[mine[0]]
            if r.stream == reference and seen[2] is not None:
                out += [(seen[1], key[0], s, *select(held, seen, s, policy)) for s in streams if s != reference]
        state.update(tuple(list(c) for c in zip(*held)) if held else ([], [], [], [], []))
        names = [c.split()[0] for c in OUT.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"seq": "Int64", "skew_ns": "Int64", "effective_ns": "Int64"})

    keyed = observations.select("rig", "seq", "stream", "t", "unc", "domain").groupBy("rig")
    return keyed.applyInPandasWithState(step, OUT, HELD, "append", GroupStateTimeout.NoTimeout)
