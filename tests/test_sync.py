"""The nearest partner against a search, and the states of absent ones."""

import datetime
import random

import duckdb
import numpy as np

from evifuse.operators import raster, sync
from evifuse.plans.sync import QUERIES

OBS = "seq long, rig long, stream string, t long, unc long, domain string"


def searched(rows, policy):
    out = {}
    names = sorted({r[2] for r in rows if r[2] != "ref"})
    for seq, rig, stream, t, unc, domain in rows:
        if stream != "ref" or t is None:
            continue
        for name in names:
            mine = [r for r in rows if r[1] == rig and r[2] == name]
            same = [r for r in mine if r[5] is not None and r[5] == domain]
            near = [r for r in same if r[3] is not None and abs(r[3] - t) <= policy.stale]
            cost = lambda r: (abs(r[3] - t) + (policy.stale + 1 if r[4] is None or unc is None else r[4] + unc), r[0])  # noqa: B023, E731
            best = min(near, key=cost, default=None)
            state = "missing" if not mine or any(r[3] is not None for r in same) else "unknown" if same else "incompatible_clock_domain"
            if best:
                pair = None if best[4] is None or unc is None else best[4] + unc
                delta = best[3] - t
                worst = None if pair is None else abs(delta) + pair
                state = "unsynchronized" if pair is None else "missing" if worst > policy.stale else "exact" if worst <= policy.exact else "late" if delta < 0 else "future" if delta > 0 else "bounded_skew"
            out[seq, name] = (best and best[0], best and best[3] - t, best and (None if best[4] is None or unc is None else abs(best[3] - t) + best[4] + unc), state)
    return out


def test_nearest_equals_a_search(spark):
    rng = random.Random(3)
    policy = sync.Policy(exact=2, fusion=20, stale=30)
    rows = [(i, rng.randint(0, 4), rng.choice(["ref", "a", "a", "b"]), rng.choice([None, *range(-90, 400, 1)]) if i % 9 else 60, rng.choice([None, 0, 1, 5, 40]),
        rng.choice(["p", "p", "p", "q", None])) for i in range(700)]
    rows += [(900, 7, "ref", 5, 1, "p"), (901, 7, "a", 5, 1, "q"), (902, 7, "b", None, 1, "p"), (903, 8, "ref", 5, None, "p"), (904, 8, "a", 5, 0, "p"), (905, 8, "b",
        400, 0, "p"), (906, 9, "ref", 0, 0, None)]
    got = {(r.ref, r.stream): (r.seq, r.skew_ns, r.effective_ns, r.state) for r in sync.nearest(spark.createDataFrame(rows, OBS).repartition(4), "ref", policy).collect()}
    want = searched(rows, policy)
    assert got == want and {s for *_, s in want.values()} >= {"missing", "unknown", "incompatible_clock_domain", "unsynchronized", "exact", "late", "future", "bounded_skew"}


def test_blur_over_mirrored_borders(spark):
    rng = np.random.default_rng(1)
    for h, w, radius in ((7, 5, 2), (4, 9, 3), (5, 5, 4)):
        image = rng.random((h, w))
        rows = spark.createDataFrame([(1, y, x, float(image[y, x])) for y in range(h) for x in range(w)], "frame long, y int, x int, v double")
        wide = np.pad(image, radius, mode="reflect")
        want = {(y, x): wide[y : y + 2 * radius + 1, x : x + 2 * radius + 1].mean() for y in range(h) for x in range(w)}
        got = {(r.y, r.x): r.v for r in raster.box_blur(rows, h, w, radius).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_resets_do_not_depend_on_the_order_of_rows(spark):
    """Observations that arrive at once come by their times, so none of them went back on another."""
    rows = [(seq, 1, "a", t) for seq, t in ((1, 50), (1, 20), (1, 40), (2, 30), (2, 60), (3, 10))]
    for held in (rows, rows[::-1]):
        df = spark.createDataFrame(held, "seq long, rig long, stream string, t long").coalesce(1)
        got = sorted((r.seq, r.t, r.before) for r in sync.went_back(df, ["rig", "stream"]).collect())
        assert got == [(2, 30, 50), (3, 10, 60)]


def test_resets_of_odd_events_equal_the_sql(spark, tmp_path):
    """Unnumbered events come last, as in the SQL; those without a time, user or type and negative numbers occur too."""
    at = lambda s: None if s is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, 50, 1, "a"), (2, 40, 1, "a"), (None, 45, 1, "a"), (3, None, 1, "a"), (4, 30, 1, "a"), (-5, 60, 1, "a"), (None, 10, 2, "a"), (1, 20, 2, "a"), (7, 20, None, "a"), (8, 10, None, "a"),
        (7, 20, 3, None), (8, 10, 3, None), (200_011, 5, 1, "a"), (9, -(10**9), 4, "b"), (10, -2 * 10**9, 4, "b")]
    events = spark.createDataFrame([(n, at(t), u, kind, 1.0, "{}") for n, t, u, kind in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    run, sql = QUERIES["boot_reset_detect"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, run(spark, str(tmp_path)).select("seq", "rig", "stream", "back_ns").collect())))
    want = sorted(map(repr, con.execute(f"SELECT seq, rig, stream, back_ns FROM ({sql})").fetchall()))
    assert got == want and any(r.startswith("(None, 2") for r in got)
