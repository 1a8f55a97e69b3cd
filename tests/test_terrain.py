"""Landings on a rough field against fine sampling, and probes against single landings."""

import duckdb
import numpy as np
import pytest

from evifuse.operators import terrain
from evifuse.plans.terrain import QUERIES

RAYS = "ray long, ox double, oy double, oz double, dx double, dy double, dz double, se double, sn double, su double, angle double"


def field(rows, columns, seed=1):
    rng = np.random.default_rng(seed)
    grid = np.cumsum(rng.normal(0, 0.2, (rows, columns)), 1) + 3 * np.sin(np.arange(rows) / 7)[:, None]
    grid[rng.random((rows, columns)) < 0.002] = np.nan
    return grid


def whole(surface, grid):
    n = surface.tile
    parts = [(r, c, np.ascontiguousarray(p).tobytes(), np.ascontiguousarray(p * 0 + 0.1).tobytes()) for r in range(-(-surface.rows // n)) for c in range(-(-surface.columns // n)) for p in [np.pad(grid, [(0, n), (0, n)], constant_values=np.nan)[r * n : r * n + n, c * n : c * n + n]]]
    return terrain.Window(surface, parts)


def test_landings_equal_fine_sampling():
    s = terrain.Surface(0.0, 60.0, 1.0, 60, 60, max_range=90.0, tolerance=1e-6, step=0.25, tile=16)
    window, rng = whole(s, field(60, 60)), np.random.default_rng(2)
    n = 300
    origin = np.stack([rng.uniform(5, 55, n), rng.uniform(5, 55, n), rng.uniform(18, 30, n)], 1)
    ray = np.stack([rng.normal(0, 0.6, n), rng.normal(0, 0.6, n), -np.ones(n)], 1)
    ray /= np.linalg.norm(ray, axis=1)[:, None]
    lowest = float(np.nanmin(window.height))
    reach = window.landings(origin, ray, lowest)
    t = np.arange(0, 90, 0.005)
    agree = 0
    for i in range(n):
        gap = window.gap(np.repeat(origin[i : i + 1], len(t), 0), np.repeat(ray[i : i + 1], len(t), 0), t)
        bad = np.flatnonzero(np.isnan(gap) | (gap <= 0))
        if not len(bad) or np.isnan(gap[bad[0]]):
            agree += bool(np.isnan(reach[i]) or abs(reach[i] - t[bad[0]]) < 0.3 if len(bad) else np.isnan(reach[i]))
        else:
            agree += bool(abs(reach[i] - t[bad[0]]) < 0.02)
    assert agree >= 0.99 * n and np.isfinite(reach).sum() > n / 2


@pytest.mark.parametrize("gap", [0.0, 5e-4])
def test_ridge_touched_between_two_samples(gap):
    """A ridge narrower than a step, just met or just missed."""
    s = terrain.Surface(0.0, 21.0, 1.0, 21, 41, min_down=0.05, max_range=60.0, tolerance=1e-4, step=0.7, tile=64)
    grid = np.zeros((21, 41))
    grid[:, 20] = 5.0 - gap  # the top, at east 20.5
    ray = np.array([[1.0, 0.0, -0.2]]) / np.linalg.norm([1.0, 0.0, -0.2])
    origin = np.array([[2.5, 10.0, 5.0 + 18 * 0.2]])
    east = (origin + whole(s, grid).landings(origin, ray, 0.0)[:, None] * ray)[0, 0]
    assert abs(east - (20.5 if gap == 0 else 27.5 + 18 - 0.0)) < 0.2 if gap == 0 else np.isnan(east) or east > 21


def test_sample_within_the_tolerance_is_no_landing_yet():
    """Where a sample is just above or below a plane, the landing is still where the ray passes it; beyond it the ground must be known."""
    s = terrain.Surface(0.0, 21.0, 1.0, 21, 41, max_range=60.0, tolerance=1e-3, step=1.0, tile=64)
    down = np.array([[0.6, 0.0, -0.8]])
    for off in (-9e-4, -1e-5, 0.0, 1e-5, 9e-4):  # of the landing from the tenth sample
        origin = np.array([[3.0, 10.0, 8.0 + 0.8 * off]])
        assert abs(whole(s, np.zeros((21, 41))).landings(origin, down, -5.0)[0] - (10 + off)) < 1e-9
    short = np.zeros((21, 41))
    short[:, 10:] = np.nan  # the eleventh sample is at east 9.6
    origin = np.array([[3.0, 10.0, 8.0 + 0.8 * 5e-4], [3.0, 10.0, 8.0 - 0.8 * 5e-4]])
    reach = whole(s, short).landings(origin, np.repeat(down, 2, 0), -5.0)
    assert np.isnan(reach[0]) and abs(reach[1] - 10 + 5e-4) < 1e-9


def test_projected_equals_one_window(spark):
    s = terrain.Surface(0.0, 60.0, 1.0, 60, 60, max_range=90.0, tolerance=1e-6, step=0.25, tile=16)
    grid, rng = field(60, 60, 5), np.random.default_rng(6)
    rays = [(i, float(rng.choice([12.0, 12.1, 40.0, 70.0])), float(rng.uniform(2, 58)), 25.0, float(rng.normal(0, 0.5)), float(rng.normal(0, 0.5)), -1.0, 0.2, None, 0.1,
        float(i % 3) * 0.01) for i in range(120)]
    rays += [(200, 5.0, 5.0, 20.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (201, None, 5.0, 20.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0), (202, 30.0, 30.0, 25.0, 0.0, 0.0, -2.0,
        0.0, 0.0, 0.0, 0.02), (203, 30.0, 30.0, 25.0, 1.0, 0.0, 0.1, 0.0, 0.0, 0.0, 0.0)]
    cells = spark.createDataFrame([(r, c, float(grid[r, c]), 0.1) for r in range(60) for c in range(60) if np.isfinite(grid[r, c])] + [(99, 0, 9.0, 0.1)],
        "row int, col int, height double, sigma double")
    terrain.RAYS, kept = 25, terrain.RAYS  # several tasks for one tile
    try:
        got = {r.ray: r for r in terrain.projected(spark.createDataFrame(rays, RAYS), terrain.tiles(cells, s), s).collect()}
    finally:
        terrain.RAYS = kept
    window = whole(s, grid)
    usable = [r for r in rays if r[0] not in (200, 201)]
    a = np.array([[0.0 if v is None else v for v in r[1:]] for r in usable])
    ray = a[:, 3:6] / np.linalg.norm(a[:, 3:6], axis=1)[:, None]
    lowest = float(np.nanmin(grid))
    reach = window.landings(a[:, :3], ray, lowest)
    probe = window.probes(a[:, :3], ray, reach, a[:, 6:9], a[:, 9], lowest)
    assert len(got) == len(rays) and got[200].reach is None and got[201].reach is None
    for r, t, p in zip(usable, reach, probe):
        row = got[r[0]]
        if np.isnan(t):
            assert row.reach is None and row.probe is None
        else:
            assert abs(row.reach - t) < 1e-9 and abs(row.ground_sigma - 0.1) < 1e-9 and (row.probe == p or abs(row.probe - p) < 1e-9)
    assert np.isinf(probe[~np.isnan(reach)]).any() and np.isfinite(probe).sum() > 30


def test_turning_keeps_lengths_and_angles():
    rng = np.random.default_rng(3)
    ray = rng.normal(size=(50, 3))
    ray /= np.linalg.norm(ray, axis=1)[:, None]
    axis = np.cross(ray, [0.3, 0.1, 0.9])
    axis /= np.linalg.norm(axis, axis=1)[:, None]
    angle = rng.uniform(-1, 1, 50)
    turned = terrain.turned_about(ray, axis, angle)
    assert np.allclose(np.linalg.norm(turned, axis=1), 1) and np.allclose((turned * ray).sum(1), np.cos(angle))


def test_no_field(spark):
    s = terrain.Surface(0.0, 60.0, 1.0, 60, 60, tile=16)
    none = terrain.tiles(spark.createDataFrame([], "row int, col int, height double, sigma double"), s)
    rays = spark.createDataFrame([(1, 5.0, 5.0, 20.0, 0.0, 0.0, -1.0, 0.1, 0.1, 0.1, 0.1)], RAYS)
    assert [(r.ray, r.reach, r.probe) for r in terrain.projected(rays, none, s).collect()] == [(1, None, None)]


def test_steep_rays_land_where_a_walk_lands(monkeypatch):
    """On a hilly field with holes, and on a plane with a few samples for each ray."""
    s = terrain.Surface(0.0, 60.0, 1.0, 60, 60, max_range=90.0, tolerance=1e-6, step=0.25, tile=16)
    rng = np.random.default_rng(8)
    n = 2000
    origin = np.stack([rng.uniform(-2, 62, n), rng.uniform(-2, 62, n), rng.uniform(-1, 30, n)], 1)
    ray = np.stack([rng.normal(0, 0.4, n), rng.normal(0, 0.4, n), -np.ones(n)], 1)
    ray /= np.linalg.norm(ray, axis=1)[:, None]
    y, x = np.mgrid[:60, :60]
    grid = 2 * np.sin(y / 5) + np.cos(x / 3) + 0.1 * x
    grid[rng.random((60, 60)) < 0.001] = np.nan
    for field_ in (grid, grid * 0 + 0.05 * x):
        window = whole(s, field_)
        got = window.landings(origin, ray, float(np.nanmin(field_)))
        end = np.minimum(90.0, (origin[:, 2] - np.nanmin(field_)) / -ray[:, 2])
        good = end >= 0
        want = np.full(n, np.nan)
        want[good] = window.walked(origin[good], ray[good], end[good], np.ceil(end[good] / s.stride).astype(np.int64))
        direct = window.fallen(origin[good], ray[good], end[good])
        assert (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want)) < 1e-11
        assert np.isfinite(direct).sum() > 0.5 * np.isfinite(want).sum() > 300
    plane, seen = whole(s, 1 + 0.05 * x + 0.02 * y), []
    inner = np.abs(origin[:, :2] - 30).max(1) < 15
    floor = np.floor
    monkeypatch.setattr(np, "floor", lambda a: seen.append(np.size(a)) or floor(a))
    plane.landings(origin[inner], ray[inner], 1.0)
    assert sum(seen) < 30 * inner.sum()


def test_small_shares_of_cells_count():
    """Near a line between centres a cell's share is tiny, but it counts if the cell is known."""
    s = terrain.Surface(0.0, 20.0, 1.0, 20, 20, tile=32)
    y, x = np.mgrid[:20, :20]
    grid = 1000 + 3.0 * x + 2.0 * y
    for off in (-5e-10, 5e-10):
        for east, north in ((7.5 + off, 7.3), (7.3, 7.5 + off), (7.5 + off, 7.5 + off), (7.5 + 1e-5, 7.5 - 1e-5)):
            got = whole(s, grid).sample(whole(s, grid).height, np.array([east]), np.array([north]))[0]
            assert abs(got - (1000 + 3 * (east - 0.5) + 2 * (20 - north - 0.5))) < 1e-10
    grid[12, 8] = np.nan
    window = whole(s, grid)
    at = window.sample(window.height, np.array([7.5, 7.5 + 5e-10, 7.5 + 5e-9]), np.array([7.5, 7.5, 7.5]))
    assert abs(at[0] - 1045) < 1e-9 and abs(at[1] - 1045) < 1e-8 and np.isnan(at[2])


def test_odd_orders_equal_the_sql(spark, tmp_path):
    """Keys that are absent, repeated, negative or large are rays too."""
    keys = [(None, 5), (None, None), (7, None), (-3, -4), (-64, 11), (9, 3), (9, 2), (10**12 + 1, 10**11 + 3), *((i, i * 37 % 1500) for i in range(20, 120))]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    run, sql = QUERIES["terrain_uncertainty"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    names = ["ray", "reach", "east", "north", "up", "ground_sigma", "probe", "sigma"]
    got = sorted(map(repr, map(tuple, run(spark, str(tmp_path)).select(*names).collect())))
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()))
    assert got == want and len(got) == 106
