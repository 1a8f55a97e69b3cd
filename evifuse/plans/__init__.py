"""Query plans over the driver tables: every module holds a ``QUERIES`` dict of name to (query, SQL or None)."""

from __future__ import annotations

from evifuse.plans import contracts, detection, evaluation, grid, images, live, missions, navigation, objects, protocol, rasters, selective, sync, terrain


def catalog() -> dict:
    found: dict = {}
    for module in (sync, evaluation, rasters, protocol, live, contracts, navigation, detection, selective, grid, terrain, images, objects, missions):
        found |= module.QUERIES
    return found
