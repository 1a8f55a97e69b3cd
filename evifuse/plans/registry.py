"""Named queries over the driver tables, each with the SQL that states the same result."""

from __future__ import annotations

from functools import wraps

from evifuse.plans import catalog
from evifuse.sources.ship import ship


def shipped(query):
    """The query, with the package sent to the executors first."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: shipped(query) for name, (query, _) in catalog().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in catalog().items() if sql}
