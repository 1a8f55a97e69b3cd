"""Every registered query against its SQL on the small tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from evifuse.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are absent")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return str(value) if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    told = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == names
    want = sorted(repr([plain(v) for _, v in sorted(zip(columns, row))]) for row in told.fetchall())
    assert got == want
    kinds = dict((r[0], r[1]) for r in duck.execute("DESCRIBE " + registry.oracle_sql()[name]).fetchall())
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
