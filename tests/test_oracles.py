"""Every registered query of the engine itself against its SQL on the smallest tables."""

import duckdb
import pytest

from loomwork.plans import registry
from loomwork.plans.star import RAW
from tests.conftest import SMALL

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in RAW:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "__float__") and not isinstance(value, int):
        return round(float(value), 9)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
