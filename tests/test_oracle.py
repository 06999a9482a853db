"""Registered queries of the item model against their SQL."""

from pathlib import Path

import duckdb
import pytest

from lodekey.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(repr(r) for r in duck.sql(f"SELECT {picked} FROM ({ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
