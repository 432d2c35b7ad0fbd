"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

from kithspark.plans import registry

DATA = os.environ.get("KITHSPARK_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(table):
    return sorted(repr([r[c] for c in sorted(table.column_names)]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal(spark, con, name):
    ours = registry.queries()[name](spark, DATA).toArrow()
    theirs = con.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).toArrow().num_rows > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert registry.queries().keys() <= e.queries().keys()
