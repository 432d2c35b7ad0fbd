"""The text operators' queries against their SQL in DuckDB, row by row, on the smallest tables."""

import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from kithspark.llm import registry  # noqa: E402

DATA = os.environ.get("KITHSPARK_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal(spark, con, name):
    ours, theirs = registry.queries()[name](spark, DATA).toArrow(), con.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    rows = lambda t: sorted(repr([round(v, 9) if isinstance(v, float) else v for _, v in sorted(r.items())]) for r in t.to_pylist())
    assert rows(ours) == rows(theirs)
