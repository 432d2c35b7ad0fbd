"""Numbers too long for a bigint: the queries over documents that hold some, compared with their SQL."""

import duckdb
import pytest

from kithspark.plans import registry, registry_runs  # noqa: F401

KEYS = ["blocking_keys", "pair_sink", "pair_jaccard", "pair_numbers_cross", "pair_context_gaps", "token_rate_table", "token_rates_full", "token_rates_handed", "token_rates_oof", "stage2_table"]
TOKENS = ["typed_tokens", "sparse_rare_q"]
SIZES = ["pair_numbers", "rule_score_a2", "fp_anatomy"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    more = "left(text, 80) || ' 9999999999999999999' || (doc_id % 7) || '1 5 17 29 31 ' || substr(text, 81)"
    duckdb.sql(f"""COPY (SELECT doc_id, t AS text, lang, source, CAST(length(t) AS BIGINT) AS n_chars FROM (
      SELECT *, CASE WHEN doc_id % 10 < 3 THEN {more} ELSE text END AS t FROM read_parquet('/root/testdata/sf0.01/documents.parquet'))) TO '{at}/documents.parquet' (FORMAT parquet)""")
    return str(at)


@pytest.mark.parametrize("name", KEYS + TOKENS + SIZES)
def test_equal(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, odd).select(*columns).collect()
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want.fetchall(), key=key)
