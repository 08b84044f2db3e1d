"""The registered queries: those with SQL against it, the others whole and of a stable shape."""

import glob
import os

import duckdb
import pytest

from tallybook.llm import queries
from tests.compare import rows

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, tables, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), tables.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: The table that a query returns a row for each row of, its id there, and columns that the contract names.
WHOLE = {
    "op1_simhash": ("documents", "doc_id", {"fingerprint", "component_id"}),
    "op2_toxicity": ("documents", "doc_id", {"held_out", "score", "predicted"}),
    "op3_substrings": ("documents", "doc_id", {"text", "n_sentences", "n_removed"}),
    "op4_html": ("pages", "page_id", {"url", "text", "n_chars"}),
    "op7_languages": ("documents", "doc_id", {"held_out", "lang_pred", "score"}),
    "op10_fingerprints": ("documents", "doc_id", {"n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_query_keeps_every_row(spark, tables, name):
    table, key, columns = WHOLE[name]
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert {key, *columns} <= set(got.columns)
    assert sorted(got[key]) == sorted(tables.sql(f"select {key} from {table}").df()[key])
    for c in {"score", "near_edited", "near_next"} & columns:
        assert got[c].between(0, 1).all()
    assert not got[sorted(columns - {"text", "url"})].isna().any().any()
