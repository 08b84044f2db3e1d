"""Every registered query of the reconciliation operators against its SQL twin."""

import glob
import os

import duckdb
import pytest

from tallybook.plans import registry
from tests.compare import rows

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert not got.duplicated().any()
        return
    want = tables.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def indel(a: str, b: str) -> float:
    """The Indel ratio by the plain table of longest common subsequences."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


@pytest.mark.parametrize("name,least", [("j13_fuzzy_pairs", 80.0), ("j14_names_one_to_one", 55.0), ("j16_greedy_lines", 70.0), ("j19_pair_files", 40.0)])
def test_pairs_are_one_to_one_and_alike(spark, name, least):
    """Every pair has the ratio it states, at least the least one, and no side is paired twice in its group."""
    got = QUERIES[name](spark, DATA).toPandas()
    group = got.columns[0]
    assert not got.duplicated([group, "a"]).any() and not got.duplicated([group, "b"]).any()
    assert all(abs(indel(a, b) - s) < 1e-6 and s >= least for a, b, s in zip(got["a"], got["b"], got["score"], strict=True))


@pytest.mark.parametrize("name", ["m01_token_sort_ratio", "m01_best_ratio_of_names", "c03_compare_field"])
def test_ratios_by_brute_force(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert got["ratio"].dropna().between(0, 100).all() and got["ratio"].notna().any()
    if name == "c03_compare_field":
        bands = got.dropna(subset=["ratio"])
        want = bands["ratio"].map(lambda r: "ok" if r == 100 else "format" if r >= 92 else "doubtful" if r >= 70 else "different")
        assert (bands["status"] == want).all() and (got[got["ratio"].isna()]["status"] == "missing").all()
