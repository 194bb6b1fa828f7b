"""The registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from beatwire.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(contract.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    df = contract.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert contract.entry(spark).count() > 0
