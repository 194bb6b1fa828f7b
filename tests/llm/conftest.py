from pathlib import Path

import pytest

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A small documents table: docs_of((id, text), ...) or with (id, text, source)."""
    def make(*rows, extra=""):
        full = [(*r, None)[:3] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, source string")
        for name in extra.split():
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit("clash"))
        return df
    return make


@pytest.fixture(scope="session")
def same_as_sql():
    """Compare a query with its SQL over the small tables."""
    def check(spark, name):
        duckdb = pytest.importorskip("duckdb")
        if not TABLES.exists():
            pytest.skip("no test tables")
        from beatwire.llm.catalog import ORACLES, QUERIES
        con = duckdb.connect()
        for f in TABLES.glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        cur = con.execute(ORACLES[name])
        cols = [c[0] for c in cur.description]
        df = QUERIES[name](spark, str(TABLES))
        assert sorted(df.columns) == sorted(cols)
        want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want
    return check
