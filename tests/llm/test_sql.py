"""The corpus queries that SQL can express give the rows that DuckDB gives."""

import os

import pytest

from pulseweave.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_rows(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = c.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(str(r[cols.index(k)]) for k in df.columns) for r in cur.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.collect()) == want
