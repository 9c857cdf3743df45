import duckdb
import pytest

from stratolith.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(cols)
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert rows(got.select(cols).collect()) == rows(want.fetchall())
