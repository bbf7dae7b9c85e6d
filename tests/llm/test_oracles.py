import duckdb
import pytest

from lexmill.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DIR)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, want.select(", ".join(sorted(want.columns))).fetchall())) == sorted(str(tuple(r)) for r in got.select(*sorted(got.columns)).collect())
