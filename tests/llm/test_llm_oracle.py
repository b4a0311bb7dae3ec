"""Operators that SQL can express give DuckDB's rows on the smallest tables."""

import duckdb
import pytest
from siftloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DIR)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = sorted((tuple(str(r[c]) for c in cols) for r in got.collect()))
    want = want.astype(object).where(want.notna(), None)
    assert rows == sorted(tuple(str(x) for x in r) for r in want[cols].itertuples(index=False))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
