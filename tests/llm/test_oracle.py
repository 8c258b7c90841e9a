"""Queries of the training-data operators with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from tributary.llm import queries as Q

from ..test_oracle import TABLES, plain


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(name, spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = Q.queries()[name](spark, sf)
    columns = sorted(df.columns)
    cursor = con.execute(Q.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert len(cursor.description) == len(columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want
