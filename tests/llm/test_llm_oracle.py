"""Operators that SQL can state against their SQL."""

import duckdb
import pytest

from quire.llm.registry import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = duck.sql(oracle_sql()[name])
    order = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns and got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 11))
