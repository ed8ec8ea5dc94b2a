"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from palimpsest import registry

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    df = registry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = con.sql(registry.oracle_sql()[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows(sql.columns, sql.fetchall())
