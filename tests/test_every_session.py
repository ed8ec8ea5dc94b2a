"""Sessions that lack something keep their row, in Spark and in SQL."""

import glob
import os

import duckdb
import pytest

from palimpsest import registry
from tests.test_registry import SF, rows


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    path = str(tmp_path_factory.mktemp("odd"))
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(f)
        change = {
            # Conversations without a user turn, with a system turn only, and with one assistant turn.
            "conversations.parquet": f"SELECT * FROM '{f}' WHERE NOT (conv_id % 5 = 0 AND role = 'user') UNION ALL BY NAME SELECT 9001 AS conv_id, 0 AS turn, 'system' AS role, 'only rules' AS text UNION ALL BY NAME SELECT 9002 AS conv_id, 0 AS turn, 'assistant' AS role, 'hello' AS text",
            # Users with one event, and with two of which no relation can be resolved.
            "events.parquet": f"SELECT * FROM '{f}' UNION ALL (SELECT * REPLACE (90001 AS event_id, 70001 AS user_id) FROM '{f}' LIMIT 1) UNION ALL (SELECT * REPLACE (90005 AS event_id, 70002 AS user_id, TIMESTAMP '2024-01-02' AS ts) FROM '{f}' LIMIT 1) UNION ALL (SELECT * REPLACE (90006 AS event_id, 70002 AS user_id, TIMESTAMP '2024-01-03' AS ts) FROM '{f}' LIMIT 1)",
        }.get(name, f"SELECT * FROM '{f}'")
        con.execute(f"COPY ({change}) TO '{path}/{name}' (FORMAT parquet)")
    return path


def view(path):
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", ["o_s3_causal_response", "o_g4_store_chain", "o_r2_context", "o_e1_end_to_end"])
def test_every_session_has_its_row(spark, odd_tables, name):
    con = view(odd_tables)
    df = registry.queries()[name](spark, odd_tables)
    got = df.collect()
    sql = con.sql(registry.oracle_sql()[name])
    assert rows(df.columns, map(tuple, got)) == rows(sql.columns, sql.fetchall())
    table, column = ("events", "user_id") if name in ("o_s3_causal_response", "o_g4_store_chain") else ("conversations", "conv_id")
    assert len(got) == con.sql(f"select count(distinct {column}) from {table}").fetchall()[0][0]
    if "error" in df.columns:
        assert {r.session_id for r in got if r.error} >= {9001, 9002} and all(r.n_messages is None for r in got if r.error)
    if name == "o_g4_store_chain":
        assert (0, 0) in {(r.n_stored, r.n_given) for r in got} and any(r.n_stored == 0 < r.n_given for r in got)
