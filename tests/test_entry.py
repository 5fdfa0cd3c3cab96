"""The driver contract, and stream results against the batch SQL."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 120


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["host", "links", "noise", "urls"] and df.count() > 0


@pytest.mark.parametrize("name", ["source_performance", "suppressed_picks", "near_misses", "stream_feedback", "stream_daily_budget", "stream_reputation", "stored_runs", "rejection_summary"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert got == want
