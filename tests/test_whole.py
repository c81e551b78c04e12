"""Queries that run over whole tables, at a size with several runs."""

import duckdb
import pytest

from kvlog.plans import catalogue

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["two_way_merge_whole", "wal_replay_whole"])
def test_whole_log(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = duck.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    newest = catalogue.events_log(spark, DATA).select("key").distinct().count()
    assert len(got) == newest
