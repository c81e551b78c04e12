import duckdb
import pytest

from kvlog.plans import catalogue

TABLES = ("customer", "orders", "events")


@pytest.fixture(scope="module")
def duck(small):
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, small, duck, name):
    got = catalogue.QUERIES[name](spark, small)
    rows = sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(got.columns) == columns
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
