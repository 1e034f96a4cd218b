"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables, and some rows."""

import duckdb
import pytest

import ledgerloom.plans as plans

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose thresholds find nothing in the smallest tables.
MAY_BE_EMPTY = {"confirmed_sweeps", "hub_cut", "flow_paths", "thin_pool", "spoof_cycle", "nft_burst", "trust_spam", "dusting", "alone_hours", "day_holes", "wash_cycles", "sweep_window", "entity_signal", "entity_clusters", "co_failure_clusters", "transit", "offer_spam", "novel_types"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want
    assert want or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
