"""What keeps shuffles in proportion to the input, held to the forms that it replaces."""

import pytest

import ledgerloom.plans as plans
from ledgerloom.operators import graph as G, state as S

from .conftest import DATA

EDGE = "hash string, account string, destination string, amount_drops long, ledger_seq long"


@pytest.fixture
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flags_are_broadcast_up_to_a_number(spark, no_automatic_broadcast):
    tx = spark.createDataFrame([(f"h{k}", f"a{k % 7}", f"a{k % 5}", k, k) for k in range(40)] + [("n", None, "a1", 1, 1)], EDGE)
    found = spark.createDataFrame([("a1", "malicious"), ("a1", "info"), ("a4", "suspect"), (None, "suspect")], "address string, severity string")
    few, many = G.flag_edges(tx, found), G.flag_edges(tx, found, most=1)
    assert plan(few).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan(few)
    assert plan(many).count("SortMergeJoin") == 2
    assert rows(few) == rows(many) and few.count() == sum(k % 7 != k % 5 and bool({k % 7, k % 5} & {1, 4}) for k in range(40))


def test_second_edges_without_a_hash_make_anchors(spark):
    e = spark.createDataFrame([("a", "x", "y", 1, 1), (None, "x", "z", 9, 2), ("b", "v", "w", 8, 3), ("b", "v", "w", 7, 3), ("c", "p", "q", 5, 4)], EDGE).selectExpr("'k' AS cluster", "*")
    got = S.top_edges(e, "cluster", k=3, anchors=1)
    assert "lead(" not in plan(got)  # a node's oldest edge is a minimum, no window over its edges
    assert [(r.hash, r.amount_drops) for r in got.orderBy("place").collect()] == [("a", 1), (None, 9), ("b", 8)]
    assert [(r.hash, r.amount_drops) for r in S.top_edges(e, "cluster", k=3, anchors=2).orderBy("place").collect()] == [("b", 8), ("b", 7), ("a", 1)]


@pytest.mark.parametrize("name", ["clusters", "capped_nodes", "drainer_sweep"])
def test_payments_are_joined_once(spark, name):
    found = plans.QUERIES[name](spark, DATA)
    assert "orders.parquet" not in found._jdf.queryExecution().optimizedPlan().toString() + plan(found)  # no step joins line items with orders again
