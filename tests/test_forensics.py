"""Forms of ledgers and their signatures, and the parts that windows run over."""

from pyspark.sql import functions as F

from ledgerloom.operators import forensics as X, parts as P, trace as T

TX = "ledger long, hash string, account string, destination string, type string, fee long, inner long, failed boolean"


def test_form_counts_a_hash_once(spark):
    tx = spark.createDataFrame([
        (1, "a", "A", "X", "Payment", 10, 0, False), (1, "a", "A", "X", "Payment", 10, 0, False), (1, "b", "A", "Y", "OfferCreate", 30, 4, True),
        (1, None, "B", None, "SetFee", 0, None, None), (1, None, "B", None, "SetFee", 0, None, None), (1, "c", None, "Z", None, None, 0, False), (2, "a", None, None, "AccountDelete", None, None, None),
    ], TX)
    r = {x.ledger: x for x in X.forms(tx).collect()}
    one, two = r[1], r[2]
    assert (one.n, one.senders, one.receivers, one.busiest, one.busiest_tx, one.fan_out, one.fan_tx) == (5, 2, 3, "A", 2, 2, 2)
    assert (one.failed, one.offers, one.features, one.batches, one.inner, one.fee_most, one.fee_median, one.repeated, one.unhashed) == (1, 1, 2, 1, 4, 30, 20.0, 1, 2)
    assert (two.n, two.senders, two.receivers, two.busiest, two.fan_out, two.created, two.fee_median) == (1, 0, 0, None, 0, 1, 0.0)
    assert {(x.ledger, x.type, x.n) for x in X.type_counts(tx).collect()} == {(1, "Payment", 1), (1, "OfferCreate", 1), (1, "SetFee", 2), (1, None, 1), (2, "AccountDelete", 1)}
    assert X.forms(tx.limit(0)).count() == 0 and X.signatures(X.forms(tx.limit(0)), X.type_counts(tx.limit(0))).count() == 0


def test_signatures_at_the_default_thresholds(spark):
    def ledger(k, n, kind="Payment", **over):
        base = {"account": None, "destination": "X", "fee": 10, "inner": 0, "failed": False}
        return [(k, f"{kind}{k}-{i}", *({**base, "account": f"S{i}", **over}[c] for c in ("account", "destination")), kind, *({**base, **over}[c] for c in ("fee", "inner", "failed"))) for i in range(n)]

    calm = [r for k in range(10) for r in ledger(k, 5)]
    loud = ledger(10, 20) + ledger(11, 50) + ledger(12, 40, "OfferCreate") + ledger(13, 25, account="S") + ledger(14, 5, inner=10) + ledger(15, 30, failed=True) + ledger(16, 39, "NFTokenMint")
    tx = spark.createDataFrame(calm + loud, TX)
    got = {}
    for r in X.signatures(X.forms(tx), X.type_counts(tx)).collect():
        got.setdefault(r.ledger, set()).add(r.tag)
    # medians with the ledger itself: 5; the offers' own baseline starts with their first ledger, so they are no burst of their type
    assert got == {10: {"load-spike", "type-burst:Payment"}, 11: {"load-extreme", "type-burst:Payment"}, 12: {"load-spike", "offer-flood"}, 13: {"load-spike", "sender-burst", "type-burst:Payment"}, 14: {"batch-amplify"}, 15: {"load-spike", "failure-spike", "type-burst:Payment"}, 16: {"load-spike"}}


def test_parts_hold_every_row_once_and_what_precedes_it(spark):
    rows = spark.range(0, 50).select((F.col("id") * 3 + (F.col("id") % 2)).alias("ledger"), (F.col("id") % 3).alias("net"))
    parts = P.overlapping(P.placed(rows, "ledger", ("net",), 7), 3, 7).collect()
    own = [(r.net, r.place, r.ledger) for r in parts if not r.guest]
    assert len(own) == 50 and [p for n, p, _ in sorted(own) if n == 0] == list(range(17))
    for r in parts:
        if not r.guest:
            assert {x.place for x in parts if x.net == r.net and x.part == r.part} >= set(range(max(0, r.place - 3), r.place))


def test_gaps_do_not_depend_on_the_parts(spark):
    rows = spark.createDataFrame([(n, x) for n in ("a", "b") for x in range(40) if x % 7 not in (3, 4)], "net string, ledger long")
    found = [{tuple(r) for r in T.index_gaps(rows, "net", w).collect()} for w in (1, 2, 5, 10_000)]
    assert found[0] == found[1] == found[2] == found[3] == {(n, x, x + 1) for n in ("a", "b") for x in (3, 10, 17, 24, 31)}
