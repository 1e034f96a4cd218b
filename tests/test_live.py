"""Branches of live events, escalation, hashes that come again, batches that run again."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import live as L

EVENT = "hash string, validated boolean, account string, destination string, type string, limit_issuer string, issuer string, touched array<string>, dest_tag long, t_ms long"


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame([("b1", "bait one"), ("b2", "bait two"), ("b2", "zz"), (None, "x")], "address string, label string"), spark.createDataFrame([("op",), ("op",)], "address string")


CASES = [  # (event, branch, risk, honeypot); each with the guard beside it
    (("h1", True, "a", "b1", "Payment", None, None, None, 7, 1), "touch", "malicious", "bait one"),
    (("h2", True, "a", "b1", "EscrowCreate", None, None, None, None, 2), "touch", "suspect", "bait one"),
    (("h3", False, "a", "b1", "Payment", None, None, None, None, 3), "unvalidated", None, None),
    (("h3", None, "a", "b1", "Payment", None, None, None, None, 3), "unvalidated", None, None),
    ((None, True, "a", "b1", "Payment", None, None, None, None, 3), "unnamed", None, None),
    (("h4", True, "b1", "b2", "Payment", None, None, None, None, 4), "internal", None, None),
    (("h5", True, "b1", "op", "Payment", None, None, None, None, 5), "operations", None, None),
    (("h6", True, "b1", None, "OfferCreate", None, None, None, None, 6), "own-order", "suspect", "bait one"),
    (("h7", True, "b2", None, "OfferCancel", None, None, None, None, 7), "own-order", "suspect", "bait two"),
    (("h8", True, "b1", "c", "Payment", None, None, None, None, 8), "compromised", "malicious", "bait one"),
    (("h9", True, "b1", None, "SetRegularKey", None, None, None, None, 9), "compromised", "malicious", "bait one"),
    (("ha", True, "t", None, "TrustSet", "b2", None, None, None, 10), "trust", "malicious", "bait two"),
    (("hb", True, "m", None, "NFTokenMint", None, "b1", None, None, 11), "mint", "suspect", "bait one"),
    (("hc", True, "o", None, "OfferCreate", None, None, ["x", "b2", "b1"], None, 12), "orderbook", "suspect", "bait two"),
    (("hd", True, "o", None, "Payment", None, None, ["b1"], None, 13), "orderbook", "malicious", "bait one"),
    (("he", True, "o", "op", "Payment", None, None, ["x"], None, 14), "unrelated", None, None),
    (("hf", True, None, "b1", "Payment", None, None, None, None, 15), "anonymous", None, None),
    (("hg", True, "d", "b1", "TrustSet", "b2", None, ["b2"], None, 16), "touch", "malicious", "bait one"),
]


def test_each_branch(spark, sides):
    got = {(r.hash, r.validated): (r.branch, r.risk, r.honeypot, r.address) for r in L.branched(spark.createDataFrame([c[0] for c in CASES], EVENT), *sides).collect()}
    assert got == {(e[0], e[1]): (branch, risk, label, e[2] if risk else None) for e, branch, risk, label in CASES}
    assert {b for _, b, _, _ in CASES} >= {"touch", "trust", "mint", "orderbook", "internal", "operations", "own-order", "compromised", "unrelated", "anonymous", "unvalidated", "unnamed"}
    with pytest.raises(ValueError):
        L.branched(spark.createDataFrame([], EVENT), *sides, most=1)
    assert L.branched(spark.createDataFrame([CASES[0][0]], EVENT), sides[0].limit(0), sides[1]).first().branch == "unrelated"


def test_long_watchlist(spark, sides):
    watched = spark.range(10_050).select(F.concat(F.lit("w"), "id").alias("address"), F.concat(F.lit("l"), "id").alias("label"))
    rows = [("h1", True, "a", "w10049", "Payment", None, None, None, None, 1), ("h2", True, "o", None, "OfferCreate", None, None, ["x", None, "w10048", "w3"], None, 2), ("h3", True, "o", None, "OfferCreate", None, None, ["x"], None, 3), ("h4", True, "o", None, "OfferCreate", None, None, ["x", None, "w10048", "w3"], None, 4)]
    got = {r.hash: (r.branch, r.honeypot) for r in L.branched(spark.createDataFrame(rows, EVENT), watched, sides[1]).collect()}
    assert got == {"h1": ("touch", "l10049"), "h2": ("orderbook", "l10048"), "h3": ("unrelated", None), "h4": ("orderbook", "l10048")}


def walk(events):
    """The threats after events in order, one after the other."""
    store, hashes = {}, set()
    for address, hash_, t, risk, reason in events:
        if hash_ in hashes:
            continue
        hashes.add(hash_)
        had = store.setdefault(address, [risk, reason, t, 0])
        if risk == "malicious" and had[0] != "malicious":
            had[:2] = risk, reason
        had[2], had[3] = min(had[2], t), had[3] + 1
    return {a: tuple(x) for a, x in store.items()}


def made(seed=1, n=150):
    """Events of which a fifth are ones that came before."""
    r, out = random.Random(seed), []
    for k in range(n):
        again = out and r.random() < 0.2
        out.append(r.choice(out) if again else (f"g{k}", True, f"a{r.randrange(12)}", "b1", r.choice(["Payment", "EscrowCreate", "EscrowFinish", "CheckCreate"]), None, None, None, None, 1000 * k + 1000))  # a watermark begins at 0
    return out


def test_upsert_equals_a_walk_and_may_run_again(spark, sides, tmp_path):
    events, path = made(), str(tmp_path / "store")
    batch = L.upserting(path)
    parts = [events[k : k + 40] for k in range(0, len(events), 40)]
    for n, part in enumerate(parts):
        df = L.branched(spark.createDataFrame(part, EVENT), *sides)
        batch(df, n)
        if n == 2:
            before = sorted(map(str, L.threats(spark, path).collect()))
            batch(df, n)
            assert sorted(map(str, L.threats(spark, path).collect())) == before
    want = walk((e[2], e[0], e[9], "malicious" if e[4] == "Payment" else "suspect", f"touch {e[4]}") for e in events)
    got = {r.address: (r.risk, r.reason, r.first_seen_ms, r.events) for r in L.threats(spark, path).collect()}
    assert got == want and {v[0] for v in want.values()} == {"malicious", "suspect"}
    evidence = L.logged(spark, f"{path}/evidence", L.EVIDENCE)
    assert evidence.count() == len({e[0] for e in events})


def test_escalation_keeps_its_reason(spark, sides, tmp_path):
    row = lambda h, kind, t: (h, True, "a", "b1", kind, None, None, None, None, t)
    batch, path = L.upserting(str(tmp_path / "s")), str(tmp_path / "s")
    state = lambda: tuple(L.threats(spark, path).first())[1:]
    batch(L.branched(spark.createDataFrame([row("1", "CheckCreate", 50)], EVENT), *sides), 0)
    assert state() == ("suspect", "touch CheckCreate", "bait one", 50, 1, 0)
    batch(L.branched(spark.createDataFrame([row("2", "Payment", 90), row("3", "TrustSet", 60)], EVENT), *sides), 1)
    assert state() == ("malicious", "touch TrustSet", "bait one", 50, 3, 1)
    batch(L.branched(spark.createDataFrame([row("4", "Payment", 10), row("2", "Payment", 90)], EVENT), *sides), 2)
    assert state() == ("malicious", "touch TrustSet", "bait one", 10, 4, 2)
    batch(L.branched(spark.createDataFrame([row("4", "Payment", 10)], EVENT), *sides), 3)
    assert state() == ("malicious", "touch TrustSet", "bait one", 10, 4, 2)  # nothing new, no new version


def test_stream_of_threats(spark, sides, tmp_path):
    events = made(2, 60)
    for part in (events[:30], events[20:60], events[:5]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = L.keep_threats(L.classified_stream(stream, *sides), str(tmp_path / "store"), str(tmp_path / "cp"))
    q.awaitTermination(300)
    assert q.exception() is None
    got = {r.address: r.events for r in L.threats(spark, str(tmp_path / "store")).collect()}
    first = {}
    for e in events:
        first.setdefault(e[0], e[2])
    want = {}
    for address in first.values():
        want[address] = want.get(address, 0) + 1
    assert got == want
