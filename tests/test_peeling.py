"""Chains from seeds and over state against a walk over random graphs."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import peeling as P

TX = "hash string, account string, destination string, amount_drops long, ledger_seq long, fee_drops long, to_tag long, from_tag long, close_ms long"


def graph(seed, lines=30, peels=0.5):
    """Lines of relays with decaying amounts, some joined, cut, widened by further payments, peeled or with a flagged account inside."""
    r, tx, flags, n = random.Random(seed), [], {}, 0

    def pay(a, b, amount, seq):
        nonlocal n
        n += 1
        tx.append((f"h{n:04}", a, b, amount, seq, r.choice([10, 10, 11, 15, None]), r.choice([None, None, 7]), None, None if seq is None else seq * 4000))

    for line in range(lines):
        nodes, seq, amount = [f"n{line}-{k}" for k in range(r.randint(3, 12))], r.randint(1, 50), 10_000_000
        for a, b in zip(nodes, nodes[1:]):
            pay(a, b, amount if r.random() > 0.03 else None, seq if r.random() > 0.03 else None)
            if r.random() < peels:
                pay(b, f"p{r.randint(0, 9)}", int(amount * r.choice([0.005, 0.008, 0.05, 0.00001])), seq)
            if r.random() < 0.06:
                pay(b, f"n{r.randrange(lines)}-{r.randint(0, 3)}", amount // 3, seq)
            amount, seq = int(amount * r.choice([0.7, 0.8, 0.9, 0.97, 0.98])), seq + r.choice([1, 5, 5, 6, 2000] if r.random() < 0.2 else [5])
        flags[nodes[0]] = r.choice([1, 2, 3])
        if r.random() < 0.8:
            flags[nodes[-1]] = 2
        if r.random() < 0.3:
            flags[r.choice(nodes)] = 3
    for k in range(25):
        pay(f"n0-{k % 2}", "n1-1", 50, 3)
    return tx, flags


def habits(hops, peels):
    out, fees = [], [h[5] for h in hops if h[5]]
    if len(fees) >= 2 and all(abs(f - median(fees)) <= 0.1 * median(fees) for f in fees):
        out.append("fee-constancy")
    amounts = [x for x in [h[3] for h in hops] + peels if x is not None]
    if len(set(amounts)) < len(amounts):
        out.append("amount-duplicates")
    if len(hops) >= 3 and all(h[4] is not None for h in hops):
        gaps = [abs(b[4] - a[4]) for a, b in zip(hops, hops[1:])]
        mean = sum(gaps) / len(gaps)
        if median(gaps) <= 10 and sum((g - mean) ** 2 for g in gaps) / len(gaps) <= 36:
            out.append("interval-regularity")
    tags = [x for h in hops for x in (h[6], h[7]) if x is not None]
    if len(set(tags)) < len(tags):
        out.append("tag-reuse")
    return out


def closure(starts, arcs):
    seen, front = set(starts), list(starts)
    while front:
        front = [b for a in front for b in arcs.get(a, ()) if b not in seen and not seen.add(b)]
    return seen


def walk(tx, flags, over_state=False):
    tx = [t for t in tx if t[1] != t[2]]
    out, back = {}, {}
    for t in tx:
        out.setdefault(t[1], set()).add(t[2])
        back.setdefault(t[2], set()).add(t[1])
    reach, lead = closure(flags, out), closure(flags, back)
    near = tx if over_state else [t for t in tx if t[1] in reach and t[2] in lead]
    counted = tx if over_state else [t for t in tx if t[1] in flags or t[2] in flags]
    outs, ins, busy = {}, {}, {}
    for t in near:
        outs.setdefault(t[1], []).append(t)
        ins.setdefault(t[2], []).append(t)
    for t in counted:
        for end in t[1:3]:
            busy[end] = busy.get(end, 0) + 1
    found = {}
    for seed in sorted(flags):
        for first in sorted(outs.get(seed, []), key=lambda t: (t[2], -1 if t[4] is None else t[4], t[0])):
            if not first[3] or first[3] <= 100:
                continue
            path, hops, peels = [seed, first[2]], [first], []
            while len(hops) < 8:
                at, came = path[-1], hops[-1]
                if (at in flags and not over_state) or (at not in flags and busy.get(at, 0) > 20) or len(outs.get(at, [])) != 1 or len(ins.get(at, [])) != 1:
                    break
                way = outs[at][0]
                if way[2] in path or not way[3] or way[3] <= 100 or not came[3]:
                    break
                ratio = way[3] / came[3]
                if over_state and None not in (way[4], came[4]) and abs(way[4] - came[4]) > 900:
                    break
                if not 0.6 <= ratio <= 0.95:
                    small = [t for t in sorted(tx, key=lambda t: (-1 if t[4] is None else t[4], t[0])) if t[1] == at and t[2] not in path and t[2] != way[2] and t[3] is not None and 100 < t[3] <= came[3] * 0.01]
                    if over_state or not 0.95 <= ratio < 1 or not small:
                        break
                    peels.append(small[0][3])
                path.append(way[2])
                hops.append(way)
            times = [h[8] for h in hops if h[8] is not None]
            if len(hops) < (2 if peels else 3) or ",".join(path) in found or (over_state and times and max(times) - min(times) > 86_400_000):
                continue
            ordered = sorted(hops, key=lambda h: (-1 if h[4] is None else h[4], h[0]))
            found[",".join(path)] = (flags[seed], [h[0] for h in ordered], sorted(a for a in path if a not in flags), len(peels), habits(hops, peels))
    return found


def frames(spark, tx, flags):
    return spark.createDataFrame(tx, TX), spark.createDataFrame([(a, r) for a, r in flags.items()] + [(next(iter(flags)), 1)], "address string, rank int")


def results(df):
    return {r.signature: (r.seed_rank, [h.hash for h in r.hops], r.bridges, r.remainder_hops, r.habits) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_seeded_chains_equal_a_walk(spark, seed):
    tx, flags = graph(seed)
    want = walk(tx, flags)
    assert results(P.seeded_chains(*frames(spark, tx, flags))) == want
    assert len(want) > 5 and any(w[3] for w in want.values()) and any(not w[3] for w in want.values())


def test_edge_chains_owners_and_folds(spark):
    tx, flags = graph(3, 60, 0.05)
    t, f = frames(spark, tx, flags)
    want = walk(tx, flags, over_state=True)
    chains = P.edge_chains(t, f)
    assert results(chains) == want and any(any(a in flags for a in s.split(",")[1:-1]) for s in want)
    first = sorted(want)[0].split(",")
    members = spark.createDataFrame([("c2", first[0]), ("c1", first[2]), ("c3", first[0])], "cluster string, address string")
    own = {r.signature: r.owner for r in P.owned(chains, members).collect()}
    assert own[",".join(first)] == "c2" and set(own.values()) <= {"c1", "c2"}
    known = spark.createDataFrame([("c2", "zz", None), ("c2", "a", None), ("c9", "old", None)], "owner string, signature string, hops array<struct<hash:string,account:string,destination:string,amount_drops:bigint,ledger_seq:bigint,fee_drops:bigint,to_tag:bigint,from_tag:bigint,ratio:double,peel_drops:bigint>>")
    once = P.fold_chains(known, t, f, members, most=2).persist()
    got = {(r.owner, r.signature) for r in once.collect()}
    assert ("c9", "old") in got and ("c2", "a") in got and sum(o == "c2" for o, _ in got) == 2
    again = P.fold_chains(once, t, f, members, most=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))  # a fold run twice changes nothing
    once.unpersist()


def test_limits_and_empty_tables(spark):
    tx, flags = graph(1)
    t, f = frames(spark, tx, flags)
    some = P.seeded_chains(t, f, seeds=5, chains=2).collect()
    assert len(some) <= 2 and {r.seed for r in some} <= set(sorted(flags)[:5])
    assert P.seeded_chains(t, f.limit(0)).collect() == [] and P.edge_chains(t.limit(0), f).collect() == []
    assert P.seeded_chains(t, f, degree=1).collect() == []


def test_searches_and_walks_shuffle_or_broadcast_alike(spark):
    e = spark.createDataFrame([(a, b) for a, b in [(0, 1), (1, 2), (2, 3), (3, 1), (5, 4), (4, 0), (7, 8)]] + [(k, k + 1) for k in range(20, 40)], "account long, destination long")
    starts = spark.createDataFrame([(0,), (30,), (None,)], "node long")
    few, many = (sorted(map(tuple, P.reached(e, starts, most=most).collect()), key=str) for most in (1 << 20, 0))
    assert few == many and len(few) == len(set(few))
    assert {n for n, side in few if side == "from"} == {None, 0, 1, 2, 3, *range(30, 41)} and {n for n, side in few if side == "to"} == {None, 0, 4, 5, *range(20, 31)}


def test_walked_chains_are_kept_and_short_ones_left_out(spark):
    tx, flags = graph(2)
    t, f = frames(spark, tx, flags)
    chains = P.edge_chains(t, f)
    assert len(results(chains)) > 0 and "Join" not in str(P.edge_chains(t.drop("close_ms"), f)._jdf.queryExecution().optimizedPlan())  # no step is joined again
    hop = [F.lit(None).cast("long").alias(c) for c in ("fee_drops", "to_tag", "from_tag")]
    first = spark.createDataFrame([("a", "s", "x", 100, 1, None, 3), ("b", "s", "dead", 100, 1, None, 3)], "hash string, account string, destination string, amount_drops long, ledger_seq long, destination_rank long, account_rank long").select("*", *hop)
    way = F.struct("hash", "account", "destination", "amount_drops", "ledger_seq", *hop, F.lit(None).cast("long").alias("destination_rank")).alias("way")
    ways = spark.createDataFrame([("c", "x", "y", 80, 2), ("d", "y", "z", 64, 3), ("e", "z", "x", 51, 4)], "hash string, account string, destination string, amount_drops long, ledger_seq long")
    step = ways.select(F.col("account").alias("node"), F.expr("amount_drops * 5 div 4").alias("in_drops"), F.lit(1).cast("long").alias("in_seq"), way, F.array().cast("array<struct<destination:string,amount_drops:bigint>>").alias("peels"))
    ok = lambda ratio, peel: F.when(ratio.between(0.6, 0.95), F.lit(0))
    for most in (0, 1 << 20):
        assert [r.path for r in P._walked(first, step, ok, F.size("hops") >= 2, 8, most).collect()] == [["s", "x", "y", "z"]]
        assert [r.path for r in P._walked(first, step, ok, F.size("hops") >= 2, 2, most).collect()] == [["s", "x", "y"]]
