"""Each rule with a case on its threshold and a guard just below."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import chains as C, entry_rules as E, graph as G, motifs as M, reports as P, rules as R, timing as W, trace, validators as D, views as V
from ledgerloom.sources import ledger as L

TX = "account string, destination string, amount_drops long, ledger_seq long, hash string, pair long, type string, tag long"


def tx(spark, rows):
    return spark.createDataFrame([(a, b, d, s, f"h{k}", 1, "Payment", None) for k, (a, b, d, s) in enumerate(rows)], TX)


def addresses(found):
    return sorted(r.address for r in found.collect())


def test_dusting(spark):
    rows = [("hit", f"d{k}", 99, 1) for k in range(3)] + [("few", f"d{k}", 99, 1) for k in range(2)] + [("big", f"d{k}", 100, 1) for k in range(5)] + [("same", "d", 1, k) for k in range(5)]
    assert addresses(R.dusting(tx(spark, rows))) == ["hit"]
    assert R.dusting(tx(spark, rows).where("false")).count() == 0


def test_payment_burst(spark):
    rows = [("hit", f"d{k}", 99, 1) for k in range(4)] + [("hit", "e", 1000, 1)] + [("four", f"d{k}", 99, 1) for k in range(4)] + [("mixed", f"d{k}", 99 if k < 3 else 500, 1) for k in range(6)]
    assert addresses(R.payment_burst(tx(spark, rows), tiny=100)) == ["hit"]


def test_dusting_counts_history_and_fresh_destinations(spark):
    rows = [("hit", "d1", 9, 1), ("young", "f1", 9, 1), ("young", "f2", 9, 1), ("one", "f1", 9, 1), ("old", "d1", 9, 1), ("idle", "x", 500, 1)]
    history = spark.createDataFrame([("hit", "d2"), ("hit", "d3"), ("old", "d1"), ("old", "d2"), *(("idle", f"d{k}") for k in range(5))], "account string, destination string")
    fresh = spark.createDataFrame([("f1",), ("f2",)], "address string")
    assert {(r.address, r.note) for r in R.dusting(tx(spark, rows), history=history, fresh=fresh).collect()} == {("hit", "3"), ("young", "2")}


def test_payment_burst_to_a_bad_account(spark):
    rows = [("hit", f"d{k}", 99 if k < 2 else 500, 1) for k in range(3)] + [("hit", "e1", 99, 1), ("hit", "e2", 500, 1)]
    rows = [("hit", f"d{k}", 99, 1) for k in range(2)] + [("hit", f"e{k}", 500, 1) for k in range(2)] + [("hit", "bad", 500, 1)]
    bad = spark.createDataFrame([("bad",)], "address string")
    assert addresses(R.payment_burst(tx(spark, rows), tiny=100, bad=bad)) == []  # two tiny of five: not all but two
    assert addresses(R.payment_burst(tx(spark, rows), tiny=100, slack=3, bad=bad)) == ["hit"]
    assert addresses(R.payment_burst(tx(spark, rows), tiny=100, slack=3)) == []


def test_self_transfers_are_payments_to_oneself_in_one_asset(spark):
    rows = [("hit", "hit", 1, k) for k in range(3)] + [("two", "two", 1, k) for k in range(2)] + [("other", "b", 1, k) for k in range(5)]
    assert addresses(R.self_transfers(tx(spark, rows))) == ["hit"]
    mixed = tx(spark, rows[:3]).withColumn("pair", F.monotonically_increasing_id() % 2)
    assert addresses(R.self_transfers(mixed.withColumn("pair", F.col("ledger_seq") % 2))) == []


def test_drainer_sweep(spark):
    rows = [("v1", "hit", 500, 1), ("v2", "hit", 500, 2), ("hit", "small", 10, 3), ("hit", "out", 900, 4), ("v3", "low", 1000, 1), ("low", "out", 899, 2), ("v4", "back", 1000, 1), ("back", "v4", 1000, 2), ("poor", "out", 900, 5)]
    assert addresses(R.drainer_sweep(tx(spark, rows))) == ["hit"]
    fresh = spark.createDataFrame([("hit", True), ("poor", False), ("low", True)], "account string, created boolean")
    history = spark.createDataFrame([("poor", 1000)], "account string, funded long")
    assert {(r.address, r.severity, r.note) for r in R.drainer_sweep(tx(spark, rows), fresh=fresh, history=history).collect()} == {("hit", "malicious", "900"), ("poor", "suspect", "900")}
    balances = spark.createDataFrame([("h5", 900), ("h3", 5000)], "hash string, balance long")
    assert addresses(R.drainer_sweep(tx(spark, rows), fresh=fresh, balances=balances)) == ["low"] or addresses(R.drainer_sweep(tx(spark, rows), fresh=fresh, balances=balances)) == ["hit", "low"]
    assert R.drainer_sweep(tx(spark, rows), fresh=fresh.where("false")).count() == 0


def test_spoof_cycles(spark):
    events = []
    for who, wait, notional, levels in (("hit", 75, 10**8, 2), ("slow", 76, 10**8, 2), ("little", 75, 10**8 - 1, 2), ("flat", 75, 10**8, 1)):
        for k in range(3):
            events += [(who, k, 1, k % levels, notional, 70 * k, f"{who}{k}a", "create"), (who, k, 1, None, None, 70 * k + wait, f"{who}{k}b", "cancel")]
    events += [("twice", 1, 1, k % 2, 10**8, k, f"t{k}", "create" if k == 0 else "cancel") for k in range(4)]  # one order is cancelled once
    schema = "account string, sequence long, book long, level long, notional long, ledger_seq long, hash string, kind string"
    assert addresses(R.spoof_cycles(spark.createDataFrame(events, schema))) == ["hit"]
    assert addresses(R.spoof_cycles(spark.createDataFrame(events, schema), span=214)) == []


def test_thin_pool_and_wash_swap(spark):
    n = 10**7
    fills = [(f"m{k}", 1, False, 10.0, n, k) for k in range(9)] + [("hit", 1, False, 7.5, n, 1), ("hit", 1, False, 7.4, n, 151), ("once", 1, False, 7.0, n, 2), ("near", 1, False, 7.6, n, 1), ("near", 1, False, 7.6, n, 2)]
    fills += [("wrong", 1, True, 7.0, n, 1), ("wrong", 1, True, 7.0, n, 2), ("long", 1, False, 7.0, n, 1), ("long", 1, False, 7.0, n, 152), ("little", 1, False, 7.0, n - 1, 1), ("little", 1, False, 7.0, n - 1, 2), ("high", 1, True, 12.5, n, 1), ("high", 1, True, 12.5, n, 2)]
    fills += [(f"n{k}", 1, False, 10.0, n, k) for k in range(20)]
    assert addresses(R.thin_pool(spark.createDataFrame(fills, "account string, pair long, up boolean, rate double, notional long, ledger_seq long"))) == ["high", "hit"]
    ways = lambda last: (("buy", 1), ("buy", 2), ("sell", 3), ("sell", last))
    wash = [("hit", 1, d, 500_000, s) for d, s in ways(151)] + [("wide", 1, d, 500_000, s) for d, s in ways(152)] + [("one", 1, "buy", 500_000, s) for s in range(4)]
    wash += [("little", 1, d, 499_999, s) for d, s in ways(9)] + [("uneven", 1, d, 500_000 if d == "buy" else 440_000, s) for d, s in ways(9)]
    assert addresses(R.wash_swap(spark.createDataFrame(wash, "account string, pair long, direction string, notional long, ledger_seq long"))) == ["hit"]


def test_findings_keep_the_first(spark):
    a, b = (spark.createDataFrame([("r", s, "x", "n")], "rule_id string, severity string, address string, note string") for s in ("suspect", "info"))
    assert [r.severity for r in R.together(b, a).collect()] == ["info"] and [r.severity for r in R.together(a, b).collect()] == ["suspect"]
    assert [r.severity for r in R.deduplicated(b.unionByName(a)).collect()] == ["suspect"]


def test_bursts_of_free_accepts(spark):
    accepts = spark.createDataFrame([("hit", 0)] * 10 + [("few", 0)] * 9 + [("paid", 1)] * 10, "account string, amount_drops long")
    assert addresses(R.nft_bursts(tx(spark, []).limit(0), accepts=accepts)) == ["hit"]


def slow_flows(nodes, edges, paths=4, longest=6):
    role, onward, into = dict(nodes), {}, set()
    for a, b in sorted({e for e in edges if e[0] != e[1]}):
        onward.setdefault(a, []).append(b)
        into.add(b)
    found = []

    def record(path):
        if len(path) >= 2 and len(found) < paths and path not in found:
            found.append(path)

    def walk(path):
        if len(found) >= paths:
            return
        nxt = onward.get(path[-1], [])
        if role[path[-1]] == "collector" or not nxt or len(path) >= longest:
            return record(path)
        for t in nxt:
            record(path) if t in path else walk([*path, t])

    for n in sorted(role):
        if n not in into or role[n] == "source":
            walk([n])
    return sorted(found)


def test_flow_paths_match_a_walk(spark):
    r = random.Random(5)
    nodes, edges = [], []
    for g in range(30):
        size = r.randint(2, 12)
        nodes += [(g, f"n{k:02}", r.choice(["unknown", "unknown", "relay", "collector", "source", None])) for k in range(size)]
        edges += [(g, f"n{r.randrange(size):02}", f"n{r.randrange(size):02}") for _ in range(r.randint(1, 40))]
    found = C.flow_paths(spark.createDataFrame(nodes, "g long, node string, role string"), spark.createDataFrame(edges, "g long, src string, dst string"), "g").collect()
    for g in range(30):
        want = slow_flows([(n, x) for h, n, x in nodes if h == g], [(a, b) for h, a, b in edges if h == g])
        assert sorted(list(x.path) for x in found if x.g == g) == want


def test_replay_matches_a_walk(spark):
    r = random.Random(6)
    edges = [(r.randrange(3), f"n{r.randrange(9)}", f"n{r.randrange(9)}", r.randrange(20), f"h{k}") for k in range(90)]
    df = spark.createDataFrame(edges, "g long, account string, destination string, ledger_seq long, hash string")
    start = spark.createDataFrame([(g, f"n{k}") for g in range(3) for k in range(10)], "g long, address string")
    for most in (200, 3):
        for x in V.replay(start, df, "g", most, at_once=2).collect():
            path, usable = [x.address], lambda path: sorted((s, h, a) for g, a, b, s, h in edges if g == x.g and b == path[-1] and a not in path)
            while len(path) <= most and usable(path):
                path.append(usable(path)[0][2])
            assert list(x.path) == path and x.hops == len(path) - 1 and x.truncated == (len(path) > most and bool(usable(path)))
    assert V.replay(start, df, "g").count() == 30


def test_replay_goes_to_the_end_of_a_long_walk(spark):
    line = spark.range(320).select((F.col("id") % 2).alias("g"), F.concat(F.lit("n"), F.floor(F.col("id") / 2)).alias("account"), F.concat(F.lit("n"), F.floor(F.col("id") / 2) + 1).alias("destination"), F.col("id").alias("ledger_seq"), F.lit("h").alias("hash"))
    line = line.where("g = 0 OR id < 20")
    start = line.select("g", F.col("destination").alias("address"))
    by_task = {(x.g, x.address): (tuple(x.path), x.hops, x.truncated) for x in V.replay(start, line, "g", None, dealt=7).collect()}
    assert by_task == {(g, f"n{k}"): (tuple(f"n{j}" for j in range(k, -1, -1)), k, False) for g, last in ((0, 160), (1, 10)) for k in range(1, last + 1)}
    short = line.where("id < 60")  # graph 0 by joins, graph 1 in tasks
    assert {(x.g, x.address): (tuple(x.path), x.hops, x.truncated) for x in V.replay(short.select("g", F.col("destination").alias("address")), short, "g", None, held=15).collect()} == {k: v for k, v in by_task.items() if v[1] <= (30 if k[0] == 0 else 10)}


def test_replay_shares_the_ends_of_walks():
    class Counted(list):
        looked = 0

        def __getitem__(self, i):
            Counted.looked += isinstance(i, slice)
            return super().__getitem__(i)

    n = 1000  # 0 <- 1 <- 2 ..: every node's only sender is the one before it, and 0's is the last one
    turns, line, walks = V._turns(list(range(n + 1)), Counted((k - 1) % n for k in range(n)), list(range(0, n, 3))), [], 0
    for kept, nodes in turns:
        line[kept:] = nodes
        if walks < 3:
            assert line[::-1] == [(line[-1] - k) % n for k in range(n)]
        walks += 1
    assert walks == n and Counted.looked == n * n  # a circle: each node lies on the walk from its sender
    Counted.looked = 0
    n = 3000
    sizes = [len(nodes) + kept for kept, nodes in V._turns([0, *range(n)], Counted(range(n - 1)), list(range(n)))]
    assert sorted(sizes) == list(range(1, n + 1)) and Counted.looked <= 2  # a line of 4.5 million hops


def test_replay_of_all_receivers_as_text(spark):
    r = random.Random(8)
    edges = [(r.choice([0, 1, 2, None]), f"n{r.randrange(25)}", f"n{r.randrange(25)}", r.randrange(60), f"h{k}") for k in range(260)]
    df = spark.createDataFrame(edges, "g long, account string, destination string, ledger_seq long, hash string")
    for most in (None, 5):
        found = {(x.g, x.address): (x.path, x.hops, x.truncated) for x in V.replay(None, df, "g", most, dealt=4, joined=" > ").collect()}
        want = {}
        for g, _, start, _, _ in (e for e in edges if e[1] != e[2]):
            path, usable = [start], lambda path: sorted((s, h, a) for k, a, b, s, h in edges if g is not None and k == g and b == path[-1] and a not in path)
            while (most is None or len(path) <= most) and usable(path):
                path.append(usable(path)[0][2])
            want[g, start] = (" > ".join(path), len(path) - 1, most is not None and len(path) > most and bool(usable(path)))
        assert found == want
    short = {(x.g, x.address): x.path for x in V.replay(None, df, "g", 5, held=20, joined=" > ").collect()}  # by joins
    assert short == {k: v[0] for k, v in found.items()}


def test_replay_batches_stay_small():
    n = 300
    rows = pa.RecordBatch.from_pydict({"tip": [f"n{k}" for k in range(1, n)] * 2, "account": [f"n{k - 1}" for k in range(1, n)] + [None] * (n - 1), "place": pa.array([1] * (n - 1) + [None] * (n - 1), pa.int32())})
    for joined in (None, ">"):
        found = list(V._followed(None, joined, size=10_000)((pa.scalar(7),), iter([rows])))
        assert len(found) > 10 and max(x.nbytes for x in found) < 30_000
        for x in found:
            x.validate(full=True)
        paths = {y["address"]: y["path"] for x in found for y in x.to_pylist()}
        walk = lambda k: [f"n{j}" for j in range(k, -1, -1)]
        assert paths == {f"n{k}": walk(k) if joined is None else ">".join(walk(k)) for k in range(1, n)}


def test_members_absent_from_a_long_list(spark):
    masters = spark.range(10_200).select(F.concat(F.lit("V"), "id").alias("master"))
    votes = masters.where("master <> 'V7'").select(F.lit(1).alias("ledger"), "master").unionByName(spark.createDataFrame([(2, "V7"), (2, "X"), (3, "X")], "ledger int, master string"))
    absent = P.absent_members(votes, masters.unionByName(masters.limit(5)), 1)
    assert absent.where("ledger = 1").collect() == [(1, "V7", "missed")]
    assert sorted(tuple(r) for r in absent.groupBy("ledger", "type").count().collect()) == [(1, "missed", 1), (2, "missed", 10_199), (3, "vote-not-observed", 10_200)]
    assert absent.distinct().count() == 20_400 and absent.where("ledger = 2 AND master IN ('V7', 'X')").isEmpty()


def test_sweeps_match_a_walk_and_copy_no_contact(spark):
    r = random.Random(8)
    tx = [(f"a{r.randrange(5)}", r.choice([None, *(f"d{k}" for k in range(9))]), r.choice([None, *range(60)])) for _ in range(160)]
    df = spark.createDataFrame(tx, "account string, destination string, ledger long")
    for least, window in ((2, 1), (4, 7), (6, 12), (9, 80)):
        want = []
        for a in {x[0] for x in tx}:
            near = lambda at: len({d for b, d, n in tx if b == a and d and n is not None and n <= at <= n + window})  # noqa: B023, E731
            want += [(a, at, near(at)) for at in range(160) if near(at) >= least][:1]
        assert sorted(tuple(x) for x in trace.sweeps(df, least, window).collect()) == sorted(want)
    assert "sequence(" not in trace.sweeps(df)._jdf.queryExecution().optimizedPlan().toString()


def slow_capped(nodes, edges, budget, floor):
    if len(nodes) <= budget:
        return {n[0] for n in nodes}
    sev, rank = {"malicious": 2, "suspect": 1}, {"relay": 1, "source": 2, "collector": 3, "drainer": 4}
    s, q = {n: sev.get(x, 0) for n, x, _, _ in nodes}, {n: rank.get(x, 0) for n, _, x, _ in nodes}
    taken = set(sorted((n for n in s if s[n] == 2 or q[n] >= 2), key=lambda n: (-s[n], -q[n], n))[: min(floor, budget)])
    for _, _, _, a, b in sorted((-(d or 0), -1 if l is None else l, h, a, b) for a, b, d, l, h in edges if a in s and b in s and a != b):
        new = {a, b} - taken
        if len(taken) + len(new) <= budget:
            taken |= new
    drops = {n: d or 0 for n, _, _, d in nodes}
    return taken | set(sorted((n for n in s if n not in taken), key=lambda n: (-s[n], -drops[n], n))[: budget - len(taken)])


@pytest.mark.parametrize("budget, floor", [(7, 2), (8, 3), (12, 12), (5, 0)])
def test_capped_nodes_match_a_walk(spark, budget, floor):
    r = random.Random(budget)
    nodes, edges = [], []
    for g in range(40):
        size = r.randint(3, 25)
        nodes += [(g, f"n{k:02}", r.choice(["malicious", "suspect", "info", None, "info", "info"]), r.choice(["unknown", "relay", "drainer", "unknown", None, "unknown"]), r.choice([None, 5, 9, 20])) for k in range(size)]
        edges += [(g, f"n{r.randrange(size + 1):02}", f"n{r.randrange(size + 1):02}", r.choice([None, 3, 3, r.randrange(50)]), r.choice([None, 1, 2]), f"h{r.randrange(99)}") for _ in range(r.randint(0, 30))]
    found = V.capped_nodes(spark.createDataFrame(nodes, "g long, address string, severity string, role string, drops long"), spark.createDataFrame(edges, "g long, account string, destination string, amount_drops long, ledger_seq long, hash string"), "g", budget, floor).collect()
    for g in range(40):
        assert {x.address for x in found if x.g == g} == slow_capped([n[1:] for n in nodes if n[0] == g], [e[1:] for e in edges if e[0] == g], budget, floor)
    assert len(found) == len({(x.g, x.address) for x in found})


def test_waves_and_others(spark):
    rows = [(f"a{k}", "hit", 90, 5) for k in range(5)] + [(f"b{k}", "low", 89, 5) for k in range(5)]
    balances = spark.createDataFrame([(f"{x}{k}", 100) for x in "ab" for k in range(5)], "account string, balance long")
    assert addresses(R.sweep_convergence(tx(spark, rows), balances)) == ["hit"]
    assert addresses(R.delete_sweep(tx(spark, rows[:3] + rows[5:7]))) == ["hit"]
    assert addresses(R.trust_spam(tx(spark, rows), tiny=90, least=5)) == ["low"]
    assert addresses(R.nft_bursts(tx(spark, [("s", "o", 0, k) for k in range(5)] + [("t", "o", 0, k) for k in range(4)]))) == ["s"]


def test_wash_cycles_guard_refunds_and_spans(spark):
    rows = [("a", "b", 100, 1), ("a", "b", 100, 2), ("b", "a", 90, 3), ("b", "a", 90, 4), ("c", "d", 100, 1), ("d", "c", 100, 2), ("e", "f", 100, 1), ("e", "f", 100, 2), ("f", "e", 70, 3), ("f", "e", 80, 4)]
    found = M.wash_cycles(tx(spark, rows)).collect()
    assert [(r.a, r.b, r.conserve) for r in found] == [("a", "b", 0.9)]
    assert M.wash_cycles(tx(spark, rows), span=2).count() == 0
    exclude = spark.createDataFrame([("a",)], "address string")
    assert M.wash_cycles(tx(spark, rows), exclude=exclude).count() == 0


def test_temporal_burst_counts_both_ends(spark):
    rows = [("x", "y", 1, s) for s in (0, 10, 10, 11, 21)] + [("z", "y", 1, 5)]
    found = {r.account: r for r in M.temporal(tx(spark, rows)).collect()}
    assert found["x"].burst == 3 and found["x"].median_gap == 5.5 and found["z"].burst == 1 and found["z"].median_gap is None and found["z"].automated is False


def roles(spark, rows, flagged):
    f = spark.createDataFrame([(a, "suspect", "r") for a in flagged], "address string, severity string, rule_id string")
    return {r.address: r.role for r in G.node_roles(G.flag_edges(tx(spark, rows), f)).collect()}


def test_roles(spark):
    drainer = [("v1", "d", 500, 1), ("v2", "d", 500, 1), ("d", "out", 900, 2)]
    assert roles(spark, drainer, ["v1", "v2", "d"])["d"] == "drainer"
    assert roles(spark, drainer[:2] + [("d", "out", 899, 2)], ["v1", "v2", "d"])["d"] == "relay"
    assert roles(spark, [("v1", "d", 500, 1), ("d", "out", 500, 2)], ["v1", "d"])["d"] == "relay"  # one sender only
    collector = [(f"v{k}", "c", 100, 1) for k in range(3)]
    assert roles(spark, collector, ["v0", "v1", "v2"])["c"] == "collector"
    assert roles(spark, collector[:2], ["v0", "v1", "v2"])["c"] == "unknown"
    source = [("s", f"t{k}", 100_000, 1) for k in range(3)]
    assert roles(spark, source, ["t0", "s"])["s"] == "source"
    assert roles(spark, [("s", f"t{k}", 100_001, 1) for k in range(3)], ["t0", "s"])["s"] == "unknown"


def test_edges_need_a_flag_and_two_addresses(spark):
    f = spark.createDataFrame([("a", "suspect", "r"), ("a", "malicious", "q"), ("b", "odd", "r")], "address string, severity string, rule_id string")
    rows = [("a", "b", 1, 1), ("c", "a", 1, 1), ("c", "d", 1, 1), ("a", "a", 1, 1), ("b", None, 1, 1)]
    assert sorted((r.account, r.destination, r.severity) for r in G.flag_edges(tx(spark, rows), f).collect()) == [("a", "b", "malicious"), ("c", "a", "malicious")]
    assert {r.address: r.severity for r in G.severity_by_address(f).collect()} == {"a": "malicious", "b": "info"}


def test_peeling_chain_and_guards(spark):
    def chain(*amounts, gap=1):
        return tx(spark, [(f"n{k}", f"n{k + 1}", a, 1 + k * gap) for k, a in enumerate(amounts)])

    assert [r.hops for r in C.peeling_chains(chain(1000, 900, 800)).collect()] == [3]
    assert C.peeling_chains(chain(1000, 900)).count() == 0  # two hops
    assert C.peeling_chains(chain(1000, 960, 900)).count() == 0  # a share over 0.95
    assert C.peeling_chains(chain(1000, 900, 800, gap=901)).count() == 0
    fan = tx(spark, [("n0", "n1", 1000, 1), ("n1", "n2", 900, 2), ("n1", "x", 900, 2), ("n2", "n3", 800, 3), ("n3", "n4", 700, 4)])
    assert [r.path for r in C.peeling_chains(fan, least=2).collect()] == [["n1", "n2", "n3", "n4"]]


def samples(spark, extra):
    rows = [("n", 1000 + k, 4000 * k, 20, 0) for k in range(40)] + [("n", *extra)]
    return {r.type: (r.value, r.baseline) for r in trace.detect_patterns(spark.createDataFrame(rows, "network string, ledger long, close_ms long, tx_count long, findings long"), "network").collect()}


def test_patterns(spark):
    assert samples(spark, (1040, 160_000, 200, 0)) == {"load-spike": (200, 20.0)}
    assert samples(spark, (1040, 160_000, 45, 0)) == {}
    assert samples(spark, (1040, 39 * 4000 + 60_000, 20, 0)) == {"close-gap": (60_000, 4000.0)}
    assert samples(spark, (1041, 39 * 4000 + 60_000, 20, 0)) == {}  # an index was skipped
    assert samples(spark, (1040, 160_000, 20, 12)) == {"fund-burst": (12, 0.0)}
    assert samples(spark, (1040, 160_000, 20, 3)) == {}


def test_failure_runs(spark):
    rows = [("m", k, 10 * k, "missed") for k in (1, 2, 3, 7)] + [("o", 7, 70, "wrong-hash"), ("p", 9, 90, "partial"), ("p", 10, 100, "partial")]
    found = {(r.master, r.from_ledger): r for r in D.failure_runs(spark.createDataFrame(rows, "master string, ledger long, t_ms long, type string")).collect()}
    assert {k: (r.ledgers, r.verdict) for k, r in found.items()} == {("m", 1): (3, "offline-window"), ("m", 7): (1, "isolated-miss"), ("o", 7): (1, "hash-divergence"), ("p", 9): (2, "degraded-window")}
    assert found["m", 7].co_ledgers == 1 and found["m", 1].duration_ms == 20


def test_two_proportions_and_erfc(spark):
    import math

    from ledgerloom.functions.stats import erfc, two_proportion_z
    from pyspark.sql import functions as F

    xs = [-2.5, -0.3, 0.0, 0.7, 3.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x"))).collect()]
    assert all(abs(a - math.erfc(x)) < 3e-7 for a, x in zip(got, xs))
    z = spark.createDataFrame([(30, 100, 10, 100), (0, 10, 0, 10), (1, 0, 1, 5)], "a long, n long, b long, m long").select(two_proportion_z(*map(F.col, "anbm")).alias("z")).collect()
    assert z[0].z == pytest.approx(0.2 / math.sqrt(0.2 * 0.8 * 0.02)) and z[1].z is None and z[2].z is None


def test_stride_and_limits(spark):
    df = spark.createDataFrame([("a", k) for k in range(10)] + [("b", 1)], "k string, n long")
    assert sorted((r.k, r.n) for r in W.strided(df, "k", ["n"], 4).collect()) == [("a", 0), ("a", 2), ("a", 5), ("a", 7), ("b", 1)]
    asked = spark.createDataFrame([("u", t) for t in (0, 10, 20, 60)], "k string, t long")
    assert [r.recent for r in W.sliding_limit(asked, "k", "t", 60, 2).orderBy("t").collect()] == [1, 2, 3, 3]


def entries(spark, tmp_path, rows):
    (tmp_path / "e.json").write_text("\n".join(json.dumps(r) for r in rows))
    return L.expand_batches(L.normalized(L.read_entries(spark, str(tmp_path / "e.json"))))


def memo(text):
    return [{"Memo": {"MemoData": text.encode().hex()}}]


def test_entry_rules(spark, tmp_path):
    rows = entries(spark, tmp_path, [
        {"TransactionType": "Payment", "Account": "bad", "Destination": "v", "Memos": memo("verify your wallet at http://evil.example"), "hash": "1"},
        {"TransactionType": "Payment", "Account": "ask", "Destination": "v", "Memos": memo("is this legit: airdrop http://evil.example"), "hash": "2"},
        {"TransactionType": "Payment", "Account": "ok", "Destination": "v", "Memos": memo("Warranty claim: register at www.example.com/support"), "hash": "3"},
        {"TransactionType": "Batch", "Account": "p", "hash": "4", "RawTransactions": [{"RawTransaction": {"TransactionType": "SetRegularKey", "Account": "q", "RegularKey": "bad"}}, {"RawTransaction": {"TransactionType": "AccountSet", "Account": "p"}}]},
        {"TransactionType": "NFTokenMint", "Account": "m1", "TransferFee": 50000, "hash": "5"}, {"TransactionType": "NFTokenMint", "Account": "m2", "TransferFee": 49999, "hash": "6"},
        {"TransactionType": "NFTokenMint", "Account": "m3", "URI": b"https://bit.ly/x".hex(), "hash": "7"}, {"TransactionType": "SetFee", "hash": "8"}, {"TransactionType": "UNLModify", "hash": "9"},
        {"TransactionType": "EscrowCreate", "Account": "e", "Destination": "new", "Amount": "99", "Memos": memo("free token http://x.example"), "hash": "10"},
        {"TransactionType": "EscrowCreate", "Account": "f", "Destination": "old", "Amount": "99", "Memos": memo("free token http://x.example"), "hash": "11"},
    ])
    get = lambda d: sorted((r.rule_id, r.severity, r.address) for r in d.collect())
    assert get(E.memo_phishing(rows)) == [("memo-phishing", "malicious", "bad"), ("memo-phishing", "malicious", "e"), ("memo-phishing", "malicious", "f"), ("memo-phishing", "suspect", "ask")]
    assert get(E.batch_control(rows)) == [("batch-inner-control", "malicious", "q"), ("batch-inner-control", "suspect", "p")]
    assert get(E.fake_nft(rows)) == [("fake-nft-fraud", "suspect", "m1"), ("fake-nft-fraud", "suspect", "m3")]
    assert get(E.governance(rows)) == [("fee-change", "info", E.ZERO_ACCOUNT), ("validator-unl-change", "suspect", E.ZERO_ACCOUNT)]
    fresh = spark.createDataFrame([("new",)], "address string")
    assert get(E.escrow_bait_entries(rows, fresh)) == [("escrow-check-bait", "suspect", "e")]
    bad = spark.createDataFrame([("bad",), ("v",)], "address string")
    assert get(E.known_bad_actors(rows, bad, spark.createDataFrame([("v",)], "address string"))) == [("known-bad-hit", "malicious", "bad")]
    assert E.catalog(spark).count() == 22


def test_text_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("0",), ("4294967295",), ("4294967296",), ("-1",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normal_tag(F.col("t"))).collect()] == [0, 4294967295, None, None, None, None]
    kinds = spark.createDataFrame([("Payment",), ("AMMVote",), ("VaultSet",), ("Strange",), (None,)], "t string")
    assert [r[0] for r in kinds.select(T.tx_category(F.col("t"))).collect()] == ["payment", "market", "admin", "other", "other"]


def test_results_do_not_depend_on_row_order(spark):
    rows = [("v1", "d", 500, 1), ("v2", "d", 500, 1), ("d", "out", 900, 2), ("a", "b", 100, 1), ("b", "a", 90, 3)]
    f = spark.createDataFrame([(a, "suspect", "r") for a in ("v1", "d", "a")], "address string, severity string, rule_id string")
    runs = []
    for k in range(3):
        shuffled = rows[k:] + rows[:k]
        runs.append(sorted(map(str, G.node_roles(G.flag_edges(tx(spark, shuffled), f)).collect())))
    assert runs[0] == runs[1] == runs[2]


def test_node_keys_round_trip(spark):
    from ledgerloom.functions import keys as K
    from pyspark.sql import functions as F

    hexes = ["ED" + "0" * 64, "03" + "AB" * 32, "02" + "FF" * 32]
    df = spark.createDataFrame([(h,) for h in [*hexes, "zz", "AB", None]], "h string").withColumn("k", K.node_key("h"))
    rows = df.select("h", "k", K.node_hex("k").alias("back")).collect()
    assert [r.back for r in rows] == [*hexes, None, None, None] and all(r.k.startswith("n") for r in rows[:3])
    assert K.decode_node_key(rows[0].k[:-1] + ("r" if rows[0].k[-1] != "r" else "p")) is None
    assert df.where(F.col("k").isNull()).count() == 3
