"""Ledger evaluation: levels, quorum, typing and late votes against a walk, and the stream against the batch form."""

import datetime as dt
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as E
from ledgerloom.streaming.evaluation import evaluated_stream, ledger_join

CLOSES = "network string, ledger long, hash string, close_ms long, tx_count long"
VOTES = "network string, ledger long, master string, hash string, full boolean, t_ms long"
MEMBERS = [f"m{k}" for k in range(10)]


def history(seed=1, n=140, grace=20_000):
    """A network of ten members with missing ledgers, thin stretches, partial, wrong, repeated and late votes, and strangers."""
    r, closes, votes, t = random.Random(seed), [], [], 1_000_000
    for ledger in range(100, 100 + n):
        t += r.choice([3000, 4000, 4000, 5000, 30_000])
        if r.random() < 0.04:
            continue
        h = f"h{ledger}"
        closes.append(("main", ledger, r.choice([None, f"c{ledger}"]) if r.random() < 0.08 else h, t, r.randint(1, 90)))
        thin = r.random() < 0.06
        for m in [*MEMBERS, "x", "y", "z"]:
            if r.random() < (0.6 if thin else 0.03):
                continue
            at = t + r.choice([100, 900, 2500, grace, grace + 1, 25_000, 90_000] if r.random() < 0.1 else [300, 700])
            votes.append(("main", ledger, m, h if r.random() > 0.03 else r.choice([f"w{ledger}", "a", None]), r.random() > 0.03, at))
            if r.random() < 0.03:
                votes.append(("main", ledger, m, f"w{ledger}", True, at + 50))
    return closes, votes


def walk(closes, votes, members, quorum=(), opens=(), grace=20_000, ring=512, size=60, least=20):
    """The evaluation, one ledger after the other."""
    reception, coverage, gaps, out, late, prev, prev_due = [], [], [], {}, {}, None, None
    rows = sorted(closes, key=lambda c: c[1])
    dues = [c[3] + grace for c in rows]
    for k, (_, ledger, closed, close, _) in enumerate(rows):
        due, seen, outside = close + grace, {}, 0
        for v in sorted((v for v in votes if v[1] == ledger), key=lambda v: (v[5], v[3] or "", v[4])):
            if v[5] <= due:
                if v[2] in members:
                    seen[v[2]] = v
                else:
                    outside += 1
            elif v[2] in members:
                inside = k + ring >= len(rows) or v[5] < dues[k + ring]
                late[ledger, v[2], inside] = v[5] - close
        count = {}
        for v in seen.values():
            if v[3] is not None:
                count[v[3]] = count.get(v[3], 0) + 1
        order = sorted(count, key=lambda h: (-count[h], h))
        top = order[0] if order else None
        measured = [q for t, q in quorum if t <= due]
        need = measured[-1] if measured else -(-len(members) * 8 // 10)
        index_gap = prev is not None and ledger > prev[0] + 1
        opened = any(t <= due and (prev_due is None or t > prev_due) for t in opens)
        gap = closed is not None and (index_gap or opened)
        level = median(reception[-size:]) if len(reception[-size:]) >= least else None
        cover = median(coverage[-size:]) if len(coverage[-size:]) >= least else None
        observed = len(seen) + outside
        thin = closed is not None and level is not None and observed < level * 0.75
        conflict = closed is not None and top is not None and top != closed
        blame = closed is not None and not gap and not thin and cover is not None and len(seen) >= cover * 0.9 and not conflict and len(members) - len(seen) <= max(0, len(members) - need)
        has = top is not None and count[top] >= need
        types = {}
        for m in members:
            v = seen.get(m)
            kind = ("missed" if has and blame else "vote-not-observed" if closed else "no-quorum") if v is None else "wrong-hash" if has and v[3] != top else None if v[4] else "partial"
            if kind:
                types[m] = kind
        out[ledger] = (len(seen), outside, top, count.get(top, 0), count[order[1]] if len(order) > 1 else 0, need, has, gap, level, cover, median(gaps[-size:]) if gaps else None, thin, conflict, blame, types)
        reception.append(observed)
        if closed is not None and not gap:
            coverage.append(len(seen))
        if prev is not None and not index_gap:
            gaps.append(close - prev[1])
        prev, prev_due = (ledger, close), due
    return out, late


COLUMNS = ["votes", "outside", "top_hash", "top", "runner", "needed", "has_quorum", "capture_gap", "observed_baseline", "coverage_baseline", "median_gap_ms", "reception_thin", "closure_conflict", "attributable"]


def results(j, members, votes, ring=512):
    found = E.incidents(j, members)
    types = {}
    for r in found.collect():
        types.setdefault(r.ledger, {})[r.master] = r.type
    got = {r.ledger: (*(r[c] for c in COLUMNS), types.get(r.ledger, {})) for r in j.collect()}
    late = E.late(j, votes, members, ring)
    return got, {(r.ledger, r.master, r.in_ring): r.delay_ms for r in late.collect()}, E.patched(found, late).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_evaluation_equals_a_walk(spark, seed):
    closes, votes = history(seed)
    quorum, opens = [(1_200_000, 7), (1_400_000, 9)], [1_050_000, 1_300_000]
    c, v = spark.createDataFrame(closes, CLOSES), spark.createDataFrame(votes, VOTES)
    q = spark.createDataFrame([("main", t, x) for t, x in quorum], "network string, t_ms long, quorum long")
    o = spark.createDataFrame([("main", t) for t in opens], "network string, t_ms long")
    j = E.judged(E.tallies(c, v, MEMBERS), MEMBERS, q, o, width=64).cache()
    got, late, patches = results(j, MEMBERS, v, ring=5)
    want, want_late = walk(closes, votes, MEMBERS, quorum, opens, ring=5)
    assert got == want and late == want_late
    assert {x for r in want.values() for x in r[-1].values()} == {"missed", "vote-not-observed", "no-quorum", "wrong-hash", "partial"}
    assert any(r[11] for r in want.values()) and any(r[12] for r in want.values())
    for r in patches:
        hit = (r.ledger, r.master, True) in want_late and r.type in ("missed", "vote-not-observed")
        assert r.late == hit and (not hit or r.vote_delay_ms == want_late[r.ledger, r.master, True])
    assert any(r.late for r in patches) and any(not k[2] for k in want_late)
    j.unpersist()


def test_levels_need_twenty_ledgers(spark):
    closes = [("n", k, "h", k * 4000, 1) for k in range(22)]
    votes = [("n", k, m, "h", True, k * 4000 + 10) for k in range(22) for m in MEMBERS[: 8 if k in (19, 20) else 10]]
    j = E.judged(E.tallies(spark.createDataFrame(closes, CLOSES), spark.createDataFrame(votes, VOTES), MEMBERS), MEMBERS)
    got = {r.ledger: r for r in j.collect()}
    assert got[19].coverage_baseline is None and not got[19].attributable  # nineteen before it
    assert got[20].coverage_baseline == 10 and not got[20].attributable and got[20].has_quorum  # eight are fewer than nine
    assert got[21].attributable


def test_no_rows_and_no_members(spark):
    c, v = spark.createDataFrame([], CLOSES), spark.createDataFrame([], VOTES)
    assert E.judged(E.tallies(c, v, MEMBERS), MEMBERS).collect() == []
    j = E.judged(E.tallies(spark.createDataFrame([("n", 1, "h", 5, None)], CLOSES), v, []), [])
    assert E.incidents(j, []).collect() == [] and j.first().votes == 0
    with pytest.raises(ValueError):
        E.member_list(spark.createDataFrame([("a",), ("b",)], "master string"), most=1)


def test_stream_equals_batch(spark, tmp_path):
    """The same rows, in files, disordered within the watermark's delay: equal tallies, the same late votes, nothing told twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        closes, votes = history(3, 36)
        r, rows = random.Random(5), [(c[3], "c", c) for c in closes] + [(v[5], "v", v) for v in votes]
        rows.sort(key=lambda x: x[0] + r.randint(0, 4000))
        folders = {"c": tmp_path / "closes", "v": tmp_path / "votes"}
        size = len(rows) // 4 + 1
        for k in range(0, len(rows), size):
            part = rows[k : k + size]
            for tag, schema in (("c", CLOSES), ("v", VOTES)):
                spark.createDataFrame([x[2] for x in part if x[1] == tag], schema).coalesce(1).write.mode("append").parquet(str(folders[tag]))
        far = max(x[0] for x in rows) + 10_000_000  # another ledger moves the watermark past all
        spark.createDataFrame([("other", 1, "h", far, 1)], CLOSES).coalesce(1).write.mode("append").parquet(str(folders["c"]))
        spark.createDataFrame([("other", 1, "m1", "h", True, far)], VOTES).coalesce(1).write.mode("append").parquet(str(folders["v"]))
        read = lambda tag, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folders[tag]))
        q = evaluated_stream(read("c", CLOSES), read("v", VOTES), MEMBERS, keep_ms=3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        out = spark.read.parquet(str(tmp_path / "out")).where("network = 'main'")
        t = out.where("kind = 'tally'").select("network", "ledger", "close_ms", "hash", "tx_count", "ballots", "outside")
        c, v = spark.createDataFrame(closes, CLOSES), spark.createDataFrame(votes, VOTES)
        batch = E.tallies(c, v, MEMBERS)
        plain = lambda df: sorted((r.ledger, r.close_ms, r.hash or "", r.tx_count, r.outside, tuple(map(tuple, r.ballots))) for r in df.collect())
        assert plain(t) == plain(batch) and t.count() == len(closes)
        late = out.where("kind = 'late'").select("network", "ledger", "master", "hash", "full", "t_ms")
        mine, theirs = (results(E.judged(x, MEMBERS, width=64), MEMBERS, y) for x, y in ((t, late), (batch, v)))
        assert mine[:2] == theirs[:2] and mine[1] and sorted(mine[2]) == sorted(theirs[2])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


TXS = "network string, ledger long, tx_hash string, account string, amount_drops long, t_ms long"


def test_three_streams_join_as_tables_do(spark, tmp_path):
    """Votes, closes and transactions in files of shuffled order give the batch join's rows once the watermarks are past them."""
    r = random.Random(7)
    closes, votes = history(9, 30)
    closes = [c for c in closes for _ in range(2 if c[1] % 9 == 0 else 1)]  # some come twice
    txs = [("main", c[1], f"t{c[1]}-{k % 7}", f"a{k % 3}", 10 * k if k % 7 else None, c[3] - r.choice([0, 500, 59_000, 61_000])) for c in closes if c[1] % 4 for k in range(r.randint(0, 9))]
    sides = {"c": (closes, CLOSES, 3), "v": (votes, VOTES, 5), "x": (txs, TXS, 5)}
    tables = [spark.createDataFrame(rows, schema) for rows, schema, _ in sides.values()]
    want = sorted(map(str, ledger_join(*tables).collect()))
    assert len(want) == len({c[1:4] for c in closes}) and any("tx_count=0" in w for w in want) and any("voters=0" not in w for w in want)
    streams = []
    for tag, (rows, schema, at) in sides.items():
        far = {"c": ("other", 1, "h", 10**9, 1), "v": ("other", 1, "m", "h", True, 10**9), "x": ("other", 1, "t", "a", 1, 10**9)}[tag]
        order = sorted(rows, key=lambda x: x[at] + r.randint(0, 4000))
        for part in (order[: len(order) // 2], order[len(order) // 2 :], [far]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / tag))
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / tag)))
    q = ledger_join(*streams, delays=("100 seconds",) * 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).where("network = 'main'").collect())) == want
