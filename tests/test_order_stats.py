"""Medians without the own value, ranks and criticality against brute force."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import criticality as C, evaluation as E, order_stats as O

from .test_evaluation import CLOSES, MEMBERS, VOTES, history


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_others_median_equals_brute_force(spark, by):
    r = random.Random(4)
    rows = [(k, r.choice(["a", "b", None]), r.randrange(2), r.choice([None, r.randrange(6), r.randrange(6), r.random()]), r.random() < 0.8) for k in range(160)] + [(900, "lone", 0, 5.0, True), (901, "pair", 0, 1.0, True), (902, "pair", 0, 9.0, True)]
    rows = [(i, g, h, None if x is None else float(x), s) for i, g, h, x, s in rows]
    df = spark.createDataFrame(rows, "id long, g string, h int, x double, s boolean")
    got = {t.id: (t.m, t.m_samples) for t in O.others_median(df, by, "x", F.col("s"), "m", least=2).collect()}
    at = {"g": 1, "h": 2}
    assert len(got) == len(rows)
    for row in rows:
        rest = [o[3] for o in rows if o[0] != row[0] and o[4] and o[3] is not None and all(o[at[c]] == row[at[c]] for c in by)]
        assert got[row[0]] == (median(rest) if len(rest) >= 2 else None, len(rest))


def test_ranks_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        values = [random.Random(k).randrange(300) for k in range(2000)]
        ranked = O.ranked_values(spark.createDataFrame([(v,) for v in values], "x long"), [], "x").persist()
        assert {r.x: (r.n, r.below, r.total) for r in ranked.collect()} == {v: (values.count(v), sum(o < v for o in values), 2000) for v in set(values)}
        assert O.percentile_row(ranked, "x", 0.9, "p").first().p == pytest.approx(spark.createDataFrame([(v,) for v in values], "x long").agg(F.percentile("x", F.lit(0.9))).first()[0])
        ranked.unpersist()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    empty = spark.createDataFrame([], "id long, x double")
    assert O.others_median(empty, [], "x", F.lit(True), "m").collect() == []


def test_criticality_equals_brute_force(spark):
    closes, votes = history(4, 70)
    r = random.Random(8)
    captures = [("main", r.choice(["open", "drop", None]), c[3] + r.choice([-120_001, -120_000, -500, 0, 500, 90_000])) for c in r.sample(closes, 15)]
    j = E.judged(E.tallies(spark.createDataFrame(closes, CLOSES), spark.createDataFrame(votes, VOTES), MEMBERS), MEMBERS)
    inc = E.incidents(j, MEMBERS)
    got = C.criticality(j, inc, spark.createDataFrame(captures, "network string, kind string, at_ms long")).persist()
    by = {x.ledger: x for x in j.collect()}
    all_ = {}
    for x in inc.collect():
        all_.setdefault(x.ledger, []).append((x.type, x.master))
    seen = set()
    for x in got.collect():
        t, day = by[x.ledger], by[x.ledger].close_ms // C.DAY_MS
        rest = [o.votes for o in by.values() if o.ledger != x.ledger and o.closed and not o.capture_gap and not o.stream_open and o.close_ms // C.DAY_MS == day]
        level = t.coverage_baseline if t.coverage_baseline is not None else median(rest) if len(rest) >= 20 else None
        assert x.coverage_level == level and x.coverage_basis == ("recorded" if t.coverage_baseline is not None else "day" if level is not None else None)
        near = sorted((abs(a - t.close_ms), a) for _, _, a in captures if abs(a - t.close_ms) <= 120_000 and a // C.DAY_MS == day)
        assert x.event_delta_ms == (near[0][0] if near else None)
        verdict = "not-closed" if not t.closed else "closed-capture-gap" if t.capture_gap else "closed-line-conflict" if t.closure_conflict else "closed-quorum-observed" if t.has_quorum else "closed-reception-thin" if t.reception_thin else "closed-observation-gap"
        assert x.verdict == verdict and x.critical == (not t.closed and t.margin <= 1)
        others = sorted(o for o in all_[x.ledger] if o[1] != x.master)
        assert (x.affected_types, x.affected_masters) == ([o[0] for o in others], [o[1] for o in others])
        absent = sum(o[0] in ("missed", "vote-not-observed", "no-quorum") for o in all_[x.ledger])
        assert x.capture_artifact_min == (max(0, absent - t.genuine_absent_max) if t.closed else None)
        seen.add(verdict)
    assert got.count() == sum(map(len, all_.values())) and {"not-closed", "closed-capture-gap", "closed-line-conflict", "closed-quorum-observed"} <= seen
    assert C.summary(got).agg(F.sum("checked")).first()[0] == got.count()
    got.unpersist()
