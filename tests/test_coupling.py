"""Stress coupling against a plain walk over random ledgers, and the verdicts' branches on planted ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import coupling as K

LEDGERS = "ledger bigint, t_ms bigint, tx_count bigint, deviating bigint, swept boolean, amendment boolean, unl boolean, shaped boolean, gap_ms bigint, gap_median bigint, first_vote_ms bigint"
DAY = K.DAY_MS


def frames(spark, ledgers, tags, failures):
    return spark.createDataFrame(ledgers, LEDGERS), spark.createDataFrame(tags, "ledger bigint, tag string"), spark.createDataFrame(failures, "ledger bigint, master string, type string")


def drawn(seed, n=160, masters=12):
    r = random.Random(seed)
    ledgers, tags, failures = [], [], []
    for k in range(n):
        tx, fail = r.choice([None, 3, 12, 30, 60, 150, 500]), r.sample(range(masters), r.choice([0, 1, 1, 2, 9, 10]))
        ledgers.append((k, k * 40_000_000, tx, r.choice([None, len(fail), len(fail)]), r.choice([None, False, False, k % 9 == 0]), None, False, r.random() < 0.8, r.choice([None, 1, 10]), r.choice([None, 0, 3]), r.choice([None, 5, 30_000])))
        tags += [(k, t) for t in ("offer-flood", "type-burst:X", "load-spike", "close-gap", "offer-flood") if r.random() < (0.5 if len(fail) > 5 else 0.2)]
        failures += [(k, f"V{m}", r.choice(["missed", "partial"])) for m in fail for _ in range(r.choice([1, 1, 2]))]
    failures.append((n + 5, "V0", "missed"))
    return ledgers, tags, failures


def grade(d, enough, recorded=True):
    return "not-recorded" if not recorded else "insufficient-sample" if not enough else "stress-coupled" if d >= 0.1 else "stress-linked-weak" if d >= 0.04 else "no-coupling-measured"


class Walk:
    """The same by loops over ledgers, one master at a time."""

    def __init__(self, ledgers, tags, failures):
        stress = {t for _, t in tags if t in K.STRESS_TAGS or t.startswith("type-burst:")}
        self.rows = []
        for k, _, tx, dev, swept, am, unl, _, gap, med, first in ledgers:
            own = {t for l, t in tags if l == k and t in stress}
            band = sum((tx or 0) >= b for b in K.BOUNDS)
            stressed = bool(own or swept or am or unl or band >= 5 or (med and gap is not None and gap >= 3 * med) or (first or 0) > 20_000)
            self.rows.append({"l": k, "tags": own, "band": band, "dev": dev, "mass": (dev or 0) >= 8, "solo": dev == 1, "stressed": stressed, "failing": {m for l, m, _ in failures if l == k}})
        self.tags = sorted(stress)

    def sides(self, tag):
        on = [r for r in self.rows if tag in r["tags"]]
        bands = {r["band"] for r in on}
        return on, [r for r in self.rows if not r["tags"] and r["band"] in bands]

    def lift(self, tag, test):
        on, off = self.sides(tag)
        return None if not on or not off else sum(map(test, on)) / len(on) - sum(map(test, off)) / len(off)

    def enough(self, tag):
        on, off = self.sides(tag)
        return len(on) >= 8 and len(off) >= 8


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_axes_match_a_walk(spark, seed):
    data = drawn(seed)
    ledgers, tags, failures = frames(spark, *data)
    s, w = K.samples(ledgers, tags), Walk(*data)
    assert {(r.ledger, r.band, r.tags, r.mass, r.solo, r.stressed) for r in s.collect()} == {(r["l"], r["band"], len(r["tags"]), r["mass"], r["solo"], r["stressed"]) for r in w.rows}

    got = {r.tag: r for r in K.by_tag(s, tags).collect()}
    assert sorted(got) == w.tags
    for tag, r in got.items():
        on, off = w.sides(tag)
        d = w.lift(tag, lambda x: x["mass"])
        assert (r.exposed, r.control) == (len(on), len(off)) and r.lift == pytest.approx(d)
        assert r.verdict == grade(d, w.enough(tag), bool(off))

    own = {(r.master, r.tag): r for r in K.by_master(s, tags, failures).collect()}
    for m in {x for _, x, _ in data[2]}:
        for tag in w.tags:
            d = w.lift(tag, lambda x: m in x["failing"])
            if (m, tag) in own:
                assert own[m, tag].own_lift == pytest.approx(d) and own[m, tag].verdict == grade(own[m, tag].own_lift, w.enough(tag))
            else:
                assert d == 0

    net = K.network(s).first()
    mass, solo = [r for r in w.rows if r["mass"]], [r for r in w.rows if r["solo"]]
    assert (net.samples, net.mass, net.solo) == (len(w.rows), len(mass), len(solo))
    assert net.lift == pytest.approx(sum(bool(r["tags"]) for r in mass) / len(mass) - sum(bool(r["tags"]) for r in solo) / len(solo))
    assert sum(r.ledgers for r in K.failing_at_once(s).collect()) == sum(r["dev"] is not None for r in w.rows)
    for r in K.node_local(s, failures).collect():
        fell = [x for x in w.rows if r.master in x["failing"]]
        assert (r.own, r.stressed, r.quiet, r.solo_stressed) == (len(fell), sum(x["stressed"] for x in fell), sum(not x["stressed"] for x in fell), sum(x["stressed"] and x["solo"] for x in fell))

    top = K.peaks(s, failures, 4, 3).orderBy("place").collect()
    best = sorted((x for x in data[0] if (x[3] or 0) >= 8), key=lambda x: (-x[3], -(x[2] or -1), x[0]))[:4]
    assert [r.ledger for r in top] == [x[0] for x in best]
    for r in top:
        who = sorted({m for l, m, _ in data[2] if l == r.ledger})
        assert (list(r.masters), r.named_total, r.missing) == (who[:3], len(who), max(r.deviating, len(who)) - 3)


@pytest.mark.parametrize("seed", [4, 5, 6, 7])
def test_dose_matches_a_walk(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice([None, 3, 12, 30, 60, 150, 500, 9000]), r.random() < 0.3) for k in range(r.choice([20, 70, 120]))]
    got = K.dose(K.load_bands(spark.createDataFrame(rows, "ledger bigint, tx_count bigint, failed boolean"))).first()
    bands = {}
    for _, tx, failed in rows:
        n = bands.setdefault(sum((tx or 0) >= b for b in K.BOUNDS), [0, 0])
        n[0] += 1
        n[1] += failed
    kept = [bands[b] for b in sorted(bands) if bands[b][0] >= 8]
    assert (got.bands, got.thin) == (len(kept), len(bands) - len(kept))
    if len(kept) < 4:
        assert got.verdict == "insufficient-sample" and got.half_ratio is None
        return
    half = len(kept) // 2
    low, up = (sum(x[1] for x in p) / sum(x[0] for x in p) for p in (kept[:half], kept[-half:]))
    steps = [b[1] / b[0] - a[1] / a[0] for a, b in zip(kept, kept[1:])]
    assert (got.rising, got.falling) == (sum(d > 0 for d in steps), sum(d < 0 for d in steps))
    assert got.lower_rate == pytest.approx(low) and got.upper_rate == pytest.approx(up)
    want = "not-comparable" if low == 0 else "load-dose-rising" if up / low >= 1.5 else "load-dose-falling" if up / low <= 1 / 1.5 else "load-dose-flat"
    assert got.verdict == want


def test_population_takes_whole_days_only(spark):
    days = spark.createDataFrame([(d, 100, 10, d != 3) for d in range(6)], "day bigint, ledgers bigint, fails bigint, layered boolean")
    tags = spark.createDataFrame([(d, t, 20, 8) for d in range(6) for t in ("offer-flood", "load-spike")] + [(2, "nft-spam", 5, 5)], "day bigint, tag string, ledgers bigint, fails bigint")
    rows = {r.tag: r for r in K.population(days, tags, DAY // 2, 5 * DAY).collect()}  # days 1, 2 and 4
    assert sorted(rows) == ["nft-spam", "offer-flood"]
    r = rows["offer-flood"]
    assert (r.exposed, r.exposed_fails, r.control, r.control_fails, r.verdict) == (60, 24, 240, 6, "stress-coupled")
    assert rows["nft-spam"].verdict == "insufficient-sample"
    assert K.population(days, tags, 0, DAY // 2).count() == 0
    assert K.population(days, tags).where("tag = 'offer-flood'").first().exposed == 100


def planted(spark, ledgers, tags, failures, members):
    l, t, f = frames(spark, ledgers, tags, failures)
    s = K.samples(l, t)
    none = K.population(spark.createDataFrame([], "day bigint, ledgers bigint, fails bigint, layered boolean"), spark.createDataFrame([], "day bigint, tag string, ledgers bigint, fails bigint"))
    who = spark.createDataFrame([(m,) for m in members], "master string")
    return {r.master: r for r in K.verdicts(who, K.by_tag(s, t), K.by_master(s, t, f), K.network(s), none, K.node_local(s, f)).collect()}


def row(k, deviating, tx=5, first=None):
    return (k, k, tx, deviating, None, None, None, True, None, None, first)


def test_verdicts(spark):
    # A fails under a tag only, B alone in every calm ledger under late first votes, C never
    tagged, calm = range(10), range(10, 30)
    ledgers = [row(k, 1) for k in tagged] + [row(k, 1, first=60_000) for k in calm]
    got = planted(spark, ledgers, [(k, "offer-flood") for k in tagged], [(k, "A", "missed") for k in tagged] + [(k, "B", "missed") for k in calm], "ABC")
    assert (got["A"].verdict, got["A"].axis, got["A"].reason, got["A"].node_axis) == ("stress-coupled", "node", "node-lift-plus-100-points-under-offer-flood", "stress-coupled")
    assert (got["B"].verdict, got["B"].axis) == ("node-local-under-stress", "node")
    assert (got["C"].verdict, got["C"].axis, got["C"].node_axis, got["C"].population_axis) == ("no-coupling-measured", "none", "no-coupling-measured", "not-recorded")
    # many at once under a tag: the mass and the network axis agree, and the tag's name decides between equal differences
    got = planted(spark, [row(k, 9 if k < 10 else 1) for k in range(20)], [(k, "offer-flood") for k in range(10)], [], "A")
    assert (got["A"].axis, got["A"].tag, got["A"].mass_axis, got["A"].network_axis) == ("mass", "offer-flood", "stress-coupled", "stress-coupled")
    assert planted(spark, [], [], [], "A")["A"].reason == "no-ledger-forensics-row-in-this-window"
    got = planted(spark, [row(k, 0) for k in range(3)], [], [], "A")["A"]
    assert (got.verdict, got.axis, got.network_axis) == ("insufficient-sample", "sample", "insufficient-sample")


def test_gaps(spark):
    ledgers, tags, failures = frames(spark, [row(0, 2), row(1, None)], [], [(0, "A", "missed"), (7, "A", "missed")])
    days = spark.createDataFrame([(0, 2, 1, True), (1, 2, 1, False)], "day bigint, ledgers bigint, fails bigint, layered boolean")
    axis = K.population(days, spark.createDataFrame([], "day bigint, tag string, ledgers bigint, fails bigint"))
    got = {r.gap: r.rows for r in K.gaps(K.samples(ledgers, tags), failures, days, axis).collect()}
    assert got == {"forensics-row-missing": 1, "cohort-membership-derived": 1, "vote-latency-not-recorded": 2, "cadence-not-recorded": 2, "cohort-masters-incomplete": 1, "sample-too-small": 2, "population-counters-missing": 2}
    assert math.isclose(K.load_bands(ledgers.select("ledger", "tx_count", F.lit(True).alias("failed"))).first().rate, 1)
