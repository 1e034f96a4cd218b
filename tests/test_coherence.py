"""Every check holds on sound layers, breaks on a planted contradiction, and says so where it can't be checked."""

import pytest

from ledgerloom.operators import coherence as C

ROW = "ledger bigint, master string, hash string, closed boolean, votes bigint, needed bigint, top bigint, margin bigint, capture_gap boolean, gap_basis string, members bigint, absent bigint, genuine_most bigint, artifact_least bigint, critical boolean, verdict string, affected bigint, named bigint"
SOUND = dict(ledger=1, master="A", hash="H", closed=True, votes=30, needed=28, top=30, margin=2, capture_gap=False, gap_basis="ledger-index", members=35, absent=9, genuine_most=7, artifact_least=2, critical=False, verdict="closed-quorum-observed", affected=3, named=2)


def frame(spark, *changes):
    rows = [{**SOUND, **c} for c in changes]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ROW)


def verdict(frames):
    return {r.check: r.verdict for r in C.total([C.judged(df, rules) for df, rules in frames]).collect()}


@pytest.mark.parametrize("check,change", [
    ("A", {"gap_basis": None}), ("A", {"gap_basis": "guessed"}), ("A", {"capture_gap": None}), ("A", {"gap_basis": "not-recorded"}), ("D", {"genuine_most": 8}), ("D", {"artifact_least": None}), ("D", {"absent": None}),
    ("E", {"critical": True}), ("E", {"verdict": "not-closed"}), ("E", {"closed": False}), ("F", {"affected": 2}),
])
def test_rows(spark, check, change):
    sound = verdict([(frame(spark, {}), C.row_rules())])
    assert {k for k, v in sound.items() if v == "held"} == set("ADEF") and {k for k, v in sound.items() if v == "not-checkable"} == set("BCGHIJK")
    df = frame(spark, {}, {**change, "ledger": 2})
    assert verdict([(df, C.row_rules())])[check] == "broken"
    assert (check, 2, "A") in {tuple(r) for r in C.violations(df, C.row_rules(), "ledger", "master").collect()}


def test_unknown_is_never_a_statement(spark):
    unknown = frame(spark, {"closed": None, "verdict": None, "critical": None, "capture_gap": None, "gap_basis": "not-recorded", "affected": None, "genuine_most": None})
    got = verdict([(unknown, C.row_rules())])
    assert got["A"] == "held" and {got[k] for k in "DEF"} == {"not-checkable"}
    assert set(verdict([(frame(spark), C.row_rules())]).values()) == {"not-checkable"}


def test_layers_and_masters_agree(spark):
    rows = frame(spark, {}, {"master": "B"}, {"ledger": 2, "hash": None, "capture_gap": None, "gap_basis": "not-recorded"})
    layers = lambda *r: spark.createDataFrame([*r], "layer string, ledger bigint, master string, hash string, capture_gap boolean")
    assert verdict([C.layer_pairs(rows, layers(("retrace", 1, "A", "H", False), ("cause", 2, "A", None, None)))])["B"] == "held"
    for theirs in (("cause", 1, "A", "X", False), ("cause", 1, "B", "H", None), ("cause", 2, "A", None, False)):
        assert verdict([C.layer_pairs(rows, layers(theirs))])["B"] == "broken"
    assert verdict([C.layer_pairs(rows, layers())])["B"] == "not-checkable"
    assert verdict([C.ledger_facts(rows)])["C"] == "held"
    for name, other in (("hash", None), ("closed", None), ("margin", 3), ("capture_gap", None), ("gap_basis", "stream-gap")):
        assert verdict([C.ledger_facts(rows.unionByName(frame(spark, {"master": "C", name: other})))])["C"] == "broken"
    assert verdict([C.ledger_facts(frame(spark, {}))])["C"] == "not-checkable"


def test_claims_openings_misses_tags_and_quorum(spark):
    claims = lambda total: [(spark.createDataFrame([("A", 3, 2, None, 1, 0, total)], "master string, attributable_most bigint, artifact_least bigint, open bigint, statements bigint, late bigint, claims bigint"), C.claim_rules())]
    assert [verdict(claims(x))["G"] for x in (6, 7, None)] == ["held", "broken", "not-checkable"]

    def h(flags, opened):
        return verdict([C.openings(spark.createDataFrame(flags, "day bigint, ledger bigint, t_ms bigint"), spark.createDataFrame(opened, "day bigint, t_ms bigint, truncated boolean"))])["H"]

    assert h([(1, 5, 10), (1, 9, 30)], [(1, 10, False), (1, 20, False), (1, 25, False)]) == "held"
    assert h([(1, 5, 10)], [(1, 11, False)]) == h([(1, 5, 10), (1, 6, 12)], [(1, 9, False)]) == h([(1, 5, 10)], [(2, 9, False)]) == "broken"
    assert h([(1, 5, 10)], [(1, 11, True)]) == h([], [(1, 1, False)]) == "not-checkable"

    def i(incidents, counters):
        return verdict(C.misses(spark.createDataFrame(incidents, "day bigint, ledger bigint, master string, type string, proven boolean"), spark.createDataFrame(counters, "day bigint, master string, missed bigint")))["I"]

    assert i([(1, 5, "A", "missed", True), (1, 6, "A", "partial", None)], [(1, "A", 1)]) == i([(1, 5, "A", "missed", True)], []) == "held"
    assert i([(1, 5, "A", "missed", None)], [(1, "A", 1)]) == i([(1, 5, "A", "missed", True)], [(1, "A", 2)]) == i([], [(1, "A", 1)]) == "broken"
    assert i([(1, 6, "A", "partial", None)], []) == "not-checkable"

    def j(reasons, counters):
        return verdict([C.tag_cover(spark.createDataFrame(reasons, "day bigint, ledger bigint, tag string"), spark.createDataFrame(counters, "day bigint, tag string, fails bigint, shown boolean"))])["J"]

    assert j([(1, 5, "t"), (1, 5, "t")], [(1, "t", 1, True)]) == j([(1, 5, "t"), (1, 6, "t")], [(1, "t", 1, False)]) == "held"
    assert j([(1, 5, "t"), (1, 6, "t")], [(1, "t", 1, True)]) == j([], [(1, "no-quorum", 1, True)]) == "broken"

    k = lambda *day: verdict([(spark.createDataFrame([(1, *day)], "day bigint, quorum_fails bigint, rows bigint, gap_named boolean"), C.quorum_rules())])["K"]
    assert [k(3, 3, False), k(3, 1, True), k(3, None, True)] == ["held"] * 3
    assert [k(3, 1, False), k(3, 3, True), k(1, 2, None)] == ["broken"] * 3 and k(None, 1, True) == "not-checkable"
