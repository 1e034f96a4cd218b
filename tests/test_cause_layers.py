"""Each layer of the cause ranking with a guard beside it, and merging, weights and checks against a plain version over random facts."""

import random

import pytest

from ledgerloom.operators import cause_layers as L

SCHEMA = (
    "id long, type string, scope string, hypotheses array<struct<tag:string,strength:string,reliable:boolean,size:bigint>>, known_quorum boolean, closed boolean, capture_gap boolean, critical boolean, margin long, band_rate double, overall_rate double, band_reliable boolean, "
    "vote_delay_ms long, tx_count long, load_bucket long, base_bucket long, own_rate double, base_rate double, load_thin boolean, resilient boolean, co_share double, peer_verdict string, lineage string, hour_ledgers long, signature_ledgers long, "
    "trace_attack boolean, history_attack boolean, quiet boolean, control string, peak_incidents long"
)
NAMES = [c.strip().split(" ")[0] for c in SCHEMA.replace("array<struct<tag:string,strength:string,reliable:boolean,size:bigint>>", "x").split(",")]


def rows(spark, facts):
    return spark.createDataFrame([tuple({"id": k, "type": "missed", **f}.get(n) for n in NAMES) for k, f in enumerate(facts)], SCHEMA)


def tags(spark, facts):
    return [{(c.tag, c.kind, c.strength) for c in r.candidates} for r in L.ranked(rows(spark, facts), most=99).orderBy("id").collect()]


LOAD = {"tx_count": 90, "load_bucket": 3, "base_bucket": 2, "own_rate": 0.06, "base_rate": 0.03}
BAND = {"known_quorum": True, "critical": False, "band_reliable": True, "overall_rate": 0.1}
HOUR = {"hour_ledgers": 60, "signature_ledgers": 3}
CASES = [  # (facts, a candidate they give, facts beside them that do not)
    ({"type": "vote-not-observed"}, ("vote-not-observed", "cause", "measured"), {"type": "partial"}),
    ({"type": "no-quorum", "closed": False}, ("network-stall", "cause", "measured"), {"type": "no-quorum"}),
    ({"hypotheses": [("hash-split", "cohort", None, None)]}, ("hash-split", "cause", "correlated"), {"hypotheses": [("no-correlated-cause", "measured", None, None)]}),
    ({"hypotheses": [("cohort-event", "measured", None, None)]}, ("cohort-event", "category", "measured"), {"hypotheses": []}),
    ({"vote_delay_ms": 20_001}, ("vote-late", "cause", "measured"), {"vote_delay_ms": 20_000}),
    ({"known_quorum": True, "critical": True}, ("quorum-critical", "consequence", "measured"), {"critical": True}),
    ({"known_quorum": True}, ("quorum-follow-on", "exoneration", "measured"), {}),
    ({**BAND, "band_rate": 0.15}, ("quorum-band-risk", "cause", "corroborated"), {**BAND, "band_rate": 0.149}),
    ({**BAND, "band_rate": 0.05}, ("quorum-band-comfort", "exoneration", "corroborated"), {**BAND, "band_rate": 0.05, "band_reliable": False}),
    (LOAD, ("load-coupled", "cause", "corroborated"), {**LOAD, "base_rate": 0.031}),
    ({**LOAD, "base_rate": None}, ("load-coupled", "cause", "corroborated"), {**LOAD, "load_thin": True}),
    ({**LOAD, "load_bucket": 2, "resilient": True}, ("load-independent", "exoneration", "corroborated"), {**LOAD, "tx_count": None, "load_bucket": 2, "resilient": True}),
    ({"co_share": 0.5}, ("network-window-localization", "localization", "corroborated"), {"co_share": 0.49}),
    ({"co_share": 0.049}, ("node-local-window", "localization", "correlated"), {"co_share": 0.05, "scope": "solo"}),
    ({"scope": "solo"}, ("node-local-window", "localization", "correlated"), {"scope": "cohort"}),
    ({"peer_verdict": "outlier"}, ("node-local-window", "localization", "context"), {"peer_verdict": "insufficient-sample"}),
    ({"peer_verdict": "peer-baseline"}, ("network-window-localization", "localization", "context"), {"peer_verdict": "not-observed"}),
    ({"lineage": "runner"}, ("hash-divergence", "cause", "measured"), {"lineage": "other"}),
    ({"lineage": "accepted"}, ("signed-accepted-lineage", "exoneration", "measured"), {}),
    ({**HOUR, "control": "attack-linked"}, ("attack-window", "cause", "corroborated"), {**HOUR, "hour_ledgers": 59, "control": "attack-linked"}),
    ({"history_attack": True}, ("attack-window", "cause", "context"), {**HOUR, "signature_ledgers": 2}),
    ({**HOUR, "signature_ledgers": 2, "quiet": True}, ("attack-window-clear", "exoneration", "corroborated"), {**HOUR, "signature_ledgers": 2}),
    ({"quiet": True}, ("attack-window-clear", "exoneration", "correlated"), {**HOUR, "quiet": True}),
    ({"peak_incidents": 5}, ("recurrent-hour", "cause", "correlated"), {"peak_incidents": 4}),
]


def test_each_layer_has_a_guard(spark):
    got = tags(spark, [f for hit, _, guard in CASES for f in (hit, guard)])
    for k, (_, want, _) in enumerate(CASES):
        assert want in got[2 * k] and want not in got[2 * k + 1], CASES[k]


def plain(f):
    """Candidates, verdict and checks of one row, one step after the other."""
    found = []
    add = lambda tag, kind, strength, layer, reliable=None, size=None: found.append((tag, kind, strength, layer, reliable, size))
    g = lambda n: f.get(n)
    for tag, strength, reliable, size in g("hypotheses") or []:
        if tag != "no-correlated-cause":
            add(tag, "category" if tag in ("solo-failure", "cohort-event") else "cause", strength if strength in ("measured", "none") else "correlated", "series" if tag in L.SERIES else "ledger", reliable, size)
    if g("type") in ("no-quorum", "vote-not-observed"):
        add("vote-not-observed", "cause", "measured", "ledger")
        if g("closed") is False:
            add("network-stall", "cause", "measured", "ledger")
    if (g("vote_delay_ms") or 0) > 20_000:
        add("vote-late", "cause", "measured", "timing")
    if g("known_quorum"):
        add(*(("quorum-critical", "consequence") if g("critical") else ("quorum-follow-on", "exoneration")), "measured", "quorum")
        if g("band_reliable") and g("band_rate") is not None and (g("overall_rate") or 0) > 0:
            lift = round(g("band_rate") / g("overall_rate"), 4)
            if lift >= 1.5:
                add("quorum-band-risk", "cause", "corroborated", "quorum")
            elif lift <= 0.5:
                add("quorum-band-comfort", "exoneration", "corroborated", "quorum")
    if None not in (g("tx_count"), g("load_bucket"), g("base_bucket")):
        if g("load_bucket") <= g("base_bucket"):
            add("load-independent", "exoneration", "corroborated" if g("resilient") else "correlated", "load")
        elif not g("load_thin") and g("own_rate") is not None and g("own_rate") >= 0.05 and (not g("base_rate") or g("own_rate") >= 2 * g("base_rate")):
            add("load-coupled", "cause", "corroborated", "load")
    share = g("co_share")
    if share is not None:
        if share >= 0.5:
            add("network-window-localization", "localization", "corroborated", "peer")
        elif share < 0.05:
            add("node-local-window", "localization", "correlated", "peer")
    elif g("scope") == "solo":
        add("node-local-window", "localization", "correlated", "peer")
    elif g("scope") == "network":
        add("network-window-localization", "localization", "corroborated", "peer")
    if g("peer_verdict") not in (None, "insufficient-sample", "not-observed"):
        add("network-window-localization" if g("peer_verdict") == "peer-baseline" else "node-local-window", "localization", "context", "peer")
    if g("lineage") in ("own", "runner"):
        add("hash-divergence", "cause", "measured", "lineage")
    elif g("lineage") == "accepted":
        add("signed-accepted-lineage", "exoneration", "measured", "lineage")
    thick = (g("hour_ledgers") or 0) >= 60
    if (thick and (g("signature_ledgers") or 0) >= 3) or g("history_attack"):
        add("attack-window", "cause", "corroborated" if g("control") == "attack-linked" else "context", "attack")
    elif g("quiet"):
        calm = thick and g("signature_ledgers") is not None and not g("trace_attack")
        add("attack-window-clear", "exoneration", "corroborated" if calm else "correlated", "attack")
    if (g("peak_incidents") or 0) >= 5:
        add("recurrent-hour", "cause", "correlated", "hour", None, g("peak_incidents"))
    out = []
    for tag, kind in dict.fromkeys(c[:2] for c in found):
        own = [c for c in found if c[:2] == (tag, kind)]
        strength = max((c[2] for c in own), key=L.STRENGTH.get)
        size = next((c[5] for c in own if c[5] is not None), None)
        w = L.STRENGTH[strength] + (len({c[3] for c in own}) >= 2) + bool(next((c[4] for c in own if c[4] is not None), False))
        if tag in L.GROWING and size is not None:
            w += 2 if size >= 15 else 1 if size >= 5 else 0
        w += tag == "recurrent-hour" and (size or 0) >= 20
        w = 0 if kind == "category" else max(0, w - (kind == "exoneration"))
        out.append((-w, L.KINDS.index(kind), tag, kind, strength))
    out.sort()
    head = next((c for c in out if c[3] in ("cause", "localization") and c[0] <= -2), None)
    checks = []
    for c in [head] * bool(head) + [c for c in out if c[0] <= -3 and not (head and c[2] == head[2])]:
        for x in L.CHECKS.get(c[2], "").split():
            if x == "network-stall" and g("closed") is not False and not (c[2] == "close-gap" and g("capture_gap") is False):
                continue
            if f"cause-check-{x}" not in checks:
                checks.append(f"cause-check-{x}")
    if head is None:
        checks.append("cause-check-unknown")
    return head[2] if head else "unexplained", [(c[2], c[3], c[4], -c[0]) for c in out[:6]], len(out), checks[:8]


def test_ranking_equals_a_plain_version(spark):
    r = random.Random(11)
    pick = lambda *x: r.choice([None, *x])
    made = [
        {
            "type": r.choice(["missed", "no-quorum", "vote-not-observed", "partial"]), "scope": pick("solo", "network", "cohort"), "closed": pick(True, False), "capture_gap": pick(True, False), "known_quorum": pick(True, False), "critical": pick(True, False), "band_rate": pick(0.01, 0.2),
            "hypotheses": pick([], [(r.choice(["offline-window", "close-gap", "solo-failure", "hash-divergence", "vote-not-observed", "no-correlated-cause", "odd"]), r.choice(["measured", "cohort", "none", "correlated"]), pick(True, False), pick(2, 5, 15)) for _ in range(r.randint(1, 3))]),
            "overall_rate": pick(0.0, 0.1), "band_reliable": pick(True, False), "vote_delay_ms": pick(5, 30_000), "tx_count": pick(5), "load_bucket": pick(1, 3), "base_bucket": pick(1, 2), "own_rate": pick(0.01, 0.2), "base_rate": pick(0.0, 0.05, 0.15), "load_thin": pick(True, False),
            "resilient": pick(True, False), "co_share": pick(0.01, 0.2, 0.7), "peer_verdict": pick("peer-baseline", "outlier", "not-observed"), "lineage": pick("own", "accepted", "other"), "hour_ledgers": pick(10, 90), "signature_ledgers": pick(0, 9), "trace_attack": pick(True, False),
            "history_attack": pick(True, False), "quiet": pick(True, False), "control": pick("attack-linked", "no-link"), "peak_incidents": pick(3, 8, 25),
        }
        for _ in range(300)
    ]
    got = L.ranked(rows(spark, made)).orderBy("id").collect()
    for f, x in zip(made, got):
        assert (x.verdict, [(c.tag, c.kind, c.strength, c.weight) for c in x.candidates], x.candidate_total, x.checks) == plain(f), f
    assert {x.confidence for x in got} == {"high", "medium", "low", "none"} and any(x.verdict == "unexplained" for x in got)
    assert all(("vote-lineage" in x.data_gaps) == (f["lineage"] is None) for f, x in zip(made, got))
    assert L.ranked(rows(spark, [])).collect() == []
