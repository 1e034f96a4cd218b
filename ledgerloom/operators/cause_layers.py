"""Ranked causes of an incident from nine layers of evidence, merged by tag and kind; a map over rows, without a shuffle.

facts has a row for each incident with what the layers know of it; a null is "not measured" and lands in the data gaps,
never in a verdict. Columns: type, scope, hypotheses (array of tag, strength, reliable, size), known_quorum, closed, capture_gap,
critical, margin, band_rate, overall_rate, band_reliable, vote_delay_ms, tx_count, load_bucket, base_bucket, own_rate, base_rate,
load_thin, resilient, co_share, peer_verdict, lineage, hour_ledgers, signature_ledgers, trace_attack, history_attack, quiet, control,
peak_incidents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Points of a strength, order of the kinds, the layers.
STRENGTH = {"measured": 4, "corroborated": 3, "correlated": 2, "context": 1, "none": 0}
KINDS = ["cause", "localization", "consequence", "exoneration", "category"]
LAYERS = ["ledger", "series", "quorum", "load", "peer", "hour", "attack", "lineage", "timing"]
#: Tags of the series layer, of which the long ones earn more with their length, and the checks that a tag asks for.
SERIES = ["offline-window", "brief-outage", "short-series", "degraded-window", "degraded-single", "cohort-window", "network-window", "capture-window", "vote-not-observed", "hash-divergence", "isolated-miss"]
GROWING = ["offline-window", "brief-outage", "short-series", "degraded-window", "cohort-window", "network-window"]
CHECKS = {
    "offline-window": "uptime resources", "brief-outage": "uptime resources", "short-series": "uptime", "degraded-window": "load-ceiling version", "degraded-single": "load-ceiling version", "cohort-window": "peer-audit network-stall",
    "network-window": "network-stall", "network-stall": "network-stall", "vote-not-observed": "capture-window peer-audit", "capture-window": "capture-window peer-audit", "hash-divergence": "version peer-audit", "isolated-miss": "uptime",
    "node-local-window": "uptime peer-audit", "network-window-localization": "network-stall peer-audit", "quorum-thin": "quorum-settings", "quorum-critical": "quorum-settings", "quorum-follow-on": "", "quorum-band-risk": "quorum-settings peer-audit",
    "quorum-band-comfort": "uptime resources", "hash-split": "version peer-audit", "load-spike": "load-ceiling resources", "load-extreme": "load-ceiling resources", "load-coupled": "load-ceiling resources", "load-independent": "uptime",
    "close-gap": "network-stall", "vote-late": "clock load-ceiling", "recurrent-hour": "uptime clock", "attack-window": "attack-ledger", "attack-window-clear": "", "sweep-window": "attack-ledger", "drainer-fanout": "attack-ledger",
    "sender-burst": "attack-ledger", "offer-flood": "attack-ledger", "nft-spam": "attack-ledger", "account-create-burst": "attack-ledger", "failure-spike": "attack-ledger", "batch-amplify": "attack-ledger", "fee-spike": "attack-ledger",
    "new-tx-type": "version", "amendment-activity": "version", "unl-change": "version", "signed-different-hash": "version", "solo-failure": "uptime resources", "cohort-event": "peer-audit",
}
_CANDIDATE = "struct<tag:string,kind:string,strength:string,layer:string,reliable:boolean,size:bigint>"


def _c(tag, kind: str, strength, layer, reliable=None, size=None) -> Column:
    as_col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(as_col(tag, "string").alias("tag"), as_col(kind, "string").alias("kind"), as_col(strength, "string").alias("strength"), as_col(layer, "string").alias("layer"), as_col(reliable, "boolean").alias("reliable"), as_col(size, "bigint").alias("size"))


def _yes(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _gap(name: str, cond: Column) -> Column:
    return F.when(cond, F.lit(name))


def hypotheses_layer() -> Column:
    """Tags of the ledger and of the series as the retrace gives them; cohort strength counts as correlated, tags of scope as categories."""
    kept = F.filter("hypotheses", lambda h: h["tag"] != "no-correlated-cause")
    strength = lambda h: F.when(h["strength"].isin("measured", "correlated", "none"), h["strength"]).otherwise("correlated")
    kind = lambda h: F.when(h["tag"].isin("solo-failure", "cohort-event"), "category").otherwise("cause")
    return F.coalesce(F.transform(kept, lambda h: _c(h["tag"], kind(h), strength(h), F.when(h["tag"].isin(SERIES), "series").otherwise("ledger"), h["reliable"], h["size"])), F.array().cast(f"array<{_CANDIDATE}>"))


def ledger_layer() -> list[Column]:
    unseen = F.col("type").isin("no-quorum", "vote-not-observed")
    return [F.when(unseen, _c("vote-not-observed", "cause", "measured", "ledger")), F.when(unseen & _yes(~F.col("closed")), _c("network-stall", "cause", "measured", "ledger"))]


def timing_layer(grace_ms: int) -> list[Column]:
    return [F.when(F.col("vote_delay_ms") > grace_ms, _c("vote-late", "cause", "measured", "timing"))]


def quorum_layer(risk: float, comfort: float) -> list[Column]:
    known = _yes("known_quorum")
    usable = known & _yes("band_reliable") & F.col("band_rate").isNotNull() & _yes(F.col("overall_rate") > 0)
    lift = F.round(F.col("band_rate") / F.col("overall_rate"), 4)
    return [
        F.when(known & _yes("critical"), _c("quorum-critical", "consequence", "measured", "quorum")), F.when(known & ~_yes("critical"), _c("quorum-follow-on", "exoneration", "measured", "quorum")),
        F.when(usable & (lift >= risk), _c("quorum-band-risk", "cause", "corroborated", "quorum")), F.when(usable & (lift <= comfort), _c("quorum-band-comfort", "exoneration", "corroborated", "quorum")),
    ]


def _load_known() -> Column:
    return F.col("tx_count").isNotNull() & F.col("load_bucket").isNotNull() & F.col("base_bucket").isNotNull()


def load_layer(least: float, ratio: float) -> list[Column]:
    above = F.col("load_bucket") > F.col("base_bucket")
    coupled = above & ~_yes("load_thin") & _yes(F.col("own_rate") >= least) & (F.coalesce(F.col("base_rate"), F.lit(0.0)).eqNullSafe(F.lit(0.0)) | _yes(F.col("own_rate") >= F.col("base_rate") * ratio))
    return [F.when(_load_known() & coupled, _c("load-coupled", "cause", "corroborated", "load")), F.when(_load_known() & ~above, _c("load-independent", "exoneration", F.when(_yes("resilient"), "corroborated").otherwise("correlated"), "load"))]


def peer_layer(few: float, many: float) -> list[Column]:
    share, none = F.col("co_share"), F.col("co_share").isNull()
    judged = _yes(~F.col("peer_verdict").isin("insufficient-sample", "not-observed"))
    wide = lambda strength: _c("network-window-localization", "localization", strength, "peer")
    own = lambda strength: _c("node-local-window", "localization", strength, "peer")
    return [
        F.when(share >= many, wide("corroborated")).when(share < few, own("correlated")).when(none & (F.col("scope") == "solo"), own("correlated")).when(none & (F.col("scope") == "network"), wide("corroborated")),
        F.when(judged, F.when(F.col("peer_verdict") == "peer-baseline", wide("context")).otherwise(own("context"))),
    ]


def lineage_layer() -> list[Column]:
    return [F.when(F.col("lineage").isin("own", "runner"), _c("hash-divergence", "cause", "measured", "lineage")).when(F.col("lineage") == "accepted", _c("signed-accepted-lineage", "exoneration", "measured", "lineage"))]


def _attack(signature: int, cell: int) -> tuple[Column, Column, Column]:
    """(attacked, quiet by the trace, quiet by the control's head)."""
    thick, signed = _yes(F.col("hour_ledgers") >= cell), F.col("signature_ledgers").isNotNull()
    attacked = (signed & _yes(F.col("signature_ledgers") >= signature) & thick) | _yes("history_attack")
    return attacked, signed & thick & ~_yes("trace_attack") & _yes(F.col("signature_ledgers") < signature), _yes("quiet")


def attack_layer(signature: int, cell: int) -> list[Column]:
    attacked, calm, head = _attack(signature, cell)
    linked = F.when(F.col("control") == "attack-linked", "corroborated").otherwise("context")
    return [F.when(attacked, _c("attack-window", "cause", linked, "attack")).when(head, _c("attack-window-clear", "exoneration", F.when(calm, "corroborated").otherwise("correlated"), "attack"))]


def hour_layer(least: int) -> list[Column]:
    return [F.when(F.col("peak_incidents") >= least, _c("recurrent-hour", "cause", "correlated", "hour", size=F.col("peak_incidents")))]


def ranked(facts: DataFrame, grace_ms: int = 20_000, few: float = 0.05, many: float = 0.5, load_rate: float = 0.05, load_ratio: float = 2.0, band_risk: float = 1.5, band_comfort: float = 0.5, signature: int = 3, cell: int = 60, peak: int = 5, most: int = 6, most_checks: int = 8) -> DataFrame:
    """facts with verdict, verdict_kind, verdict_strength, confidence, verdict_layers, candidates, candidate_total, checks and data_gaps.

    Candidates of one tag and kind are one: its strongest strength, all its layers, the first lift and size. Weight: points of
    the strength, one more for two layers, for a reliable lift, for a peak of 20 or a series of 5 (two from 15 on), one less for what exonerates; categories weigh 0.
    6 is high, 4 medium, 2 low. The verdict is the heaviest cause or localization that weighs 2 or more, ties by kind, then tag; else `unexplained`.
    """
    found = [*ledger_layer(), *timing_layer(grace_ms), *quorum_layer(band_risk, band_comfort), *load_layer(load_rate, load_ratio), *peer_layer(few, many), *lineage_layer(), *attack_layer(signature, cell), *hour_layer(peak)]
    rows = facts.withColumn("_c", F.concat(hypotheses_layer(), F.array_compact(F.array(*found))))
    points = F.create_map(*(F.lit(x) for kv in STRENGTH.items() for x in kv))
    by_points = F.create_map(*(F.lit(x) for k, v in STRENGTH.items() for x in (v, k)))

    def merged(key: Column) -> Column:
        own = F.filter("_c", lambda c: (c["tag"] == key["tag"]) & (c["kind"] == key["kind"]))
        layers = F.array_distinct(F.transform(own, lambda c: c["layer"]))
        strength = F.array_max(F.transform(own, lambda c: points[c["strength"]]))
        first = lambda name: F.get(F.filter(F.transform(own, lambda c: c[name]), lambda x: x.isNotNull()), F.lit(0))
        size = first("size")
        growth = F.when(key["tag"].isin(GROWING), F.when(size >= 15, 2).when(size >= 5, 1)).when(key["tag"] == "recurrent-hour", F.when(size >= 20, 1))
        weight = strength + (F.size(layers) >= 2).cast("int") + _yes(first("reliable")).cast("int") + F.coalesce(growth, F.lit(0)) - (key["kind"] == "exoneration").cast("int")
        weight = F.when(key["kind"] == "category", 0).otherwise(F.greatest(weight, F.lit(0)))
        place = F.array_position(F.lit(KINDS), key["kind"])
        confidence = F.when(weight >= 6, "high").when(weight >= 4, "medium").when(weight >= 2, "low").otherwise("none")
        return F.struct((-weight).alias("less"), place.alias("place"), key["tag"].alias("tag"), key["kind"].alias("kind"), by_points[strength].alias("strength"), layers.alias("layers"), weight.alias("weight"), confidence.alias("confidence"))

    keys = F.array_distinct(F.transform("_c", lambda c: F.struct(c["tag"].alias("tag"), c["kind"].alias("kind"))))
    rows = rows.withColumn("_keys", keys).withColumn("_m", F.array_sort(F.transform("_keys", merged)))
    head = F.get(F.filter("_m", lambda c: c["kind"].isin("cause", "localization") & (c["confidence"] != "none")), F.lit(0))
    rows = rows.withColumn("_h", head)
    stall = F.coalesce(~F.col("closed"), F.lit(False))
    asked = F.create_map(*(F.lit(x) for tag, names in CHECKS.items() for x in (tag, " ".join(f"cause-check-{n}" for n in names.split()))))
    of = lambda tag: F.filter(F.split(F.coalesce(F.try_element_at(asked, tag), F.lit("")), " "), lambda c: (c != "") & (stall | (c != "cause-check-network-stall") | ((tag == "close-gap") & _yes(~F.col("capture_gap")))))
    none = F.array().cast("array<string>")
    heavy = F.filter("_m", lambda c: (c["weight"] >= 3) & ~c["tag"].eqNullSafe(F.col("_h.tag")))
    checks = F.array_distinct(F.concat(F.when(F.col("_h").isNotNull(), of(F.col("_h.tag"))).otherwise(none), F.flatten(F.transform(heavy, lambda c: of(c["tag"]))), F.when(F.col("_h").isNull(), F.array(F.lit("cause-check-unknown"))).otherwise(none)))
    attacked, _, head_quiet = _attack(signature, cell)
    usable_band = _yes("band_reliable") & F.col("band_rate").isNotNull() & _yes(F.col("overall_rate") > 0)
    gaps = F.array_compact(F.array(
        _gap("attack-hours", ~attacked & ~head_quiet & (F.col("hour_ledgers").isNull() | (F.col("signature_ledgers").isNull() & ~_yes("trace_attack")))), _gap("load-axis", ~_load_known()), _gap("quorum-band-rate", _yes("known_quorum") & ~usable_band),
        _gap("quorum-counterfactual", ~_yes("known_quorum")), _gap("vote-lineage", F.col("lineage").isNull()), _gap("vote-timing", F.col("vote_delay_ms").isNull() & (F.col("type") == "missed")),
    ))
    return rows.select(
        *facts.columns, F.coalesce("_h.tag", F.lit("unexplained")).alias("verdict"), F.coalesce("_h.kind", F.lit("none")).alias("verdict_kind"), F.coalesce("_h.strength", F.lit("none")).alias("verdict_strength"), F.coalesce("_h.confidence", F.lit("none")).alias("confidence"),
        F.coalesce("_h.layers", none).alias("verdict_layers"), F.transform(F.slice("_m", 1, most), lambda c: F.struct(c["tag"].alias("tag"), c["kind"].alias("kind"), c["strength"].alias("strength"), c["weight"].alias("weight"), c["confidence"].alias("confidence"))).alias("candidates"),
        F.size("_m").cast("bigint").alias("candidate_total"), F.slice(checks, 1, most_checks).alias("checks"), gaps.alias("data_gaps"),
    )
