"""Whether the layers contradict each other: eleven checks, each held, broken, or not checkable where nothing could be held against it.

Rules are (check, applies, broken), conditions over the rows of one frame; a condition that is null does not apply or is not
broken. `judged` counts all rules of a frame in one pass, `violations` names the rows; `total` adds frames and parts up.

A three values of capture gaps and their basis; B the layers' closing hash and capture gap agree; C every master is told the same
of a ledger; D bounds of absence; E verdicts fit the closing; F affected masters are counted with the own one; G claims add
up; H a gap after a subscription has an opening of its own; I a miss has its proof and its counter; J counters of tags cover
the failures that name them before a rate is shown; K unattributed quorum failures are a named gap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Bases of a capture gap that are measured, verdicts of closed ledgers, and tags that are no features of a ledger.
MEASURED = ["ledger-index", "stream-gap", "stream-open"]
CLOSED_VERDICTS = ["closed-capture-gap", "closed-quorum-observed", "closed-reception-thin", "closed-observation-gap"]
OBSERVATION_TAGS = ["no-quorum", "vote-not-observed"]
CHECKS = "ABCDEFGHIJK"
#: What every master must be told alike of a ledger.
FACTS = ["hash", "closed", "votes", "needed", "top", "margin", "capture_gap", "gap_basis"]

Rule = tuple[str, Column, Column]


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def judged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(check, checked, broken), a row for each rule, from one pass over df."""
    one = df.agg(*(F.struct(F.lit(c).alias("check"), F.count_if(yes(a)).alias("checked"), F.count_if(yes(a) & yes(b)).alias("broken")).alias(f"r{k}") for k, (c, a, b) in enumerate(rules)))
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")


def violations(df: DataFrame, rules: list[Rule], *key: str) -> DataFrame:
    """(check, *key), a row for each rule that a row of df breaks."""
    found = F.array_compact(F.array(*(F.when(yes(a) & yes(b), F.lit(c)) for c, a, b in rules)))
    return df.select(F.explode(found).alias("check"), *key)


def row_rules() -> list[Rule]:
    """A, D, E, F over rows of criticality: (ledger, master, *FACTS, members, absent, genuine_most, artifact_least, critical, verdict, affected, named)."""
    c, closed = F.col, F.col("closed")
    basis, gap = c("gap_basis"), c("capture_gap")
    wrong_basis = basis.isNull() | ~basis.isin([*MEASURED, "not-recorded"]) | (gap.isNull() & (basis != "not-recorded")) | (gap.isNotNull() & ~basis.isin(MEASURED))
    most = F.greatest(F.lit(0), c("members") - c("needed"))
    least = F.greatest(F.lit(0), F.coalesce("absent", F.lit(0)) - most)
    verdict = F.coalesce("verdict", F.lit(""))
    return [
        ("A", F.lit(True), wrong_basis),
        ("D", closed & (c("members") > 0) & (c("needed") > 0), ~c("genuine_most").eqNullSafe(most) | ~c("artifact_least").eqNullSafe(least)),
        ("E", closed.isNotNull(), F.when(closed, yes(c("critical")) | ~verdict.isin(CLOSED_VERDICTS)).otherwise(verdict != "not-closed")),
        ("F", c("affected").isNotNull() & c("named").isNotNull(), c("affected") != c("named") + 1),
    ]


def layer_pairs(rows: DataFrame, layers: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """B: each layer's statement (layer, ledger, master, hash, capture_gap) beside the row's."""
    theirs = layers.select("layer", "ledger", "master", F.col("hash").alias("their_hash"), F.col("capture_gap").alias("their_gap"))
    j = rows.select("ledger", "master", "hash", "capture_gap").join(theirs, ["ledger", "master"])
    return j, [("B", F.lit(True), ~F.col("hash").eqNullSafe(F.col("their_hash")) | ~F.col("capture_gap").eqNullSafe(F.col("their_gap")))]


def ledger_facts(rows: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """C: of each ledger how many masters were told of it, and whether the same; least and largest facts are compared, nothing is gathered."""
    of = F.struct(*FACTS)
    by = rows.groupBy("ledger").agg(F.count("*").alias("told"), F.min(of).alias("a"), F.max(of).alias("b"))
    return by, [("C", F.col("told") > 1, ~F.col("a").eqNullSafe(F.col("b")))]


def claim_rules() -> list[Rule]:
    """G over attributions: (master, attributable_most, artifact_least, open, statements, late, claims)."""
    parts = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0)) for x in ("attributable_most", "artifact_least", "open", "statements", "late")))
    return [("G", F.col("claims").isNotNull(), parts != F.col("claims"))]


def openings(flags: DataFrame, opened: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """H: each flagged ledger (day, ledger, t_ms) with the number of the day's subscriptions (day, t_ms, truncated) opened up to it.

    Broken without one, or where an earlier flag has it; not checkable on days whose list was truncated.
    """
    cut = opened.groupBy("day").agg(F.bool_or("truncated").alias("cut"))
    both = flags.select("day", "ledger", "t_ms", F.lit(0).alias("opens")).unionByName(opened.select("day", F.lit(None).cast("bigint").alias("ledger"), "t_ms", F.lit(1).alias("opens")))
    w = Window.partitionBy("day").orderBy("t_ms", F.desc("opens"), "ledger").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("opening", F.sum("opens").over(w)).where("opens = 0")
    first = Window.partitionBy("day", "opening").orderBy("t_ms", "ledger")
    j = at.withColumn("k", F.row_number().over(first)).join(cut, "day", "left")
    return j.select("day", "ledger", "opening", "k", "cut"), [("H", ~F.coalesce("cut", F.lit(False)), (F.col("opening") == 0) | (F.col("k") > 1))]


def misses(incidents: DataFrame, counters: DataFrame) -> list[tuple[DataFrame, list[Rule]]]:
    """I: incidents (day, ledger, master, type, proven) of type missed need a proof, and as many as counters (day, master, missed) say."""
    missed = incidents.where("type = 'missed'")
    by = missed.groupBy("day", "master").agg(F.count("*").alias("listed"))
    j = by.join(counters, ["day", "master"], "full_outer").na.fill(0, ["listed"])
    return [(missed, [("I", F.lit(True), ~yes(F.col("proven")))]), (j, [("I", F.col("missed").isNotNull(), F.col("missed") != F.col("listed"))])]


def tag_cover(reasons: DataFrame, counters: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """J: distinct failing ledgers that name a tag (day, ledger, tag) against counters (day, tag, fails, shown), shown if a rate comes of them."""
    named = reasons.groupBy("day", "tag").agg(F.countDistinct("ledger").alias("named"))
    j = counters.join(named, ["day", "tag"], "left").na.fill(0, ["named"])
    return j, [("J", F.lit(True), yes(F.col("shown")) & ((F.coalesce("fails", F.lit(0)) < F.col("named")) | F.col("tag").isin(OBSERVATION_TAGS)))]


def quorum_rules() -> list[Rule]:
    """K over days: (day, quorum_fails, rows, gap_named); what no row attributes must be a named gap, and a named gap there."""
    over = F.col("quorum_fails") - F.coalesce("rows", F.lit(0))
    return [("K", F.col("quorum_fails").isNotNull(), (over < 0) | ((over > 0) != yes(F.col("gap_named"))))]


def total(parts: list[DataFrame]) -> DataFrame:
    """(check, checked, broken, verdict) of all eleven checks: held, broken, or not-checkable where nothing was checked."""
    spark = parts[0].sparkSession
    every = spark.createDataFrame([(c, 0, 0) for c in CHECKS], "check string, checked bigint, broken bigint")
    by = reduce(DataFrame.unionByName, parts, every).groupBy("check").agg(F.sum("checked").alias("checked"), F.sum("broken").alias("broken"))
    return by.withColumn("verdict", F.when(F.col("checked") == 0, "not-checkable").when(F.col("broken") > 0, "broken").otherwise("held"))
