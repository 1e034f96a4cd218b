"""Normalization of trace days: types that lack a proof are renamed, and counters move with them, so that sums stay.

Tables by day, all keyed by `day`: incidents (day, ledger, master, type, t_ms, not_closed, attributable, reasons, told, mark, basis, hash, verified_by),
stats (day, ledger, closed, hash, attributable, top, need), proofs (day, ledger, closed, hash, source, verified_by), counters (day, master) and
hours (day, hour, master) with KINDS, anomaly (day, tag, ledgers, fails), days (day, quorum_fail). A run over its own output changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .iterate import kept

KINDS = ["ok", "partial", "missed", "wrong_hash", "no_quorum", "missed_open"]
_HEX = "^[0-9A-Fa-f]{64}$"
_STREAM = "validated-ledger-stream"


def closures(stats: DataFrame, proofs: DataFrame) -> DataFrame:
    """(day, ledger, denied, proof): whether any row says the ledger did not close, and the last named proof (proofs before stats; of several the greatest hash)."""
    rows = stats.select("day", "ledger", "closed", "hash", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("verified_by"), F.lit(0).alias("own"))
    rows = rows.unionByName(proofs.select("day", "ledger", "closed", "hash", "source", "verified_by", F.lit(1).alias("own")))
    no = F.coalesce(~F.col("closed"), F.lit(False))
    named = F.when(~no & F.col("hash").rlike(_HEX), F.struct("own", "hash", F.coalesce("source", F.lit(_STREAM)).alias("source"), "verified_by"))
    return rows.where("ledger is not null").groupBy("day", "ledger").agg(F.bool_or(no).alias("denied"), F.max(named).alias("proof"))


def _renamed(types: Column, old: str, new: Column) -> Column:
    return F.transform(types, lambda t: F.when(t == old, new).otherwise(t))


def normalized(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after normalization, with `gaps` (day, tag, ledgers, reason) and `moved` (day, moved, proven, counter_gaps).

    `no-quorum` becomes `vote-not-observed` unless the incident or a row of its ledger says that the ledger did not close.
    `missed` stays where the incident or its ledger's row proves that the absence is the member's own; otherwise it becomes
    `vote-not-observed` (`no-quorum` where closing is denied), and as many of the master's missed as there are move to no_quorum and
    missed_open, in the day and in the hour. The anomaly counter of no-quorum moves as a whole if nothing in the day denies closing, else it is a gap, as is a
    quorum counter that differs from the rows short of their need. A closing without a hash of 64 digits is taken back.
    """
    valid = F.coalesce(F.col("hash").rlike(_HEX), F.lit(False))
    bad = F.coalesce(F.col("closed"), F.lit(False)) & ~valid
    stats = t["stats"].withColumn("_bad", bad).withColumn("closed", F.when(~F.col("_bad"), F.col("closed"))).withColumn("hash", F.when(~F.col("_bad"), F.col("hash"))).drop("_bad")
    closed = kept(closures(stats, t["proofs"]))
    blame = stats.where("ledger is not null").groupBy("day", "ledger").agg(F.max_by("attributable", F.struct(F.col("attributable").isNotNull(), F.col("attributable"))).alias("row_proof"))
    columns = t["incidents"].columns
    i = t["incidents"].join(closed, ["day", "ledger"], "left").join(blame, ["day", "ledger"], "left")
    denied = F.coalesce("not_closed", F.lit(False)) | F.coalesce("denied", F.lit(False))
    proven = F.coalesce("attributable", F.lit(False)) | F.coalesce("row_proof", F.lit(False))
    i = i.withColumn("_denied", denied).withColumn("_missed", (F.col("type") == "missed") & ~proven).withColumn("_proven", (F.col("type") == "missed") & proven).withColumn("_open", (F.col("type") == "no-quorum") & ~denied)
    new = F.when(F.col("_denied"), "no-quorum").otherwise("vote-not-observed")
    changed = F.col("_missed") | F.col("_open")
    based = (F.col("_open") | (F.col("_missed") & ~F.col("_denied")) | ((F.col("type") == "vote-not-observed") & ~F.col("_denied") & F.col("basis").isNull()))
    i = i.withColumn("_based", based)
    i = kept(
        i.withColumn("told", F.when(changed, F.col("type")).otherwise(F.col("told")))
        .withColumn("mark", F.when(F.col("_missed"), F.when(~F.coalesce("attributable", F.lit(True)) | ~F.coalesce("row_proof", F.lit(True)), "not-attributable").otherwise("not-recorded")).otherwise(F.col("mark")))
        .withColumn("reasons", F.when(F.col("_missed"), _renamed(F.col("reasons"), "missed", new)).when(F.col("_open"), _renamed(F.col("reasons"), "no-quorum", new)).otherwise(F.col("reasons")))
        .withColumn("type", F.when(changed, new).otherwise(F.col("type")))
        .withColumn("basis", F.when(F.col("_based"), F.coalesce("proof.source", F.lit(_STREAM))).otherwise(F.col("basis")))
        .withColumn("hash", F.when(F.col("_based"), F.coalesce("proof.hash", "hash")).otherwise(F.col("hash")))
        .withColumn("verified_by", F.when(F.col("_based"), F.coalesce("proof.verified_by", "verified_by")).otherwise(F.col("verified_by")))
    )
    gone = i.where("_missed")
    out = {"incidents": i.select(columns), "stats": stats, "proofs": t["proofs"], "days": t["days"]}
    wanted = gone.groupBy("day", "master").agg(F.count("*").alias("_want"))
    by_hour = gone.where("t_ms is not null").groupBy("day", F.expr("t_ms DIV 3600000").alias("hour"), "master").agg(F.count("*").alias("_want"))
    out["counters"], out["hours"] = _moved(t["counters"], wanted, ["day", "master"]), _moved(t["hours"], by_hour, ["day", "hour", "master"])
    taken = wanted.join(t["counters"].select("day", "master", F.coalesce("missed", F.lit(0)).alias("_have")), ["day", "master"], "left").withColumn("_take", F.least("_want", F.coalesce("_have", F.lit(0))))
    sums = taken.groupBy("day").agg(F.sum("_take").alias("moved"), F.count_if(F.col("_take") < F.col("_want")).alias("counter_gaps"))
    held = i.where("_proven").groupBy("day").agg(F.count("*").alias("proven"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out["moved"] = sums.join(held, "day", "full").select("day", zero("moved"), zero("proven"), zero("counter_gaps"))

    denials = closed.where("denied").select("day").unionByName(t["incidents"].where("not_closed").select("day")).groupBy("day").agg(F.count("*").alias("denials"))
    a = t["anomaly"].join(denials, "day", "left")
    free = F.col("denials").isNull()
    legacy = a.where("tag = 'no-quorum' and ledgers > 0")
    moving = legacy.where(free).select("day", F.col("ledgers").alias("_l"), F.coalesce("fails", F.lit(0)).alias("_f"))
    rest = a.select("day", "tag", "ledgers", "fails").join(moving.select("day", F.lit(True).alias("_m")), "day", "left")
    rest = rest.select("day", "tag", *(F.when(F.coalesce("_m", F.lit(False)) & (F.col("tag") == "no-quorum"), F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("ledgers", "fails")))
    more = moving.select("day", F.lit("vote-not-observed").alias("tag"), F.col("_l").cast("bigint").alias("ledgers"), F.col("_f").cast("bigint").alias("fails"))
    out["anomaly"] = rest.unionByName(more).groupBy("day", "tag").agg(F.sum("ledgers").alias("ledgers"), F.sum("fails").alias("fails"))
    short = stats.where("need > 0 and top < need").groupBy("day").agg(F.count("*").alias("short"))
    q = t["days"].join(short, "day", "full").withColumn("short", F.coalesce("short", F.lit(0)))
    q = q.where("quorum_fail is not null or short > 0").where("quorum_fail is null or quorum_fail <> short")
    more_rows = F.when(F.col("short") > F.coalesce("quorum_fail", F.lit(0)), "forensics-rows-exceed-counter").otherwise("counter-without-forensics-row")
    out["gaps"] = legacy.where(~free).select("day", "tag", F.col("ledgers").cast("bigint").alias("ledgers"), F.lit("closure-denied-in-same-counter").alias("reason")).unionByName(
        q.select("day", F.lit("quorum-fail").alias("tag"), F.abs(F.coalesce("quorum_fail", F.lit(0)) - F.col("short")).cast("bigint").alias("ledgers"), more_rows.alias("reason"))
    )
    return out


def _moved(counters: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """counters with as many missed as wanted, at most those there are, counted as no_quorum and missed_open."""
    j = counters.join(wanted, key, "left").withColumn("_take", F.least(F.coalesce("_want", F.lit(0)), F.coalesce("missed", F.lit(0))))
    step = {"missed": -F.col("_take"), "no_quorum": F.col("_take"), "missed_open": F.col("_take")}
    return j.select(*(((F.coalesce(c, F.lit(0)) + step[c]).alias(c) if c in step else F.col(c)) for c in counters.columns))
