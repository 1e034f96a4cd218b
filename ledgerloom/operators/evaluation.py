"""Evaluation of ledgers by the votes that came before a grace period ended: tallies, own reception levels, incidents, late votes.

closes: (network, ledger, hash, close_ms, tx_count), hash null where the ledger is not proven closed; votes: (network,
ledger, master, hash, full, t_ms), one row for each validation that was received; members: (master). A ledger is due at
close_ms + grace_ms. Levels are medians of the last `history` ledgers before one, over parts that overlap, so that no task
holds a network's history. Times are explicit, and ties go to the smaller hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .iterate import kept

KEY = ["network", "ledger"]
#: A tally's ballots.
BALLOTS = "array<struct<master:string,hash:string,full:boolean,t_ms:bigint>>"


def member_list(members: DataFrame, most: int = 10_000) -> list[str]:
    """The distinct members, sorted; a list over `most` is refused, as each ledger is held against all of it."""
    found = sorted(r[0] for r in members.select("master").where("master is not null").distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} members")
    return found


def tallies(closes: DataFrame, votes: DataFrame, members: list[str], grace_ms: int = 20_000) -> DataFrame:
    """Of each closed ledger what was received in time: a ballot for each member (its last vote), and the number of other validations.

    Votes for ledgers that never closed are left out. A ledger without votes has an empty list.
    """
    one = closes.groupBy(*KEY).agg(F.max(F.struct("close_ms", "hash", "tx_count")).alias("c")).select(*KEY, "c.*")
    timely = votes.join(one.select(*KEY, "close_ms"), KEY).where(F.col("t_ms") <= F.col("close_ms") + grace_ms)
    known = F.col("master").isin(members)
    of = timely.withColumn("master", F.when(known, F.col("master")))
    last = of.groupBy(*KEY, "master").agg(F.max(F.struct("t_ms", "hash", "full")).alias("v"), F.count("*").alias("n"))
    ballot = F.when(F.col("master").isNotNull(), F.struct("master", F.col("v.hash").alias("hash"), F.col("v.full").alias("full"), F.col("v.t_ms").alias("t_ms")))
    by = last.groupBy(*KEY).agg(F.array_sort(F.collect_list(ballot)).alias("ballots"), F.coalesce(F.sum(F.when(F.col("master").isNull(), F.col("n"))), F.lit(0)).alias("outside"))  # a member's one ballot
    return one.join(by, KEY, "left").select(*KEY, "close_ms", "hash", "tx_count", F.coalesce("ballots", F.array().cast(BALLOTS)).alias("ballots"), F.coalesce("outside", F.lit(0)).alias("outside"))


def counted(t: DataFrame) -> DataFrame:
    """Tallies with votes, top and runner-up hash and their votes, and the first and last delay."""
    lines = F.filter(F.transform("ballots", lambda b: b["hash"]), lambda h: h.isNotNull())
    ranked = F.array_sort(F.transform(F.array_distinct(lines), lambda h: F.struct((-F.size(F.filter(lines, lambda x: x == h))).alias("less"), h.alias("hash"))))
    delays = F.transform("ballots", lambda b: b["t_ms"] - F.col("close_ms"))
    place = lambda k: F.get(F.col("ranked"), F.lit(k))
    t = t.withColumn("ranked", ranked)
    return t.select(
        "*", F.size("ballots").cast("bigint").alias("votes"), place(0)["hash"].alias("top_hash"), F.coalesce(-place(0)["less"], F.lit(0)).cast("bigint").alias("top"), place(1)["hash"].alias("runner_hash"),
        F.coalesce(-place(1)["less"], F.lit(0)).cast("bigint").alias("runner"), F.array_min(delays).alias("first_vote_ms"), F.array_max(delays).alias("last_vote_ms"),
    ).drop("ranked")


def sequenced(rows: DataFrame, width: int = 10_000) -> DataFrame:
    """rows with `place`, their number within the network from 0 on, and the ledger and close before (null for the first).

    Rows are numbered within stretches of `width` ledgers; only counts and last rows of the stretches meet in one window.
    """
    cut = rows.withColumn("_cut", F.expr(f"ledger DIV {width}"))
    stretches = Window.partitionBy("network").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy("network", "_cut").agg(F.count("*").alias("n"), F.max(F.struct("ledger", "close_ms")).alias("end"))
    ends = ends.select("network", "_cut", F.coalesce(F.sum("n").over(stretches), F.lit(0)).alias("_from"), F.max("end").over(stretches).alias("_end"))
    own = Window.partitionBy("network", "_cut").orderBy("ledger")
    j = cut.join(ends, ["network", "_cut"]).withColumn("_last", F.coalesce(F.lag(F.struct("ledger", "close_ms")).over(own), F.col("_end")))
    return j.withColumn("place", F.col("_from") + F.row_number().over(own) - 1).withColumn("previous", F.col("_last.ledger")).withColumn("previous_close_ms", F.col("_last.close_ms")).drop("_cut", "_from", "_end", "_last")


def as_of(rows: DataFrame, samples: DataFrame, at: str, value: str, out: str, width: int = 86_400_000) -> DataFrame:
    """rows with the last sample (network, t_ms, value) at or before their time `at`: last ones within stretches of time, and the last of the stretches before."""
    both = rows.withColumn("_t", F.col(at)).unionByName(samples.select("network", F.col("t_ms").alias("_t"), F.struct(value).alias("_v")), allowMissingColumns=True).withColumn("_cut", F.expr(f"_t DIV {width}"))
    own = Window.partitionBy("network", "_cut").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    stretches = Window.partitionBy("network").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("network", "_cut").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("e")).select("network", "_cut", F.max("e").over(stretches)["_v"].alias("_end"))
    here = F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).over(own)["_v"]
    j = both.withColumn("_here", here).where("_v is null").join(ends, ["network", "_cut"])
    return j.withColumn(out, F.coalesce("_here", "_end")[value]).drop("_t", "_v", "_cut", "_here", "_end")


def trailing(rows: DataFrame, counts: Column, value: Column, out: str, history: int, least: int = 1, width: int = 10_000) -> DataFrame:
    """(network, ledger, out): the median of `value` over the last `history` rows before each for which `counts` holds; null below `least` of them.

    Rows that count are numbered by stretches of place; a row is dealt to the part that holds its number, and rows that count
    also to the part behind, if it can need them.
    """
    r = rows.select(*KEY, "place", F.coalesce(counts, F.lit(False)).alias("_ok"), value.cast("double").alias("_value"), F.expr(f"place DIV {width}").alias("_cut")).withColumn("_value", F.when(F.col("_ok"), F.col("_value")))
    stretches = Window.partitionBy("network").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    ends = r.groupBy("network", "_cut").agg(F.count_if("_ok").alias("n")).select("network", "_cut", F.coalesce(F.sum("n").over(stretches), F.lit(0)).alias("_from"))
    before = F.coalesce(F.sum(F.col("_ok").cast("bigint")).over(Window.partitionBy("network", "_cut").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.join(ends, ["network", "_cut"]).withColumn("_n", F.col("_from") + before).drop("_from", "_cut")
    own = F.expr(f"_n DIV {width}")
    r = r.withColumn("_part", F.explode(F.array_compact(F.array(own, F.when(F.col("_ok") & (F.col("_n") % width >= width - history), own + 1)))))
    w = Window.partitionBy("network", "_part").orderBy("_n").rangeBetween(-history, -1)
    found = F.when(F.count("_value").over(w) >= least, F.percentile("_value", F.lit(0.5)).over(w))
    return r.withColumn(out, found).where(F.col("_part") == own).select(*KEY, out)


def judged(t: DataFrame, members: list[str], quorum: DataFrame | None = None, opens: DataFrame | None = None, grace_ms: int = 20_000, share: float = 0.8, history: int = 60, least: int = 20, reception: float = 0.75, coverage: float = 0.9, width: int = 10_000) -> DataFrame:
    """Tallies with what they prove: the quorum needed and where it comes from, margins, own levels, and whether an absence can be blamed on a member.

    quorum: (network, t_ms, quorum), as measured; the last sample up to a ledger's due time counts, and without one the
    need is the share of the members, rounded up. opens: (network, t_ms), when a subscription began: the first ledger due
    from then on is a gap of the own recording, as is one behind a jump of the index. An absence is attributable where the ledger is closed,
    the recording has no gap, reception and coverage are at their own levels, votes agree with the closed hash, and
    no more are absent than the quorum lets.
    """
    r = kept(sequenced(kept(counted(t)), width)).withColumn("due_ms", F.col("close_ms") + grace_ms).withColumn("closed", F.col("hash").isNotNull())
    derived = -(-int(len(members) * share * 1000) // 1000)
    r = as_of(r, quorum.where("quorum > 0"), "due_ms", "quorum", "network_quorum") if quorum is not None else r.withColumn("network_quorum", F.lit(None).cast("bigint"))
    r = r.withColumn("needed", F.coalesce("network_quorum", F.lit(derived)).cast("bigint")).withColumn("needed_basis", F.when(F.col("network_quorum").isNotNull(), "measured").otherwise("derived"))
    r = r.withColumn("index_gap", F.coalesce(F.col("ledger") > F.col("previous") + 1, F.lit(False)))
    if opens is not None:
        r = as_of(r, opens.withColumn("opened", F.col("t_ms")), "due_ms", "opened", "opened")
        r = r.withColumn("stream_open", F.coalesce((F.col("opened") > F.col("previous_close_ms") + grace_ms) | (F.col("previous").isNull() & F.col("opened").isNotNull()), F.lit(False))).drop("opened")
    else:
        r = r.withColumn("stream_open", F.lit(False))
    r = r.withColumn("capture_gap", F.col("closed") & (F.col("index_gap") | F.col("stream_open"))).withColumn("observed", F.col("votes") + F.col("outside"))
    r = r.withColumn("close_gap_ms", F.col("close_ms") - F.col("previous_close_ms"))
    r = kept(r)  # each level reads it twice
    levels = [
        trailing(r, F.lit(True), F.col("observed"), "observed_baseline", history, least, width), trailing(r, F.col("closed") & ~F.col("capture_gap"), F.col("votes"), "coverage_baseline", history, least, width),
        trailing(r, F.col("close_gap_ms").isNotNull() & ~F.col("index_gap"), F.col("close_gap_ms"), "median_gap_ms", history, 1, width),
    ]
    for level in levels:
        r = r.join(level, KEY)
    r = r.withColumn("has_quorum", F.col("top_hash").isNotNull() & (F.col("top") >= F.col("needed"))).withColumn("margin", F.col("top") - F.col("needed"))
    r = r.withColumn("reception_thin", F.col("closed") & F.coalesce(F.col("observed") < F.col("observed_baseline") * reception, F.lit(False)))
    r = r.withColumn("absent", F.lit(len(members)) - F.col("votes")).withColumn("genuine_absent_max", F.when(F.col("closed") & (F.col("needed") > 0), F.greatest(F.lit(0), F.lit(len(members)) - F.col("needed"))).cast("bigint"))
    r = r.withColumn("closure_conflict", F.col("closed") & F.coalesce(F.col("top_hash") != F.col("hash"), F.lit(False)))
    at_level = F.coalesce(F.col("votes") >= F.col("coverage_baseline") * coverage, F.lit(False))
    few = F.coalesce(F.col("absent") <= F.col("genuine_absent_max"), F.lit(False))
    return kept(r.withColumn("attributable", F.col("closed") & ~F.col("capture_gap") & ~F.col("reception_thin") & at_level & ~F.col("closure_conflict") & few))


def incidents(j: DataFrame, members: list[str]) -> DataFrame:
    """(network, ledger, master, type, vote_delay_ms, voted_hash): members without a vote, on another hash than a quorum's, or with a partial validation.

    Without a vote: `missed` if there is a quorum and the absence is attributable, `vote-not-observed` if the ledger is closed, else `no-quorum`.
    """
    seen = F.transform("ballots", lambda b: b["master"])
    absent = F.transform(F.array_except(F.lit(members) if members else F.array().cast("array<string>"), seen), lambda m: F.struct(m.alias("master"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("boolean").alias("full"), F.lit(None).cast("bigint").alias("t_ms")))
    one = j.select(*KEY, "close_ms", "has_quorum", "attributable", "closed", "top_hash", F.explode(F.concat("ballots", absent)).alias("b"))
    kind = (
        F.when(F.col("b.t_ms").isNull(), F.when(F.col("has_quorum") & F.col("attributable"), "missed").when(F.col("closed"), "vote-not-observed").otherwise("no-quorum"))
        .when(F.col("has_quorum") & ~F.col("b.hash").eqNullSafe(F.col("top_hash")), "wrong-hash")
        .when(~F.coalesce("b.full", F.lit(True)), "partial")
    )
    return one.select(*KEY, "b.master", kind.alias("type"), (F.col("b.t_ms") - F.col("close_ms")).alias("vote_delay_ms"), F.col("b.hash").alias("voted_hash")).where("type is not null")


def late(j: DataFrame, votes: DataFrame, members: list[str], ring: int = 512) -> DataFrame:
    """(network, ledger, master, delay_ms, hash, full, in_ring) of members' votes after their ledger was due; of several in the ring the last.

    A ledger stays in the ring until `ring` later ones are due: votes from then on are outside, and are told apart only by in_ring.
    """
    end = j.select("network", (F.col("place") - ring).alias("place"), F.col("due_ms").alias("ring_end_ms"))
    r = votes.where(F.col("master").isin(members)).join(j.select(*KEY, "place", "close_ms", "due_ms").join(end, ["network", "place"], "left"), KEY).where("t_ms > due_ms")
    r = r.withColumn("in_ring", F.coalesce(F.col("t_ms") < F.col("ring_end_ms"), F.lit(True)))
    last = r.groupBy(*KEY, "master", "in_ring").agg(F.max(F.struct("t_ms", "hash", "full")).alias("v"), F.max("close_ms").alias("close_ms"))
    return last.select(*KEY, "master", (F.col("v.t_ms") - F.col("close_ms")).alias("delay_ms"), "v.hash", "v.full", "in_ring")


def patched(found: DataFrame, late_votes: DataFrame) -> DataFrame:
    """Incidents with `late`: a member without a timely vote whose vote came within the ring gets its delay and is marked; types stay."""
    came = late_votes.where("in_ring").select(*KEY, "master", F.col("delay_ms").alias("_delay"))
    j = found.join(came, [*KEY, "master"], "left")
    hit = F.col("_delay").isNotNull() & F.col("type").isin("missed", "vote-not-observed")
    return j.withColumn("vote_delay_ms", F.when(hit, F.col("_delay")).otherwise(F.col("vote_delay_ms"))).withColumn("late", hit).drop("_delay")
