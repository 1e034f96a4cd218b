"""Validator trace and ledger samples: rolling baselines, shapes, sweeps, incidents, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .parts import overlapping, placed


def detect_patterns(samples: DataFrame, by: str, base: int = 60, least: int = 10, spike_tx: int = 50, spike: float = 3.0, gap_ms: int = 15_000, gap: float = 4.0, burst_findings: int = 5, burst: float = 4.0, width: int = 10_000) -> DataFrame:
    """Patterns of ledger samples (by, ledger, close_ms, tx_count, findings) against the `base` samples before each.

    One row a pattern: by, ledger, type (load-spike, close-gap, fund-burst), value, baseline. Gaps count
    between consecutive ledgers only. Networks (`by`) are independent; a network's samples lie in parts of
    `width` that overlap by the baseline.
    """
    samples = overlapping(placed(samples, "ledger", (by,), width), base, width)
    order = Window.partitionBy(by, "part").orderBy("ledger")
    before, inner = order.rowsBetween(-base, -1), order.rowsBetween(1 - base, -1)
    gaps = samples.withColumn("gap", F.when(F.lag("ledger").over(order) == F.col("ledger") - 1, F.col("close_ms") - F.lag("close_ms").over(order)))
    median = lambda c, w: F.percentile(F.col(c), 0.5).over(w)
    known = gaps.withColumn("positive", F.when(F.col("gap") > 0, F.col("gap"))).select("*", F.count("*").over(before).alias("n"), median("tx_count", before).alias("m_tx"), median("positive", inner).alias("m_gap"), median("findings", before).alias("m_f")).where((F.col("n") >= least) & ~F.col("guest"))
    c = F.col
    tests = [
        ("load-spike", c("tx_count"), c("m_tx"), (c("tx_count") >= spike_tx) & (c("tx_count") >= spike * c("m_tx"))),
        ("close-gap", c("gap"), c("m_gap"), (c("m_gap") > 0) & (c("gap") >= gap_ms) & (c("gap") >= gap * c("m_gap"))),
        ("fund-burst", c("findings"), c("m_f"), (c("findings") >= burst_findings) & (c("findings") >= burst * c("m_f"))),
    ]
    hits = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("type"), v.cast("bigint").alias("value"), m.alias("baseline"))) for name, v, m, test in tests)))
    return known.withColumn("hit", F.explode(hits)).select(by, "ledger", "hit.*")


def shapes(tx: DataFrame, ledger: str) -> DataFrame:
    """Of each ledger: transactions, distinct senders and receivers, the busiest sender and the widest fan-out."""
    pair = tx.groupBy(ledger, "account", "destination").agg(F.count("*").alias("n"))
    sender = pair.groupBy(ledger, "account").agg(F.sum("n").alias("sent"), F.count("*").alias("dests"))
    out = sender.groupBy(ledger).agg(
        F.sum("sent").alias("tx_count"), F.count("*").alias("senders"), F.max(F.struct("sent", "account")).alias("busy"), F.max(F.struct("dests", "sent", "account")).alias("wide"),
    )
    received = pair.groupBy(ledger, "destination").agg(F.lit(1).alias("one")).groupBy(ledger).agg(F.count("*").alias("receivers"))
    return out.join(received, ledger).select(ledger, "tx_count", "senders", "receivers", F.col("busy.account").alias("busiest"), F.col("busy.sent").alias("busiest_tx"), F.col("wide.account").alias("widest"), F.col("wide.dests").alias("fan_out"))


def signatures(shape: DataFrame, by: str, base: int = 60, least: int = 10, fan_dests: int = 8, fan_tx: int = 10, burst_tx: int = 25, burst_share: float = 0.4, spike_tx: int = 50, spike: float = 3.0, extreme: float = 10.0, width: int = 10_000) -> DataFrame:
    """Shapes with their signatures as an array; the baseline takes the last `base` ledgers, the current one included, across overlapping parts."""
    shape = overlapping(placed(shape, "ledger", (by,), width), base, width)
    w = Window.partitionBy(by, "part").orderBy("ledger").rowsBetween(1 - base, 0)
    s = shape.withColumn("n", F.count("*").over(w)).withColumn("median_tx", F.percentile(F.col("tx_count"), 0.5).over(w))
    c, known = F.col, F.col("n") >= least
    spiked = known & (c("tx_count") >= spike_tx)
    found = F.array_compact(
        F.array(
            F.when((c("fan_out") >= fan_dests) & (c("busiest_tx") >= fan_tx), "drainer-fanout"),
            F.when((c("busiest_tx") >= burst_tx) & (c("busiest_tx") >= burst_share * c("tx_count")), "sender-burst"),
            F.when(spiked & (c("tx_count") >= extreme * c("median_tx")), "load-extreme").when(spiked & (c("tx_count") >= spike * c("median_tx")), "load-spike"),
        )
    )
    return s.withColumn("signatures", found).where("NOT guest").drop("n", "place", "part", "guest")


def sweeps(tx: DataFrame, least: int = 12, window: int = 12) -> DataFrame:
    """(account, ledger, dests): the first ledger at which an account has reached `least` distinct destinations within `window` ledgers.

    A destination counts from a contact on until the window has passed or the pair's next contact takes over, so the count is a
    running sum of what begins and ends, over at most one row for an account and ledger; no contact is copied along its window.
    """
    contact = tx.select("account", "destination", "ledger").where("destination IS NOT NULL AND ledger IS NOT NULL").distinct()
    following = F.lead("ledger").over(Window.partitionBy("account", "destination").orderBy("ledger"))
    held = contact.select("account", "ledger", F.least(F.col("ledger") + window + 1, following).alias("until"))
    turn = F.explode(F.array(F.struct(F.col("ledger").alias("at"), F.lit(1).alias("n")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("n"))))
    turns = held.select("account", turn.alias("t")).groupBy("account", F.col("t.at").alias("at")).agg(F.sum("t.n").alias("n"))
    dests = F.sum("n").over(Window.partitionBy("account").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    hit = turns.withColumn("dests", dests).where(F.col("dests") >= least)
    return hit.groupBy("account").agg(F.min(F.struct("at", "dests")).alias("x")).select("account", F.col("x.at").alias("ledger"), "x.dests")


def tally(votes: DataFrame, members: int, share: float = 0.8) -> DataFrame:
    """Of each ledger: voters, the top hash (ties: the smaller), its votes, the runner-up's, quorum need and margin."""
    one = votes.groupBy("ledger", "master").agg(F.max(F.struct("t_ms", "hash")).alias("v")).select("ledger", "master", "v.hash")  # the last vote of a master counts
    by_hash = one.groupBy("ledger", "hash").agg(F.count("*").alias("n"))
    w = Window.partitionBy("ledger").orderBy(F.desc("n"), "hash")
    ranked = by_hash.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("n").over(w)).withColumn("voters", F.sum("n").over(Window.partitionBy("ledger"))).where("rn = 1")
    need = -(-int(members * share * 1000) // 1000)
    return ranked.select("ledger", "voters", F.col("hash").alias("top_hash"), F.col("n").alias("top"), F.coalesce("next", F.lit(0)).alias("runner"), F.lit(need).cast("bigint").alias("need"), (F.col("n") - need).alias("margin"))


def wrong_hash(votes: DataFrame, tallied: DataFrame) -> DataFrame:
    """Votes for another hash than the ledger's top one."""
    return votes.join(tallied.select("ledger", "top_hash"), "ledger").where("hash <> top_hash").groupBy("master").agg(F.count("*").alias("wrong"), F.countDistinct("ledger").alias("ledgers"))


#: Upper edges of the load and margin bands.
LOAD_BANDS = [10, 25, 50, 100, 200, 400, 800, 1600, 3200]
MARGIN_BANDS = [0, 1, 2, 3, 5, 8]


def band(value: Column, edges: list[int]) -> Column:
    """Number of the first band whose upper edge value does not exceed (irregular edges)."""
    out = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        out = F.when(value <= edges[k], k).otherwise(out)
    return F.when(value.isNotNull(), out).cast("bigint")


def tag_patterns(incidents: DataFrame, tags: DataFrame) -> DataFrame:
    """Of each tag of the incidents' ledgers: incidents, distinct masters, distinct ledgers. tags: (ledger, tag)."""
    return incidents.join(tags, "ledger").groupBy("tag").agg(F.count("*").alias("incidents"), F.countDistinct("master").alias("masters"), F.countDistinct("ledger").alias("ledgers"))


def index_gaps(ledgers: DataFrame, by: str, width: int = 10_000) -> DataFrame:
    """(by, from_ledger, to_ledger) of every jump of the index. Each part of `width` ledgers knows the last one before it."""
    one = overlapping(placed(ledgers.select(by, "ledger").distinct(), "ledger", (by,), width), 1, width)
    w = Window.partitionBy(by, "part").orderBy("ledger")
    return one.withColumn("before", F.lag("ledger").over(w)).where("NOT guest AND ledger - before > 1").select(by, (F.col("before") + 1).alias("from_ledger"), (F.col("ledger") - 1).alias("to_ledger"))


def first_types(tx: DataFrame, established: list[str], after: int) -> DataFrame:
    """Types that first occur after ledger `after` and are not established."""
    first = tx.groupBy("type").agg(F.min("ledger").alias("ledger"))
    return first.where((F.col("ledger") > after) & ~F.col("type").isin(established))


def materialize_hours(votes: DataFrame, hour: Column) -> DataFrame:
    """Counters of each master and hour by incident type."""
    kinds = ["ok", "partial", "missed", "wrong-hash"]
    return votes.groupBy("master", hour.alias("hour")).agg(*(F.count_if(F.col("type") == k).alias(k.replace("-", "_")) for k in kinds))
