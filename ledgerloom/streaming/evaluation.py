"""Ledger evaluation as a stream: a timer for each ledger, and corrections for votes that come after it.

Each ledger is a key with state of its own: ballots until the grace period has passed, then a mark and the time when
it leaves the ring. The stream gives `tally` rows, one a ledger, as operators.evaluation.tallies gives them, and `late` rows
as they come; levels and incidents follow by operators.evaluation.judged over the rows that were written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "kind string, network string, ledger bigint, close_ms bigint, hash string, tx_count bigint, ballots array<struct<master:string,hash:string,full:boolean,t_ms:bigint>>, outside bigint, master string, full boolean, t_ms bigint"
_NAMES = [x.split()[0] for x in re.sub("<.*?>", "", OUT).split(", ")]


def _row(**values) -> Row:
    return Row(**{n: values.get(n) for n in _NAMES})


class Evaluator(StatefulProcessor):
    """State of a ledger: its close, each member's last timely vote, votes behind the due time until it is known, and the number of others."""

    def __init__(self, members: list[str], grace_ms: int, keep_ms: int):
        self.members, self.grace_ms, self.keep_ms = frozenset(members), grace_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.close_ = handle.getValueState("closed", "close_ms bigint, hash string, tx_count bigint, told boolean")
        self.votes = handle.getMapState("votes", "master string, t_ms bigint", "hash string, full boolean")
        self.others = handle.getMapState("others", "t_ms bigint", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.close_.get() if self.close_.exists() else None
        late = []
        for r in rows:
            if r.tag == "close":
                new = (r.t_ms, r.hash, r.tx_count)
                if known is None or (not known[3] and (new[0], new[1] or "") > (known[0], known[1] or "")):
                    known = (*new, False)
            elif r.master in self.members:
                if known is not None and known[3]:
                    late.append((r.master, r.hash, r.full, r.t_ms))
                else:
                    at, new = (r.master, r.t_ms), (r.hash, r.full)
                    had = tuple(self.votes.getValue(at)) if self.votes.containsKey(at) else None
                    if had is None or (new[0] or "", new[1]) > (had[0] or "", had[1]):
                        self.votes.updateValue(at, new)
            elif known is None or not known[3]:
                at = (r.t_ms,)
                self.others.updateValue(at, ((self.others.getValue(at)[0] if self.others.containsKey(at) else 0) + 1,))
        if known is not None:
            self.close_.update(known)
            if not known[3]:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(known[0] + self.grace_ms)
        elif not list(self.handle.listTimers()):  # votes without a close go after a while
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.keep_ms)
        yield from self._late(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.close_.get() if self.close_.exists() else None
        if known is None or known[3]:
            self.close_.clear()
            self.votes.clear()
            self.others.clear()
            return
        due, last, late = known[0] + self.grace_ms, {}, []
        for (master, t), (hash_, full) in self.votes.iterator():
            if t > due:
                late.append((master, hash_, full, t))
            elif master not in last or t > last[master][3]:
                last[master] = (master, hash_, full, t)
        ballots = [Row(master=m, hash=h, full=f, t_ms=t) for m, h, f, t in (last[k] for k in sorted(last))]
        outside = sum(n for (t,), (n,) in self.others.iterator() if t <= due)
        self.votes.clear()
        self.others.clear()
        self.close_.update((known[0], known[1], known[2], True))
        self.handle.registerTimer(due + self.keep_ms)
        yield _row(kind="tally", network=key[0], ledger=key[1], close_ms=known[0], hash=known[1], tx_count=known[2], ballots=ballots, outside=outside)
        yield from self._late(key, late)

    def _late(self, key, votes: list[tuple]) -> Iterator[Row]:
        for m, h, f, t in votes:
            yield _row(kind="late", network=key[0], ledger=key[1], master=m, hash=h, full=f, t_ms=t)

    def close(self) -> None:
        pass


def tagged(closes: DataFrame, votes: DataFrame, delay: str) -> DataFrame:
    """One stream of closes and votes with the event time ts; rows behind the watermark are dropped by Spark."""
    c = closes.select(F.lit("close").alias("tag"), "network", "ledger", "hash", "tx_count", F.lit(None).cast("string").alias("master"), F.lit(None).cast("boolean").alias("full"), F.col("close_ms").alias("t_ms"))
    v = votes.select(F.lit("vote").alias("tag"), "network", "ledger", "hash", F.lit(None).cast("bigint").alias("tx_count"), "master", F.coalesce("full", F.lit(True)).alias("full"), "t_ms")
    return c.unionByName(v).withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", delay)


def evaluated_stream(closes: DataFrame, votes: DataFrame, members: list[str], grace_ms: int = 20_000, keep_ms: int = 3_600_000, delay: str = "5 seconds") -> DataFrame:
    """Rows of OUT. A ledger's tally comes when the watermark passes its due time; its state goes keep_ms later (the ring's span of time).

    Needs the RocksDB state store. Equal to the batch form for any order of arrival within `delay`.
    """
    rows = tagged(closes, votes, delay)
    return rows.groupBy("network", "ledger").transformWithState(Evaluator(members, grace_ms, keep_ms), OUT, "Append", "EventTime")


def ledger_join(closes: DataFrame, votes: DataFrame, txs: DataFrame, before: str = "60 seconds", grace: str = "20 seconds", delays: tuple[str, str, str] = ("5 seconds", "5 seconds", "5 seconds")) -> DataFrame:
    """Each close with its votes and its transactions: (network, ledger, closed_at, hash, voters, agreeing, tx_count, senders, drops).

    Three streams, or three tables, in any mixture: votes and transactions are joined to the close of their ledger within
    an interval around it, so each side's state ends with the watermarks. Of a member's votes in the interval the
    last counts, a transaction hash counts once, and sides without rows give zeros. txs: (network, ledger, tx_hash, account,
    amount_drops, t_ms). Closes with the same ledger and time are one if their hashes are equal.
    """
    key = ["network", "ledger"]
    at = lambda df, col, name, delay: df.withColumn(name, F.timestamp_millis(col)).withWatermark(name, delay)
    c = at(closes.select(*key, "hash", "close_ms"), "close_ms", "closed_at", delays[0]).drop("close_ms")
    near = lambda own: (F.col(own) >= F.col("closed_at") - F.expr(f"interval {before}")) & (F.col(own) <= F.col("closed_at") + F.expr(f"interval {grace}"))
    side = lambda df, own: [F.col(k) == F.col(f"{own}_{k}") for k in key]
    close = [*key, "closed_at", "hash"]

    v = at(votes.select(F.col("network").alias("v_network"), F.col("ledger").alias("v_ledger"), "master", F.col("hash").alias("voted"), "t_ms"), "t_ms", "voted_at", delays[1])
    cond = side(v, "v")
    voted = c.join(v, cond[0] & cond[1] & near("voted_at"), "leftOuter")
    last = voted.groupBy(*close, "master").agg(F.max(F.struct("voted_at", "voted")).alias("last"))
    tally = last.groupBy(*close).agg(F.count("master").alias("voters"), F.count(F.when(F.col("last.voted") == F.col("hash"), 1)).alias("agreeing"))

    x = at(txs.select(F.col("network").alias("x_network"), F.col("ledger").alias("x_ledger"), "tx_hash", "account", "amount_drops", "t_ms"), "t_ms", "sent_at", delays[2])
    cond = side(x, "x")
    sent = c.join(x, cond[0] & cond[1] & near("sent_at"), "leftOuter")
    once = sent.groupBy(*close, "account", "tx_hash").agg(F.max("amount_drops").alias("drops"))
    by_sender = once.groupBy(*close, "account").agg(F.count("tx_hash").alias("n"), F.sum("drops").alias("drops"))
    shape = by_sender.groupBy(*close).agg(F.sum("n").alias("tx_count"), F.count("account").alias("senders"), F.coalesce(F.sum("drops"), F.lit(0)).alias("drops"))
    # The last join is on the close's own time, which bounds its state; hashes may be null.
    right = shape.select(F.col("network").alias("s_network"), F.col("ledger").alias("s_ledger"), F.col("closed_at").alias("s_at"), F.col("hash").alias("s_hash"), "tx_count", "senders", "drops")
    both = tally.join(right, (F.col("network") == F.col("s_network")) & (F.col("ledger") == F.col("s_ledger")) & (F.col("closed_at") == F.col("s_at")) & F.col("hash").eqNullSafe(F.col("s_hash")))
    return both.select(*close, "voters", "agreeing", "tx_count", "senders", "drops")
