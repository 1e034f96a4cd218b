"""Streaming forms: vote tallies under a grace period, ledger shapes, live classification, state by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tally_stream(votes: DataFrame, grace: str = "20 seconds", cell: str = "10 minutes") -> DataFrame:
    """Closed cells of a vote stream (ts, master, hash): voters, the top hash (ties: the smaller), its votes.

    A cell closes when the watermark has passed its end by the grace; later votes are dropped by the
    watermark. Of a master's votes in a cell the last counts, as in the batch form. Append mode.
    """
    last = votes.withWatermark("ts", grace).groupBy(F.window("ts", cell).alias("cell"), "master").agg(F.max(F.struct("ts", "hash")).alias("v"))
    counted = last.groupBy(F.window("cell", cell).alias("again"), F.col("v.hash").alias("hash")).agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("less"), "hash", "n")).alias("x")
    return counted.groupBy(F.window("again", cell).alias("closed")).agg(F.sum("n").alias("votes"), top).select(F.col("closed.start").alias("start"), "votes", F.col("x.hash").alias("top_hash"), F.col("x.n").alias("top"))


def shape_stream(tx: DataFrame, grace: str = "20 seconds", cell: str = "1 hour") -> DataFrame:
    """Tumbling ledger shapes of a transaction stream (ts, hash, account, destination): repeated hashes count once; senders and receivers are approximate, unlike the batch form's."""
    once = tx.withWatermark("ts", grace).dropDuplicatesWithinWatermark(["hash"])
    return once.groupBy(F.window("ts", cell).alias("w")).agg(F.count("*").alias("tx_count"), F.approx_count_distinct("account").alias("senders"), F.approx_count_distinct("destination").alias("receivers")).select(F.col("w.start").alias("start"), "tx_count", "senders", "receivers")


def classified(events: DataFrame, watched: DataFrame, tiny: int = 100) -> DataFrame:
    """Live events (hash, account, destination, type, amount_drops) with a risk class; watched (address) is a static side."""
    w = watched.select(F.col("address").alias("destination"), F.lit(True).alias("to_watched"))
    v = watched.select(F.col("address").alias("account"), F.lit(True).alias("from_watched"))
    j = events.join(w, "destination", "left").join(v, "account", "left")
    kind = (
        F.when(F.col("from_watched"), "outgoing")
        .when(F.col("to_watched") & (F.col("type") == "Payment") & (F.col("amount_drops") < tiny), "dust")
        .when(F.col("to_watched") & (F.col("type") == "Payment"), "incoming")
        .when(F.col("to_watched"), "contact")
    )
    return j.withColumn("class", kind).where(F.col("class").isNotNull()).drop("to_watched", "from_watched")


def tiny_destinations(tx: DataFrame, tiny: int = 100, least: int = 3) -> DataFrame:
    """Dusting over a whole stream: an account's distinct tiny destinations are kept as state; it is reported once, when it reaches `least`.

    The state of an account ends with its report, so it holds fewer than `least` destinations.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, done = state.get if state.exists else ([], False)
        known = set(found)
        for pdf in batches:
            if not done:
                known |= set(pdf["destination"])
        if not done and len(known) >= least:
            yield pd.DataFrame({"account": [key[0]], "destinations": [len(known)]})
            known, done = set(), True
        state.update((sorted(known), done))

    small = tx.where(F.col("amount_drops") < tiny).select("account", "destination")
    return small.groupBy("account").applyInPandasWithState(step, "account string, destinations long", "found array<string>, done boolean", "append", GroupStateTimeout.NoTimeout)


def advance(stream: DataFrame, path: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str):
    """Folds a stream into a state table by micro-batches; returns the started query, which ends when the input does.

    State number n + 1 is written from state n and batch n, to a folder of its own: a batch that runs
    again writes the same folder again, so every batch counts once.
    """
    def batch(df: DataFrame, number: int) -> None:
        old = df.sparkSession.read.parquet(f"{path}/{number}") if number else None
        fold(old, df).write.mode("overwrite").parquet(f"{path}/{number + 1}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
