"""Motifs and timing of money flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def gather_scatter(tx: DataFrame, least: int = 3, exclude: DataFrame | None = None) -> DataFrame:
    """Addresses with at least `least` distinct payers and payees (fan_in, fan_out)."""
    edges = _plain(tx, exclude)
    pair = edges.select("account", "destination").distinct()
    fan = pair.select(F.col("account").alias("address"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(pair.select(F.col("destination").alias("address"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return fan.groupBy("address").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).where((F.col("fan_in") >= least) & (F.col("fan_out") >= least))


def _plain(tx: DataFrame, exclude: DataFrame | None) -> DataFrame:
    edges = tx.where("account <> destination AND amount_drops IS NOT NULL")
    if exclude is not None:
        for end in ("account", "destination"):
            edges = edges.join(exclude.select(F.col("address").alias(end)).distinct(), end, "left_anti")
    return edges


def wash_cycles(tx: DataFrame, least_edges: int = 2, conserve: float = 0.8, span: int | None = None, time: str = "ledger_seq", exclude: DataFrame | None = None) -> DataFrame:
    """Unordered pairs that pay each other: enough edges each way, volumes alike, all within span of `time`."""
    forth = F.col("account") < F.col("destination")
    pair = _plain(tx, exclude).groupBy(F.least("account", "destination").alias("a"), F.greatest("account", "destination").alias("b")).agg(
        F.count_if(forth).alias("forth"), F.count_if(~forth).alias("back"), F.coalesce(F.sum(F.when(forth, F.col("amount_drops"))), F.lit(0)).alias("forth_drops"),
        F.coalesce(F.sum(F.when(~forth, F.col("amount_drops"))), F.lit(0)).alias("back_drops"), F.min("ledger_seq").alias("first_ledger"), F.max("ledger_seq").alias("last_ledger"),
        (F.max(time) - F.min(time)).alias("span"),
    )
    ratio = F.least("forth_drops", "back_drops") / F.greatest("forth_drops", "back_drops")
    found = pair.where((F.col("forth") >= least_edges) & (F.col("back") >= least_edges) & (F.greatest("forth_drops", "back_drops") > 0)).withColumn("conserve", ratio).where(F.col("conserve") >= conserve)
    return (found if span is None else found.where(F.col("span").isNull() | (F.col("span") <= span))).drop("span")


def temporal(tx: DataFrame, window: int = 10, burst: int = 5, gap: float = 2.0) -> DataFrame:
    """Of each sender: burst (most payments within `window` ledgers, both ends counted), median gap, span, drops out, automated.

    One shuffle by account serves both windows.
    """
    w = Window.partitionBy("account").orderBy("ledger_seq")
    timed = tx.withColumn("near", F.count("*").over(w.rangeBetween(0, window))).withColumn("gap", F.col("ledger_seq") - F.lag("ledger_seq").over(w))
    out = timed.groupBy("account").agg(F.max("near").alias("burst"), F.expr("percentile(gap, 0.5)").alias("median_gap"), (F.max("ledger_seq") - F.min("ledger_seq")).alias("span"), F.sum("amount_drops").alias("out_drops"), F.count("*").alias("payments"))
    return out.withColumn("automated", (F.col("burst") >= burst) & F.coalesce(F.col("median_gap") <= gap, F.lit(False)))


def series(tx: DataFrame, points: int = 16) -> DataFrame:
    """The last `points` ledgers of each sender as a sorted array, built from top-k rows only."""
    w = Window.partitionBy("account").orderBy(F.desc("ledger_seq"), F.desc("hash"))
    last = tx.select("account", "ledger_seq", "hash").withColumn("n", F.row_number().over(w)).where(F.col("n") <= points)
    return last.groupBy("account").agg(F.sort_array(F.collect_list("ledger_seq")).alias("ledgers"))
