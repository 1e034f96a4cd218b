"""Accumulated cluster state: merging, ranks under caps, retention, archive and history, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .iterate import stored


def top_edges(edges: DataFrame, key: str, k: int = 50, anchors: int = 10) -> DataFrame:
    """Of each cluster its k edges: the first `anchors` in time of nodes with several edges, then the largest.

    An anchor is the oldest edge of a node of degree two or more; it is found by a minimum, which is combined before the
    shuffle. Ranks are filtered windows by cluster, which Spark limits before the shuffle.
    """
    edges = stored(edges)  # read for the anchors and for the ranks
    ends = edges.select(key, F.struct("ledger_seq", "hash").alias("at"), F.explode(F.array("account", "destination")).alias("node"))
    anchor = ends.groupBy(key, "node").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n > 1").select(key, "at.hash", "at.ledger_seq").distinct()
    first = anchor.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("ledger_seq", "hash"))).where(F.col("rn") <= anchors).select(key, "hash", F.lit(0).alias("class"))
    ranked = edges.join(first, [key, "hash"], "left").withColumn("class", F.coalesce("class", F.lit(1)))
    w = Window.partitionBy(key).orderBy("class", F.desc("amount_drops"), "hash")
    return ranked.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k).drop("class")


def merge_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Totals by cluster over two states (cluster, total_drops, tx_count, first_seen, last_seen, role_rank, severity_rank).

    Sums add up, seen ledgers widen, ranks keep the higher; a union and one partial aggregation.
    """
    return old.unionByName(new).groupBy("cluster").agg(
        F.sum("total_drops").alias("total_drops"), F.sum("tx_count").alias("tx_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max("role_rank").alias("role_rank"), F.max("severity_rank").alias("severity_rank"),
    )


def absorb(members: DataFrame, state: DataFrame) -> DataFrame:
    """(cluster, target): each new cluster joins the first state cluster that shares a member, else stays itself."""
    hit = members.join(state.select("address", F.col("cluster").alias("found")), "address", "left")
    return hit.groupBy("cluster").agg(F.min("found").alias("found")).select("cluster", F.coalesce("found", "cluster").alias("target"))


def retained(state: DataFrame, now: int, plain: int, evident: int, evidence: Column) -> DataFrame:
    """Rows whose last_seen is unknown or young enough: `plain`, or `evident` with evidence."""
    return state.where(F.col("last_seen").isNull() | (F.lit(now) - F.col("last_seen") <= F.when(evidence, evident).otherwise(plain)))


def capped(state: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of a total order."""
    return state.orderBy(*order).limit(n)


def archived(state: DataFrame, kept: DataFrame, key: str, evidence: Column) -> DataFrame:
    """What leaves the state with evidence: expired, or beyond the cap."""
    return state.where(evidence).join(kept.select(key), key, "left_anti")


def capped_members(members: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return members.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= n)


def fitting(rows: DataFrame, key: str, order: list[Column], size: Column, cap: int) -> DataFrame:
    """Of each key the newest rows whose sizes add up to at most cap (a running sum within the key)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes", F.sum(size).over(w)).where(F.col("bytes") <= cap)


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last by order: a max over a struct, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return best.select(*key, *(f"x.{c}" for c in [*order, *rest]))


def history_key(members: Column) -> Column:
    """sha256 of the sorted members, one a line."""
    return F.sha2(F.array_join(F.sort_array(members), "\n"), 256)


def merge_history(old: DataFrame, new: DataFrame, again_after: int) -> DataFrame:
    """Histories by key: new totals replace old ones, seen times widen, a sighting counts after a pause.

    Columns: key, total_drops, first_seen, last_seen, sightings.
    """
    n = new.select("key", *(F.col(c).alias(f"n_{c}") for c in ("total_drops", "first_seen", "last_seen")))
    j = old.join(n, "key", "full_outer")
    known, fresh = F.col("first_seen").isNotNull(), F.col("n_last_seen").isNotNull()
    return j.select(
        "key", F.coalesce("n_total_drops", "total_drops").alias("total_drops"), F.least("first_seen", "n_first_seen").alias("first_seen"), F.greatest("last_seen", "n_last_seen").alias("last_seen"),
        (F.coalesce("sightings", F.lit(0)) + F.when(fresh & (~known | (F.col("n_last_seen") - F.col("last_seen") > again_after)), 1).otherwise(0)).cast("bigint").alias("sightings"),
    )
