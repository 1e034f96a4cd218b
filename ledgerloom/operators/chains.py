"""Layered forwarding chains: relays that pass on most of what they got, hop by hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .iterate import kept


def peeling_chains(edges: DataFrame, low: float = 0.6, high: float = 0.95, least: int = 3, most: int = 8, gap: int = 900) -> DataFrame:
    """Chains of edges (hash, account, destination, amount_drops, ledger_seq): (path, hops, first_drops, last_drops).

    A relay has one in- and one out-edge, so every edge has at most one successor: the walk is a
    pointer followed by at most `most` self-joins, and no node fans out.
    """
    out = edges.groupBy("account").agg(F.count("*").alias("n")).where("n = 1").select(F.col("account").alias("relay"))
    into = edges.groupBy("destination").agg(F.count("*").alias("n")).where("n = 1").select(F.col("destination").alias("relay"))
    relay = out.join(into, "relay")
    a = edges.select(F.col("destination").alias("relay"), F.col("hash").alias("h"), F.col("amount_drops").alias("a"), F.col("ledger_seq").alias("s")).join(relay, "relay")
    b = edges.select(F.col("account").alias("relay"), F.col("hash").alias("next"), F.col("amount_drops").alias("b"), F.col("ledger_seq").alias("t"), F.col("destination").alias("to"))
    ratio = F.col("b") / F.col("a")
    step = kept(a.join(b, "relay").where((F.col("a") > 0) & ratio.between(low, high) & (F.col("t") - F.col("s")).between(0, gap)).select("h", "next", "to", "b"))
    heads = step.select(F.col("h").alias("hash")).join(step.select(F.col("next").alias("hash")), "hash", "left_anti")
    level = edges.join(heads, "hash").select(F.col("hash").alias("tip"), F.array("account", "destination").alias("path"), F.col("amount_drops").alias("first_drops"), F.col("amount_drops").alias("last_drops"))
    done = None
    for _ in range(most - 1):
        onward = level.join(step, F.col("tip") == F.col("h"), "left")
        ended = onward.where(F.col("next").isNull() | F.array_contains("path", F.col("to"))).select("path", "first_drops", "last_drops")
        done = ended if done is None else done.unionByName(ended)
        level = kept(onward.where(F.col("next").isNotNull() & ~F.array_contains("path", F.col("to"))).select(F.col("next").alias("tip"), F.concat("path", F.array("to")).alias("path"), "first_drops", F.col("b").alias("last_drops")))
    done = done.unionByName(level.select("path", "first_drops", "last_drops"))
    return done.withColumn("hops", (F.size("path") - 1).cast("bigint")).where(F.col("hops") >= least)


def chain_fingerprint(hops: DataFrame, gap: float = 10.0, variance: float = 36.0, fee: float = 0.1) -> DataFrame:
    """Of each chain (chain, ledger_seq, amount_drops, fee, tag): how many of four habits it shows.

    Fees near their median, repeated amounts, even gaps (three hops at least) and a tag used again.
    """
    w = Window.partitionBy("chain").orderBy("ledger_seq")
    g = hops.withColumn("gap", F.col("ledger_seq") - F.lag("ledger_seq").over(w)).withColumn("mid", F.percentile(F.col("fee"), 0.5).over(Window.partitionBy("chain")))
    by = g.groupBy("chain").agg(F.count("*").alias("hops"), F.bool_and(F.abs(F.col("fee") - F.col("mid")) <= fee * F.col("mid")).alias("fees"), (F.countDistinct("amount_drops") < F.count("amount_drops")).alias("amounts"), (F.countDistinct("tag") < F.count("tag")).alias("tags"), F.percentile(F.col("gap"), 0.5).alias("median_gap"), F.var_pop("gap").alias("var_gap"))
    even = F.coalesce((F.col("hops") >= 3) & (F.col("median_gap") <= gap) & (F.col("var_gap") <= variance), F.lit(False))
    score = sum((F.when(c, 1).otherwise(0) for c in (F.col("fees"), F.col("amounts"), F.col("tags"), even)), F.lit(0))
    return by.select("chain", "hops", "fees", "amounts", "tags", even.alias("even"), score.cast("bigint").alias("score"))


def flow_paths(nodes: DataFrame, edges: DataFrame, by: str, paths: int = 4, longest: int = 6) -> DataFrame:
    """The first `paths` simple paths of each group in depth-first order, neighbours by name: (by, path, hops).

    nodes: (by, node, role), edges: (by, src, dst). Paths begin at nodes without an in-edge and at those of
    role source, and end at collectors, at nodes without an out-edge, before a node that they hold already,
    and at `longest` nodes. Every path begun ends in a path of its own, so of each group only the first
    `paths` are followed, and of each node's neighbours only as many as these and the path itself can use.
    """
    edges = edges.where("src <> dst").select(by, "src", "dst").distinct()
    has_out, has_in = edges.select(by, F.col("src").alias("node")).distinct(), edges.select(by, F.col("dst").alias("node"), F.lit(True).alias("reached")).distinct()
    end = nodes.join(has_out.withColumn("onward", F.lit(True)), [by, "node"], "left").select(by, F.col("node").alias("dst"), (F.coalesce(F.col("role") == "collector", F.lit(False)) | F.col("onward").isNull()).alias("ends"))
    near = edges.withColumn("place", F.row_number().over(Window.partitionBy(by, "src").orderBy("dst"))).where(F.col("place") <= paths + longest).drop("place")
    step = kept(near.join(end, [by, "dst"]))
    start = nodes.join(has_out, [by, "node"], "left_semi").join(has_in, [by, "node"], "left").where("(reached IS NULL OR role = 'source') AND coalesce(role, '') <> 'collector'")
    first = Window.partitionBy(by).orderBy("key", "path")

    def leading(entries: DataFrame) -> DataFrame:
        return kept(entries.withColumn("place", F.row_number().over(first)).where(F.col("place") <= paths).drop("place"))

    entries = leading(start.select(by, F.array("node").alias("key"), F.array("node").alias("path"), F.lit(False).alias("done")))
    for n in range(2, longest + 1):
        on = entries.where("NOT done").withColumn("src", F.element_at("path", -1)).join(step, [by, "src"])
        again, longer = F.array_contains("path", F.col("dst")), F.concat("path", F.array("dst"))
        new = on.select(by, longer.alias("key"), F.when(again, F.col("path")).otherwise(longer).alias("path"), (again | F.col("ends") | F.lit(n == longest)).alias("done"))
        entries = leading(entries.where("done").unionByName(new.groupBy(by, "path", "done").agg(F.min("key").alias("key")).select(by, "key", "path", "done")))
    return entries.where("done").select(by, "path", (F.size("path") - 1).cast("bigint").alias("hops"))
