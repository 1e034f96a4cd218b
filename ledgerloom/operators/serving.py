"""Serving projections: windows, top lists, country flows, threats, account reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def hour_rollup(blocks: DataFrame, hour: Column) -> DataFrame:
    """Of each hour: blocks, transactions, flagged blocks, worst severity rank."""
    return blocks.groupBy(hour.alias("hour")).agg(F.count("*").alias("blocks"), F.sum("tx_count").alias("tx_count"), F.count_if(F.col("rank") > 1).alias("flagged"), F.max("rank").alias("rank"))


def windowed(df: DataFrame, seq: str, windows: dict[str, int | None]) -> DataFrame:
    """df once for each window that holds its row: name -> first value of seq (None: all)."""
    names = F.array_compact(F.array(*(F.lit(n) if lo is None else F.when(F.col(seq) >= lo, n) for n, lo in windows.items())))
    return df.withColumn("window", F.explode(names))


def top_flows(edges: DataFrame, address: str, windows: dict[str, int | None], n: int = 10) -> DataFrame:
    """The n addresses of each window with the largest sums; one pass over the edges for all windows."""
    total = windowed(edges, "ledger_seq", windows).groupBy("window", F.col(address).alias("address")).agg(F.sum("amount_drops").alias("drops"), F.count("*").alias("edges"), F.max("ledger_seq").alias("last"))
    w = Window.partitionBy("window").orderBy(F.desc("drops"), F.desc("edges"), "address")
    return total.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= n)


def country_flows(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Flows between countries: edges, drops, by severity, and what goes to cold custody; flows inside a country are dropped."""
    a = registry.select(F.col("address").alias("account"), F.col("country").alias("from_country"))
    b = registry.select(F.col("address").alias("destination"), F.col("country").alias("to_country"), F.col("tier"))
    j = edges.join(a, "account").join(b, "destination").where("from_country <> to_country")
    return j.groupBy("from_country", "to_country").agg(F.count("*").alias("edges"), F.sum("amount_drops").alias("drops"), *(F.count_if(F.col("rank") == k).alias(s) for k, s in ((3, "malicious"), (2, "suspect"), (1, "info"))), F.count_if(F.col("tier") == "cold").alias("custody"))


def knowledge(layers: list[tuple[str, DataFrame]], registry: DataFrame | None = None) -> DataFrame:
    """Threat knowledge of ordered layers (address, risk, reason, first_seen): the worst risk with its reason, first seen, sources."""
    rows = reduce(DataFrame.unionByName, (d.select("address", "risk", "reason", "first_seen", F.lit(k).alias("layer"), F.lit(name).alias("source")) for k, (name, d) in enumerate(layers)))
    if registry is not None:
        rows = rows.join(registry.select("address").distinct(), "address", "left_anti")
    best = rows.groupBy("address").agg(F.max(F.struct("risk", F.negative("layer").alias("l"), "reason")).alias("x"), F.min("first_seen").alias("first_seen"), F.sort_array(F.collect_set(F.struct("layer", "source"))).alias("s"))
    return best.select("address", "x.risk", "x.reason", "first_seen", F.array_join(F.transform("s", lambda s: s["source"]), ",").alias("sources"))


def account_scores(tx: DataFrame, flags: DataFrame, malicious: int = 15, suspect: int = 5, own: int = 10) -> DataFrame:
    """Of each address: distinct flagged counterparties, a score of 100 less the penalties, and a verdict."""
    both = tx.select(F.col("account").alias("address"), F.col("destination").alias("other")).unionByName(tx.select(F.col("destination").alias("address"), F.col("account").alias("other"))).where("address <> other").distinct()
    f = flags.select(F.col("address").alias("other"), "rank")
    met = both.join(f, "other", "left").groupBy("address").agg(F.count("*").alias("contacts"), F.count_if(F.col("rank") == 3).alias("malicious"), F.count_if(F.col("rank") == 2).alias("suspect"))
    j = met.join(flags.select("address", F.col("rank").alias("own_rank")), "address", "left")
    score = F.greatest(F.lit(0), 100 - malicious * F.col("malicious") - suspect * F.col("suspect") - F.when(F.col("own_rank").isNotNull(), own).otherwise(0)).cast("bigint")
    verdict = F.when(F.col("own_rank").isNotNull(), "bad").when(F.col("malicious") + F.col("suspect") > 0, "contact").otherwise("clean")
    return j.select("address", "contacts", "malicious", "suspect", score.alias("score"), verdict.alias("verdict"))


def monitor_samples(tx: DataFrame, n: int = 240) -> DataFrame:
    """The last n ledgers with counts of malicious and suspect edges and the most frequent type."""
    kinds = tx.groupBy("ledger_seq", "type").agg(F.count("*").alias("k"), F.count_if(F.col("rank") == 3).alias("m"), F.count_if(F.col("rank") == 2).alias("s"))
    by = kinds.groupBy("ledger_seq").agg(F.sum("k").alias("edges"), F.sum("m").alias("malicious"), F.sum("s").alias("suspect"), F.max(F.struct("k", "type")).alias("x"))
    return by.orderBy(F.desc("ledger_seq")).limit(n).select("ledger_seq", "edges", "malicious", "suspect", F.col("x.type").alias("top_type"))


def node_size(drops: Column) -> Column:
    return F.greatest(F.lit(8.0), 1 + 2 * F.log1p(drops / 1e6))


def threat_graph(edges: DataFrame) -> DataFrame:
    """Nodes and links of the graph from flagged senders to their receivers, as (kind, a, b, n)."""
    pair = edges.where("from_rank = 3").groupBy("account", "destination").agg(F.count("*").alias("n"))
    nodes = pair.select(F.explode(F.array("account", "destination")).alias("a")).distinct().select(F.lit("node").alias("kind"), "a", F.lit(None).cast("string").alias("b"), F.lit(1).cast("bigint").alias("n"))
    return nodes.unionByName(pair.select(F.lit("link").alias("kind"), F.col("account").alias("a"), F.col("destination").alias("b"), "n"))
