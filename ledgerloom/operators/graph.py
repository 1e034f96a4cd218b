"""Money-flow graph: flagged edges, node aggregates, roles, components, clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.ranks import ROLES, SEVERITIES, epoch_label, name_of, rank_of
from .iterate import components, kept, narrow, stored


@dataclass(frozen=True)
class RoleThresholds:
    sweep: float = 0.9
    collector_in: int = 3
    collector_out: int = 2
    collector_excess: float = 1.5
    relay_balance: float = 0.5
    source_out: int = 3
    small_drops: int = 100_000


def severity_by_address(findings: DataFrame) -> DataFrame:
    """(address, rank, severity): the worst finding of each address."""
    ranked = findings.groupBy("address").agg(F.max(rank_of(F.col("severity"), SEVERITIES)).alias("rank"))
    return ranked.withColumn("severity", name_of(F.col("rank"), SEVERITIES))


def flag_edges(tx: DataFrame, findings: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Transactions between two different addresses of which one is flagged; the edge takes the worse severity.

    from_rank and to_rank stay null for addresses without a finding. Up to `most` flagged addresses are broadcast, so
    that transactions are not shuffled for either end; more are joined by shuffles.
    """
    flags = narrow(kept(severity_by_address(findings).select("address", "rank")), most)
    a = flags.select(F.col("address").alias("account"), F.col("rank").alias("from_rank"))
    b = flags.select(F.col("address").alias("destination"), F.col("rank").alias("to_rank"))
    joined = tx.where("account <> destination").join(a, "account", "left").join(b, "destination", "left")
    flagged = joined.where("from_rank IS NOT NULL OR to_rank IS NOT NULL")
    return flagged.withColumn("rank", F.greatest(F.coalesce("from_rank", F.lit(1)), F.coalesce("to_rank", F.lit(1))).cast("bigint")).withColumn("severity", name_of(F.col("rank"), SEVERITIES))


def edge_order(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns or ("ledger_seq", "hash", "account", "destination", "type", "amount_drops")]


def newest(edges: DataFrame, n: int) -> DataFrame:
    """The n last edges in the total order: a top-k, not a global sort."""
    return edges.orderBy(*(F.col(c).desc_nulls_last() for c in ("ledger_seq", "hash", "account", "destination", "type", "amount_drops"))).limit(n)


def node_aggregates(edges: DataFrame, small_drops: int = 100_000) -> DataFrame:
    """Degrees, sums and distinct counterparties of each address over its out- and in-edges."""
    drops = F.coalesce("amount_drops", F.lit(0))
    out = edges.select(F.col("account").alias("address"), F.col("destination").alias("other"), drops.alias("out"), F.lit(None).cast("bigint").alias("in"), F.col("to_rank").alias("rank"))
    into = edges.select(F.col("destination").alias("address"), F.col("account").alias("other"), F.lit(None).cast("bigint").alias("out"), drops.alias("in"), F.col("from_rank").alias("rank"))
    o, i, flagged = F.col("out").isNotNull(), F.col("in").isNotNull(), F.col("rank").isNotNull()
    # one row for each pair first, so distinct counts need no second shuffle of the edges
    pair = out.unionByName(into).groupBy("address", "other").agg(
        F.count("out").alias("n_out"), F.count("in").alias("n_in"), F.sum("out").alias("out"), F.sum("in").alias("in"), F.max("out").alias("max_out"),
        F.count_if((F.col("out") > 0) & (F.col("out") <= small_drops)).alias("small"), F.max(flagged & o).alias("to_flagged"), F.max(flagged & i).alias("from_flagged"),
    )
    return pair.groupBy("address").agg(
        F.sum("n_out").alias("degree_out"), F.sum("n_in").alias("degree_in"), F.coalesce(F.sum("out"), F.lit(0)).alias("out_drops"), F.coalesce(F.sum("in"), F.lit(0)).alias("in_drops"),
        F.count_if(F.col("n_in") > 0).alias("distinct_in"), F.sum("small").alias("small_out"), F.coalesce(F.max("max_out"), F.lit(0)).alias("max_out"),
        F.count_if("from_flagged").alias("flagged_in"), F.count_if("to_flagged").alias("flagged_out"),
    )


def node_roles(edges: DataFrame, th: RoleThresholds = RoleThresholds()) -> DataFrame:
    """Node aggregates with a role: drainer before collector, relay and source."""
    c = F.col
    drainer = (c("distinct_in") >= 2) & (c("degree_out") >= 1) & (c("in_drops") > 0) & (c("max_out") >= th.sweep * c("in_drops")) & (c("flagged_in") >= 1)
    collector = (c("degree_in") >= th.collector_in) & (c("distinct_in") >= th.collector_in) & (c("degree_out") <= th.collector_out) & (c("in_drops") >= th.collector_excess * c("out_drops")) & (c("flagged_in") >= 1)
    relay = (c("degree_in") >= 1) & (c("degree_out") >= 1) & (F.abs(c("in_drops") - c("out_drops")) <= th.relay_balance * F.greatest("in_drops", "out_drops"))
    source = (c("degree_out") >= th.source_out) & (c("small_out") >= th.source_out) & (c("degree_in") <= 1) & (c("flagged_out") >= 1)
    role = F.when(drainer, "drainer").when(collector, "collector").when(relay, "relay").when(source, "source").otherwise("unknown")
    return node_aggregates(edges, th.small_drops).withColumn("role", role)


def hub_cut(edges: DataFrame, most: int = 20) -> DataFrame:
    """Edges that connect: both ends are flagged or have at most `most` edges."""
    degree = edges.select(F.explode(F.array("account", "destination")).alias("address")).groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") > most).select("address", F.lit(True).alias("hub"))
    a, b = degree.select(F.col("address").alias("account"), F.col("hub").alias("a_hub")), degree.select(F.col("address").alias("destination"), F.col("hub").alias("b_hub"))
    joined = edges.join(a, "account", "left").join(b, "destination", "left")
    return joined.where("(a_hub IS NULL OR from_rank IS NOT NULL) AND (b_hub IS NULL OR to_rank IS NOT NULL)").drop("a_hub", "b_hub")


def clusters(edges: DataFrame, hub: int = 20) -> DataFrame:
    """Clusters over all edges: totals, first and last ledger, members, label by rank of (drops, transactions, first member).

    Addresses that only reach the cluster through a hub stand alone, as in the hub cut.
    """
    edges = stored(edges.select("account", "destination", "amount_drops", "ledger_seq", "from_rank", "to_rank"))  # read by each of the steps
    nodes = edges.select(F.explode(F.array("account", "destination")).alias("address")).distinct()
    member = nodes.join(components(hub_cut(edges, hub), "account", "destination").withColumnRenamed("node", "address"), "address", "left").withColumn("root", F.coalesce("root", "address"))
    size = member.groupBy("root").agg(F.count("*").alias("members"), F.min("address").alias("first_member"))
    total = edges.join(member.select(F.col("address").alias("account"), "root"), "account").groupBy("root").agg(F.coalesce(F.sum("amount_drops"), F.lit(0)).alias("total_drops"), F.count("*").alias("tx_count"), F.min("ledger_seq").alias("first_seen"), F.max("ledger_seq").alias("last_seen"))
    return size.join(total, "root", "left").na.fill(0, ["total_drops", "tx_count"]).drop("root")


def labelled(found: DataFrame, n: int) -> DataFrame:
    """The n largest clusters with labels A, B, ..; the rank runs over a top-k only."""
    top = found.orderBy(F.desc("total_drops"), F.desc("tx_count"), "first_member").limit(n)
    w = Window.orderBy(F.desc("total_drops"), F.desc("tx_count"), "first_member")
    return top.withColumn("label", epoch_label(F.row_number().over(w) - 1))


def transit_flags(tx: DataFrame, registry: DataFrame, least: int = 2) -> DataFrame:
    """Registry destinations that are paid under at least two tag identities ('none' is one)."""
    identity = F.coalesce(F.concat(F.lit("t"), F.col("tag").cast("string")), F.lit("none"))
    paid = tx.join(registry.select(F.col("address").alias("destination")), "destination", "left_semi")
    return paid.groupBy("destination").agg(F.countDistinct(identity).alias("identities"), F.count("*").alias("payments")).where(F.col("identities") >= least)


def live_edges(tx: DataFrame, findings: DataFrame, n: int = 60) -> DataFrame:
    """The newest n edges at flagged addresses."""
    return newest(flag_edges(tx, findings), n)


def entity_links(keys: DataFrame, hub: int = 20) -> DataFrame:
    """(address, key) without keys of more than hub owners or of one: what still links addresses."""
    owned = keys.where("key IS NOT NULL").select("address", "key").distinct()
    size = owned.groupBy("key").agg(F.count("*").alias("owners")).where(F.col("owners").between(2, hub))
    return owned.join(size, "key")


def entity_clusters(keys: DataFrame, hub: int = 20) -> DataFrame:
    """(entity, members, size): addresses that share keys, directly or over others; entity is the first address."""
    links = entity_links(keys, hub)
    anchor = links.groupBy("key").agg(F.min("address").alias("anchor"))
    joined = components(links.join(anchor, "key").where("address <> anchor"), "address", "anchor")
    return joined.groupBy("root").agg(F.count("*").alias("size")).select(F.col("root").alias("entity"), "size")


def entity_signals(keys: DataFrame, hub: int = 20) -> DataFrame:
    """(address, others): how many other addresses share a key with it; bounded, as hubs are gone."""
    links = entity_links(keys, hub).select("address", "key")
    other = links.select(F.col("address").alias("other"), "key")
    return links.join(other, "key").where("address <> other").groupBy("address").agg(F.countDistinct("other").alias("others"), F.countDistinct("key").alias("keys"))


def registry_role_rank(role: Column) -> Column:
    return rank_of(role, ROLES)
