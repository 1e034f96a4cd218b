"""Evidence around ledgers and accounts: indexes, scopes, closure proofs, guidance, residuals, searches, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def account_history(tx: DataFrame, address: str, limit: int) -> DataFrame:
    """The newest `limit` transactions at an address, and whether there were more: a top-k of limit + 1 rows."""
    own = tx.where((F.col("account") == address) | (F.col("destination") == address))
    newest = own.orderBy(F.desc_nulls_last("ledger_seq"), F.desc("hash")).limit(limit + 1)
    w = Window.orderBy(F.desc_nulls_last("ledger_seq"), F.desc("hash"))
    ranked = newest.withColumn("place", F.row_number().over(w).cast("bigint")).withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > limit)
    return ranked.where(F.col("place") <= limit)


def clean_names(names: DataFrame, most: int = 3000) -> DataFrame:
    """(address, name) with control signs and markup out, at most 40 characters; the first `most` by address."""
    name = F.trim(F.substring(F.regexp_replace("name", r"[\x00-\x1F<>#]", ""), 1, 40))
    return names.select("address", name.alias("name")).where("name <> ''").orderBy("address").limit(most)


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first, and those rows of second whose key first does not have."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def search(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows of which a column holds the needle in any case."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return rows.where(hit)


def in_range(edges: DataFrame, time: str, start: int) -> DataFrame:
    """Edges from start on; those without a time always stay."""
    return edges.where(F.col(time).isNull() | (F.col(time) >= start))


def fraud_edges(edges: DataFrame) -> DataFrame:
    """Edges with the verdict that the edge or one of its ends is malicious."""
    return edges.withColumn("fraud", F.greatest(F.col("rank"), F.coalesce("from_rank", F.lit(0)), F.coalesce("to_rank", F.lit(0))) >= 3)


def ledger_tags(stats: DataFrame, spike_tx: int = 50, spike: float = 3.0, extreme: float = 10.0, gap_ms: int = 15_000, gap: float = 4.0) -> DataFrame:
    """stats (ledger, tx, median_tx, gap_ms, median_gap, hashes, closed) with their tags in order."""
    c = F.col
    tags = F.array(
        F.when(~c("closed"), "no-quorum"),
        F.when(c("hashes") >= 2, "hash-split"),
        F.when((c("tx") >= spike_tx) & (c("tx") >= extreme * c("median_tx")), "load-extreme").when((c("tx") >= spike_tx) & (c("tx") >= spike * c("median_tx")), "load-spike"),
        F.when((c("gap_ms") >= gap_ms) & (c("gap_ms") >= gap * c("median_gap")), "close-gap"),
    )
    return stats.withColumn("tags", F.array_compact(tags))


def closure(ledgers: DataFrame, share: float = 0.8) -> DataFrame:
    """Bounds of each ledger (members, present, closed): votes needed, how many can really have been absent, how many absences are the recorder's at least."""
    need = F.ceil(F.col("members") * share).cast("bigint")
    absent = F.col("members") - F.col("present")
    most = F.when(F.col("closed"), F.col("members") - need)
    return ledgers.select("ledger", "members", "present", need.alias("needed"), most.alias("absent_most"), F.when(F.col("closed"), F.greatest(F.lit(0), absent - most)).cast("bigint").alias("artifact_least"))


def unproven(claims: DataFrame, proofs: DataFrame, key: str = "ledger") -> DataFrame:
    """Claimed ledgers without a proof."""
    return claims.select(key).distinct().join(proofs.select(key), key, "left_anti")


def agreed(a: DataFrame, b: DataFrame, key: str = "ledger") -> DataFrame:
    """Proofs on which two independent sources agree: equal hash, whatever its case."""
    other = b.select(key, F.upper("hash").alias("h"))
    return a.select(key, F.upper("hash").alias("hash")).join(other, key).where("hash = h").select(key, "hash").distinct()


def ledger_index(incidents: DataFrame, stats: DataFrame) -> DataFrame:
    """Ledgers of incidents and of stats side by side: incidents, masters, tx (each null where it is not recorded)."""
    by = incidents.groupBy("ledger").agg(F.count("*").alias("incidents"), F.countDistinct("master").alias("masters"))
    return by.join(stats.select("ledger", "tx"), "ledger", "full_outer")


def retrace(incidents: DataFrame, network: int = 5) -> DataFrame:
    """Incidents with the peers of their ledger by type, and the scope: solo, cohort or network."""
    kinds = ("missed", "partial", "wrong-hash")
    by = incidents.groupBy("ledger").agg(F.countDistinct("master").alias("masters"), *(F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds))
    peers = [(F.col(f"n_{k}") - F.when(F.col("type") == k, 1).otherwise(0)).cast("bigint").alias(f"peers_{k.replace('-', '_')}") for k in kinds]
    scope = F.when(F.col("masters") >= network, "network").when(F.col("masters") > 1, "cohort").otherwise("solo")
    return incidents.join(by, "ledger").select("ledger", "master", "t_ms", "type", scope.alias("scope"), *peers)


#: What a tag of the ledger asks to be checked.
GUIDANCE = {
    "hash-split": "report-split",
    "load-spike": "load-backlog",
    "load-extreme": "load-backlog",
    "amendment-activity": "version-state",
    "unl-change": "unl-membership",
    "new-tx-type": "parser-version",
    "quorum-thin": "quorum-margin",
    "drainer-fanout": "attack-drainer",
    "sweep-window": "attack-drainer",
    "sender-burst": "attack-burst",
    "offer-flood": "attack-spam",
    "nft-spam": "attack-spam",
    "account-create-burst": "attack-spam",
    "failure-spike": "attack-failed-tx",
    "batch-amplify": "attack-amplify",
    "fee-spike": "attack-fee",
    "feature-change": "version-state",
    "vote-late": "late-signing-path",
}


def guidance(incidents: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(ledger, master, type, check): what to look at next, each check once.

    incidents: (ledger, master, type, scope, closed), closed null where it is not known; hypotheses:
    (ledger, master, tag, strength, continuous). A stall of the network is only suspected where the
    ledger is known not to have closed, or at a gap within a continuous index.
    """
    c = F.col
    table = F.create_map(*(F.lit(x) for pair in GUIDANCE.items() for x in pair))
    by_tag = F.when(c("tag").startswith("type-burst:"), "attack-type-burst").when((c("tag") == "close-gap") & c("continuous"), "network-stall").otherwise(F.try_element_at(table, c("tag")))
    grouped = hypotheses.groupBy("ledger", "master").agg(F.collect_set(by_tag).alias("by_tag"), F.bool_or(c("strength").isin("measured", "correlated")).alias("explained"))  # as many as there are checks at most
    stalled = c("closed").eqNullSafe(F.lit(False))
    own = F.array(
        F.when(c("scope") == "network", F.when(stalled, "network-stall").otherwise("capture-window")),
        F.when(c("scope") == "cohort", "cohort-network"),
        F.when(c("scope") == "capture-cohort", "capture-window"),
        F.when(c("scope") == "solo", "solo-peering"),
        F.when(c("scope") == "solo", "solo-resources"),
        F.when(c("type") == "wrong-hash", "version-state"),
        F.when(~F.coalesce("explained", F.lit(False)), "unknown-cause"),
    )
    one = incidents.select("ledger", "master", "type", "scope", "closed").distinct().join(grouped, ["ledger", "master"], "left")
    checks = F.array_distinct(F.concat(F.array_compact(own), F.coalesce("by_tag", F.array().cast("array<string>"))))
    return one.withColumn("check", F.explode(checks)).select("ledger", "master", "type", "check").distinct()


def lift_for(tags: DataFrame, risk: DataFrame) -> DataFrame:
    """tags with the lift of the exact tag, else of what stands before its colon."""
    exact = risk.select("tag", F.col("lift").alias("e"))
    family = risk.select(F.col("tag").alias("f"), F.col("lift").alias("g"))
    return tags.join(exact, "tag", "left").join(family, F.substring_index("tag", ":", 1) == F.col("f"), "left").select("tag", F.coalesce("e", "g").alias("lift"))


def attack_signals(incidents: DataFrame, masters: int = 5, most: int = 12) -> DataFrame:
    """The `most` ledgers at which the most masters failed together, at least `masters`."""
    by = incidents.groupBy("ledger").agg(F.countDistinct("master").alias("masters"), F.count_if(F.col("type") == "missed").alias("missed"), F.min("t_ms").alias("t_ms"))
    return by.where(F.col("masters") >= masters).orderBy(F.desc("masters"), "ledger").limit(most)


def day_residual(day: DataFrame, hours: DataFrame) -> DataFrame:
    """(master, day, total): what a day's counters hold beyond the sum of its hours, never below zero."""
    h = hours.groupBy("master", "day").agg(F.sum("n").alias("hours"))
    rest = F.greatest(F.lit(0), F.col("n") - F.coalesce("hours", F.lit(0))).cast("bigint")
    return day.join(h, ["master", "day"], "left").select("master", "day", "n", F.coalesce("hours", F.lit(0)).cast("bigint").alias("hours"), rest.alias("residual"))


def covering_window(spans: DataFrame, windows: list[int]) -> DataFrame:
    """spans (.., hours) with the smallest window that covers them, null beyond all."""
    out = F.lit(None).cast("bigint")
    for w in sorted(windows, reverse=True):
        out = F.when(F.col("hours") <= w, w).otherwise(out)
    return spans.withColumn("window", out.cast("bigint"))


def dense_types(tx: DataFrame, ledger: str) -> DataFrame:
    """(type, ledger, n) of every ledger from a type's first one on, zeros included: ledgers without the type are filled in.

    The grid has a row for each of the few types and each ledger, made from the ledgers' own table.
    """
    seen = tx.groupBy("type", ledger).agg(F.count("*").alias("n"))
    first = tx.groupBy("type").agg(F.min(ledger).alias("first"))
    kinds = first.agg(F.collect_list(F.struct("type", "first")).alias("kinds"))  # one row, an entry for each type
    grid = tx.select(ledger).distinct().crossJoin(F.broadcast(kinds)).withColumn("k", F.explode("kinds")).where(F.col(ledger) >= F.col("k.first")).select(F.col("k.type").alias("type"), ledger)
    return grid.join(seen, ["type", ledger], "left").na.fill(0, ["n"])


def archive_retention(archive: DataFrame, now: int, plain: int, linked: int) -> DataFrame:
    """Archived rows (archived_at, last_seen, linked) that are young enough, from the later of their two times."""
    anchor = F.greatest("archived_at", "last_seen")
    return archive.where(F.lit(now) - anchor <= F.when(F.col("linked"), linked).otherwise(plain))


def once_a_day(new: DataFrame, archive: DataFrame) -> DataFrame:
    """Checkpoints (cluster, day) that the archive does not have yet."""
    return new.join(archive.select("cluster", "day"), ["cluster", "day"], "left_anti")


def capped_chains(chains: DataFrame, key: str, k: int) -> DataFrame:
    """Of each cluster its first k chains by signature, the last version of each (by seq)."""
    last = chains.groupBy(key, "signature").agg(F.max_by("hops", "seq").alias("hops"))
    w = Window.partitionBy(key).orderBy("signature")
    return last.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def contract(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(field, rows, broken): rows of each frame, and those for which the condition does not hold."""
    out = None
    for name, (df, ok) in checks.items():
        one = df.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("broken")).select(F.lit(name).alias("field"), "rows", "broken")
        out = one if out is None else out.unionByName(one)
    return out


def day_list(spark: SparkSession, last: str, days: int) -> DataFrame:
    """The days up to `last`, newest first by name."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date_sub(date'{last}', {days - 1}), date'{last}')")).alias("day")).select(F.col("day").cast("string").alias("day"))
