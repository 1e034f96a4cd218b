"""What the rules take as given, and what confirms them: protected and known addresses, watchlists, countries, totals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .iterate import kept
from .rules import drainer_sweep


def without(rows: DataFrame, listed: DataFrame, *ends: str) -> DataFrame:
    """Rows none of whose columns `ends` is a listed address; a null end is none. One anti join for each end."""
    for k, end in enumerate(ends):
        bad = listed.select(F.col("address").alias(f"_listed_{k}")).where(F.col(f"_listed_{k}").isNotNull()).distinct()
        rows = rows.join(bad, F.col(end) == F.col(f"_listed_{k}"), "left_anti")
    return rows


def detection_context(knowledge: DataFrame, history: DataFrame, state: DataFrame, drained_history: DataFrame, drained_state: DataFrame, registry: DataFrame, protected: DataFrame) -> DataFrame:
    """(address, known_bad, first_seen, drainer, funded): what the rules know of an address beforehand.

    knowledge, history and state are (address, first_seen), in order of precedence; within one the earliest
    counts. The drained ones are (address, out_drops), history before state, the largest within one; no drops
    are a null funded. Known are addresses of knowledge. Registered addresses stay out of knowledge and
    history, protected ones out of all. All layers meet in one aggregation; there is no cap on addresses.
    """
    seen = [d.select("address", F.lit(k).alias("layer"), F.col("first_seen").cast("bigint").alias("first_seen"), F.lit(None).cast("bigint").alias("out"), F.lit(True).alias("seen")) for k, d in enumerate((knowledge, history, state))]
    drained = [d.select("address", F.lit(k).alias("layer"), F.lit(None).cast("bigint").alias("first_seen"), F.col("out_drops").cast("bigint").alias("out"), F.lit(False).alias("seen")) for k, d in ((0, drained_history), (2, drained_state))]
    outer = without(reduce(DataFrame.unionByName, [*seen[:2], drained[0]]), registry, "address")
    rows = without(reduce(DataFrame.unionByName, [outer, seen[2], drained[1]]), protected, "address").where("address IS NOT NULL")
    first = F.min(F.when(F.col("seen") & F.col("first_seen").isNotNull(), F.struct("layer", "first_seen")))
    funded = F.min(F.when(~F.col("seen"), F.struct("layer", F.negative(F.coalesce("out", F.lit(0))).alias("out"))))
    by = rows.groupBy("address").agg(F.bool_or(F.col("seen") & (F.col("layer") == 0)).alias("known_bad"), first.alias("a"), funded.alias("b"))
    out = F.negative(F.col("b.out"))
    return by.select("address", "known_bad", F.col("a.first_seen").alias("first_seen"), F.col("b").isNotNull().alias("drainer"), F.when(out > 0, out).alias("funded"))


def confirmed_sweeps(touched: DataFrame, tx: DataFrame, balances: DataFrame | None = None, newest: int = 100, share: float = 0.9) -> DataFrame:
    """(address, ratio, drops, severity) of touched (address, created) that the sweep rule confirms.

    Only the `newest` payments at an address count, each address for itself: of these the largest share that
    one payment took of the balance before (balances: hash, balance), else of all receipts, has to be `share`,
    and the rule has to fire. The rule runs once over all addresses, with accounts named (address, account).
    """
    asked = touched.groupBy("address").agg(F.bool_or("created").alias("created"))
    ends = tx.select("hash", "ledger_seq", "account", "destination", "amount_drops").withColumn("address", F.explode(F.array_distinct(F.array("account", "destination"))))
    w = Window.partitionBy("address").orderBy(F.desc_nulls_last("ledger_seq"), F.desc("hash"))
    recent = kept(ends.join(asked, "address").withColumn("place", F.row_number().over(w)).where(F.col("place") <= newest))  # read by the rule and by the shares
    named = recent.select("hash", "ledger_seq", "amount_drops", *(F.struct("address", F.col(c).alias("account")).alias(c) for c in ("account", "destination")))
    fresh = asked.select(F.struct("address", F.col("address").alias("account")).alias("account"), "created")
    rule = drainer_sweep(named, share, fresh=fresh, balances=balances).select(F.col("address.address").alias("address"), "severity").distinct()

    had = recent.withColumn("balance", F.lit(None).cast("bigint")) if balances is None else recent.join(balances.select("hash", "balance"), "hash", "left")
    into = F.sum(F.when((F.col("account") != F.col("address")) & (F.col("amount_drops") > 0), F.col("amount_drops"))).over(Window.partitionBy("address"))
    base = F.coalesce("balance", "received", F.lit(0))
    out = had.withColumn("received", into).where((F.col("account") == F.col("address")) & (F.col("amount_drops") > 0) & (base > 0))
    best = out.groupBy("address").agg(F.max(F.struct((F.col("amount_drops") / base).alias("ratio"), "ledger_seq", "hash", "amount_drops")).alias("x"))
    return best.where(F.col("x.ratio") >= share).join(rule, "address").select("address", F.round("x.ratio", 6).alias("ratio"), F.col("x.amount_drops").alias("drops"), "severity")


def watchlist(registry: DataFrame, lists: list[str], most: int = 12) -> DataFrame:
    """The `most` masters of the registry (master, domain, lists, last_seen) seen last that have a domain and stand on one of the lists."""
    listed = F.arrays_overlap("lists", F.array(*map(F.lit, lists)))
    return registry.where((F.col("domain") != "") & listed).orderBy(F.desc_nulls_last("last_seen"), "master").limit(most).select("master", "domain")


def listed_masters(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Listed keys (master) with the domain of the registry, and whether it knows them; no key is dropped."""
    known = registry.groupBy("master").agg(F.max(F.when(F.col("domain") != "", F.col("domain"))).alias("domain")).withColumn("matched", F.lit(True))
    return keys.select("master").distinct().join(known, "master", "left").na.fill(False, ["matched"])


def _folding():
    def folded(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in names:
            yield s.str.strip().str.normalize("NFKC").str.lower()

    return F.pandas_udf(folded, "string")


def matched_countries(names: DataFrame, countries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, country): names by their compatibility form in lower case, else by alias (alias, country); null if there is none.

    Only distinct names reach Python, and of these only the ones that are not plain ASCII.
    """
    def keyed(df: DataFrame, name: str) -> DataFrame:
        c = F.col(name)
        plain, other = F.coalesce(c.rlike(r"^[\x00-\x7F]*$"), F.lit(True)), ~c.rlike(r"^[\x00-\x7F]*$")
        return df.where(plain).withColumn("key", F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))).unionByName(df.where(other).withColumn("key", _folding()(c)))

    by = keyed(countries.select("country").distinct(), "country").groupBy("key").agg(F.min("country").alias("direct"))
    other = keyed(aliases.select(F.col("country").alias("target"), "alias").distinct(), "alias").select(F.col("key").alias("alias_key"), "target")
    target = keyed(other, "target").join(by, "key").groupBy(F.col("alias_key").alias("key")).agg(F.min("direct").alias("aliased"))
    asked = keyed(names.select("name").distinct(), "name").withColumn("key", F.when(F.col("key") != "", F.col("key")))
    return asked.join(by, "key", "left").join(target, "key", "left").select("name", F.coalesce("direct", "aliased").alias("country"))


def window_totals(buckets: DataFrame, *counts: str) -> DataFrame:
    """One row: the sum of each count over the buckets; what is no number counts as zero."""
    return buckets.agg(*(F.coalesce(F.sum(F.col(c).cast("string").try_cast("bigint")), F.lit(0)).alias(c) for c in counts))


def fraud_first(clusters: DataFrame, rules: list[str], most: int) -> DataFrame:
    """The `most` clusters (key, rules, last_seen) that a capped history keeps: those with one of the rules first, then the newest, then by key."""
    fraud = F.coalesce(F.arrays_overlap("rules", F.array(*map(F.lit, rules))), F.lit(False))
    return clusters.withColumn("fraud", fraud).orderBy(F.desc("fraud"), F.desc_nulls_last("last_seen"), "key").limit(most).select("key", "last_seen", "fraud")
