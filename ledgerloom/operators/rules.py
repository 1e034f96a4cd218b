"""Detector rules over normalized transactions. Findings are (rule_id, severity, address, note)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def findings(df: DataFrame, rule_id: str, severity: str | Column, address: str, note: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(rule_id).alias("rule_id"), severity.alias("severity"), F.col(address).alias("address"), note.cast("string").alias("note"))


def deduplicated(found: DataFrame, *place: str) -> DataFrame:
    """One finding for each (rule_id, address, note): the first by the columns `place` (without any, the gravest)."""
    first = F.struct(*place) if place else F.when(F.col("severity") == "malicious", 0).when(F.col("severity") == "suspect", 1).otherwise(2)
    return found.groupBy("rule_id", "address", "note").agg(F.min(F.struct(first.alias("at"), "severity")).alias("x")).select("rule_id", "x.severity", "address", "note")


def known_bad(tx: DataFrame, bad: DataFrame, benign: DataFrame | None = None) -> DataFrame:
    """The first actor of a transaction on the bad list: malicious as sender or receiver, if not benign."""
    listed = bad.select("address").distinct()
    if benign is not None:
        listed = listed.join(benign.select("address").distinct(), "address", "left_anti")
    a = listed.select(F.col("address").alias("account"), F.lit(True).alias("a"))
    b = listed.select(F.col("address").alias("destination"), F.lit(True).alias("b"))
    hit = tx.join(a, "account", "left").join(b, "destination", "left").where("a OR b").withColumn("actor", F.when(F.col("a"), F.col("account")).otherwise(F.col("destination")))
    return hit.groupBy("actor").agg(F.count("*").alias("n")).transform(lambda d: findings(d, "known-bad-hit", "malicious", "actor", F.col("n")))


def dusting(tx: DataFrame, tiny: int = 100, least: int = 3, history: DataFrame | None = None, fresh: DataFrame | None = None, least_fresh: int = 2) -> DataFrame:
    """Senders of tiny amounts to at least `least` distinct destinations, or to `least_fresh` fresh ones.

    history (account, destination) holds earlier tiny destinations, which count together with those at
    hand; fresh (address) the new accounts. Only accounts with a tiny payment at hand are reported.
    """
    now = tx.where(F.col("amount_drops") < tiny).select("account", "destination").distinct().withColumn("now", F.lit(1))
    if fresh is None:
        now = now.withColumn("fresh", F.lit(0))
    else:
        now = now.join(fresh.select(F.col("address").alias("destination"), F.lit(1).alias("fresh")).distinct(), "destination", "left").select("account", "destination", "now", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    if history is not None:
        now = now.unionByName(history.select("account", "destination", F.lit(0).alias("now"), F.lit(0).alias("fresh")))
    pair = now.groupBy("account", "destination").agg(F.max("now").alias("now"), F.max("fresh").alias("fresh"))
    by = pair.groupBy("account").agg(F.count("*").alias("n"), F.sum("fresh").alias("k"), F.max("now").alias("now")).where("now = 1")
    hit = by.where((F.col("n") >= least) | (F.col("k") >= least_fresh))
    return findings(hit, "dusting", "suspect", "account", F.when(F.col("n") >= least, F.col("n")).otherwise(F.col("k")))


def self_transfers(tx: DataFrame, asset: str = "pair", least: int = 3) -> DataFrame:
    """Accounts that pay themselves at least `least` times in one asset."""
    hit = tx.where("account = destination").groupBy("account", asset).agg(F.count("*").alias("k")).where(F.col("k") >= least).groupBy("account").agg(F.max("k").alias("n"))
    return findings(hit, "wash-self-transfer", "suspect", "account", F.col("n"))


def drainer_sweep(tx: DataFrame, share: float = 0.9, fresh: DataFrame | None = None, history: DataFrame | None = None, balances: DataFrame | None = None, dust: int = 100, least_dust: int = 3) -> DataFrame:
    """The first payment of a funded account that moves `share` of what it had to a destination that never paid it.

    What it had is its balance before (balances: hash, balance), else what it received, else what history
    (account, funded) says; funded are accounts with receipts, `least_dust` tiny ones or a history. fresh
    (account, created) names the accounts that are new; created ones are malicious, the others suspect.
    Without it every account counts, as suspect. Payers are matched by an anti join, never collected.
    """
    into = tx.where("account <> destination").groupBy(F.col("destination").alias("account")).agg(F.sum("amount_drops").alias("received"), F.count_if(F.col("amount_drops") < dust).alias("dust"))
    payer = tx.select(F.col("destination").alias("account"), F.col("account").alias("destination")).distinct()
    out = tx.where("account <> destination").join(payer, ["account", "destination"], "left_anti").join(into, "account", "left")
    out = out.withColumn("funded", F.lit(None).cast("bigint")) if history is None else out.join(history.select("account", "funded"), "account", "left")
    out = out.withColumn("balance", F.lit(None).cast("bigint")) if balances is None else out.join(balances.select("hash", "balance"), "hash", "left")
    out = out.withColumn("created", F.lit(False)) if fresh is None else out.join(fresh.select("account", "created"), "account")
    had = F.coalesce("balance", F.when(F.col("received") > 0, F.col("received")), "funded")
    paid = (F.col("received") > 0) | (F.col("dust") >= least_dust) | F.col("funded").isNotNull()
    hit = out.where(paid & (had > 0) & (F.col("amount_drops") >= share * had)).groupBy("account").agg(F.min(F.struct("ledger_seq", "hash", "amount_drops", "created")).alias("f")).select("account", "f.amount_drops", "f.created")
    return findings(hit, "drainer-sweep", F.when(F.col("created"), "malicious").otherwise("suspect"), "account", F.col("amount_drops"))


def payment_burst(tx: DataFrame, tiny: int, least: int = 5, least_tiny: int = 3, slack: int = 2, bad: DataFrame | None = None) -> DataFrame:
    """At least `least` destinations, all but `slack` of them paid tiny amounts, and `least_tiny` of these or one on the list `bad` (address)."""
    pair = tx.groupBy("account", "destination").agg(F.bool_or(F.col("amount_drops") < tiny).alias("small"))
    pair = pair.withColumn("bad", F.lit(None).cast("boolean")) if bad is None else pair.join(bad.select(F.col("address").alias("destination"), F.lit(True).alias("bad")).distinct(), "destination", "left")
    by = pair.groupBy("account").agg(F.count("*").alias("n"), F.count_if("small").alias("k"), F.count_if("bad").alias("b"))
    hit = by.where((F.col("n") >= least) & ((F.col("k") >= least_tiny) | (F.col("b") > 0)) & (F.col("k") >= F.col("n") - slack))
    return findings(hit, "payment-burst", "suspect", "account", F.concat_ws("/", "k", "n"))


def trust_spam(tx: DataFrame, tiny: int, least: int = 5) -> DataFrame:
    """Issuers (destinations) that at least `least` distinct accounts trust with tiny limits."""
    hit = tx.where((F.col("amount_drops") > 0) & (F.col("amount_drops") < tiny) & (F.col("account") != F.col("destination"))).groupBy("destination").agg(F.countDistinct("account").alias("n")).where(F.col("n") >= least)
    return findings(hit, "airdrop-trustset-spam", "suspect", "destination", F.col("n"))


def wash_swap(fills: DataFrame, least: int = 2, alike: float = 0.9, drift: float = 0.1, span: int = 150, floor: int = 1_000_000) -> DataFrame:
    """fills (account, pair, direction, notional, ledger_seq): an account that trades a pair both ways for alike sums.

    Each way has at least `least` fills and `floor` drops, the lesser sum is at least `alike` of the larger
    and `drift` below it at most, all within `span` ledgers. Of an account's pairs the first is reported.
    """
    way = fills.groupBy("account", "pair", "direction").agg(F.count("*").alias("n"), F.sum("notional").alias("v"), F.min("ledger_seq").alias("f"), F.max("ledger_seq").alias("l"))
    both = way.groupBy("account", "pair").agg(F.count("*").alias("ways"), F.min("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), (F.max("l") - F.min("f")).alias("span"))
    fair = (F.col("most") > 0) & (F.col("least") >= floor) & (F.col("least") >= alike * F.col("most")) & (F.col("most") - F.col("least") <= drift * F.col("most"))
    hit = both.where((F.col("ways") >= 2) & (F.col("n") >= least) & fair & (F.col("span") <= span))
    return findings(hit.groupBy("account").agg(F.min("pair").alias("pair")), "amm-wash-swap", "suspect", "account", F.col("pair"))


def thin_pool(fills: DataFrame, least_rates: int = 5, off: float = 0.25, least: int = 2, floor: int = 10_000_000, span: int = 150) -> DataFrame:
    """fills (account, pair, up, rate, notional, ledger_seq): at least `least` fills that beat the pair's median rate by the share `off`.

    up tells whether a higher rate favours the account. Pairs need `least_rates` rates, fills `floor`
    drops, and an account's fills lie within `span` ledgers. Of an account's pairs the first is reported.
    """
    mid = fills.groupBy("pair").agg(F.expr("percentile(rate, 0.5)").alias("mid"), F.count("rate").alias("rates")).where((F.col("rates") >= least_rates) & (F.col("mid") > 0))
    gain = F.when(F.col("up"), F.col("rate") - F.col("mid")).otherwise(F.col("mid") - F.col("rate"))
    own = fills.join(mid, "pair").where((F.col("notional") >= floor) & (gain >= off * F.col("mid")))
    by = own.groupBy("account", "pair").agg(F.count("*").alias("n"), (F.max("ledger_seq") - F.min("ledger_seq")).alias("span")).where((F.col("n") >= least) & (F.col("span") <= span))
    return findings(by.groupBy("account").agg(F.min("pair").alias("pair")), "thin-pool-exploit", "suspect", "account", F.col("pair"))


def spoof_cycles(orders: DataFrame, within: int = 75, least: int = 3, floor: int = 100_000_000, levels: int = 2, span: int = 300) -> DataFrame:
    """orders (account, sequence, book, level, notional, ledger_seq, hash, kind create|cancel): large orders that are soon cancelled.

    A cancel belongs to the create just before it under its (account, sequence, book). At least `least` of
    them in a book, of `floor` drops each, at `levels` price levels, within `span` ledgers. Level and notional
    are the cancel's, or else the create's. Of an account's books the first is reported.
    """
    w = Window.partitionBy("account", "sequence", "book").orderBy("ledger_seq", "hash")
    before = lambda c: F.lag(c).over(w)
    paired = orders.select("account", "book", "kind", "ledger_seq", before("kind").alias("k"), before("ledger_seq").alias("made"), F.coalesce("level", before("level")).alias("level"), F.coalesce("notional", before("notional")).alias("notional"))
    soon = paired.where((F.col("kind") == "cancel") & (F.col("k") == "create") & (F.col("ledger_seq") - F.col("made") <= within) & (F.col("notional") >= floor))
    by = soon.groupBy("account", "book").agg(F.count("*").alias("n"), F.countDistinct("level").alias("levels"), (F.max("ledger_seq") - F.min("made")).alias("span"))
    hit = by.where((F.col("n") >= least) & (F.col("levels") >= levels) & (F.col("span") <= span)).groupBy("account").agg(F.min("book").alias("book"))
    return findings(hit, "spoof-offer-cycle", "suspect", "account", F.col("book"))


def sweep_convergence(tx: DataFrame, balances: DataFrame, share: float = 0.9, least: int = 5) -> DataFrame:
    """Destinations to which at least `least` accounts pay `share` of their own balance."""
    hit = tx.join(balances, "account").where((F.col("balance") > 0) & (F.col("amount_drops") >= share * F.col("balance")) & (F.col("account") != F.col("destination"))).groupBy("destination").agg(F.countDistinct("account").alias("n")).where(F.col("n") >= least)
    return findings(hit, "mass-sweep-convergence", "malicious", "destination", F.col("n"))


def delete_sweep(tx: DataFrame, least: int = 3) -> DataFrame:
    """Destinations of the last payment ever of at least `least` accounts."""
    last = tx.groupBy("account").agg(F.max(F.struct("ledger_seq", "hash", "destination")).alias("x")).select("account", "x.destination")
    hit = last.where("account <> destination").groupBy("destination").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return findings(hit, "account-delete-sweep", "suspect", "destination", F.col("n"))


def offer_spam(tx: DataFrame, least: int = 10) -> DataFrame:
    """At least `least` offers of an account of which none was filled (kind offer, filled boolean)."""
    hit = tx.groupBy("account").agg(F.count_if(F.col("kind") == "offer").alias("n"), F.count_if(F.col("filled")).alias("f")).where((F.col("n") >= least) & (F.col("f") == 0))
    return findings(hit, "offer-spam", "info", "account", F.col("n"))


def nft_bursts(tx: DataFrame, least: int = 5, accepts: DataFrame | None = None, least_accepts: int = 10) -> DataFrame:
    """At least `least` offers from one account to one owner, or `least_accepts` accepted offers (account, amount_drops) without payment."""
    hit = tx.groupBy("account", "destination").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = findings(hit, "fake-nft-fraud", "suspect", "account", F.concat_ws(":", "destination", "n"))
    if accepts is None:
        return found
    free = accepts.where("amount_drops = 0").groupBy("account").agg(F.count("*").alias("n")).where(F.col("n") >= least_accepts)
    return found.unionByName(findings(free, "fake-nft-fraud", "suspect", "account", F.col("n")))


def escrow_bait(tx: DataFrame, tiny: int, first_seen: DataFrame, fresh: int, least: int = 3) -> DataFrame:
    """Escrows of tiny amounts from one account to at least `least` distinct destinations that are new (first seen at most `fresh` ledgers before)."""
    dest = first_seen.select(F.col("address").alias("destination"), "first_ledger")
    hit = tx.where((F.col("type") == "EscrowCreate") & (F.col("amount_drops") < tiny)).join(dest, "destination").where(F.col("ledger_seq") - F.col("first_ledger") <= fresh).groupBy("account").agg(F.countDistinct("destination").alias("n")).where(F.col("n") >= least)
    return findings(hit, "escrow-check-bait", "suspect", "account", F.col("n"))


def pool_drain(events: DataFrame, share: float, least: float) -> DataFrame:
    """events (pool, before, taken): a withdrawal of at least `share` of a side that held at least `least`."""
    hit = events.where((F.col("before") >= least) & (F.col("taken") >= share * F.col("before"))).groupBy("pool").agg(F.count("*").alias("n"))
    return findings(hit, "amm-pool-drain", "suspect", "pool", F.col("n"))


def together(*found: DataFrame) -> DataFrame:
    """All findings, equal ones once: that of the rule that stands first."""
    return deduplicated(reduce(DataFrame.unionByName, (f.withColumn("place", F.lit(k)) for k, f in enumerate(found))), "place")


def rule_rates(found: DataFrame, transactions: int) -> DataFrame:
    """Findings of each rule and per thousand transactions."""
    return found.groupBy("rule_id").agg(F.count("*").alias("findings"), F.countDistinct("address").alias("addresses")).withColumn("per_thousand", F.round(F.col("findings") * 1000 / F.lit(transactions), 6))
