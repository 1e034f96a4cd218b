"""Composed answers: absent members, account eligibility, one row for each validator, the network in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import validators as D
from .iterate import kept
from .serving import account_scores


def absent_members(votes: DataFrame, members: DataFrame, need: int, width: int = 2_000) -> DataFrame:
    """(ledger, master, type) of every member without a vote: missed where the ledger has `need` member votes, else vote-not-observed.

    The validator list may have any length: it is cut by hash into stretches of about `width` members, and a ledger has a row for each.
    """
    members = kept(members.select("master").where("master is not null").distinct())
    stretches = max(1, -(-members.count() // width))
    cut = F.pmod(F.xxhash64("master"), F.lit(stretches)).alias("stretch")
    listed = members.groupBy(cut).agg(F.collect_set("master").alias("members"))
    by = votes.join(members, "master", "left_semi").groupBy("ledger", cut).agg(F.collect_set("master").alias("there"))
    voters = by.groupBy("ledger").agg(F.sum(F.size("there")).alias("n"))
    none = F.array().cast("array<string>")
    all_ledgers = votes.select("ledger").distinct().join(voters, "ledger", "left").withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1)).cast("array<bigint>")))
    held = all_ledgers.join(by, ["ledger", "stretch"], "left").join(listed, "stretch")
    kind = F.when(F.coalesce("n", F.lit(0)) >= need, "missed").otherwise("vote-not-observed")
    return held.select("ledger", F.explode(F.array_except("members", F.coalesce("there", none))).alias("master"), kind.alias("type"))


def eligibility(tx: DataFrame, flags: DataFrame, least: int = 85) -> DataFrame:
    """Account scores with whether the account may be admitted: clean and scored at least `least`."""
    return account_scores(tx, flags).withColumn("eligible", (F.col("score") >= least) & (F.col("verdict") == "clean"))


def validator_report(votes: DataFrame, network: int = 5) -> DataFrame:
    """One row for each master: rates, peer verdict, scope split, longest run, busiest hour. Inputs are computed once each and joined on the master."""
    bad = votes.where("type <> 'ok'")
    peer = D.peer_benchmark(votes, outlier=2.0).select("master", "n", "f", "rate", "verdict")
    runs = D.failure_runs(bad).groupBy("master").agg(F.max("ledgers").alias("longest_run"), F.count("*").alias("runs"))
    peak = D.fingerprint(votes).select("master", "peak_hour", "peak_share")
    return peer.join(D.failure_split(bad, network), "master", "left").join(runs, "master", "left").join(peak, "master", "left").na.fill(0, ["solo", "cohort", "network", "longest_run", "runs"])


def network_report(votes: DataFrame, network: int = 5) -> DataFrame:
    """The network in one row: votes, masters, ledgers, failing ledgers by scope, incidents by type."""
    scope = D.by_ledger(votes.where("type <> 'ok'"), network).agg(*(F.count_if(F.col("scope") == s).alias(f"{s}_ledgers") for s in ("solo", "cohort", "network")))
    total = votes.agg(F.count("*").alias("votes"), F.countDistinct("master").alias("masters"), F.countDistinct("ledger").alias("ledgers"), *(F.count_if(F.col("type") == k).alias(k.replace("-", "_")) for k in ("missed", "partial", "wrong-hash")))
    return total.crossJoin(F.broadcast(scope))  # one row each
