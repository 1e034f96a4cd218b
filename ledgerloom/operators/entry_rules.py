"""Rules over single normalized entries (tx, meta, inner_of); findings are (rule_id, severity, address, note)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import decoded_hex, phishing, phishing_uri
from ..sources.ledger import actors, drops, executed, memo_text
from .rules import deduplicated, findings

#: The catalog of rules with their severities.
CATALOG = {
    "known-bad-hit": "malicious", "memo-phishing": "malicious", "drainer-sweep": "malicious", "airdrop-trustset-spam": "suspect", "dusting": "suspect", "fake-nft-fraud": "suspect", "escrow-check-bait": "suspect",
    "payment-burst": "suspect", "offer-spam": "info", "wash-self-transfer": "suspect", "peeling-chain": "suspect", "wash-cycle": "suspect", "amm-wash-swap": "suspect", "thin-pool-exploit": "suspect", "spoof-offer-cycle": "suspect",
    "amm-pool-drain": "suspect", "validator-unl-change": "suspect", "amendment-enabled": "info", "fee-change": "info", "account-delete-sweep": "suspect", "mass-sweep-convergence": "suspect", "batch-inner-control": "suspect",
}
#: Types with memos that are read, types that control an account, pseudo transactions.
MEMO_TYPES = ["Payment", "EscrowCreate", "CheckCreate", "TrustSet", "NFTokenMint", "PaymentChannelCreate"]
CONTROL_TYPES = ["SetRegularKey", "SignerListSet", "AccountSet", "AccountDelete", "DepositPreauth"]
GOVERNANCE = {"UNLModify": "validator-unl-change", "EnableAmendment": "amendment-enabled", "SetFee": "fee-change"}
ZERO_ACCOUNT = "rrrrrrrrrrrrrrrrrrrrrhoLvTp"


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG.items()), "rule_id string, severity string")


def known_bad_actors(rows: DataFrame, bad: DataFrame, benign: DataFrame | None = None) -> DataFrame:
    """Entries that name a bad address: the first such actor; malicious if it takes part or controls, else suspect."""
    listed = bad.select(F.col("address").alias("actor")).distinct()
    if benign is not None:
        listed = listed.join(benign.select(F.col("address").alias("actor")).distinct(), "actor", "left_anti")
    control = F.array_compact(F.concat(F.array("tx.Account", "tx.Destination", "tx.RegularKey", "tx.Authorize"), F.coalesce(F.transform("tx.SignerEntries", lambda e: e["SignerEntry"]["Account"]), F.array().cast("array<string>"))))
    named = rows.select(F.monotonically_increasing_id().alias("row"), control.alias("control"), F.posexplode(actors()).alias("pos", "actor"))
    hit = named.join(listed, "actor").groupBy("row").agg(F.min(F.struct("pos", "actor", F.array_contains("control", F.col("actor")).alias("part"))).alias("x")).select("x.actor", "x.part")
    return deduplicated(findings(hit, "known-bad-hit", F.when(F.col("part"), "malicious").otherwise("suspect"), "actor", F.lit("")))


def memo_phishing(rows: DataFrame) -> DataFrame:
    """Memos that phish; the issuer answers for trust lines and mints."""
    read = rows.where(F.col("tx.TransactionType").isin(MEMO_TYPES)).withColumn("memo", memo_text())
    who = F.when(F.col("tx.TransactionType") == "TrustSet", F.col("tx.LimitAmount.issuer")).when(F.col("tx.TransactionType") == "NFTokenMint", F.coalesce("tx.Issuer", "tx.Account")).otherwise(F.col("tx.Account"))
    hit = read.withColumn("level", phishing(F.col("memo"))).where("level IS NOT NULL").withColumn("who", who)
    return findings(hit, "memo-phishing", F.col("level"), "who", F.col("tx.hash"))


def batch_control(rows: DataFrame) -> DataFrame:
    """Inner transactions that control an account; malicious where the batch belongs to another one."""
    parent = rows.where("tx.TransactionType = 'Batch' AND inner_of IS NULL").select(F.col("tx.hash").alias("inner_of"), F.col("tx.Account").alias("parent"))
    hit = rows.where(F.col("tx.TransactionType").isin(CONTROL_TYPES) & F.col("inner_of").isNotNull()).join(parent, "inner_of", "left").withColumn("who", F.col("tx.Account"))
    return findings(hit, "batch-inner-control", F.when(F.col("parent") != F.col("who"), "malicious").otherwise("suspect"), "who", F.col("inner_of"))


def fake_nft(rows: DataFrame, fee: int = 50_000, benign: list[str] = ()) -> DataFrame:
    """Mints whose link phishes, or whose transfer fee is extreme and whose issuer is not benign."""
    mint = rows.where("tx.TransactionType = 'NFTokenMint'").withColumn("who", F.coalesce("tx.Issuer", "tx.Account"))
    link = phishing_uri(F.trim(decoded_hex(F.col("tx.URI"))))
    hit = mint.where(link | ((F.col("tx.TransferFee") >= fee) & ~F.col("who").isin(list(benign)))).withColumn("why", F.when(link, "uri").otherwise("fee"))
    return findings(hit, "fake-nft-fraud", "suspect", "who", F.col("why"))


def escrow_bait_entries(rows: DataFrame, fresh: DataFrame, tiny: int = 100) -> DataFrame:
    """Executed escrows and checks of tiny amounts to fresh addresses with a phishing memo."""
    dest = fresh.select(F.col("address").alias("to")).distinct()
    small = rows.where(F.col("tx.TransactionType").isin("EscrowCreate", "CheckCreate") & executed() & (drops(F.coalesce("tx.Amount", "tx.SendMax")) < tiny)).withColumn("to", F.col("tx.Destination"))
    hit = small.join(dest, "to", "left_semi").withColumn("who", F.col("tx.Account")).where(phishing(memo_text()).isNotNull())
    return findings(hit, "escrow-check-bait", "suspect", "who", F.col("tx.hash"))


def governance(rows: DataFrame) -> DataFrame:
    """Pseudo transactions: changes of the validator list, amendments and fees, filed under the zero account."""
    rule = F.create_map(*(F.lit(x) for kv in GOVERNANCE.items() for x in kv))
    hit = rows.where(F.col("tx.TransactionType").isin(list(GOVERNANCE))).withColumn("rule", rule[F.col("tx.TransactionType")])
    level = F.create_map(*(F.lit(x) for r in GOVERNANCE.values() for x in (r, CATALOG[r])))
    return hit.select(F.col("rule").alias("rule_id"), level[F.col("rule")].alias("severity"), F.lit(ZERO_ACCOUNT).alias("address"), F.col("tx.hash").alias("note"))
