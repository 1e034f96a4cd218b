"""Raw ledger entries: reading, the three shapes, batches, moved money, records, actors, counterparties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import decoded_hex, normal_tag

#: Fields of a transaction. Those that hold an amount are strings: digits are drops, an object's text is an issued amount.
FIELDS = dict.fromkeys("TransactionType Account Destination Amount DeliverMax SendMax DeliverMin Fee DestinationTag SourceTag Owner URI RegularKey Authorize Holder Issuer hash close_time_iso TransactionResult Asset Asset2".split(), "string")
FIELDS |= dict.fromkeys("Flags Sequence TransferFee ledger_index close_time".split(), "bigint")
FIELDS |= {
    "Paths": "array<string>", "LimitAmount": "struct<currency:string,issuer:string,value:string>", "Memos": "array<struct<Memo:struct<MemoData:string,MemoFormat:string>>>",
    "SignerEntries": "array<struct<SignerEntry:struct<Account:string>>>",
}
_INNER = "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">"
FIELDS["RawTransactions"] = f"array<struct<RawTransaction:{_INNER}>>"
_TX = "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">"
_NODE = "struct<LedgerEntryType:string,FinalFields:struct<Account:string,Balance:string,Owner:string,Amount:string>,PreviousFields:struct<Balance:string>,NewFields:struct<Account:string,Balance:string>>"
META = f"struct<TransactionResult:string,delivered_amount:string,AffectedNodes:array<struct<CreatedNode:{_NODE},ModifiedNode:{_NODE},DeletedNode:{_NODE}>>>"
ENTRY = ", ".join(f"{k} {t}" for k, t in {"tx_json": _TX, "tx": _TX, "meta": META, "metaData": META, **FIELDS}.items())
_ISSUED = "struct<currency:string,issuer:string,value:string>"

#: Types whose amount is a price or a limit.
NO_MOVEMENT = ["NFTokenCreateOffer", "NFTokenAcceptOffer", "OfferCreate", "OfferCancel", "TrustSet", "AccountSet", "RegularKeySet", "NFTokenMint", "EnableAmendment", "SetFee", "UNLModify", "EscrowCancel", "CheckCancel"]
LEDGER_EPOCH = 946_684_800


def read_entries(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines of raw entries; fields of the wrong kind become null, a broken line ends the job (strict) or is left out."""
    broken = F.expr("try_parse_json(value) IS NULL")
    stop = F.raise_error(F.concat(F.lit("broken line: "), F.substring("value", 1, 80))).cast("boolean")
    lines = spark.read.text(path).where("trim(value) <> ''").where(F.when(broken, stop if strict else F.lit(False)).otherwise(F.lit(True)))
    return lines.select(F.from_json("value", ENTRY).alias("entry")).select("entry.*")


def normalized(entries: DataFrame) -> DataFrame:
    """(tx, meta, inner_of) of entries in any shape; rows without a transaction type are left out."""
    flat = F.struct(*map(F.col, FIELDS))
    tx = F.coalesce("tx_json", "tx", F.when(F.col("TransactionType").isNotNull(), flat))
    out = entries.select(tx.alias("tx"), F.coalesce("meta", "metaData").alias("meta"), F.coalesce("hash", "tx_json.hash", "tx.hash").alias("h"), F.coalesce("ledger_index", "tx_json.ledger_index", "tx.ledger_index").alias("i"), F.coalesce("close_time_iso", "tx_json.close_time_iso", "tx.close_time_iso").alias("c"))
    stamped = F.col("tx").withField("hash", F.col("h")).withField("ledger_index", F.col("i")).withField("close_time_iso", F.col("c"))
    return out.where("tx.TransactionType IS NOT NULL").select(stamped.alias("tx"), "meta", F.lit(None).cast("string").alias("inner_of"))


def expand_batches(rows: DataFrame) -> DataFrame:
    """rows with each batch's inner transactions as rows of their own: no meta, the batch's hash in inner_of."""
    inner = rows.where("tx.TransactionType = 'Batch' AND inner_of IS NULL").select("tx.hash", "tx.ledger_index", "tx.close_time_iso", F.explode("tx.RawTransactions.RawTransaction").alias("raw")).where("raw.TransactionType IS NOT NULL")
    given = {"hash": F.lit(None).cast("string"), "ledger_index": F.col("ledger_index"), "close_time_iso": F.col("close_time_iso"), "RawTransactions": F.lit(None).cast(FIELDS["RawTransactions"])}
    tx = F.struct(*(given.get(n, F.col(f"raw.{n}")).alias(n) for n in FIELDS))
    return rows.unionByName(inner.select(tx.alias("tx"), F.lit(None).cast(META).alias("meta"), F.col("hash").alias("inner_of")))


def executed() -> Column:
    """True without a result, or with success."""
    result = F.coalesce("meta.TransactionResult", "tx.TransactionResult")
    return result.isNull() | (result == "tesSUCCESS")


def drops(amount: Column) -> Column:
    return amount.try_cast("bigint")


def balance_delta(account: Column) -> Column:
    """Balance change of an account in meta, null unless exactly one of its roots has both balances."""
    roots = F.filter(
        F.transform("meta.AffectedNodes", lambda n: F.coalesce(n["ModifiedNode"], n["CreatedNode"], n["DeletedNode"])),
        lambda n: (n["LedgerEntryType"] == "AccountRoot") & (n["FinalFields"]["Account"] == account) & drops(n["PreviousFields"]["Balance"]).isNotNull() & drops(n["FinalFields"]["Balance"]).isNotNull(),
    )
    return F.when(F.size(roots) == 1, drops(roots[0]["FinalFields"]["Balance"]) - drops(roots[0]["PreviousFields"]["Balance"]))


def moved_drops() -> Column:
    """Drops that a transaction has moved, null where no movement is proven: what was delivered, not what was claimed."""
    c, claim = F.col, F.coalesce("tx.Amount", "tx.DeliverMax")
    cross = c("tx.SendMax").isNotNull() | (F.coalesce(F.size("tx.Paths"), F.lit(0)) > 0) | c("tx.DeliverMin").isNotNull()
    delta = balance_delta(c("tx.Destination"))
    payment = (
        F.when(c("meta.delivered_amount").isNotNull(), drops(c("meta.delivered_amount")))
        .when(~cross, drops(claim))
        .when(c("tx.Account") != c("tx.Destination"), F.when(delta > 0, delta))
    )
    moves = executed() & ~c("tx.TransactionType").isin(NO_MOVEMENT)
    return F.when(moves, F.when(c("tx.TransactionType") == "Payment", payment).otherwise(drops(claim)))


def moved_issued() -> Column:
    """(currency, issuer, value) of an issued amount that was moved, else null."""
    text = F.when(F.col("meta.delivered_amount").startswith("{"), F.col("meta.delivered_amount")).otherwise(F.coalesce("tx.Amount", "tx.DeliverMax"))
    a = F.from_json(F.when(text.startswith("{"), text), _ISSUED)
    value = a["value"].try_cast("double")
    ok = executed() & ~F.col("tx.TransactionType").isin(NO_MOVEMENT) & a["currency"].isNotNull() & a["issuer"].isNotNull() & value.isNotNull()
    return F.when(ok, F.struct(a["currency"].alias("currency"), a["issuer"].alias("issuer"), value.alias("value")))


def records(rows: DataFrame) -> DataFrame:
    """Transaction records of normalized rows, one each: money moved, counterparties, tags, times."""
    c = F.col
    owner = F.when(c("tx.TransactionType").isin("EscrowFinish", "EscrowCancel") & (c("tx.Owner") != c("tx.Account")), c("tx.Owner"))
    iso = F.coalesce("tx.close_time_iso", F.date_format(F.timestamp_seconds(c("tx.close_time") + LEDGER_EPOCH), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    destination = F.nullif(c("tx.Destination"), F.lit(""))
    return rows.select(
        c("tx.hash").alias("hash"), c("tx.ledger_index").alias("ledger_seq"), iso.alias("close_time"), c("tx.TransactionType").alias("type"), c("tx.Account").alias("account"),
        F.coalesce(destination, owner).alias("destination"), F.when(destination.isNotNull(), normal_tag(c("tx.DestinationTag"))).alias("destination_tag"), normal_tag(c("tx.SourceTag")).alias("source_tag"),
        moved_drops().alias("amount_drops"), moved_issued().alias("issued"), drops(c("tx.Fee")).alias("fee_drops"), c("tx.Flags").alias("flags"), "inner_of",
    )


def actors() -> Column:
    """Addresses that a transaction names, in order of their fields."""
    issuer = lambda c: F.get_json_object(F.when(F.col(c).startswith("{"), F.col(c)), "$.issuer")
    one = F.array(*(F.col(f"tx.{x}") for x in ("Account", "Destination", "LimitAmount.issuer", "Owner", "RegularKey", "Holder", "Authorize", "Issuer")))
    signers = F.coalesce(F.transform("tx.SignerEntries", lambda e: e["SignerEntry"]["Account"]), F.array().cast("array<string>"))
    return F.array_compact(F.concat(one, signers, F.array(issuer("tx.Asset"), issuer("tx.Asset2"), issuer("tx.Amount"))))


def memo_text() -> Column:
    """All memos' data and formats, decoded from hex and joined by spaces."""
    parts = F.flatten(F.transform("tx.Memos", lambda m: F.array(decoded_hex(m["Memo"]["MemoData"]), decoded_hex(m["Memo"]["MemoFormat"]))))
    return F.array_join(F.array_compact(parts), " ")


def counterparties(rows: DataFrame) -> DataFrame:
    """(address, other, direction, type, tag) of both ends of every transaction that has two.

    A trust line leads in from the issuer; payments and the like out to the destination.
    """
    c = F.col
    trust = c("tx.TransactionType") == "TrustSet"
    other = F.when(trust, c("tx.LimitAmount.issuer")).otherwise(c("tx.Destination"))
    tag = F.when(~trust, normal_tag(c("tx.DestinationTag")))
    flip = lambda a, b, way: F.struct(a.alias("address"), b.alias("other"), way.alias("direction"), tag.alias("tag"))
    both = F.array(flip(c("tx.Account"), other, F.when(trust, "in").otherwise("out")), flip(other, c("tx.Account"), F.when(trust, "out").otherwise("in")))
    return rows.where(other.isNotNull() & (other != c("tx.Account"))).select(c("tx.TransactionType").alias("type"), F.explode(both).alias("x")).select("x.address", "x.other", "x.direction", "type", "x.tag")
