"""Forms of the ledgers of a transaction stream, and their signatures against a rolling baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .parts import overlapping, placed

#: Types that are counted together.
KINDS = {
    "created": ["AccountCreate", "AccountDelete"],
    "offers": ["OfferCreate", "OfferCancel"],
    "nfts": ["NFTokenCreateOffer", "NFTokenMint", "NFTokenAcceptOffer", "NFTokenCancelOffer"],
    "features": ["EnableAmendment", "SetFee", "UNLModify", "EnableFeature"],
}


def forms(tx: DataFrame) -> DataFrame:
    """The form of each ledger of tx (ledger, hash, account, destination, type, fee, inner, failed).

    A hash counts once in a ledger (`repeated` are the further messages); transactions without one all
    count and are told in `unhashed`. The busiest account sent most transactions (ties: the smaller name);
    the fan-out is that of the account with most receivers. Fees are those above zero.
    """
    rest = ["account", "destination", "type", "fee", "inner", "failed"]
    known = tx.where("hash IS NOT NULL").groupBy("ledger", "hash").agg(F.min(F.struct(*rest)).alias("x"), (F.count("*") - 1).alias("again")).select("ledger", "hash", "x.*", "again")
    one = known.unionByName(tx.where("hash IS NULL").select("ledger", "hash", *rest, F.lit(0).cast("bigint").alias("again")))
    c, paid = F.col, F.when(F.col("fee") > 0, F.col("fee"))
    total = one.groupBy("ledger").agg(
        F.count("*").alias("n"), F.count_if(c("failed")).alias("failed"), *(F.count_if(c("type").isin(types)).alias(k) for k, types in KINDS.items()),
        F.count_if(c("inner") > 0).alias("batches"), F.coalesce(F.sum(F.when(c("inner") > 0, c("inner"))), F.lit(0)).cast("bigint").alias("inner"),
        F.coalesce(F.max(paid), F.lit(0)).alias("fee_most"), F.coalesce(F.percentile(paid, 0.5), F.lit(0.0)).alias("fee_median"), F.sum("again").alias("repeated"), F.count_if(c("hash").isNull()).alias("unhashed"),
    )
    pair = one.groupBy("ledger", "account", "destination").agg(F.count("*").alias("k"))
    sender = pair.where("account IS NOT NULL").groupBy("ledger", "account").agg(F.sum("k").alias("sent"), F.count("destination").alias("dests"))
    least = lambda *a: F.min(F.struct(*a))
    sent = sender.groupBy("ledger").agg(
        F.count("*").alias("senders"), least(F.negative("sent").alias("a"), "account", "sent").alias("busy"), least(F.negative("dests").alias("a"), "account", "sent", "dests").alias("wide"),
    )
    received = pair.where("destination IS NOT NULL").groupBy("ledger", "destination").agg(F.lit(1).alias("one")).groupBy("ledger").agg(F.count("*").alias("receivers"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    j = total.join(sent, "ledger", "left").join(received, "ledger", "left")
    fan = zero(c("wide.dests"))
    return j.select(
        "ledger", "n", zero(c("senders")).alias("senders"), zero(c("receivers")).alias("receivers"), c("busy.account").alias("busiest"), zero(c("busy.sent")).alias("busiest_tx"),
        fan.alias("fan_out"), F.when(fan > 0, c("wide.sent")).otherwise(0).cast("bigint").alias("fan_tx"), "failed", *KINDS, "batches", "inner", "fee_most", "fee_median", "repeated", "unhashed",
    )


def type_counts(tx: DataFrame, most: int = 12) -> DataFrame:
    """(ledger, type, n): the `most` frequent types of each ledger, a hash once (ties: the smaller name)."""
    by = tx.groupBy("ledger", "type", F.coalesce("hash", F.lit(""))).agg(F.when(F.max("hash").isNull(), F.count("*")).otherwise(1).alias("k")).groupBy("ledger", "type").agg(F.sum("k").alias("n"))
    w = Window.partitionBy("ledger").orderBy(F.desc("n"), "type")
    return by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def _median_with_zeros(values: Column, size: Column) -> Column:
    """Median of `size` numbers of which `values`, sorted, are those above zero."""
    at = lambda k: F.when(k < size - F.size(values), F.lit(0)).otherwise(F.get(values, (k - size + F.size(values)).cast("int")))
    half = F.floor(size / 2)
    return F.when(size % 2 == 1, at(half).cast("double")).otherwise((at(half - 1) + at(half)) / 2)


def signatures(
    form: DataFrame, types: DataFrame, base: int = 60, least: int = 10, width: int = 10_000, least_tx: int = 20, fan_out: int = 8, fan_tx: int = 10, burst_tx: int = 25, burst_share: float = 0.4,
    failures: int = 10, failure_share: float = 0.25, batches: int = 5, inner: int = 50, fee: int = 100_000, fee_ratio: float = 20, created: int = 10, offers: int = 40, nfts: int = 40, of_type: int = 20, ratio: float = 4, extreme: float = 10,
) -> DataFrame:
    """(ledger, tag, value, baseline) of each signature of a ledger's form, types being its type_counts.

    The baseline is the median of the last `base` ledgers, this one included, and counts from `least`
    ledgers on; a type's baseline starts with the type's first ledger and has zeros where it is absent.
    Ledgers are dealt to parts of `width` that overlap by the baseline, so no task holds all history.
    """
    c, none = F.col, F.lit(None).cast("double")
    row = Window.partitionBy("part").orderBy("place").rowsBetween(1 - base, 0)
    numbered = placed(form, "ledger", width=width)
    med = {k: F.percentile(c(k), 0.5).over(row) for k in ("n", "created", "offers", "nfts")}
    s = overlapping(numbered, base, width=width).select("*", *(m.alias(f"m_{k}") for k, m in med.items())).where("NOT guest")
    ready = c("place") + 1 >= least

    def hit(test, tag, value, baseline=none):
        return F.when(test, F.struct(F.lit(tag).alias("tag") if isinstance(tag, str) else tag.alias("tag"), value.cast("double").alias("value"), baseline.cast("double").alias("baseline")))

    def above(k: str, floor: int):
        return ready & (c(k) >= floor) & (c(k) >= ratio * c(f"m_{k}"))

    found = F.array(
        hit((c("fan_out") >= fan_out) & (c("fan_tx") >= fan_tx), "drainer-fanout", c("fan_out")),
        hit((c("busiest_tx") >= burst_tx) & (c("n") >= least_tx) & (c("busiest_tx") >= burst_share * c("n")), "sender-burst", c("busiest_tx")),
        hit((c("failed") >= failures) & (c("failed") >= failure_share * c("n")), "failure-spike", c("failed")),
        hit((c("batches") >= batches) & (c("inner") >= inner), "batch-amplify", c("inner")),
        hit((c("fee_most") >= fee) & (c("fee_median") > 0) & (c("fee_most") >= fee_ratio * c("fee_median")), "fee-spike", c("fee_most"), c("fee_median")),
        hit(c("features") > 0, "feature-change", c("features")),
        hit(above("created", created), "account-create-burst", c("created"), c("m_created")),
        hit(above("offers", offers), "offer-flood", c("offers"), c("m_offers")),
        hit(above("nfts", nfts), "nft-spam", c("nfts"), c("m_nfts")),
        hit(above("n", least_tx) & (c("m_n") > 0), F.when(c("n") >= extreme * c("m_n"), "load-extreme").otherwise("load-spike"), c("n"), c("m_n")),
    )
    plain = s.withColumn("hit", F.explode(F.array_compact(found))).select("ledger", "hit.*")

    at = types.withColumnRenamed("n", "k").join(numbered.select("ledger", "place"), "ledger")
    first = at.groupBy("type").agg(F.min("place").alias("first"))
    near = Window.partitionBy("type", "part").orderBy("place").rangeBetween(1 - base, 0)
    t = overlapping(at, base, width=width).withColumn("near", F.sort_array(F.collect_list("k").over(near))).where("NOT guest").join(first, "type")  # `base` entries at most
    baseline = _median_with_zeros(F.col("near"), F.least(F.lit(base), F.col("place") - F.col("first") + 1))
    burst = t.withColumn("baseline", baseline).where(ready & (c("k") >= of_type) & (c("baseline") > 0) & (c("k") >= ratio * c("baseline")))
    return plain.unionByName(burst.select("ledger", F.concat(F.lit("type-burst:"), "type").alias("tag"), c("k").cast("double").alias("value"), "baseline"))
