"""Live events around watched accounts: twelve branches, and an upsert of threats that may run again.

events: (hash, validated, account, destination, type, limit_issuer, issuer, touched, dest_tag, t_ms), touched being the accounts of
the offers that the entry's meta data names, in their order; watched: (address, label); own: (address), the operator's accounts.
A store is a log of changed rows by micro-batch; its view is the last version of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

THREAT = "address string, risk string, reason string, honeypot string, first_seen_ms bigint, events bigint"
EVIDENCE = "address string, hash string, type string, t_ms bigint, honeypot string, dest_tag bigint, risk string"


def branched(events: DataFrame, watched: DataFrame, own: DataFrame, most: int | None = None) -> DataFrame:
    """events with `branch`, and for those that make a threat its address, risk, reason and honeypot (null otherwise); works on streams too.

    A watched account's own act: to another watched one `internal`, to the operator's `operations`, an order `own-order` (suspect),
    else `compromised` (malicious). Another account's: `touch`, `trust` (it trusts a watched issuer), `mint` (in the name of one), `orderbook` (by an
    offer of one), malicious if a payment or a trust line; `unrelated`, `anonymous` without an account. Ahead of all: `unvalidated`, `unnamed` without
    a hash. Watched lists may have any length; with `most`, longer ones are refused. Only a stream's plan takes the list's addresses along.
    """
    if most is not None and watched.where("address is not null").select("address").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} watched accounts")
    side = watched.where("address is not null").groupBy("address").agg(F.min("label").alias("label"))
    j = events
    for col in ("account", "destination", "limit_issuer", "issuer"):
        j = j.join(side.select(F.col("address").alias(col), F.col("label").alias(f"_{col}")), col, "left")
    j = j.join(own.select(F.col("address").alias("destination"), F.lit(True).alias("_own")).distinct(), "destination", "left")
    if events.isStreaming:
        names = [r[0] for r in side.select("address").collect()]
        hit = F.get(F.filter("touched", lambda a: F.array_contains(F.lit(names).cast("array<string>"), a)), F.lit(0)) if names else F.lit(None).cast("string")
        j = j.withColumn("_hit", hit).join(side.select(F.col("address").alias("_hit"), F.col("label").alias("_touched")), "_hit", "left")
    else:  # each list of accounts is looked up once, however many events have it; events without one are spread
        lists = events.where("touched is not null").select("touched").distinct().select("touched", F.posexplode("touched").alias("_at", "address"))
        found = lists.join(side, "address").groupBy("touched").agg(F.min_by("label", "_at").alias("_touched"), F.min(F.lit(0).cast("bigint")).alias("_spread"))  # no constant, else it is no key
        j = j.withColumn("_spread", F.when(F.col("touched").isNull(), F.xxhash64("hash", "account", "t_ms")).otherwise(0)).join(found, ["touched", "_spread"], "left")
    mine, has = F.col("_account").isNotNull(), lambda c: F.col(f"_{c}").isNotNull()
    branch = (
        F.when(~F.coalesce("validated", F.lit(False)), "unvalidated").when(F.col("hash").isNull(), "unnamed")
        .when(mine & has("destination"), "internal").when(mine & F.coalesce("_own", F.lit(False)), "operations").when(mine & F.col("type").isin("OfferCreate", "OfferCancel"), "own-order").when(mine, "compromised")
        .when(F.col("account").isNull(), "anonymous").when(has("destination"), "touch").when(has("limit_issuer"), "trust").when(has("issuer"), "mint").when(has("touched"), "orderbook").otherwise("unrelated")
    )
    j = j.withColumn("branch", branch)
    outside = F.col("branch").isin("touch", "trust", "mint", "orderbook")
    grave = (F.col("branch") == "compromised") | (outside & F.col("type").isin("Payment", "TrustSet"))
    threat = outside | F.col("branch").isin("own-order", "compromised")
    label = F.when(mine, F.col("_account")).otherwise(F.coalesce("_destination", "_limit_issuer", "_issuer", "_touched"))
    return j.select(
        *events.columns, "branch", F.when(threat, F.col("account")).alias("address"), F.when(threat, F.when(grave, "malicious").otherwise("suspect")).alias("risk"),
        F.when(threat, F.concat_ws(" ", "branch", "type")).alias("reason"), F.when(threat, label).alias("honeypot"),
    )


def classified_stream(events: DataFrame, watched: DataFrame, own: DataFrame, delay: str = "1 hour") -> DataFrame:
    """branched() over a stream in which a hash counts once within the watermark; copies that come later meet the store's own test."""
    e = events.where("validated and hash is not null").withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash"]).drop("ts")
    return branched(e, watched, own)


def folded(old: DataFrame, seen: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed threats, new evidence) of classified events over the threats (THREAT) and the evidence (address, hash) there were.

    The first malicious event of an address gives risk and reason for good; before it, the first event does. Order is by time,
    then hash; the first time seen is the least of all; a hash counts once. Addresses whose events are all known don't change.
    """
    new = events.where("address is not null").select("address", "hash", "type", "t_ms", "honeypot", "dest_tag", "risk", "reason")
    new = new.groupBy("address", "hash").agg(F.min(F.struct("t_ms", "type", "honeypot", "dest_tag", "risk", "reason")).alias("e")).select("address", "hash", "e.*")
    new = new.join(seen.select("address", "hash").distinct(), ["address", "hash"], "left_anti")
    order = F.struct("t_ms", "hash", "reason", "honeypot")
    by = new.groupBy("address").agg(F.min(order).alias("any"), F.min(F.when(F.col("risk") == "malicious", order)).alias("bad"), F.min("t_ms").alias("least"), F.count("*").alias("n"))
    o = old.select("address", F.col("risk").alias("o_risk"), F.col("reason").alias("o_reason"), F.col("honeypot").alias("o_honeypot"), F.col("first_seen_ms").alias("o_first"), F.col("events").alias("o_events"))
    j = by.join(o, "address", "left")
    def pick(field: str, before: str) -> Column:
        return F.when(F.col("o_risk") == "malicious", F.col(before)).when(F.col("bad").isNotNull(), F.col(f"bad.{field}")).when(F.col("o_risk").isNotNull(), F.col(before)).otherwise(F.col(f"any.{field}"))

    risk = F.when((F.col("o_risk") == "malicious") | F.col("bad").isNotNull(), "malicious").otherwise("suspect")
    threats = j.select("address", risk.alias("risk"), pick("reason", "o_reason").alias("reason"), pick("honeypot", "o_honeypot").alias("honeypot"), F.least("least", "o_first").alias("first_seen_ms"), (F.col("n") + F.coalesce("o_events", F.lit(0))).alias("events"))
    return threats, new.select("address", "hash", "type", "t_ms", "honeypot", "dest_tag", "risk")


def logged(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of a log (with version, the micro-batch that wrote them) of the batches before a number, or of all; later folders are not read."""
    schema = f"{schema}, version bigint"
    try:
        rows = spark.read.schema(schema).parquet(path)
    except Exception as missing:  # noqa: BLE001  the first batch has nothing to read
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)
    return rows if before is None else rows.where(F.col("version") < before)


def current(rows: DataFrame, key: str) -> DataFrame:
    """The last version of each key."""
    others = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("r"), F.max("version").alias("version")).select(key, "r.*", "version")


def upserting(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps threats and evidence as logs under path.

    Batch n reads what batches before n wrote about its own addresses, and writes changed rows to a folder of its own, evidence last: run
    again, it writes the same folders again.
    """
    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.where("address is not null").persist()
        mine = df.select("address").distinct()
        old = current(logged(spark, f"{path}/threats", THREAT, number).join(mine, "address", "left_semi"), "address")
        seen = logged(spark, f"{path}/evidence", EVIDENCE, number).join(mine, "address", "left_semi")
        for name, rows in zip(("threats", "evidence"), folded(old, seen, df)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/version={number}")
        df.unpersist()

    return batch


def keep_threats(stream: DataFrame, path: str, checkpoint: str):
    """Starts the upsert of a classified stream; it ends when the input does."""
    return stream.writeStream.foreachBatch(upserting(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def threats(spark: SparkSession, path: str) -> DataFrame:
    """The store's view: one row an address, with the version that changed it last."""
    return current(logged(spark, f"{path}/threats", THREAT), "address")
