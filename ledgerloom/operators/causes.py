"""What explains incidents: latency, divergence, stress, ranked causes, truth against a reference, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def vote_latency(votes: DataFrame, steady_ms: int = 2500) -> DataFrame:
    """Of each master: delays against the first vote of the ledger, and whether they are a steady offset."""
    first = votes.groupBy("ledger").agg(F.min("t_ms").alias("first_ms"))
    d = votes.join(first, "ledger").withColumn("delay", F.col("t_ms") - F.col("first_ms"))
    by = d.groupBy("master").agg(F.count("*").alias("votes"), F.min("delay").alias("least"), F.round(F.percentile(F.col("delay"), 0.5), 3).alias("median"), F.round(F.percentile(F.col("delay"), 0.9), 3).alias("p90"), F.max("delay").alias("most"), F.round(F.avg("delay"), 6).alias("mean"))
    return by.withColumn("steady", F.col("p90") - F.col("median") <= steady_ms)


def late_votes(votes: DataFrame, grace_ms: int) -> DataFrame:
    """Of each master: votes later than the grace after the ledger's first vote, and the longest delay."""
    first = votes.groupBy("ledger").agg(F.min("t_ms").alias("first_ms"))
    late = votes.join(first, "ledger").withColumn("delay", F.col("t_ms") - F.col("first_ms")).where(F.col("delay") > grace_ms)
    return late.groupBy("master").agg(F.count("*").alias("late"), F.max("delay").alias("longest"))


def divergence(wrong: DataFrame, repeated: int = 3, shared: int = 2) -> DataFrame:
    """Losing lineages (hash) of wrong votes (ledger, master, hash): how often and by how many, repeated or shared."""
    by = wrong.groupBy("hash").agg(F.count("*").alias("votes"), F.countDistinct("ledger").alias("ledgers"), F.countDistinct("master").alias("masters"))
    return by.withColumn("repeated", F.col("ledgers") >= repeated).withColumn("shared", F.col("masters") >= shared)


def stress_coupling(cells: DataFrame) -> DataFrame:
    """Of each master: risk difference of stressed against calm ledgers of the same band, weighted over bands.

    cells: (master, band, stressed, failed). The weight of a band is n1 n0 / (n1 + n0).
    """
    by = cells.groupBy("master", "band").agg(F.count_if("stressed").alias("n1"), F.count_if(~F.col("stressed")).alias("n0"), F.count_if(F.col("stressed") & F.col("failed")).alias("f1"), F.count_if(~F.col("stressed") & F.col("failed")).alias("f0")).where("n1 > 0 AND n0 > 0")
    w = F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))
    out = by.groupBy("master").agg(F.count("*").alias("bands"), F.sum("n1").alias("stressed"), (F.sum(w * (F.col("f1") / F.col("n1") - F.col("f0") / F.col("n0"))) / F.sum(w)).alias("d"))
    return out.select("master", "bands", "stressed", F.round("d", 6).alias("difference"), F.when(F.col("d") >= 0.10, "coupled").when(F.col("d") >= 0.04, "weak").otherwise("none").alias("verdict"))


def ranked_causes(incidents: DataFrame, tags: DataFrame, risk: DataFrame, runs: DataFrame, most: int = 3) -> DataFrame:
    """Of each incident (ledger, master) its candidate causes by weight: tags by their lift, and the run it lies in.

    runs: (ledger, master, ledgers). Ranks are filtered windows by incident.
    """
    one = incidents.select("ledger", "master").distinct()
    by_tag = one.join(tags, "ledger").join(risk.select("tag", "lift"), "tag").select("ledger", "master", F.col("tag").alias("cause"), F.coalesce("lift", F.lit(0.0)).alias("weight"))
    by_run = one.join(runs, ["ledger", "master"]).where("ledgers > 1").select("ledger", "master", F.lit("run").alias("cause"), F.col("ledgers").cast("double").alias("weight"))
    w = Window.partitionBy("ledger", "master").orderBy(F.desc("weight"), "cause")
    return by_tag.unionByName(by_run).withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most)


def truth(claims: DataFrame, reference: DataFrame, now: int, hours: list[int]) -> DataFrame:
    """Of each master and window: claimed and reference misses, the least number of false claims, and a verdict. Inputs: (master, t_ms)."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        spans = F.explode(F.array_compact(F.array(*(F.when(F.col("t_ms") > now - h * 3_600_000, F.lit(h)) for h in hours))))
        return df.withColumn("hours", spans).groupBy("master", "hours").agg(F.count("*").alias(name))

    j = counted(claims, "claimed").join(counted(reference, "reference"), ["master", "hours"], "full_outer").na.fill(0, ["claimed", "reference"])
    verdict = F.when(F.col("claimed") > F.col("reference"), "over").when(F.col("claimed") < F.col("reference"), "under").otherwise("equal")
    return j.select("master", F.col("hours").cast("bigint").alias("hours"), "claimed", "reference", F.greatest(F.lit(0), F.col("claimed") - F.col("reference")).cast("bigint").alias("false_least"), verdict.alias("verdict"))


def signature_board(incidents: DataFrame, tags: DataFrame) -> DataFrame:
    """Of each tag: incidents and the newest one."""
    return incidents.join(tags, "ledger").groupBy("tag").agg(F.count("*").alias("incidents"), F.max(F.struct("t_ms", "master", "ledger")).alias("x")).select("tag", "incidents", F.col("x.master").alias("master"), F.col("x.ledger").alias("ledger"), F.col("x.t_ms").alias("t_ms"))


def signature_cohort(incidents: DataFrame, tags: DataFrame) -> DataFrame:
    """Of each tag: median and largest number of masters that fail together."""
    n = incidents.groupBy("ledger").agg(F.countDistinct("master").alias("k"))
    return n.join(tags.distinct(), "ledger").groupBy("tag").agg(F.count("*").alias("ledgers"), F.percentile(F.col("k"), 0.5).alias("median"), F.max("k").alias("largest"))


def health_alerts(info: DataFrame, at: str, least: int = 200, score: float = 0.95, missed: float = 0.05) -> DataFrame:
    """(master, at, alert, severity, value, threshold) of the snapshots of each master.

    info: (master, at, revoked, score, missed, total, incomplete, signing_key, list). Scores count from
    `least` votes on and if complete; keys and lists are compared with the snapshot just before.
    """
    c, w = F.col, Window.partitionBy("master").orderBy(at)
    sound = (c("total") >= least) & ~F.coalesce("incomplete", F.lit(False))
    share, none = c("missed") / F.nullif("total", F.lit(0)), F.lit(None).cast("double")

    def alert(test, name: str, severity: str = "suspect", value=none, threshold=none):
        return F.when(test, F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), value.alias("value"), threshold.cast("double").alias("threshold")))

    alerts = F.array(
        alert(c("revoked"), "validator-revoked", "malicious"),
        alert(sound & (c("score") < score), "agreement-drop", "suspect", c("score"), F.lit(score)),
        alert(sound & (share > missed), "missed-surge", "suspect", F.round(share * 1000) / 10, F.lit(missed * 100)),
        alert(c("signing_key") != F.lag("signing_key").over(w), "signing-key-rotated"),
        alert(c("list") != F.lag("list").over(w), "unl-membership-changed"),
    )
    return info.withColumn("found", F.array_compact(alerts)).select("master", at, F.explode("found").alias("x")).select("master", at, "x.*")


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): each check is the frame of its violations."""
    return reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, d in checks.items()))


def csv_line(*columns: str):
    """A row as an RFC 4180 line: fields with a comma, quote or line end are quoted, quotes doubled."""
    def field(c: str):
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(",", *map(field, columns))
