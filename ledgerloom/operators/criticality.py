"""What a member's incident says of the quorum: whether the ledger hung on it, or the own recording missed the votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .evaluation import KEY
from .iterate import kept
from .order_stats import others_median

DAY_MS = 86_400_000


def criticality(judged: DataFrame, incidents: DataFrame, captures: DataFrame, marginal: int = 1, near_ms: int = 120_000, least: int = 20, coverage: float = 0.9) -> DataFrame:
    """A row for each incident (network, ledger, master, type): its ledger's verdict, coverage, the nearest capture event, who else was concerned.

    judged and incidents as in evaluation; captures: (network, kind, at_ms). The verdict is the first that holds of not-closed, closed-capture-gap,
    closed-line-conflict, closed-quorum-observed, closed-reception-thin, closed-observation-gap. A ledger that isn't closed is critical if its margin is `marginal` at most.
    Coverage is the ledger's own baseline, else the median votes of the day's other ledgers that closed without a gap (`least` of them at least).
    The event is the nearest of the same day within near_ms, earlier ones first. Other members are ordered by type and name.
    """
    j = judged.withColumn("day", F.expr(f"close_ms DIV {DAY_MS}"))
    j = others_median(j, ["network", "day"], "votes", F.col("closed") & ~F.col("capture_gap") & ~F.col("stream_open"), "day_coverage", least)
    one = incidents.select(*KEY, "master", "type")
    absent = F.count_if(F.col("type").isin("missed", "vote-not-observed", "no-quorum"))
    concerned = one.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("type", "master"))).alias("concerned"), absent.alias("absent_count"))  # members at most
    j = near_event(j.join(concerned, KEY), captures, near_ms)
    level = F.coalesce("coverage_baseline", "day_coverage")
    usable = F.col("closed") & (F.col("needed") > 0)
    verdict = (
        F.when(~F.col("closed"), "not-closed").when(F.col("capture_gap"), "closed-capture-gap").when(F.col("closure_conflict"), "closed-line-conflict")
        .when(F.col("has_quorum"), "closed-quorum-observed").when(F.col("reception_thin"), "closed-reception-thin").otherwise("closed-observation-gap")
    )
    j = j.select(
        *KEY, "votes", "needed", "needed_basis", "top", "margin", "runner", "observed", "observed_baseline", verdict.alias("verdict"), (~F.col("closed") & (F.col("needed") > 0) & (F.col("margin") <= marginal)).alias("critical"), level.alias("coverage_level"),
        F.when(F.col("coverage_baseline").isNotNull(), "recorded").when(F.col("day_coverage").isNotNull(), "day").alias("coverage_basis"), F.when(F.col("coverage_baseline").isNull() & F.col("day_coverage").isNotNull(), F.col("day_coverage_samples")).alias("coverage_samples"),
        (F.col("top") >= level * coverage).alias("coverage_at_level"), F.when(usable, F.col("top") >= F.col("needed")).alias("capture_complete"), F.when(usable, F.greatest(F.lit(0), F.col("absent_count") - F.col("genuine_absent_max"))).cast("bigint").alias("capture_artifact_min"),
        "event_kind", "event_delta_ms", F.size("ballots").cast("bigint").alias("voter_count"), "concerned",
    )
    rows = one.join(j, KEY)
    others = F.filter("concerned", lambda c: c["master"] != F.col("master"))
    return rows.withColumn("affected", F.size("concerned").cast("bigint")).withColumn("affected_masters", F.transform(others, lambda c: c["master"])).withColumn("affected_types", F.transform(others, lambda c: c["type"])).drop("concerned")


def near_event(ledgers: DataFrame, captures: DataFrame, near_ms: int) -> DataFrame:
    """ledgers (network, day, close_ms) with event_kind and event_delta_ms of the day's nearest event within near_ms: the last before and the first after, by one window over the day."""
    e = captures.where("at_ms is not null").groupBy("network", "at_ms").agg(F.min("kind").alias("kind")).select("network", F.expr(f"at_ms DIV {DAY_MS}").alias("day"), F.col("at_ms").alias("_t"), F.struct("at_ms", "kind").alias("_e"))
    both = kept(ledgers.withColumn("_t", F.col("close_ms"))).unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy("network", "day").orderBy("_t", F.col("_e").isNull())  # an event at the same time comes first
    both = both.withColumn("_p", F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first("_e", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).where("_e is null")
    before, after = F.col("close_ms") - F.col("_p.at_ms"), F.col("_n.at_ms") - F.col("close_ms")
    first = F.coalesce(before <= after, before.isNotNull())
    delta = F.when(first, before).otherwise(after)
    hit = delta <= near_ms
    return both.withColumn("event_delta_ms", F.when(hit, delta)).withColumn("event_kind", F.when(hit, F.when(first, F.col("_p.kind")).otherwise(F.col("_n.kind")))).drop("_t", "_e", "_p", "_n")


def summary(rows: DataFrame) -> DataFrame:
    """Of each member: incidents, those critical, by verdict, with incomplete capture, near an event, and the sum of absences that must be artifacts."""
    of = lambda name, cond: F.count_if(cond).alias(name)
    return rows.groupBy("network", "master").agg(
        F.count("*").alias("checked"), of("critical", F.col("critical")), of("closed", F.col("verdict") != "not-closed"), of("capture_gaps", F.col("verdict") == "closed-capture-gap"), of("reception_thin", F.col("verdict") == "closed-reception-thin"),
        of("near_events", F.col("event_kind").isNotNull()), of("capture_incomplete", F.col("capture_complete") == F.lit(False)), F.coalesce(F.sum("capture_artifact_min"), F.lit(0)).alias("artifact_min"),
    ).withColumn("follow_on", F.col("checked") - F.col("critical"))
