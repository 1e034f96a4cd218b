"""Validator statistics over incidents (ledger, master, t_ms, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.stats import erfc, p_two_sided, rate, two_proportion_z
from .iterate import components, kept
from .order_stats import percentile_row, ranked_values


def failure_runs(incidents: DataFrame, strong: int = 3) -> DataFrame:
    """Runs of consecutive ledgers of each master: from, to, ledgers, counts by type, share with others, verdict."""
    shared = incidents.select("ledger", "master").distinct().groupBy("ledger").agg((F.count("*") > 1).alias("shared"))
    one = incidents.groupBy("master", "ledger").agg(F.min("t_ms").alias("t_ms"), F.min("type").alias("type")).join(shared, "ledger")
    w = Window.partitionBy("master").orderBy("ledger")
    runs = one.withColumn("island", F.col("ledger") - F.row_number().over(w)).groupBy("master", "island").agg(
        F.min("ledger").alias("from_ledger"), F.max("ledger").alias("to_ledger"), F.count("*").alias("ledgers"), (F.max("t_ms") - F.min("t_ms")).alias("duration_ms"),
        F.count_if(F.col("type") == "missed").alias("missed"), F.count_if(F.col("type") == "partial").alias("partial"), F.count_if(F.col("type") == "wrong-hash").alias("wrong_hash"), F.count_if("shared").alias("co_ledgers"),
    )
    c = F.col
    verdict = (
        F.when(c("ledgers") == 1, F.when(c("wrong_hash") > 0, "hash-divergence").when(c("partial") > 0, "degraded-single").otherwise("isolated-miss"))
        .when(c("co_ledgers") >= 0.5 * c("ledgers"), "cohort-window")
        .when(c("partial") == c("ledgers"), "degraded-window")
        .when(c("ledgers") >= strong, "offline-window")
        .otherwise("short-series")
    )
    return runs.withColumn("verdict", verdict).drop("island")


def by_ledger(incidents: DataFrame, network: int) -> DataFrame:
    """(ledger, masters, scope): solo, cohort, or network from `network` distinct masters on."""
    n = incidents.groupBy("ledger").agg(F.countDistinct("master").alias("masters"))
    return n.withColumn("scope", F.when(F.col("masters") >= network, "network").when(F.col("masters") > 1, "cohort").otherwise("solo"))


def failure_split(incidents: DataFrame, network: int = 5) -> DataFrame:
    """Of each master: incident ledgers by scope."""
    one = incidents.select("ledger", "master").distinct().join(by_ledger(incidents, network), "ledger")
    return one.groupBy("master").agg(*(F.count_if(F.col("scope") == s).alias(s) for s in ("solo", "cohort", "network")))


def co_failures(incidents: DataFrame, recorded: int, network: int = 5) -> DataFrame:
    """Pairs that fail together on private ledgers: co, expected by chance, lift, mutual share.

    A private ledger has fewer than `network` masters, which bounds the pairs it makes.
    """
    scope = by_ledger(incidents, network)
    private = incidents.select("ledger", "master").distinct().join(scope.where("scope <> 'network'").select("ledger"), "ledger")
    own = private.groupBy("master").agg(F.count("*").alias("own"))
    total = scope.agg(F.greatest(F.lit(1), F.lit(recorded) - F.count_if(F.col("scope") == "network")).alias("total"))
    other = private.select("ledger", F.col("master").alias("b"))
    pair = private.withColumnRenamed("master", "a").join(other, "ledger").where("a < b").groupBy("a", "b").agg(F.count("*").alias("co"))
    sized = pair.join(own.select(F.col("master").alias("a"), F.col("own").alias("own_a")), "a").join(own.select(F.col("master").alias("b"), F.col("own").alias("own_b")), "b").crossJoin(F.broadcast(total))
    expected = F.col("own_a") * F.col("own_b") / F.col("total")
    return sized.select("a", "b", "co", "own_a", "own_b", F.round(expected, 6).alias("expected"), F.round(F.col("co") / expected, 6).alias("lift"), F.round(F.least(F.col("co") / F.col("own_a"), F.col("co") / F.col("own_b")), 6).alias("mutual"))


def co_failure_clusters(pairs: DataFrame, least: int = 4, lift: float = 4.0, mutual: float = 0.4) -> DataFrame:
    """Components of strong pairs: (master, cluster)."""
    strong = pairs.where((F.col("co") >= least) & (F.col("lift") >= lift) & (F.col("mutual") >= mutual))
    return components(strong, "a", "b").select(F.col("node").alias("master"), F.col("root").alias("cluster"))


def risk_profile(ledgers: DataFrame, tags: DataFrame, least: int = 20, least_fails: int = 3, least_plain: int = 50) -> DataFrame:
    """Of each tag the fail rate of ledgers with and without it, and the lift. ledgers: (ledger, failed); tags: (ledger, tag)."""
    total = ledgers.agg(F.count("*").alias("n"), F.count_if("failed").alias("f"))
    tagged = tags.distinct().join(ledgers, "ledger").groupBy("tag").agg(F.count("*").alias("with"), F.count_if("failed").alias("fails_with"))
    j = tagged.crossJoin(F.broadcast(total))  # one row
    j = j.withColumn("without", F.col("n") - F.col("with")).withColumn("fails_without", F.col("f") - F.col("fails_with"))
    a, b = rate(F.col("fails_with"), F.col("with")), rate(F.col("fails_without"), F.col("without"))
    reliable = (F.col("with") >= least) & (F.col("fails_with") >= least_fails) & (F.col("without") >= least_plain)
    return j.select("tag", "with", "fails_with", "without", "fails_without", F.round(a, 6).alias("rate_with"), F.round(b, 6).alias("rate_without"), F.round(F.when(b > 0, a / b), 6).alias("lift"), reliable.alias("reliable"))


def load_curve(ledgers: DataFrame) -> DataFrame:
    """Fail rate by load band and against the fullest band. ledgers: (band, failed)."""
    by = ledgers.groupBy("band").agg(F.count("*").alias("ledgers"), F.count_if("failed").alias("failed"))
    base = by.agg(F.max(F.struct("ledgers", F.negative("band").alias("o"), "failed")).alias("x")).select(F.round(F.col("x.failed") / F.col("x.ledgers"), 6).alias("base_rate"))
    return by.crossJoin(F.broadcast(base)).withColumn("rate", F.round(F.col("failed") / F.col("ledgers"), 6))


def peer_benchmark(votes: DataFrame, outlier: float = 4.0, least: int = 10) -> DataFrame:
    """Of each master: own rate, pooled rate of its peers, mid-rank among them, binomial z with continuity, p, verdict.

    Ranks come from the histogram of rates with prefix counts, so no task holds all masters; what is broadcast is one row.
    """
    own = kept(votes.groupBy("master").agg(F.count("*").alias("n"), F.count_if(F.col("type") != "ok").alias("f")).withColumn("rate", F.col("f") / F.col("n")))
    ranked = kept(ranked_values(own.select("rate"), [], "rate"))
    all_ = own.agg(F.sum("n").alias("all_n"), F.sum("f").alias("all_f")).crossJoin(F.broadcast(percentile_row(ranked, "rate", 0.9, "p90")))  # one row each
    j = own.join(ranked.select("rate", F.col("n").alias("equal"), "below"), "rate").crossJoin(F.broadcast(all_))
    j = j.withColumn("mid_rank", F.round((F.col("below") + 0.5 * (F.col("equal") - 1)) / F.greatest(F.lit(1), F.col("total") - 1), 6))
    p = (F.col("all_f") - F.col("f")) / (F.col("all_n") - F.col("n"))
    z = (F.col("f") - F.col("n") * p - 0.5) / F.sqrt(F.col("n") * p * (1 - p))
    verdict = F.when((F.col("rate") > F.col("p90")) & (z >= outlier) & (F.col("f") >= least), "outlier").when(F.col("rate") > F.col("p90"), "elevated").otherwise("baseline")
    return j.select("master", "n", "f", F.round("rate", 6).alias("rate"), F.round(p, 6).alias("peer_rate"), "mid_rank", F.round(z, 6).alias("z"), F.round(0.5 * erfc(z / F.sqrt(F.lit(2.0))), 6).alias("p"), verdict.alias("verdict"))


def alone_hours(votes: DataFrame, hour: Column, seen: int = 5) -> DataFrame:
    """Of each master: hours in which only it failed while at least `seen` peers were there."""
    cell = votes.groupBy(hour.alias("hour"), "master").agg((F.count_if(F.col("type") != "ok") > 0).alias("failed"))
    w = cell.groupBy("hour").agg(F.count("*").alias("there"), F.count_if("failed").alias("failing"), F.max(F.when(F.col("failed"), F.col("master"))).alias("master"))
    return w.where((F.col("failing") == 1) & (F.col("there") - 1 >= seen)).groupBy("master").agg(F.count("*").alias("alone"))


def cohort_split(incidents: DataFrame) -> DataFrame:
    """Of each master: solo and shared incident ledgers, largest and median cohort."""
    one = incidents.select("ledger", "master").distinct()
    n = one.groupBy("ledger").agg(F.count("*").alias("k"))
    return one.join(n, "ledger").groupBy("master").agg(F.count_if(F.col("k") == 1).alias("solo"), F.count_if(F.col("k") > 1).alias("shared"), F.max("k").alias("largest"), F.percentile(F.col("k"), 0.5).alias("median"))


def attack_impact(cells: DataFrame, least: int = 1) -> DataFrame:
    """Fail rates of attack hours against other hours of the same hour of day. cells: (hour, ledgers, fails, attack).

    Only hours of day that have both kinds are compared; z is pooled, p two-sided.
    """
    day = cells.withColumn("hod", F.pmod("hour", F.lit(24)))
    by = day.where(F.col("ledgers") >= least).groupBy("hod").agg(*(F.sum(F.when(F.col("attack") == a, F.col(c))).alias(f"{c}_{k}") for a, k in ((True, "a"), (False, "b")) for c in ("ledgers", "fails")))
    both = by.where("ledgers_a IS NOT NULL AND ledgers_b IS NOT NULL").agg(F.count("*").alias("hours_of_day"), *(F.sum(c).alias(c) for c in ("ledgers_a", "fails_a", "ledgers_b", "fails_b")))
    z = two_proportion_z(F.col("fails_a"), F.col("ledgers_a"), F.col("fails_b"), F.col("ledgers_b"))
    return both.withColumn("z", F.round(z, 6)).withColumn("p", F.round(p_two_sided(z), 6))


def sensitivity(votes: DataFrame, tags: DataFrame) -> DataFrame:
    """Of each tag and master: fail rates on ledgers with and without the tag, the lift and its z."""
    own = votes.groupBy("master", "ledger").agg((F.count_if(F.col("type") != "ok") > 0).alias("failed"))
    total = own.groupBy("master").agg(F.count("*").alias("n"), F.count_if("failed").alias("f"))
    on = own.join(tags.distinct(), "ledger").groupBy("tag", "master").agg(F.count("*").alias("with"), F.count_if("failed").alias("fails_with"))
    j = on.join(total, "master").withColumn("without", F.col("n") - F.col("with")).withColumn("fails_without", F.col("f") - F.col("fails_with"))
    a, b = rate(F.col("fails_with"), F.col("with")), rate(F.col("fails_without"), F.col("without"))
    z = two_proportion_z(F.col("fails_with"), F.col("with"), F.col("fails_without"), F.col("without"))
    return j.select("tag", "master", "with", "fails_with", "without", "fails_without", F.round(F.when(b > 0, a / b), 6).alias("lift"), F.round(z, 6).alias("z"))


def surface(cells: DataFrame) -> DataFrame:
    """Interaction of two axes: observed fails of (row, col) over what the margins expect. cells: (row, col, n, f)."""
    total = cells.agg(F.sum("n").alias("tn"), F.sum("f").alias("tf"))
    rows, cols = cells.groupBy("row").agg(F.sum("n").alias("rn"), F.sum("f").alias("rf")), cells.groupBy("col").agg(F.sum("n").alias("cn"), F.sum("f").alias("cf"))
    j = cells.join(rows, "row").join(cols, "col").crossJoin(F.broadcast(total))
    expected = F.col("n") * (F.col("rf") / F.col("rn")) * (F.col("cf") / F.col("cn")) / (F.col("tf") / F.col("tn"))
    return j.select("row", "col", "n", "f", F.round(expected, 6).alias("expected"), F.round(F.when(expected > 0, F.col("f") / expected), 6).alias("interaction"))


def profile_cells(incidents: DataFrame, start: int, end: int, cells: int = 24) -> DataFrame:
    """Counts of each of `cells` equal time cells of [start, end), empty ones included."""
    width = (end - start) // cells
    hit = incidents.where((F.col("t_ms") >= start) & (F.col("t_ms") < start + width * cells)).withColumn("cell", F.expr(f"(t_ms - {start}) DIV {width}")).groupBy("cell").agg(F.count("*").alias("incidents"), F.countDistinct("master").alias("masters"))
    grid = incidents.sparkSession.range(cells).select(F.col("id").alias("cell"))
    return grid.join(hit, "cell", "left").na.fill(0)


def holes(rows: DataFrame, by: str, least_ms: int) -> DataFrame:
    """(by, from_ms, to_ms, ms): pauses of at least least_ms between rows of a partition."""
    w = Window.partitionBy(by).orderBy("t_ms")
    return rows.withColumn("before", F.lag("t_ms").over(w)).where(F.col("t_ms") - F.col("before") >= least_ms).select(by, F.col("before").alias("from_ms"), F.col("t_ms").alias("to_ms"), (F.col("t_ms") - F.col("before")).alias("ms"))


def watch_delta(incidents: DataFrame, seen: DataFrame) -> DataFrame:
    """New incidents of watched masters since their visit. seen: (master, seen_ms)."""
    return incidents.join(seen, "master").where("t_ms > seen_ms").groupBy("master").agg(F.count("*").alias("new"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.countDistinct("type").alias("types"))


def fingerprint(votes: DataFrame) -> DataFrame:
    """Of each master: its rate, the network's, its busiest hour of day and the share of its fails in it."""
    fails = votes.where("type <> 'ok'").withColumn("hod", F.expr("(t_ms DIV 3600000) % 24"))
    own = votes.groupBy("master").agg(F.count("*").alias("n"), F.count_if(F.col("type") != "ok").alias("f"))
    peak = fails.groupBy("master", "hod").agg(F.count("*").alias("k")).groupBy("master").agg(F.max(F.struct("k", F.negative("hod").alias("h"))).alias("x")).select("master", F.col("x.k").alias("peak_fails"), F.negative("x.h").alias("peak_hour"))
    network = own.agg((F.sum("f") / F.sum("n")).alias("network"))
    return own.join(peak, "master").crossJoin(F.broadcast(network)).select("master", "n", "f", "peak_hour", "peak_fails", F.round(F.col("f") / F.col("n"), 6).alias("rate"), F.round("network", 6).alias("network_rate"), F.round(F.col("peak_fails") / F.col("f"), 6).alias("peak_share"))


def attribution(incidents: DataFrame, gaps: DataFrame, width: int) -> DataFrame:
    """Missed incidents split by whether a capture gap covers their ledger. gaps: (from_ledger, to_ledger).

    A bucketed interval join: gaps are dealt to the buckets of `width` ledgers that they touch.
    """
    dealt = gaps.withColumn("bucket", F.explode(F.sequence(F.expr(f"from_ledger DIV {width}"), F.expr(f"to_ledger DIV {width}"))))
    keyed = incidents.where("type = 'missed'").withColumn("bucket", F.expr(f"ledger DIV {width}"))
    inside = keyed.join(dealt, "bucket").where("ledger BETWEEN from_ledger AND to_ledger").select("master", "ledger", "t_ms").distinct().withColumn("capture", F.lit(True))
    return keyed.join(inside, ["master", "ledger", "t_ms"], "left").groupBy("master").agg(F.count_if("capture").alias("capture"), F.count_if(F.col("capture").isNull()).alias("open"))
