"""How failures go with the stress of the very same ledgers, on four axes.

* node: a master fails more often under a tag than in untagged ledgers of the same load bands;
* mass: many masters fail at once more often under a tag than in such controls;
* network: ledgers where many fail carry tags more often than ledgers where one fails;
* population: over whole days, ledgers with a tag fail more often than the other ledgers.

ledgers: (ledger, t_ms, tx_count, deviating, swept, amendment, unl, shaped, gap_ms, gap_median, first_vote_ms), a row for each
recorded ledger; deviating is the number of failing masters, null where it was not recorded. tags: (ledger, tag). failures:
(ledger, master, type); of repeated ones of a master in a ledger the smallest type counts. Differences are of shares; a
difference of `STRONG` couples, one of `WEAK` is a direction. Nulls are "not recorded" and never "no coupling".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.stats import rate

#: Tags that count as stress (with those that begin with type-burst:), and the upper ends of the load bands.
STRESS_TAGS = ["drainer-fanout", "sender-burst", "failure-spike", "batch-amplify", "fee-spike", "feature-change", "account-create-burst", "offer-flood", "nft-spam", "sweep-window", "load-extreme", "close-gap", "vote-latency-late"]
BOUNDS = [10, 25, 50, 100, 200, 400, 800, 1600, 3200]
STRONG, WEAK, LEAST = 0.10, 0.04, 8
DAY_MS = 86_400_000


def band(tx_count: Column, bounds: list[int] = BOUNDS) -> Column:
    """The number of bounds that a load reaches; a missing load is in the lowest band."""
    return reduce(lambda n, b: n + F.when(tx_count >= b, 1).otherwise(0), bounds, F.lit(0)).cast("bigint")


def graded(difference: Column, enough: Column, recorded: Column) -> Column:
    return F.when(~recorded, "not-recorded").when(~enough, "insufficient-sample").when(difference >= STRONG, "stress-coupled").when(difference >= WEAK, "stress-linked-weak").otherwise("no-coupling-measured")


def stress_tags(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("tag").isin(STRESS_TAGS) | F.col("tag").startswith("type-burst:")).select("ledger", "tag").distinct()


def samples(ledgers: DataFrame, tags: DataFrame, bounds: list[int] = BOUNDS, many: int = LEAST, high_band: int = 5, break_factor: float = 3, grace_ms: int = 20_000) -> DataFrame:
    """ledgers with (band, tags, mass, solo, stressed): the number of stress tags, whether many or one failed, and whether anything stressed it."""
    c = F.col
    n = stress_tags(tags).groupBy("ledger").agg(F.count("*").alias("tags"))
    s = ledgers.join(n, "ledger", "left").na.fill(0, ["tags"]).withColumn("band", band(c("tx_count"), bounds))
    cadence = (c("gap_median") > 0) & (c("gap_ms") >= break_factor * c("gap_median"))
    facts = [c("tags") > 0, c("swept"), c("amendment"), c("unl"), cadence, c("first_vote_ms") > grace_ms, c("band") >= high_band]
    stressed = reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), facts, F.lit(False))
    failing = F.coalesce("deviating", F.lit(0))
    return s.select("*", (failing >= many).alias("mass"), (failing == 1).alias("solo"), stressed.alias("stressed"))


def own_failures(failures: DataFrame) -> DataFrame:
    return failures.groupBy("ledger", "master").agg(F.min("type").alias("type"))


def _exposure(s: DataFrame, tags: DataFrame) -> DataFrame:
    return stress_tags(tags).join(s.select("ledger", "band", "mass"), "ledger")


def by_tag(s: DataFrame, tags: DataFrame, least: int = LEAST) -> DataFrame:
    """The mass axis: (tag, exposed, control, mass_exposed, mass_control, rate_exposed, rate_control, lift, verdict) over samples.

    The control of a tag are the untagged ledgers of the bands that it is found in.
    """
    c = F.col
    exposed = _exposure(s, tags).groupBy("tag", "band").agg(F.count("*").alias("e"), F.count_if("mass").alias("em"))
    control = s.where("tags = 0").groupBy("band").agg(F.count("*").alias("n"), F.count_if("mass").alias("nm"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    g = exposed.join(control, "band", "left").groupBy("tag").agg(total("e").alias("exposed"), total("n").alias("control"), total("em").alias("mass_exposed"), total("nm").alias("mass_control"))
    g = g.withColumn("rate_exposed", rate(c("mass_exposed"), c("exposed"))).withColumn("rate_control", rate(c("mass_control"), c("control"))).withColumn("lift", c("rate_exposed") - c("rate_control"))
    return g.withColumn("verdict", graded(c("lift"), (c("exposed") >= least) & (c("control") >= least), c("control") > 0))


def by_master(s: DataFrame, tags: DataFrame, failures: DataFrame, least: int = LEAST) -> DataFrame:
    """The node axis: (master, tag, exposed, control, own_exposed, own_control, own_lift, verdict), for the tags and controls in which a master failed.

    For other tags a master's difference is zero; `by_tag` tells whether they were measured.
    """
    c = F.col
    own, exposure = own_failures(failures), _exposure(s, tags)
    under = own.join(exposure, "ledger").groupBy("master", "tag").agg(F.count("*").alias("own_exposed"))
    calm = own.join(s.where("tags = 0").select("ledger", "band"), "ledger").groupBy("master", "band").agg(F.count("*").alias("n"))
    beside = calm.join(exposure.select("tag", "band").distinct(), "band").groupBy("master", "tag").agg(F.sum("n").alias("own_control"))
    j = under.join(beside, ["master", "tag"], "full_outer").na.fill(0, ["own_exposed", "own_control"]).join(by_tag(s, tags, least).select("tag", "exposed", "control"), "tag")
    j = j.withColumn("own_lift", rate(c("own_exposed"), c("exposed")) - rate(c("own_control"), c("control")))
    verdict = graded(c("own_lift"), (c("exposed") >= least) & (c("control") >= least), c("control") > 0)
    return j.select("master", "tag", "exposed", "control", "own_exposed", "own_control", "own_lift", verdict.alias("verdict"))


def failing_at_once(s: DataFrame) -> DataFrame:
    """(deviating, ledgers): in how many ledgers so many masters failed, where that was recorded."""
    return s.where("deviating IS NOT NULL").groupBy("deviating").agg(F.count("*").alias("ledgers"))


def network(s: DataFrame, least: int = LEAST, very_many: int = 15) -> DataFrame:
    """The network axis, one row: (samples, mass, solo, very_many, share_mass, share_solo, lift, verdict)."""
    c, tagged = F.col, F.col("tags") > 0
    one = s.agg(F.count("*").alias("samples"), F.count_if("mass").alias("mass"), F.count_if("solo").alias("solo"), F.count_if(c("deviating") >= very_many).alias("very_many"), F.count_if(c("mass") & tagged).alias("tm"), F.count_if(c("solo") & tagged).alias("ts"))
    one = one.withColumn("share_mass", rate(c("tm"), c("mass"))).withColumn("share_solo", rate(c("ts"), c("solo"))).drop("tm", "ts").withColumn("lift", c("share_mass") - c("share_solo"))
    return one.withColumn("verdict", graded(c("lift"), (c("mass") >= least) & (c("solo") >= least), c("samples") > 0))


def peaks(s: DataFrame, failures: DataFrame, most: int = 6, named: int = 40) -> DataFrame:
    """The `most` ledgers where most masters failed: (place, ledger, t_ms, deviating, tx_count, masters, named_total, missing).

    At most `named` masters, by name, are listed; named_total counts them all, and missing tells how many are not listed or not
    known by name.
    """
    top = s.where("mass").orderBy(F.desc("deviating"), F.desc_nulls_last("tx_count"), "ledger").limit(most).select("ledger", "t_ms", "deviating", "tx_count")
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("deviating"), F.desc_nulls_last("tx_count"), "ledger")).cast("bigint"))  # at most `most` rows
    who = own_failures(failures).join(F.broadcast(top.select("ledger")), "ledger")
    w = Window.partitionBy("ledger").orderBy("master")
    listed = who.withColumn("k", F.row_number().over(w)).where(F.col("k") <= named).groupBy("ledger").agg(F.array_sort(F.collect_list("master")).alias("masters"))  # `named` at most
    total = who.groupBy("ledger").agg(F.count("*").alias("named_total"))
    j = top.join(listed, "ledger", "left").join(total, "ledger", "left").withColumn("masters", F.coalesce("masters", F.array().cast("array<string>"))).na.fill(0, ["named_total"])
    return j.select("place", "ledger", "t_ms", "deviating", "tx_count", "masters", "named_total", (F.greatest("deviating", "named_total") - F.size("masters")).cast("bigint").alias("missing"))


def node_local(s: DataFrame, failures: DataFrame, least: int = LEAST) -> DataFrame:
    """Of each master: (own, stressed, quiet, share, solo_stressed, enough), its failing ledgers, with and without stress, and those where it failed alone under stress."""
    c = F.col
    j = own_failures(failures).join(s.select("ledger", "stressed", "solo"), "ledger")
    by = j.groupBy("master").agg(F.count("*").alias("own"), F.count_if("stressed").alias("stressed"), F.count_if(c("stressed") & c("solo")).alias("solo_stressed"))
    return by.select("master", "own", "stressed", (c("own") - c("stressed")).alias("quiet"), rate(c("stressed"), c("own")).alias("share"), "solo_stressed", (c("own") >= least).alias("enough"))


def load_bands(evaluated: DataFrame, bounds: list[int] = BOUNDS, least: int = LEAST) -> DataFrame:
    """(band, ledgers, fails, rate, measured) over all evaluated ledgers (ledger, tx_count, failed), those without a failure included."""
    by = evaluated.groupBy(band(F.col("tx_count"), bounds).alias("band")).agg(F.count("*").alias("ledgers"), F.count_if("failed").alias("fails"))
    return by.select("band", "ledgers", "fails", rate(F.col("fails"), F.col("ledgers")).alias("rate"), (F.col("ledgers") >= least).alias("measured"))


def own_load_bands(evaluated: DataFrame, failures: DataFrame, bounds: list[int] = BOUNDS) -> DataFrame:
    """(master, band, own, own_rate): failing ledgers of each master by load band, against all ledgers of the band."""
    e = evaluated.select("ledger", band(F.col("tx_count"), bounds).alias("band"))
    own = own_failures(failures).join(e, "ledger").groupBy("master", "band").agg(F.count("*").alias("own"))
    return own.join(load_bands(evaluated, bounds).select("band", "ledgers"), "band").select("master", "band", "own", rate(F.col("own"), F.col("ledgers")).alias("own_rate"))


def dose(bands: DataFrame, least_bands: int = 4, ratio: float = 1.5) -> DataFrame:
    """The dose of load, one row: (bands, thin, rising, falling, peak_band, lower_rate, upper_rate, half_ratio, verdict) over measured bands.

    The lower half of the bands is held against the upper half (the middle one of an odd number in neither). The bands are as
    many as there are bounds, so one array holds them.
    """
    c = F.col
    row = F.when(c("measured"), F.struct("band", "ledgers", "fails", "rate"))
    one = bands.agg(F.array_sort(F.collect_list(row)).alias("b"), F.count_if(~c("measured")).alias("thin")).withColumn("n", F.size("b"))
    half = F.floor(c("n") / 2).cast("int")
    steps = F.when(c("n") > 1, F.transform(F.sequence(F.lit(1), c("n") - 1), lambda k: F.get("b", k)["rate"] - F.get("b", k - 1)["rate"])).otherwise(F.array().cast("array<double>"))

    def share(part: Column) -> Column:
        added = lambda field: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x[field])
        return rate(added("fails"), added("ledgers"))

    lower, upper = share(F.slice("b", F.lit(1), half)), share(F.slice("b", c("n") - half + 1, half))
    enough = c("n") >= least_bands
    peak = F.array_max(F.transform("b", lambda x: F.struct(x["rate"].alias("rate"), (-x["band"]).alias("less"))))["less"]
    one = one.select(
        c("n").cast("bigint").alias("bands"), "thin", F.when(enough, F.size(F.filter(steps, lambda d: d > 0))).otherwise(0).cast("bigint").alias("rising"), F.when(enough, F.size(F.filter(steps, lambda d: d < 0))).otherwise(0).cast("bigint").alias("falling"),
        F.when(enough, -peak).alias("peak_band"), F.when(enough, lower).alias("lower_rate"), F.when(enough, upper).alias("upper_rate"),
    )
    one = one.withColumn("half_ratio", rate(c("upper_rate"), c("lower_rate")))
    verdict = F.when(c("bands") < least_bands, "insufficient-sample").when(c("half_ratio").isNull(), "not-comparable").when(c("half_ratio") >= ratio, "load-dose-rising").when(c("half_ratio") <= 1 / ratio, "load-dose-falling").otherwise("load-dose-flat")
    return one.withColumn("verdict", verdict)


def whole_days(days: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """days (day, from midnight in days of the epoch) with `whole`: all of it lies between since and until (milliseconds; none: all days)."""
    inside = F.lit(True) if since is None else (F.col("day") * DAY_MS >= since) & ((F.col("day") + 1) * DAY_MS <= until)
    return days.withColumn("whole", inside)


def population(days: DataFrame, day_tags: DataFrame, since: int | None = None, until: int | None = None, least: int = LEAST) -> DataFrame:
    """The population axis: (tag, exposed, exposed_fails, control, control_fails, rate_exposed, rate_control, difference, relative, verdict).

    days: (day, ledgers, fails, layered), counters over all evaluated ledgers; day_tags: (day, tag, ledgers, fails). A day that
    lies in the window in part only is left out whole, as are days whose tags were not counted (layered).
    """
    c = F.col
    whole = whole_days(days, since, until).where("whole AND layered")
    total = whole.agg(F.coalesce(F.sum("ledgers"), F.lit(0)).alias("n"), F.coalesce(F.sum("fails"), F.lit(0)).alias("f"))
    counted = day_tags.where(c("tag").isin(STRESS_TAGS) | c("tag").startswith("type-burst:")).join(whole.select("day").distinct(), "day")
    by = counted.groupBy("tag").agg(F.sum("ledgers").alias("exposed"), F.sum("fails").alias("exposed_fails")).crossJoin(F.broadcast(total))  # one row
    by = by.withColumn("control", F.greatest(F.lit(0), c("n") - c("exposed"))).withColumn("control_fails", F.greatest(F.lit(0), c("f") - c("exposed_fails"))).drop("n", "f")
    by = by.withColumn("rate_exposed", rate(c("exposed_fails"), c("exposed"))).withColumn("rate_control", rate(c("control_fails"), c("control"))).withColumn("difference", c("rate_exposed") - c("rate_control")).withColumn("relative", rate(c("rate_exposed"), c("rate_control")))
    return by.withColumn("verdict", graded(c("difference"), (c("exposed") >= least) & (c("control") >= least), F.lit(True)))


def gaps(s: DataFrame, failures: DataFrame, days: DataFrame, axis: DataFrame, since: int | None = None, until: int | None = None, least: int = LEAST) -> DataFrame:
    """(gap, rows): what was not recorded, and how often; gaps that are not there give no row. axis: the rows of `population`."""
    c = F.col
    named = own_failures(failures).groupBy("ledger").agg(F.count("*").alias("named"))
    j = s.select("*", F.lit(True).alias("there")).join(named, "ledger", "full_outer")
    there = c("there").isNotNull()
    known = (c("gap_median") > 0) & c("gap_ms").isNotNull()
    of = j.agg(
        F.count_if(~there).alias("forensics-row-missing"), F.count_if(there & c("deviating").isNull()).alias("cohort-membership-derived"), F.count_if(there & ~F.coalesce("shaped", F.lit(False))).alias("shape-not-recorded"),
        F.count_if(there & c("first_vote_ms").isNull()).alias("vote-latency-not-recorded"), F.count_if(there & ~F.coalesce(known, F.lit(False))).alias("cadence-not-recorded"),
        F.count_if(there & (c("deviating") > F.coalesce("named", F.lit(0)))).alias("cohort-masters-incomplete"), F.when(F.count_if(there) == 0, 1).otherwise(0).cast("bigint").alias("control-not-recorded"),
        F.when(F.count_if(there).between(1, least - 1), F.count_if(there)).otherwise(0).alias("sample-too-small"),
    )
    d = whole_days(days, since, until).agg(F.count_if(~c("whole")).alias("population-window-partial"), F.count_if("whole").alias("w"), F.count_if(c("whole") & ~c("layered")).alias("bare"))
    d = d.crossJoin(F.broadcast(axis.agg(F.count("*").alias("rows"))))  # one row each
    d = d.select("population-window-partial", F.when((c("rows") == 0) & (c("w") > 0), c("w")).otherwise(0).alias("population-counters-missing"), F.when(c("rows") > 0, c("bare")).otherwise(0).alias("population-counters-partial"))
    long = lambda x: x.unpivot([], [F.col(f"`{k}`") for k in x.columns], "gap", "rows")
    return long(of).unionByName(long(d)).where("rows > 0")


def _finding(axis: str, place: int, tag: str | Column, verdict: str, lift: str, exposed: str, control: str, failures: str) -> Column:
    c = F.col
    weak = F.when(c(verdict) == "stress-coupled", 0).when(c(verdict) == "stress-linked-weak", 1)
    one = F.struct(weak.alias("weak"), (-c(lift)).alias("down"), (tag if isinstance(tag, Column) else c(tag)).alias("tag"), F.lit(place).alias("place"), F.lit(axis).alias("axis"), c(exposed).alias("exposed"), c(control).alias("control"), c(failures).alias("failures"))
    return F.when(weak.isNotNull(), one)


def verdicts(members: DataFrame, tag_rows: DataFrame, own_rows: DataFrame, net: DataFrame, axis: DataFrame, local: DataFrame, least: int = LEAST) -> DataFrame:
    """Of each member (master): (master, verdict, axis, reason, tag, lift, exposed, control, failures, node_axis, mass_axis, network_axis, population_axis).

    tag_rows, own_rows, net, axis and local are the rows of `by_tag`, `by_master`, `network`, `population` and `node_local`. The
    strongest finding of any axis decides: coupled before weak, then the larger difference, the tag and the axis's place
    (population, node, mass, network). Without one, half and at least two of the failing ledgers alone and under stress is the node's own matter.
    """
    c = F.col
    graded_best = lambda v: F.min(F.when(v == "stress-coupled", 0).when(v == "stress-linked-weak", 1).when(v == "no-coupling-measured", 2).when(v == "insufficient-sample", 3))
    names = F.array(*map(F.lit, ["stress-coupled", "stress-linked-weak", "no-coupling-measured", "insufficient-sample"]))
    of_tags = tag_rows.agg(F.min(_finding("mass", 2, "tag", "verdict", "lift", "exposed", "control", "mass_exposed")).alias("f_mass"), graded_best(c("verdict")).alias("g_mass"), F.coalesce(F.bool_or((c("exposed") >= least) & (c("control") >= least)), F.lit(False)).alias("measured"))
    of_days = axis.agg(F.min(_finding("population", 0, "tag", "verdict", "difference", "exposed", "control", "exposed_fails")).alias("f_days"), graded_best(c("verdict")).alias("g_days"))
    of_net = net.select(_finding("network", 3, F.lit("signature-share-mass-vs-solo"), "verdict", "lift", "mass", "solo", "mass").alias("f_net"), c("verdict").alias("network_axis"), "samples")
    common = of_tags.crossJoin(of_days).crossJoin(of_net)  # one row each
    own = own_rows.groupBy("master").agg(F.min(_finding("node", 1, "tag", "verdict", "own_lift", "exposed", "control", "own_exposed")).alias("f_own"), graded_best(c("verdict")).alias("g_own"))
    j = members.select("master").distinct().join(own, "master", "left").join(local.select("master", "own", "solo_stressed", "enough"), "master", "left").crossJoin(F.broadcast(common))
    enough = F.coalesce("enough", F.lit(False))
    j = j.withColumn("head", F.array_min(F.array_compact(F.array("f_days", "f_own", "f_mass", "f_net"))))
    head, alone = c("head").isNotNull(), enough & (c("solo_stressed") >= F.greatest(F.lit(2), F.ceil(c("own") * 0.5)))
    node_axis = F.when(c("g_own") <= 1, F.get(names, c("g_own"))).when(c("measured") | enough, "no-coupling-measured").otherwise("insufficient-sample")
    j = j.withColumn("node_axis", node_axis).withColumn("mass_axis", F.when(c("g_mass") <= 2, F.get(names, c("g_mass"))).otherwise("insufficient-sample")).withColumn("population_axis", F.coalesce(F.get(names, c("g_days")), F.lit("not-recorded")))
    j = j.withColumn("verdict", F.when(c("samples") == 0, "not-recorded").when(head, F.get(names, c("head.weak"))).when(alone, "node-local-under-stress").when(c("samples") < least, "insufficient-sample").otherwise("no-coupling-measured"))
    points = F.round(F.abs(c("head.down")) * 100).cast("bigint").cast("string")
    both = (c("node_axis") == "no-coupling-measured") & (c("network_axis") == "no-coupling-measured")
    where = F.when(c("verdict") == "not-recorded", "none").when(head, c("head.axis")).when(c("verdict") == "insufficient-sample", "sample").when(c("verdict") == "node-local-under-stress", "node").when(both, "both").otherwise("none")
    reason = (
        F.when(c("verdict") == "not-recorded", "no-ledger-forensics-row-in-this-window").when(head, F.concat(c("head.axis"), F.lit("-lift-plus-"), points, F.lit("-points-under-"), c("head.tag")))
        .when(c("verdict") == "node-local-under-stress", "own-failures-under-stress-without-cohort").when(c("verdict") == "insufficient-sample", "fewer-ledger-rows-than-min-sample").otherwise("measured-difference-below-weak-lift-on-both-axes")
    )
    shown = lambda x: F.when(c("verdict") != "not-recorded", x)
    return j.select("master", "verdict", where.alias("axis"), reason.alias("reason"), shown(c("head.tag")).alias("tag"), shown(F.round(-c("head.down"), 6)).alias("lift"), shown(c("head.exposed")).alias("exposed"), shown(c("head.control")).alias("control"), shown(c("head.failures")).alias("failures"), "node_axis", "mass_axis", "network_axis", "population_axis")
