"""Stress coupling over the events table: an hour is a ledger, its events are load and votes, and every day is counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coupling as K
from ..sources import views as V
from .registry import query

BOUNDS, MANY, VERY_MANY = [1, 2, 4, 8, 12, 16, 24, 48, 96], 2, 4
GRADE = "CASE WHEN {r} THEN 'not-recorded' WHEN {e} THEN 'insufficient-sample' WHEN {d} >= 0.10 THEN 'stress-coupled' WHEN {d} >= 0.04 THEN 'stress-linked-weak' ELSE 'no-coupling-measured' END"
THIN = "NOT (exposed >= 8 AND control >= 8)"
BASE = """WITH fl AS (SELECT t_ms // 3600000 AS ledger, master, min(type) AS type FROM votes WHERE type IN ('missed', 'wrong-hash') GROUP BY 1, 2), dv AS (SELECT ledger, count(*) AS k FROM fl GROUP BY 1),
    h AS (SELECT t_ms // 3600000 AS ledger, count(*) AS n, count(DISTINCT master) AS m, count(*) FILTER (type = 'partial') AS p, count(*) FILTER (type = 'missed') AS x, min(t_ms) % 3600000 AS fv, max(t_ms) - min(t_ms) AS gap FROM votes GROUP BY 1),
    l AS (SELECT h.*, coalesce(k, 0) AS k, CASE WHEN h.ledger % 5 <> 0 THEN coalesce(k, 0) END AS deviating, (n >= 1)::int + (n >= 2)::int + (n >= 4)::int + (n >= 8)::int + (n >= 12)::int + (n >= 16)::int + (n >= 24)::int + (n >= 48)::int + (n >= 96)::int AS band FROM h LEFT JOIN dv USING (ledger)),
    tg AS (SELECT ledger, 'sender-burst' AS tag FROM l WHERE m < n UNION ALL SELECT ledger, 'type-burst:signup' FROM l WHERE p * 4 >= n UNION ALL SELECT ledger, 'failure-spike' FROM l WHERE x * 3 >= n UNION ALL SELECT ledger, 'close-gap' FROM l WHERE gap > 3300000),
    s AS (SELECT l.*, coalesce(deviating, 0) >= 2 AS mass, coalesce(deviating, 0) = 1 AS solo, (SELECT count(*) FROM tg WHERE tg.ledger = l.ledger) AS tags FROM l),
    st AS (SELECT *, tags > 0 OR n >= 48 OR fv > 2400000 OR gap >= 3000000 AS stressed FROM s),
    ex AS (SELECT tg.tag, band, count(*) AS e, count(*) FILTER (mass) AS em FROM tg JOIN s USING (ledger) GROUP BY 1, 2), co AS (SELECT band, count(*) AS n, count(*) FILTER (mass) AS nm FROM s WHERE tags = 0 GROUP BY 1),
    b1 AS (SELECT tag, sum(e)::bigint AS exposed, coalesce(sum(n), 0)::bigint AS control, sum(em)::bigint AS mass_exposed, coalesce(sum(nm), 0)::bigint AS mass_control FROM ex LEFT JOIN co USING (band) GROUP BY 1),
    b2 AS (SELECT *, mass_exposed / exposed AS rate_exposed, mass_control / nullif(control, 0) AS rate_control, mass_exposed / exposed - mass_control / nullif(control, 0) AS lift FROM b1),
    tagrows AS (SELECT *, """ + GRADE.format(r="control = 0", e=THIN, d="lift") + """ AS verdict FROM b2)"""
OWN = """, ue AS (SELECT master, tag, count(*) AS own_exposed FROM fl JOIN tg USING (ledger) GROUP BY 1, 2), cm AS (SELECT master, band, count(*) AS n FROM fl JOIN s USING (ledger) WHERE tags = 0 GROUP BY 1, 2),
    be AS (SELECT master, tag, sum(n)::bigint AS own_control FROM cm JOIN (SELECT DISTINCT tag, band FROM ex) USING (band) GROUP BY 1, 2),
    o1 AS (SELECT master, tag, exposed, control, coalesce(own_exposed, 0) AS own_exposed, coalesce(own_control, 0) AS own_control FROM (SELECT master, tag, own_exposed, own_control FROM ue FULL JOIN be USING (master, tag)) JOIN tagrows USING (tag)),
    o2 AS (SELECT *, own_exposed / exposed - own_control / nullif(control, 0) AS own_lift FROM o1), ownrows AS (SELECT *, """ + GRADE.format(r="control = 0", e=THIN, d="own_lift") + """ AS verdict FROM o2)"""
LOCAL = ", loc AS (SELECT master, count(*) AS own, count(*) FILTER (stressed) AS stressed, count(*) FILTER (NOT stressed) AS quiet, count(*) FILTER (stressed) / count(*) AS share, count(*) FILTER (stressed AND solo) AS solo_stressed, count(*) >= 8 AS enough FROM fl JOIN st USING (ledger) GROUP BY 1)"
NET = """, n1 AS (SELECT count(*) AS samples, count(*) FILTER (mass) AS mass, count(*) FILTER (solo) AS solo, count(*) FILTER (deviating >= 4) AS very_many, count(*) FILTER (mass AND tags > 0) / nullif(count(*) FILTER (mass), 0) AS share_mass, count(*) FILTER (solo AND tags > 0) / nullif(count(*) FILTER (solo), 0) AS share_solo FROM s),
    n2 AS (SELECT *, share_mass - share_solo AS lift FROM n1), net AS (SELECT *, """ + GRADE.format(r="samples = 0", e="NOT (mass >= 8 AND solo >= 8)", d="lift") + """ AS verdict FROM n2)"""
POP = """, dy AS (SELECT ledger // 24 AS day, count(*) AS ledgers, count(*) FILTER (k > 0) AS fails FROM l GROUP BY 1), w AS (SELECT min(day) * 86400000 + 3600000 AS since, (max(day) + 1) * 86400000 - 7200000 AS until FROM dy),
    wh AS (SELECT dy.* FROM dy, w WHERE day * 86400000 >= since AND (day + 1) * 86400000 <= until AND day % 7 <> 3), tt AS (SELECT coalesce(sum(ledgers), 0) AS n, coalesce(sum(fails), 0) AS f FROM wh),
    pc AS (SELECT tag, count(*) AS exposed, count(*) FILTER (k > 0) AS exposed_fails FROM tg JOIN l USING (ledger) JOIN wh ON day = ledger // 24 GROUP BY 1),
    p1 AS (SELECT tag, exposed, exposed_fails, greatest(0, n - exposed)::bigint AS control, greatest(0, f - exposed_fails)::bigint AS control_fails FROM pc, tt),
    p2 AS (SELECT *, exposed_fails / exposed AS rate_exposed, control_fails / nullif(control, 0) AS rate_control FROM p1), p3 AS (SELECT *, rate_exposed - rate_control AS difference, rate_exposed / nullif(rate_control, 0) AS relative FROM p2),
    pop AS (SELECT *, """ + GRADE.format(r="false", e=THIN, d="difference") + """ AS verdict FROM p3)"""
WEAKER = "CASE verdict WHEN 'stress-coupled' THEN 0 WHEN 'stress-linked-weak' THEN 1 END"
LEVEL = "min(CASE verdict WHEN 'stress-coupled' THEN 0 WHEN 'stress-linked-weak' THEN 1 WHEN 'no-coupling-measured' THEN 2 WHEN 'insufficient-sample' THEN 3 END)"
NAME = "['stress-coupled', 'stress-linked-weak', 'no-coupling-measured', 'insufficient-sample']"


class Facts:
    """The frames that the axes read."""

    def __init__(self, spark, sf_dir):
        c, votes = F.col, V.votes(spark, sf_dir).withColumn("ledger", F.expr("t_ms DIV 3600000"))
        self.failures = votes.where("type IN ('missed', 'wrong-hash')").select("ledger", "master", "type")
        k = self.failures.groupBy("ledger").agg(F.countDistinct("master").alias("k"))
        hours = votes.groupBy("ledger").agg(F.count("*").alias("n"), F.countDistinct("master").alias("m"), F.count_if(c("type") == "partial").alias("p"), F.count_if(c("type") == "missed").alias("x"), F.min("t_ms").alias("t_ms"), (F.max("t_ms") - F.min("t_ms")).alias("gap"))
        self.hours = hours.join(k, "ledger", "left").na.fill(0, ["k"])
        found = F.array_compact(F.array(F.when(c("m") < c("n"), "sender-burst"), F.when(c("p") * 4 >= c("n"), "type-burst:signup"), F.when(c("x") * 3 >= c("n"), "failure-spike"), F.when(c("gap") > 3_300_000, "close-gap")))
        self.tags = self.hours.select("ledger", F.explode(found).alias("tag"))
        no = F.lit(None).cast("boolean")
        self.ledgers = self.hours.select("ledger", "t_ms", c("n").alias("tx_count"), F.when(c("ledger") % 5 != 0, c("k")).alias("deviating"), no.alias("swept"), no.alias("amendment"), no.alias("unl"), (c("ledger") % 3 != 0).alias("shaped"), c("gap").alias("gap_ms"), F.lit(1_000_000).alias("gap_median"), (c("t_ms") % 3_600_000).alias("first_vote_ms"))
        self.evaluated = self.hours.select("ledger", c("n").alias("tx_count"), (c("k") > 0).alias("failed"))
        self.samples = K.samples(self.ledgers, self.tags, BOUNDS, MANY, 8, 3, 2_400_000)

    def days(self):
        """Counters of days, those of their tags, and a window that begins and ends within days; of every seventh day no tags were counted."""
        day = F.expr("ledger DIV 24").alias("day")
        days = self.evaluated.groupBy(day).agg(F.count("*").alias("ledgers"), F.count_if("failed").alias("fails")).withColumn("layered", F.col("day") % 7 != 3)
        by = self.tags.join(self.evaluated, "ledger").groupBy(day, "tag").agg(F.count("*").alias("ledgers"), F.count_if("failed").alias("fails"))
        a, b = days.agg(F.min("day"), F.max("day")).first()
        return days, by, *((None, None) if a is None else (a * K.DAY_MS + 3_600_000, (b + 1) * K.DAY_MS - 7_200_000))

    def population(self):
        return K.population(*self.days())


@query("votes", BASE + " SELECT * FROM tagrows")
def coupling_mass(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return K.by_tag(f.samples, f.tags)


@query("votes", BASE + OWN + " SELECT * FROM ownrows")
def coupling_node(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return K.by_master(f.samples, f.tags, f.failures)


@query("votes", BASE + " SELECT deviating, count(*) AS ledgers FROM s WHERE deviating IS NOT NULL GROUP BY 1")
def coupling_histogram(spark, sf_dir):
    return K.failing_at_once(Facts(spark, sf_dir).samples)


@query("votes", BASE + NET + " SELECT * FROM net")
def coupling_network(spark, sf_dir):
    return K.network(Facts(spark, sf_dir).samples, very_many=VERY_MANY)


@query("votes", BASE + """, tp AS (SELECT *, row_number() OVER (ORDER BY deviating DESC, n DESC, ledger) AS place FROM s WHERE mass QUALIFY place <= 6), nm AS (SELECT ledger, list_sort(list(master))[:3] AS masters, count(*) AS named_total FROM fl GROUP BY 1)
    SELECT place, ledger, (SELECT min(t_ms) FROM votes v WHERE v.t_ms // 3600000 = tp.ledger) AS t_ms, deviating, n AS tx_count, array_to_string(masters, ' ') AS masters, named_total, (named_total - len(masters))::bigint AS missing FROM tp JOIN nm USING (ledger)""")
def coupling_peaks(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return K.peaks(f.samples, f.failures, 6, 3).withColumn("masters", F.array_join("masters", " "))


@query("votes", BASE + LOCAL + " SELECT * FROM loc")
def coupling_local(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return K.node_local(f.samples, f.failures)


@query("votes", BASE + """, bd AS (SELECT band, count(*) AS n, count(*) FILTER (k > 0) AS f, count(*) FILTER (k > 0) / count(*) AS r FROM l GROUP BY 1), ms AS (SELECT *, row_number() OVER (ORDER BY band) AS pos, count(*) OVER () AS c, r - lag(r) OVER (ORDER BY band) AS step FROM bd WHERE n >= 8),
    a AS (SELECT count(*) AS bands, (SELECT count(*) FROM bd WHERE n < 8) AS thin, count(*) FILTER (step > 0) AS rising, count(*) FILTER (step < 0) AS falling, arg_max(band, (r, -band))::bigint AS peak, sum(f) FILTER (pos <= c // 2) / sum(n) FILTER (pos <= c // 2) AS lo, sum(f) FILTER (pos > c - c // 2) / sum(n) FILTER (pos > c - c // 2) AS up FROM ms),
    g AS (SELECT bands, thin, CASE WHEN bands >= 4 THEN rising ELSE 0 END AS rising, CASE WHEN bands >= 4 THEN falling ELSE 0 END AS falling, CASE WHEN bands >= 4 THEN peak END AS peak_band, CASE WHEN bands >= 4 THEN lo END AS lower_rate, CASE WHEN bands >= 4 THEN up END AS upper_rate FROM a), q AS (SELECT *, upper_rate / nullif(lower_rate, 0) AS half_ratio FROM g)
    SELECT *, CASE WHEN bands < 4 THEN 'insufficient-sample' WHEN half_ratio IS NULL THEN 'not-comparable' WHEN half_ratio >= 1.5 THEN 'load-dose-rising' WHEN half_ratio <= 1 / 1.5 THEN 'load-dose-falling' ELSE 'load-dose-flat' END AS verdict FROM q""")
def coupling_dose(spark, sf_dir):
    return K.dose(K.load_bands(Facts(spark, sf_dir).evaluated, BOUNDS))


@query("votes", BASE + POP + " SELECT * FROM pop")
def coupling_population(spark, sf_dir):
    return Facts(spark, sf_dir).population()


@query("votes", BASE + POP + """, nm AS (SELECT ledger, count(*) AS named FROM fl GROUP BY 1), g AS (SELECT 'cohort-membership-derived' AS gap, count(*) AS rows FROM s WHERE deviating IS NULL UNION ALL SELECT 'shape-not-recorded', count(*) FROM s WHERE ledger % 3 = 0
    UNION ALL SELECT 'forensics-row-missing', count(*) FROM nm ANTI JOIN s USING (ledger) UNION ALL SELECT 'cohort-masters-incomplete', count(*) FROM s LEFT JOIN nm USING (ledger) WHERE deviating > coalesce(named, 0) UNION ALL SELECT 'sample-too-small', count(*) FROM s HAVING count(*) < 8
    UNION ALL SELECT 'population-window-partial', count(*) FROM dy, w WHERE NOT (day * 86400000 >= since AND (day + 1) * 86400000 <= until) UNION ALL SELECT 'population-counters-partial', count(*) FROM dy, w WHERE day * 86400000 >= since AND (day + 1) * 86400000 <= until AND day % 7 = 3 AND (SELECT count(*) FROM pop) > 0)
    SELECT * FROM g WHERE rows > 0""")
def coupling_gaps(spark, sf_dir):
    f = Facts(spark, sf_dir)
    days, by, since, until = f.days()
    return K.gaps(f.samples, f.failures, days, K.population(days, by, since, until), since, until)


@query("votes", BASE + OWN + LOCAL + NET + POP + f""", fi AS (SELECT NULL AS master, {WEAKER} AS weak, difference AS d, tag, 0 AS place, 'population' AS axis, exposed, control, exposed_fails AS failures FROM pop UNION ALL SELECT master, {WEAKER}, own_lift, tag, 1, 'node', exposed, control, own_exposed FROM ownrows
      UNION ALL SELECT NULL, {WEAKER}, lift, tag, 2, 'mass', exposed, control, mass_exposed FROM tagrows UNION ALL SELECT NULL, {WEAKER}, lift, 'signature-share-mass-vs-solo', 3, 'network', mass, solo, mass FROM net),
    mem AS (SELECT DISTINCT master FROM votes), hd AS (SELECT mem.master, fi.* EXCLUDE (master), row_number() OVER (PARTITION BY mem.master ORDER BY weak, d DESC, tag, place) AS rn FROM mem JOIN fi ON fi.master IS NULL OR fi.master = mem.master WHERE weak IS NOT NULL QUALIFY rn = 1),
    ol AS (SELECT master, {LEVEL} AS g FROM ownrows GROUP BY 1), cx AS (SELECT (SELECT {LEVEL} FROM tagrows) AS gm, (SELECT coalesce(bool_or(exposed >= 8 AND control >= 8), false) FROM tagrows) AS measured, (SELECT {LEVEL} FROM pop) AS gp, net.verdict AS network_axis, samples FROM net),
    j AS (SELECT mem.master, weak, d, tag, hd.axis AS head_axis, exposed, control, failures, own, solo_stressed, coalesce(enough, false) AS enough, cx.*, CASE WHEN g <= 1 THEN {NAME}[g + 1] WHEN measured OR coalesce(enough, false) THEN 'no-coupling-measured' ELSE 'insufficient-sample' END AS node_axis,
      CASE WHEN gm <= 2 THEN {NAME}[gm + 1] ELSE 'insufficient-sample' END AS mass_axis, coalesce({NAME}[gp + 1], 'not-recorded') AS population_axis FROM mem LEFT JOIN hd USING (master) LEFT JOIN loc USING (master) LEFT JOIN ol USING (master), cx),
    v AS (SELECT *, CASE WHEN weak IS NOT NULL THEN {NAME}[weak + 1] WHEN enough AND solo_stressed >= greatest(2, ceil(own * 0.5)) THEN 'node-local-under-stress' WHEN samples < 8 THEN 'insufficient-sample' ELSE 'no-coupling-measured' END AS verdict FROM j)
    SELECT master, verdict, CASE WHEN weak IS NOT NULL THEN head_axis WHEN verdict = 'insufficient-sample' THEN 'sample' WHEN verdict = 'node-local-under-stress' THEN 'node' WHEN node_axis = 'no-coupling-measured' AND network_axis = 'no-coupling-measured' THEN 'both' ELSE 'none' END AS axis,
      CASE WHEN weak IS NOT NULL THEN concat(head_axis, '-lift-plus-', round(d * 100)::bigint, '-points-under-', tag) WHEN verdict = 'node-local-under-stress' THEN 'own-failures-under-stress-without-cohort' WHEN verdict = 'insufficient-sample' THEN 'fewer-ledger-rows-than-min-sample' ELSE 'measured-difference-below-weak-lift-on-both-axes' END AS reason,
      tag, round(d, 6) AS lift, exposed, control, failures, node_axis, mass_axis, network_axis, population_axis FROM v""")
def coupling_verdicts(spark, sf_dir):
    """Every master's verdict over the four axes."""
    f = Facts(spark, sf_dir)
    tag_rows, net = K.by_tag(f.samples, f.tags), K.network(f.samples, very_many=VERY_MANY)
    return K.verdicts(V.votes(spark, sf_dir).select("master"), tag_rows, K.by_master(f.samples, f.tags, f.failures), net, f.population(), K.node_local(f.samples, f.failures))
