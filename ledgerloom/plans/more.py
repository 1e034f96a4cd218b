"""Queries of the timing, cause and view operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causes as C, graph as G, motifs as M, timing as T, validators as D, views as W
from ..operators.iterate import stored
from ..operators.state import last_wins
from ..sources import views as V
from .registry import query
from .trace import CELL, HASHED, _cells, _hashed, _tags

FIRST = "WITH f AS (SELECT ledger, min(t_ms) AS m FROM votes GROUP BY 1), d AS (SELECT v.*, t_ms - m AS delay FROM votes v JOIN f USING (ledger))"


@query("votes", FIRST + " SELECT master, count(*) AS votes, min(delay) AS least, round(median(delay), 3) AS median, round(quantile_cont(delay, 0.9), 3) AS p90, max(delay) AS most, round(avg(delay), 6) AS mean, round(quantile_cont(delay, 0.9), 3) - round(median(delay), 3) <= 250000 AS steady FROM d GROUP BY 1")
def vote_latency(spark, sf_dir):
    return C.vote_latency(V.votes(spark, sf_dir), 250_000)


@query("votes", FIRST + " SELECT master, count(*) AS late, max(delay) AS longest FROM d WHERE delay > 300000 GROUP BY 1")
def late_votes(spark, sf_dir):
    return C.late_votes(V.votes(spark, sf_dir), 300_000)


@query("ev", HASHED + " SELECT hash, count(*) AS votes, count(DISTINCT ledger) AS ledgers, count(DISTINCT master) AS masters, count(DISTINCT ledger) >= 3 AS repeated, count(DISTINCT master) >= 2 AS shared FROM v JOIN t USING (ledger) WHERE hash <> top_hash GROUP BY 1")
def divergence(spark, sf_dir):
    from ..operators.trace import tally

    v = _hashed(spark, sf_dir)
    return C.divergence(v.join(tally(v, 5).select("ledger", "top_hash"), "ledger").where("hash <> top_hash"))


@query("votes", CELL + """, o AS (SELECT v.master, c.n % 3 AS band, c.m < c.n AS stressed, v.type <> 'ok' AS failed FROM votes v JOIN cell c USING (ledger)),
    b AS (SELECT master, band, count(*) FILTER (stressed) AS n1, count(*) FILTER (NOT stressed) AS n0, count(*) FILTER (stressed AND failed) AS f1, count(*) FILTER (NOT stressed AND failed) AS f0 FROM o GROUP BY 1, 2),
    w AS (SELECT *, n1 * n0 / (n1 + n0) AS w FROM b WHERE n1 > 0 AND n0 > 0), d AS (SELECT master, count(*) AS bands, cast(sum(n1) AS bigint) AS stressed, sum(w * (f1 / n1 - f0 / n0)) / sum(w) AS d FROM w GROUP BY 1)
    SELECT master, bands, stressed, round(d, 6) AS difference, CASE WHEN d >= 0.10 THEN 'coupled' WHEN d >= 0.04 THEN 'weak' ELSE 'none' END AS verdict FROM d""")
def stress_coupling(spark, sf_dir):
    cells = V.votes(spark, sf_dir).join(_cells(spark, sf_dir).select("ledger", "n", "m"), "ledger").select("master", (F.col("n") % 3).alias("band"), (F.col("m") < F.col("n")).alias("stressed"), (F.col("type") != "ok").alias("failed"))
    return C.stress_coupling(cells)


RUNS = """, one AS (SELECT DISTINCT master, ledger FROM incident), isl AS (SELECT *, ledger - row_number() OVER (PARTITION BY master ORDER BY ledger) AS g FROM one), rn AS (SELECT master, min(ledger) AS from_ledger, max(ledger) AS to_ledger, count(*) AS ledgers FROM isl GROUP BY master, g)"""
RISK = """, tot AS (SELECT count(*) AS n, count(*) FILTER (failed) AS f FROM cell), gg AS (SELECT tag, count(*) AS w, count(*) FILTER (failed) AS fw FROM tags JOIN cell USING (ledger) GROUP BY 1), rk AS (SELECT tag, round(CASE WHEN f - fw > 0 THEN (fw / w) / ((f - fw) / (n - w)) END, 6) AS lift FROM gg, tot)"""


@query("votes incident", CELL + RISK + RUNS + """, cand AS (SELECT ledger, master, tag AS cause, coalesce(lift, 0) AS weight FROM one JOIN tags USING (ledger) JOIN rk USING (tag)
      UNION ALL SELECT o.ledger, o.master, 'run', r.ledgers::double FROM one o JOIN rn r ON r.master = o.master AND o.ledger BETWEEN from_ledger AND to_ledger WHERE r.ledgers > 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY ledger, master ORDER BY weight DESC, cause) AS place FROM cand) SELECT * FROM p WHERE place <= 3""")
def cause_ranking(spark, sf_dir):
    incidents = V.incident(spark, sf_dir)
    risk = D.risk_profile(_cells(spark, sf_dir).select("ledger", "failed"), _tags(spark, sf_dir))
    runs = T.in_runs(incidents.select("ledger", "master").distinct(), D.failure_runs(incidents).select("master", "from_ledger", "to_ledger", "ledgers"), "master", "ledger", 64)
    return C.ranked_causes(incidents, _tags(spark, sf_dir), risk, runs.select("ledger", "master", "ledgers"))


@query("incident", "WITH x AS (SELECT 1)" + RUNS + " SELECT o.master, o.ledger, from_ledger, to_ledger, ledgers FROM one o JOIN rn r ON r.master = o.master AND o.ledger BETWEEN from_ledger AND to_ledger WHERE ledgers > 1")
def series_context(spark, sf_dir):
    incidents = V.incident(spark, sf_dir)
    runs = D.failure_runs(incidents).where("ledgers > 1").select("master", "from_ledger", "to_ledger", "ledgers")
    return T.in_runs(incidents.select("master", "ledger").distinct(), runs, "master", "ledger", 64)


@query("incident", "WITH x AS (SELECT 1)" + RUNS + " SELECT CASE WHEN ledgers >= 3 THEN 'long' WHEN ledgers = 2 THEN 'pair' ELSE 'single' END AS class, count(*) AS runs, count(DISTINCT master) AS masters, cast(sum(ledgers) AS bigint) AS ledgers FROM rn GROUP BY 1")
def window_scan(spark, sf_dir):
    n = F.col("ledgers")
    runs = D.failure_runs(V.incident(spark, sf_dir)).select("master", "ledgers", F.when(n >= 3, "long").when(n == 2, "pair").otherwise("single").alias("class"))
    return runs.groupBy("class").agg(F.count("*").alias("runs"), F.countDistinct("master").alias("masters"), F.sum("ledgers").alias("ledgers"))


@query("votes incident", CELL + " SELECT tag, count(*) AS incidents, arg_max(master, (t_ms, master, ledger)) AS master, arg_max(ledger, (t_ms, master, ledger)) AS ledger, max(t_ms) AS t_ms FROM incident JOIN tags USING (ledger) GROUP BY 1")
def signature_board(spark, sf_dir):
    return C.signature_board(V.incident(spark, sf_dir), _tags(spark, sf_dir))


@query("votes incident", CELL + ", k AS (SELECT ledger, count(DISTINCT master) AS k FROM incident GROUP BY 1) SELECT tag, count(*) AS ledgers, median(k)::double AS median, max(k) AS largest FROM k JOIN tags USING (ledger) GROUP BY 1")
def signature_cohort(spark, sf_dir):
    return C.signature_cohort(V.incident(spark, sf_dir), _tags(spark, sf_dir))


@query("ev", """WITH e AS (SELECT max(t_ms) AS now FROM ev), c AS (SELECT concat('V', user_id) AS master, t_ms FROM ev WHERE event_type = 'error'), r AS (SELECT concat('V', user_id) AS master, t_ms FROM ev WHERE event_type = 'signup'),
    h AS (SELECT unnest([24, 168, 720])::bigint AS hours), a AS (SELECT master, hours, count(*) AS claimed FROM c, e, h WHERE t_ms > now - hours * 3600000 GROUP BY 1, 2), b AS (SELECT master, hours, count(*) AS reference FROM r, e, h WHERE t_ms > now - hours * 3600000 GROUP BY 1, 2)
    SELECT coalesce(a.master, b.master) AS master, coalesce(a.hours, b.hours) AS hours, coalesce(claimed, 0) AS claimed, coalesce(reference, 0) AS reference, greatest(0, coalesce(claimed, 0) - coalesce(reference, 0))::bigint AS false_least,
      CASE WHEN coalesce(claimed, 0) > coalesce(reference, 0) THEN 'over' WHEN coalesce(claimed, 0) < coalesce(reference, 0) THEN 'under' ELSE 'equal' END AS verdict FROM a FULL JOIN b ON a.master = b.master AND a.hours = b.hours""")
def truth_windows(spark, sf_dir):
    e = V.events(spark, sf_dir).withColumn("master", F.concat(F.lit("V"), "user_id"))
    now = e.agg(F.max("t_ms")).first()[0]
    return C.truth(e.where("event_type = 'error'"), e.where("event_type = 'signup'"), now, [24, 168, 720])


@query("votes", """WITH d AS (SELECT master, t_ms // 86400000 AS day, count(*) FILTER (type = 'ok') AS ok, count(*) FILTER (type = 'missed') AS missed, count(*) AS total, max(type) AS k, min(type) AS l FROM votes GROUP BY 1, 2),
    a AS (SELECT *, k <> lag(k) OVER w AS rotated, l <> lag(l) OVER w AS moved FROM d WINDOW w AS (PARTITION BY master ORDER BY day))
    SELECT master, day, 'validator-revoked' AS alert, 'malicious' AS severity, NULL::double AS value, NULL::double AS threshold FROM a WHERE missed = total
    UNION ALL SELECT master, day, 'agreement-drop', 'suspect', ok / total, 0.95::double FROM a WHERE total >= 2 AND ok / total < 0.95
    UNION ALL SELECT master, day, 'missed-surge', 'suspect', round(missed / total * 1000) / 10, 5.0::double FROM a WHERE total >= 2 AND missed / total > 0.05
    UNION ALL SELECT master, day, 'signing-key-rotated', 'suspect', NULL, NULL FROM a WHERE rotated UNION ALL SELECT master, day, 'unl-membership-changed', 'suspect', NULL, NULL FROM a WHERE moved""")
def health_alerts(spark, sf_dir):
    """A day is a snapshot: its last type by name stands for the key, its first for the list; all missed: revoked."""
    t = F.col("type")
    daily = V.votes(spark, sf_dir).groupBy("master", F.expr("t_ms DIV 86400000").alias("day")).agg(F.count_if(t == "ok").alias("ok"), F.count_if(t == "missed").alias("missed"), F.count("*").alias("total"), F.max("type").alias("signing_key"), F.min("type").alias("list"))
    info = daily.withColumn("score", F.col("ok") / F.col("total")).withColumn("revoked", F.col("missed") == F.col("total")).withColumn("incomplete", F.lit(False))
    return C.health_alerts(info, "day", least=2)


@query("ev", """WITH i AS (SELECT event_id, user_id, t_ms FROM ev WHERE event_type = 'error'), s AS (SELECT user_id, t_ms, event_id AS snapshot FROM ev WHERE event_type = 'signup')
    SELECT i.event_id, i.user_id, i.t_ms, s.snapshot FROM i ASOF LEFT JOIN s ON i.user_id = s.user_id AND i.t_ms >= s.t_ms""")
def member_asof(spark, sf_dir):
    e = V.events(spark, sf_dir)
    return T.asof(e.where("event_type = 'error'").select("event_id", "user_id", "t_ms"), e.where("event_type = 'signup'").select("user_id", "t_ms", F.col("event_id").alias("snapshot")), "user_id", "t_ms", "snapshot")


@query("ev", """WITH i AS (SELECT event_id, user_id, t_ms FROM ev WHERE event_type = 'error'), s AS (SELECT user_id, t_ms FROM ev WHERE event_type = 'click'),
    m AS (SELECT event_id, min(abs(i.t_ms - s.t_ms)) AS d FROM i JOIN s USING (user_id) GROUP BY 1) SELECT i.event_id, i.user_id, i.t_ms, CASE WHEN d <= 86400000 THEN d END AS distance FROM i LEFT JOIN m USING (event_id)""")
def nearest_capture(spark, sf_dir):
    e = V.events(spark, sf_dir)
    return T.nearest(e.where("event_type = 'error'").select("event_id", "user_id", "t_ms"), e.where("event_type = 'click'"), "user_id", "t_ms", 86_400_000)


@query("ev", "WITH w AS (SELECT event_id, user_id, t_ms, count(*) OVER (PARTITION BY user_id ORDER BY t_ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS recent FROM ev) SELECT *, recent <= 3 AS allowed FROM w")
def sliding_limit(spark, sf_dir):
    return T.sliding_limit(V.events(spark, sf_dir).select("event_id", "user_id", "t_ms"), "user_id", "t_ms", 86_400_000, 3)


@query("txn", """WITH r AS (SELECT account, hash, ledger_seq, row_number() OVER (PARTITION BY account ORDER BY ledger_seq, hash) - 1 AS rn, count(*) OVER (PARTITION BY account) AS n FROM txn)
    SELECT account, hash, ledger_seq FROM r WHERE n <= 7 OR rn IN (SELECT unnest([0, n // 7, (2 * n) // 7, (3 * n) // 7, (4 * n) // 7, (5 * n) // 7, (6 * n) // 7]))""")
def stride_sample(spark, sf_dir):
    return T.strided(V.txn(spark, sf_dir).select("account", "hash", "ledger_seq"), "account", ["ledger_seq", "hash"], 7)


@query("txn", """WITH f AS (SELECT DISTINCT account AS address FROM txn WHERE ledger_seq > 2300) SELECT DISTINCT account AS address FROM txn WHERE account NOT IN (SELECT address FROM f) ORDER BY 1 LIMIT 20""")
def snapshot_refresh(spark, sf_dir):
    t = V.txn(spark, sf_dir)
    return T.due_for_refresh(t.select(F.col("account").alias("address")), t.groupBy(F.col("account").alias("address")).agg(F.max("ledger_seq").alias("snapshot_at")), 2500, 200, 20)


@query("votes", """WITH b AS (SELECT min(t_ms) + 1800000 AS lo, max(t_ms) - 900000 AS hi FROM votes), c AS (SELECT master, t_ms // 3600000 AS hour, count(*) AS n FROM votes GROUP BY 1, 2)
    SELECT master, round(sum(n * least(1.0::double, greatest(0, least(hour * 3600000 + 3600000, hi) - greatest(hour * 3600000, lo)) / 3600000)), 6) AS votes FROM c, b GROUP BY 1""")
def prorated_hours(spark, sf_dir):
    v = V.votes(spark, sf_dir)
    lo, hi = v.agg(F.min("t_ms") + 1_800_000, F.max("t_ms") - 900_000).first()
    cells = v.groupBy("master", F.expr("t_ms DIV 3600000").alias("hour")).agg(F.count("*").alias("n"))
    return cells.groupBy("master").agg(F.round(T.prorated(cells, F.col("hour") * 3_600_000, 3_600_000, lo, hi, "n"), 6).alias("votes"))


@query("", "SELECT r AS from_ledger, least(r + 499, 2499) AS to_ledger FROM (SELECT unnest(range(1, 2500, 500)) AS r)")
def replay_jobs(spark, sf_dir):
    return T.job_windows(spark, 1, 2499, 500)


@query("votes", """WITH e AS (SELECT max(t_ms) AS now FROM votes), h AS (SELECT unnest([1, 24, 720])::bigint AS hours)
    SELECT master, hours, count(*) AS total, count(*) FILTER (type = 'missed') AS missed FROM votes, e, h WHERE t_ms > now - hours * 3600000 GROUP BY 1, 2""")
def reference_windows(spark, sf_dir):
    v = V.votes(spark, sf_dir)
    now = v.agg(F.max("t_ms")).first()[0]
    spans = F.explode(F.array_compact(F.array(*(F.when(F.col("t_ms") > now - h * 3_600_000, F.lit(h)) for h in (1, 24, 720)))))
    return v.withColumn("hours", spans).groupBy("master", F.col("hours").cast("bigint").alias("hours")).agg(F.count("*").alias("total"), F.count_if(F.col("type") == "missed").alias("missed"))


@query("votes", """SELECT concat_ws(',', master, count(*), count(*) FILTER (type = 'missed'), concat('"', string_agg(DISTINCT type, ',' ORDER BY type), '"')) AS line FROM votes GROUP BY master HAVING count(DISTINCT type) > 1""")
def csv_report(spark, sf_dir):
    by = V.votes(spark, sf_dir).groupBy("master").agg(F.count("*").alias("votes"), F.count_if(F.col("type") == "missed").alias("missed"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return by.where("types LIKE '%,%'").select(C.csv_line("master", "votes", "missed", "types").alias("line"))


@query("votes", """SELECT 'orders-without-lines' AS "check", count(*) AS violations FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'lines-without-order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'late-half', count(*) FROM votes WHERE t_ms % 600000 >= 300000""")
def audits(spark, sf_dir):
    o, line = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return C.audit({"orders-without-lines": o.join(line, "k", "left_anti"), "lines-without-order": line.join(o, "k", "left_anti"), "late-half": V.votes(spark, sf_dir).where("t_ms % 600000 >= 300000")})


@query("edge", """SELECT account AS address, max(ra)::bigint AS risk, string_agg(DISTINCT concat(type, ':', CASE r WHEN 3 THEN 'malicious' WHEN 2 THEN 'suspect' ELSE 'info' END), ',' ORDER BY concat(type, ':', CASE r WHEN 3 THEN 'malicious' WHEN 2 THEN 'suspect' ELSE 'info' END)) AS reasons,
    min(ledger_seq) AS first_seen, count(DISTINCT destination) AS receivers FROM edge WHERE ra >= 2 GROUP BY 1""")
def threats(spark, sf_dir):
    return W.threats(G.flag_edges(V.txn(spark, sf_dir), V.finding(spark, sf_dir)))


@query("txn", """WITH o AS (SELECT account AS cluster, list_distinct(list(destination)) AS m, cast(sum(amount_drops) AS bigint) AS t FROM txn WHERE ledger_seq < 1200 GROUP BY 1), n AS (SELECT account AS cluster, list_distinct(list(destination)) AS m, cast(sum(amount_drops) AS bigint) AS t FROM txn WHERE ledger_seq >= 1200 GROUP BY 1)
    SELECT coalesce(o.cluster, n.cluster) AS cluster, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.m, []), coalesce(n.m, [])))), ',') AS members, greatest(o.t, n.t) AS total_drops FROM o FULL JOIN n ON o.cluster = n.cluster""")
def view_merge(spark, sf_dir):
    t = V.txn(spark, sf_dir)
    f = lambda d: d.groupBy(F.col("account").alias("cluster")).agg(F.collect_set("destination").alias("members"), F.sum("amount_drops").alias("total_drops"))
    return W.merge_views(f(t.where("ledger_seq < 1200")), f(t.where("ledger_seq >= 1200"))).withColumn("members", F.array_join("members", ","))


@query("edge", """WITH d AS (SELECT account, list_sort(list_distinct(list(destination))) AS e FROM edge GROUP BY 1) SELECT account, array_to_string(list_transform(e, lambda x, i: concat('E-', i, ' ', x)), ';') AS evidence FROM d""")
def evidence_refs(spark, sf_dir):
    e = G.flag_edges(V.txn(spark, sf_dir), V.finding(spark, sf_dir)).groupBy("account").agg(F.array_sort(F.collect_set("destination")).alias("e"))
    return e.select("account", F.array_join(W.evidence_refs(F.col("e")), ";").alias("evidence"))


@query("", """WITH p AS (SELECT c_nationkey AS ring, c_custkey AS n, cast(c_custkey % 100 AS double) AS x, cast(c_custkey * 7 % 101 AS double) AS y FROM customer),
    s AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY ring ORDER BY n)),
    a AS (SELECT ring, sum(x * ny - nx * y) / 2 AS area, sum((x + nx) * (x * ny - nx * y)) AS sx, sum((y + ny) * (x * ny - nx * y)) AS sy FROM s GROUP BY 1)
    SELECT ring, round(abs(area), 4) AS area, round(sx / (6 * area), 4) AS cx, round(sy / (6 * area), 4) AS cy FROM a WHERE area <> 0""")
def centroids(spark, sf_dir):
    k = F.col("c_custkey")
    return W.centroids(V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("ring"), k.alias("n"), (k % 100).cast("double").alias("x"), (k * 7 % 101).cast("double").alias("y")))


@query("txn", """SELECT account AS address, max(ledger_seq) AS age_from, 2500 - max(ledger_seq) AS age, count(*) <= 30 AS strict FROM txn GROUP BY 1 HAVING 2500 - max(ledger_seq) BETWEEN 0 AND 60""")
def fresh_evidence(spark, sf_dir):
    s = V.txn(spark, sf_dir).groupBy(F.col("account").alias("address")).agg(F.max("ledger_seq").alias("previous_ledger"), F.count("*").alias("sequence")).withColumn("snapshot_ledger", F.lit(2500))
    return W.fresh_evidence(s, 60, 30).select("address", (2500 - F.col("age")).alias("age_from"), "age", "strict")


@query("txn", """WITH w AS (SELECT least(account, destination) AS a, greatest(account, destination) AS b, count(*) FILTER (account < destination) AS f, count(*) FILTER (account > destination) AS k FROM txn GROUP BY 1, 2),
    c AS (SELECT a AS account, count(*) AS cycles FROM w WHERE f >= 1 AND k >= 1 GROUP BY 1), s AS (SELECT account, count(*) FILTER (amount_drops > 9000000) AS drainers, count(*) FILTER (amount_drops < 200000) AS collectors FROM txn GROUP BY 1)
    SELECT account, concat_ws(',', CASE WHEN drainers > 0 THEN 'drainer-sweep' END, CASE WHEN collectors > 0 THEN 'mass-sweep-convergence' END, CASE WHEN cycles > 0 THEN 'wash-cycle' END) AS rules FROM s LEFT JOIN c USING (account)""")
def cluster_rules(spark, sf_dir):
    t = V.txn(spark, sf_dir)
    c = M.wash_cycles(t, least_edges=1, conserve=0.0).groupBy(F.col("a").alias("account")).agg(F.count("*").alias("cycles"))
    s = t.groupBy("account").agg(F.count_if(F.col("amount_drops") > 9_000_000).alias("drainers"), F.count_if(F.col("amount_drops") < 200_000).alias("collectors"))
    return W.rules_of(s.join(c, "account", "left")).select("account", "rules")


@query("txn", """WITH r AS (SELECT destination AS address, tag, amount_drops, ledger_seq, hash, row_number() OVER (PARTITION BY destination ORDER BY ledger_seq DESC, hash DESC, amount_drops DESC, tag DESC) AS n FROM txn) SELECT address, ledger_seq, hash, amount_drops, tag FROM r WHERE n = 1""")
def registry_last_wins(spark, sf_dir):
    return last_wins(V.txn(spark, sf_dir).select(F.col("destination").alias("address"), "ledger_seq", "hash", "amount_drops", "tag"), ["address"], ["ledger_seq", "hash"])


@query("txn", "SELECT account, substr(sha256(string_agg(DISTINCT destination, ',' ORDER BY destination)), 1, 16) AS fingerprint FROM txn GROUP BY 1")
def signers_fingerprint(spark, sf_dir):
    return V.txn(spark, sf_dir).groupBy("account").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("destination")), ","), 256), 1, 16).alias("fingerprint"))


@query("handoff", """WITH hd AS (SELECT t_ms // 21600000 AS day, account, destination, min((ledger_seq, hash, account)) AS e FROM handoff WHERE account <> destination GROUP BY 1, 2, 3),
    w AS (SELECT DISTINCT day, destination AS address, [destination] AS path, true AS more FROM hd
      UNION ALL SELECT w.day, address, CASE WHEN n.a IS NULL THEN path ELSE list_append(path, n.a) END, n.a IS NOT NULL FROM w,
        LATERAL (SELECT arg_min(hd.account, hd.e) AS a FROM hd WHERE hd.day = w.day AND hd.destination = path[len(path)] AND NOT list_contains(path, hd.account)) n WHERE more)
    SELECT day, address, array_to_string(path, '>') AS path, cast(len(path) - 1 AS bigint) AS hops, false AS truncated FROM w WHERE NOT more""")
def replay_archive(spark, sf_dir):
    """Every account's walk back through each archive of six hours, to its end."""
    t = V.handoff(spark, sf_dir).withColumn("day", F.expr("t_ms DIV 21600000"))
    return W.replay(None, t, "day", most=None, joined=">")


@query("txn")
def capped_nodes(spark, sf_dir):
    """A drawing of at most 120 nodes for each tag; tests hold the operator to a direct walk."""
    e = G.flag_edges(V.txn(spark, sf_dir), V.finding(spark, sf_dir)).withColumn("drawing", F.col("tag"))
    e = stored(e.select("drawing", "hash", "account", "destination", "amount_drops", "ledger_seq", "from_rank", "to_rank"))  # for the nodes and the drawing
    ends = e.select("drawing", F.col("account").alias("address"), F.col("from_rank").alias("rank"), "amount_drops").unionByName(e.select("drawing", F.col("destination").alias("address"), F.col("to_rank").alias("rank"), "amount_drops"))
    nodes = ends.groupBy("drawing", "address").agg(F.max("rank").alias("rank"), F.sum("amount_drops").alias("drops")).select("drawing", "address", F.when(F.col("rank") == 3, "malicious").when(F.col("rank") == 2, "suspect").alias("severity"), F.lit("unknown").alias("role"), "drops")
    return W.capped_nodes(nodes, e, "drawing", 120, 24)
