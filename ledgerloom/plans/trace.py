"""Queries of the validator-trace family over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains as C, trace as T, validators as D
from ..sources import views as V
from .registry import query

SAMPLES = """WITH s AS (SELECT event_type AS network, t_ms // 3600000 AS ledger, max(t_ms) AS close_ms, count(*) AS tx_count, count(*) FILTER (user_id % 5 = 0) AS findings FROM ev GROUP BY 1, 2)"""


def _samples(spark, sf_dir):
    return V.events(spark, sf_dir).groupBy(F.col("event_type").alias("network"), F.expr("t_ms DIV 3600000").alias("ledger")).agg(F.max("t_ms").alias("close_ms"), F.count("*").alias("tx_count"), F.count_if(F.col("user_id") % 5 == 0).alias("findings"))


@query("ev", SAMPLES + """, g AS (SELECT *, CASE WHEN lag(ledger) OVER w = ledger - 1 THEN close_ms - lag(close_ms) OVER w END AS gap FROM s WINDOW w AS (PARTITION BY network ORDER BY ledger)),
    m AS (SELECT *, count(*) OVER b AS n, median(tx_count) OVER b AS m_tx, median(findings) OVER b AS m_f, median(CASE WHEN gap > 0 THEN gap END) OVER i AS m_gap FROM g
      WINDOW b AS (PARTITION BY network ORDER BY ledger ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), i AS (PARTITION BY network ORDER BY ledger ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING))
    SELECT network, ledger, 'load-spike' AS type, tx_count AS value, cast(m_tx AS double) AS baseline FROM m WHERE n >= 10 AND tx_count >= 4 AND tx_count >= 2 * m_tx
    UNION ALL SELECT network, ledger, 'close-gap', gap, m_gap FROM m WHERE n >= 10 AND m_gap > 0 AND gap >= 15000 AND gap >= 1.5 * m_gap
    UNION ALL SELECT network, ledger, 'fund-burst', findings, m_f FROM m WHERE n >= 10 AND findings >= 2 AND findings >= 2 * m_f""")
def detect_patterns(spark, sf_dir):
    return T.detect_patterns(_samples(spark, sf_dir), "network", spike_tx=4, spike=2.0, gap=1.5, burst_findings=2, burst=2.0, width=100)


SHAPE = """WITH h AS (SELECT t_ms // 3600000 AS ledger, account, destination FROM handoff), p AS (SELECT ledger, account, destination, count(*) AS n FROM h GROUP BY 1, 2, 3),
    sd AS (SELECT ledger, account, sum(n) AS sent, count(*) AS dests FROM p GROUP BY 1, 2),
    sh AS (SELECT ledger, cast(sum(sent) AS bigint) AS tx_count, count(*) AS senders, arg_max(account, (sent, account)) AS busiest, cast(max(sent) AS bigint) AS busiest_tx, arg_max(account, (dests, sent, account)) AS widest, max(dests) AS fan_out FROM sd GROUP BY 1),
    rc AS (SELECT ledger, count(DISTINCT destination) AS receivers FROM p GROUP BY 1), shape AS (SELECT sh.*, receivers FROM sh JOIN rc USING (ledger))"""


def _shape(spark, sf_dir):
    return T.shapes(V.handoff(spark, sf_dir).withColumn("ledger", F.expr("t_ms DIV 3600000")), "ledger")


@query("handoff", SHAPE + " SELECT * FROM shape")
def tx_shape(spark, sf_dir):
    return _shape(spark, sf_dir)


@query("handoff", SHAPE + """, m AS (SELECT *, count(*) OVER w AS n, median(tx_count) OVER w AS med FROM shape WINDOW w AS (ORDER BY ledger ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT ledger, tx_count, cast(med AS double) AS median_tx, concat_ws(',', CASE WHEN fan_out >= 2 AND busiest_tx >= 3 THEN 'drainer-fanout' END, CASE WHEN busiest_tx >= 3 AND busiest_tx >= 0.2 * tx_count THEN 'sender-burst' END,
      CASE WHEN n >= 10 AND tx_count >= 5 AND tx_count >= 10 * med THEN 'load-extreme' WHEN n >= 10 AND tx_count >= 5 AND tx_count >= 1.4 * med THEN 'load-spike' END) AS signatures FROM m""")
def shape_signatures(spark, sf_dir):
    s = T.signatures(_shape(spark, sf_dir).withColumn("network", F.lit("main")), "network", width=100, fan_dests=2, fan_tx=3, burst_tx=3, burst_share=0.2, spike_tx=5, spike=1.4)
    return s.select("ledger", "tx_count", "median_tx", F.concat_ws(",", "signatures").alias("signatures"))


@query("handoff", """WITH c AS (SELECT DISTINCT account, destination, t_ms // 3600000 AS ledger FROM handoff), r AS (SELECT account, destination, unnest(range(ledger, ledger + 73)) AS pos FROM c),
    h AS (SELECT account, pos, count(DISTINCT destination) AS dests FROM r GROUP BY 1, 2 HAVING count(DISTINCT destination) >= 12)
    SELECT account, min(pos) AS ledger, arg_min(dests, pos) AS dests FROM h GROUP BY 1""")
def sweep_window(spark, sf_dir):
    return T.sweeps(V.handoff(spark, sf_dir).withColumn("ledger", F.expr("t_ms DIV 3600000")), 12, 72)


HASHED = """WITH v AS (SELECT t_ms // 3600000 AS ledger, concat('V', user_id) AS master, t_ms, event_type AS hash, event_id FROM ev), o AS (SELECT ledger, master, arg_max(hash, (t_ms, hash)) AS hash FROM v GROUP BY 1, 2),
    n AS (SELECT ledger, hash, count(*) AS n FROM o GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS rn, lead(n) OVER w AS nx, sum(n) OVER (PARTITION BY ledger) AS voters FROM n WINDOW w AS (PARTITION BY ledger ORDER BY n DESC, hash)),
    t AS (SELECT ledger, cast(voters AS bigint) AS voters, hash AS top_hash, n AS top, coalesce(nx, 0) AS runner, 4::bigint AS need, n - 4 AS margin FROM k WHERE rn = 1)"""


def _hashed(spark, sf_dir):
    return V.events(spark, sf_dir).select(F.expr("t_ms DIV 3600000").alias("ledger"), F.concat(F.lit("V"), "user_id").alias("master"), "t_ms", F.col("event_type").alias("hash"))


@query("ev", HASHED + " SELECT * FROM t")
def ledger_tally(spark, sf_dir):
    return T.tally(_hashed(spark, sf_dir), 5)


@query("ev", HASHED + " SELECT master, count(*) AS wrong, count(DISTINCT ledger) AS ledgers FROM v JOIN t USING (ledger) WHERE hash <> top_hash GROUP BY 1")
def wrong_hash(spark, sf_dir):
    v = _hashed(spark, sf_dir)
    return T.wrong_hash(v, T.tally(v, 5))


CELL = """WITH cell AS (SELECT ledger, count(*) AS n, count(DISTINCT master) AS m, count(*) FILTER (type <> 'ok') > 0 AS failed FROM votes GROUP BY 1),
    tags AS (SELECT ledger, 'load-spike' AS tag FROM cell WHERE n >= 4 UNION ALL SELECT ledger, 'load-extreme' FROM cell WHERE n >= 6 UNION ALL SELECT ledger, 'repeat' FROM cell WHERE m < n UNION ALL SELECT ledger, 'quiet' FROM cell WHERE n = 1)"""


def _cells(spark, sf_dir):
    return V.votes(spark, sf_dir).groupBy("ledger").agg(F.count("*").alias("n"), F.countDistinct("master").alias("m"), (F.count_if(F.col("type") != "ok") > 0).alias("failed"))


def _tags(spark, sf_dir):
    n = F.col("n")
    return _cells(spark, sf_dir).select("ledger", F.explode(F.array_compact(F.array(F.when(n >= 4, "load-spike"), F.when(n >= 6, "load-extreme"), F.when(F.col("m") < n, "repeat"), F.when(n == 1, "quiet")))).alias("tag"))


@query("votes incident", CELL + " SELECT tag, count(*) AS incidents, count(DISTINCT master) AS masters, count(DISTINCT ledger) AS ledgers FROM incident JOIN tags USING (ledger) GROUP BY 1")
def tag_patterns(spark, sf_dir):
    return T.tag_patterns(V.incident(spark, sf_dir), _tags(spark, sf_dir))


@query("votes", CELL + """, a AS (SELECT count(*) AS n, count(*) FILTER (failed) AS f FROM cell), g AS (SELECT tag, count(*) AS "with", count(*) FILTER (failed) AS fails_with FROM tags JOIN cell USING (ledger) GROUP BY 1),
    j AS (SELECT tag, "with", fails_with, n - "with" AS without, f - fails_with AS fails_without FROM g, a)
    SELECT *, round(fails_with / nullif("with", 0), 6) AS rate_with, round(fails_without / nullif(without, 0), 6) AS rate_without,
      round(CASE WHEN fails_without > 0 THEN (fails_with / "with") / (fails_without / without) END, 6) AS lift, "with" >= 20 AND fails_with >= 3 AND without >= 50 AS reliable FROM j""")
def risk_profile(spark, sf_dir):
    return D.risk_profile(_cells(spark, sf_dir).select("ledger", "failed"), _tags(spark, sf_dir))


@query("votes", CELL + """, b AS (SELECT CASE WHEN n <= 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 ELSE 3 END::bigint AS band, count(*) AS ledgers, count(*) FILTER (failed) AS failed FROM cell GROUP BY 1)
    SELECT band, ledgers, failed, round(failed / ledgers, 6) AS rate, (SELECT round(failed / ledgers, 6) FROM b ORDER BY ledgers DESC, band LIMIT 1) AS base_rate FROM b""")
def load_curve(spark, sf_dir):
    return D.load_curve(_cells(spark, sf_dir).select(T.band(F.col("n"), [1, 2, 4]).alias("band"), "failed"))


@query("incident", """WITH s AS (SELECT ledger, count(DISTINCT master) > 1 AS shared FROM incident GROUP BY 1), o AS (SELECT master, ledger, min(t_ms) AS t_ms, min(type) AS type FROM incident GROUP BY 1, 2),
    i AS (SELECT o.*, shared, ledger - row_number() OVER (PARTITION BY master ORDER BY ledger) AS island FROM o JOIN s USING (ledger)),
    r AS (SELECT master, min(ledger) AS from_ledger, max(ledger) AS to_ledger, count(*) AS ledgers, max(t_ms) - min(t_ms) AS duration_ms, count(*) FILTER (type = 'missed') AS missed, count(*) FILTER (type = 'partial') AS partial, count(*) FILTER (type = 'wrong-hash') AS wrong_hash, count(*) FILTER (shared) AS co_ledgers FROM i GROUP BY master, island)
    SELECT *, CASE WHEN ledgers = 1 THEN CASE WHEN wrong_hash > 0 THEN 'hash-divergence' WHEN partial > 0 THEN 'degraded-single' ELSE 'isolated-miss' END
      WHEN co_ledgers >= 0.5 * ledgers THEN 'cohort-window' WHEN partial = ledgers THEN 'degraded-window' WHEN ledgers >= 3 THEN 'offline-window' ELSE 'short-series' END AS verdict FROM r""")
def failure_runs(spark, sf_dir):
    return D.failure_runs(V.incident(spark, sf_dir))


SCOPE = """WITH sc AS (SELECT ledger, count(DISTINCT master) AS masters FROM incident GROUP BY 1), one AS (SELECT DISTINCT ledger, master FROM incident)"""


@query("incident", SCOPE + " SELECT ledger, masters, CASE WHEN masters >= 5 THEN 'network' WHEN masters > 1 THEN 'cohort' ELSE 'solo' END AS scope FROM sc")
def ledger_scope(spark, sf_dir):
    return D.by_ledger(V.incident(spark, sf_dir), 5)


@query("incident", SCOPE + " SELECT master, count(*) FILTER (masters = 1) AS solo, count(*) FILTER (masters BETWEEN 2 AND 4) AS cohort, count(*) FILTER (masters >= 5) AS network FROM one JOIN sc USING (ledger) GROUP BY 1")
def failure_split(spark, sf_dir):
    return D.failure_split(V.incident(spark, sf_dir))


PAIRS = SCOPE + """, pv AS (SELECT o.* FROM one o JOIN sc USING (ledger) WHERE masters < 5), own AS (SELECT master, count(*) AS own FROM pv GROUP BY 1), tot AS (SELECT greatest(1, 4320 - count(*) FILTER (masters >= 5)) AS total FROM sc),
    pr AS (SELECT x.master AS a, y.master AS b, count(*) AS co FROM pv x JOIN pv y USING (ledger) WHERE x.master < y.master GROUP BY 1, 2),
    pairs AS (SELECT a, b, co, oa.own AS own_a, ob.own AS own_b, round(oa.own * ob.own / total, 6) AS expected, round(co / (oa.own * ob.own / total), 6) AS lift, round(least(co / oa.own, co / ob.own), 6) AS mutual FROM pr JOIN own oa ON oa.master = a JOIN own ob ON ob.master = b, tot)"""


@query("incident", PAIRS + " SELECT * FROM pairs")
def co_failure_pairs(spark, sf_dir):
    return D.co_failures(V.incident(spark, sf_dir), 4320)


@query("incident", PAIRS + """, st AS (SELECT a, b FROM pairs WHERE co >= 2 AND lift >= 2.5 AND mutual >= 0.04 UNION SELECT b, a FROM pairs WHERE co >= 2 AND lift >= 2.5 AND mutual >= 0.04),
    reach AS (SELECT a AS master, a AS other FROM st UNION SELECT r.master, s.b FROM reach r JOIN st s ON r.other = s.a) SELECT master, min(other) AS cluster FROM reach GROUP BY 1""")
def co_failure_clusters(spark, sf_dir):
    return D.co_failure_clusters(D.co_failures(V.incident(spark, sf_dir), 4320), least=2, lift=2.5, mutual=0.04)


def _erfc_sql(x):
    from ..functions.stats import ERFC

    t = f"(1 / (1 + 0.5 * abs({x})))"
    poly = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN {t} * exp(-({x}) * ({x}) + {poly}) ELSE 2 - {t} * exp(-({x}) * ({x}) + {poly}) END)"


@query("votes", f"""WITH o AS (SELECT master, count(*) AS n, count(*) FILTER (type <> 'ok') AS f, count(*) FILTER (type <> 'ok') / count(*) AS rate FROM votes GROUP BY 1),
    t AS (SELECT sum(n) AS an, sum(f) AS af, count(*) AS c, quantile_cont(rate, 0.9) AS p90 FROM o),
    z AS (SELECT o.*, an, af, c, p90, (af - f) / (an - n) AS pr, (f - n * ((af - f) / (an - n)) - 0.5) / sqrt(n * ((af - f) / (an - n)) * (1 - (af - f) / (an - n))) AS z,
      (SELECT count(*) FROM o q WHERE q.rate < o.rate) AS lo, (SELECT count(*) - 1 FROM o q WHERE q.rate = o.rate) AS eq FROM o, t)
    SELECT master, n, f, round(rate, 6) AS rate, round(pr, 6) AS peer_rate, round((lo + 0.5 * eq) / greatest(1, c - 1), 6) AS mid_rank, round(z, 6) AS z, round(0.5 * {_erfc_sql('(z / sqrt(2))')}, 6) AS p,
      CASE WHEN rate > p90 AND z >= 2 AND f >= 10 THEN 'outlier' WHEN rate > p90 THEN 'elevated' ELSE 'baseline' END AS verdict FROM z""")
def peer_benchmark(spark, sf_dir):
    return D.peer_benchmark(V.votes(spark, sf_dir), outlier=2.0)


@query("votes", """WITH c AS (SELECT t_ms // 3600000 AS hour, master, count(*) FILTER (type <> 'ok') > 0 AS failed FROM votes GROUP BY 1, 2),
    w AS (SELECT hour, count(*) AS there, count(*) FILTER (failed) AS failing, max(master) FILTER (failed) AS master FROM c GROUP BY 1)
    SELECT master, count(*) AS alone FROM w WHERE failing <= 1 AND failing = 1 AND there - 1 >= 2 GROUP BY 1""")
def alone_hours(spark, sf_dir):
    return D.alone_hours(V.votes(spark, sf_dir), F.expr("t_ms DIV 3600000"), seen=2)


@query("incident", SCOPE + " SELECT master, count(*) FILTER (masters = 1) AS solo, count(*) FILTER (masters > 1) AS shared, max(masters) AS largest, cast(median(masters) AS double) AS median FROM one JOIN sc USING (ledger) GROUP BY 1")
def cohort_split(spark, sf_dir):
    return D.cohort_split(V.incident(spark, sf_dir))


HOURS = """WITH hc AS (SELECT t_ms // 3600000 AS hour, count(*) AS ledgers, count(*) FILTER (type <> 'ok') AS fails, count(*) >= 16 AS attack FROM votes GROUP BY 1)"""


@query("votes", HOURS + f""", d AS (SELECT hour % 24 AS hod, sum(ledgers) FILTER (attack) AS la, sum(fails) FILTER (attack) AS fa, sum(ledgers) FILTER (NOT attack) AS lb, sum(fails) FILTER (NOT attack) AS fb FROM hc GROUP BY 1),
    s AS (SELECT count(*) AS hours_of_day, cast(sum(la) AS bigint) AS ledgers_a, cast(sum(fa) AS bigint) AS fails_a, cast(sum(lb) AS bigint) AS ledgers_b, cast(sum(fb) AS bigint) AS fails_b FROM d WHERE la IS NOT NULL AND lb IS NOT NULL),
    z AS (SELECT *, (fails_a / ledgers_a - fails_b / ledgers_b) / sqrt(((fails_a + fails_b) / (ledgers_a + ledgers_b)) * (1 - (fails_a + fails_b) / (ledgers_a + ledgers_b)) * (1 / ledgers_a + 1 / ledgers_b)) AS z0 FROM s)
    SELECT hours_of_day, ledgers_a, fails_a, ledgers_b, fails_b, round(z0, 6) AS z, round({_erfc_sql('(abs(z0) / sqrt(2))')}, 6) AS p FROM z""")
def impact_matched(spark, sf_dir):
    cells = V.votes(spark, sf_dir).groupBy(F.expr("t_ms DIV 3600000").alias("hour")).agg(F.count("*").alias("ledgers"), F.count_if(F.col("type") != "ok").alias("fails"))
    return D.attack_impact(cells.withColumn("attack", F.col("ledgers") >= 16))


@query("votes", CELL + """, o AS (SELECT master, ledger, count(*) FILTER (type <> 'ok') > 0 AS failed FROM votes GROUP BY 1, 2), tt AS (SELECT master, count(*) AS n, count(*) FILTER (failed) AS f FROM o GROUP BY 1),
    x AS (SELECT tag, master, count(*) AS w, count(*) FILTER (o.failed) AS fw FROM o JOIN tags USING (ledger) GROUP BY 1, 2), j AS (SELECT tag, master, w, fw, n - w AS wo, f - fw AS fo FROM x JOIN tt USING (master)),
    z AS (SELECT *, (fw + fo) / (w + wo) AS p FROM j)
    SELECT tag, master, w AS "with", fw AS fails_with, wo AS without, fo AS fails_without, round(CASE WHEN fo > 0 THEN (fw / w) / (fo / wo) END, 6) AS lift,
      round(CASE WHEN w > 0 AND wo > 0 AND p > 0 AND p < 1 THEN (fw / w - fo / wo) / sqrt(p * (1 - p) * (1 / w + 1 / wo)) END, 6) AS z FROM z""")
def sensitivity(spark, sf_dir):
    return D.sensitivity(V.votes(spark, sf_dir), _tags(spark, sf_dir))


@query("votes", CELL + """, c AS (SELECT CASE WHEN n <= 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 ELSE 3 END::bigint AS "row", ledger % 3 AS col, count(*) AS n, count(*) FILTER (failed) AS f FROM cell GROUP BY 1, 2),
    r AS (SELECT "row", sum(n) AS rn, sum(f) AS rf FROM c GROUP BY 1), k AS (SELECT col, sum(n) AS cn, sum(f) AS cf FROM c GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(f) AS tf FROM c),
    e AS (SELECT c.*, c.n * (rf / rn) * (cf / cn) / (tf / tn) AS x FROM c JOIN r USING ("row") JOIN k USING (col), t)
    SELECT "row", col, n, f, round(x, 6) AS expected, round(CASE WHEN x > 0 THEN f / x END, 6) AS interaction FROM e""")
def quorum_surface(spark, sf_dir):
    c = _cells(spark, sf_dir).groupBy(T.band(F.col("n"), [1, 2, 4]).alias("row"), (F.col("ledger") % 3).alias("col")).agg(F.count("*").alias("n"), F.count_if("failed").alias("f"))
    return D.surface(c)


@query("incident", """WITH b AS (SELECT min(t_ms) AS lo, max(t_ms) + 1 AS hi FROM ev), g AS (SELECT lo, (hi - lo) // 24 AS w FROM b), h AS (SELECT (t_ms - lo) // w AS cell, count(*) AS incidents, count(DISTINCT master) AS masters FROM incident, g WHERE t_ms < lo + w * 24 GROUP BY 1)
    SELECT r.cell, coalesce(incidents, 0) AS incidents, coalesce(masters, 0) AS masters FROM (SELECT unnest(range(24)) AS cell) r LEFT JOIN h USING (cell)""")
def profile_cells(spark, sf_dir):
    lo, hi = V.events(spark, sf_dir).agg(F.min("t_ms"), F.max("t_ms") + 1).first()
    return D.profile_cells(V.incident(spark, sf_dir), lo, hi)


@query("votes", """WITH l AS (SELECT master, t_ms, lag(t_ms) OVER (PARTITION BY master ORDER BY t_ms) AS b FROM votes)
    SELECT master, b AS from_ms, t_ms AS to_ms, t_ms - b AS ms FROM l WHERE t_ms - b >= 259200000""")
def day_holes(spark, sf_dir):
    return D.holes(V.votes(spark, sf_dir), "master", 259_200_000)


@query("incident", """WITH s AS (SELECT master, median(t_ms) AS m, min(t_ms) + (max(t_ms) - min(t_ms)) // 2 AS seen_ms FROM incident GROUP BY 1)
    SELECT master, count(*) AS new, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(DISTINCT type) AS types FROM incident JOIN s USING (master) WHERE t_ms > seen_ms GROUP BY 1""")
def watch_delta(spark, sf_dir):
    i = V.incident(spark, sf_dir)
    seen = i.groupBy("master").agg((F.min("t_ms") + F.expr("(max(t_ms) - min(t_ms)) DIV 2")).alias("seen_ms"))
    return D.watch_delta(i, seen)


@query("votes", """WITH o AS (SELECT master, count(*) AS n, count(*) FILTER (type <> 'ok') AS f FROM votes GROUP BY 1), k AS (SELECT master, (t_ms // 3600000) % 24 AS hod, count(*) AS k FROM votes WHERE type <> 'ok' GROUP BY 1, 2),
    p AS (SELECT master, arg_max(hod, (k, -hod)) AS peak_hour, max(k) AS peak_fails FROM k GROUP BY 1)
    SELECT master, n, f, peak_hour, peak_fails, round(f / n, 6) AS rate, round((SELECT sum(f) / sum(n) FROM o), 6) AS network_rate, round(peak_fails / f, 6) AS peak_share FROM o JOIN p USING (master)""")
def validator_fingerprint(spark, sf_dir):
    return D.fingerprint(V.votes(spark, sf_dir))


@query("votes", """SELECT master, t_ms // 3600000 AS hour, count(*) FILTER (type = 'ok') AS ok, count(*) FILTER (type = 'partial') AS partial, count(*) FILTER (type = 'missed') AS missed, count(*) FILTER (type = 'wrong-hash') AS wrong_hash FROM votes GROUP BY 1, 2""")
def hour_counters(spark, sf_dir):
    return T.materialize_hours(V.votes(spark, sf_dir), F.expr("t_ms DIV 3600000"))


GAPS = """WITH l AS (SELECT network, ledger, lag(ledger) OVER (PARTITION BY network ORDER BY ledger) AS b FROM (SELECT DISTINCT event_type AS network, t_ms // 600000 AS ledger FROM ev)), gp AS (SELECT network, b + 1 AS from_ledger, ledger - 1 AS to_ledger FROM l WHERE ledger - b > 1)"""


@query("ev", GAPS + " SELECT * FROM gp")
def index_gaps(spark, sf_dir):
    return T.index_gaps(V.events(spark, sf_dir).select(F.col("event_type").alias("network"), F.expr("t_ms DIV 600000").alias("ledger")), "network")


@query("ev incident", GAPS + """, g AS (SELECT from_ledger, to_ledger FROM gp WHERE network = 'click'), m AS (SELECT i.master, i.ledger, i.t_ms, EXISTS (SELECT 1 FROM g WHERE i.ledger BETWEEN from_ledger AND to_ledger) AS c FROM incident i WHERE type = 'missed')
    SELECT master, count(*) FILTER (c) AS capture, count(*) FILTER (NOT c) AS open FROM m GROUP BY 1""")
def attribution(spark, sf_dir):
    gaps = T.index_gaps(V.events(spark, sf_dir).where("event_type = 'click'").select(F.lit(1).alias("network"), F.expr("t_ms DIV 600000").alias("ledger")), "network")
    return D.attribution(V.incident(spark, sf_dir), gaps.select("from_ledger", "to_ledger"), 64)


@query("ev", "SELECT event_type AS type, min(t_ms // 3600000) AS ledger FROM ev WHERE event_type NOT IN ('view', 'click') GROUP BY 1 HAVING min(t_ms // 3600000) > 0")
def novel_types(spark, sf_dir):
    return T.first_types(V.events(spark, sf_dir).select(F.col("event_type").alias("type"), F.expr("t_ms DIV 3600000").alias("ledger")), ["view", "click"], 0)


CHAIN = """WITH e AS (SELECT event_id AS hash, concat('U', event_id, '-', user_id) AS x, user_id, t_ms, event_id, cast(round(value * 100) AS bigint) AS amount_drops, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM ev)"""


@query("ev", """WITH s AS (SELECT concat('H', event_id) AS hash, concat('N', event_id) AS account, concat('N', lead(event_id) OVER (PARTITION BY user_id, t_ms // 86400000 ORDER BY event_id)) AS destination, lead(event_id) OVER (PARTITION BY user_id, t_ms // 86400000 ORDER BY event_id) AS nx,
      cast(round(value * 100) AS bigint) AS amount_drops, event_id AS ledger_seq FROM ev), e AS (SELECT hash, account, destination, amount_drops, ledger_seq FROM s WHERE nx IS NOT NULL),
    st AS (SELECT a.hash AS h, b.hash AS n, b.destination AS dst, b.amount_drops AS amt FROM e a JOIN e b ON a.destination = b.account WHERE a.amount_drops > 0 AND b.amount_drops / a.amount_drops BETWEEN 0.2 AND 0.95 AND b.ledger_seq - a.ledger_seq BETWEEN 0 AND 900),
    w AS (SELECT hash AS tip, concat(account, '>', destination) AS path, amount_drops AS first_drops, amount_drops AS last_drops, 1 AS hops FROM e WHERE hash IN (SELECT h FROM st) AND hash NOT IN (SELECT n FROM st)
      UNION ALL SELECT st.n, concat(path, '>', dst), first_drops, amt, hops + 1 FROM w JOIN st ON tip = h WHERE hops < 8)
    SELECT path, first_drops, last_drops, cast(hops AS bigint) AS hops FROM w WHERE hops >= 3 AND (hops = 8 OR tip NOT IN (SELECT h FROM st))""")
def peeling_chains(spark, sf_dir):
    from pyspark.sql.window import Window

    nxt = F.lead("event_id").over(Window.partitionBy("user_id", F.expr("t_ms DIV 86400000")).orderBy("event_id"))
    e = V.events(spark, sf_dir).withColumn("nx", nxt).where("nx IS NOT NULL").select(F.concat(F.lit("H"), "event_id").alias("hash"), F.concat(F.lit("N"), "event_id").alias("account"), F.concat(F.lit("N"), "nx").alias("destination"), F.round(F.col("value") * 100).cast("bigint").alias("amount_drops"), F.col("event_id").alias("ledger_seq"))
    return C.peeling_chains(e, low=0.2).select(F.array_join("path", ">").alias("path"), "first_drops", "last_drops", "hops")


@query("handoff", """WITH h AS (SELECT account AS chain, ledger_seq, amount_drops, ledger_seq % 3 + 10 AS fee, ledger_seq % 40 AS tag FROM handoff),
    g AS (SELECT *, ledger_seq - lag(ledger_seq) OVER (PARTITION BY chain ORDER BY ledger_seq) AS gap, median(fee) OVER (PARTITION BY chain) AS mid FROM h),
    b AS (SELECT chain, count(*) AS hops, bool_and(abs(fee - mid) <= 0.1 * mid) AS fees, count(DISTINCT amount_drops) < count(amount_drops) AS amounts, count(DISTINCT tag) < count(tag) AS tags, coalesce(count(*) >= 3 AND median(gap) <= 60 AND var_pop(gap) <= 4000, false) AS even FROM g GROUP BY 1)
    SELECT *, (fees::int + amounts::int + tags::int + even::int)::bigint AS score FROM b""")
def chain_fingerprint(spark, sf_dir):
    h = V.handoff(spark, sf_dir).select(F.col("account").alias("chain"), "ledger_seq", "amount_drops", (F.col("ledger_seq") % 3 + 10).alias("fee"), (F.col("ledger_seq") % 40).alias("tag"))
    return C.chain_fingerprint(h, gap=60.0, variance=4000.0)
