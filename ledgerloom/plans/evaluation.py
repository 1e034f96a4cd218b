"""Queries of ledger evaluation over the events table: an hour is a ledger, users fall to twelve masters, ten of them members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import criticality as C, evaluation as E
from ..sources import views as V
from ..streaming.evaluation import ledger_join
from .registry import query

GRACE, RING, HISTORY, LEAST, SHARE = 1_500_000, 2, 12, 5, 0.3
_HOUR = 3_600_000


def _inputs(spark, sf_dir):
    """(closes, votes, members, quorum samples, subscriptions): hours divisible by 11 were never seen to close, every fifth vote is for two hours before."""
    e = V.events(spark, sf_dir).withColumn("hour", F.expr(f"t_ms DIV {_HOUR}"))
    network = F.lit("main").alias("network")
    closes = e.groupBy("hour").agg(F.count("*").alias("tx_count")).where("hour % 11 <> 0").select(network, F.col("hour").alias("ledger"), F.expr("case when hour % 13 = 0 then null when hour % 7 = 0 then 'view' else 'click' end").alias("hash"), F.expr(f"hour * {_HOUR} + 1500000").alias("close_ms"), "tx_count")
    votes = e.select(network, F.expr("hour - case when event_id % 5 = 0 then 2 else 0 end").alias("ledger"), F.concat(F.lit("V"), F.col("user_id") % 12).alias("master"), F.expr("case when event_type in ('error', 'signup') then event_type else 'click' end").alias("hash"), (F.col("event_type") != "purchase").alias("full"), "t_ms")
    members = E.member_list(e.where("user_id % 12 < 10").select(F.concat(F.lit("V"), F.col("user_id") % 12).alias("master")))
    quorum = e.where("event_type = 'signup'").select(network, "t_ms", F.expr("2 + user_id % 3").alias("quorum"))
    opens = e.where("event_id % 97 = 0").select(network, "t_ms")
    return closes, votes, members, quorum, opens


def _judged(spark, sf_dir):
    closes, votes, members, quorum, opens = _inputs(spark, sf_dir)
    t = E.tallies(closes, votes, members, GRACE)
    return E.judged(t, members, quorum, opens, GRACE, SHARE, HISTORY, LEAST, width=100), votes, members


#: Every level below on its own; a row of b is a member's last vote in time, of k a ledger.
SQL = f"""WITH e AS (SELECT *, t_ms // {_HOUR} AS hour FROM ev),
    c AS (SELECT hour AS ledger, CASE WHEN hour % 13 = 0 THEN NULL WHEN hour % 7 = 0 THEN 'view' ELSE 'click' END AS hash, hour * {_HOUR} + 1500000 AS close_ms, count(*) AS tx_count FROM e WHERE hour % 11 <> 0 GROUP BY hour),
    v AS (SELECT hour - CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS ledger, concat('V', user_id % 12) AS master, CASE WHEN event_type IN ('error', 'signup') THEN event_type ELSE 'click' END AS hash, event_type <> 'purchase' AS "full", t_ms FROM e),
    mm AS (SELECT DISTINCT concat('V', user_id % 12) AS master FROM e WHERE user_id % 12 < 10), mn AS (SELECT count(*) AS members FROM mm),
    tv AS (SELECT v.*, close_ms, v.master IN (SELECT master FROM mm) AS member FROM v JOIN c USING (ledger) WHERE t_ms <= close_ms + {GRACE}),
    b AS (SELECT ledger, master, arg_max(hash, (t_ms, hash, "full")) AS hash, arg_max("full", (t_ms, hash, "full")) AS "full", max(t_ms) - any_value(close_ms) AS delay FROM tv WHERE member GROUP BY 1, 2),
    bn AS (SELECT ledger, count(*) AS votes, min(delay) AS first_vote_ms, max(delay) AS last_vote_ms FROM b GROUP BY 1), os AS (SELECT ledger, count(*) AS outside FROM tv WHERE NOT member GROUP BY 1),
    h AS (SELECT ledger, hash, count(*) AS n, row_number() OVER (PARTITION BY ledger ORDER BY count(*) DESC, hash) AS rn FROM b GROUP BY 1, 2),
    q AS (SELECT t_ms, max(2 + user_id % 3) AS quorum FROM e WHERE event_type = 'signup' GROUP BY 1), op AS (SELECT DISTINCT t_ms AS opened FROM e WHERE event_id % 97 = 0),
    k0 AS (SELECT c.*, close_ms + {GRACE} AS due_ms, coalesce(votes, 0) AS votes, coalesce(outside, 0) AS outside, first_vote_ms, last_vote_ms, h1.hash AS top_hash, coalesce(h1.n, 0) AS top, h2.hash AS runner_hash, coalesce(h2.n, 0) AS runner,
        lag(c.ledger) OVER o AS previous, lag(close_ms) OVER o AS previous_close_ms, row_number() OVER o - 1 AS place
        FROM c LEFT JOIN bn USING (ledger) LEFT JOIN os USING (ledger) LEFT JOIN h h1 ON h1.ledger = c.ledger AND h1.rn = 1 LEFT JOIN h h2 ON h2.ledger = c.ledger AND h2.rn = 2 WINDOW o AS (ORDER BY c.ledger)),
    k1 AS (SELECT k0.*, members, quorum AS network_quorum, coalesce(quorum, cast(ceil(members * {int(SHARE * 1000)} / 1000) AS bigint)) AS needed, hash IS NOT NULL AS closed, coalesce(k0.ledger > previous + 1, false) AS index_gap,
        coalesce(opened > previous_close_ms + {GRACE} OR (previous IS NULL AND opened IS NOT NULL), false) AS stream_open
        FROM k0 CROSS JOIN mn ASOF LEFT JOIN q ON k0.due_ms >= q.t_ms ASOF LEFT JOIN op ON k0.due_ms >= op.opened),
    k2 AS (SELECT *, closed AND (index_gap OR stream_open) AS capture_gap, votes + outside AS observed, close_ms - previous_close_ms AS close_gap_ms FROM k1),
    k3 AS (SELECT *, count(*) FILTER (closed AND NOT capture_gap) OVER u AS cc, count(*) FILTER (close_gap_ms IS NOT NULL AND NOT index_gap) OVER u AS cg FROM k2 WINDOW u AS (ORDER BY ledger ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k4 AS (SELECT *, CASE WHEN count(*) OVER r >= {LEAST} THEN median(observed) OVER r END AS observed_baseline, CASE WHEN count(*) FILTER (closed AND NOT capture_gap) OVER x >= {LEAST} THEN median(CASE WHEN closed AND NOT capture_gap THEN votes END) OVER x END AS coverage_baseline,
        median(CASE WHEN close_gap_ms IS NOT NULL AND NOT index_gap THEN close_gap_ms END) OVER g AS median_gap_ms
        FROM k3 WINDOW r AS (ORDER BY ledger ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING), x AS (ORDER BY cc RANGE BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING), g AS (ORDER BY cg RANGE BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING)),
    k5 AS (SELECT *, top_hash IS NOT NULL AND top >= needed AS has_quorum, top - needed AS margin, closed AND coalesce(observed < observed_baseline * 0.75, false) AS reception_thin, members - votes AS absent,
        CASE WHEN closed AND needed > 0 THEN greatest(0, members - needed) END AS genuine_absent_max, closed AND coalesce(top_hash <> hash, false) AS closure_conflict FROM k4),
    k AS (SELECT *, closed AND NOT capture_gap AND NOT reception_thin AND coalesce(votes >= coverage_baseline * 0.9, false) AND NOT closure_conflict AND coalesce(absent <= genuine_absent_max, false) AS attributable FROM k5),
    i0 AS (SELECT k.ledger, mm.master, b.delay AS vote_delay_ms, b.hash AS voted_hash, CASE WHEN b.delay IS NULL THEN CASE WHEN has_quorum AND attributable THEN 'missed' WHEN closed THEN 'vote-not-observed' ELSE 'no-quorum' END
        WHEN has_quorum AND b.hash IS DISTINCT FROM top_hash THEN 'wrong-hash' WHEN NOT coalesce(b."full", true) THEN 'partial' END AS type FROM k CROSS JOIN mm LEFT JOIN b ON b.ledger = k.ledger AND b.master = mm.master),
    i AS (SELECT * FROM i0 WHERE type IS NOT NULL),
    l AS (SELECT v.ledger, v.master, arg_max(v.hash, (t_ms, v.hash, "full")) AS hash, arg_max("full", (t_ms, v.hash, "full")) AS "full", max(t_ms) - any_value(k.close_ms) AS delay_ms, coalesce(t_ms < k2.due_ms, true) AS in_ring
        FROM v JOIN mm USING (master) JOIN k ON k.ledger = v.ledger AND t_ms > k.due_ms LEFT JOIN k k2 ON k2.place = k.place + {RING} GROUP BY v.ledger, v.master, coalesce(t_ms < k2.due_ms, true))"""

_COLUMNS = ["ledger", "tx_count", "votes", "outside", "top_hash", "top", "runner_hash", "runner", "first_vote_ms", "last_vote_ms", "previous", "needed", "network_quorum", "closed", "index_gap", "stream_open", "capture_gap", "observed", "observed_baseline", "coverage_baseline",
            "close_gap_ms", "median_gap_ms", "has_quorum", "margin", "reception_thin", "absent", "genuine_absent_max", "closure_conflict", "attributable"]


@query("ev", SQL + f" SELECT {', '.join(_COLUMNS)} FROM k")
def ledger_evaluation(spark, sf_dir):
    """What each ledger's votes prove, with measured quorum, own levels and attribution."""
    return _judged(spark, sf_dir)[0].select(*_COLUMNS)


@query("ev", SQL + """ SELECT i.ledger, i.master, type, CASE WHEN type IN ('missed', 'vote-not-observed') AND delay_ms IS NOT NULL THEN delay_ms ELSE vote_delay_ms END AS vote_delay_ms, voted_hash, type IN ('missed', 'vote-not-observed') AND delay_ms IS NOT NULL AS late
    FROM i LEFT JOIN l ON l.ledger = i.ledger AND l.master = i.master AND in_ring""")
def member_incidents(spark, sf_dir):
    """Each member's incidents by type, late votes patched in."""
    j, votes, members = _judged(spark, sf_dir)
    return E.patched(E.incidents(j, members), E.late(j, votes, members, RING)).drop("network")


@query("ev", SQL + """ SELECT ledger, master, delay_ms, hash, "full", in_ring FROM l""")
def late_ring(spark, sf_dir):
    """Members' votes after their ledger was due, within the ring of later ledgers or outside."""
    j, votes, members = _judged(spark, sf_dir)
    return E.late(j, votes, members, RING).drop("network")


@query("ev", SQL + f""", vi AS (SELECT v.ledger, v.master, arg_max(v.hash, (t_ms, v.hash)) AS voted, any_value(c.hash) AS hash FROM v JOIN c USING (ledger) WHERE t_ms BETWEEN close_ms - 1200000 AND close_ms + 1500000 GROUP BY 1, 2),
    ta AS (SELECT ledger, count(*) AS voters, count(*) FILTER (voted = hash) AS agreeing FROM vi GROUP BY 1),
    x AS (SELECT hour AS ledger, concat('U', user_id) AS account, concat('H', hour, '-', user_id, '-', event_id % 2) AS tx_hash, cast(round(value * 100) AS bigint) AS drops, t_ms FROM e WHERE event_type <> 'view'),
    xi AS (SELECT ledger, account, tx_hash, max(drops) AS drops FROM x JOIN c USING (ledger) WHERE t_ms BETWEEN close_ms - 1200000 AND close_ms + 1500000 GROUP BY 1, 2, 3),
    sh AS (SELECT ledger, count(*) AS tx_count, count(DISTINCT account) AS senders, cast(sum(drops) AS bigint) AS drops FROM xi GROUP BY 1)
    SELECT c.ledger, c.hash, coalesce(voters, 0) AS voters, coalesce(agreeing, 0) AS agreeing, coalesce(sh.tx_count, 0) AS tx_count, coalesce(senders, 0) AS senders, coalesce(drops, 0) AS drops FROM c LEFT JOIN ta USING (ledger) LEFT JOIN sh USING (ledger)""")
def ledger_streams(spark, sf_dir):
    """The join of the vote, close and transaction streams, here over tables."""
    closes, votes, *_ = _inputs(spark, sf_dir)
    e = V.events(spark, sf_dir).where("event_type <> 'view'").withColumn("hour", F.expr(f"t_ms DIV {_HOUR}"))
    txs = e.select(F.lit("main").alias("network"), F.col("hour").alias("ledger"), F.concat(F.lit("H"), "hour", F.lit("-"), "user_id", F.lit("-"), F.col("event_id") % 2).alias("tx_hash"), F.concat(F.lit("U"), "user_id").alias("account"), F.round(F.col("value") * 100).cast("bigint").alias("amount_drops"), "t_ms")
    return ledger_join(closes, votes, txs, "20 minutes", "25 minutes").drop("network", "closed_at")


CRITICAL = SQL + """, kd AS (SELECT *, close_ms // 86400000 AS day FROM k), cap AS (SELECT t_ms AS at_ms, min(event_type) AS kind FROM e WHERE event_id % 53 = 0 GROUP BY 1),
    dc AS (SELECT a.ledger, count(x.ledger) AS dn, median(x.votes) AS dm FROM kd a LEFT JOIN kd x ON x.day = a.day AND x.ledger <> a.ledger AND x.closed AND NOT x.capture_gap AND NOT x.stream_open GROUP BY 1),
    ne AS (SELECT ledger, arg_min(kind, (abs(at_ms - close_ms), at_ms)) AS event_kind, min(abs(at_ms - close_ms)) AS event_delta_ms FROM kd JOIN cap ON at_ms // 86400000 = day AND abs(at_ms - close_ms) <= 600000 GROUP BY 1),
    ac AS (SELECT ledger, count(*) AS affected, count(*) FILTER (type IN ('missed', 'vote-not-observed', 'no-quorum')) AS absent_count, list(concat(type, '|', master) ORDER BY type, master) AS who FROM i GROUP BY 1),
    cr AS (SELECT i.ledger, i.master, i.type, votes, needed, top, margin, CASE WHEN NOT closed THEN 'not-closed' WHEN capture_gap THEN 'closed-capture-gap' WHEN closure_conflict THEN 'closed-line-conflict' WHEN has_quorum THEN 'closed-quorum-observed' WHEN reception_thin THEN 'closed-reception-thin' ELSE 'closed-observation-gap' END AS verdict,
        NOT closed AND needed > 0 AND margin <= 1 AS critical, coalesce(coverage_baseline, CASE WHEN dn >= 5 THEN dm END) AS coverage_level, CASE WHEN coverage_baseline IS NOT NULL THEN 'recorded' WHEN dn >= 5 THEN 'day' END AS coverage_basis, CASE WHEN coverage_baseline IS NULL AND dn >= 5 THEN dn END AS coverage_samples,
        CASE WHEN closed AND needed > 0 THEN top >= needed END AS capture_complete, CASE WHEN closed AND needed > 0 THEN greatest(0, absent_count - genuine_absent_max) END AS capture_artifact_min, event_kind, event_delta_ms, affected,
        array_to_string(list_filter(who, lambda x: NOT ends_with(x, concat('|', i.master))), ',') AS others
        FROM i JOIN kd ON kd.ledger = i.ledger JOIN dc ON dc.ledger = i.ledger JOIN ac ON ac.ledger = i.ledger LEFT JOIN ne ON ne.ledger = i.ledger)"""


def _critical(spark, sf_dir):
    j, _, members = _judged(spark, sf_dir)
    captures = V.events(spark, sf_dir).where("event_id % 53 = 0").select(F.lit("main").alias("network"), F.col("event_type").alias("kind"), F.col("t_ms").alias("at_ms"))
    return C.criticality(j, E.incidents(j, members), captures, near_ms=600_000, least=LEAST)


@query("ev", CRITICAL + " SELECT * FROM cr")
def quorum_criticality(spark, sf_dir):
    """Each incident's verdict chain, coverage without its own ledger, nearest capture event and the others concerned."""
    r = _critical(spark, sf_dir).withColumn("others", F.array_join(F.zip_with("affected_types", "affected_masters", lambda t, m: F.concat(t, F.lit("|"), m)), ","))
    return r.select("ledger", "master", "type", "votes", "needed", "top", "margin", "verdict", "critical", "coverage_level", "coverage_basis", "coverage_samples", "capture_complete", "capture_artifact_min", "event_kind", "event_delta_ms", "affected", "others")


@query("ev", CRITICAL + """ SELECT master, count(*) AS checked, count(*) FILTER (critical) AS critical, count(*) FILTER (verdict <> 'not-closed') AS closed, count(*) FILTER (verdict = 'closed-capture-gap') AS capture_gaps, count(*) FILTER (verdict = 'closed-reception-thin') AS reception_thin,
    count(*) FILTER (event_kind IS NOT NULL) AS near_events, count(*) FILTER (NOT capture_complete) AS capture_incomplete, cast(coalesce(sum(capture_artifact_min), 0) AS bigint) AS artifact_min, count(*) FILTER (NOT critical) AS follow_on FROM cr GROUP BY 1""")
def criticality_summary(spark, sf_dir):
    """Each member's incidents by verdict."""
    return C.summary(_critical(spark, sf_dir)).drop("network")
