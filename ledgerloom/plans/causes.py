"""The nine-layer cause ranking over incidents of the events table, with facts from runs, bands of load and hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cause_layers as L, timing as T, validators as D
from ..sources import views as V
from .registry import query

SQL = """WITH one AS (SELECT ledger, master, min(type) AS type, min(t_ms) AS t_ms FROM incident GROUP BY 1, 2), isl AS (SELECT ledger, master, ledger - row_number() OVER (PARTITION BY master ORDER BY ledger) AS g FROM one),
    rn AS (SELECT master, g, count(*) AS run FROM isl GROUP BY 1, 2), rl AS (SELECT isl.ledger, isl.master, run FROM isl JOIN rn USING (master, g)),
    lc AS (SELECT ledger, count(*) AS n FROM votes GROUP BY 1), sc AS (SELECT ledger, count(*) AS m FROM one GROUP BY 1),
    ld AS (SELECT master, least(n, 4) AS bucket, count(*) AS v, count(*) FILTER (type <> 'ok') / count(*) AS rate FROM votes JOIN lc USING (ledger) GROUP BY 1, 2),
    hc AS (SELECT t_ms // 3600000 AS hour, 12 * count(DISTINCT ledger) AS hour_ledgers, count(*) FILTER (type = 'missed') AS signature FROM votes GROUP BY 1), pk AS (SELECT master, (t_ms // 3600000) % 24 AS hod, count(*) AS peak FROM one GROUP BY 1, 2),
    f AS (SELECT one.*, run, n, m, least(n, 4) AS bucket, a.rate AS own_rate, a.v, b.rate AS base_rate, hour_ledgers, signature, (one.t_ms // 3600000) AS hour, peak, one.ledger % 2 = 0 AS known, one.ledger % 5 <> 0 AS closed, one.t_ms % 600000 // 10 AS delay
        FROM one JOIN rl USING (ledger, master) JOIN lc USING (ledger) JOIN sc USING (ledger) LEFT JOIN ld a ON a.master = one.master AND a.bucket = least(n, 4) LEFT JOIN ld b ON b.master = one.master AND b.bucket = 1
        JOIN hc ON hc.hour = one.t_ms // 3600000 JOIN pk ON pk.master = one.master AND hod = (one.t_ms // 3600000) % 24),
    c AS (SELECT ledger, master, CASE WHEN run >= 3 THEN 'offline-window' WHEN run = 2 THEN 'short-series' ELSE 'isolated-miss' END AS tag, 'cause' AS kind, CASE WHEN run >= 3 THEN 4 ELSE 2 END AS p, 'series' AS layer, CASE WHEN run >= 15 AND run >= 2 THEN 2 WHEN run >= 5 THEN 1 ELSE 0 END AS more FROM f
        UNION ALL SELECT ledger, master, 'vote-late', 'cause', 4, 'timing', 0 FROM f WHERE delay > 20000 UNION ALL SELECT ledger, master, 'quorum-critical', 'consequence', 4, 'quorum', 0 FROM f WHERE known AND NOT closed
        UNION ALL SELECT ledger, master, 'quorum-follow-on', 'exoneration', 4, 'quorum', 0 FROM f WHERE known AND closed UNION ALL SELECT ledger, master, 'load-independent', 'exoneration', 2, 'load', 0 FROM f WHERE bucket <= 1
        UNION ALL SELECT ledger, master, 'load-coupled', 'cause', 3, 'load', 0 FROM f WHERE bucket > 1 AND v >= 3 AND own_rate >= 0.05 AND (coalesce(base_rate, 0) = 0 OR own_rate >= 2 * base_rate)
        UNION ALL SELECT ledger, master, 'node-local-window', 'localization', 2, 'peer', 0 FROM f WHERE m = 1 UNION ALL SELECT ledger, master, 'network-window-localization', 'localization', 3, 'peer', 0 FROM f WHERE m >= 3
        UNION ALL SELECT ledger, master, 'hash-divergence', 'cause', 4, 'lineage', 0 FROM f WHERE type = 'wrong-hash' UNION ALL SELECT ledger, master, 'signed-accepted-lineage', 'exoneration', 4, 'lineage', 0 FROM f WHERE type = 'partial'
        UNION ALL SELECT ledger, master, 'attack-window', 'cause', CASE WHEN hour % 2 = 0 THEN 3 ELSE 1 END, 'attack', 0 FROM f WHERE hour_ledgers >= 60 AND signature >= 3
        UNION ALL SELECT ledger, master, 'attack-window-clear', 'exoneration', CASE WHEN hour_ledgers >= 60 AND signature < 3 THEN 3 ELSE 2 END, 'attack', 0 FROM f WHERE NOT (hour_ledgers >= 60 AND signature >= 3) AND hour % 3 = 0
        UNION ALL SELECT ledger, master, 'recurrent-hour', 'cause', 2, 'hour', CASE WHEN peak >= 20 THEN 1 ELSE 0 END FROM f WHERE peak >= 5),
    w AS (SELECT *, greatest(0, p + more - CASE WHEN kind = 'exoneration' THEN 1 ELSE 0 END) AS weight, CASE kind WHEN 'cause' THEN 1 WHEN 'localization' THEN 2 WHEN 'consequence' THEN 3 ELSE 4 END AS place FROM c),
    k AS (SELECT ledger, master, count(*) AS candidate_total, array_to_string(list(concat(tag, ':', weight) ORDER BY weight DESC, place, tag)[:6], ' ') AS candidates, (list(tag ORDER BY weight DESC, place, tag) FILTER (weight >= 2 AND place <= 2))[1] AS verdict, (list(weight ORDER BY weight DESC, place, tag) FILTER (weight >= 2 AND place <= 2))[1] AS w FROM w GROUP BY 1, 2)"""


@query("votes incident", SQL + " SELECT ledger, master, type, coalesce(verdict, 'unexplained') AS verdict, CASE WHEN w >= 6 THEN 'high' WHEN w >= 4 THEN 'medium' WHEN w >= 2 THEN 'low' ELSE 'none' END AS confidence, candidates, candidate_total FROM one JOIN k USING (ledger, master)")
def cause_layers(spark, sf_dir):
    """Each incident's ranked causes from all nine layers."""
    votes, hour = V.votes(spark, sf_dir), F.expr("t_ms DIV 3600000")
    one = V.incident(spark, sf_dir).groupBy("ledger", "master").agg(F.min("type").alias("type"), F.min("t_ms").alias("t_ms"))
    runs = T.in_runs(one.select("ledger", "master"), D.failure_runs(one).select("master", "from_ledger", "to_ledger", "ledgers"), "master", "ledger", 64).select("ledger", "master", F.col("ledgers").alias("run"))
    load, scope = votes.groupBy("ledger").agg(F.count("*").alias("tx_count")), one.groupBy("ledger").agg(F.count("*").alias("m"))
    curve = votes.join(load, "ledger").groupBy("master", F.least("tx_count", F.lit(4)).alias("load_bucket")).agg(F.count("*").alias("v"), (F.count_if(F.col("type") != "ok") / F.count("*")).alias("own_rate"))
    base = curve.where("load_bucket = 1").select("master", F.col("own_rate").alias("base_rate"))
    hours = votes.groupBy(hour.alias("hour")).agg((F.countDistinct("ledger") * 12).alias("hour_ledgers"), F.count_if(F.col("type") == "missed").alias("signature_ledgers"))
    peaks = one.groupBy("master", (hour % 24).alias("hod")).agg(F.count("*").alias("peak_incidents"))
    f = one.join(runs, ["ledger", "master"]).join(load, "ledger").join(scope, "ledger").withColumn("hour", hour).withColumn("hod", F.col("hour") % 24).withColumn("load_bucket", F.least("tx_count", F.lit(4)))
    f = f.join(curve, ["master", "load_bucket"], "left").join(base, "master", "left").join(hours, "hour").join(peaks, ["master", "hod"])
    series = F.when(F.col("run") >= 3, "offline-window").when(F.col("run") == 2, "short-series").otherwise("isolated-miss")
    no = lambda kind: F.lit(None).cast(kind)
    facts = f.select(
        "ledger", "master", "type", F.when(F.col("m") == 1, "solo").when(F.col("m") >= 3, "network").otherwise("cohort").alias("scope"),
        F.array(F.struct(series.alias("tag"), F.when(F.col("run") >= 3, "measured").otherwise("correlated").alias("strength"), no("boolean").alias("reliable"), F.col("run").alias("size"))).alias("hypotheses"),
        (F.col("ledger") % 2 == 0).alias("known_quorum"), (F.col("ledger") % 5 != 0).alias("closed"), no("boolean").alias("capture_gap"), (F.col("ledger") % 5 == 0).alias("critical"), no("double").alias("band_rate"), no("double").alias("overall_rate"), no("boolean").alias("band_reliable"),
        F.expr("t_ms % 600000 DIV 10").alias("vote_delay_ms"), "tx_count", "load_bucket", F.lit(1).alias("base_bucket"), "own_rate", "base_rate", (F.col("v") < 3).alias("load_thin"), no("boolean").alias("resilient"), no("double").alias("co_share"), no("string").alias("peer_verdict"),
        F.expr("case type when 'wrong-hash' then 'own' when 'partial' then 'accepted' end").alias("lineage"), "hour_ledgers", "signature_ledgers", no("boolean").alias("trace_attack"), no("boolean").alias("history_attack"), (F.col("hour") % 3 == 0).alias("quiet"),
        F.when(F.col("hour") % 2 == 0, "attack-linked").alias("control"), "peak_incidents",
    )
    r = L.ranked(facts)
    return r.select("ledger", "master", "type", "verdict", "confidence", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["tag"], c["weight"].cast("string"))), " ").alias("candidates"), "candidate_total")
