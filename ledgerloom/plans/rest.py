"""Queries of the evidence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E, graph as G, validators as D
from ..sources import views as V
from .registry import query
from .trace import CELL, _cells, _tags


def _edges(spark, sf_dir):
    return G.flag_edges(V.txn(spark, sf_dir), V.finding(spark, sf_dir))


@query("txn", """WITH o AS (SELECT hash, ledger_seq, row_number() OVER (ORDER BY ledger_seq DESC, hash DESC) AS place, count(*) OVER () AS n FROM txn WHERE account = 'S1' OR destination = 'S1') SELECT hash, ledger_seq, place, n > 30 AS truncated FROM o WHERE place <= 30""")
def account_history(spark, sf_dir):
    return E.account_history(V.txn(spark, sf_dir), "S1", 30).select("hash", "ledger_seq", "place", "truncated")


@query("", "SELECT address, name FROM (SELECT concat('C', c_custkey) AS address, trim(substr(regexp_replace(c_name, '[\\x00-\\x1F<>#]', '', 'g'), 1, 40)) AS name FROM customer) WHERE name <> '' ORDER BY address LIMIT 100")
def known_names(spark, sf_dir):
    return E.clean_names(V.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("address"), F.col("c_name").alias("name")), 100)


@query("", """SELECT n_nationkey AS k, n_name AS name, 'registry' AS source FROM nation WHERE n_regionkey < 2 UNION ALL SELECT s_nationkey, min(s_name), 'name' FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) GROUP BY 1""")
def multi_user(spark, sf_dir):
    first = V.table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit("registry").alias("source"))
    second = V.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name")).withColumn("source", F.lit("name"))
    return E.with_fallback(first, second, "k")


@query("", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1')")
def text_search(spark, sf_dir):
    return E.search(V.table(spark, sf_dir, "part"), ["p_name", "p_brand"], "Brand#1").select("p_partkey", "p_name")


@query("edge", "SELECT hash, r = 3 OR coalesce(ra, 0) = 3 OR coalesce(rb, 0) = 3 AS fraud FROM edge")
def edge_fraud(spark, sf_dir):
    return E.fraud_edges(_edges(spark, sf_dir)).select("hash", "fraud")


@query("txn", "SELECT count(*) AS edges, count(*) FILTER (t IS NULL) AS untimed, cast(sum(amount_drops) AS bigint) AS drops FROM (SELECT amount_drops, CASE WHEN tag = 7 THEN NULL ELSE ledger_seq END AS t FROM txn) WHERE t IS NULL OR t >= 2000")
def range_filter(spark, sf_dir):
    t = V.txn(spark, sf_dir).withColumn("t", F.when(F.col("tag") != 7, F.col("ledger_seq")))
    return E.in_range(t, "t", 2000).agg(F.count("*").alias("edges"), F.count_if(F.col("t").isNull()).alias("untimed"), F.sum("amount_drops").alias("drops"))


@query("flag", "SELECT count(*) AS addresses, count(*) FILTER (r = 3) AS malicious, count(*) FILTER (r = 2) AS suspect, count(*) FILTER (r = 1) AS info FROM flag")
def public_stats(spark, sf_dir):
    r = F.col("rank")
    return G.severity_by_address(V.finding(spark, sf_dir)).agg(F.count("*").alias("addresses"), F.count_if(r == 3).alias("malicious"), F.count_if(r == 2).alias("suspect"), F.count_if(r == 1).alias("info"))


STATS = """WITH c AS (SELECT event_type AS network, t_ms // 3600000 AS ledger, count(*) AS tx, max(t_ms) AS close_ms, count(DISTINCT user_id % 3) AS hashes, count(*) >= 2 AS closed FROM ev GROUP BY 1, 2),
    s AS (SELECT *, median(tx) OVER w AS median_tx, close_ms - lag(close_ms) OVER (PARTITION BY network ORDER BY ledger) AS gap_ms FROM c WINDOW w AS (PARTITION BY network ORDER BY ledger ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


@query("ev", STATS + """ SELECT network, ledger, concat_ws(',', CASE WHEN NOT closed THEN 'no-quorum' END, CASE WHEN hashes >= 2 THEN 'hash-split' END, CASE WHEN tx >= 5 AND tx >= 4 * median_tx THEN 'load-extreme' WHEN tx >= 5 AND tx >= 2 * median_tx THEN 'load-spike' END,
    CASE WHEN gap_ms >= 15000 AND gap_ms >= 2 * 3600000 THEN 'close-gap' END) AS tags FROM s""")
def ledger_tags(spark, sf_dir):
    from pyspark.sql.window import Window

    c = V.events(spark, sf_dir).groupBy(F.col("event_type").alias("network"), F.expr("t_ms DIV 3600000").alias("ledger")).agg(F.count("*").alias("tx"), F.max("t_ms").alias("close_ms"), F.countDistinct(F.col("user_id") % 3).alias("hashes"), (F.count("*") >= 2).alias("closed"))
    w = Window.partitionBy("network").orderBy("ledger")
    s = c.withColumn("median_tx", F.percentile(F.col("tx"), 0.5).over(w.rowsBetween(-59, 0))).withColumn("gap_ms", F.col("close_ms") - F.lag("close_ms").over(w)).withColumn("median_gap", F.lit(3_600_000))
    return E.ledger_tags(s, spike_tx=5, spike=2.0, extreme=4.0, gap=2.0).select("network", "ledger", F.concat_ws(",", "tags").alias("tags"))


@query("votes", """WITH l AS (SELECT ledger, 6::bigint AS members, count(DISTINCT master) AS present, count(*) >= 2 AS closed FROM votes GROUP BY 1)
    SELECT ledger, members, present, 5::bigint AS needed, CASE WHEN closed THEN 1::bigint END AS absent_most, CASE WHEN closed THEN greatest(0, members - present - 1)::bigint END AS artifact_least FROM l""")
def closure_bounds(spark, sf_dir):
    return E.closure(V.votes(spark, sf_dir).groupBy("ledger").agg(F.lit(6).cast("bigint").alias("members"), F.countDistinct("master").alias("present"), (F.count("*") >= 2).alias("closed")))


@query("incident", "SELECT DISTINCT ledger FROM incident WHERE ledger NOT IN (SELECT ledger FROM votes WHERE type = 'ok')")
def unproven_claims(spark, sf_dir):
    return E.unproven(V.incident(spark, sf_dir), V.votes(spark, sf_dir).where("type = 'ok'"))


@query("ev", """WITH a AS (SELECT t_ms // 600000 AS ledger, upper(sha256(event_type)) AS hash FROM ev WHERE user_id % 2 = 0), b AS (SELECT t_ms // 600000 AS ledger, upper(sha256(event_type)) AS hash FROM ev WHERE user_id % 2 = 1)
    SELECT DISTINCT a.ledger, a.hash FROM a JOIN b ON a.ledger = b.ledger AND a.hash = b.hash""")
def closure_backfill(spark, sf_dir):
    e = V.events(spark, sf_dir).select(F.expr("t_ms DIV 600000").alias("ledger"), F.sha2("event_type", 256).alias("hash"), "user_id")
    return E.agreed(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"))


@query("incident", "WITH b AS (SELECT ledger, count(*) AS incidents, count(DISTINCT master) AS masters FROM incident GROUP BY 1), s AS (SELECT ledger, count(*) AS tx FROM votes GROUP BY 1 HAVING count(*) >= 2) SELECT coalesce(b.ledger, s.ledger) AS ledger, incidents, masters, tx FROM b FULL JOIN s ON b.ledger = s.ledger")
def ledger_index(spark, sf_dir):
    return E.ledger_index(V.incident(spark, sf_dir), V.votes(spark, sf_dir).groupBy("ledger").agg(F.count("*").alias("tx")).where("tx >= 2"))


@query("incident", """WITH b AS (SELECT ledger, count(DISTINCT master) AS m, count(*) FILTER (type = 'missed') AS a, count(*) FILTER (type = 'partial') AS p, count(*) FILTER (type = 'wrong-hash') AS w FROM incident GROUP BY 1)
    SELECT i.ledger, master, t_ms, type, CASE WHEN m >= 5 THEN 'network' WHEN m > 1 THEN 'cohort' ELSE 'solo' END AS scope, a - (type = 'missed')::int AS peers_missed, p - (type = 'partial')::int AS peers_partial, w - (type = 'wrong-hash')::int AS peers_wrong_hash FROM incident i JOIN b USING (ledger)""")
def retrace(spark, sf_dir):
    return E.retrace(V.incident(spark, sf_dir))


@query("votes incident", CELL + """, s AS (SELECT ledger, count(DISTINCT master) AS m FROM incident GROUP BY 1), o AS (SELECT DISTINCT ledger FROM votes WHERE type = 'ok'),
    i AS (SELECT DISTINCT i.ledger, master, type, CASE WHEN s.m >= 5 THEN 'network' WHEN s.m > 1 THEN 'cohort' ELSE 'solo' END AS scope, o.ledger IS NOT NULL AS closed FROM incident i JOIN s USING (ledger) LEFT JOIN o USING (ledger)),
    h AS (SELECT DISTINCT ledger, master, tag FROM incident JOIN tags USING (ledger))
    SELECT ledger, master, type, 'network-stall' AS "check" FROM i WHERE scope = 'network' AND NOT closed UNION SELECT ledger, master, type, 'capture-window' FROM i WHERE scope = 'network' AND closed
    UNION SELECT ledger, master, type, 'cohort-network' FROM i WHERE scope = 'cohort' UNION SELECT ledger, master, type, unnest(['solo-peering', 'solo-resources']) FROM i WHERE scope = 'solo'
    UNION SELECT ledger, master, type, 'version-state' FROM i WHERE type = 'wrong-hash' UNION SELECT ledger, master, type, 'load-backlog' FROM i JOIN h USING (ledger, master) WHERE tag IN ('load-spike', 'load-extreme')
    UNION SELECT ledger, master, type, 'unknown-cause' FROM i WHERE (ledger, master) NOT IN (SELECT (ledger, master) FROM h WHERE tag = 'load-extreme')""")
def guidance(spark, sf_dir):
    v, i = V.votes(spark, sf_dir), V.incident(spark, sf_dir)
    ok = v.where("type = 'ok'").select("ledger").distinct().withColumn("closed", F.lit(True))
    scoped = E.retrace(i).join(ok, "ledger", "left").na.fill(False, ["closed"])
    found = i.select("ledger", "master").distinct().join(_tags(spark, sf_dir), "ledger").select("ledger", "master", "tag", F.when(F.col("tag") == "load-extreme", "measured").otherwise("context").alias("strength"), F.lit(False).alias("continuous"))
    return E.guidance(scoped, found)


@query("votes", CELL + """, tot AS (SELECT count(*) AS n, count(*) FILTER (failed) AS f FROM cell), gg AS (SELECT tag, count(*) AS w, count(*) FILTER (failed) AS fw FROM tags JOIN cell USING (ledger) GROUP BY 1),
    rk AS (SELECT tag, round(CASE WHEN f - fw > 0 THEN (fw / w) / ((f - fw) / (n - w)) END, 6) AS lift FROM gg, tot), q AS (SELECT unnest(['quiet', 'repeat:x', 'load-spike:p', 'none']) AS tag)
    SELECT q.tag, coalesce(a.lift, b.lift) AS lift FROM q LEFT JOIN rk a ON a.tag = q.tag LEFT JOIN rk b ON b.tag = split_part(q.tag, ':', 1)""")
def lift_lookup(spark, sf_dir):
    asked = spark.createDataFrame([("quiet",), ("repeat:x",), ("load-spike:p",), ("none",)], "tag string")
    return E.lift_for(asked, D.risk_profile(_cells(spark, sf_dir).select("ledger", "failed"), _tags(spark, sf_dir)))


@query("incident", "SELECT ledger, count(DISTINCT master) AS masters, count(*) FILTER (type = 'missed') AS missed, min(t_ms) AS t_ms FROM incident GROUP BY 1 HAVING count(DISTINCT master) >= 3 ORDER BY masters DESC, ledger LIMIT 12")
def attack_signals(spark, sf_dir):
    return E.attack_signals(V.incident(spark, sf_dir), 3)


@query("votes", """WITH d AS (SELECT master, t_ms // 86400000 AS day, count(*) AS n FROM votes GROUP BY 1, 2), h AS (SELECT master, t_ms // 86400000 AS day, count(*) AS h FROM votes WHERE (t_ms // 3600000) % 24 < 12 GROUP BY 1, 2)
    SELECT d.master, d.day, n, coalesce(h, 0) AS hours, n - coalesce(h, 0) AS residual FROM d LEFT JOIN h USING (master, day)""")
def day_residual(spark, sf_dir):
    v = V.votes(spark, sf_dir).withColumn("day", F.expr("t_ms DIV 86400000")).withColumn("hour", F.expr("t_ms DIV 3600000"))
    return E.day_residual(v.groupBy("master", "day").agg(F.count("*").alias("n")), v.where("hour % 24 < 12").groupBy("master", "day", "hour").agg(F.count("*").alias("n")))


@query("votes", "WITH s AS (SELECT master, (max(t_ms) - min(t_ms)) // 3600000 AS hours FROM votes GROUP BY 1) SELECT master, hours, CASE WHEN hours <= 1 THEN 1 WHEN hours <= 24 THEN 24 WHEN hours <= 700 THEN 700 END::bigint AS \"window\" FROM s")
def reference_window(spark, sf_dir):
    return E.covering_window(V.votes(spark, sf_dir).groupBy("master").agg(F.expr("(max(t_ms) - min(t_ms)) DIV 3600000").alias("hours")), [1, 24, 700])


@query("ev", """WITH t AS (SELECT event_type AS type, t_ms // 3600000 AS hour FROM ev), f AS (SELECT type, min(hour) AS first FROM t GROUP BY 1), g AS (SELECT type, hour FROM (SELECT DISTINCT hour FROM t), f WHERE hour >= first),
    n AS (SELECT type, hour, count(*) AS n FROM t GROUP BY 1, 2) SELECT g.type, g.hour, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (type, hour)""")
def type_baseline(spark, sf_dir):
    return E.dense_types(V.events(spark, sf_dir).select(F.col("event_type").alias("type"), F.expr("t_ms DIV 3600000").alias("hour")), "hour")


@query("txn", """WITH a AS (SELECT account AS cluster, min(ledger_seq) AS archived_at, max(ledger_seq) AS last_seen, count(*) > 40 AS linked FROM txn GROUP BY 1)
    SELECT * FROM a WHERE 2500 - greatest(archived_at, last_seen) <= CASE WHEN linked THEN 600 ELSE 520 END""")
def archive_retention(spark, sf_dir):
    a = V.txn(spark, sf_dir).groupBy(F.col("account").alias("cluster")).agg(F.min("ledger_seq").alias("archived_at"), F.max("ledger_seq").alias("last_seen"), (F.count("*") > 40).alias("linked"))
    return E.archive_retention(a, 2500, 520, 600)


@query("txn", "SELECT DISTINCT account AS cluster, ledger_seq // 30 AS day FROM txn WHERE tag <= 2 EXCEPT SELECT account, ledger_seq // 30 FROM txn WHERE tag > 2")
def daily_checkpoint(spark, sf_dir):
    t = V.txn(spark, sf_dir).select(F.col("account").alias("cluster"), F.expr("ledger_seq DIV 30").alias("day"), "tag")
    return E.once_a_day(t.where("tag <= 2").select("cluster", "day").distinct(), t.where("tag > 2").select("cluster", "day").distinct())


@query("txn", """WITH l AS (SELECT account, destination AS signature, arg_max(tag, (ledger_seq, hash)) AS hops FROM txn GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY signature) AS place FROM l) SELECT * FROM r WHERE place <= 3""")
def chain_cap(spark, sf_dir):
    c = V.txn(spark, sf_dir).select("account", F.col("destination").alias("signature"), F.col("tag").alias("hops"), F.struct("ledger_seq", "hash").alias("seq"))
    return E.capped_chains(c, "account", 3)


@query("edge", """SELECT 'account' AS field, count(*) AS rows, count(*) FILTER (NOT regexp_matches(account, '^[CS][0-9]+$')) AS broken FROM edge UNION ALL SELECT 'amount', count(*), count(*) FILTER (NOT amount_drops > 200000) FROM edge""")
def contract_check(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return E.contract({"account": (e, F.col("account").rlike("^[CS][0-9]+$")), "amount": (e, F.col("amount_drops") > 200_000)})


@query("", "SELECT cast(cast(d AS date) AS varchar) AS day FROM (SELECT unnest(generate_series(DATE '2026-01-01', DATE '2026-03-01', INTERVAL 1 DAY)) AS d)")
def day_list(spark, sf_dir):
    return E.day_list(spark, "2026-03-01", 60)
