"""Queries of the composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, reports as P, trace as T
from ..operators.entry_rules import CATALOG, catalog
from ..sources import views as V
from ..streaming.tracker import classified
from .registry import query
from .trace import SCOPE, _cells


@query("votes", """WITH m AS (SELECT DISTINCT master FROM votes), l AS (SELECT DISTINCT ledger FROM votes), th AS (SELECT DISTINCT ledger, master FROM votes WHERE master IN (SELECT master FROM m)), n AS (SELECT ledger, count(*) AS n FROM th GROUP BY 1)
    SELECT l.ledger, m.master, CASE WHEN coalesce(n, 0) >= 1 THEN 'missed' ELSE 'vote-not-observed' END AS type FROM l CROSS JOIN m LEFT JOIN n USING (ledger) WHERE NOT EXISTS (SELECT 1 FROM th WHERE th.ledger = l.ledger AND th.master = m.master)""")
def absent_votes(spark, sf_dir):
    v = V.votes(spark, sf_dir)
    return P.absent_members(v, v.select("master"), 1)


@query("votes", "WITH c AS (SELECT ledger, count(*) AS n FROM votes GROUP BY 1) SELECT CASE WHEN n - 2 <= 0 THEN 0 WHEN n - 2 <= 1 THEN 1 WHEN n - 2 <= 2 THEN 2 WHEN n - 2 <= 3 THEN 3 WHEN n - 2 <= 5 THEN 4 WHEN n - 2 <= 8 THEN 5 ELSE 6 END::bigint AS band, count(*) AS ledgers FROM c GROUP BY 1")
def margin_bands(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy(T.band(F.col("n") - 2, T.MARGIN_BANDS).alias("band")).agg(F.count("*").alias("ledgers"))


@query("txn flag", """WITH b AS (SELECT DISTINCT address, other FROM (SELECT account AS address, destination AS other FROM txn UNION ALL SELECT destination, account FROM txn) WHERE address <> other),
    m AS (SELECT b.address, count(*) FILTER (f.r = 3) AS a, count(*) FILTER (f.r = 2) AS s FROM b LEFT JOIN flag f ON f.address = other GROUP BY 1)
    SELECT m.address, greatest(0, 100 - 15 * a - 5 * s - CASE WHEN f.r IS NOT NULL THEN 10 ELSE 0 END)::bigint AS score, greatest(0, 100 - 15 * a - 5 * s - CASE WHEN f.r IS NOT NULL THEN 10 ELSE 0 END) >= 85 AND f.r IS NULL AND a + s = 0 AS eligible FROM m LEFT JOIN flag f ON f.address = m.address""")
def account_eligibility(spark, sf_dir):
    return P.eligibility(V.txn(spark, sf_dir), G.severity_by_address(V.finding(spark, sf_dir))).select("address", "score", "eligible")


@query("votes incident", SCOPE + """, o AS (SELECT master, count(*) AS n, count(*) FILTER (type <> 'ok') AS f FROM votes GROUP BY 1), sp AS (SELECT master, count(*) FILTER (masters = 1) AS solo, count(*) FILTER (masters BETWEEN 2 AND 4) AS cohort, count(*) FILTER (masters >= 5) AS network FROM one JOIN sc USING (ledger) GROUP BY 1),
    i AS (SELECT master, ledger - row_number() OVER (PARTITION BY master ORDER BY ledger) AS g FROM one), r AS (SELECT master, max(k) AS longest_run, count(*) AS runs FROM (SELECT master, g, count(*) AS k FROM i GROUP BY 1, 2) GROUP BY 1)
    SELECT o.master, n, f, round(f / n, 6) AS rate, coalesce(solo, 0) AS solo, coalesce(cohort, 0) AS cohort, coalesce(network, 0) AS network, coalesce(longest_run, 0) AS longest_run, coalesce(runs, 0) AS runs FROM o LEFT JOIN sp USING (master) LEFT JOIN r USING (master)""")
def validator_report(spark, sf_dir):
    return P.validator_report(V.votes(spark, sf_dir)).select("master", "n", "f", "rate", "solo", "cohort", "network", "longest_run", "runs")


@query("votes incident", SCOPE + """ SELECT (SELECT count(*) FROM votes) AS votes, (SELECT count(DISTINCT master) FROM votes) AS masters, (SELECT count(DISTINCT ledger) FROM votes) AS ledgers, (SELECT count(*) FROM votes WHERE type = 'missed') AS missed,
    (SELECT count(*) FROM votes WHERE type = 'partial') AS partial, (SELECT count(*) FROM votes WHERE type = 'wrong-hash') AS wrong_hash, count(*) FILTER (masters = 1) AS solo_ledgers, count(*) FILTER (masters BETWEEN 2 AND 4) AS cohort_ledgers, count(*) FILTER (masters >= 5) AS network_ledgers FROM sc""")
def network_report(spark, sf_dir):
    return P.network_report(V.votes(spark, sf_dir))


@query("txn flag", """WITH w AS (SELECT address FROM flag WHERE r = 3) SELECT hash, CASE WHEN account IN (SELECT address FROM w) THEN 'outgoing' WHEN type = 'Payment' AND amount_drops < 500000 THEN 'dust' WHEN type = 'Payment' THEN 'incoming' ELSE 'contact' END AS class
    FROM txn WHERE account IN (SELECT address FROM w) OR destination IN (SELECT address FROM w)""")
def live_classes(spark, sf_dir):
    watched = G.severity_by_address(V.finding(spark, sf_dir)).where("rank = 3")
    return classified(V.txn(spark, sf_dir), watched, 500_000).select("hash", "class")


@query("", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{s}')" for r, s in CATALOG.items()) + ") v(rule_id, severity)")
def rule_catalog(spark, sf_dir):
    return catalog(spark)


@query("edge", """WITH r AS (SELECT account AS cluster, destination AS address, max(coalesce(rb, 1)) AS s FROM edge GROUP BY 1, 2)
    SELECT cluster, count(*) AS members, count(*) FILTER (s = 3) AS malicious, count(*) FILTER (s = 2) AS suspect, string_agg(address, ',' ORDER BY address) AS addresses FROM r GROUP BY 1 HAVING count(*) <= 20""")
def state_view(spark, sf_dir):
    """Clusters as nested views of at most 20 members: the size is checked before the members are gathered."""
    e = G.flag_edges(V.txn(spark, sf_dir), V.finding(spark, sf_dir))
    m = e.groupBy(F.col("account").alias("cluster"), F.col("destination").alias("address")).agg(F.max(F.coalesce("to_rank", F.lit(1))).alias("s"))
    small = m.groupBy("cluster").agg(F.count("*").alias("members"), F.count_if(F.col("s") == 3).alias("malicious"), F.count_if(F.col("s") == 2).alias("suspect")).where("members <= 20")
    return m.join(small, "cluster").groupBy("cluster", "members", "malicious", "suspect").agg(F.array_join(F.sort_array(F.collect_list("address")), ",").alias("addresses"))
