"""Queries of the serving projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, serving as S
from ..sources import views as V
from .registry import query

WINDOWS = {"7d": 2493, "30d": 2470, "all": None}
TOP = """w AS (SELECT unnest(['7d', '30d', 'all']) AS "window", unnest([2493, 2470, -1]) AS lo)"""


def _edges(spark, sf_dir):
    return G.flag_edges(V.txn(spark, sf_dir), V.finding(spark, sf_dir))


def _top(column, where=""):
    return f"""WITH {TOP}, g AS (SELECT "window", {column} AS address, cast(sum(amount_drops) AS bigint) AS drops, count(*) AS edges, max(ledger_seq) AS last FROM edge, w WHERE ledger_seq >= lo {where} GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY drops DESC, edges DESC, address) AS place FROM g) SELECT * FROM r WHERE place <= 10"""


@query("edge", _top("destination"))
def top10_inflow(spark, sf_dir):
    return S.top_flows(_edges(spark, sf_dir), "destination", WINDOWS)


@query("edge", _top("account", "AND ra >= 2"))
def top10_outflow(spark, sf_dir):
    return S.top_flows(_edges(spark, sf_dir).where("from_rank >= 2"), "account", WINDOWS)


@query("edge reg", """SELECT a.country AS from_country, b.country AS to_country, count(*) AS edges, cast(sum(amount_drops) AS bigint) AS drops, count(*) FILTER (r = 3) AS malicious, count(*) FILTER (r = 2) AS suspect, count(*) FILTER (r = 1) AS info, count(*) FILTER (b.tier = 'cold') AS custody
    FROM edge JOIN reg a ON a.address = account JOIN reg b ON b.address = destination WHERE a.country <> b.country GROUP BY 1, 2""")
def country_flows(spark, sf_dir):
    return S.country_flows(_edges(spark, sf_dir), V.geo(spark, sf_dir))


BLOCKS = """WITH bl AS (SELECT ledger_seq, count(*) AS tx_count, max(r) AS rank FROM (SELECT ledger_seq, hash, 1 AS r FROM txn UNION ALL SELECT ledger_seq, hash, r FROM edge) GROUP BY 1)"""


@query("edge", """WITH bl AS (SELECT ledger_seq, count(*) AS tx_count, max(r) AS rank FROM edge GROUP BY 1)
    SELECT ledger_seq // 24 AS hour, count(*) AS blocks, cast(sum(tx_count) AS bigint) AS tx_count, count(*) FILTER (rank > 1) AS flagged, max(rank)::bigint AS rank FROM bl GROUP BY 1""")
def hour_rollup(spark, sf_dir):
    blocks = _edges(spark, sf_dir).groupBy("ledger_seq").agg(F.count("*").alias("tx_count"), F.max("rank").alias("rank"))
    return S.hour_rollup(blocks, F.expr("ledger_seq DIV 24"))


@query("edge", """WITH k AS (SELECT ledger_seq, type, count(*) AS k, count(*) FILTER (r = 3) AS m, count(*) FILTER (r = 2) AS s FROM edge GROUP BY 1, 2)
    SELECT ledger_seq, cast(sum(k) AS bigint) AS edges, cast(sum(m) AS bigint) AS malicious, cast(sum(s) AS bigint) AS suspect, arg_max(type, (k, type)) AS top_type FROM k GROUP BY 1 ORDER BY 1 DESC LIMIT 240""")
def monitor_samples(spark, sf_dir):
    return S.monitor_samples(_edges(spark, sf_dir))


@query("txn flag", """WITH b AS (SELECT DISTINCT address, other FROM (SELECT account AS address, destination AS other FROM txn UNION ALL SELECT destination, account FROM txn) WHERE address <> other),
    m AS (SELECT b.address, count(*) AS contacts, count(*) FILTER (f.r = 3) AS malicious, count(*) FILTER (f.r = 2) AS suspect FROM b LEFT JOIN flag f ON f.address = other GROUP BY 1)
    SELECT m.*, greatest(0, 100 - 15 * malicious - 5 * suspect - CASE WHEN f.r IS NOT NULL THEN 10 ELSE 0 END)::bigint AS score, CASE WHEN f.r IS NOT NULL THEN 'bad' WHEN malicious + suspect > 0 THEN 'contact' ELSE 'clean' END AS verdict FROM m LEFT JOIN flag f ON f.address = m.address""")
def account_scores(spark, sf_dir):
    return S.account_scores(V.txn(spark, sf_dir), G.severity_by_address(V.finding(spark, sf_dir)))


@query("edge", """WITH l AS (SELECT destination AS address, 2 AS risk, 'inflow' AS reason, min(ledger_seq) AS first_seen, 0 AS layer, 'history' AS source FROM edge WHERE r = 3 GROUP BY 1
      UNION ALL SELECT account, 3, 'outflow', min(ledger_seq), 1, 'state' FROM edge WHERE ra = 3 GROUP BY 1),
    u AS (SELECT * FROM l WHERE address NOT IN (SELECT concat('S', s_suppkey) FROM supplier WHERE s_acctbal > 9000))
    SELECT address, max(risk)::bigint AS risk, arg_max(reason, (risk, -layer)) AS reason, min(first_seen) AS first_seen, string_agg(source, ',' ORDER BY layer) AS sources FROM u GROUP BY 1""")
def threat_knowledge(spark, sf_dir):
    e = _edges(spark, sf_dir)
    layer = lambda d, c, risk, reason: d.groupBy(F.col(c).alias("address")).agg(F.min("ledger_seq").alias("first_seen")).select("address", F.lit(risk).cast("bigint").alias("risk"), F.lit(reason).alias("reason"), "first_seen")
    registry = V.table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.concat(F.lit("S"), "s_suppkey").alias("address"))
    return S.knowledge([("history", layer(e.where("rank = 3"), "destination", 2, "inflow")), ("state", layer(e.where("from_rank = 3"), "account", 3, "outflow"))], registry)


@query("edge", "SELECT account, round(greatest(8, 1 + 2 * ln(1 + sum(amount_drops) / 1e6)), 6) AS size FROM edge GROUP BY 1")
def node_size(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("account").agg(F.sum("amount_drops").alias("d")).select("account", F.round(S.node_size(F.col("d")), 6).alias("size"))


@query("edge", """WITH p AS (SELECT account, destination, count(*) AS n FROM edge WHERE ra = 3 GROUP BY 1, 2)
    SELECT 'node' AS kind, a, NULL AS b, 1::bigint AS n FROM (SELECT account AS a FROM p UNION SELECT destination FROM p) UNION ALL SELECT 'link', account, destination, n FROM p""")
def threat_graph(spark, sf_dir):
    return S.threat_graph(_edges(spark, sf_dir))
