"""Queries of live classification over payments: every fifth supplier is watched, some customers are the operator's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.iterate import kept
from ..sources import views as V
from ..streaming import live as L
from .registry import query

KINDS = ["Payment", "TrustSet", "OfferCreate", "OfferCancel", "NFTokenMint", "AccountSet", "EscrowCreate"]


def _events(spark, sf_dir):
    t = V.txn(spark, sf_dir)
    kind = F.element_at(F.lit(KINDS), F.col("tag").cast("int"))
    third = F.concat(F.lit("S"), F.col("pair") % 40 + 1)
    return t.select(
        F.when(F.col("quantity") != 50, F.col("hash")).alias("hash"), (F.col("quantity") != 13).alias("validated"), "account", F.when(F.col("tag").isin(1, 7), F.col("destination")).alias("destination"), kind.alias("type"),
        F.when(F.col("tag") == 2, third).alias("limit_issuer"), F.when(F.col("tag") == 5, third).alias("issuer"), F.when(F.col("tag").isin(3, 4), F.array(F.lit("X"), third, F.lit("S5"))).alias("touched"),
        F.lit(None).cast("bigint").alias("dest_tag"), (F.col("ledger_seq") * 86_400_000).alias("t_ms"),
    )


def _sides(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0")
    own = V.table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("address"))
    return s.select(F.concat(F.lit("S"), "s_suppkey").alias("address"), F.col("s_name").alias("label")), own


SQL = f"""WITH q AS (SELECT CASE WHEN quantity <> 50 THEN hash END AS hash, quantity <> 13 AS validated, account, CASE WHEN tag IN (1, 7) THEN destination END AS destination, {KINDS}[tag] AS type, concat('S', pair % 40 + 1) AS third, tag, ledger_seq * 86400000 AS t_ms FROM txn),
    w AS (SELECT concat('S', s_suppkey) AS address, s_name AS label FROM supplier WHERE s_suppkey % 5 = 0), o AS (SELECT concat('C', c_custkey) AS address FROM customer WHERE c_custkey % 7 = 0),
    j AS (SELECT q.*, a.label AS la, d.label AS ld, i.label AS li, CASE WHEN tag IN (3, 4) THEN coalesce(i.label, five.label) END AS lt, o.address IS NOT NULL AS own
        FROM q LEFT JOIN w a ON a.address = account LEFT JOIN w d ON d.address = destination LEFT JOIN w i ON i.address = third LEFT JOIN w five ON five.address = 'S5' LEFT JOIN o ON o.address = destination),
    b AS (SELECT *, CASE WHEN NOT validated THEN 'unvalidated' WHEN hash IS NULL THEN 'unnamed' WHEN la IS NOT NULL AND ld IS NOT NULL THEN 'internal' WHEN la IS NOT NULL AND own THEN 'operations' WHEN la IS NOT NULL AND tag IN (3, 4) THEN 'own-order' WHEN la IS NOT NULL THEN 'compromised'
        WHEN ld IS NOT NULL THEN 'touch' WHEN tag = 2 AND li IS NOT NULL THEN 'trust' WHEN tag = 5 AND li IS NOT NULL THEN 'mint' WHEN lt IS NOT NULL THEN 'orderbook' ELSE 'unrelated' END AS branch FROM j),
    c AS (SELECT *, branch IN ('touch', 'trust', 'mint', 'orderbook', 'own-order', 'compromised') AS threat, branch = 'compromised' OR (branch NOT IN ('own-order') AND type IN ('Payment', 'TrustSet')) AS grave FROM b),
    r AS (SELECT hash, branch, CASE WHEN threat THEN account END AS address, CASE WHEN threat THEN CASE WHEN grave THEN 'malicious' ELSE 'suspect' END END AS risk, CASE WHEN threat THEN concat(branch, ' ', type) END AS reason,
        CASE WHEN threat THEN CASE WHEN la IS NOT NULL THEN la WHEN ld IS NOT NULL THEN ld WHEN tag IN (2, 5) THEN li ELSE lt END END AS honeypot, t_ms FROM c)"""


@query("txn", SQL + " SELECT branch, risk, reason, honeypot, count(*) AS events, count(DISTINCT address) AS addresses FROM r GROUP BY ALL")
def live_branches(spark, sf_dir):
    """How many events each branch takes, by reason and watched account."""
    r = L.branched(_events(spark, sf_dir), *_sides(spark, sf_dir))
    return r.groupBy("branch", "risk", "reason", "honeypot").agg(F.count("*").alias("events"), F.countDistinct("address").alias("addresses"))


@query("txn", SQL + """, k AS (SELECT * FROM r WHERE address IS NOT NULL QUALIFY row_number() OVER (PARTITION BY address, hash ORDER BY t_ms, reason, honeypot) = 1),
    x AS (SELECT address, bool_or(risk = 'malicious') FILTER (t_ms < 103680000000) AS early_bad, arg_min(reason, (t_ms, hash, reason, honeypot)) FILTER (t_ms < 103680000000 AND risk = 'malicious') AS er, arg_min(reason, (t_ms, hash, reason, honeypot)) FILTER (risk = 'malicious') AS ar, arg_min(reason, (t_ms, hash, reason, honeypot)) AS fr,
        arg_min(honeypot, (t_ms, hash, reason, honeypot)) FILTER (t_ms < 103680000000 AND risk = 'malicious') AS eh, arg_min(honeypot, (t_ms, hash, reason, honeypot)) FILTER (risk = 'malicious') AS ah, arg_min(honeypot, (t_ms, hash, reason, honeypot)) AS fh, min(t_ms) AS first_seen_ms, count(*) AS events FROM k GROUP BY 1)
    SELECT address, CASE WHEN ar IS NOT NULL THEN 'malicious' ELSE 'suspect' END AS risk, coalesce(er, ar, fr) AS reason, coalesce(eh, ah, fh) AS honeypot, first_seen_ms, events FROM x""")
def threat_upserts(spark, sf_dir):
    """Threats after two folds: what came early, then all of it again with what came later."""
    events = kept(L.branched(_events(spark, sf_dir), *_sides(spark, sf_dir)).where("address is not null").select("address", "hash", "type", "t_ms", "honeypot", "dest_tag", "risk", "reason"))
    none = lambda schema: spark.createDataFrame([], schema)
    old, seen = L.folded(none(L.THREAT), none(L.EVIDENCE), events.where("t_ms < 103680000000"))
    old = kept(old)
    changed = kept(L.folded(old, seen, events)[0])
    rest = old.join(changed.select("address"), "address", "left_anti")
    return changed.unionByName(rest)
