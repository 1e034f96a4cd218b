"""Queries of the forms of ledgers: six hours of events are a ledger, every tenth event is told twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forensics as X
from ..sources import views as V
from .registry import query

#: The same transactions in SQL, each once.
TX = """WITH t AS (SELECT t_ms // 21600000 AS ledger, event_id, concat('U', user_id) AS account, concat('U', event_id % 7) AS destination,
    CASE event_type WHEN 'error' THEN 'NFTokenMint' WHEN 'signup' THEN 'AccountCreate' WHEN 'purchase' THEN 'OfferCreate' ELSE CASE WHEN event_id % 97 = 0 THEN 'SetFee' ELSE 'Payment' END END AS type,
    cast(round(value * 100) AS bigint) AS fee, CASE WHEN user_id % 11 = 0 THEN event_id % 5 ELSE 0 END AS inn, event_type = 'error' AS bad FROM ev),
    sd AS (SELECT ledger, account, count(*) AS sent, count(DISTINCT destination) AS dests FROM t GROUP BY 1, 2),
    w AS (SELECT ledger, count(*) AS senders, arg_min(account, (-sent, account)) AS busiest, max(sent) AS busiest_tx, max(dests) AS fan_out, arg_min(sent, (-dests, account)) AS fan_tx FROM sd GROUP BY 1),
    f AS (SELECT ledger, count(*) AS n, any_value(senders) AS senders, count(DISTINCT destination) AS receivers, any_value(busiest) AS busiest, any_value(busiest_tx) AS busiest_tx, any_value(fan_out) AS fan_out, any_value(fan_tx) AS fan_tx,
      count(*) FILTER (bad) AS failed, count(*) FILTER (type = 'AccountCreate') AS created, count(*) FILTER (type = 'OfferCreate') AS offers, count(*) FILTER (type = 'NFTokenMint') AS nfts, count(*) FILTER (type = 'SetFee') AS features,
      count(*) FILTER (inn > 0) AS batches, cast(sum(inn) AS bigint) AS inner_tx, coalesce(max(fee) FILTER (fee > 0), 0) AS fee_most, cast(coalesce(median(fee) FILTER (fee > 0), 0) AS double) AS fee_median, count(*) FILTER (event_id % 10 = 0) AS repeated
      FROM t JOIN w USING (ledger) GROUP BY 1)"""


def _tx(spark, sf_dir):
    e, kind, rare = V.events(spark, sf_dir), F.col("event_type"), F.col("event_id") % 97 == 0
    t = e.select(
        F.expr("t_ms DIV 21600000").alias("ledger"), F.concat(F.lit("H"), "event_id").alias("hash"), F.concat(F.lit("U"), "user_id").alias("account"), F.concat(F.lit("U"), F.col("event_id") % 7).alias("destination"),
        F.when(kind == "error", "NFTokenMint").when(kind == "signup", "AccountCreate").when(kind == "purchase", "OfferCreate").when(rare, "SetFee").otherwise("Payment").alias("type"),
        F.round(F.col("value") * 100).cast("bigint").alias("fee"), F.when(F.col("user_id") % 11 == 0, F.col("event_id") % 5).otherwise(0).alias("inner"), (kind == "error").alias("failed"), "event_id",
    )
    return t.unionByName(t.where("event_id % 10 = 0")).drop("event_id")


@query("ev", TX + " SELECT * FROM f")
def ledger_forms(spark, sf_dir):
    return X.forms(_tx(spark, sf_dir)).drop("unhashed").withColumnRenamed("inner", "inner_tx")


LIMITS = {"least_tx": 5, "fan_out": 2, "fan_tx": 2, "burst_tx": 2, "burst_share": 0.1, "failures": 2, "batches": 1, "inner": 3, "fee": 1000, "fee_ratio": 3, "created": 3, "offers": 3, "nfts": 2, "of_type": 3, "ratio": 1.5, "extreme": 3, "width": 64}


@query("ev", TX + """, p AS (SELECT *, row_number() OVER (ORDER BY ledger) - 1 AS place FROM f),
    m AS (SELECT *, median(n) OVER w AS m_n, median(created) OVER w AS m_created, median(offers) OVER w AS m_offers, median(nfts) OVER w AS m_nfts FROM p WINDOW w AS (ORDER BY place ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    tc AS (SELECT ledger, type, count(*) AS k FROM t GROUP BY 1, 2), fi AS (SELECT type, min(place) AS first FROM tc JOIN p USING (ledger) GROUP BY 1),
    g AS (SELECT type, p.ledger, place, coalesce(k, 0) AS k FROM p JOIN fi ON place >= first LEFT JOIN tc USING (type, ledger)), b AS (SELECT *, median(k) OVER (PARTITION BY type ORDER BY place ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS mk FROM g),
    r AS (SELECT ledger, 'drainer-fanout' AS tag, fan_out AS value, NULL AS baseline FROM m WHERE fan_out >= 2 AND fan_tx >= 2 UNION ALL SELECT ledger, 'sender-burst', busiest_tx, NULL FROM m WHERE busiest_tx >= 2 AND n >= 5 AND busiest_tx >= 0.1 * n
    UNION ALL SELECT ledger, 'failure-spike', failed, NULL FROM m WHERE failed >= 2 AND failed >= 0.25 * n UNION ALL SELECT ledger, 'batch-amplify', inner_tx, NULL FROM m WHERE batches >= 1 AND inner_tx >= 3
    UNION ALL SELECT ledger, 'fee-spike', fee_most, fee_median FROM m WHERE fee_most >= 1000 AND fee_median > 0 AND fee_most >= 3 * fee_median UNION ALL SELECT ledger, 'feature-change', features, NULL FROM m WHERE features > 0
    UNION ALL SELECT ledger, 'account-create-burst', created, m_created FROM m WHERE place >= 9 AND created >= 3 AND created >= 1.5 * m_created UNION ALL SELECT ledger, 'offer-flood', offers, m_offers FROM m WHERE place >= 9 AND offers >= 3 AND offers >= 1.5 * m_offers
    UNION ALL SELECT ledger, 'nft-spam', nfts, m_nfts FROM m WHERE place >= 9 AND nfts >= 2 AND nfts >= 1.5 * m_nfts UNION ALL SELECT ledger, CASE WHEN n >= 3 * m_n THEN 'load-extreme' ELSE 'load-spike' END, n, m_n FROM m WHERE place >= 9 AND n >= 5 AND n >= 1.5 * m_n AND m_n > 0
    UNION ALL SELECT ledger, concat('type-burst:', type), k, mk FROM b WHERE place >= 9 AND k >= 3 AND mk > 0 AND k >= 1.5 * mk)
    SELECT ledger, tag, cast(value AS double) AS value, cast(baseline AS double) AS baseline FROM r""")
def form_signatures(spark, sf_dir):
    t = _tx(spark, sf_dir)
    return X.signatures(X.forms(t), X.type_counts(t), **LIMITS)
