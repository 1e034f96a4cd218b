"""Queries of day normalization: events as incidents of trace days, purchases as votes without a quorum."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import day_normalization as N
from ..sources import views as V
from .registry import query

DAY, HOUR = 86_400_000, 3_600_000

SQL = f"""WITH i AS (SELECT t_ms // {DAY} AS day, ledger, master, CASE type WHEN 'wrong-hash' THEN 'no-quorum' ELSE type END AS type, t_ms, ledger % 5 = 0 AS not_closed, CASE ledger % 3 WHEN 0 THEN true WHEN 1 THEN false END AS attributable FROM incident),
    ls AS (SELECT DISTINCT day, ledger, ledger % 7 <> 0 AS closed FROM i),
    r AS (SELECT i.*, not_closed OR NOT closed AS denied, type = 'missed' AND NOT coalesce(attributable, false) AS gone FROM i JOIN ls USING (day, ledger)),
    n AS (SELECT *, CASE WHEN gone OR (type = 'no-quorum' AND NOT denied) THEN CASE WHEN denied THEN 'no-quorum' ELSE 'vote-not-observed' END ELSE type END AS new, CASE WHEN gone OR (type = 'no-quorum' AND NOT denied) THEN type END AS told,
        CASE WHEN gone THEN CASE WHEN attributable IS NULL THEN 'not-recorded' ELSE 'not-attributable' END END AS mark, CASE WHEN (gone OR type = 'no-quorum') AND NOT denied THEN 'validated-ledger-stream' END AS basis FROM r),
    c AS (SELECT day, master, count(*) FILTER (type = 'partial') AS partial, greatest(0, count(*) FILTER (type = 'missed') - (ascii(right(master, 1)) % 2)) AS missed, count(*) FILTER (type = 'no-quorum') AS no_quorum FROM i GROUP BY 1, 2),
    m AS (SELECT day, master, count(*) FILTER (gone) AS want FROM n GROUP BY 1, 2)"""


def _tables(spark, sf_dir):
    i = V.incident(spark, sf_dir).select(
        F.expr(f"t_ms DIV {DAY}").alias("day"), "ledger", "master", F.expr("case when type = 'wrong-hash' then 'no-quorum' else type end").alias("type"), "t_ms", (F.col("ledger") % 5 == 0).alias("not_closed"),
        F.expr("case ledger % 3 when 0 then true when 1 then false end").alias("attributable"),
    ).withColumn("reasons", F.array("type"))
    i = i.select("*", *(F.lit(None).cast("string").alias(c) for c in ("told", "mark", "basis", "hash", "verified_by")))
    by = i.groupBy("day", "ledger").agg(F.count("*").alias("top"))
    stats = by.select("day", "ledger", (F.col("ledger") % 7 != 0).alias("closed"), F.when(F.col("ledger") % 7 != 0, F.repeat(F.lit("a"), F.lit(64))).alias("hash"), F.lit(None).cast("boolean").alias("attributable"), "top", F.lit(3).cast("bigint").alias("need"))
    kinds = [F.lit(0).cast("bigint").alias("ok"), F.count_if(F.col("type") == "partial").alias("partial"), F.greatest(F.lit(0), F.count_if(F.col("type") == "missed") - F.ascii(F.right("master", F.lit(1))) % 2).alias("missed"), F.lit(0).cast("bigint").alias("wrong_hash"), F.count_if(F.col("type") == "no-quorum").alias("no_quorum"), F.lit(0).cast("bigint").alias("missed_open")]
    anomaly = i.groupBy("day", F.col("type").alias("tag")).agg(F.countDistinct("ledger").alias("ledgers"), F.count("*").alias("fails"))
    days = i.groupBy("day").agg(F.countDistinct(F.when(F.col("type") == "no-quorum", F.col("ledger"))).alias("quorum_fail"))
    proofs = spark.createDataFrame([], "day bigint, ledger bigint, closed boolean, hash string, source string, verified_by string")
    return {"incidents": i, "stats": stats, "proofs": proofs, "counters": i.groupBy("day", "master").agg(*kinds), "hours": i.groupBy("day", F.expr(f"t_ms DIV {HOUR}").alias("hour"), "master").agg(*kinds), "anomaly": anomaly, "days": days}


@query("incident", SQL + " SELECT day, master, partial, missed - least(want, missed) AS missed, no_quorum + least(want, missed) AS no_quorum, least(want, missed) AS missed_open FROM c JOIN m USING (day, master)")
def day_counters(spark, sf_dir):
    """Counters of each day and master after normalization."""
    return N.normalized(_tables(spark, sf_dir))["counters"].select("day", "master", "partial", "missed", "no_quorum", "missed_open")


@query("incident", SQL + " SELECT new AS type, told, mark, basis, count(*) AS incidents, count(DISTINCT day) AS days FROM n GROUP BY ALL")
def day_renames(spark, sf_dir):
    """How many incidents got which type, from which, and why."""
    return N.normalized(_tables(spark, sf_dir))["incidents"].groupBy("type", "told", "mark", "basis").agg(F.count("*").alias("incidents"), F.countDistinct("day").alias("days"))


@query("incident", SQL + """, q AS (SELECT day, count(DISTINCT ledger) FILTER (type = 'no-quorum') AS counter FROM i GROUP BY 1), s AS (SELECT day, count(*) FILTER (k < 3) AS short FROM (SELECT day, ledger, count(*) AS k FROM i GROUP BY 1, 2) GROUP BY 1),
    d AS (SELECT day, bool_or(denied) AS denied FROM n GROUP BY 1)
    SELECT day, 'no-quorum' AS tag, counter AS ledgers, 'closure-denied-in-same-counter' AS reason FROM q JOIN d USING (day) WHERE denied AND counter > 0
    UNION ALL SELECT day, 'quorum-fail', abs(counter - short), CASE WHEN short > counter THEN 'forensics-rows-exceed-counter' ELSE 'counter-without-forensics-row' END FROM q JOIN s USING (day) WHERE counter <> short""")
def day_gaps(spark, sf_dir):
    """Counters of a day that its rows can't explain."""
    return N.normalized(_tables(spark, sf_dir))["gaps"]
