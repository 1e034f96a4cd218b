"""How deep the archive of closed accounts has to be read, for windows that begin at each of its quarters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive_window as A
from ..sources import views as V
from .registry import query

BASE = """WITH a AS (SELECT account, max(ledger_seq) AS day, min(ledger_seq) + 2000 AS from_ledger, max(ledger_seq) + 2000 AS to_ledger FROM txn WHERE type = 'Payment' GROUP BY account, pair % 50), st AS (SELECT day, min(from_ledger) AS least, max(to_ledger) AS most, count(*) AS rows FROM a GROUP BY 1)"""


def _archive(spark, sf_dir):
    """An account's payments for a group of parts are one archived row, on the day of the last."""
    paid = V.txn(spark, sf_dir).where("type = 'Payment'").groupBy("account", (F.col("pair") % 50).alias("group"))
    rows = paid.agg(F.max("ledger_seq").alias("day"), (F.min("ledger_seq") + 2000).alias("from_ledger"), (F.max("ledger_seq") + 2000).alias("to_ledger"))
    return A.day_statistics(rows)


@query("txn", BASE + " SELECT * FROM st")
def archive_statistics(spark, sf_dir):
    return _archive(spark, sf_dir)


@query("txn", BASE + """, w AS (SELECT day AS "window", day AS today, least - CASE WHEN day % 2 = 0 THEN 40 ELSE 0 END AS from_ledger, CASE day % 3 WHEN 0 THEN 30 WHEN 1 THEN 90 END::bigint AS range_days FROM st),
    al AS (SELECT *, least(2, coalesce(ceil(range_days / 31), 2))::bigint AS allowed FROM w), hit AS (SELECT "window", min((today - day) // 31) AS hit FROM al JOIN st ON day <= today AND day > today - allowed * 31 AND least <= from_ledger GROUP BY 1),
    j AS (SELECT al.*, hit, coalesce(hit + 1, allowed)::bigint AS blocks FROM al LEFT JOIN hit USING ("window"))
    SELECT "window", today, from_ledger, range_days, blocks, blocks * 31 AS days, hit IS NOT NULL AS covered, hit IS NULL OR coalesce(blocks * 31 < range_days, false) AS truncated, coalesce(blocks * 31 < range_days, false) AS range_truncated FROM j""")
def archive_depth(spark, sf_dir):
    """A window that ends on each archived day."""
    st = _archive(spark, sf_dir)
    day = F.col("day")
    windows = st.select(day.alias("window"), day.alias("today"), (F.col("least") - F.when(day % 2 == 0, 40).otherwise(0)).alias("from_ledger"), F.when(day % 3 == 0, 30).when(day % 3 == 1, 90).cast("bigint").alias("range_days"))
    return A.depth(windows, st)
