"""Coherence of statements about the hours of the events table; those about every so-many-th hour contradict each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coherence as C
from ..sources import views as V
from .registry import query

#: The statements, as SQL expressions that both engines read: l is the hour, k the master's number, n and m the hour's events and masters.
ROW = {
    "hash": "case when l % 4 <> 0 then concat('H', l) end", "closed": "case when l % 4 = 1 then false when l % 4 > 1 then true end", "votes": "m", "needed": "greatest(1, m - 2)", "top": "m - l % 2", "margin": "case when l % 53 = 5 and k % 2 = 0 then 0 else l % 3 end",
    "capture_gap": "case when l % 3 = 0 then l % 2 = 0 end", "gap_basis": "case when l % 59 = 3 then 'guessed' when l % 3 = 0 then 'ledger-index' else 'not-recorded' end", "members": "m", "absent": "n % 4", "genuine_most": "case when l % 61 = 2 then 9 else m - greatest(1, m - 2) end",
    "artifact_least": "greatest(0, n % 4 - (m - greatest(1, m - 2)))", "critical": "l % 67 = 2", "verdict": "case when l % 4 > 1 then 'closed-quorum-observed' when l % 4 = 1 then 'not-closed' end", "affected": "case when l % 5 <> 0 then m + case when l % 71 = 3 then 1 else 0 end end", "named": "m - 1",
}
FACTS = ", ".join(f"{e} AS {k}" for k, e in ROW.items())
BASE = f"""WITH h AS (SELECT t_ms // 3600000 AS l, count(*) AS n, count(DISTINCT master) AS m, min(t_ms) AS t FROM votes GROUP BY 1), f AS (SELECT DISTINCT t_ms // 3600000 AS l, master, substr(master, 2)::bigint AS k FROM votes WHERE type = 'missed'),
    r AS (SELECT l AS ledger, master, {FACTS} FROM f JOIN h USING (l)), o AS (SELECT l // 24 AS day, l AS ledger, t FROM h WHERE n % 7 = 1),
    ev1 AS (SELECT o.day, ledger, (SELECT count(*) FROM o p WHERE p.day = o.day AND p.ledger % 11 <> 4 AND p.t <= o.t) AS opening FROM o)"""
ROWS = """SELECT 'A' AS "check", ledger, master, true AS applies, gap_basis = 'guessed' AS bad FROM r UNION ALL SELECT 'D', ledger, master, closed IS TRUE, genuine_most <> greatest(0, members - needed) FROM r UNION ALL SELECT 'E', ledger, master, closed IS NOT NULL, closed AND critical FROM r
    UNION ALL SELECT 'F', ledger, master, affected IS NOT NULL, affected <> named + 1 FROM r"""


def _rows(spark, sf_dir):
    votes = V.votes(spark, sf_dir).withColumn("l", F.expr("t_ms DIV 3600000"))
    hours = votes.groupBy("l").agg(F.count("*").alias("n"), F.countDistinct("master").alias("m"), F.min("t_ms").alias("t"))
    failed = votes.where("type = 'missed'").select("l", "master", F.expr("cast(substr(master, 2) as bigint)").alias("k")).distinct()
    return votes, hours, failed.join(hours, "l").select(F.col("l").alias("ledger"), "master", *(F.expr(e).alias(k) for k, e in ROW.items()))


@query("votes", BASE + f""", x AS ({ROWS} UNION ALL SELECT 'B', ledger, master, true, ledger % 73 = 1 AND hash IS NOT NULL FROM r
      UNION ALL SELECT 'C', ledger, NULL, count(*) > 1, count(DISTINCT margin) > 1 FROM r GROUP BY ledger UNION ALL SELECT 'G', ledger, master, true, votes % 10 = 9 FROM r
      UNION ALL SELECT 'H', ledger, NULL, day % 6 <> 5, opening = 0 OR row_number() OVER (PARTITION BY day, opening ORDER BY ledger) > 1 FROM ev1
      UNION ALL SELECT 'I', ledger, master, true, votes % 12 = 0 FROM r UNION ALL SELECT 'I', ledger // 24, master, true, count(*) % 9 = 0 FROM r GROUP BY ledger // 24, master
      UNION ALL SELECT 'J', ledger // 24, gap_basis, true, (ledger // 24) % 3 <> 0 AND (count(DISTINCT ledger) > 4 AND gap_basis = 'ledger-index') FROM r GROUP BY ledger // 24, gap_basis
      UNION ALL SELECT 'K', ledger // 24, NULL, true, (ledger // 24) % 8 = 2 FROM r GROUP BY ledger // 24),
    c AS (SELECT unnest(string_split('A B C D E F G H I J K', ' ')) AS "check")
    SELECT "check", count(*) FILTER (applies) AS checked, count(*) FILTER (applies AND bad) AS broken, CASE WHEN count(*) FILTER (applies) = 0 THEN 'not-checkable' WHEN count(*) FILTER (applies AND bad) > 0 THEN 'broken' ELSE 'held' END AS verdict FROM c LEFT JOIN x USING ("check") GROUP BY 1""")
def coherence(spark, sf_dir):
    """All eleven checks, over the layers of every hour."""
    c, day = F.col, F.expr("ledger DIV 24").alias("day")
    votes, hours, rows = _rows(spark, sf_dir)
    layers = rows.select(F.lit("retrace").alias("layer"), "ledger", "master", F.when(c("ledger") % 73 != 1, c("hash")).alias("hash"), "capture_gap")
    claims = rows.select("master", c("votes").alias("attributable_most"), c("absent").alias("artifact_least"), c("top").alias("open"), F.lit(None).cast("bigint").alias("statements"), c("margin").alias("late"), (c("votes") + c("absent") + c("top") + c("margin") + F.when(c("votes") % 10 == 9, 1).otherwise(0)).alias("claims"))
    flags = hours.where("n % 7 = 1").select(F.expr("l DIV 24").alias("day"), c("l").alias("ledger"), c("t").alias("t_ms"))
    opened = flags.where("ledger % 11 <> 4").select("day", "t_ms", (c("day") % 6 == 5).alias("truncated"))
    missed = rows.select(day, "ledger", "master", F.lit("missed").alias("type"), F.when(c("votes") % 12 != 0, True).alias("proven"))
    counters = missed.groupBy("day", "master").agg(F.count("*").alias("missed")).withColumn("missed", c("missed") + F.when(c("missed") % 9 == 0, 1).otherwise(0))
    reasons = rows.select(day, "ledger", c("gap_basis").alias("tag"))
    tags = reasons.groupBy("day", "tag").agg(F.countDistinct("ledger").alias("fails")).select("day", "tag", F.when(c("tag") == "ledger-index", F.least("fails", F.lit(4))).otherwise(c("fails")).alias("fails"), (c("day") % 3 != 0).alias("shown"))
    days = rows.groupBy(day).agg(F.count("*").alias("rows")).select("day", "rows", (c("rows") + F.when(c("day") % 4 == 2, 2).otherwise(0)).alias("quorum_fails"), (c("day") % 8 == 6).alias("gap_named"))
    frames = [(rows, C.row_rules()), C.layer_pairs(rows, layers), C.ledger_facts(rows), (claims, C.claim_rules()), C.openings(flags, opened), *C.misses(missed, counters), C.tag_cover(reasons, tags), (days, C.quorum_rules())]
    return C.total([C.judged(df, rules) for df, rules in frames])


@query("votes", BASE + f', x AS ({ROWS}) SELECT "check", ledger, master FROM x WHERE applies AND bad')
def coherence_violations(spark, sf_dir):
    """The rows that break a check of their own."""
    return C.violations(_rows(spark, sf_dir)[2], C.row_rules(), "ledger", "master")
