"""Queries of forwarding chains: each event hands on to the next one's account, amounts decay, signups are flagged, purchases end a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peeling as P
from ..operators.iterate import kept
from ..sources import views as V
from .registry import query

PAID = """t AS (SELECT concat('n', event_id) AS hash, concat('N', event_id) AS account, concat('N', event_id + 1) AS destination, cast(round(10000000 * power(0.8::double, event_id % 9 - CASE WHEN event_type = 'error' THEN 0.85::double ELSE 0 END)) AS bigint) AS amount_drops, event_id AS seq, 10 + event_id % 2 AS fee, event_id % 40 AS tag, t_ms FROM ev WHERE event_type <> 'purchase')"""
FLAGS = "f AS (SELECT concat('N', event_id) AS address, 2 + user_id % 2 AS rank FROM ev WHERE event_type = 'signup')"


def _paid(spark, sf_dir):
    amount = F.round(F.pow(F.lit(0.8), F.col("event_id") % 9 - F.when(F.col("event_type") == "error", 0.85).otherwise(0.0)) * 10_000_000).cast("bigint")
    return V.events(spark, sf_dir).where("event_type <> 'purchase'").select(
        F.concat(F.lit("n"), "event_id").alias("hash"), F.concat(F.lit("N"), "event_id").alias("account"), F.concat(F.lit("N"), F.col("event_id") + 1).alias("destination"), amount.alias("amount_drops"), F.col("event_id").alias("ledger_seq"),
        (F.col("event_id") % 2 + 10).alias("fee_drops"), (F.col("event_id") % 40).alias("to_tag"), F.col("t_ms").alias("close_ms"),
    )


def _flags(spark, sf_dir):
    return V.events(spark, sf_dir).where("event_type = 'signup'").select(F.concat(F.lit("N"), "event_id").alias("address"), (F.col("user_id") % 2 + 2).alias("rank"))


def _text(df):
    """Arrays as text, as SQL gives them."""
    return df.withColumn("hops", F.array_join(F.transform("hops", lambda h: h["hash"]), ",")).withColumn("bridges", F.array_join("bridges", ",")).withColumn("habits", F.array_join("habits", ","))


#: The walk of a chain by recursion; step has a row for each relay, with a place for what a further hop needs.
_WALK = """w AS (SELECT account AS seed, [account, destination] AS path, [hash] AS hashes, [amount_drops] AS amounts, [seq] AS seqs, [fee] AS fees, [tag] AS tags, 0 AS rem, CASE WHEN destination IN (SELECT address FROM f) THEN []::varchar[] ELSE [destination] END AS bridges, NULL::varchar AS prev FROM near WHERE amount_drops > 100 AND account IN (SELECT address FROM f)
    UNION ALL SELECT seed, list_append(path, s.destination), list_append(hashes, s.hash), CASE WHEN peel > 0 THEN list_concat(amounts, [s.amount_drops, peel]) ELSE list_append(amounts, s.amount_drops) END, list_append(seqs, s.seq), list_append(fees, s.fee), list_append(tags, s.tag), rem + (peel > 0)::int, CASE WHEN s.destination IN (SELECT address FROM f) THEN bridges ELSE list_append(bridges, s.destination) END, array_to_string(path, ',')
    FROM w JOIN step s ON s.node = path[-1] AND NOT list_contains(path, s.destination) AND len(hashes) < 8),
    e AS (SELECT *, array_to_string(path, ',') AS signature, len(hashes) AS n FROM w WHERE array_to_string(path, ',') NOT IN (SELECT prev FROM w WHERE prev IS NOT NULL)),
    g AS (SELECT *, list_transform(range(1, n), lambda i: seqs[i + 1] - seqs[i]) AS gaps, list_aggregate(fees, 'median') AS mid FROM e)"""
_HABITS = """concat_ws(',', CASE WHEN n >= 2 AND len(list_filter(fees, lambda x: abs(x - mid) > 0.1 * mid)) = 0 THEN 'fee-constancy' END, CASE WHEN len(list_distinct(amounts)) < len(amounts) THEN 'amount-duplicates' END,
    CASE WHEN n >= 3 AND list_aggregate(gaps, 'median') <= 10 AND list_aggregate(gaps, 'var_pop') <= 36 THEN 'interval-regularity' END, CASE WHEN len(list_distinct(tags)) < len(tags) THEN 'tag-reuse' END) AS habits"""


@query("ev", f"""WITH {PAID}, {FLAGS}, p AS (SELECT concat('p', event_id) AS hash, concat('N', event_id) AS account, concat('P', user_id) AS destination, 1000 + cast(round(value * 100) AS bigint) AS amount_drops, event_id AS seq FROM ev WHERE user_id % 2 = 0),
    a AS (SELECT account, destination FROM t UNION ALL SELECT account, destination FROM p), fr AS (SELECT address AS node FROM f UNION SELECT destination FROM a JOIN fr ON account = node), tos AS (SELECT address AS node FROM f UNION SELECT account FROM a JOIN tos ON destination = node),
    near AS (SELECT * FROM t WHERE account IN (SELECT node FROM fr) AND destination IN (SELECT node FROM tos)),
    step AS (SELECT * FROM (SELECT o.account AS node, o.*, CASE WHEN o.amount_drops / i.amount_drops BETWEEN 0.6 AND 0.95 THEN 0 WHEN o.amount_drops / i.amount_drops >= 0.95 AND o.amount_drops < i.amount_drops AND p.amount_drops <= i.amount_drops * 0.01 THEN p.amount_drops END AS peel
        FROM near o JOIN near i ON i.destination = o.account LEFT JOIN p ON p.account = o.account WHERE o.account NOT IN (SELECT address FROM f) AND o.amount_drops > 100) WHERE peel IS NOT NULL),
    {_WALK} SELECT signature, seed, rank AS seed_rank, array_to_string(hashes, ',') AS hops, n AS hop_count, array_to_string(list_sort(bridges), ',') AS bridges, rem::bigint AS remainder_hops, {_HABITS}
    FROM g JOIN f ON address = seed WHERE n >= CASE WHEN rem > 0 THEN 2 ELSE 3 END""")
def seeded_chains(spark, sf_dir):
    """Chains between flagged accounts, with small payments beside the line as peels."""
    peels = V.events(spark, sf_dir).where("user_id % 2 = 0").select(F.concat(F.lit("p"), "event_id").alias("hash"), F.concat(F.lit("N"), "event_id").alias("account"), F.concat(F.lit("P"), "user_id").alias("destination"), (F.round(F.col("value") * 100).cast("bigint") + 1000).alias("amount_drops"), F.col("event_id").alias("ledger_seq"))
    found = P.seeded_chains(_paid(spark, sf_dir).drop("close_ms").unionByName(peels, allowMissingColumns=True), _flags(spark, sf_dir))
    return _text(found).drop("path", "score", "high")


@query("ev", f"""WITH {PAID}, {FLAGS}, near AS (SELECT * FROM t), step AS (SELECT o.account AS node, o.*, 0 AS peel FROM t o JOIN t i ON i.destination = o.account WHERE o.amount_drops > 100 AND o.amount_drops / i.amount_drops BETWEEN 0.6 AND 0.95 AND o.seq - i.seq <= 900),
    {_WALK}, m AS (SELECT concat('C', (event_id // 50) % 7) AS cluster, concat('N', event_id) AS address FROM ev), c AS (SELECT signature, n, hashes, m.cluster AS owner, {_HABITS} FROM g JOIN m ON m.address = seed WHERE n >= 3)
    SELECT owner, signature, array_to_string(hashes, ',') AS hops FROM c QUALIFY row_number() OVER (PARTITION BY owner ORDER BY signature) <= 5""")
def state_chains(spark, sf_dir):
    """Chains over the edges of all clusters' state, folded into their owners, five each."""
    members = V.events(spark, sf_dir).select(F.concat(F.lit("C"), F.expr("(event_id DIV 50) % 7")).alias("cluster"), F.concat(F.lit("N"), "event_id").alias("address"))
    paid, flags = _paid(spark, sf_dir), _flags(spark, sf_dir)
    found = kept(P.owned(P.edge_chains(paid, flags), members))  # once for both
    known = found.where("seed_rank = 3").select("owner", "signature", "hops")  # as an older fold left them
    return P.folded(known, found, 5).withColumn("hops", F.array_join(F.transform("hops", lambda h: h["hash"]), ","))
