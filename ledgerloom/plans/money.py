"""Queries of the money-flow family over the txn, finding, geo and handoff views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranks import ROLES, SEVERITIES, rank_of
from ..operators import graph as G, motifs as M, rules as R, state as S
from ..operators.chains import flow_paths as flows
from ..operators.iterate import components, stored
from ..sources import views as V
from .registry import query

ROLES_SQL = """WITH ends AS (
      SELECT account AS address, destination AS other, amount_drops AS o, NULL::bigint AS i, rb IS NOT NULL AS f FROM edge
      UNION ALL SELECT destination, account, NULL::bigint, amount_drops, ra IS NOT NULL FROM edge),
    agg AS (SELECT address, count(o) AS degree_out, count(i) AS degree_in, cast(coalesce(sum(o), 0) AS bigint) AS out_drops, cast(coalesce(sum(i), 0) AS bigint) AS in_drops,
      count(DISTINCT CASE WHEN i IS NOT NULL THEN other END) AS distinct_in, count(*) FILTER (o > 0 AND o <= 100000) AS small_out, coalesce(max(o), 0) AS max_out,
      count(DISTINCT CASE WHEN i IS NOT NULL AND f THEN other END) AS flagged_in, count(DISTINCT CASE WHEN o IS NOT NULL AND f THEN other END) AS flagged_out
      FROM ends GROUP BY address)"""
ROLE_CASE = """CASE WHEN distinct_in >= 2 AND degree_out >= 1 AND in_drops > 0 AND max_out >= 0.9 * in_drops AND flagged_in >= 1 THEN 'drainer'
      WHEN degree_in >= 3 AND distinct_in >= 3 AND degree_out <= 2 AND in_drops >= 1.5 * out_drops AND flagged_in >= 1 THEN 'collector'
      WHEN degree_in >= 1 AND degree_out >= 1 AND abs(in_drops - out_drops) <= 0.5 * greatest(in_drops, out_drops) THEN 'relay'
      WHEN degree_out >= 3 AND small_out >= 3 AND degree_in <= 1 AND flagged_out >= 1 THEN 'source' ELSE 'unknown' END"""
SEVERITY = "CASE r WHEN 3 THEN 'malicious' WHEN 2 THEN 'suspect' ELSE 'info' END"


def _edges(spark, sf_dir):
    return G.flag_edges(V.txn(spark, sf_dir), V.finding(spark, sf_dir))


@query("edge", ROLES_SQL + f" SELECT *, {ROLE_CASE} AS role FROM agg")
def node_roles(spark, sf_dir):
    return G.node_roles(_edges(spark, sf_dir))


@query("edge", ROLES_SQL + " SELECT * FROM agg")
def node_aggregates(spark, sf_dir):
    return G.node_aggregates(_edges(spark, sf_dir))


@query("flag", f"SELECT address, cast(r AS bigint) AS rank, {SEVERITY} AS severity FROM flag")
def severity_max(spark, sf_dir):
    return G.severity_by_address(V.finding(spark, sf_dir))


@query("edge", f"SELECT hash, account, destination, ledger_seq, amount_drops, {SEVERITY} AS severity FROM edge")
def flag_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("hash", "account", "destination", "ledger_seq", "amount_drops", "severity")


@query("edge", "SELECT hash, account, destination, ledger_seq, amount_drops FROM edge ORDER BY ledger_seq DESC, hash DESC, account DESC, destination DESC, type DESC, amount_drops DESC LIMIT 2000")
def edge_cap_newest(spark, sf_dir):
    return G.newest(_edges(spark, sf_dir), 2000).select("hash", "account", "destination", "ledger_seq", "amount_drops")


@query("edge", "SELECT hash, account, destination FROM edge ORDER BY ledger_seq DESC, hash DESC, account DESC, destination DESC, type DESC, amount_drops DESC LIMIT 60")
def live_edges(spark, sf_dir):
    return G.live_edges(V.txn(spark, sf_dir), V.finding(spark, sf_dir)).select("hash", "account", "destination")


WASH = """WITH pairs AS (SELECT least(account, destination) AS a, greatest(account, destination) AS b, count(*) FILTER (account < destination) AS forth, count(*) FILTER (account > destination) AS back,
      cast(coalesce(sum(amount_drops) FILTER (account < destination), 0) AS bigint) AS forth_drops, cast(coalesce(sum(amount_drops) FILTER (account > destination), 0) AS bigint) AS back_drops,
      min(ledger_seq) AS first_ledger, max(ledger_seq) AS last_ledger FROM txn WHERE account <> destination GROUP BY 1, 2)"""


@query("txn", WASH + """ SELECT *, least(forth_drops, back_drops) / greatest(forth_drops, back_drops) AS conserve FROM pairs
    WHERE forth >= 2 AND back >= 2 AND greatest(forth_drops, back_drops) > 0 AND least(forth_drops, back_drops) / greatest(forth_drops, back_drops) >= 0.5 AND last_ledger - first_ledger <= 2000""")
def wash_cycles(spark, sf_dir):
    return M.wash_cycles(V.txn(spark, sf_dir), conserve=0.5, span=2000)


@query("txn", """WITH fan AS (SELECT account AS address, count(DISTINCT destination) AS fan_out FROM txn WHERE account <> destination GROUP BY 1),
    fin AS (SELECT destination AS address, count(DISTINCT account) AS fan_in FROM txn WHERE account <> destination GROUP BY 1)
    SELECT address, fan_in, fan_out FROM fan JOIN fin USING (address) WHERE fan_in >= 3 AND fan_out >= 3""")
def gather_scatter(spark, sf_dir):
    return M.gather_scatter(V.txn(spark, sf_dir))


@query("txn", """WITH w AS (SELECT account, ledger_seq, amount_drops, count(*) OVER (PARTITION BY account ORDER BY ledger_seq RANGE BETWEEN CURRENT ROW AND 10 FOLLOWING) AS near,
      ledger_seq - lag(ledger_seq) OVER (PARTITION BY account ORDER BY ledger_seq) AS gap FROM txn),
    g AS (SELECT account, max(near) AS burst, median(gap) AS median_gap, max(ledger_seq) - min(ledger_seq) AS span, cast(sum(amount_drops) AS bigint) AS out_drops, count(*) AS payments FROM w GROUP BY 1)
    SELECT *, burst >= 5 AND coalesce(median_gap <= 2, false) AS automated FROM g""")
def temporal_burst(spark, sf_dir):
    return M.temporal(V.txn(spark, sf_dir))


@query("txn", """WITH r AS (SELECT account, ledger_seq, row_number() OVER (PARTITION BY account ORDER BY ledger_seq DESC, hash DESC) AS n FROM txn)
    SELECT account, string_agg(cast(ledger_seq AS varchar), ',' ORDER BY ledger_seq) AS ledgers FROM r WHERE n <= 16 GROUP BY 1""")
def temporal_series(spark, sf_dir):
    return M.series(V.txn(spark, sf_dir)).select("account", F.array_join(F.col("ledgers").cast("array<string>"), ",").alias("ledgers"))


@query("txn reg", """SELECT destination, count(DISTINCT coalesce('t' || cast(tag AS varchar), 'none')) AS identities, count(*) AS payments FROM txn
    WHERE destination IN (SELECT address FROM reg WHERE tier = 'cold') GROUP BY 1 HAVING count(DISTINCT coalesce('t' || cast(tag AS varchar), 'none')) >= 2""")
def transit(spark, sf_dir):
    return G.transit_flags(V.txn(spark, sf_dir), V.geo(spark, sf_dir).where("tier = 'cold'"))


@query("edge", """WITH pairs AS (SELECT least(account, destination) AS a, greatest(account, destination) AS b FROM txn GROUP BY 1, 2
      HAVING count(*) FILTER (account < destination) >= 2 AND count(*) FILTER (account > destination) >= 2),
    both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a)
    SELECT node, min(other) AS root FROM reach GROUP BY 1""")
def pair_components(spark, sf_dir):
    tx = V.txn(spark, sf_dir)
    both = M.wash_cycles(tx, conserve=0.0)
    return components(both, "a", "b")


@query("edge")
def clusters(spark, sf_dir):
    return G.labelled(G.clusters(_edges(spark, sf_dir), hub=20), 50)


CUT = """WITH deg AS (SELECT address, count(*) AS n FROM (SELECT account AS address FROM edge UNION ALL SELECT destination FROM edge) GROUP BY 1 HAVING count(*) > 20)
    SELECT hash, account, destination FROM edge WHERE (ra IS NOT NULL OR account NOT IN (SELECT address FROM deg)) AND (rb IS NOT NULL OR destination NOT IN (SELECT address FROM deg))"""


@query("edge", CUT)
def hub_cut(spark, sf_dir):
    return G.hub_cut(_edges(spark, sf_dir)).select("hash", "account", "destination")


@query("handoff", """WITH st AS (SELECT DISTINCT t_ms // 86400000 AS day, account AS src, destination AS dst FROM handoff WHERE account <> destination),
    en AS (SELECT day, node, sum(i) AS i, sum(o) AS o FROM (SELECT day, src AS node, 0 AS i, 1 AS o FROM st UNION ALL SELECT day, dst, 1, 0 FROM st) GROUP BY 1, 2),
    nd AS (SELECT day, node, i, o, CASE WHEN i >= 2 * o THEN 'collector' WHEN o >= 3 * i THEN 'source' END AS role FROM en),
    sx AS (SELECT st.*, coalesce(nd.role = 'collector', false) OR nd.o = 0 AS ends FROM st JOIN nd ON nd.day = st.day AND nd.node = dst),
    w AS (SELECT day, [node] AS key, [node] AS path, false AS done FROM nd WHERE o > 0 AND coalesce(role, '') <> 'collector' AND (i = 0 OR role = 'source')
      UNION ALL SELECT w.day, list_append(path, dst), CASE WHEN list_contains(path, dst) THEN path ELSE list_append(path, dst) END, list_contains(path, dst) OR ends OR len(path) >= 5 FROM w JOIN sx ON sx.day = w.day AND src = path[len(path)] WHERE NOT done),
    k AS (SELECT day, path, min(key) AS key FROM w WHERE done AND len(path) >= 2 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY key) AS n FROM k)
    SELECT day, array_to_string(path, '>') AS path, cast(len(path) - 1 AS bigint) AS hops FROM r WHERE n <= 4""")
def flow_paths(spark, sf_dir):
    step = V.handoff(spark, sf_dir).where("account <> destination").select(F.expr("t_ms DIV 86400000").alias("day"), F.col("account").alias("src"), F.col("destination").alias("dst")).distinct()
    ends = step.select("day", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(step.select("day", F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    nodes = ends.groupBy("day", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    role = F.when(F.col("i") >= 2 * F.col("o"), "collector").when(F.col("o") >= 3 * F.col("i"), "source")
    return flows(nodes.select("day", "node", role.alias("role")), step, "day").select("day", F.array_join("path", ">").alias("path"), "hops")


@query("handoff", """WITH h AS (SELECT * FROM handoff WHERE account <> destination),
    f1 AS (SELECT destination AS address, account AS funder, row_number() OVER (PARTITION BY destination ORDER BY ledger_seq, hash) AS n FROM h),
    f AS (SELECT address, funder FROM f1 WHERE n = 1)
    SELECT a.address, a.funder, b.funder AS second FROM f a LEFT JOIN f b ON a.funder = b.address AND b.funder <> a.address""")
def funding(spark, sf_dir):
    first = V.handoff(spark, sf_dir).where("account <> destination").groupBy(F.col("destination").alias("address")).agg(F.min(F.struct("ledger_seq", "hash", "account")).alias("x")).select("address", F.col("x.account").alias("funder"))
    second = first.select(F.col("address").alias("funder"), F.col("funder").alias("second"))
    return first.join(second.alias("s"), "funder", "left").select("address", "funder", F.when(F.col("second") != F.col("address"), F.col("second")).alias("second"))


RULES = {
    "dusting": ("txn", """WITH tn AS (SELECT DISTINCT account, destination FROM txn WHERE amount_drops < 150000 AND ledger_seq >= 1200), hs AS (SELECT DISTINCT account, destination FROM txn WHERE amount_drops < 150000 AND ledger_seq < 1200),
        fr AS (SELECT address FROM (SELECT account AS address, ledger_seq FROM txn UNION ALL SELECT destination, ledger_seq FROM txn) GROUP BY 1 HAVING min(ledger_seq) >= 100),
        un AS (SELECT account, count(*) AS n FROM (SELECT * FROM tn UNION SELECT * FROM hs) GROUP BY 1), fs AS (SELECT account, count(fr.address) AS k FROM tn LEFT JOIN fr ON fr.address = destination GROUP BY 1)
        SELECT 'dusting' AS rule_id, 'suspect' AS severity, account AS address, cast(CASE WHEN n >= 3 THEN n ELSE k END AS varchar) AS note FROM fs JOIN un USING (account) WHERE n >= 3 OR k >= 2"""),
}


def _first_seen(tx):
    both = tx.select(F.col("account").alias("address"), "ledger_seq").unionByName(tx.select(F.col("destination").alias("address"), "ledger_seq"))
    return both.groupBy("address").agg(F.min("ledger_seq").alias("first_ledger"))


def _dusting(tx):
    old = tx.where("amount_drops < 150000 AND ledger_seq < 1200").select("account", "destination").distinct()
    return R.dusting(tx.where("ledger_seq >= 1200"), tiny=150_000, history=old, fresh=_first_seen(tx).where("first_ledger >= 100"))


@query(*RULES["dusting"])
def dusting(spark, sf_dir):
    return _dusting(V.txn(spark, sf_dir))


@query("txn flag", """WITH p AS (SELECT account, destination, bool_or(amount_drops < 4000000) AS small FROM txn GROUP BY 1, 2),
    q AS (SELECT account, count(*) AS n, count(*) FILTER (small) AS k, count(f.address) AS b FROM p LEFT JOIN flag f ON f.address = destination AND f.r = 3 GROUP BY 1)
    SELECT 'payment-burst' AS rule_id, 'suspect' AS severity, account AS address, concat(k, '/', n) AS note FROM q WHERE n >= 5 AND (k >= 3 OR b > 0) AND k >= n - 8""")
def payment_burst(spark, sf_dir):
    bad = G.severity_by_address(V.finding(spark, sf_dir)).where("rank = 3")
    return R.payment_burst(V.txn(spark, sf_dir), tiny=4_000_000, slack=8, bad=bad)


@query("txn flag", """WITH h AS (SELECT CASE WHEN a.address IS NOT NULL THEN account ELSE destination END AS actor FROM txn LEFT JOIN flag a ON a.address = account AND a.r = 3
      LEFT JOIN flag b ON b.address = destination AND b.r = 3 WHERE a.address IS NOT NULL OR b.address IS NOT NULL)
    SELECT 'known-bad-hit' AS rule_id, 'malicious' AS severity, actor AS address, cast(count(*) AS varchar) AS note FROM h GROUP BY actor""")
def known_bad(spark, sf_dir):
    bad = G.severity_by_address(V.finding(spark, sf_dir)).where("rank = 3")
    return R.known_bad(V.txn(spark, sf_dir), bad)


@query("txn reg", """WITH n AS (SELECT a.country AS account, pair % 50 AS asset, count(*) AS k FROM txn t JOIN reg a ON a.address = account JOIN reg b ON b.address = destination WHERE a.country = b.country GROUP BY 1, 2)
    SELECT 'wash-self-transfer' AS rule_id, 'suspect' AS severity, account AS address, cast(max(k) AS varchar) AS note FROM n WHERE k >= 3 GROUP BY account""")
def self_transfer(spark, sf_dir):
    """Payments between countries, so that some pay themselves."""
    g = V.geo(spark, sf_dir)
    a, b = (g.select(F.col("address").alias(c), F.col("country").alias(f"{c}_country")) for c in ("account", "destination"))
    t = V.txn(spark, sf_dir).join(a, "account").join(b, "destination")
    return R.self_transfers(t.select(F.col("account_country").alias("account"), F.col("destination_country").alias("destination"), (F.col("pair") % 50).alias("pair")))


@query("txn", """WITH rec AS (SELECT destination AS account, sum(amount_drops) AS received FROM txn GROUP BY 1), fs AS (SELECT address AS account, min(ledger_seq) AS f FROM (SELECT account AS address, ledger_seq FROM txn UNION ALL SELECT destination, ledger_seq FROM txn) GROUP BY 1),
    o AS (SELECT t.*, f >= 300 AS created FROM txn t JOIN fs USING (account) WHERE f >= 60 AND NOT EXISTS (SELECT 1 FROM txn p WHERE p.destination = t.account AND p.account = t.destination)),
    h AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ledger_seq, hash, amount_drops) AS n FROM o JOIN rec USING (account) WHERE amount_drops >= 0.9 * received)
    SELECT 'drainer-sweep' AS rule_id, CASE WHEN created THEN 'malicious' ELSE 'suspect' END AS severity, account AS address, cast(amount_drops AS varchar) AS note FROM h WHERE n = 1""")
def drainer_sweep(spark, sf_dir):
    t = stored(V.txn(spark, sf_dir).select("hash", "account", "destination", "amount_drops", "ledger_seq"))  # read for receipts, payers, first ledgers and the payments
    return R.drainer_sweep(t, fresh=_first_seen(t).where("first_ledger >= 60").select(F.col("address").alias("account"), (F.col("first_ledger") >= 300).alias("created")))


@query("txn", """SELECT 'airdrop-trustset-spam' AS rule_id, 'suspect' AS severity, destination AS address, cast(count(DISTINCT account) AS varchar) AS note FROM txn
    WHERE amount_drops > 0 AND amount_drops < 600000 AND account <> destination GROUP BY destination HAVING count(DISTINCT account) >= 5""")
def trust_spam(spark, sf_dir):
    return R.trust_spam(V.txn(spark, sf_dir), tiny=600_000)


FILLS = """WITH fills AS (SELECT CASE WHEN starts_with(account, 'C') THEN account ELSE destination END AS account, pair % 50 AS pair, CASE WHEN starts_with(account, 'C') THEN 'buy' ELSE 'sell' END AS direction,
    amount_drops AS notional, price / quantity AS rate, ledger_seq FROM txn)"""


def _fills(spark, sf_dir):
    c = F.col("account").startswith("C")
    return V.txn(spark, sf_dir).select(F.when(c, F.col("account")).otherwise(F.col("destination")).alias("account"), (F.col("pair") % 50).alias("pair"), F.when(c, "buy").otherwise("sell").alias("direction"), F.col("amount_drops").alias("notional"), (F.col("price") / F.col("quantity")).alias("rate"), "ledger_seq")


@query("txn", FILLS + """, w AS (SELECT account, pair, direction, count(*) AS n, sum(notional) AS v, min(ledger_seq) AS f, max(ledger_seq) AS l FROM fills GROUP BY 1, 2, 3),
    b AS (SELECT account, pair FROM w GROUP BY 1, 2 HAVING count(*) >= 2 AND min(n) >= 1 AND min(v) >= 1000000 AND min(v) >= 0.9 * max(v) AND max(v) - min(v) <= 0.1 * max(v) AND max(l) - min(f) <= 1500)
    SELECT 'amm-wash-swap' AS rule_id, 'suspect' AS severity, account AS address, cast(min(pair) AS varchar) AS note FROM b GROUP BY account""")
def wash_swap(spark, sf_dir):
    return R.wash_swap(_fills(spark, sf_dir), least=1, span=1500)


@query("txn", FILLS + """, m AS (SELECT pair, median(rate) AS mid FROM fills GROUP BY 1 HAVING count(rate) >= 5),
    h AS (SELECT account, pair FROM fills JOIN m USING (pair) WHERE notional >= 1000000 AND CASE WHEN direction = 'sell' THEN rate - mid ELSE mid - rate END >= 0.25 * mid GROUP BY account, pair HAVING count(*) >= 2 AND max(ledger_seq) - min(ledger_seq) <= 150)
    SELECT 'thin-pool-exploit' AS rule_id, 'suspect' AS severity, account AS address, cast(min(pair) AS varchar) AS note FROM h GROUP BY account""")
def thin_pool(spark, sf_dir):
    return R.thin_pool(_fills(spark, sf_dir).withColumn("up", F.col("direction") == "sell"), floor=1_000_000)


@query("txn", """WITH ord AS (SELECT account, pair // 4 % 5 AS sequence, pair % 4 AS book, tag AS level, amount_drops AS notional, ledger_seq, hash, CASE WHEN tag % 2 = 1 THEN 'create' ELSE 'cancel' END AS kind FROM txn),
    l AS (SELECT *, lag(kind) OVER w AS k, lag(ledger_seq) OVER w AS made FROM ord WINDOW w AS (PARTITION BY account, sequence, book ORDER BY ledger_seq, hash)),
    b AS (SELECT account, book FROM l WHERE kind = 'cancel' AND k = 'create' AND ledger_seq - made <= 75 AND notional >= 1000000 GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT level) >= 2 AND max(ledger_seq) - min(made) <= 2000)
    SELECT 'spoof-offer-cycle' AS rule_id, 'suspect' AS severity, account AS address, cast(min(book) AS varchar) AS note FROM b GROUP BY account""")
def spoof_cycle(spark, sf_dir):
    orders = V.txn(spark, sf_dir).select("account", F.expr("pair DIV 4 % 5").alias("sequence"), (F.col("pair") % 4).alias("book"), F.col("tag").alias("level"), F.col("amount_drops").alias("notional"), "ledger_seq", "hash", F.when(F.col("tag") % 2 == 1, "create").otherwise("cancel").alias("kind"))
    return R.spoof_cycles(orders, floor=1_000_000, span=2000)


@query("txn", """WITH bal AS (SELECT concat('C', c_custkey) AS account, cast(round(c_acctbal * 1000) AS bigint) AS balance FROM customer)
    SELECT 'mass-sweep-convergence' AS rule_id, 'malicious' AS severity, destination AS address, cast(count(DISTINCT account) AS varchar) AS note FROM txn JOIN bal USING (account)
    WHERE balance > 0 AND amount_drops >= 0.9 * balance AND account <> destination GROUP BY destination HAVING count(DISTINCT account) >= 5""")
def sweep_convergence(spark, sf_dir):
    balances = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("account"), F.round(F.col("c_acctbal") * 1000).cast("bigint").alias("balance"))
    return R.sweep_convergence(V.txn(spark, sf_dir), balances)


@query("txn", """WITH r AS (SELECT account, destination, row_number() OVER (PARTITION BY account ORDER BY ledger_seq DESC, hash DESC, destination DESC) AS n FROM txn)
    SELECT 'account-delete-sweep' AS rule_id, 'suspect' AS severity, destination AS address, cast(count(*) AS varchar) AS note FROM r WHERE n = 1 AND account <> destination GROUP BY destination HAVING count(*) >= 3""")
def delete_sweep(spark, sf_dir):
    return R.delete_sweep(V.txn(spark, sf_dir))


@query("txn", """SELECT 'offer-spam' AS rule_id, 'info' AS severity, account AS address, cast(count(*) FILTER (type = 'Payment') AS varchar) AS note FROM txn GROUP BY account
    HAVING count(*) FILTER (type = 'Payment') >= 10 AND count(*) FILTER (quantity >= 49) = 0""")
def offer_spam(spark, sf_dir):
    return R.offer_spam(V.txn(spark, sf_dir).select("account", F.when(F.col("type") == "Payment", "offer").alias("kind"), (F.col("quantity") >= 49).alias("filled")))


@query("txn", """SELECT 'fake-nft-fraud' AS rule_id, 'suspect' AS severity, account AS address, concat(destination, ':', count(*)) AS note FROM txn GROUP BY account, destination HAVING count(*) >= 5
    UNION ALL SELECT 'fake-nft-fraud', 'suspect', account, cast(count(*) AS varchar) FROM txn WHERE amount_drops // 1000000 = 0 GROUP BY account HAVING count(*) >= 10""")
def nft_burst(spark, sf_dir):
    t = V.txn(spark, sf_dir)
    return R.nft_bursts(t, accepts=t.select("account", F.expr("amount_drops DIV 1000000").alias("amount_drops")))


@query("txn", """WITH fs AS (SELECT destination, min(ledger_seq) AS first_ledger FROM txn GROUP BY 1)
    SELECT 'escrow-check-bait' AS rule_id, 'suspect' AS severity, account AS address, cast(count(DISTINCT destination) AS varchar) AS note FROM txn JOIN fs USING (destination)
    WHERE type = 'EscrowCreate' AND amount_drops < 5000000 AND ledger_seq - first_ledger <= 1500 GROUP BY account HAVING count(DISTINCT destination) >= 2""")
def escrow_bait(spark, sf_dir):
    tx = V.txn(spark, sf_dir)
    return R.escrow_bait(tx, 5_000_000, tx.groupBy(F.col("destination").alias("address")).agg(F.min("ledger_seq").alias("first_ledger")), 1500, least=2)


@query("txn", """WITH e AS (SELECT destination AS pool, sum(amount_drops) OVER (PARTITION BY destination ORDER BY ledger_seq, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, amount_drops AS taken FROM txn)
    SELECT 'amm-pool-drain' AS rule_id, 'suspect' AS severity, pool AS address, cast(count(*) AS varchar) AS note FROM e WHERE before >= 10000000 AND taken >= 0.5 * before GROUP BY pool""")
def pool_drain(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("destination").orderBy("ledger_seq", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return R.pool_drain(V.txn(spark, sf_dir).select(F.col("destination").alias("pool"), F.sum("amount_drops").over(w).alias("before"), F.col("amount_drops").alias("taken")), 0.5, 10_000_000)


@query("txn", f"""WITH a AS ({RULES['dusting'][1]}), b AS (SELECT 'account-delete-sweep' AS rule_id, destination AS address FROM (SELECT account, destination, row_number() OVER (PARTITION BY account ORDER BY ledger_seq DESC, hash DESC, destination DESC) AS n FROM txn) WHERE n = 1 AND account <> destination GROUP BY destination HAVING count(*) >= 3),
    u AS (SELECT rule_id, address FROM a UNION ALL SELECT * FROM b)
    SELECT rule_id, count(*) AS findings, count(DISTINCT address) AS addresses, round(count(*) * 1000 / (SELECT count(*) FROM txn), 6) AS per_thousand FROM u GROUP BY 1""")
def rule_rates(spark, sf_dir):
    tx = V.txn(spark, sf_dir)
    return R.rule_rates(R.together(_dusting(tx), R.delete_sweep(tx)), tx.count())


@query("edge", """WITH ends AS (SELECT account AS cluster, hash, ledger_seq, account AS node FROM edge UNION ALL SELECT account, hash, ledger_seq, destination FROM edge),
    o AS (SELECT *, row_number() OVER (PARTITION BY cluster, node ORDER BY ledger_seq, hash) AS rn, count(*) OVER (PARTITION BY cluster, node) AS d FROM ends),
    an AS (SELECT DISTINCT cluster, hash, ledger_seq FROM o WHERE rn = 1 AND d >= 2),
    f AS (SELECT cluster, hash FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ledger_seq, hash) AS n FROM an) WHERE n <= 3),
    r AS (SELECT e.account AS cluster, e.hash, e.amount_drops, row_number() OVER (PARTITION BY e.account ORDER BY CASE WHEN f.hash IS NULL THEN 1 ELSE 0 END, e.amount_drops DESC, e.hash) AS place FROM edge e LEFT JOIN f ON f.cluster = e.account AND f.hash = e.hash)
    SELECT * FROM r WHERE place <= 8""")
def edge_topk(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("cluster", F.col("account"))
    e = e.select("cluster", "hash", "account", "destination", "amount_drops", "ledger_seq")
    return S.top_edges(e, "cluster", k=8, anchors=3).select("cluster", "hash", "amount_drops", "place")


STATE = """WITH st AS (SELECT account AS cluster, cast(sum(amount_drops) AS bigint) AS total_drops, count(*) AS tx_count, min(ledger_seq) AS first_seen, max(ledger_seq) AS last_seen, max(coalesce(rb, 1)) AS role_rank, max(r) AS severity_rank, ledger_seq < 1200 AS early FROM edge GROUP BY account, ledger_seq < 1200)"""


def _state(e):
    return e.groupBy(F.col("account").alias("cluster")).agg(F.sum("amount_drops").alias("total_drops"), F.count("*").alias("tx_count"), F.min("ledger_seq").alias("first_seen"), F.max("ledger_seq").alias("last_seen"), F.max(F.coalesce("to_rank", F.lit(1))).cast("bigint").alias("role_rank"), F.max("rank").alias("severity_rank"))


@query("edge", STATE + " SELECT cluster, cast(sum(total_drops) AS bigint) AS total_drops, cast(sum(tx_count) AS bigint) AS tx_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen, cast(max(role_rank) AS bigint) AS role_rank, cast(max(severity_rank) AS bigint) AS severity_rank FROM st GROUP BY cluster")
def state_merge(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return S.merge_clusters(_state(e.where("ledger_seq < 1200")), _state(e.where("ledger_seq >= 1200")))


KEEP = STATE + """, m AS (SELECT cluster, cast(sum(total_drops) AS bigint) AS total_drops, cast(sum(tx_count) AS bigint) AS tx_count, max(last_seen) AS last_seen, max(severity_rank) AS s FROM st GROUP BY cluster),
    k AS (SELECT * FROM m WHERE 2500 - last_seen <= CASE WHEN s = 3 THEN 400 ELSE 100 END),
    t AS (SELECT * FROM k ORDER BY CASE WHEN s = 3 THEN 1 ELSE 0 END DESC, total_drops DESC, tx_count DESC, cluster LIMIT 200)"""


def _kept(e):
    state = _state(e)
    evidence = F.col("severity_rank") == 3
    young = S.retained(state, 2500, 100, 400, evidence)
    return state, evidence, S.capped(young, 200, [F.when(evidence, 1).otherwise(0).desc(), F.desc("total_drops"), F.desc("tx_count"), F.col("cluster").asc()])


@query("edge", KEEP + " SELECT cluster, total_drops, last_seen FROM t")
def retention(spark, sf_dir):
    return _kept(_edges(spark, sf_dir))[2].select("cluster", "total_drops", "last_seen")


@query("edge", KEEP + " SELECT cluster, total_drops, last_seen FROM m WHERE s = 3 AND cluster NOT IN (SELECT cluster FROM t)")
def archive_select(spark, sf_dir):
    state, evidence, kept = _kept(_edges(spark, sf_dir))
    return S.archived(state, kept, "cluster", evidence).select("cluster", "total_drops", "last_seen")


@query("edge", """WITH mem AS (SELECT DISTINCT account AS cluster, destination AS address FROM edge WHERE ledger_seq >= 1200), st AS (SELECT DISTINCT account AS cluster, destination AS address FROM edge WHERE ledger_seq < 1200)
    SELECT m.cluster, coalesce(min(s.cluster), m.cluster) AS target FROM mem m LEFT JOIN st s USING (address) GROUP BY m.cluster""")
def state_absorb(spark, sf_dir):
    e = _edges(spark, sf_dir).select(F.col("account").alias("cluster"), F.col("destination").alias("address"), "ledger_seq")
    return S.absorb(e.where("ledger_seq >= 1200").select("cluster", "address").distinct(), e.where("ledger_seq < 1200").select("cluster", "address").distinct())


@query("edge", """WITH m AS (SELECT account AS cluster, destination AS address, max(coalesce(rb, 0)) AS s, count(*) AS n FROM edge GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, n DESC, address) AS place FROM m) SELECT cluster, address, place FROM r WHERE place <= 5""")
def member_cap(spark, sf_dir):
    m = _edges(spark, sf_dir).groupBy(F.col("account").alias("cluster"), F.col("destination").alias("address")).agg(F.max(F.coalesce("to_rank", F.lit(0))).alias("s"), F.count("*").alias("n"))
    return S.capped_members(m, "cluster", 5, [F.desc("s"), F.desc("n"), F.col("address")]).select("cluster", "address", "place")


@query("edge", """WITH s AS (SELECT account, hash, ledger_seq, sum(length(hash)) OVER (PARTITION BY account ORDER BY ledger_seq DESC, hash DESC ROWS UNBOUNDED PRECEDING) AS b FROM edge)
    SELECT account, hash, cast(b AS bigint) AS bytes FROM s WHERE b <= 200""")
def byte_cap(spark, sf_dir):
    return S.fitting(_edges(spark, sf_dir), "account", [F.desc("ledger_seq"), F.desc("hash")], F.length("hash"), 200).select("account", "hash", "bytes")


@query("txn", """WITH r AS (SELECT account, destination, ledger_seq, hash, amount_drops, row_number() OVER (PARTITION BY account, destination ORDER BY ledger_seq DESC, hash DESC, amount_drops DESC) AS n FROM txn)
    SELECT account, destination, ledger_seq, hash, amount_drops FROM r WHERE n = 1""")
def last_wins(spark, sf_dir):
    return S.last_wins(V.txn(spark, sf_dir).select("account", "destination", "ledger_seq", "hash", "amount_drops"), ["account", "destination"], ["ledger_seq", "hash"])


@query("txn", "SELECT account, sha256(string_agg(DISTINCT destination, chr(10) ORDER BY destination)) AS key, count(DISTINCT destination) AS members FROM txn GROUP BY account")
def history_key(spark, sf_dir):
    m = V.txn(spark, sf_dir).groupBy("account").agg(F.collect_set("destination").alias("m"))
    return m.select("account", S.history_key(F.col("m")).alias("key"), F.size("m").cast("bigint").alias("members"))


@query("txn", """WITH o AS (SELECT account AS key, cast(sum(amount_drops) AS bigint) AS total_drops, min(ledger_seq) AS first_seen, max(ledger_seq) AS last_seen FROM txn WHERE ledger_seq < 1500 GROUP BY 1),
    n AS (SELECT account AS key, cast(sum(amount_drops) AS bigint) AS total_drops, min(ledger_seq) AS first_seen, max(ledger_seq) AS last_seen FROM txn WHERE ledger_seq >= 1500 GROUP BY 1)
    SELECT coalesce(o.key, n.key) AS key, coalesce(n.total_drops, o.total_drops) AS total_drops, least(o.first_seen, n.first_seen) AS first_seen, greatest(o.last_seen, n.last_seen) AS last_seen,
      CASE WHEN o.key IS NULL THEN 1 WHEN n.key IS NULL THEN 1 WHEN n.last_seen - o.last_seen > 600 THEN 2 ELSE 1 END::bigint AS sightings FROM o FULL JOIN n ON o.key = n.key""")
def history_merge(spark, sf_dir):
    t = V.txn(spark, sf_dir)
    f = lambda d: d.groupBy(F.col("account").alias("key")).agg(F.sum("amount_drops").alias("total_drops"), F.min("ledger_seq").alias("first_seen"), F.max("ledger_seq").alias("last_seen"))
    return S.merge_history(f(t.where("ledger_seq < 1500")).withColumn("sightings", F.lit(1)), f(t.where("ledger_seq >= 1500")), 600)


MEMO = "CASE page_id % 5 WHEN 0 THEN 'verify your wallet at ' WHEN 1 THEN 'free token ' WHEN 2 THEN 'is this legit here: airdrop ' WHEN 3 THEN 'warranty claim ' ELSE 'order ' END"


@query("", f"""WITH m AS (SELECT page_id, concat({MEMO}, url) AS t FROM pages), h AS (SELECT *, regexp_matches(t, '{T.SEED}') OR (regexp_matches(t, '{T.URL.replace("'", "''")}') AND (regexp_matches(t, '{T.LURE}') OR regexp_matches(t, '{T.CLAIM}'))) AS hit FROM m)
    SELECT page_id, CASE WHEN hit AND regexp_matches(t, '{T.ASKING}') THEN 'suspect' WHEN hit THEN 'malicious' END AS verdict FROM h""")
def phishing_memo(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", T.phishing(F.concat(F.expr(MEMO), "url")).alias("verdict"))


@query("txn", "SELECT CASE type WHEN 'Payment' THEN 'payment' WHEN 'EscrowCreate' THEN 'escrow' ELSE 'other' END AS category, count(*) AS n FROM txn GROUP BY 1")
def tx_category(spark, sf_dir):
    return V.txn(spark, sf_dir).groupBy(T.tx_category(F.col("type")).alias("category")).agg(F.count("*").alias("n"))


@query("", """SELECT conv_id, turn, replace(replace(text, 'the', 'A-1'), 'and', 'A-2') AS text FROM conversations""")
def sanitize_text(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.protected(F.col("text"), {"the": "A-1", "and": "A-2"}).alias("text"))


@query("txn", "SELECT account, sha256(account) AS hash FROM txn GROUP BY account")
def address_hashes(spark, sf_dir):
    return V.txn(spark, sf_dir).select("account").distinct().select("account", T.address_hash(F.col("account")).alias("hash"))


KEYS = """WITH ks AS (SELECT concat('C', c_custkey) AS address, concat('k', c_nationkey, '-', c_custkey % 97) AS key FROM customer UNION ALL SELECT concat('C', c_custkey), concat('m', c_mktsegment) FROM customer),
    own AS (SELECT DISTINCT address, key FROM ks), big AS (SELECT key FROM own GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20), lk AS (SELECT address, key FROM own WHERE key IN (SELECT key FROM big))"""


def _keys(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    a = F.concat(F.lit("C"), "c_custkey").alias("address")
    return c.select(a, F.concat(F.lit("k"), "c_nationkey", F.lit("-"), F.col("c_custkey") % 97).alias("key")).unionByName(c.select(a, F.concat(F.lit("m"), "c_mktsegment").alias("key")))


@query("", KEYS + " SELECT a.address, count(DISTINCT b.address) AS others, count(DISTINCT a.key) AS keys FROM lk a JOIN lk b ON a.key = b.key AND a.address <> b.address GROUP BY 1")
def entity_signal(spark, sf_dir):
    return G.entity_signals(_keys(spark, sf_dir))


@query("", KEYS.replace("WITH ", "WITH RECURSIVE ") + """, reach AS (SELECT address AS node, address AS other FROM lk UNION SELECT r.node, b.address FROM reach r JOIN lk a ON a.address = r.other JOIN lk b ON a.key = b.key),
    roots AS (SELECT node, min(other) AS root FROM reach GROUP BY 1) SELECT root AS entity, count(*) AS size FROM roots GROUP BY 1 HAVING count(*) >= 2""")
def entity_clusters(spark, sf_dir):
    return G.entity_clusters(_keys(spark, sf_dir))
