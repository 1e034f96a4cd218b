"""Queries of the operators around the rules: context, confirmation, watchlists, countries, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assets as A
from ..operators import context as X
from ..sources import views as V
from .registry import query


def _protected(spark, sf_dir):
    return V.geo(spark, sf_dir).where("country = 'FRANCE'")


@query("txn reg", "SELECT hash, account, destination FROM txn WHERE account NOT IN (SELECT address FROM reg WHERE country = 'FRANCE') AND destination NOT IN (SELECT address FROM reg WHERE country = 'FRANCE')")
def protected_endpoints(spark, sf_dir):
    return X.without(V.txn(spark, sf_dir), _protected(spark, sf_dir), "account", "destination").select("hash", "account", "destination")


@query("txn finding reg", """WITH p AS (SELECT address FROM reg WHERE country = 'FRANCE'), g AS (SELECT address FROM reg WHERE tier = 'cold'),
    k AS (SELECT f.address, s.first_seen FROM (SELECT DISTINCT address FROM finding) f LEFT JOIN (SELECT account AS address, min(ledger_seq) AS first_seen FROM txn WHERE type = 'Payment' GROUP BY 1) s USING (address)),
    s AS (SELECT 0 AS layer, address, first_seen FROM k WHERE address NOT IN (FROM g) UNION ALL SELECT 1, destination, min(ledger_seq) FROM txn WHERE type = 'EscrowCreate' AND destination NOT IN (FROM g) GROUP BY 2 UNION ALL SELECT 2, account, min(ledger_seq) FROM txn GROUP BY 2),
    d AS (SELECT 0 AS layer, destination AS address, sum(amount_drops) AS out FROM txn WHERE tag = 1 AND destination NOT IN (FROM g) GROUP BY 2 UNION ALL SELECT 2, account, sum(amount_drops) FROM txn WHERE tag = 2 GROUP BY 2),
    s1 AS (SELECT address, bool_or(layer = 0) AS known_bad, arg_min(first_seen, layer) FILTER (first_seen IS NOT NULL) AS first_seen FROM s GROUP BY 1), d1 AS (SELECT address, arg_min(out, layer) AS funded FROM d GROUP BY 1)
    SELECT coalesce(s1.address, d1.address) AS address, coalesce(known_bad, false) AS known_bad, first_seen, d1.address IS NOT NULL AS drainer, cast(funded AS bigint) AS funded FROM s1 FULL JOIN d1 ON s1.address = d1.address WHERE coalesce(s1.address, d1.address) NOT IN (FROM p)""")
def detection_context(spark, sf_dir):
    t = V.txn(spark, sf_dir)
    seen = lambda df, end: df.groupBy(F.col(end).alias("address")).agg(F.min("ledger_seq").alias("first_seen"))
    out = lambda df, end: df.groupBy(F.col(end).alias("address")).agg(F.sum("amount_drops").alias("out_drops"))
    listed = V.finding(spark, sf_dir).select("address").distinct().join(seen(t.where("type = 'Payment'"), "account"), "address", "left")
    return X.detection_context(listed, seen(t.where("type = 'EscrowCreate'"), "destination"), seen(t, "account"), out(t.where("tag = 1"), "destination"), out(t.where("tag = 2"), "account"), V.geo(spark, sf_dir).where("tier = 'cold'"), _protected(spark, sf_dir))


@query("txn flag", """WITH a AS (SELECT DISTINCT address FROM flag), e AS (SELECT a.address, t.* FROM a JOIN txn t ON a.address = t.account OR a.address = t.destination),
    r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY address ORDER BY ledger_seq DESC, hash DESC) <= 100),
    i AS (SELECT address, sum(amount_drops) AS received FROM r WHERE account <> address GROUP BY 1),
    o AS (SELECT r.*, amount_drops / received AS ratio FROM r JOIN i USING (address) WHERE account = address AND destination <> address),
    b AS (SELECT address, arg_max(struct_pack(ratio, amount_drops), (ratio, ledger_seq, hash)) AS x FROM o GROUP BY 1),
    c AS (SELECT DISTINCT address FROM o WHERE ratio >= 0.9 AND NOT EXISTS (SELECT 1 FROM r p WHERE p.address = o.address AND p.account = o.destination))
    SELECT address, round(x.ratio, 6) AS ratio, x.amount_drops AS drops, CASE WHEN starts_with(address, 'C') THEN 'malicious' ELSE 'suspect' END AS severity FROM b JOIN c USING (address) WHERE x.ratio >= 0.9""")
def confirmed_sweeps(spark, sf_dir):
    touched = V.finding(spark, sf_dir).select("address", F.col("address").startswith("C").alias("created"))
    return X.confirmed_sweeps(touched, V.txn(spark, sf_dir))


REGISTRY = """WITH m AS (SELECT master, CASE WHEN max(t_ms) % 4 > 0 THEN concat(lower(master), '.example') ELSE '' END AS domain, list(DISTINCT type) AS lists, max(t_ms) AS last_seen FROM votes GROUP BY 1)"""


def _registry(votes):
    by = votes.groupBy("master").agg(F.max("t_ms").alias("last_seen"), F.collect_set("type").alias("lists"))  # four types at most
    return by.withColumn("domain", F.when(F.col("last_seen") % 4 > 0, F.concat(F.lower("master"), F.lit(".example"))).otherwise(""))


@query("votes", REGISTRY + " SELECT master, domain FROM m WHERE domain <> '' AND list_has_any(lists, ['missed', 'partial']) ORDER BY last_seen DESC, master LIMIT 12")
def watchlist(spark, sf_dir):
    return X.watchlist(_registry(V.votes(spark, sf_dir)), ["missed", "partial"])


@query("votes incident", REGISTRY + ", k AS (SELECT DISTINCT master FROM incident), g AS (SELECT * FROM m WHERE list_contains(lists, 'ok')) SELECT k.master, nullif(domain, '') AS domain, g.master IS NOT NULL AS matched FROM k LEFT JOIN g USING (master)")
def listed_masters(spark, sf_dir):
    return X.listed_masters(V.incident(spark, sf_dir), _registry(V.votes(spark, sf_dir)).where(F.array_contains("lists", "ok")))


@query("", """WITH n AS (SELECT DISTINCT concat('  ', lower(n_name)) AS name FROM nation UNION SELECT DISTINCT upper(concat(substr(n_name, 1, 2), n_regionkey)) FROM nation), a AS (SELECT concat(substr(n_name, 1, 2), n_regionkey) AS alias, min(n_name) AS country FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1)
    SELECT name, coalesce(c.n_name, a.country) AS country FROM n LEFT JOIN nation c ON lower(c.n_name) = lower(trim(name)) LEFT JOIN a ON lower(alias) = lower(trim(name))""")
def country_match(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    short = F.concat(F.substring("n_name", 1, 2), "n_regionkey")
    names = n.select(F.concat(F.lit("  "), F.lower("n_name")).alias("name")).union(n.select(F.upper(short)))
    return X.matched_countries(names, n.select(F.col("n_name").alias("country")), n.where("n_nationkey % 2 = 0").select(short.alias("alias"), F.col("n_name").alias("country")))


@query("sample", "SELECT cast(count(*) AS bigint) AS blocks, cast(sum(tx_count) AS bigint) AS txns, count(*) FILTER (findings > 0) AS flagged FROM sample")
def window_totals(spark, sf_dir):
    b = V.sample(spark, sf_dir).select(F.lit(1).alias("blocks"), F.col("tx_count").alias("txns"), (F.col("findings") > 0).cast("int").alias("flagged"))
    return X.window_totals(b, "blocks", "txns", "flagged")


@query("txn finding", """WITH f AS (SELECT address AS key, list(DISTINCT rule_id) AS rules FROM finding GROUP BY 1), s AS (SELECT account AS key, max(ledger_seq) AS last_seen FROM txn GROUP BY 1)
    SELECT key, last_seen, coalesce(list_has_any(rules, ['balance']), false) AS fraud FROM s LEFT JOIN f USING (key) ORDER BY fraud DESC, last_seen DESC, key LIMIT 50""")
def fraud_first(spark, sf_dir):
    rules = V.finding(spark, sf_dir).groupBy(F.col("address").alias("key")).agg(F.collect_set("rule_id").alias("rules"))  # as many as there are rules at most
    last = V.txn(spark, sf_dir).groupBy(F.col("account").alias("key")).agg(F.max("ledger_seq").alias("last_seen"))
    return X.fraud_first(last.join(rules, "key", "left"), ["balance"], 50)


@query("", """WITH o AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS hash, round(l_extendedprice * 100) AS drops, l_quantity AS q, l_returnflag = 'A' AS bad, l_returnflag = 'R' AS turned FROM lineitem)
    SELECT hash, CASE WHEN NOT bad THEN round(drops / q, 6) END AS rate, NOT turned AS same FROM o""")
def fill_rates(spark, sf_dir):
    """Line items as fills of drops against an issued asset, either way round; the code of some is not valid."""
    t = V.table(spark, sf_dir, "lineitem")
    text = lambda c: F.lit(c).cast("string")
    drops = F.struct(text(None).alias("currency"), text(None).alias("issuer"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string").alias("value"))
    other = F.struct(F.when(F.col("l_returnflag") == "A", "ab").otherwise("ABC").alias("currency"), F.lit("S1").alias("issuer"), F.col("l_quantity").cast("string").alias("value"))
    turned = F.col("l_returnflag") == "R"
    rate = F.when(turned, A.fill_rate(drops, other)).otherwise(A.fill_rate(other, drops))
    same = A.pays_same_asset(F.lit(None).cast("array<string>"), F.when(turned, other), drops)
    return t.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("hash"), F.round(rate, 6).alias("rate"), same.alias("same"))
