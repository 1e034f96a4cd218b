"""Ledger-like views of the driver tables, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment for each line item: a customer pays a supplier, returned goods flow back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    t = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    customer, supplier, back = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("S"), "l_suppkey"), F.col("l_returnflag") == "R"
    return t.select(
        F.when(back, supplier).otherwise(customer).alias("account"),
        F.when(back, customer).otherwise(supplier).alias("destination"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_drops"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("ledger_seq"),
        F.when(F.col("l_linestatus") == "F", "Payment").otherwise("EscrowCreate").alias("type"),
        F.col("l_linenumber").cast("bigint").alias("tag"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("hash"),
        F.col("l_partkey").alias("pair"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


def finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: a negative balance marks an account, a low one in a segment leaves a note."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("address"), F.col("c_acctbal").alias("b"), F.col("c_mktsegment").alias("s"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("address"), F.col("s_acctbal").alias("b"), F.lit("").alias("s"))
    low = c.unionByName(s).where("b < 0")
    worst = low.select("address", F.when(F.col("b") < -500, "malicious").otherwise("suspect").alias("severity"), F.lit("balance").alias("rule_id"))
    return worst.unionByName(low.where("s = 'BUILDING'").select("address", F.lit("info").alias("severity"), F.lit("segment").alias("rule_id")))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: address, country, region, kind, tier (a supplier's or customer's nation)."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("address"), F.col("c_nationkey").alias("k"), F.when(F.col("c_acctbal") > 9000, "cold").otherwise("hot").alias("tier"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("address"), F.col("s_nationkey").alias("k"), F.lit("hot").alias("tier"))
    return c.unionByName(s).join(n, F.col("k") == F.col("n_nationkey")).select("address", F.col("n_name").alias("country"), F.col("r_name").alias("region"), "tier")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("t_ms", F.expr("unix_micros(cast(ts AS timestamp)) DIV 1000"))


def handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user hands on to the user of the next event of the same hour: a graph of small steps.

    The window is partitioned by the hour, so no task sees more than an hour.
    """
    e = events(spark, sf_dir).withColumn("hour", F.expr("t_ms DIV 3600000"))
    w = Window.partitionBy("hour").orderBy("event_id")
    e = e.withColumn("to_user", F.lead("user_id").over(w))
    return e.where("to_user IS NOT NULL").select(
        F.concat(F.lit("U"), "user_id").alias("account"),
        F.concat(F.lit("U"), "to_user").alias("destination"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_drops"),
        F.col("event_id").alias("ledger_seq"),
        "t_ms",
        F.concat(F.lit("H"), "event_id").alias("hash"),
    )


def incident(spark: SparkSession, sf_dir: str, cell_ms: int = 600_000) -> DataFrame:
    """Validator incidents: a ledger is a cell of ten minutes, a master a user; ok rows are left out."""
    return votes(spark, sf_dir, cell_ms).where("type <> 'ok'")


def votes(spark: SparkSession, sf_dir: str, cell_ms: int = 600_000) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.create_map(*(F.lit(x) for x in ("error", "missed", "signup", "partial", "purchase", "wrong-hash")))
    return e.select(F.expr(f"t_ms DIV {cell_ms}").alias("ledger"), F.concat(F.lit("V"), "user_id").alias("master"), "t_ms", F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("ok")).alias("type"))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger samples: an hour is a ledger."""
    e = events(spark, sf_dir)
    return e.groupBy(F.expr("t_ms DIV 3600000").alias("ledger")).agg(F.max("t_ms").alias("close_ms"), F.count("*").alias("tx_count"), F.count_if(F.col("event_type") == "error").alias("findings"))


#: The same views in DuckDB SQL; each may use those before it.
SQL = {
    "txn": """SELECT CASE WHEN l_returnflag = 'R' THEN concat('S', l_suppkey) ELSE concat('C', o_custkey) END AS account,
        CASE WHEN l_returnflag = 'R' THEN concat('C', o_custkey) ELSE concat('S', l_suppkey) END AS destination,
        cast(round(l_extendedprice * 100) AS bigint) AS amount_drops, date_diff('day', DATE '1995-01-01', cast(l_shipdate AS date)) AS ledger_seq,
        CASE WHEN l_linestatus = 'F' THEN 'Payment' ELSE 'EscrowCreate' END AS type, cast(l_linenumber AS bigint) AS tag,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS hash, l_partkey AS pair, l_quantity AS quantity, l_extendedprice AS price
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "low": """SELECT concat('C', c_custkey) AS address, c_acctbal AS b, c_mktsegment AS s FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT concat('S', s_suppkey), s_acctbal, '' FROM supplier WHERE s_acctbal < 0""",
    "finding": """SELECT address, CASE WHEN b < -500 THEN 'malicious' ELSE 'suspect' END AS severity, 'balance' AS rule_id FROM low
        UNION ALL SELECT address, 'info', 'segment' FROM low WHERE s = 'BUILDING'""",
    "flag": """SELECT address, max(CASE severity WHEN 'malicious' THEN 3 WHEN 'suspect' THEN 2 ELSE 1 END) AS r FROM finding GROUP BY 1""",
    "edge": """SELECT t.*, greatest(coalesce(a.r, 1), coalesce(b.r, 1)) AS r, a.r AS ra, b.r AS rb FROM txn t
        LEFT JOIN flag a ON a.address = account LEFT JOIN flag b ON b.address = destination
        WHERE (a.r IS NOT NULL OR b.r IS NOT NULL) AND account <> destination""",
    "reg": """SELECT concat('C', c_custkey) AS address, n_name AS country, r_name AS region, CASE WHEN c_acctbal > 9000 THEN 'cold' ELSE 'hot' END AS tier
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT concat('S', s_suppkey), n_name, r_name, 'hot' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ev": "SELECT *, epoch_us(ts) // 1000 AS t_ms FROM events",
    "handoff": """SELECT concat('U', user_id) AS account, concat('U', n) AS destination, cast(round(value * 100) AS bigint) AS amount_drops,
        event_id AS ledger_seq, t_ms, concat('H', event_id) AS hash
        FROM (SELECT *, lead(user_id) OVER (PARTITION BY t_ms // 3600000 ORDER BY event_id) AS n FROM ev) WHERE n IS NOT NULL""",
    "votes": """SELECT t_ms // 600000 AS ledger, concat('V', user_id) AS master, t_ms,
        CASE event_type WHEN 'error' THEN 'missed' WHEN 'signup' THEN 'partial' WHEN 'purchase' THEN 'wrong-hash' ELSE 'ok' END AS type FROM ev""",
    "incident": "SELECT * FROM votes WHERE type <> 'ok'",
    "sample": """SELECT t_ms // 3600000 AS ledger, max(t_ms) AS close_ms, count(*) AS tx_count, count(*) FILTER (event_type = 'error') AS findings FROM ev GROUP BY 1""",
}

_NEEDS = {"finding": ["low"], "flag": ["low", "finding"], "edge": ["txn", "low", "finding", "flag"], "handoff": ["ev"], "votes": ["ev"], "incident": ["ev", "votes"], "sample": ["ev"]}


def with_views(views: str, body: str) -> str:
    """body behind the WITH list of the named views and of those they need; body may go on with further ones."""
    wanted = {x for v in views.split() for x in [*_NEEDS.get(v, []), v]}
    head = ", ".join(f"{k} AS ({v})" for k, v in SQL.items() if k in wanted)
    body = body.strip()
    return f"WITH RECURSIVE {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH RECURSIVE {head} {body}"
