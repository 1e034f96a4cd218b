"""How far back an archive by days has to be read for a window of ledgers, from block statistics, and that read.

Archived rows lie in folders by day with `from_ledger`, the first ledger that a row covers. Days are read backwards in blocks;
reading stops with the block that reaches the window's first ledger, or with the allowed number of blocks. What was not read is
said: `covered`, `truncated`, `range_truncated`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Days of a block, and of the ranges that may be asked for.
BLOCK_DAYS = 31
RANGES = {"30d": 30, "90d": 90}


def day_statistics(rows: DataFrame) -> DataFrame:
    """(day, least, most, rows) of archived rows (day, from_ledger, to_ledger): what a reader needs to know without reading them."""
    return rows.groupBy("day").agg(F.min("from_ledger").alias("least"), F.max("to_ledger").alias("most"), F.count("*").alias("rows"))


def depth(windows: DataFrame, statistics: DataFrame, most_blocks: int = 2, block_days: int = BLOCK_DAYS) -> DataFrame:
    """windows with (blocks, days, covered, truncated, range_truncated).

    windows: (window, today, from_ledger, range_days), days as numbers, range_days null for "as deep as allowed". A window without a
    `from_ledger` is never covered, and days after its today don't count. Statistics are a row a day and meet each window on equal
    blocks only: at most `most_blocks` x `block_days` days a window.
    """
    c = F.col
    allowed = F.least(F.lit(most_blocks), F.coalesce(F.ceil(c("range_days") / block_days), F.lit(most_blocks))).cast("bigint")
    w = windows.withColumn("allowed", allowed)
    span = w.select("window", "today", "from_ledger", F.explode(F.sequence(F.lit(0).cast("bigint"), c("allowed") * block_days - 1)).alias("ago")).where(c("today").isNotNull())
    met = span.withColumn("day", c("today") - c("ago")).join(statistics.select("day", "least"), "day")
    reach = met.where(c("least") <= c("from_ledger")).groupBy("window").agg(F.min(F.floor(c("ago") / block_days)).alias("hit"))
    j = w.join(reach, "window", "left").withColumn("blocks", F.coalesce(c("hit") + 1, c("allowed")))
    covered, short = c("hit").isNotNull(), F.coalesce(c("blocks") * block_days < c("range_days"), F.lit(False))
    return j.select(*windows.columns, "blocks", (c("blocks") * block_days).alias("days"), covered.alias("covered"), (~covered | short).alias("truncated"), short.alias("range_truncated"))


def read_window(spark: SparkSession, path: str, statistics: DataFrame, today: int, from_ledger: int, to_ledger: int, range_name: str | None = None, most_blocks: int = 2) -> tuple[DataFrame, dict]:
    """(rows of the archive at path that overlap the window, the window's flags).

    One row of flags passes through the driver; the filter on `day` prunes the archive's folders to the blocks needed.
    """
    if from_ledger > to_ledger or (range_name is not None and range_name not in RANGES):
        raise ValueError("no such window")
    asked = spark.createDataFrame([(0, today, from_ledger, RANGES.get(range_name))], "window int, today bigint, from_ledger bigint, range_days bigint")
    flags = depth(asked, statistics, most_blocks).first().asDict()
    days = spark.read.parquet(path).where(F.col("day").between(today - flags["days"] + 1, today))
    return days.where((F.col("from_ledger") <= to_ledger) & (F.col("to_ledger") >= from_ledger)), flags


def write_archive(rows: DataFrame, path: str, parts: int = 8) -> None:
    """Archived rows in folders by day; a day is written by up to `parts` tasks, so that a full one doesn't meet in one."""
    salt = F.pmod(F.xxhash64(*[x for x in rows.columns if x != "day"]), F.lit(parts))
    rows.repartition("day", salt).write.mode("overwrite").partitionBy("day").parquet(path)
