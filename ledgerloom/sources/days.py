"""Day-partitioned fact tables: pruned reads, idempotent writes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Days of each range; None is all.
RANGES = {"1h": 1, "24h": 1, "7d": 7, "30d": 30, "all": None}


def read_days(spark: SparkSession, path: str, today: str, span: str = "all", retention: int = 400) -> DataFrame:
    """The partitions of a range that ends today, newest `retention` days at most; the filter prunes folders."""
    days = min(RANGES[span] or retention, retention)
    return spark.read.parquet(path).where(F.col("day").between(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date")))


def write_days(df: DataFrame, path: str) -> None:
    """Replaces the partitions of df's days and leaves the others: running it again gives the same table.

    Rows are rebalanced by day, so small days share a task and a day that is too large for one is split.
    """
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def with_addendum(day: DataFrame, proofs: DataFrame, key: list[str], column: str) -> DataFrame:
    """day with `column` filled from proofs where it is unknown; known values stay. Of several proofs of a key the smallest value counts, nulls don't."""
    p = proofs.groupBy(*key).agg(F.min(column).alias("_p"))
    return day.join(p, key, "left").withColumn(column, F.coalesce(column, "_p")).drop("_p")


def write_csv_report(lines: DataFrame, path: str, header: str) -> None:
    """A report of CSV lines (column line) with CRLF line ends; every part file begins with the header."""
    def framed(batches):
        first = True
        import pyarrow as pa

        for b in batches:
            rows = [f"{x}\r" for x in b.column(0).to_pylist()]
            rows = [f"{header}\r", *rows] if first and rows else rows
            first = first and not rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    lines.select("line").mapInArrow(framed, "value string").write.mode("overwrite").text(path)
