"""Ordered rows in parts that overlap, for windows over a history that no single task should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def placed(rows: DataFrame, order: str, by: tuple[str, ...] = (), width: int = 10_000) -> DataFrame:
    """rows with `place`, their number from 0 on within `by` along the column `order`, of which each value occurs once.

    Rows are numbered within stretches of `width` values; only the stretches' counts meet in one window.
    """
    cut = rows.withColumn("_cut", F.expr(f"{order} DIV {width}"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
    offset = cut.groupBy(*by, "_cut").agg(F.count("*").alias("n")).select(*by, "_cut", F.coalesce(before, F.lit(0)).alias("_before"))
    return cut.join(offset, [*by, "_cut"]).withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_cut").orderBy(order)) - 1).drop("_cut", "_before")


def overlapping(rows: DataFrame, before: int, width: int = 10_000) -> DataFrame:
    """Placed rows dealt to parts of `width` places; each part also holds the `before` rows before it, marked as guests."""
    if not 0 < before <= width:
        raise ValueError("a part has to be as wide as what precedes it")
    own = F.expr(f"place DIV {width}")
    parts = F.array_compact(F.array(own, F.when(F.col("place") % width >= width - before, own + 1)))
    return rows.withColumn("part", F.explode(parts)).withColumn("guest", F.col("part") != own)
