"""Joins and limits in time: as-of, nearest, interval, sliding limits, strides, refreshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the last `value` of right at or before its time, by key: a union and one window, no range join."""
    both = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(key, time, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, within: int) -> DataFrame:
    """left with `distance` to the nearest time of right of the same key, null beyond `within`."""
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, time).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    seen = F.when(F.col("_side") == 0, F.col(time))
    w = Window.partitionBy(key).orderBy(time, "_side")
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    distance = F.least(F.col(time) - before, after - F.col(time))
    return both.withColumn("distance", distance).where("_side = 1").drop("_side").withColumn("distance", F.when(F.col("distance") <= within, F.col("distance")))


def in_runs(points: DataFrame, runs: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """points joined with the run (key, from_ledger, to_ledger, ..) that holds them; runs are dealt to the buckets they touch."""
    dealt = runs.withColumn("_b", F.explode(F.sequence(F.expr(f"from_ledger DIV {width}"), F.expr(f"to_ledger DIV {width}"))))
    return points.withColumn("_b", F.expr(f"{at} DIV {width}")).join(dealt, [key, "_b"]).where(F.col(at).between(F.col("from_ledger"), F.col("to_ledger"))).drop("_b")


def sliding_limit(requests: DataFrame, key: str, time: str, span: int, most: int) -> DataFrame:
    """requests with the number of the key's requests in the last `span` (itself included) and whether that is allowed."""
    w = Window.partitionBy(key).orderBy(time).rangeBetween(-span + 1, 0)
    return requests.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= most)


def strided(rows: DataFrame, by: str, order: list[str], budget: int) -> DataFrame:
    """Of each group the rows number floor(k n / budget), k = 0 .. budget - 1; all if there are no more than budget."""
    w = Window.partitionBy(by).orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    k = F.ceil(F.col("_rn") * budget / F.col("_n"))
    return ranked.where((F.col("_n") <= budget) | ((k < budget) & (F.floor(k * F.col("_n") / budget) == F.col("_rn")))).drop("_rn", "_n")


def due_for_refresh(addresses: DataFrame, snapshots: DataFrame, now: int, ttl: int, most: int) -> DataFrame:
    """Up to `most` addresses without a snapshot younger than ttl, in order."""
    fresh = snapshots.where(F.lit(now) - F.col("snapshot_at") < ttl).select("address").distinct()
    return addresses.select("address").distinct().join(fresh, "address", "left_anti").orderBy("address").limit(most)


def prorated(cells: DataFrame, start: Column, width: int, lo: int, hi: int, value: str) -> Column:
    """Sum of a value over cells, each by the share of it that lies in [lo, hi)."""
    overlap = F.greatest(F.lit(0), F.least(start + width, F.lit(hi)) - F.greatest(start, F.lit(lo)))
    return F.sum(F.col(value) * F.least(F.lit(1.0), overlap / width))


def job_windows(spark, first: int, last: int, size: int) -> DataFrame:
    """Replay jobs of `size` ledgers each: (from_ledger, to_ledger)."""
    return spark.range(first, last + 1, size).select(F.col("id").alias("from_ledger"), F.least(F.col("id") + size - 1, F.lit(last)).alias("to_ledger"))
