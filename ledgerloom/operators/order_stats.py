"""Ranks and medians from histograms with prefix counts: no group of values is gathered, whatever its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .iterate import kept


def ranked_values(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, below, total) of each distinct value: how often it occurs in its group, how many are smaller, how many there are. Nulls don't count.

    The histogram is dealt out by ranges of group and value; only the ranges' sums meet in one window.
    """
    hist = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    dealt = kept(hist.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    groups = Window.partitionBy(*by)
    sizes = dealt.groupBy(*by, "_part").agg(F.sum("n").alias("m"))
    sizes = sizes.select(*by, "_part", F.coalesce(F.sum("m").over(groups.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("m").over(groups).alias("total"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
    j = dealt.withColumn("_within", within).alias("d").join(sizes.alias("s"), same & (F.col("d._part") == F.col("s._part")))
    return j.select(*(F.col(f"d.{c}").alias(c) for c in [*by, value, "n"]), (F.col("_before") + F.col("_within")).alias("below"), "total")


def at_places(ranked: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, total, names): the values at places (from 0, of `total`) of each group's order; null beyond its ends. One row for each group."""
    hit = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value)))
    return ranked.groupBy(*by).agg(F.max("total").alias("total"), *(hit(k).alias(name) for name, k in places.items()))


def others_median(rows: DataFrame, by: list[str], value: str, sample: Column, out: str, least: int = 1) -> DataFrame:
    """rows with `out`, the median of the samples of its group without the row's own, and `out`_samples, their number; null below `least` of them.

    Rows that are no samples (or have no value) are held against all. Leaving out one value moves a place of the order by one at most, so six
    order statistics a group answer every row.
    """
    rows = kept(rows.withColumn("_is", F.coalesce(sample, F.lit(False)) & F.col(value).isNotNull()))
    t = F.col("total")
    half = lambda x: F.floor(x / 2)
    places = {"_a": half(t - 2), "_a1": half(t - 2) + 1, "_b": half(t - 1), "_b1": half(t - 1) + 1, "_c": half(t - 1), "_d": half(t)}
    stats = at_places(ranked_values(rows.where("_is"), by, value), by, value, places)
    if by:
        left, right = rows.alias("l"), stats.alias("r")
        same = F.lit(True)
        for c in by:
            same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        j = left.join(right, same, "left").select("l.*", *(f"r.{c}" for c in ["total", *places]))
    else:
        j = rows.crossJoin(F.broadcast(stats))  # one row
    rest = lambda k: F.when(F.col(k) < F.col(value), F.col(k)).otherwise(F.col(f"{k}1"))
    n = F.coalesce("total", F.lit(0)) - F.col("_is").cast("int")
    median = F.when(F.col("_is"), (rest("_a") + rest("_b")) / 2).otherwise((F.col("_c") + F.col("_d")) / 2)
    return j.withColumn(f"{out}_samples", n.cast("bigint")).withColumn(out, F.when(F.col(f"{out}_samples") >= max(least, 1), median)).drop("_is", "total", *places)


def percentile_row(ranked: DataFrame, value: str, share: float, out: str) -> DataFrame:
    """One row (total, out): the interpolated percentile of an ungrouped histogram."""
    at = (F.col("total") - 1) * share
    r = at_places(ranked, [], value, {"_low": F.floor(at), "_high": F.ceil(at)})
    at = (F.col("total") - 1) * share
    return r.select("total", F.when(F.ceil(at) == F.floor(at), F.col("_low")).otherwise((F.ceil(at) - at) * F.col("_low") + (at - F.floor(at)) * F.col("_high")).alias(out))
