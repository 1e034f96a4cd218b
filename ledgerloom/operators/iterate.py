"""Iteration over tables: components, bounded walks and reachability."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F


def _folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir (a temporary one only where it is unset)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of spark.checkpoint.dir."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df computed once and kept there as a Parquet table: for many rows, as later steps read only the columns they need."""
    path = f"{_folder(df)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 1 << 20) -> bool:
    """Whether df, which should be a kept one, has at most `most` rows, so that it may be broadcast."""
    return df.count() <= most


def narrow(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df, marked to be broadcast if it has at most `most` rows."""
    return F.broadcast(df) if small(df, most) else df


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of nodes with an edge to another node; root is the smallest node of the component.

    Rounds hook nodes to their smallest neighbour, double the pointers until they end at roots, and
    contract the graph.
    """
    pair = edges.where(F.col(left) != F.col(right)).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()
    pair, labels = kept(pair), None
    while not pair.isEmpty():
        both = pair.select(F.col("a").alias("node"), F.col("b").alias("o")).unionByName(pair.select(F.col("b").alias("node"), F.col("a").alias("o")))
        hop = kept(both.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least("node", "o").alias("root")))
        moving = True
        while moving:
            nxt = hop.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            hop = kept(hop.join(nxt, "root").select("node", F.col("onward").alias("root"), (F.col("onward") != F.col("root")).alias("moved")))
            moving = not hop.where("moved").isEmpty()
            hop = hop.select("node", "root")
        onward = hop.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        labels = hop if labels is None else kept(labels.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root")))
        for end in ("a", "b"):
            pair = pair.join(hop.select(F.col("node").alias(end), F.col("root").alias("r")), end).drop(end).withColumnRenamed("r", end)
        pair = kept(pair.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return pair.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
