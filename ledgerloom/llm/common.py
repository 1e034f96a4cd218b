"""Pieces that several operators share."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def materialized(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shipped(spark: SparkSession, thing):
    """A function that gives thing again inside a task: it is broadcast with its classes, which executors need not have on their path."""
    state = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(state.value)


def agreeing(bits: int, radius: int, n: int, room: int) -> list[int]:
    """Masks of bits such that two numbers of `bits` bits within radius agree on all bits of one mask at least.

    The bits are cut into radius + j blocks, of which j agree; a mask takes j of them. j grows with the
    count n, so that a mask's values are many enough for n evenly spread numbers to have `room` a value.
    """
    for j in range(1, bits - radius + 1):
        cuts = [bits * k // (radius + j) for k in range(radius + j + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
        masks = [sum(some) for some in combinations(blocks, j)]
        if n <= room << min(m.bit_count() for m in masks):
            break
    return masks


def signed(x: int) -> int:
    """A 64-bit number as a signed long."""
    return x - (1 << 64) if x >> 63 else x


def with_sizes(rows: DataFrame, sizes: DataFrame, keys: list[str], how: str, most: int = 1 << 20) -> DataFrame:
    """rows joined with a table of group sizes, which is broadcast only if it has at most `most` rows."""
    sizes = materialized(sizes)
    return rows.join(F.broadcast(sizes) if sizes.limit(most + 1).count() <= most else sizes, keys, how)


def by_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Applies a function from columns (lists) to columns to every Arrow batch; make() runs once a task."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                out = f({n: b.column(n) for n in b.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in target], schema=target)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of an undirected graph of long ids: (node, root), root the smallest id.

    Only nodes of some edge between two different ids are returned; edges with a null end are ignored.
    Every round hooks each node to its smallest neighbour, follows the pointers to their roots by
    doubling, and contracts the graph, so stars end after one round and paths after logarithmically
    many. All state lives in tables.
    """
    a, b = F.col(left), F.col(right)
    edges = materialized(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hop = materialized(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root"), F.lit(True).alias("moved")))
        while True:
            to = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hop = materialized(hop.join(to, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            if hop.where("moved").isEmpty():
                break
        hop = hop.select("node", "root")
        if labels is None:
            labels = hop
        else:
            onward = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = materialized(labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        for end in ("a", "b"):
            to = hop.select(F.col("node").alias(end), F.col("root").alias("r"))
            edges = edges.join(to, end).drop(end).withColumnRenamed("r", end)
        edges = materialized(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
