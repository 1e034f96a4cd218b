"""Views of clusters and threats: merging, sanitizing, geometry, capped drawings, replays."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .iterate import kept, narrow, stored


def merge_views(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cluster views (cluster, members array, total_drops): members united, the larger total kept."""
    n = new.select("cluster", F.col("members").alias("m"), F.col("total_drops").alias("t"))
    none = F.array().cast("array<string>")
    return old.join(n, "cluster", "full_outer").select("cluster", F.array_sort(F.array_union(F.coalesce("members", none), F.coalesce("m", none))).alias("members"), F.greatest("total_drops", "t").alias("total_drops"))


def evidence_refs(items: Column) -> Column:
    """Evidence as E-1, E-2, .. followed by its text."""
    return F.transform(items, lambda e, i: F.concat(F.lit("E-"), (i + 1).cast("string"), F.lit(" "), e))


def threats(edges: DataFrame) -> DataFrame:
    """Of each flagged sender: risk, distinct reasons in order, first seen, receivers."""
    reason = F.concat(F.col("type"), F.lit(":"), F.col("severity"))
    return edges.where("from_rank >= 2").groupBy(F.col("account").alias("address")).agg(F.max("from_rank").alias("risk"), F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons"), F.min("ledger_seq").alias("first_seen"), F.countDistinct("destination").alias("receivers"))


def rules_of(cluster: DataFrame) -> DataFrame:
    """cluster (.., drainers, collectors, cycles) with the rules that its evidence stands for."""
    found = F.array_compact(F.array(F.when(F.col("drainers") > 0, "drainer-sweep"), F.when(F.col("collectors") > 0, "mass-sweep-convergence"), F.when(F.col("cycles") > 0, "wash-cycle")))
    return cluster.withColumn("rules", F.array_join(found, ","))


def centroids(points: DataFrame) -> DataFrame:
    """Centroid of each ring (ring, n, x, y: corners in order) by the shoelace formula."""
    w = Window.partitionBy("ring").orderBy("n")
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(w)), F.coalesce(F.lead("y").over(w), F.first("y").over(w))
    step = points.withColumn("nx", nx).withColumn("ny", ny).withColumn("c", F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    by = step.groupBy("ring").agg((F.sum("c") / 2).alias("area"), F.sum((F.col("x") + F.col("nx")) * F.col("c")).alias("sx"), F.sum((F.col("y") + F.col("ny")) * F.col("c")).alias("sy"))
    return by.where("area <> 0").select("ring", F.round(F.abs("area"), 4).alias("area"), F.round(F.col("sx") / (6 * F.col("area")), 4).alias("cx"), F.round(F.col("sy") / (6 * F.col("area")), 4).alias("cy"))


def fresh_evidence(snapshots: DataFrame, recent: int = 21_600, strict: int = 3) -> DataFrame:
    """Accounts whose last change lies at most `recent` ledgers before the snapshot and that are young (sequence)."""
    age = F.col("snapshot_ledger") - F.col("previous_ledger")
    return snapshots.where(age.between(0, recent)).withColumn("strict", F.col("sequence") <= strict).select("address", age.alias("age"), "strict")


def _turns(bound: list[int], senders: list[int], starts: list[int], most: int | None = None) -> Iterator[tuple[int, Sequence[int]]]:
    """The walks from all starts as turns of one line, ends first: (kept, nodes) cuts it back to its first `kept` nodes and adds nodes.

    The line then is the walk from the last of them, which is a start or lies on a start's way. A walk is that from the node's
    first sender and the node itself, unless the node is on that walk already: only such nodes, and one of each circle
    of first senders, are walked hop by hop, a hop further than `most`. Of each line the first most + 1 hops count.
    """
    n = len(bound) - 1
    first = [senders[i] if i < k else -1 for i, k in zip(bound, bound[1:])]
    reached, height, done, on_line = [0] * n, [0] * n, bytearray(n), bytearray(n)
    after, beside = [-1] * n, [-1] * n  # a node that goes to this one first, another that goes where this one goes
    roots, line = [], []
    for turn, node in enumerate(starts, 1):
        while not reached[node]:
            reached[node] = turn
            to = first[node]
            if to < 0:
                break
            beside[node], after[to] = after[to], node
            node = to
        if reached[node] == turn:  # nobody sends to it, or the way came back to it
            roots.append(node)
    while roots:
        for x in line:
            on_line[x] = 0
        root = roots.pop()
        line = [root]
        on_line[root] = done[root] = 1
        while (most is None or len(line) <= most + 1) and (on := next((x for x in senders[bound[line[-1]] : bound[line[-1] + 1]] if not on_line[x]), None)) is not None:
            line.append(on)
            on_line[on] = 1
        line.reverse()
        yield 0, line
        height[root] = len(line)
        todo, node = [], after[root]
        while node >= 0 or todo:
            if node < 0:
                node = todo.pop()
            if beside[node] >= 0:
                todo.append(beside[node])
            if done[node]:
                node = -1
                continue
            done[node], kept = 1, height[first[node]]
            while len(line) > kept:
                on_line[line.pop()] = 0
            if on_line[node]:
                roots.append(node)
                node = -1
                continue
            line.append(node)
            on_line[node], height[node] = 1, kept + 1
            yield kept, (node,)
            node = after[node]


def _followed(most: int | None, joined: str | None, size: int = 16 << 20):
    """A group's walks: rows with a place are the senders of a tip in the order of their earliest edges, rows without one are starts.

    The line of walks is held as bytes, written from their ends to the left, so that a path is one copy; memory is the graph's, a line's and a batch's.
    """
    glue = (joined or "").encode()

    def batch(by: pa.Scalar, address: pa.Array, data: bytearray, ends: list[int], words: list[np.ndarray], hops: list[int], truncated: list[bool]) -> pa.RecordBatch:
        ints = lambda x: pa.py_buffer(np.asarray(x, np.int32))
        if joined is None:
            texts = pa.StringArray.from_buffers(ends[-1], ints(np.concatenate([[0], *words])), pa.py_buffer(data))
            path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts)
        else:
            path = pa.StringArray.from_buffers(len(hops), ints(ends), pa.py_buffer(data))
        return pa.RecordBatch.from_arrays([pa.repeat(by, len(hops)), address, path, pa.array(truncated, pa.bool_()), pa.array(hops, pa.int64())], ["by", "address", "path", "truncated", "hops"])

    def walks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        names = pa.chunked_array([*rows["tip"].chunks, *rows["account"].chunks]).combine_chunks().dictionary_encode("encode")
        codes, place = names.indices.to_numpy(), rows["place"].fill_null(0).to_numpy()
        tip, account = codes[: len(rows)], codes[len(rows) :]
        order = np.lexsort((place, tip))
        order = order[place[order] > 0]
        starts, labels = tip[place == 0].tolist(), [(x or "").encode() + glue for x in names.dictionary.to_pylist()]
        bound, wanted = np.searchsorted(tip[order], np.arange(len(labels) + 1)).tolist(), bytearray(len(labels))
        for x in starts:
            wanted[x] = 1
        line, begin = memoryview(bytearray(sum(map(len, labels)))), array("q", bytes(8 * (len(labels) + 1)))
        begin[0], begins = len(line), np.frombuffer(begin, np.int64)
        data, ends, words, hops, truncated, found = bytearray(), [0], [], [], [], []
        for top, nodes in _turns(bound, account[order].tolist(), starts, most):
            for node in nodes:
                begin[top + 1] = begin[top] - len(labels[node])
                line[begin[top + 1] : begin[top]] = labels[node]
                top += 1
            if not wanted[node]:
                continue
            last = 0 if most is None else max(0, top - 1 - most)
            if joined is None:
                words.append(begins[last:top][::-1] - begin[top] + len(data))
            data += line[begin[top] : begin[last] - len(glue)]
            ends.append(len(data) if joined is not None else ends[-1] + top - last)
            found.append(node)
            hops.append(top - 1 - last)
            truncated.append(last > 0)
            if max(len(data), 4 * ends[-1]) >= size:
                yield batch(key[0], names.dictionary.take(pa.array(found)), data, ends, words, hops, truncated)
                data, ends, words, hops, truncated, found = bytearray(), [0], [], [], [], []
        if found:
            yield batch(key[0], names.dictionary.take(pa.array(found)), data, ends, words, hops, truncated)

    return walks


def replay(start: DataFrame | None, edges: DataFrame, by: str, most: int | None = 200, at_once: int = 6, held: int = 2_000_000, dealt: int = 500_000, joined: str | None = None) -> DataFrame:
    """Backward walks: from each start (by, address; None: every receiver) to the sender of its earliest in-edge that was not visited yet, `most` hops at most (None: to their ends).

    edges: (by, account, destination, ledger_seq, hash). Returns (by, address, path, truncated, hops), the path as an array or, with `joined` between
    its accounts, as a string; truncated walks could go on. A path of h hops shuts out h senders, so of a node's senders, each with its
    earliest edge, only the first most + 1 are looked at. The starts of a graph are dealt to tasks by about `dealt`,
    which hold its pairs of sender and receiver; graphs of more than `held` pairs are walked by a join a hop, kept every `at_once` hops.
    """
    earliest = edges.where("account <> destination").groupBy(by, F.col("destination").alias("tip"), "account").agg(F.min(F.struct("ledger_seq", "hash", "account")).alias("e"))
    ranked = earliest.withColumn("place", F.row_number().over(Window.partitionBy(by, "tip").orderBy("e")))
    step = stored((ranked if most is None else ranked.where(F.col("place") <= most + 1)).select(by, "tip", "place", "account"))
    starts = step.where("place = 1").select(by, F.col("tip").alias("address")) if start is None else start.select(by, "address").distinct()
    large = kept(step.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("pairs")).where(F.col("pairs") > held).select(by))
    small = starts.join(large, by, "left_anti")
    parts = narrow(kept(small.groupBy(F.col(by).alias("by")).agg(F.ceil(F.count("*") / dealt).cast("int").alias("parts"))))
    tasks = parts.agg(F.sum("parts")).first()[0] or 1
    rows = small.join(parts, F.col(by).eqNullSafe(F.col("by"))).select("by", F.pmod(F.xxhash64("address"), "parts").cast("int").alias("part"), F.col("address").alias("tip"), F.lit(None).cast("string").alias("account"), F.lit(None).cast("int").alias("place"))
    graph = step.join(parts, F.col(by) == F.col("by")).select("by", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tip", "account", "place")
    schema = f"by {step.schema[by].dataType.simpleString()}, address string, path {'array<string>' if joined is None else 'string'}, truncated boolean, hops bigint"
    dealt_out = rows.unionByName(graph).repartition(min(tasks, 4096), "by", "part")  # by their number: what they read is small beside what they return
    done = dealt_out.groupBy("by", "part").applyInArrow(_followed(most, joined), schema).withColumnRenamed("by", by)
    if not large.isEmpty():
        far = _joined(starts.join(large, by, "left_semi"), step.join(large, by, "left_semi"), by, most, at_once).withColumn("hops", (F.size("path") - 1).cast("bigint"))
        done = done.unionByName(far if joined is None else far.withColumn("path", F.array_join("path", joined)))
    return done


def _joined(starts: DataFrame, step: DataFrame, by: str, most: int | None, at_once: int) -> DataFrame:
    """The walks (by, address, path, truncated) by a join for each hop."""
    level, done = kept(starts.select(by, "address", F.array("address").alias("path"))), None
    for hop in count():
        on = level.withColumn("tip", F.element_at("path", -1)).join(step.where(F.col("place") <= hop + 1), [by, "tip"], "left")
        usable = F.when(~F.array_contains("path", F.col("account")), F.struct("place", "account"))
        on = on.groupBy(by, "address", "path").agg(F.min(usable).alias("e"))
        if hop % at_once == 0 or hop == most:
            on = kept(on)
        ended = on.where("true" if hop == most else "e IS NULL").select(by, "address", "path", F.col("e").isNotNull().alias("truncated"))
        done = ended if done is None else done.unionByName(ended)
        level = on.where("e IS NOT NULL").select(by, "address", F.concat("path", F.array("e.account")).alias("path"))
        if hop % at_once == 0:
            done = kept(done)
            if level.isEmpty():
                return done
        if hop == most:
            return done


def capped_nodes(nodes: DataFrame, edges: DataFrame, by: str, budget: int = 600, floor: int = 120) -> DataFrame:
    """Of each drawing at most `budget` nodes: (by, address, phase), where all fit with phase all.

    nodes: (by, address, severity, role, drops); edges: (by, account, destination, amount_drops, ledger_seq,
    hash). First up to `floor` nodes of evidence (malicious, source, collector, drainer), then both ends of
    the heaviest edges while they fit, then the gravest nodes. An edge adds nodes only if it is the heaviest
    of one of its ends, so the `budget` first of these and their running count give what the walk over all
    edges takes; where one place is left over, the heaviest edge with one end inside fills it.
    """
    nodes = nodes.withColumn("s", F.when(F.col("severity") == "malicious", 2).when(F.col("severity") == "suspect", 1).otherwise(0)).withColumn("r", F.coalesce(F.array_position(F.array(*map(F.lit, ("relay", "source", "collector", "drainer"))), F.col("role")).cast("int"), F.lit(0)))
    sizes = nodes.groupBy(by).agg(F.count("*").alias("nodes"))
    nodes = kept(nodes.join(sizes, by))
    all_fit = nodes.where(F.col("nodes") <= budget).select(by, "address", F.lit("all").alias("phase"))
    large = nodes.where(F.col("nodes") > budget)
    rank = lambda *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    proven = large.where("s = 2 OR r >= 2").withColumn("n", rank(F.desc("s"), F.desc("r"), "address")).where(F.col("n") <= min(floor, budget)).select(by, "address")
    proven = kept(proven)
    weight = F.greatest(F.coalesce("amount_drops", F.lit(0)), F.lit(0))
    order = F.struct((-weight).alias("w"), F.coalesce("ledger_seq", F.lit(-1)).alias("l"), "hash", "account", "destination")
    inside = large.select(by, "address")
    e = edges.where("account <> destination").select(by, "account", "destination", order.alias("at"))
    for end in ("account", "destination"):
        e = e.join(inside.withColumnRenamed("address", end), [by, end], "left_semi")
    e = kept(e.select(by, "account", "destination", "at"))
    ends = e.select(by, F.explode(F.array("account", "destination")).alias("address"), "at").groupBy(by, "address").agg(F.min("at").alias("at")).join(proven, [by, "address"], "left_anti")
    steps = ends.groupBy(by, "at").agg(F.count("*").alias("adds")).withColumn("n", rank("at")).where(F.col("n") <= budget)
    size = proven.groupBy(by).agg(F.count("*").alias("held"))
    running = F.sum("adds").over(Window.partitionBy(by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    taken = steps.join(size, by, "left").withColumn("total", F.coalesce("held", F.lit(0)) + running).where(F.col("total") <= budget).select(by, "at")
    chosen = proven.withColumn("phase", F.lit("evidence")).unionByName(ends.join(taken, [by, "at"], "left_semi").select(by, "address", F.lit("edge").alias("phase")))
    chosen = kept(chosen)
    short = chosen.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") == budget - 1).select(by)
    known = chosen.select(by, "address", F.lit(True).alias("in"))
    open_ = e.join(short, by, "left_semi").join(known.select(by, F.col("address").alias("account"), F.col("in").alias("a")), [by, "account"], "left").join(known.select(by, F.col("address").alias("destination"), F.col("in").alias("b")), [by, "destination"], "left")
    last = open_.where("(a IS NULL) <> (b IS NULL)").groupBy(by).agg(F.min(F.struct("at", F.when(F.col("a").isNull(), F.col("account")).otherwise(F.col("destination")).alias("address"))).alias("x"))
    chosen = kept(chosen.unionByName(last.select(by, F.col("x.address").alias("address"), F.lit("edge").alias("phase"))))
    left = chosen.groupBy(by).agg(F.count("*").alias("held"))
    rest = large.join(chosen, [by, "address"], "left_anti").withColumn("n", rank(F.desc("s"), F.desc(F.coalesce("drops", F.lit(0))), "address")).where(F.col("n") <= budget)
    fill = rest.join(left, by, "left").where(F.col("n") <= budget - F.coalesce("held", F.lit(0))).select(by, "address", F.lit("fill").alias("phase"))
    return all_fit.unionByName(chosen).unionByName(fill)
