"""SimHash near-duplicates: a binary trie self-join under a Hamming error budget.

Distribution. Fingerprints of 64 bits are cut into radius + j blocks; two that differ in at most `radius`
bits agree on j of them, so every fingerprint is dealt once for each choice of j blocks, and links are
looked for inside the groups of equal values only. j grows with the number of fingerprints, so evenly
spread ones make small groups at any size. A group larger than a chunk is dealt in chunks, one task for
each pair of chunks, which keeps tasks small however many near copies there are. In a task the sorted
fingerprints of a group form a binary trie whose nodes are ranges of the array; pairs of nodes descend together,
add up differing bits and end when the budget is exceeded. Links leave a task as a spanning forest,
never as all pairs, and connected components are found by table operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import agreeing, by_batch, components, fresh, materialized, signed, with_sizes

BITS = 64


def simhash_of(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text: a bit is set if it is set in over half of the shingles' XXH64.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are `width` words joined by
    a space, repeats included; fewer words make one shingle, none (or a null text) make zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        block = slice(at, at + (1 << 15))
        h = np.array([digest(view[s:e], seed) for s, e in zip(starts[block].tolist(), ends[block].tolist())], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fingerprint as a signed long) of every row; mark is a hash of the text."""

    def make():
        def f(cols):
            fps = np.fromiter((simhash_of(t) for t in cols["text"].to_pylist()), np.uint64, len(cols["text"]))
            return {"id": cols["id"], "mark": cols["mark"], "fingerprint": fps.view(np.int64)}

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return by_batch(rows, "id long, mark long, fingerprint long", make)


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels (each node's root, compressed) with the links i-j added."""
    while True:
        a, b = labels[i], labels[j]
        new = a != b
        if not new.any():
            return labels
        i, j, a, b = i[new], j[new], a[new], b[new]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further


def trie_components(keys: np.ndarray, starts: np.ndarray, radius: int, leaf: int = 64, most: int = 1 << 18) -> np.ndarray:
    """Root index of every key; keys (uint64) are sorted within the groups that begin at starts.

    A trie node is a range of the array whose keys share a prefix. Frontiers of node pairs are kept on a
    stack and cut to `most` pairs, so memory stays bounded; pairs of small nodes are compared directly.
    """
    n = len(keys)
    labels, ones = np.arange(n), {}
    lo, hi = np.asarray(starts), np.append(starts[1:], n)
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > most:
            for at in range(0, len(al), most):
                stack.append((depth, *(x[at : at + most] for x in (al, ah, bl, bh, err))))
            continue
        na, nb = ah - al, bh - bl
        small = (na * nb <= leaf) | (depth == BITS)
        if small.any():
            a0, b0, sa, sb = al[small], bl[small], na[small], nb[small]
            size = sa * sb
            pair = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            i, j = a0[pair] + k // sb[pair], b0[pair] + k % sb[pair]
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= radius)
            labels = _merge(labels, i[near], j[near])
        if small.all():
            continue
        al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        c = ones[depth]
        am, bm, own = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl]), al == bl
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), tuple(x[~own] for x in (am, ah, bl, bm, err + 1))]
        child = [np.concatenate(x) for x in zip(*parts)]
        keep = (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= radius) & ~((child[0] == child[2]) & (child[1] - child[0] < 2))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in child)))
    return labels


def dealt(distinct: DataFrame, masks: list[int], col: str, chunk: int) -> DataFrame:
    """distinct with a row for each mask and task: mask (its number), value, first, second (the chunks of the task).

    Only groups beyond a chunk have a row in the table of sizes.
    """
    rows = distinct.withColumn("dealt", F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.col(col).bitwiseAND(F.lit(signed(m)).cast("bigint")).alias("value")) for k, m in enumerate(masks))))).select("*", "dealt.mask", "dealt.value").drop("dealt")
    large = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("mask", "value", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    rows = with_sizes(rows, large, ["mask", "value"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64(col), F.col("chunks")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("first"), F.greatest(own, j).alias("second")))
    return rows.withColumn("task", F.explode(tasks)).select("*", "task.first", "task.second").drop("task", "chunks")


def rolled(fps: np.ndarray, mask: int) -> np.ndarray:
    """Fingerprints with the mask's bits first; the order of bits within both parts stays."""
    out, at = np.zeros_like(fps), BITS
    for part in (mask, ~mask & ((1 << BITS) - 1)):
        while part:  # runs of bits, from the highest
            high = part.bit_length()
            low = high
            while low and part >> (low - 1) & 1:
                low -= 1
            width = high - low
            at -= width
            out |= ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(at)
            part &= (1 << low) - 1
    return out


def links(distinct: DataFrame, radius: int = 4, chunk: int = 1024, flush: int = 1 << 16) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fingerprint): a spanning forest of every task's pairs.

    The join of all links connects exactly the fingerprints that a chain of pairs within radius connects.
    """
    masks = agreeing(BITS, radius, distinct.count(), max(1, chunk // 2))
    tasks = dealt(distinct.select("fingerprint"), masks, "fingerprint", chunk)
    keys = ["mask", "value", "first", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            turned = np.zeros_like(fps)
            for k in np.unique(ids[:, 0]).tolist():
                own = ids[:, 0] == k
                turned[own] = rolled(fps[own], masks[k])
            order = np.lexsort((turned, *ids.T[::-1]))
            ids, fps, turned = ids[order], fps[order], turned[order]
            starts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1])
            root = trie_components(turned, starts, radius)
            plain = fps.view(np.int64)
            least = np.full(len(fps), np.iinfo(np.int64).max)
            np.minimum.at(least, root, plain)
            to = least[root]
            moved = to != plain
            return pa.RecordBatch.from_arrays([pa.array(plain[moved]), pa.array(to[moved])], names=["a", "b"])

        kept: list = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            kept.append((np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1), b.column("fingerprint").to_numpy().view(np.uint64)))
            rows += b.num_rows
            if rows >= flush:
                ids, fps = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
                last = int(np.flatnonzero((ids != ids[-1]).any(axis=1))[-1]) + 1 if (ids != ids[-1]).any() else 0
                if last:
                    yield joined(ids[:last], fps[:last])
                kept = [(ids[last:], fps[last:])]
                rows = len(ids) - last
        if rows:
            yield joined(np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept]))

    return tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id) of every row of docs.

    component_id is the smallest id reachable over links of at most `radius` differing bits, the row's own
    included. Null and empty texts have fingerprint zero, which is linked like any other. Rows with a
    null id are linked through their fingerprint and get the smallest non-null id of their component
    (null where there is none); repeated rows and ids each keep their row; other columns are ignored.
    """
    fps, reps, roots = _linked(docs, id_col, text_col, radius)
    member = reps.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    linked = member.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = materialized(reps.join(linked.join(least, "root").select("fingerprint", "component"), "fingerprint", "left").select("fingerprint", F.coalesce("component", "least").alias("component")))
    return fps.join(named, "fingerprint", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _linked(docs: DataFrame, id_col: str, text_col: str, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows; distinct ones with the least id and the first row; (node, root) of those with links."""
    fps = materialized(fingerprints(docs, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "mark")).alias("first")
    reps = materialized(fps.groupBy("fingerprint").agg(F.min("id").alias("least"), first))
    return fps, reps, components(links(reps), "a", "b")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """docs with one row of each component: that with the smallest id (null ids last, equal ids by a hash of the text).

    Rows are told apart by id and text, so of two different texts under one id each is judged by its own
    fingerprint; of rows with equal id and text one stays. All columns are kept, whatever their names.
    """
    _, reps, roots = _linked(docs, id_col, text_col, radius)
    member = reps.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    key, copy = fresh(docs, "key"), fresh(docs, "copy")
    pair = lambda i, mark: F.struct(i.cast("long").alias("id"), mark.alias("mark"))
    kept = member.groupBy("root").agg(F.min("first").alias("first")).select(pair(F.col("first.id"), F.col("first.mark")).alias(key))
    own = docs.withColumn(key, pair(F.col(id_col), F.xxhash64(text_col))).join(materialized(kept), key, "left_semi")
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "variant", "array", "struct") and f.name not in (id_col, text_col)]
    copies = Window.partitionBy(key).orderBy(*(others or [F.lit(0)]))
    return own.withColumn(copy, F.row_number().over(copies)).where(F.col(copy) == 1).drop(key, copy)
