"""Document fingerprints: weighted SimHash of word pairs, and a Hamming search in permuted block tables.

A term is a pair of neighbouring words (the word itself in texts of one word); each distinct term votes
with 1 + ln(occurrences) on the signed bits of its XXH3 hash. The search cuts fingerprints into
radius + j blocks: two fingerprints within the radius agree on j of them, so the tables of all choices of j
blocks, keyed by these blocks' values, bring every such pair together; j grows with the number of
fingerprints, so that keys stay rare. A pair counts in the first table that has it, and tables' large
groups are dealt in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import agreeing, materialized, signed, with_sizes

BITS = 128


def fingerprint(text: str | None) -> bytes:
    """16 bytes; zero for null texts and texts without a word. A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(BITS // 8)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > 1:
        starts, ends = starts[:-1], ends[1:]
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), np.uint8).reshape(-1, 16)
    _, at, n = np.unique(hashes[:, :8].copy().view(np.uint64)[:, 0], return_index=True, return_counts=True)
    distinct, weight = hashes[at], (1 + np.log(n)).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(distinct), 1 << 14):
        bits = np.unpackbits(distinct[at : at + (1 << 14)], axis=1).astype(np.float32)
        votes += (2 * (weight[at : at + (1 << 14)] @ bits) - weight[at : at + (1 << 14)].sum()).astype(np.float64)
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated cosine of two texts' term vectors, 0 to 1: the angle is the share of differing bits."""
    share = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS
    return float(max(0.0, np.cos(np.pi * share)))


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def order_hash(text: Column) -> Column:
    """What orders the texts of one id before the texts themselves do; it can be cut into even stretches."""
    return F.xxhash64(text)


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """docs' id and text dealt in order of id to about parts tasks, each followed by the first row of the next task.

    Columns id, text, guest; a task's rows are sorted with guests last. The last task's guest is the very
    first row. Null ids come first and, as ids that many rows have, are dealt to as many tasks as their share of the rows
    asks for, by stretches of the texts' hashes. Only cut points, counts and first ids, one a task, pass through the driver.
    Rows alike in id and text are neighbours in one task.
    """
    c = F.col
    rows = docs.select(c(id_col).cast("long").alias("id"), c(text_col).alias("text"))
    low, hashed = F.coalesce("id", F.lit(-(1 << 63))), order_hash(c("text"))
    least, most = -(1 << 63), (1 << 63) - 1
    points = sorted({max(least, min(most, int(x))) for x in rows.approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts)}) if parts > 1 else []

    def task(cuts: list[int]) -> Column:
        """0 for null ids, else 1 and the number of cuts up to the id."""
        passed = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in cuts)), lambda x: x <= c("id"))) if cuts else F.lit(0)
        return F.when(c("id").isNull(), 0).otherwise(passed + 1).cast("int")

    def counted(cuts: list[int]) -> dict:
        return {r["at"]: r for r in rows.select("id").groupBy(task(cuts).alias("at")).agg(F.count("*").alias("n"), F.min(low).alias("first")).collect()}

    cuts, found = points, counted(points)
    if not found:
        return rows.withColumn("guest", F.lit(False))
    share = max(1, sum(r["n"] for r in found.values()) // parts)
    crowded = [k for k, r in found.items() if k and r["n"] > share]
    alone = set()
    if crowded:  # ids with more than a share of the rows, fewer than there are parts
        alone = {r["id"] for r in rows.select("id").where(task(points).isin(crowded)).groupBy("id").agg(F.count("*").alias("n")).where(c("n") > share).collect()}
    if alone:
        cuts = sorted({*points, *alone, *(x + 1 for x in alone if x < most)})
        found = counted(cuts)
    split = {k: -(-r["n"] // share) for k, r in found.items() if (k == 0 or (k > 1 and cuts[k - 2] in alone)) and r["n"] > share}
    base, total = {}, 0
    for k in sorted(found):
        base[k], total = total, total + split.get(k, 1)
    at = task(cuts)
    pick = lambda of: F.create_map(*(F.lit(x) for k, v in of.items() for x in (k, v)))[at]
    slices = pick({k: split.get(k, 1) for k in found})
    place = pick(base) + F.when(slices > 1, F.least(slices - 1, F.floor((hashed / 2.0**64 + 0.5) * slices).cast("int"))).otherwise(0) if split else pick(base)
    firsts = {base[k]: (r["first"], None) for k, r in found.items() if k not in split}
    if split:
        hot = rows.where(at.isin(list(split))).groupBy(place.alias("at")).agg(F.min(low).alias("first"), F.min(hashed).alias("h"))
        firsts |= {r["at"]: (r["first"], r["h"]) for r in hot.collect()}
    filled = sorted(firsts)
    own_first = lambda k: F.create_map(*(x for f in filled for x in (F.lit(f), F.lit(firsts[f][k]).cast("long"))))[c("at")]
    leads = low == own_first(0)
    if split:
        leads &= F.coalesce(hashed == own_first(1), F.lit(True))
    before = F.create_map(*(F.lit(x) for k, p in zip(filled, [filled[-1], *filled[:-1]]) for x in (k, p)))
    own = F.struct(c("at"), F.lit(False).alias("guest"))
    guest = F.struct(before[c("at")].alias("at"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("at", place).withColumn("to", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own))))
    return dealt.select("id", "text", "to.at", "to.guest").repartitionById(total, c("at")).sortWithinPartitions("at", "guest", F.asc_nulls_first("id"), hashed, F.asc_nulls_first("text")).select("id", "text", "guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, hi, lo, edited_fingerprint, near_edited, near_next): every document, with its edited text and the next one.

    The next document is the one that follows by id (null ids first, equal ids by the XXH64 of the text, signed, seed 42 and itself for a null one, then by
    the text), after the last the first. hi and lo are the fingerprint's halves. Null texts count as empty.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = None

        def made(i, text: str, own: bytes, following: str, theirs: bytes) -> None:
            changed = edited(text, following)
            other = fingerprint(changed)
            hi, lo = np.frombuffer(own, ">i8").tolist()
            held.append((i, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), hi, lo, other.hex(), likeness(own, other), likeness(own, theirs)))

        def sent() -> pa.RecordBatch:
            t = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            b = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), t)], names=["id", "n_chars", "edited_sha256", "hi", "lo", "edited_fingerprint", "near_edited", "near_next"])
            held.clear()
            return b

        ended = False
        for b in batches:
            for i, text, guest in zip(*(b.column(c).to_pylist() for c in ("id", "text", "guest"))):
                if ended:
                    continue
                text = text or ""
                own = fingerprint(text)
                if last is not None:
                    made(*last, text, own)
                last, ended = (i, text, own), guest
            if held:
                yield sent()
        if held:
            yield sent()

    return with_next(docs, id_col, text_col, parts).mapInArrow(run, "id long, n_chars long, edited_sha256 string, hi long, lo long, edited_fingerprint string, near_edited double, near_next double")


def within(fps: DataFrame, radius: int = 8, chunk: int = 1024, flush: int = 1 << 15) -> DataFrame:
    """(hi, lo, near): for distinct queries of fps (hi, lo, copies, asked) the copies of all fingerprints within radius.

    fps has one row for each fingerprint; asked marks queries; the query's own copies count.
    """
    masks = [(m >> 64, m & ((1 << 64) - 1)) for m in agreeing(BITS, radius, fps.count(), max(1, chunk // 2))]
    place = lambda k, m: F.struct(F.lit(k).alias("table"), *(F.col(h).bitwiseAND(F.lit(signed(x)).cast("bigint")).alias(f"v{h}") for h, x in zip(("hi", "lo"), m)))
    rows = fps.withColumn("t", F.explode(F.array(*(place(k, m) for k, m in enumerate(masks))))).select("hi", "lo", "copies", "asked", "t.*")
    keys = ["table", "vhi", "vlo"]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.max("asked").alias("any")).where("any").drop("any")
    own = F.pmod(F.xxhash64("hi", "lo"), F.col("chunks")).cast("int")
    places = F.concat(F.array(F.struct(own.alias("part"), F.lit(False).alias("query"))), F.when(F.col("asked"), F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("part"), F.lit(True).alias("query")))).otherwise(F.array().cast("array<struct<part:int,query:boolean>>")))
    dealt = with_sizes(rows, sizes, keys, "inner").withColumn("p", F.explode(places)).select("hi", "lo", "copies", *keys, "p.part", "p.query")
    keys = [*keys, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mhi, mlo = (np.array([m[k] for m in masks], np.uint64) for k in (0, 1))

        def searched(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
            ids = np.stack([cols[k] for k in keys], axis=1)
            order = np.lexsort((~cols["query"], *ids.T[::-1]))
            ids, c = ids[order], {k: v[order] for k, v in cols.items()}
            cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(ids)]])
            asked = np.add.reduceat(c["query"].astype(np.int64), cuts[:-1])
            hi, lo = c["hi"].view(np.uint64), c["lo"].view(np.uint64)
            out = []
            for a, b, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), asked.tolist()):
                k = int(ids[a, 0])
                for at in range(a, a + q, 256):
                    s = slice(at, min(a + q, at + 256))
                    xh, xl = hi[s, None] ^ hi[None, a + q : b], lo[s, None] ^ lo[None, a + q : b]
                    i, j = np.nonzero(np.bitwise_count(xh).astype(np.int64) + np.bitwise_count(xl) <= radius)
                    xh, xl = xh[i, j], xl[i, j]
                    seen = np.zeros(len(i), bool)
                    for e in range(k):
                        seen |= ((xh & mhi[e]) == 0) & ((xl & mlo[e]) == 0)
                    near = np.zeros(s.stop - s.start, np.int64)
                    np.add.at(near, i[~seen], c["copies"][a + q : b][j[~seen]])
                    out.append((c["hi"][s], c["lo"][s], near))
            arrays = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3)]
            return pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["hi", "lo", "near"])

        names, held, rows = ["hi", "lo", "copies", "query", *keys], None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            new = {n: v if n == "query" else v.astype(np.int64) for n, v in new.items()}
            held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in names}
            rows = len(held["hi"])
            if rows >= flush:
                other = np.flatnonzero(np.any([held[k] != held[k][-1] for k in keys], axis=0))
                last = int(other[-1]) + 1 if len(other) else 0
                if last:
                    yield searched({n: v[:last] for n, v in held.items()})
                    held = {n: v[last:] for n, v in held.items()}
        if held is not None and len(held["hi"]):
            yield searched(held)

    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "hi long, lo long, near long")
    return found.groupBy("hi", "lo").agg(F.sum("near").alias("near"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 8, every: int = 50) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_docs) of every row.

    near_docs is the number of other documents whose fingerprint lies within radius bits, for the
    queries: rows whose id is divisible by `every` (null for others). Null texts count as empty, with
    fingerprint zero, as all texts without a word; repeated rows and null ids keep their rows; other
    columns are ignored.
    """
    rows = materialized(fingerprints(docs, id_col, text_col))
    asked = F.coalesce(F.col("id") % every == 0, F.lit(False))
    fps = materialized(rows.groupBy("hi", "lo").agg(F.count("*").alias("copies"), F.max(asked).alias("asked")))
    near = rows.where(asked).select("id", "hi", "lo").distinct().join(within(fps, radius), ["hi", "lo"]).select("id", "hi", "lo", (F.col("near") - 1).alias("near_docs"))
    hexed = F.concat(*(F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("hi", "lo")))
    return rows.join(materialized(near), ["id", "hi", "lo"], "left").select(F.col("id").alias(id_col), "n_chars", "edited_sha256", hexed.alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "near_docs")
