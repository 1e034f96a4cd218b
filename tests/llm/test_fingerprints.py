import hashlib

import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import fingerprints as P

from .fixtures import documents, empty, prose, rows


def order(r):
    """Ids, nulls first, then the hash of the text and the text."""
    i, text = r
    h = 42 if text is None else xxhash.xxh64(text.encode(), seed=42).intdigest()
    return (i is not None, i or 0, h - (1 << 64) if h >= 1 << 63 else h, text is not None, text or "")


def test_compare_matches_brute_force(spark):
    base = prose(20, 200).split()
    more = [(200 + 25 * k, " ".join([*base[:k], "other", *base[k + 1 :]]), "en", "n") for k in range(12)]
    found = sorted(P.compare(documents(spark, more)).collect(), key=str)
    data = sorted(((r[0], r[1]) for r in [*rows(), *more]), key=order)
    prints = [P.fingerprint(t) for _, t in data]
    want = []
    for k, (i, text) in enumerate(data):
        text, nxt = text or "", data[(k + 1) % len(data)][1] or ""
        changed = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        near = sum((int.from_bytes(prints[k], "big") ^ int.from_bytes(p, "big")).bit_count() <= 8 for p in prints) - 1
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), prints[k].hex(), P.fingerprint(changed).hex(), P.likeness(prints[k], P.fingerprint(changed)), P.likeness(prints[k], prints[(k + 1) % len(data)]), near if i is not None and i % 50 == 0 else None))
    assert found == sorted(want, key=str)
    assert any(r.near_docs for r in found if r.near_docs is not None)


def test_hot_tables_lose_no_pair(spark):
    fps = [(5 ^ (1 << a) ^ (1 << b), 9, 1 + (a + b) % 3, b == 0) for a in range(24) for b in range(a)]
    df = spark.createDataFrame(fps, "hi long, lo long, copies long, asked boolean")
    found = {(r.hi, r.lo): r.near for r in P.within(df, radius=3, chunk=8, flush=50).collect()}
    want = {(h, lo): sum(c for x, y, c, _ in fps if (x ^ h).bit_count() + (y ^ lo).bit_count() <= 3) for h, lo, _, q in fps if q}
    assert found == want


def test_likeness():
    a, b = prose(1, 300), prose(2, 300)
    half = P.edited(a, b)
    assert P.fingerprint(a) == P.fingerprint(a.upper()) and P.likeness(P.fingerprint(a), P.fingerprint(a)) == 1
    assert P.likeness(P.fingerprint(a), P.fingerprint(half)) > P.likeness(P.fingerprint(a), P.fingerprint(b))


def test_small_tables(spark):
    assert P.compare(empty(spark)).collect() == []
    (one,) = P.compare(documents(spark).where("doc_id = 1")).collect()
    assert one.near_next == 1.0


def test_rows_of_one_id_are_dealt_to_many_tasks(spark):
    """Half of the rows have no id and a quarter share one; tasks stay even, one row follows each, and nothing is lost."""
    n, parts = 8000, 16
    ids = F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 4 == 1, 70).otherwise(F.col("id"))
    docs = spark.range(n).select(ids.alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    dealt = P.with_next(docs, "doc_id", "text", parts)
    tasks = {}
    for r in dealt.select(F.spark_partition_id().alias("p"), "id", "text", "guest").collect():  # in order within a task
        tasks.setdefault(r.p, []).append(r)
    sizes = [sum(not r.guest for r in t) for t in tasks.values()]
    assert sum(sizes) == n and max(sizes) <= 2 * n // parts
    assert all([r.guest for r in t] == [False] * (len(t) - 1) + [True] for t in tasks.values())
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=order)
    got = sorted((((r.id, r.text), (s.id, s.text)) for t in tasks.values() for r, s in zip(t, t[1:])), key=lambda x: order(x[0]))
    assert got == list(zip(want, [*want[1:], want[0]]))


def test_the_least_and_largest_ids(spark):
    for ids in ([-(1 << 63), None, (1 << 63) - 1], [5] * 40, [None] * 40, [1, 1, 2, 2, 3, 3] * 9, [(1 << 60) + 1] * 50 + [1 << 60, (1 << 60) + 2], []):
        data = [(i, f"t{k % 50}") for k, i in enumerate(ids)]
        got = P.compare(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "n_chars", "edited_sha256").collect()
        rows = sorted(data, key=order)
        assert len(got) == len(rows)
        want = [(i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(rows)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
