"""Quality, importance resampling and filter audit against plain versions, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import filter_audit, importance, quality, queries

from ..conftest import DATA

ODD = "doc_id long, text string, source string, bucket int, score string, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty and long texts, equal texts, columns with clashing names."""
    long, plain = "Word wörd ÄB " * 40_000, "the quick brown fox jumps over the lazy dog and runs to the old red barn near a cold river bank today"
    rows = [(1, None, "a"), (2, "", "a"), (3, plain, None), (4, plain, ""), (4, plain, ""), (5, plain.upper(), "b"), (None, plain, "b"), (None, None, "b"), (6, long, "b"), (7, "x # y", "c"), (7, "another text of the same id", "c")]
    rows += [(10 + k, f"{plain} {k % 5} {'Pad ' * k}", "d") for k in range(30)]
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], ODD)


def plain_draw(docs, target):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    buckets = lambda t: [zlib.crc32(w.encode()) % 10000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))]
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    out = []
    for i, x in docs:
        own = buckets(x)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {k: order[k] for k in range(len(order) * 10 // 100)}
    return Counter(out), [drawn[k] for k in sorted(drawn)]


def test_importance_equals_plain(spark, odd):
    target = spark.createDataFrame([("Fox jumps, over the river! Ä",), (None,), ("fox barn",)], "text string")
    got = importance.resample(odd, target).collect()
    rows, drawn = plain_draw([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in target.collect()])
    assert Counter(tuple(r[:4]) for r in got) == rows
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [r.score for r in ranked] == [d[3] for d in drawn]


def test_importance_of_longer_runs_and_empty_tables(spark, odd):
    target = odd.select("text").limit(0)
    assert importance.resample(odd.limit(0), target).collect() == []
    words = odd.where("doc_id = 7").select("doc_id", "text")
    assert sorted(r.n_features for r in importance.resample(words, target, longest=2).collect()) == [3, 11]  # x, y, x y; 6 words, 5 pairs


def test_importance_ranks_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(1000).selectExpr("id as doc_id", "concat('w', id % 7, repeat(' a b', 10)) as text").union(spark.sql("select 5L, 'w5 a b' from range(70000)"))
        got = importance.resample(rows, spark.createDataFrame([("w3 a",)], "text string"), share=(1, 2))
        ranked = got.where("rank is not null").orderBy("rank").select("doc_id", "score", "rank").collect()
        assert [r["rank"] for r in ranked] == list(range(1, 501)) and got.count() == 71_000
        assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in ranked)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def plain_audit(docs, good, toxic):
    first, rows = {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((p or "", i, {k for k, v in fails.items() if v}))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone, now = set(order[:k]), lambda r: f in r[2] and not r[2] & set(order[:k])  # noqa: E731,B023
                here = [r for r in own if now(r)]
                total[f] += len(here)
                out[part, "".join(order), k + 1, f] = [sum(not r[2] & {*gone, f} for r in own), len(here), sum(f in r[2] and bool(r[2] & gone) for r in own), sum(r[2] == {f} for r in own), sum(r[1] in good for r in here), sum(r[1] in toxic for r in here)]
        for key in out:
            if key[0] == part:
                out[key].append(total[key[3]])
    return out


def test_audit_equals_plain(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, 1), (5, 1, 1), (7, None, None), (None, 1, 1), (12, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(odd, labels)
    want = plain_audit([(r.doc_id, r.text, r.source) for r in odd.collect()], {3, 5, 12}, {4, 5})
    assert {tuple(r[:4]): list(r[4:]) for r in got.collect()} == want
    assert filter_audit.audit(odd.limit(0), labels).collect() == []
    with pytest.raises(ValueError):
        filter_audit.audit(odd, labels, {str(k): filter_audit.too_short(k) for k in range(7)})


def test_audit_with_named_filters(spark, odd):
    got = filter_audit.audit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"), {"short": filter_audit.too_short(5), "sign": filter_audit.has_signs()}).collect()
    assert {r.filter_order for r in got} == {"shortsign", "signshort"} and len(got) == 5 * 2 * 2  # five parts
    assert {(r.removed, r.redundant) for r in got if r.part == "c" and r.filter == "sign"} == {(0, 1), (1, 0)}


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_filter_audit"])
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=str)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == docs.count() and all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.97 and len(held) > 50


def test_quality_equals_plain_densities(spark):
    """Differences are those of two normal densities with the shrunk covariances, computed without factors."""
    rng = np.random.default_rng(3)
    texts = [(k, " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta!", "e1"], rng.integers(1, 60) if k % 3 else 8))) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.log_density for r in quality.score(docs, labels).collect()}
    x = {k: np.array(quality.describe(t)) for k, t in texts}
    learn = [k for k, _ in texts if zlib.crc32(str(k).encode()) % 5 and k != 2]  # 2 has both labels
    own = {c: np.array([x[k] for k in learn if int(k % 3 > 0) == c]) for c in (0, 1)}
    mean = {c: own[c].mean(axis=0) for c in own}
    scatter = {c: (own[c] - mean[c]).T @ (own[c] - mean[c]) for c in own}
    pooled, size = (scatter[0] + scatter[1]) / len(learn), len(quality.STATISTICS)

    def density(c, v):
        s = 0.8 * scatter[c] / len(own[c]) + 0.2 * pooled
        s = 0.98 * s + (0.02 * np.trace(s) / size + 1e-9) * np.eye(size)
        return -0.5 * (np.linalg.slogdet(s)[1] + (v - mean[c]) @ np.linalg.inv(s) @ (v - mean[c]))

    for k, _ in texts:
        assert got[k] == pytest.approx(density(1, x[k]) - density(0, x[k]), rel=1e-6, abs=1e-6)


def test_quality_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(odd, none).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.5}
    good = quality.score(odd, spark.createDataFrame([(k, 1, 0) for k in range(10, 40)], "doc_id long, quality int, toxic int"))
    assert min(r.score for r in good.collect()) > 0.9
    assert quality.score(odd.limit(0), none).collect() == []
    assert quality.describe(None) == quality.describe("")
    assert quality.describe("ab cd  ef " * 1000, piece=7) == quality.describe("ab cd  ef " * 1000)
