import random
import re

import numpy as np
import xxhash

from ledgerloom.llm import simhash_dedup as D
from ledgerloom.llm.common import agreeing, components

from .fixtures import documents, empty, prose, rows


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=4):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, i in zip(group, ids):
        least[g] = i if least.get(g) is None else least[g] if i is None else min(i, least[g])
    return [least[g] for g in group]


def test_fingerprints_and_components_match_brute_force(spark):
    text = prose(9, 300).split()
    copies = [(1000 + k, " ".join([*text[: 3 * k], f"w{k}", *text[3 * k + 1 :]]), "en", "z") for k in range(40)]
    found = D.near_duplicates(documents(spark, copies)).collect()
    data = [(r[0], r[1]) for r in [*rows(), *copies]]
    fps = [slow_fingerprint(t) for _, t in data]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(data, fps, slow_components([i for i, _ in data], fps))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == want
    assert len({c for i, _, c in want if i and i >= 1000}) < 40  # there are near copies among them


def test_trie_links_all_pairs_of_dense_and_random_groups():
    rng = np.random.default_rng(1)
    for _ in range(20):
        center = rng.integers(0, 1 << 63, dtype=np.uint64)
        near = [int(center)]
        for _ in range(150):
            x = near[rng.integers(len(near))]
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            near.append(x)
        keys = np.unique(np.array([*near, *rng.integers(0, 1 << 63, 100).tolist()], np.uint64))
        root = D.trie_components(keys, np.array([0]), 4, leaf=8, most=64)
        slow = slow_components(list(range(len(keys))), [int(k) for k in keys])
        assert (np.array(slow)[:, None] == np.array(slow)).tolist() == (root[:, None] == root).tolist()


def test_hot_groups_are_dealt_in_chunks_without_losing_links(spark):
    fps = [(7 << 40) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint long")
    found = components(D.links(df, chunk=16), "a", "b").collect()
    assert len(found) == len(fps) and len({r.root for r in found}) == 1


def test_masks_and_turned_bits():
    r = random.Random(2)
    for bits, radius in ((64, 4), (128, 8)):
        counts = [len(agreeing(bits, radius, n, 512)) for n in (1, 10**6, 10**9, 10**12)]
        assert counts[0] == radius + 1 and counts == sorted(counts) and counts[2] > counts[0]
        for n in (1, 10**9):
            masks = agreeing(bits, radius, n, 512)
            assert all(any(x & m == 0 for m in masks) for x in (sum(1 << b for b in r.sample(range(bits), radius)) for _ in range(300)))
    fps = np.array([r.getrandbits(64) for _ in range(50)], np.uint64)
    for mask in agreeing(64, 4, 10**9, 512):
        turned, k = D.rolled(fps, mask), mask.bit_count()
        for i in range(50):
            assert (fps[i] ^ fps).tolist().count(0) == (turned[i] ^ turned).tolist().count(0) and turned[i].bit_count() == fps[i].bit_count()
            same = [bool((int(fps[i]) ^ int(x)) & mask == 0) for x in fps]
            assert same == [int(turned[i]) >> (64 - k) == int(x) >> (64 - k) for x in turned]


def test_pairs_of_blocks_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(8)
    fps = set()
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63))
        fps |= {x} | {x ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False)) for _ in range(5)}
    fps = sorted(fps)
    monkeypatch.setattr(D, "agreeing", lambda bits, radius, n, room: agreeing(bits, radius, 10**9, 512))
    found = {r.node: r.root for r in components(D.links(spark.createDataFrame([(f,) for f in fps], "fingerprint long")), "a", "b").collect()}
    slow = slow_components(fps, fps)
    assert [found.get(f, f) for f in fps] == slow


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(0, 60)]
    star = [(100, k) for k in range(101, 160)]
    found = dict(map(tuple, components(spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "x long, y long"), "x", "y").collect()))
    assert found == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_empty_table(spark):
    assert D.near_duplicates(empty(spark)).collect() == []
