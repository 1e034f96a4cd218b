import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import packing

from .fixtures import documents, empty, rows


def whole(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer_file():
    r = random.Random(5)
    texts = ["", " ", "  x", "a  b", "a \n b", "x\n\n y", "it's  's", "<|endoftext|> a", "a\u00a0 b", "tab\t x", "x "]
    texts += ["".join(r.choice(["a", "B", " ", "  ", "\n", "'s", "é", "7", "\u2028", "!", "日", "\U0001f600", "\x1c", "\u0301"]) for _ in range(60)) for _ in range(400)]
    encode = packing.public_encoder()
    for text, ids in zip(texts, whole(texts)):
        assert np.frombuffer(encode(text), "<u4").tolist() == ids, text
    every = ["".join(chr(c) + r.choice(["a", " ", "1", " b"]) for c in range(lo, lo + 1024) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x20000, 1024)]
    for text, ids in zip(every, whole(every)):
        assert np.frombuffer(encode(text), "<u4").tolist() == ids


def test_round_trip(spark):
    found = packing.pack(documents(spark)).collect()
    want = {}
    for (i, text, *_), ids in zip(rows(), whole([r[1] or "" for r in rows()])):
        ids = [*ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in found:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) == -(-sum(r.length for r in found) // 1024)


def test_a_shard_loses_a_few_sequences_at_most(spark):
    docs = spark.createDataFrame([(k, "word " * (k * 37 % 900)) for k in range(600)], "doc_id long, text string")
    one, many = (packing.pack(docs, shard=s).select("sequence_id").distinct().count() for s in (1 << 15, 100))
    assert one <= many <= one + 3 * 6  # six shards of 100 pieces, far smaller than real ones


def test_sum_of_squares_fills_bins():
    r = np.random.default_rng(2)
    for lengths in (r.integers(1, 1025, 3000), np.full(10, 1024), np.array([1]), np.array([600] * 5), np.zeros(0, np.int64)):
        lengths = np.sort(lengths)[::-1]
        bins, offsets = packing.sum_of_squares(lengths, 1024)
        used = {}
        for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist())):
            assert o == used.get(b, 0)
            used[b] = o + n
        assert all(v <= 1024 for v in used.values())
        if len(lengths) == 3000:
            assert len(used) <= 1.01 * lengths.sum() / 1024


def test_empty_table(spark):
    assert packing.pack(empty(spark)).collect() == []
