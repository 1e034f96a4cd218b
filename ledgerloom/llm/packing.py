"""Best-fit packing by the sum-of-squares rule.

Documents are tokenized once; from then on only lengths move. The pieces are dealt evenly to shards of
about `shard` pieces, and each shard is packed on its own, longest piece first: a piece goes where the
squared counts of open sequences, by residual gap, become smallest. A shard leaves a handful of
sequences unfilled, so more shards cost a fixed small share, and no task ever holds more than a shard.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialized

END_ID = 2
SPECIAL = "<|endoftext|>"
_ODD_SPACE = re.compile(r"\s ")


class Encoder:
    """Token ids, as little-endian unsigned 32-bit bytes, of the public byte-level vocabulary.

    A space behind a sign that is no white space always begins a new token, so texts are cut there and
    the ids of every such chunk are kept; the rank file of the same vocabulary gives them. Texts where
    white space stands before a space are encoded whole, texts with the special token's string by the
    tokenizer file itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, most: int = 300_000):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.json_path, self.whole = json_path, None

        class Chunks(dict):
            def __missing__(chunks, word: str) -> bytes:
                if len(chunks) >= most:
                    chunks.clear()
                ids = chunks[word] = self.ids(" " + word)
                return ids

        self.chunks = Chunks()

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text[:1].isspace() or _ODD_SPACE.search(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        return b"".join([self.ids(first), *map(self.chunks.__getitem__, rest)])


def public_encoder() -> Encoder:
    import public_tokenizers as p

    return Encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, encoder=public_encoder) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document's ids and END_ID, cut into pieces of at most capacity.

    Only documents longer than capacity are cut; their first piece takes the remainder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            ids, rows = b.column("id").to_pylist(), []
            for i, text in zip(ids, b.column("text").to_pylist()):
                data = encode(text or "") + end
                n = len(data) // 4
                at = 0
                while at < n:
                    to = at + ((n - at - 1) % capacity + 1 if at == 0 else capacity)
                    rows.append((i, 0 if at == 0 else rows[-1][1] + 1, at, to - at, zlib.crc32(data[4 * at : 4 * to])))
                    at = to
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (b.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length, in the given order: each goes where the sum over gaps of squared counts of open bins is smallest.

    Filled bins do not count; of equal choices the fullest bin is taken. A bin is opened only where no
    open one has room: the plain rule opens some earlier and ends with 0.5 % more bins.
    """
    counts = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        # of a bin with gap g: (N[g]-1)^2 + (N[g-s]+1)^2 against N[g]^2 + N[g-s]^2, a filled bin leaves only
        change = 2 * counts[: capacity + 1 - s] - 2 * counts[s:] + 2
        change[0] = 1 - 2 * counts[s]
        change[counts[s:] == 0] = np.iinfo(np.int64).max
        if change.min() == np.iinfo(np.int64).max or s == capacity:
            change[-1] = 0  # a new bin, where no open one has room
        left = int(change.argmin())
        if left == capacity - s:
            b, made = made, made + 1
        else:
            b = open_bins[left + s].pop()
            counts[left + s] -= 1
        bins[k], offsets[k] = b, capacity - s - left
        if left:
            open_bins[left].append(b)
            counts[left] += 1
    return bins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, shard: int = 1 << 15, encoder=public_encoder) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Null and empty texts are the single id END_ID. Repeated rows and null ids are packed like others;
    other columns are ignored; no rows give no rows.
    """
    rows = materialized(pieces(docs, id_col, text_col, capacity, encoder))
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(t.column("length").to_numpy(), capacity)
        t = t.append_column("sequence_id", pa.array((t.column("shard").to_numpy().astype(np.int64) << 40) + bins)).append_column("offset", pa.array(offsets))
        yield from t.drop_columns(["shard"]).to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
