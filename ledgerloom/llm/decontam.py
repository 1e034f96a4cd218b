"""Benchmark decontamination: rare n-gram seeds join documents to test items, Smith-Waterman scores the passages.

The test items are taken in blocks of bounded size; each block is broadcast and every document is
scanned against it. A first scan counts in how many documents each word n-gram of the items occurs. The
rare ones are seeds, and of every item those up to twice the median of its n-grams that occur, so an item
that has leaked everywhere keeps its seeds. A second scan is the join: it finds the seeds' hits, gathers
them by diagonal and aligns the items with the passages around them, many passages at once. Only counts of
n-grams are ever shuffled; a shuffle join would move every n-gram of every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import shipped

#: ASCII signs other than letters, digits and white space, and all other signs beyond ASCII.
_SIGNS = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))
_FAR_SIGNS = re.compile(r"[^\w\x00-\x7f]")


def words_of(text: str | None) -> list[bytes]:
    """A text's words as they count for equal wording: letters and digits in lower case, in UTF-8."""
    text = (text or "").lower()
    if not text.isascii():
        text = _FAR_SIGNS.sub(lambda m: " " if m[0].isspace() else "", text)
    return text.encode("utf-8", "surrogatepass").translate(None, _SIGNS).split()


class Items:
    """A block of test items as word numbers, and the n-grams they consist of."""

    def __init__(self, ids: list, texts: list[str | None], n: int):
        self.n, self.number = n, {}
        words = [words_of(t) for t in texts]
        for w in (w for item in words for w in item):
            self.number.setdefault(w, len(self.number))
        kept = [k for k, item in enumerate(words) if len(item) >= n]
        #: items shorter than an n-gram, by their words' numbers
        self.short: dict[tuple[int, ...], list] = {}
        for k, item in enumerate(words):
            if 0 < len(item) < n:
                self.short.setdefault(tuple(self.number[w] for w in item), []).append(ids[k])
        self.ids = [ids[k] for k in kept]
        self.words = [np.array([self.number[w] for w in words[k]], np.int64) for k in kept]
        self.radix = len(self.number) + 1
        places = [(g, k, at) for k, item in enumerate(self.words) for at, g in enumerate(self.grams(item)[1].tolist())]
        self.codes = np.array(sorted({g for g, _, _ in places}), np.int64)
        at = np.searchsorted(self.codes, np.array([g for g, _, _ in places], np.int64)) if places else np.zeros(0, np.int64)
        order = np.lexsort((np.arange(len(places)), at))
        self.gram, self.item, self.offset = at[order], np.array([k for _, k, _ in places], np.int64)[order], np.array([o for _, _, o in places], np.int64)[order]
        self.wanted = np.ones(len(self.codes), bool)
        self.least_hits = np.array([max(1, min(2, (len(w) - n + 1) // 3)) for w in self.words], np.int64)

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, codes) of n-grams whose words all occur in the items; equal codes are equal n-grams."""
        m = len(ids) - self.n + 1
        if m < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids >= 0
        ok = known[:m].copy()
        for k in range(1, self.n):
            ok &= known[k : k + m]
        at = np.flatnonzero(ok)
        code = np.zeros(len(at), np.int64)
        for k in range(self.n):
            code = code * self.radix + ids[at + k]
        return at, code

    def keep_rare(self, docs_with: np.ndarray, most: float) -> None:
        """Seeds are n-grams of at most `most` documents, and of each item those up to twice the median of what occurs.

        Copies raise the counts of all that an item says alike, so what edited copies keep stays below;
        n-grams that no document has, as edits leave them, do not count for the median.
        """
        self.wanted = docs_with <= most
        order = np.argsort(self.item, kind="stable")
        for own in np.split(self.gram[order], np.flatnonzero(np.diff(self.item[order])) + 1):
            there = docs_with[own][docs_with[own] > 0]
            if len(there):
                self.wanted[own[docs_with[own] <= 2 * np.median(there)]] = True

    def read(self, text: str | None) -> np.ndarray:
        """A text as word numbers, -1 for words that no item has."""
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the n-gram) of the wanted n-grams in a text."""
        at, code = self.grams(ids)
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        g = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ok = (self.codes[g] == code) & self.wanted[g]
        return at[ok], g[ok]

    def passages(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, from, to, hits) of every stretch of the text whose seeds lie near one diagonal of an item."""
        at, g = self.hits(ids)
        if not len(at):
            return []
        lo, hi = np.searchsorted(self.gram, g, "left"), np.searchsorted(self.gram, g, "right")
        which = np.repeat(np.arange(len(at)), hi - lo)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        item, pos = self.item[entry], at[which]
        diagonal = pos - self.offset[entry]
        order = np.lexsort((pos, diagonal, item))
        item, pos, diagonal = item[order], pos[order], diagonal[order]
        size = np.array([len(w) for w in self.words])
        slack = np.maximum(4, size // 3)[item]
        cut = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (np.diff(diagonal) > slack[1:])]))
        found = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(item)]):
            k = int(item[a])
            n = len(np.unique(pos[a:b]))
            if n >= self.least_hits[k]:
                s = int(slack[a])
                found.append((k, max(0, int(diagonal[a]) - s), min(len(ids), int(diagonal[b - 1]) + int(size[k]) + s), n))
        return found


def smith_waterman(item: np.ndarray, passages: list[np.ndarray], match: int = 2, other: int = -1, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(best local alignment score, where it ends) of an item against each passage, all at once."""
    width = max(map(len, passages))
    p = np.full((len(passages), width), -3, np.int64)
    for k, x in enumerate(passages):
        p[k, : len(x)] = x
    slope = gap * np.arange(width + 1)
    h = np.zeros((len(passages), width + 1), np.int64)
    best, end = np.zeros(len(passages), np.int64), np.zeros(len(passages), np.int64)
    for w in item:
        new = np.maximum(h - gap, 0)
        new[:, 1:] = np.maximum(new[:, 1:], h[:, :-1] + np.where(p == w, match, other))
        h = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps inside the row
        at = h.argmax(axis=1)
        top = np.take_along_axis(h, at[:, None], 1)[:, 0]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best, end


def leaks(items: Items, texts: list[np.ndarray], threshold: float, enough: int, at_once: int = 1 << 21) -> list[list[dict]]:
    """Of every text (as word numbers) its items with their best passage's score, in the order of the items."""
    wanted: dict[int, list[tuple[int, int, int, int]]] = {}
    for d, ids in enumerate(texts):
        for k, lo, hi, n in items.passages(ids):
            wanted.setdefault(k, []).append((d, lo, hi, n))
    best: dict[tuple[int, int], dict] = {}
    for k, places in sorted(wanted.items()):
        item, full = items.words[k], 2 * min(enough, len(items.words[k]))
        places.sort(key=lambda x: x[2] - x[1])  # passages of like length are aligned together
        step = max(1, at_once // max(1, places[-1][2] - places[-1][1]))
        for a in range(0, len(places), step):
            part = places[a : a + step]
            score, end = smith_waterman(item, [texts[d][lo:hi] for d, lo, hi, _ in part])
            good = [x for x, s in enumerate(score) if s >= threshold * full]
            if not good:
                continue
            _, back = smith_waterman(item[::-1], [texts[part[x][0]][part[x][1] : part[x][1] + end[x]][::-1] for x in good])
            for x, r in zip(good, back):
                d, lo, _, n = part[x]
                if score[x] < threshold * 2 * min(len(item), r):  # of a long item's passage too much differs
                    continue
                found = {"item_id": items.ids[k], "score": min(1.0, float(score[x]) / full), "seeds": n, "first_word": lo + int(end[x] - r), "last_word": lo + int(end[x]) - 1}
                old = best.get((d, k))
                if old is None or (found["score"], -found["first_word"]) > (old["score"], -old["first_word"]):
                    best[d, k] = found
    out: list[list[dict]] = [[] for _ in texts]
    for (d, _), found in sorted(best.items()):
        out[d].append(found)
    for d, ids in enumerate(texts):
        if len(ids) < items.n:
            out[d] += [{"item_id": i, "score": 1.0, "seeds": 0, "first_word": 0, "last_word": len(ids) - 1} for i in items.short.get(tuple(ids.tolist()), [])]
    return out


def scan(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 3, rare: float = 0.0005, threshold: float = 0.6, enough: int = 50, block_chars: int = 1 << 23, out_col: str = "leaks") -> DataFrame:
    """docs' columns `keep` and out_col: array of (item_id, score, seeds, first_word, last_word) of each row.

    score is the best local alignment's score (2 a match, -1 a substitution or gap) against the highest
    possible one of the item, or of `enough` words of it where it is longer (1 at most); passages from
    `threshold` on are leaks, so a long item leaks by a passage of it, if the passage also reaches
    `threshold` of the score that so many equal words have. An n-gram is rare in up to the
    share `rare` of documents. Items of less than n words match texts of just these words; null and empty
    ones never match, and null and empty texts have no leaks. Repeated rows and null ids keep their rows;
    repeated items each match; `keep` must not hold out_col. Items are read block by block, block_chars
    characters each, and every block scans all rows, so nothing depends on the number of items but time.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = docs.select(*keep, *([] if text_col in keep else [text_col])).withColumn(out_col, F.array().cast(f"array<struct<item_id:{kind},score:double,seeds:int,first_word:int,last_word:int>>"))
    chars, count = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-chars // block_chars), -(-count // (block_chars // 64)))
    total = None
    schema = StructType(list(out.schema.fields))
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == b).select(item_id, item_text).collect()  # a block's worth
        held.sort(key=lambda r: (r[0] is None, r[0], r[1] or ""))
        block = Items([r[0] for r in held], [r[1] for r in held], n)
        if not len(block.codes) and not block.short:
            continue
        plain = shipped(spark, block)

        def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = plain()
            sums = np.zeros(len(known.codes), np.int64)
            for x in batches:
                for text in x.column(0).to_pylist():
                    _, g = known.hits(known.read(text))
                    sums[np.unique(g)] += 1
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["gram", "docs"])

        docs_with = np.zeros(len(block.codes), np.int64)
        for g, c in docs.select(text_col).mapInArrow(count_grams, "gram int, docs long").groupBy("gram").agg(F.sum("docs")).collect():  # a row for each n-gram of the block
            docs_with[g] = c
        total = docs.count() if total is None else total
        block.keep_rare(docs_with, rare * total)
        seeded = shipped(spark, block)

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = seeded()
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    x = whole.slice(at, 2000)
                    old = x.column(out_col)
                    found = leaks(known, [known.read(t) for t in x.column(text_col).to_pylist()], threshold, enough)
                    new = pa.array([a + f for a, f in zip(old.to_pylist(), found)], old.type) if any(found) else old
                    yield x.set_column(x.schema.get_field_index(out_col), out_col, new)

        out = out.mapInArrow(align, schema)
    return out.select(*keep, out_col)
