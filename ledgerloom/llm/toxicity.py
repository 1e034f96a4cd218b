"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max index.

Learning takes about `per_class` labelled documents of each class (the documented bound) by a hash
threshold. Terms are all words and their four- and five-letter beginnings, and every vector is divided by
the norm of its whole text. Document frequencies of all terms are counted over all documents; terms of
less than the share `rarest` of them weigh as if they had that share, which bounds the table of
frequencies that is broadcast. A term that tells the examples' classes apart weighs more by a factor of
one or more (`evidence`); no term is left out. The examples' most frequent terms are dense columns with each block's
largest weight, the others postings, which a query reads whole. It computes the dense part only for blocks
whose bound reaches its k-th best so far, and the k nearest are exact. Their similarity-weighted vote is
calibrated on the examples, in `folds` parts: an index of the other parts, with evidence of theirs alone,
gives each part's votes, and equal texts stand in one part.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialized, shipped
from .langid import held_out

_BREAK = re.compile(r"\W")
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers that differ in many bits where x differs in few."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _segments(texts: list[str | None], longest: int) -> Iterator[tuple[int, str]]:
    """(position of the text, lower-cased part of it): long texts are cut where a word ends."""
    for k, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while len(text) - at > longest and (cut := _BREAK.search(text, at + longest)):
            yield k, text[at : cut.start()]
            at = cut.start()
        yield k, text[at:]


def counter(longest: int = 1 << 20, at_once: int = 1 << 16):
    """A function from a list of texts to (codes of their terms, how often each occurs, where each text's begin and the end); a text's codes ascend.

    Terms are words (runs of letters, digits and underscores, in lower case) and the first four and five
    letters of longer ones. A code is a 64-bit hash of the term's code points, taken for all terms of
    about `at_once` letters together, from running sums of letter times position's power.
    """
    inside = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(1 << 16))), bool, 1 << 16)
    letter = _mixed(np.arange(1 << 16, dtype=np.uint64), 1)
    none, powers = np.iinfo(np.int64).max, {}

    def power(base: int, n: int) -> np.ndarray:
        if len(powers.get(base, ())) < n:
            powers[base] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(max(n, 2 * at_once), base, np.uint64))])
        return powers[base][:n]

    def codes(text: str) -> tuple[np.ndarray, np.ndarray]:
        """(where each word begins, its three codes)."""
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.zeros(len(point) + 2, bool)
        word[1:-1] = inside.take(point, mode="clip")
        value = letter.take(point, mode="clip")
        if len(far := np.flatnonzero(point > 0xFFFF)):
            word[far + 1] = [chr(c).isalnum() for c in point[far].tolist()]
            value[far] = _mixed(point[far].astype(np.uint64), 1)
        edges = np.flatnonzero(word[1:] != word[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(point) + 1, np.uint64)
        np.cumsum(value * power(_BASE, len(point)), out=sums[1:])
        back = power(pow(_BASE, -1, 1 << 64), len(point) + 1)[start]
        out = np.full((len(start), 3), none)
        out[:, 0] = _mixed((sums[end] - sums[start]) * back, 2).view(np.int64)
        for k, n in ((1, 4), (2, 5)):
            longer = np.flatnonzero(end - start > n)
            a = start[longer]
            out[longer, k] = _mixed((sums[a + n] - sums[a]) * back[longer], 2 + n).view(np.int64)
        return start, out

    def count(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, sizes, held, owner, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            nonlocal held, owner, size
            first = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
            start, part = codes("\n".join(held))
            found.append(part)
            np.add.at(sizes, owner, np.diff(np.searchsorted(start, first), append=len(start)))
            held, owner, size = [], [], 0

        for k, text in _segments(texts, longest):
            held.append(text)
            owner.append(k)
            size += len(text)
            if size >= at_once:
                flush()
        if held:
            flush()
        terms = np.concatenate(found).ravel() if found else np.zeros(0, np.int64)
        cuts = 3 * np.concatenate([[0], np.cumsum(sizes)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            terms[a:b].sort()
        first = np.ones(len(terms), bool)
        first[1:] = terms[1:] != terms[:-1]
        first[cuts[:-1][np.diff(cuts) > 0]] = True
        at = np.flatnonzero(first)
        n = np.diff(at, append=len(terms))
        kept = terms[at] != none
        at, n = at[kept], n[kept]
        return terms[at], n, np.searchsorted(at, cuts)

    return count


def evidence(docs: np.ndarray, toxic: np.ndarray, n: int, n1: float) -> np.ndarray:
    """Factors of at least 1 for terms of so many examples, toxic ones among them, of n examples, n1 toxic: the root of chi-square above 3, times the log odds ratio."""
    n0, clean = n - n1, docs - toxic
    if not n0 or not n1:
        return np.ones(len(docs))
    gap = toxic * (n0 - clean) - clean * (n1 - toxic)
    z = np.abs(gap) * np.sqrt(n / np.maximum(docs * (n - docs) * n0 * n1, 1))
    odds = np.abs(np.log((toxic + 0.5) * (n0 - clean + 0.5) / ((n1 - toxic + 0.5) * (clean + 0.5))))
    return 1 + np.maximum(0, z - 3) * odds


class Weights:
    """Weights of the terms (inverse document frequency by evidence), and the columns of those that the examples have (-1: none)."""

    def __init__(self, codes: np.ndarray, idf: np.ndarray, rare: float, terms: np.ndarray, cuts: np.ndarray, labels: np.ndarray, dense: int = 2048):
        found, inverse, n = np.unique(terms, return_inverse=True, return_counts=True)
        toxic = np.bincount(inverse, np.repeat(labels, np.diff(cuts)), minlength=len(found))
        order = np.lexsort((found, -n))
        #: dense columns are the terms of at least one example in 64
        self.dense = min(dense, int((n * 64 >= max(1, len(labels))).sum()))
        self.columns = len(found)
        self.codes, self.rare = np.union1d(codes, found), np.float32(rare)
        self.idf, self.column = np.full(len(self.codes), rare, np.float32), np.full(len(self.codes), -1, np.int32)
        self.idf[np.searchsorted(self.codes, codes)] = idf
        self.idf[np.searchsorted(self.codes, found)] *= evidence(n.astype(float), toxic, len(labels), float(labels.sum()))
        self.column[np.searchsorted(self.codes, found[order])] = np.arange(len(found))

    def rows(self, code: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """TF-IDF rows, divided by the norm of all terms: the dense columns, and (row, column, weight) of the others that examples have."""
        n = len(cuts) - 1
        out, row = np.zeros((n, self.dense), np.float32), np.repeat(np.arange(n), np.diff(cuts))
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        w = (1 + np.log(counts)) * (np.where(known, self.idf[at], self.rare) if len(self.codes) else self.rare)
        w = (w / np.sqrt(np.bincount(row, w * w, minlength=n))[row]).astype(np.float32)
        column = np.where(known, self.column[at], -1) if len(self.codes) else np.full(len(code), -1)
        heavy, light = (column >= 0) & (column < self.dense), column >= self.dense
        out[row[heavy], column[heavy]] = w[heavy]
        return out, (row[light], column[light] - self.dense, w[light])


class Index:
    """Examples with their labels, in blocks, and the calibration of their votes.

    vectors are the dense columns, light (row, column, weight) what the examples have in the `others` other columns.
    """

    def __init__(self, weights, ids: list, labels: np.ndarray, vectors: np.ndarray, weight: tuple[float, float], k: int = 15, block: int = 64, light=None, others: int = 0):
        self.weights, self.k, self.block = weights, k, block
        # examples with the same heaviest term stand together, which keeps the blocks' bounds tight
        heaviest = vectors.argmax(axis=1) if vectors.size else np.zeros(len(vectors), int)
        order = np.lexsort((heaviest, labels))
        self.ids, self.labels = [ids[i] for i in order], labels[order].astype(np.float32)
        self.vectors = vectors[order].astype(np.float32)
        self.starts = np.arange(0, len(order), block)
        self.bounds = np.stack([self.vectors[s : s + block].max(axis=0) for s in self.starts]) if len(order) else np.zeros((0, vectors.shape[1]), np.float32)
        row, column, value = light or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        row = np.argsort(order)[row] if len(row) else row
        by = np.lexsort((row, column))
        self.example, self.value = row[by].astype(np.int32), value[by]
        self.first = np.searchsorted(column[by], np.arange(others + 1))
        self.weight = np.array(weight, np.float32)
        total = float(sum(weight[int(y)] for y in labels))
        self.prior = float(weight[1] * labels.sum() / total) if total else 0.0
        #: slope and shift of a logistic curve over votes; without it scores are the prior
        self.calibration = None

    def postings(self, n: int, light) -> np.ndarray:
        """What the columns beside the dense ones add to the similarities of n rows with all examples."""
        row, column, value = light
        lo, size = self.first[column], self.first[column + 1] - self.first[column]
        which = np.repeat(np.arange(len(row)), size)
        at = np.arange(len(which)) + np.repeat(lo - (np.cumsum(size) - size), size)
        m = len(self.labels)
        return np.bincount(row[which] * m + self.example[at], value[which] * self.value[at], minlength=n * m).reshape(n, m).astype(np.float32)

    def nearest(self, rows: np.ndarray, light=None, wave: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, example positions) of the k nearest; position -1 where fewer have a term in common.

        Blocks are read in the order of their bounds, `wave` at a time; of equal similarities the example
        that stands first is taken.
        """
        n, k, m = len(rows), self.k, len(self.labels)
        best, where = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
        if not len(self.bounds) or not n:
            return best, where
        bound = rows @ self.bounds.T + np.float32(1e-5)  # rounding must not prune
        added = None if light is None else self.postings(n, light)
        if added is not None:
            bound += np.maximum.reduceat(added, self.starts, axis=1)
        sims, top = np.zeros((n, m), np.float32), np.zeros((n, k), np.float32)
        order = np.argsort(-bound.max(axis=0), kind="stable")
        for at in range(0, len(order), wave):
            new, least = [top], top.min(axis=1)
            for b in order[at : at + wave].tolist():
                todo = np.flatnonzero((bound[:, b] > 1e-5) & (bound[:, b] >= least))
                if len(todo):
                    part = slice(self.starts[b], self.starts[b] + self.block)
                    found = rows[todo] @ self.vectors[part].T
                    if added is not None:
                        found += added[todo, part]
                    sims[todo, part] = found
                    new.append(sims[:, part])
            if len(new) > 1:
                top = np.partition(np.concatenate(new, axis=1), -k, axis=1)[:, -k:]
        row, column = np.nonzero((sims > 0) & (sims >= top.min(axis=1)[:, None]))
        value = sims[row, column]
        by = np.lexsort((column, -value, row))
        row, column, value = row[by], column[by], value[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < k
        best[row[kept], rank[kept]], where[row[kept], rank[kept]] = value[kept], column[kept]
        return best, where

    def of(self, codes: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of texts, given as counter() counts them."""
        found = [(np.zeros((0, self.k), np.float32), np.zeros((0, self.k), np.int64))]
        for at in range(0, len(cuts) - 1, 64):
            own = cuts[at : at + 65]
            found.append(self.nearest(*self.weights.rows(codes[own[0] : own[-1]], counts[own[0] : own[-1]], own - own[0])))
        return np.concatenate([s for s, _ in found]), np.concatenate([w for _, w in found])

    def vote(self, sims: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Share of toxic examples among the nearest, by similarity and class weight; far neighbours count little."""
        y = np.where(where >= 0, self.labels[where], 0)
        w = np.where(where >= 0, sims**2, 0) * np.where(y > 0, self.weight[1], self.weight[0])
        return (w * y).sum(axis=1) / (w.sum(axis=1) + 0.02 * self.weight.max())

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Fits the curve to votes on labelled texts."""
        v, y = votes.astype(float), labels.astype(float)
        w = self.weight[y.astype(int)].astype(float)
        w /= w.mean()
        x, beta, ridge = np.stack([v, np.ones_like(v)], axis=1), np.zeros(2), np.diag([0.5, 0.01])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ beta)
        self.calibration = float(max(beta[0], 1e-6)), float(beta[1])

    def score(self, sims: np.ndarray, where: np.ndarray) -> np.ndarray:
        if self.calibration is None:  # no labels, or of one class only
            return np.full(len(sims), self.prior)
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a * self.vote(sims, where).astype(float) + b)))


def _counted(rows: DataFrame, kept: str) -> DataFrame:
    """rows (with a column text) with the codes of its terms and their counts in its place; kept: the other columns' DDL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for b in batches:
            if b.num_rows:
                *found, cuts = count(b.column("text").to_pylist())
                ids, counts = (pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in found)
                names = [n for n in b.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), ids, counts], names=[*names, "terms", "counts"])

    return rows.mapInArrow(run, f"{kept}, terms array<long>, counts array<long>")


def frequencies(texts: DataFrame, least: float, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ascending, and how many texts have each) of the terms of more than `least` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, size = counter(), [], 0

        def summed() -> pa.RecordBatch:
            terms, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], names=["term", "docs"])

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                held.append(count(b.column(0).slice(at, 1024).to_pylist())[0])
                size += len(held[-1])
                if size >= most:
                    yield summed()
                    held, size = [], 0
        yield summed()

    found = texts.mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).where(F.col("docs") > least).toArrow()
    codes, n = found.column("term").to_numpy(), found.column("docs").to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, parts: int, part: int, per_class: int) -> tuple[DataFrame, tuple[float, float]]:
    """(id, text, label) of about per_class labelled documents of each class that are not held out, and the weights that restore the classes' shares."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, parts, part)).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = {y: min(1.0, per_class / max(1, sizes.get(y, 0))) for y in (0, 1)}
    limit = F.when(F.col("label") == 1, share[1]).otherwise(share[0]) * (1 << 30)
    drawn = known.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) < limit)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialized(texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))), (1 / share[0], 1 / share[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, parts: int, part: int, per_class: int, rarest: float, k: int, folds: int = 4) -> Index:
    kind = docs.schema[id_col].dataType.simpleString()
    drawn, weight = examples(docs, labels, id_col, text_col, label_col, parts, part, per_class)
    total = docs.count()
    least = max(1.0, rarest * total)
    idf = lambda n: np.log((1 + total) / (1 + n)) + 1e-3
    codes, n = frequencies(docs.select(F.col(text_col).alias("text")), least)
    drawn = drawn.select("id", "label", "text", F.xxhash64("text").alias("hash"))
    known = _counted(drawn, f"id {kind}, label int, hash long").toArrow().sort_by([("label", "ascending"), ("hash", "ascending"), ("id", "ascending")]).combine_chunks()  # the bounded sample
    texts = [np.concatenate([np.zeros(0, np.int64), *(x.flatten().to_numpy() for x in known.column(c).chunks)]) for c in ("terms", "counts")]
    sizes = np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy() for x in known.column("terms").chunks)]).astype(np.int64)
    marks, names, y = known.column("hash").to_numpy(), known.column("id").to_pylist(), known.column("label").to_numpy().astype(float)

    def some(rows: np.ndarray) -> list[np.ndarray]:
        which = np.repeat(rows, sizes)
        return [texts[0][which], texts[1][which], np.concatenate([[0], np.cumsum(sizes[rows])])]

    def index(rows: np.ndarray) -> Index:
        terms, counts, cuts = some(rows)
        weights = Weights(codes, idf(n), idf(least), terms, cuts, y[rows])
        vectors, light = weights.rows(terms, counts, cuts)
        return Index(weights, [names[k] for k in np.flatnonzero(rows)], y[rows], vectors, weight, k, light=light, others=weights.columns - weights.dense)

    part = (marks.view(np.uint64) % np.uint64(folds)).astype(int)  # equal texts stay together

    def votes_of(f: int) -> np.ndarray:
        other = index(part != f)
        return other.vote(*other.of(*some(part == f)))

    votes = np.zeros(len(y))
    if 0 < y.sum() < len(y):
        for f in np.unique(part).tolist():
            votes[part == f] = votes_of(f)  # one index at a time is held
    whole = index(np.ones(len(y), bool))
    if 0 < y.sum() < len(y):
        whole.calibrate(votes, y)
    return whole


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5, part: int = 0, per_class: int = 1536, rarest: float = 1e-4, k: int = 15) -> DataFrame:
    """(id_col, held_out, score, predicted, evidence) of every row of docs.

    labels has id_col and label_col (above 0: toxic; of several labels of a document the largest counts).
    evidence lists the ids and cosines of the up to k nearest examples, which are those that vote. Null
    and empty texts have no terms and get the score of texts unlike any example. Examples of equal cosine
    are taken by a hash of their text, not by id. Without labels of both classes every score is
    the share of toxic labels (0 without any). Null ids are scored, never learned from; repeated rows
    keep their rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    index_again = shipped(docs.sparkSession, fit(docs, labels, id_col, text_col, label_col, parts, part, per_class, rarest, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, index = counter(), index_again()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sims, where = index.of(*count(b.column("text").to_pylist()))
                p = index.score(sims, where)
                evidence = [[{"id": index.ids[w], "cosine": float(s)} for s, w in zip(x, y) if w >= 0] for x, y in zip(sims, where)]
                t = pa.list_(pa.struct([("id", b.schema.field("id").type), ("cosine", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(evidence, t)], names=["id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, parts, part).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, evidence array<struct<id:{kind},cosine:double>>").withColumnRenamed("id", id_col)


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5, part: int = 0, per_class: int = 1536, rarest: float = 1e-4, k: int = 15):
    """A column function from texts to scores, as score() gives them for docs."""
    index_again = shipped(docs.sparkSession, fit(docs, labels, id_col, text_col, label_col, parts, part, per_class, rarest, k))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count, known = counter(), index_again()
        for s in texts:
            p = [np.zeros(0)]
            for at in range(0, len(s), 1024):
                p.append(known.score(*known.of(*count(s.iloc[at : at + 1024].tolist()))))
            yield pd.Series(np.concatenate(p))

    return F.pandas_udf(run, "double")
