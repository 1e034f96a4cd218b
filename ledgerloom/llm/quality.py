"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of log counts and log odds (STATISTICS), computed once over the whole text and
written to the shared folder; the rest works on these narrow rows. A class's mean and covariance come from
sums over all labelled rows that learning may use, added up by Spark; covariances are shrunk to the pooled
one and to a multiple of the identity. A score is the difference of the classes' log densities, from
Mahalanobis distances by cached inverse Cholesky factors, turned into a probability by a logistic curve. The
curve is fitted on the differences that each fold's rows have under the model of the other folds, as counts by
bins, so no row of learning reaches the driver.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_batch, materialized, shipped
from .langid import held_out

STATISTICS = (
    "log characters", "log words", "log letters a word", "log words a line", "odds of distinct words", "odds of the commonest word", "odds of a word like the one before",
    "odds of distinct lines", "odds of upper case among letters", "odds of letters", "odds of digits", "odds of sentence marks", "odds of exclamation marks", "odds of other ASCII signs",
)
_SPACE = re.compile(r"\s")
#: Kinds of bytes: 0 other (letters beyond ASCII), 1 upper case, 2 lower case, 3 digits, 4 sentence marks, 5 exclamation marks, 6 other signs, 7 white space and controls.
_KIND = np.array([0 if c >= 128 else 1 if chr(c).isupper() else 2 if chr(c).islower() else 3 if chr(c).isdigit() else 5 if c == 33 else 4 if chr(c) in ",.;:?'\"-()" else 7 if c <= 32 or c == 127 else 6 for c in range(256)], np.uint8)


def _odds(part, whole, one: float = 0.5) -> float:
    return float(np.log((part + one) / (whole - part + one)))


def describe(text: str | None, piece: int = 1 << 20) -> list[float]:
    """The statistics of a text; null counts as empty. Long texts are read in pieces that end where a word does."""
    text = text or ""
    kinds, words, same, n, last, lines, distinct, at = np.zeros(8, np.int64), Counter(), 0, 0, None, 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + piece) if len(text) - at > piece else None
        end = cut.start() if cut else len(text)
        part = text[at:end]
        kinds += np.bincount(_KIND[np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8)], minlength=8)
        own = part.split()
        words.update(own)
        same += sum(map(str.__eq__, own, own[1:])) + (bool(own) and own[0] == last)
        n, last, at = n + len(own), own[-1] if own else last, end
    for line in text.split("\n") if text else ():
        if line and not line.isspace():
            lines += 1
            distinct.add(hash(line))
    letters = int(kinds[0] // 2 + kinds[1] + kinds[2])  # a letter beyond ASCII takes two bytes mostly
    seen = int(kinds.sum() - kinds[7])
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), float(np.log((letters + 1) / (n + 1))), float(np.log((n + 1) / (lines + 1))), _odds(len(words), n), _odds(max(words.values(), default=0), n), _odds(same, n),
        _odds(len(distinct), lines), _odds(int(kinds[1]), letters), _odds(letters, seen), _odds(int(kinds[3]), seen), _odds(int(kinds[4]), seen), _odds(int(kinds[5]), seen), _odds(int(kinds[6]), seen),
    ]


class Model:
    """Means, inverse Cholesky factors and half log determinants of both classes, and the curve from log-density differences to scores.

    moments: by class (0, 1) the count, the sums and the sums of products of its vectors. The share `pool` of a
    covariance is the pooled one's, the share `ridge` of that a multiple of the identity with the same trace.
    A class without rows leaves no discriminant: all differences are 0.
    """

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = 0.2, ridge: float = 0.02):
        self.curve, self.parts = (0.0, 0.0), []
        if any(moments[c][0] < 1 for c in (0, 1)):
            return
        mean = [moments[c][1] / moments[c][0] for c in (0, 1)]
        spread = [moments[c][2] - moments[c][0] * np.outer(mean[c], mean[c]) for c in (0, 1)]
        k, total = len(mean[0]), moments[0][0] + moments[1][0]
        pooled = (spread[0] + spread[1]) / total
        for c in (0, 1):
            s = (1 - pool) * spread[c] / moments[c][0] + pool * pooled
            s = (1 - ridge) * s + (ridge * np.trace(s) / k + 1e-9) * np.eye(k)
            factor = np.linalg.cholesky(s)
            self.parts.append((mean[c], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances of rows of x to both classes."""
        return np.stack([(((x - m) @ f.T) ** 2).sum(axis=1) for m, f, _ in self.parts], axis=1) if self.parts else np.zeros((len(x), 2))

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        d = self.distances(x)
        return (d[:, 0] - d[:, 1]) / 2 + (self.parts[0][2] - self.parts[1][2]) if self.parts else np.zeros(len(x))

    def scores(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * flattened(difference) + self.curve[1], -700, 700)))


def flattened(difference: np.ndarray) -> np.ndarray:
    """Signed logarithms, as differences grow with the square of how odd a text is."""
    return np.sign(difference) * np.log1p(np.abs(difference))


def logistic(at: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (0 at least) and intercept of the likeliest curve for counts at points; a slight penalty on the slope keeps it finite where classes part."""
    a, b, n = 0.0, float(np.log((good.sum() + 0.5) / (bad.sum() + 0.5))), good + bad
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * at + b, -700, 700)))
        w, r = n * p * (1 - p) + 1e-9, good - n * p
        hessian = np.array([[(w * at * at).sum() + 0.1, (w * at).sum()], [(w * at).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [(r * at).sum() - 0.1 * a, r.sum()])
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def fit(rows: DataFrame, folds: int = 4, width: float = 0.05) -> Model:
    """Model of all rows of (x, label 0 or 1). Only sums by fold and counts by bin of the flattened difference, both of fixed size, reach the driver."""
    k = len(STATISTICS)
    rows = rows.select("x", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("x"), F.lit(folds)).cast("int").alias("fold"))  # equal texts share a fold

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, 2, 1 + k + k * k))
        for b in batches:
            x, cell = _matrix(b.column("x")), b.column("fold").to_numpy(zero_copy_only=False) * 2 + b.column("label").to_numpy(zero_copy_only=False)
            for c in np.unique(cell).tolist():
                own = x[cell == c]
                total[c // 2, c % 2] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        cells = np.flatnonzero(total[:, :, 0].ravel())
        if len(cells):
            flat = total.reshape(folds * 2, -1)[cells]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cells, flat.shape[1]), pa.int32()), pa.array(np.tile(np.arange(flat.shape[1]), len(cells)), pa.int32()), pa.array(flat.ravel())], names=["cell", "at", "value"])

    total = np.zeros((folds * 2, 1 + k + k * k))
    for cell, at, value in rows.mapInArrow(sums, "cell int, at int, value double").groupBy("cell", "at").agg(F.sum("value")).collect():
        total[cell, at] = value
    total = total.reshape(folds, 2, -1)
    moments = lambda s: {c: (s[c, 0], s[c, 1 : 1 + k], s[c, 1 + k :].reshape(k, k)) for c in (0, 1)}
    whole = Model(moments(total.sum(axis=0)))
    others = shipped(rows.sparkSession, [Model(moments(total.sum(axis=0) - total[f])) for f in range(folds)])

    def make():
        models = others()

        def f(cols):
            x, fold = _matrix(cols["x"]), cols["fold"].to_numpy(zero_copy_only=False)
            out = np.zeros(len(x))
            for n in np.unique(fold).tolist():
                out[fold == n] = models[n].differences(x[fold == n])
            return {"bin": np.rint(flattened(out) / width).astype(np.int32), "label": cols["label"]}

        return f

    counts = by_batch(rows, "bin int, label int", make).groupBy("bin", "label").count().collect()  # a flattened difference is below 100, so 2 x 2 x 100 / width rows at most
    bins = sorted({r[0] for r in counts})
    n = np.zeros((2, len(bins)))
    for b, label, c in counts:
        n[label, bins.index(b)] = c
    whole.curve = logistic(np.array(bins) * width, n[1], n[0])
    return whole


def statistics(docs: DataFrame, id_col: str, text_col: str, parts: int, part: int) -> DataFrame:
    """(id, held_out, x) of every row, kept in the shared folder: about as many bytes a row as there are statistics, times eight."""

    def make():
        return lambda cols: {"id": cols["id"], "held_out": cols["held_out"], "x": [describe(t.as_py()) for t in cols["text"]]}

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, parts, part).alias("held_out"), F.col(text_col).alias("text"))
    return materialized(by_batch(rows, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, x array<double>", make))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 5, part: int = 0, threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted, log_density, good_distance, bad_distance) of every row of docs.

    Learns from all labelled rows that are not held out; several equal labels of an id count once, an id with
    both labels, or with a null one, teaches nothing. Null texts are empty, and empty texts are scored like others.
    Without labels all scores are 0.5; with labels of one class only they are that class's smoothed share.
    Null ids are scored, never learned from; repeated rows keep their rows; other columns are ignored.
    """
    stats = statistics(docs, id_col, text_col, parts, part)
    label = F.col(label_col).cast("int")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("most"), F.count(label).alias("n"), F.count(F.lit(1)).alias("rows"))
    known = materialized(known.where("label = most and label in (0, 1) and n = rows").select("id", "label"))
    model = shipped(docs.sparkSession, fit(stats.where(~F.col("held_out")).join(known, "id")))

    def make():
        m = model()

        def f(cols):
            x = _matrix(cols["x"])
            difference, distance = m.differences(x), m.distances(x)
            s = m.scores(difference)
            return {"id": cols["id"], "held_out": cols["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32), "log_density": difference, "good_distance": distance[:, 1], "bad_distance": distance[:, 0]}

        return f

    out = by_batch(stats, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int, log_density double, good_distance double, bad_distance double", make)
    return out.withColumnRenamed("id", id_col)
