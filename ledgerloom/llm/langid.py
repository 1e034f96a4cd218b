"""Language ID by error-correcting output codes over hashed byte n-grams.

Every language has a codeword; one binary classifier for each bit separates the languages whose codeword
has the bit from the others, as log odds of n-gram frequencies. A text's margins are means over its n-grams,
drawn to zero in short texts, and are decoded to the codeword with the smallest logistic loss. How steeply
losses turn into scores is fitted on an eighth of the sample, by a model of the rest; texts whose two best
codewords are close are flagged.

Training looks at about `per_language` documents of each language (the documented bound): rows whose
hash lies below a threshold made from the language's row count. So the model's size and the work of
fitting stay the same for any input, and no language is shuffled into one task.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import by_batch, shipped

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14
#: Digits and ASCII punctuation say nothing of the language; they count as spaces.
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str, piece: int = 1 << 20) -> np.ndarray:
    """Counts of hashed byte n-grams of the lower-cased text; long texts are counted in pieces that overlap."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN) + b" ", np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), piece):
        for n in ORDERS:
            b = data[at : min(len(data), at + piece + n - 1)].astype(np.uint32)
            if len(b) < n:
                continue
            h = np.full(len(b) - n + 1, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) ^ b[k : len(b) - n + 1 + k]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            total += np.bincount(h >> np.uint32(18), minlength=BUCKETS)
    return total


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A matrix of +1 and -1, a row for each language: the exhaustive code up to 6 languages, else the best of seeded random ones."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 6:
        return np.array([[1 if lang == 0 or not (bit + 1) >> (lang - 1) & 1 else -1 for bit in range(2 ** (languages - 1) - 1)] for lang in range(languages)])
    width, rng = int(np.ceil(6 * np.log2(languages))), np.random.default_rng(seed)
    best, distance = None, -1
    for _ in range(200):
        code = np.where(rng.random((languages, width)) < 0.5, 1, -1)
        code = code[:, abs(code.sum(axis=0)) < languages]
        d = (((code.shape[1] - code @ code.T) / 2) + 1e9 * np.eye(languages)).min()
        if d > distance:
            best, distance = code, d
    return best


class Model:
    """languages (sorted), codewords, the weights of the bits' classifiers (log odds by bucket) and the scale of margins."""

    def __init__(self, counts: dict[str, np.ndarray], smooth: float = 0.5, scale: float = 5.0):
        self.languages, self.scale = sorted(counts), scale
        self.code = codewords(len(self.languages))
        if self.languages:
            p = np.array([(counts[x] + smooth) / (counts[x].sum() + smooth * BUCKETS) for x in self.languages])
            side = lambda bit, s: p[self.code[:, bit] == s].mean(axis=0) if (self.code[:, bit] == s).any() else 1 / BUCKETS
            self.weights = np.stack([np.log(side(b, 1) / side(b, -1)) for b in range(self.code.shape[1])], axis=1)

    def margins(self, text: str, short: int = 100) -> np.ndarray:
        """Mean log odds of each bit over the text's n-grams and `short` ones that say nothing."""
        counts = ngram_counts(text)
        return counts @ self.weights / (counts.sum() + short)

    def shares(self, margins: np.ndarray, scale: float | None = None) -> np.ndarray:
        """Scores of the languages (rows sum to 1) from rows of margins."""
        x = self.code[None] * margins[:, None] * (self.scale if scale is None else scale)
        loss = np.logaddexp(0, -x).mean(axis=2) * 2
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)

    def calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Sets the scale under which labelled rows are likeliest; one row of doubt more keeps it finite where all are right."""
        middle = np.argsort(np.sort(self.shares(margins), axis=1)[:, -1], kind="stable")[len(margins) // 2]
        doubt = np.argsort(-self.shares(margins[middle : middle + 1])[0], kind="stable")[1]
        m, y = np.concatenate([margins, margins[middle : middle + 1]]), np.append(labels, doubt)
        cost = lambda a: -np.log(np.maximum(self.shares(m, a)[np.arange(len(y)), y], 1e-300)).sum()
        self.scale = float(min(np.geomspace(0.25, 256, 121), key=cost))

    def predict(self, text: str | None, margin: float = 0.5) -> tuple[str, float, str | None, bool]:
        """(language or und, score, runner-up, ambiguous)."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, None, True
        p = self.shares(self.margins(text)[None])[0]
        order = np.argsort(-p, kind="stable")
        second = order[1] if len(p) > 1 else None
        return self.languages[order[0]], float(p[order[0]]), None if second is None else self.languages[second], second is not None and bool(p[order[0]] - p[second] < margin)


def held_out(id_col: str, parts: int, part: int):
    """True for rows whose crc32 of the id as text leaves that remainder; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 4000, most_languages: int = 1000) -> Model:
    """Model of about per_language rows for each non-null language of train (rows with a null id or text teach nothing).

    More than most_languages are refused, as the model grows with them.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return Model({})
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))))[F.col(lang_col).cast("string")]
    key = F.col(id_col).cast("string")
    drawn = rows.where(F.pmod(F.xxhash64(key, F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30))
    drawn = drawn.select(F.col(lang_col).cast("string").alias("lang"), (F.pmod(F.xxhash64(key, F.lit("scale")), F.lit(8)) == 0).alias("apart"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple[str, bool], np.ndarray] = {}
        for b in batches:
            for lang, apart, text in zip(*(b.column(c).to_pylist() for c in ("lang", "apart", "text"))):
                if has_letter(text):
                    sums[lang, apart] = sums.get((lang, apart), 0) + ngram_counts(text)
        for (lang, apart), c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([apart] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "apart", "bucket", "n"])

    counts: dict[bool, dict[str, np.ndarray]] = {False: {}, True: {}}
    for lang, apart, bucket, n in drawn.mapInArrow(run, "lang string, apart boolean, bucket int, n long").groupBy("lang", "apart", "bucket").agg(F.sum("n")).collect():  # 2 x BUCKETS rows a language at most
        counts[apart].setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] = n
    whole = Model({k: sum(c[k] for c in counts.values() if k in c) for k in {*counts[False], *counts[True]}})
    if len(whole.languages) < 2 or set(counts[False]) != set(whole.languages) or not counts[True]:
        return whole
    most = shipped(train.sparkSession, Model(counts[False]))

    def make():
        m = most()

        def f(cols):
            known = [(t, x) for t, x in zip(cols["text"].to_pylist(), cols["lang"].to_pylist()) if has_letter(t)]
            return {"lang": [x for _, x in known], "margins": [m.margins(t).tolist() for t, _ in known]}

        return f

    apart = by_batch(drawn.where("apart").select("lang", "text"), "lang string, margins array<double>", make).collect()  # the bounded sample's eighth
    if apart:
        apart.sort(key=lambda r: (r[0], r[1]))
        whole.calibrate(np.array([r[1] for r in apart]), np.array([whole.languages.index(r[0]) for r in apart]))
    return whole


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2, per_language: int = 4000) -> DataFrame:
    """(id_col, held_out, lang_pred, score, runner_up, ambiguous) of every row of docs.

    The model learns from rows that are not held out. Null texts and texts without a letter are `und`
    with score 0, as are all rows if no language can be learned; where one language is learned, all others
    get it with score 1. Of equally likely languages the alphabetically first is taken. A text is ambiguous
    if the two best scores lie less than 0.5 apart. Null ids are predicted, never learned from; repeated
    rows keep their rows; other columns are ignored.
    """
    model = shipped(docs.sparkSession, fit(docs.where(~held_out(id_col, parts, part)), id_col, text_col, lang_col, per_language))  # BUCKETS x bits numbers, whatever the input

    def make():
        m = model()

        def f(cols):
            found = [m.predict(t) for t in cols["text"].to_pylist()]
            return {"id": cols["id"], "held_out": cols["held_out"]} | {n: [x[k] for x in found] for k, n in enumerate(("lang_pred", "score", "runner_up", "ambiguous"))}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, parts, part).alias("held_out"), F.col(text_col).alias("text"))
    return by_batch(rows, f"id {kind}, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean", make).withColumnRenamed("id", id_col)


def identifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2, per_language: int = 4000, margin: float = 0.5):
    """A column function from texts to (lang_pred, score, ambiguous), as identify() gives them for docs; ambiguous are scores less than margin apart."""
    model = shipped(docs.sparkSession, fit(docs.where(~held_out(id_col, parts, part)), id_col, text_col, lang_col, per_language))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model()
        for s in texts:
            found = [m.predict(t, margin) for t in s]
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "ambiguous": [x[3] for x in found]})

    return F.pandas_udf(run, "lang_pred string, score double, ambiguous boolean")
