"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary is a byte trie. Every node has a failure link and the number of tokens that are popped
when it is followed, so one pass over a word's bytes gives the length of its greedy longest-match
segmentation without building the pieces.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from .common import by_batch, shipped

END = 256
_UNKNOWN = 1 << 40
#: Letters, a digit, or other signs: the words that are cut into pieces.
_WORDS = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Automaton:
    """Greedy longest-match counts for a vocabulary of symbol sequences (bytes, END behind word-final pieces).

    A word is its bytes and END. A word whose last piece has no word-final form may end with a plain
    piece: END alone is then free. A word with no segmentation counts as one unknown token.
    """

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.step: dict[int, int] = {}
        ends = [False]
        for piece in pieces:
            u = 0
            for c in piece:
                v = self.step.get(u << 9 | c)
                if v is None:
                    v = self.step[u << 9 | c] = len(ends)
                    ends.append(False)
                u = v
            ends[u] = u > 0
        free = self.step.get(END)
        if free is None:
            free = self.step[END] = len(ends)
            ends.append(True)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.step.items():
            children.setdefault(key >> 9, []).append((key & 511, v))
        self.fail: list[int] = [-1] * len(ends)
        self.popped = [0] * len(ends)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children.get(u, ()):
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, int(v != free)
                else:
                    z, more = self.fail[u], self.popped[u]
                    while z >= 0 and (z << 9 | c) not in self.step:
                        more += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.step[z << 9 | c], more
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Tokens of the word, 1 + _UNKNOWN if it has no segmentation."""
        step, fail, popped, u, n = self.step, self.fail, self.popped, 0, 0
        for c in (*word, END):
            while (v := step.get(u << 9 | c)) is None:
                if fail[u] < 0:
                    return 1 + _UNKNOWN
                n += popped[u]
                u = fail[u]
            u = v
        while u:
            if fail[u] < 0:
                return 1 + _UNKNOWN
            n += popped[u]
            u = fail[u]
        return n


def byte_symbols() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file with </w> behind word-final pieces."""
    symbols = byte_symbols()
    pieces = []
    with open(path, encoding="utf-8") as file:
        for token in json.load(file)["model"]["vocab"]:
            body = token.removesuffix("</w>")
            if all(c in symbols for c in body):
                pieces.append((*(symbols[c] for c in body), *((END,) if body != token else ())))
    return pieces


class _Counts(dict):
    """Token counts by word; the automaton runs once for each word, and the table is emptied when it is full."""

    def __init__(self, automaton: Automaton, most: int = 400_000):
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = self.automaton.count(word.encode("utf-8", "surrogatepass"))
        return n


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, n_words, n_tokens, n_unknown) of every row; path names the vocabulary file, read on the driver.

    Texts are lower-cased. Null and empty texts have zero of everything. Repeated rows and null ids
    keep their rows; other columns are ignored.
    """
    automaton = shipped(docs.sparkSession, Automaton(vocabulary(path)))  # as large as the vocabulary

    def make():
        counts = _Counts(automaton())

        def f(cols):
            out = {"id": cols["id"], "n_chars": [], "n_words": [], "n_tokens": [], "n_unknown": []}
            for text in cols["text"].to_pylist():
                words = _WORDS.findall((text or "").lower())
                unknown, tokens = divmod(sum(map(counts.__getitem__, words)), _UNKNOWN)
                for name, x in zip(("n_chars", "n_words", "n_tokens", "n_unknown"), (len(text or ""), len(words), tokens, unknown)):
                    out[name].append(x)
            return out

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return by_batch(rows, f"id {kind}, n_chars long, n_words long, n_tokens long, n_unknown long", make).withColumnRenamed("id", id_col)
