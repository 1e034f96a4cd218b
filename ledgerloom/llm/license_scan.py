"""License scan by conditional compression.

Candidate blocks are the lines that speak of a license, alone, with the lines that follow up to a blank
line, and with those that follow over blank lines; of very long lines the stretches around what speaks of a
license. Where that confirms no whole notice, as many words before it as a template has there are taken in, since
notices are wrapped: what speaks of a license may lie in a later line than the notice's begin, or over a line end. What stands before and after a confirmed notice in a block is searched again. A block is compressed with zstandard alone and with each template as a raw dictionary; the
templates are ranked by how much smaller the block gets, and the best ones are confirmed, or not, by the
exact differences in wording.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: License templates (fixed values): the wording of public licenses' notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

#: What candidate lines speak of (fixed values), in lower case.
CUES = ["license", "licence", "copyright", "permission is hereby", "permission to use", "redistribution and use", "public domain", "free software", "released under", "released into", "under the mit", "creative commons", "cc by", "cc-by", "cc0", "gnu ", "mozilla public"]

#: What may stand between two words or parts of a word that a line end divides, such as comment signs.
_BREAK = r"[\s/#*;>|%!-]"
_WORD = re.compile(rf"[^\W_]+(?:(?:\.|-(?:[ \t]*\n{_BREAK}*)?)[^\W_]+)*")
_DIVIDED = re.compile(rf"-[ \t]*\n{_BREAK}*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case, from, to); points and hyphens inside a word belong to it (2.0, CC-BY), also at a line end after the hyphen."""
    return [(_DIVIDED.sub("-", m[0]).lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def cue_pattern(cues: list[str]) -> str:
    """Any of the cues; where a cue has a space, a text may have a line end with comment signs."""
    return "|".join(rf"{_BREAK}+".join(map(re.escape, c.split(" "))) for c in cues)


def back(text: str, at: int, words: int, longest: int) -> int:
    """Where the `words`-th word before `at` begins, at most `longest` characters before it."""
    low = max(0, at - longest)
    begins = [m.start() for m in _WORD.finditer(text, low, at)][-words:] if words else []
    return begins[0] if begins else at


def blocks(text: str, longest: int, cue: re.Pattern) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Of every line with a cue its candidates (from, to) and where its cues begin.

    Candidates are the line, and the lines from it on, up to a blank line and over blank lines, about `longest` characters each.
    Of a line of more than twice `longest` characters every stretch of so many around a cue is one, and wide enough. A cue that
    a line end divides belongs to the line that it begins in.
    """
    found, lines, at = [], [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    cues: dict[int, list[int]] = {}
    begins = [a for a, _ in lines]
    for m in cue.finditer(text):
        if m.end() > m.start():
            cues.setdefault(bisect_right(begins, m.start()) - 1, []).append(m.start())
    for k, starts in cues.items():
        a, b = lines[k]
        if b - a > 2 * longest:
            last, some = a - longest, []
            for start in starts:
                if start >= last + longest // 4:
                    last = start
                    some += [(max(0, last - longest // 2), min(len(text), last + longest)), (last, min(len(text), last + longest))]
            found.append((some, []))
            continue
        some, e = [(a, b)], k
        while e + 1 < len(lines) and text[lines[e + 1][0] : lines[e + 1][1]].strip() and lines[e][1] - a < longest:
            e += 1
        if e > k:
            some.append((a, min(lines[e][1], a + 2 * longest)))
        far = e
        while far + 1 < len(lines) and lines[far][1] - a < longest:
            far += 1
        while far > e and not text[lines[far][0] : lines[far][1]].strip():
            far -= 1
        if far > e:
            some.append((a, min(lines[far][1], a + 2 * longest)))
        found.append((some, starts))
    return found


def cues_of(templates) -> list[str]:
    """CUES, and of every template without one its distinct words of five letters and more (all words where it has none)."""
    found = list(CUES)
    for _, text in templates:
        if not any(c in text.lower() for c in CUES):
            words = sorted({w for w, _, _ in words_of(text)})
            found += [w for w in words if len(w) >= 5] or words
    return sorted(set(found), key=lambda c: (found.index(c)))


def closest(parts: list, own: int) -> list:
    """The stretch of equal runs of words with the highest similarity to a template of `own` words; single words far off don't stretch a notice."""
    best = (0.0, 0, 0)
    for i in range(len(parts)):
        hit = 0
        for j in range(i, len(parts)):
            hit += parts[j].size
            best = max(best, (2 * hit / (own + parts[j].b + parts[j].size - parts[i].b), i - j, -i))
    i = -best[2]
    return parts[i : i - best[1] + 1]


class Scanner:
    """Templates with their compressors and words; cues are what candidate lines speak of."""

    def __init__(self, templates=TEMPLATES, ranked: int = 3, least: float = 0.8, cues: list[str] | None = None):
        import zstandard as z

        self.templates, self.ranked, self.least = templates, ranked, least
        self.cue = re.compile(cue_pattern(cues_of(templates) if cues is None else cues), re.I)
        self.longest = 2 * max(len(t) for _, t in templates)
        data = [t.lower().encode() for _, t in templates]
        self.alone = z.ZstdCompressor(level=3)
        self.given = [z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)) for d in data]
        self.words = [[w for w, _, _ in words_of(t)] for _, t in templates]
        first = [m.start() if (m := self.cue.search(t)) else 0 for _, t in templates]
        #: the most words that a template has before its first cue
        self.lead = max(sum(b < f for _, b, _ in words_of(t)) for f, (_, t) in zip(first, templates))
        #: what the template itself saves: a block that saves as much holds it whole
        self.whole = [max(1, self.saved(d, k)) for k, d in enumerate(data)]

    def saved(self, data: bytes, k: int) -> int:
        return len(self.alone.compress(data)) - len(self.given[k].compress(data))

    def judge(self, block: str) -> dict | None:
        """The best confirmed template of a block: license, template, reduction, similarity, missing, extra, from, to."""
        data = block.lower().encode("utf-8", "surrogatepass")
        saved = [self.saved(data, k) for k in range(len(self.given))]
        rank = sorted((k for k, s in enumerate(saved) if s > 0), key=lambda k: (-saved[k] / self.whole[k], -saved[k], k))
        rank = [*rank[: self.ranked], *sorted(rank[self.ranked :], key=lambda k: (-saved[k], k))[: self.ranked]]
        best, words = None, words_of(block)
        for k in rank:
            own = self.words[k]
            parts = [m for m in SequenceMatcher(None, own, [w for w, _, _ in words], autojunk=False).get_matching_blocks() if m.size]
            if not parts:
                continue
            parts = closest(parts, len(own))
            lo, hi = parts[0].b, parts[-1].b + parts[-1].size
            hit = sum(m.size for m in parts)
            taken = {i for m in parts for i in range(m.a, m.a + m.size)}
            inside = {i for m in parts for i in range(m.b, m.b + m.size)}
            similarity = 2 * hit / (len(own) + hi - lo)
            if similarity >= self.least and (best is None or (hit, similarity) > (best["hit"], best["similarity"])):
                best = {
                    "license": self.templates[k][0], "template": k, "reduction": saved[k], "similarity": similarity, "hit": hit,
                    "missing": " ".join(own[i] for i in range(len(own)) if i not in taken), "extra": " ".join(words[i][0] for i in range(lo, hi) if i not in inside),
                    "from": words[lo][1], "to": words[hi - 1][2], "front": parts[0].a,
                }
        return best

    def scan(self, text: str) -> list[dict]:
        """Confirmed notices of a text; of overlapping ones that with more words in common, then the closer."""
        found, seen = [], set()

        def search(todo: list[tuple[int, int]]) -> list[dict]:
            some = []
            while todo:
                a, b = todo.pop()
                if (a, b) in seen or not self.cue.search(text, a, b):
                    continue
                seen.add((a, b))
                if one := self.judge(text[a:b]):
                    one |= {"from": one["from"] + a, "to": one["to"] + a}
                    some.append(one)
                    todo += [(a, one["from"]), (one["to"], b)]
                    if one["front"]:  # its first words may lie before the candidate
                        todo.append((back(text, one["from"], 2 * one["front"], self.longest), b))
            return some

        for some, starts in blocks(text, self.longest, self.cue):
            one = search(list(some))
            bare = [c for c in starts if not any(x["from"] <= c < x["to"] and not x["missing"] for x in one)]
            if bare:  # outside of what is whole
                begin = back(text, bare[0], self.lead, self.longest)
                one += search([(begin, b) for _, b in some])
            found += one
        kept: list[dict] = []
        for one in sorted(found, key=lambda x: (-x["hit"], -x["similarity"], x["from"], x["template"])):
            if all(one["to"] <= x["from"] or x["to"] <= one["from"] for x in kept):
                kept.append(one)
        return sorted(kept, key=lambda x: x["from"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = 0.8, cues: list[str] | None = None) -> DataFrame:
    """A row for each license notice of each document: (id_col, first_char, last_char, license, reduction, similarity, missing, extra, verdict).

    reduction is the bytes that the template saves; missing and extra are the words that differ; verdict
    is exact (none differ) or modified (similarity of words at least `least`). Notices may be wrapped at any width and stand behind
    comment signs. Lines are looked at that have one of `cues`, over line ends too (by default CUES and, for templates that have none of them, their own words). Null
    and empty texts, and texts without a cue, give no rows; repeated rows and null ids give theirs; other
    columns are ignored.
    """
    cues = cues_of(templates) if cues is None else cues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least=least, cues=cues)
        for b in batches:
            rows = []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                for x in scanner.scan(text):
                    rows.append((i, x["from"], x["to"], x["license"], x["reduction"], x["similarity"], x["missing"], x["extra"], "modified" if x["missing"] or x["extra"] else "exact"))
            if rows:
                t = (b.schema.field("id").type, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), t)], names=["id", "first_char", "last_char", "license", "reduction", "similarity", "missing", "extra", "verdict"])

    low, cued = F.lower(text_col), F.lit(False)
    for cue in sorted(cues, key=lambda c: " " in c):
        parts = [p for p in cue.lower().split(" ") if p]
        if parts == [cue.lower()]:
            cued |= low.contains(parts[0])
        elif parts:  # over a line end; the pattern is asked where all parts are there
            cued |= reduce(lambda a, p: a & low.contains(p), parts, F.lit(True)) & low.rlike(cue_pattern([cue.lower()]).replace("\\ ", " "))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(cued).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, first_char int, last_char int, license string, reduction int, similarity double, missing string, extra string, verdict string").withColumnRenamed("id", id_col)
