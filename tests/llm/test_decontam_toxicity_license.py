import random
import re
import textwrap
import time
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest

from ledgerloom.llm import decontam, license_scan, toxicity
from ledgerloom.llm.queries import table

from ..conftest import DATA
from .fixtures import documents, empty, prose, rows


def slow_alignment(item, words):
    h = np.zeros((len(item) + 1, len(words) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == words[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_smith_waterman_matches_the_plain_table():
    r = random.Random(4)
    for _ in range(40):
        item = np.array([r.randint(0, 4) for _ in range(r.randint(1, 9))])
        passages = [np.array([r.randint(0, 5) for _ in range(r.randint(1, 14))]) for _ in range(5)]
        score, end = decontam.smith_waterman(item, passages)
        for s, e, p in zip(score, end, passages):
            assert s == slow_alignment(item, p) == slow_alignment(item, p[:e])


ITEMS = [(k, prose(100 + k, 18 + 3 * k)) for k in range(8)] + [(20, None), (21, ""), (22, "too short"), (23, prose(100, 18))]


def leaking():
    edit = lambda words, n: " ".join(w if (k + 2) % n else "edited" for k, w in enumerate(words))
    out = []
    for k, text in ITEMS[:8]:
        w = text.split()
        out.append((300 + k, prose(50 + k, 200) + " " + text + " " + prose(70 + k, 100), "en", "x"))
        out.append((320 + k, prose(60 + k, 80) + ". " + edit(w, 6).upper() + "!", "en", "x"))
        out.append((340 + k, " ".join([*w[:9], "put", "in", *w[9:]]), "en", "x"))
    return out


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, leaking())
    for size in (1 << 23, 300):  # one block of items, or several
        found = {}
        for r in decontam.scan(docs, items, ["doc_id"], block_chars=size).collect():
            found.setdefault(r.doc_id, set()).update(x.item_id for x in r.leaks)
        for k in range(8):
            same = {k, 23} if k == 0 else {k}
            assert found[300 + k] == found[320 + k] == found[340 + k] == same
        assert not any(found[i] for i in found if i is None or i < 300)


def test_a_leak_in_every_document_is_still_found(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    docs = spark.createDataFrame([(k, prose(k, 30) + " " + ITEMS[0][1]) for k in range(60)], "doc_id long, text string")
    found = decontam.scan(docs, items, ["doc_id"]).collect()
    assert len(found) == 60 and all(len(r.leaks) == 1 and r.leaks[0].score == 1.0 and r.leaks[0].first_word == 30 for r in found)


def test_seeds_lose_nothing_that_whole_alignment_finds(spark):
    """Every document against every item, unseeded: long items, halves, edited copies, short items."""
    long = prose(900, 400).split()
    items = [*ITEMS[:8], (30, " ".join(long)), (31, prose(901, 150)), (32, "two words"), (33, "Single!")]
    edited = lambda words, n: [w if (k + 1) % n else "changed" for k, w in enumerate(words)]
    data = [r[:4] for r in [*rows(), *leaking()]]
    for k, part in enumerate((long[:230], long[100:135], long[300:], edited(long[50:200], 4), edited(long[:60], 5), long[200:212], edited(long[20:90], 3))):
        data += [(500 + 10 * k + c, " ".join([prose(700 + k + c, 60), *part, prose(800 + k + c, 60)]), "en", "x") for c in range(3)]
    data += [(600, "Two words.", "en", "x"), (601, "single", "en", "x"), (602, "so two words are no leak", "en", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = {(r.doc_id, x.item_id): x.score for r in decontam.scan(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect() for x in r.leaks}
    block = decontam.Items([i for i, _ in items], [t for _, t in items], 3)
    want = {(600, 32): 1.0, (601, 33): 1.0}
    for i, text, *_ in data:
        ids = block.read(text)
        for item, name in zip(block.words, block.ids):
            if len(ids) and i is not None:
                best, end = (x[0] for x in decontam.smith_waterman(item, [ids]))
                length = decontam.smith_waterman(item[::-1], [ids[:end][::-1]])[1][0] if best else 0
                if best >= 1.2 * min(50, len(item)) and best >= 1.2 * min(len(item), length):
                    want[i, name] = max(want.get((i, name), 0), min(1.0, best / (2 * min(50, len(item)))))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.15 for k in want)
    assert sum(k[1] == 30 for k in want) >= 12


def test_leaks_under_another_name(spark):
    docs = spark.createDataFrame([(1, ITEMS[5][1], "mine")], "doc_id long, text string, leaks string")
    (one,) = decontam.scan(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), docs.columns, out_col="leaks_").collect()
    assert one.leaks == "mine" and [x.item_id for x in one.leaks_] == [5]


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.scan(empty(spark), items, ["doc_id", "text"]).collect() == []
    assert all(r.leaks == [] for r in decontam.scan(documents(spark), items.where("false"), ["doc_id"]).collect())


def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, DATA.replace("0.001", "0.01"), "documents"), table(spark, DATA.replace("0.001", "0.01"), "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.score(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    toxic, clean = ([r.score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) >= 0.7
    again = docs.select("doc_id", toxicity.scorer(docs, labels)("text").alias("p")).collect()
    assert all(abs(x.score - y.p) < 1e-5 for x, y in zip(sorted(found, key=lambda r: r.doc_id), sorted(again, key=lambda r: r.doc_id)))


def test_nearest_is_exact():
    r = np.random.default_rng(1)
    vectors = np.where(r.random((300, 40)) < 0.1, r.random((300, 40)), 0).astype(np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    index = toxicity.Index(np.ones(40), list(range(300)), (r.random(300) < 0.3).astype(float), vectors, (1.0, 1.0), k=7, block=16)
    sims, where = index.nearest(vectors[:50])
    full = vectors[:50] @ index.vectors.T
    want = np.sort(full, axis=1)[:, ::-1][:, :7]
    assert np.allclose(sims, np.maximum(want, 0), atol=1e-5)
    assert np.allclose(np.where(where >= 0, np.take_along_axis(full, np.maximum(where, 0), 1), 0), sims, atol=1e-5)


def test_cosines_count_every_term_of_the_whole_text(spark):
    texts = [(k, prose(k, 60 if k % 3 else 900), int(k % 2 and k < 80)) for k in range(120)]
    texts = [(k, t + (" rascal knave" if y else ""), y) for k, t, y in texts] + [(500, "rascal " + prose(500, 2000), 0), (501, "unheard plainly " * 9, 0), (502, "plainly", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    labels = docs.where("doc_id < 120 OR doc_id = 502").select("doc_id", "toxic")
    index = toxicity.fit(docs, labels, "doc_id", "text", "toxic", 5, 0, 1536, 1e-4, 15)
    count = toxicity.counter()
    terms = {k: dict(zip(*(x.tolist() for x in count([t])[:2]))) for k, t, _ in texts}
    df = {}
    for c in (c for x in terms.values() for c in x):
        df[c] = df.get(c, 0) + 1
    known = [i for i, _, _ in texts if i in index.ids]
    toxic = {k: y for k, _, y in texts}
    factor = {c: toxicity.evidence(np.array([float(sum(c in terms[i] for i in known))]), np.array([float(sum(c in terms[i] and toxic[i] for i in known))]), len(known), sum(toxic[i] for i in known))[0] for c in df}
    vector = {k: {c: (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[c])) + 1e-3) * factor[c] for c, n in x.items()} for k, x in terms.items()}
    norm = {k: np.sqrt(sum(v * v for v in x.values())) for k, x in vector.items()}
    slope, shift = index.calibration
    for r in toxicity.score(docs, labels).collect():
        near = sorted(((sum(v * vector[i].get(c, 0) for c, v in vector[r.doc_id].items()) / norm[i] / norm[r.doc_id], toxic[i]) for i in known), reverse=True)[:15]
        assert np.allclose([x.cosine for x in r.evidence], [x for x, _ in near if x > 0], atol=1e-4)
        vote = sum(x * x * y * index.weight[y] for x, y in near) / (sum(x * x * index.weight[y] for x, y in near) + 0.02 * index.weight.max())
        assert abs(r.score - 1 / (1 + np.exp(-(slope * vote + shift)))) < 1e-3
        if r.doc_id == 500:  # the rest of a long text counts beside its one word of the toxic ones
            assert r.evidence[0].cosine < 0.9
        if r.doc_id == 501:  # a word that tells the classes nothing finds its example
            assert r.evidence[0].id == 502


def test_terms_are_words_and_their_beginnings():
    texts = [r[1] for r in rows()] + ["Straßenbahn über_42 \U00010400\U00010401\U00010402\U00010403\U00010404x été-là \ud800x", "a" * 30 + " " + "bb " * 50, None, ""]
    whole, pieces = toxicity.counter()(texts), toxicity.counter(longest=7, at_once=5)(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))
    code = {}
    for k, text in enumerate(texts):
        want = {}
        for w in re.findall(r"\w+", (text or "").lower()):
            for term in [w, *("^" + w[:n] for n in (4, 5) if len(w) > n)]:
                want[term] = want.get(term, 0) + 1
        got = dict(zip(*(x[whole[2][k] : whole[2][k + 1]].tolist() for x in whole[:2])))
        assert sorted(got.values()) == sorted(want.values()) and list(got) == sorted(got)
        for term in want:
            code.setdefault(term, set()).update(c for c, n in got.items() if n == want[term])
            code[term] &= {c for c, n in got.items() if n == want[term]}
    assert all(code.values())  # every term has the same code wherever it occurs


def test_toxicity_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 1, "x"), (7, 0, "x"), (8, 0, "x"), (9, 0, "x"), (9, 1, "x"), (12, None, "x"), (None, 1, "x"), (13, 0, "x"), (100, 0, "x")], "doc_id long, toxic int, text string")
    found = toxicity.score(documents(spark), labels).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(empty(spark), labels).collect() == []
    assert {r.score for r in toxicity.score(documents(spark), labels.where("false")).collect()} == {0.0}
    assert len({r.score for r in toxicity.score(documents(spark), labels.where("toxic = 1")).collect()}) == 1


LICENSED = [
    (400, prose(1, 90) + "\nLicensed under the Apache License, Version 2.0.", "en", "x"),
    (401, "Released under the MIT License.\n" + prose(2, 90) + "\nLicensed under CC BY-NC 4.0.", "en", "x"),
    (402, "This work is licensed under the GNU General Public License, at least version 2.", "en", "x"),
    (403, license_scan.TEMPLATES[2][1].replace(" copies of ", "\ncopies of\n").replace("\n", "\n") + "\n\n" + prose(3, 50), "en", "x"),
    (404, "He was granted a driving license in May, and the public domain is large.", "en", "x"),
    (404, "He was granted a driving license in May, and the public domain is large.", "en", "x"),
    (None, "licensed UNDER cc by-sa 4.0", "en", "x"),
]


def test_license_notices(spark):
    found = license_scan.scan(documents(spark, LICENSED)).collect()
    got = sorted(((r.doc_id, r.license, r.verdict) for r in found), key=str)
    want = [(400, "Apache-2.0", "exact"), (401, "MIT", "exact"), (401, "CC-BY-NC-4.0", "exact"), (402, "GPL-2.0", "modified"), (403, "MIT", "exact"), (None, "CC-BY-SA-4.0", "exact")]
    assert got == sorted(want, key=str)
    text = {r[0]: r[1] for r in LICENSED}
    (gpl,) = [r for r in found if r.doc_id == 402]
    assert (gpl.missing, gpl.extra) == ("", "at least")
    (apache,) = [r for r in found if r.doc_id == 400]
    assert text[400][apache.first_char : apache.last_char] == "Licensed under the Apache License, Version 2.0"
    assert license_scan.scan(empty(spark)).collect() == []


def test_notices_of_several_paragraphs_and_on_one_line():
    scanner, wording = license_scan.Scanner(), dict(license_scan.TEMPLATES[::-1])
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        text = next(t for x, t in license_scan.TEMPLATES if x == name)
        for n in (1, 2, 3):
            text = text.replace(f" {n}. ", f"\n\n{n}. ")
        (one,) = scanner.scan(prose(1, 50) + "\n\n" + text + "\n\n" + prose(2, 50))
        assert (one["license"], one["missing"], one["extra"]) == (name, "", "")
    apache = license_scan.TEMPLATES[4][1]
    (one,) = scanner.scan(apache.replace(" You may obtain", "\n\nYou may obtain").replace(" Unless", "\n\nUnless"))
    assert (one["template"], one["missing"], one["extra"]) == (4, "", "")
    line = f"{wording['MIT']} {prose(3, 40)} {wording['Apache-2.0']} {prose(4, 40)} Licensed under CC BY-NC 4.0."
    assert [x["license"] for x in scanner.scan(line)] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0"]


def test_own_templates_need_no_cue(spark):
    own = [("House", "Anyone may copy this text as often as they like, so long as the kitchen stays tidy.")]
    docs = spark.createDataFrame([(1, prose(1, 40) + "\n" + own[0][1] + "\n" + prose(2, 40)), (2, own[0][1].replace("often", "seldom")), (3, prose(3, 90))], "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.verdict) for r in license_scan.scan(docs, templates=own).collect()) == [(1, "House", "exact"), (2, "House", "modified")]


def test_notices_in_very_long_lines_and_whole_licenses():
    scanner = license_scan.Scanner()
    mit, apache = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[4][1]
    line = " ".join([prose(5, 9000), mit, prose(6, 9000), apache, prose(7, 9000), "Licensed under CC BY-NC 4.0.", prose(8, 4000), "the license " * 3000])
    began = time.time()
    assert [(x["license"], x["missing"], x["extra"]) for x in scanner.scan(line)] == [("MIT", "", ""), ("Apache-2.0", "", ""), ("CC-BY-NC-4.0", "", "")]
    assert time.time() - began < 60
    (one,) = scanner.scan(mit.replace(" The above", "\n\nThe above") + "\n\nTHE SOFTWARE IS PROVIDED AS IS.")
    assert (one["license"], one["missing"], one["extra"]) == ("MIT", "", "")


@pytest.mark.parametrize("sign", ["", "// ", "# ", " * "])
@pytest.mark.parametrize("width", [20, 30, 40, 60, 72])
def test_wrapped_notices_are_whole(width, sign):
    scanner = license_scan.Scanner()
    for k, (name, wording) in enumerate(license_scan.TEMPLATES):
        body = "\n".join(sign + x for x in textwrap.wrap(wording, width, break_long_words=False))
        for text in (body, f"{prose(k, 30)}\n\n{body}\n\n{prose(k + 50, 30)}", f"{prose(k, 30)}\n{body}\n{prose(k + 50, 30)}"):
            assert [(x["license"], x["missing"], x["extra"]) for x in scanner.scan(text)] == [(name, "", "")], text


def test_notices_that_begin_before_what_speaks_of_them(spark):
    unlicense, mpl, apache = (license_scan.TEMPLATES[k][1] for k in (16, 15, 4))
    texts = [
        (1, unlicense.replace("released into", "\nreleased into")),
        (2, mpl.replace("Mozilla Public", "Mozilla\n// Public")),
        (3, f"{unlicense.replace('into the public', 'into the' + chr(10) + 'public')} Released under the MIT License."),
        (4, apache.replace("licenses/", "licen\nses/")),
        (5, "Mozilla, a\n\npublic body, grants nothing here."),
    ]
    got = [(r.doc_id, r.license, r.verdict) for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, "Unlicense", "exact"), (2, "MPL-2.0", "exact"), (3, "MIT", "exact"), (3, "Unlicense", "exact"), (4, "Apache-2.0", "modified")]


def plain_best(text):
    """Every template against every stretch of lines, by words in common alone, without compression or cues."""
    lines, found = text.split("\n"), []
    for a in range(len(lines)):
        for b in range(a + 1, min(len(lines), a + 6) + 1):
            words = [w for w, _, _ in license_scan.words_of("\n".join(lines[a:b]))]
            for k, (name, template) in enumerate(license_scan.TEMPLATES):
                own = [w for w, _, _ in license_scan.words_of(template)]
                at = [m for m in SequenceMatcher(None, own, words, autojunk=False).get_matching_blocks() if m.size]
                if at:
                    hit, span = sum(m.size for m in at), at[-1].b + at[-1].size - at[0].b
                    if 2 * hit / (len(own) + span) >= 0.8:
                        found.append((hit, 2 * hit / (len(own) + span), name, a))
    return max(found)[2] if found else None


def test_scan_agrees_with_plain_comparison(spark):
    r = random.Random(11)
    texts = []
    for k in range(60):
        words = r.choice(license_scan.TEMPLATES)[1].split(" ")
        for _ in range(r.choice([0, 0, 1, len(words) // 10])):
            words[r.randrange(len(words))] = r.choice(["changed", "", "thing"])
        body = " ".join(w for w in words if w)
        if k % 2:
            body = textwrap.fill(body, max(len(body) // 3, 40), break_long_words=False)
        texts.append((k, "\n".join([prose(k, 12), body if k % 3 else prose(900 + k, 30), prose(k + 500, 12)])))
    got = {}
    for x in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, []).append(x.license)
    for k, text in texts:
        assert (got.get(k) or [None])[0] == plain_best(text), text


def test_every_license_line_of_the_table_is_found(spark):
    docs = table(spark, DATA, "documents")
    lines = {r.doc_id for r in docs.collect() if any(x in r.text for x in ("the Apache License, Version 2.0.", "the MIT License.", "CC BY-NC 4.0.", "General Public License, version 3."))}
    assert {r.doc_id for r in license_scan.scan(docs).collect()} == lines and lines
