import random
import zlib

import pytest

from ledgerloom.llm import langid, token_counts, url_filter
from ledgerloom.llm.queries import URL_RULES, table

from ..conftest import DATA
from .fixtures import documents, empty, rows


def test_language_on_held_out_documents(spark):
    docs = table(spark, DATA, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.identify(docs).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_rows(spark):
    found = langid.identify(documents(spark)).collect()
    assert len(found) == len(rows())
    for r in found:
        if r.doc_id in (4, 5, 6, 13):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert not any(r.held_out for r in found if r.doc_id is None)
    assert langid.identify(empty(spark)).collect() == []
    nothing = documents(spark).selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}


def test_mixed_and_tiny_texts_are_flagged(spark):
    docs = table(spark, DATA.replace("0.001", "0.01"), "documents")
    model = langid.fit(docs, "doc_id", "text", "lang")
    texts = {}
    for r in docs.where("length(text) BETWEEN 500 AND 4000 AND text RLIKE '[a-z]'").orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(r.text)
    r = random.Random(3)
    mixed, mostly, whole, tiny = [], [], [], []
    for _ in range(60):
        a, b = r.sample(sorted(texts), 2)
        t, u = r.choice(texts[a])[:500], r.choice(texts[b])[:500]
        mixed.append(model.predict(t + " " + u))
        mostly.append(model.predict(t + " " + u[:100])[0] == a)
        whole.append((model.predict(t), a))
        tiny.append(model.predict(t[:2] + "x"))
    assert sum(x[3] for x in mixed) > 30 and sum(x[3] for x in tiny) > 30
    assert sum(x[0] == a and not x[3] for x, a in whole) >= 54 and sum(mostly) >= 54
    assert sum(x[1] for x in mixed) < sum(x[1] for x, _ in whole) - 10


def test_one_language_and_too_many(spark):
    df = spark.createDataFrame([(k, "words of it", f"l{k % 3}") for k in range(12)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score, r.ambiguous) for r in langid.identify(df.where("lang = 'l1'")).collect()} == {("l1", 1.0, False)}
    assert {(r.lang_pred, r.ambiguous) for r in langid.identify(df).collect()} == {("l0", True)}  # all alike: the first by name
    with pytest.raises(ValueError):
        langid.fit(df, "doc_id", "text", "lang", most_languages=2)


@pytest.mark.parametrize("n", [2, 3, 5, 9, 30])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))
    assert set(code.ravel()) == {1, -1}


def test_long_texts_are_counted_in_pieces():
    text = "".join(random.Random(1).choice("abcdé ") for _ in range(5000))
    assert (langid.ngram_counts(text) == langid.ngram_counts(text, piece=100)).all()


URLS = [
    (1, "http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (2, "HTTP://M.EXAMPLE.com/en/1?x#y", "m.example.com", "/en/1", "example.com/en/", "block"),
    (3, "https://a.example.com/EN/", "a.example.com", "/EN/", "com/", "allow"),
    (4, "https://a.net/es/", "a.net", "/es/", "net/es/", "block"), (5, "https://a.net/fr", "a.net", "/fr", None, None),
    (6, "x://com/", "com", "/", "com/", "allow"), (7, "x://dotcom/", "dotcom", "/", None, None), (8, "x://a.com", "a.com", "", None, None),
    (9, None, "", "", None, None), (10, "no scheme", "", "", None, None), (11, "a://b://c/d", "b:", "//c/d", None, None), (12, "", "", "", None, None), (13, "a://h?q=/en/", "h", "", None, None), (13, "a://h?q=/en/", "h", "", None, None),
    (None, "a://k.net/fr/x\ny", "k.net", "/fr/x\ny", "net/fr/", "block"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, 1, "r") for i, u, *_ in URLS], "page_id long, url string, host int, rule string")
    found = sorted(url_filter.judge(df, URL_RULES, "page_id").collect(), key=lambda r: (r.page_id is None, r.page_id))
    for r, (i, _, host, path, rule, verdict) in zip(found, sorted(URLS, key=lambda r: (r[0] is None, r[0]))):
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge(df.where("false"), URL_RULES, "page_id").collect() == []


def test_url_classifier_on_unseen_hosts():
    w = url_filter.train()
    for host in ("casino-win.example.org", "free-bets.example.net", "cheap-pills.example.org"):
        assert url_filter.score(w, host, "/en/1.html") >= 0.5
    for host in ("ththat.example.net", "www.tionsh.example.org", "library.example.net"):
        assert url_filter.score(w, host, "/en/1.html") < 0.5


def greedy(pieces, word):
    """Longest match first, as tuples of symbols."""
    s, n = (*word, token_counts.END), 0
    while s:
        best = max((k for k in range(1, len(s) + 1) if s[:k] in pieces), default=0)
        if not best:
            return n if s == (token_counts.END,) else None
        s, n = s[best:], n + 1
    return n


def test_automaton_matches_greedy_search():
    r = random.Random(3)
    for _ in range(60):
        pieces = {tuple(r.choice(b"abc") for _ in range(r.randint(1, 4))) + ((token_counts.END,) if r.random() < 0.4 else ()) for _ in range(r.randint(1, 15))}
        automaton = token_counts.Automaton(pieces)
        for _ in range(60):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 9)))
            want = greedy(pieces, word)
            assert automaton.count(word) == (1 + token_counts._UNKNOWN if want is None else want), (pieces, word)


def test_token_counts_of_edge_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    found = token_counts.count_tokens(documents(spark), path).collect()
    assert len(found) == len(rows())
    pieces = set(token_counts.vocabulary(path))
    by = {r.doc_id: r for r in found}
    assert tuple(by[4])[1:] == (0, 0, 0, 0) and tuple(by[6])[2:] == (0, 0, 0)
    assert by[12].n_tokens == sum(greedy(pieces, w.encode()) for w in token_counts._WORDS.findall("äöü straße 日本語 \U0001f600 a\u0301"))
    assert token_counts.count_tokens(empty(spark), path).collect() == []
