"""Documents that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "river stone garden letter window market winter silver bridge candle forest harbor island kitchen ladder mirror needle orange pepper quarry rocket saddle temple urchin velvet walnut yellow zephyr".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.3 else "") for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 60)
    words = base.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, "   \n\t ", "de", "a"),
        (7, "one", "de", "a"), (8, prose(2, 6000), "en", "a"), (9, prose(3, 80), "de", "a"), (9, prose(3, 80), "de", "a"), (None, prose(4, 50), "fr", None), (None, None, None, None),
        (12, "ÄÖÜ straße 日本語 \U0001f600 a\u0301", "de", "a"), (13, "12345 !!! ???", "en", "a"), (100, prose(5, 40), "fr", "c"), (150, prose(6, 40), "fr", "c"),
    ]


#: Columns whose names operators use inside.
CLASH = "doc_id long, text string, lang string, source string, id string, label int, score string, fingerprint int, terms int, value int, length int, leaks_ int"


def documents(spark, more=()):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, 5, 6) for r in [*rows(), *more]], CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)
