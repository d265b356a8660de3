from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "hy", "ja", "ke") for b in ("lo", "mi", "nu", "pa", "qe", "ri", "so", "ta", "vu")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        s = [rng.choice(WORDS) + rng.choice(WORDS) * rng.randint(0, 1) for _ in range(rng.randint(4, 12))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


@pytest.fixture()
def rng():
    return random.Random(7)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that every operator over documents must take: nulls, empty and odd texts, repeated rows, equal texts.
ODD = [
    (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \t\n ", "en", "s", 4), (None, "no id here at all", "en", "s", 1),
    (9004, "same text", "en", "s", 9), (9005, "same text", None, None, 9), (9004, "same text", "en", "s", 9), (9006, "ünïcödé ﬂow 日本語 K", "xx", "t", 3),
]


def documents(spark, rows):
    return spark.createDataFrame([(r + ("en", "s", None))[:5] if len(r) < 5 else r for r in rows], SCHEMA)
