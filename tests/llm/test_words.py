from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skeinrisk.llm import periodic_runs, spelling

from .conftest import ODD, documents, prose


def plain_runs(w, least, periods):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def some_texts(rng):
    texts = []
    for _ in range(rng.randint(1, 5)):
        n, kinds = rng.choice([0, 1, 3, 10, 40, 80]), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        texts.append(w)
    return texts


@pytest.mark.parametrize("ask", [periodic_runs.ASK, 7])
def test_runs_match_brute_force(monkeypatch, ask):
    monkeypatch.setattr(periodic_runs, "ASK", ask)
    rng = random.Random(5)
    for _ in range(300):
        texts = some_texts(rng)
        least, periods = rng.choice([(6, 4), (2, 2), (4, 2), (6, 3)])
        got = periodic_runs.maximal_runs(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), least, periods)
        assert got == [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t, least, periods)]


def test_one_word_for_a_whole_long_text():
    n = 60_000
    assert periodic_runs.maximal_runs(np.zeros(n, np.int64), np.array([n])) == [(0, 0, n, 1)]


def plain_runs_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = best[1] * 1000 // best[2] if runs else None
    return (len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_digest_matches_brute_force(spark, rng, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TURN_WORDS", 500)
    rows = [(k, prose(rng, rng.choice([1, 8, 60, 300]))) for k in range(120)]
    rows += [(200 + k, " ".join(map(str, sum(some_texts(rng), [])))) for k in range(60)] + [(300, "a\n" * 5000), (301, "x y " * 900 + "z")]
    docs = documents(spark, [r + ("en", "s", None) for r in rows] + ODD).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed")
    got = sorted(map(tuple, periodic_runs.runs_digest(docs).collect()), key=str)
    assert got == sorted([(i, *plain_runs_row(i, t)) for i, t in rows + [o[:2] for o in ODD]], key=str)
    assert periodic_runs.runs_digest(docs.limit(0)).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_tries_find_all_words_one_edit_away():
    rng = random.Random(3)
    for _ in range(250):
        letters = rng.choice(["ab", "abc", "abcdeé"])
        some = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))  # noqa: B023, E731
        words = sorted({some() for _ in range(rng.randint(0, 60))})
        trie = spelling.Trie(words, [1] * len(words))
        for w in words + [some() for _ in range(10)]:
            assert {words[k] for k in trie.near(w)} == {x for x in words if one_edit(w, x)}


def test_very_long_words():
    long = ["a" * 50_000, "a" * 50_001, "ab" * 20_000, "ab" * 20_000 + "c"]
    trie = spelling.Trie(sorted(long), [1] * 4)
    assert {len(trie.words[k]) for k in trie.near("a" * 50_000)} == {50_001}
    assert {len(trie.words[k]) for k in trie.near("ab" * 20_000)} == {40_001}


def plain_spelling(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]+", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {w: [x for x in n if one_edit(w, x)] for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


@pytest.mark.parametrize("chars, sent", [(spelling.TRIE_CHARS, spelling.SENT_BYTES), (60, 500)])
def test_spelling_matches_brute_force(spark, rng, chars, sent):
    base = ["straße", "Ñandú", "naïveté", "letters", "lettres", "letter", "chain", "chains", "chainss", "chainsss", "K", "İstanbul"]
    rows = []
    for k in range(150):
        w = [rng.choice(base[: rng.randint(1, len(base))]) for _ in range(12)]
        w[0] = w[0][: rng.randint(0, 3)] + w[0][rng.randint(3, 5) :]
        rows.append((k, " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    rows.append((151, "steeple " * 60 + "steeples " * 25 + "steepless " * 10 + "steeplesss " * 4))
    docs = documents(spark, [r + ("en", "s", None) for r in rows] + ODD).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    got = spelling.variants(docs, spelling.misspelt, chars=chars, sent=sent).collect()
    want = plain_spelling(rows + [o[:2] for o in ODD])
    assert any(r["root"] != r["form"] for r in got if r["form"]) and len(got) == len(want)
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == want
    assert spelling.spelling_digest(docs.limit(0)).count() == 0
