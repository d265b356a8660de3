from __future__ import annotations

import hashlib
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from skeinrisk.llm import suffix_family as sf
from skeinrisk.llm.common import BRIEF_SHUFFLES, shared_dir

from .conftest import ODD, documents, prose


def plain(rows, least):
    """Per row: (bytes, removed, spans, hash of the rest), by counting every string."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + least] for _, t in texts for k in range(len(t) - least + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = True
        spans = int((gone[:-1] & ~gone[1:]).sum())
        rest = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def rows_of(rng, n):
    """Texts that share passages in every way: copies, edited copies, passages in other surroundings, periods, one letter."""
    passages = [prose(rng, k) for k in (4, 9, 20, 60, 60)]
    rows = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.45 and rows:
            w = rng.choice(rows)[1].split(" ")
            w[rng.randrange(len(w))] = rng.choice(["", "edited", "é"])
            text = " ".join(w)
        elif kind < 0.8:
            text = prose(rng, rng.randint(1, 20)) + rng.choice(passages)[rng.randint(0, 20) :] + prose(rng, rng.randint(1, 20))
        elif kind < 0.9:
            text = rng.choice(["a" * rng.randint(1, 300), "abc" * rng.randint(1, 90), "x\0y" * 40 + "\0" * rng.randint(0, 50)])
        else:
            text = prose(rng, rng.randint(1, 60))
        rows.append((len(rows), text))
    return rows


@pytest.mark.parametrize("least, how", [
    (20, {}), (400, {}), (20, {"key_chunks": 2, "shard_bytes": 300, "batches": 5}), (41, {"key_chunks": 3, "shard_bytes": 5000, "batches": 2}), (60, {"key_chunks": 1, "batches": 1}),
])
def test_suffix_digest_matches_brute_force(spark, rng, least, how, monkeypatch):
    monkeypatch.setattr(sf, "TURN_BYTES", 3000)
    rows = rows_of(rng, 150)
    docs = documents(spark, [r + ("en", "s", None) for r in rows] + ODD).withColumnRenamed("lang", "t").withColumnRenamed("source", "kept")
    got = sorted(map(tuple, sf.suffix_digest(docs, least=least, **how).collect()), key=str)
    want = plain(rows + [o[:2] for o in ODD], least)
    assert any(0 < r[2] < r[1] for r in want) and any(r[3] > 1 for r in want) or least == 400
    assert got == want


def test_crowded_key_is_dealt_again(spark, rng):
    """One passage, shorter than a string, in all texts: every key in it is crowded, and nothing is repeated but by chance."""
    passage = prose(rng, 60)[:380]
    rows = [(k, f"{k} {prose(rng, 30)}{passage}{prose(rng, 30)} {k}") for k in range(60)] + [(100, "z" + passage + "the very same end of two"), (101, "z" + passage + "the very same end of two")]
    docs = documents(spark, [r + ("en", "s", None) for r in rows])
    got = sorted(map(tuple, sf.suffix_digest(docs, key_chunks=4).collect()), key=str)
    assert got == plain(rows, 400) and sum(r[2] > 0 for r in got) == 2


def test_drop_repeated_keeps_rows_and_columns(spark, rng):
    twice = prose(rng, 90)
    rows = [(1, "one " + twice, "en", "s", 1), (2, twice + " two", "en", "s", 2), (3, "alone", "fr", None, 3)] + ODD
    docs = documents(spark, rows).withColumnRenamed("lang", "kept").withColumnRenamed("source", "t")
    got = {r["doc_id"]: r["text"] for r in sf.drop_repeated(docs).collect()}
    assert sf.drop_repeated(docs).columns == docs.columns and sf.drop_repeated(docs).count() == len(rows)
    assert (got[1], got[2], got[3], got[9001], got[9004]) == ("one ", " two", "alone", None, "same text")
    assert sf.suffix_digest(docs.limit(0)).count() == 0


def test_levels_merge_like_a_counter(spark, rng):
    family = sf.Family(1, 20)
    sizes = []
    for k in range(4):
        rows = []
        for x in range(6):
            text = f"{k} {x} {prose(rng, 6)}".encode()
            rows += [(key, c, w, 1, text[at[0] : at[0] + w + 19]) for key, c, w, _, at in next(iter(sf.chunks_of([text], 20)))]
        family.add(spark.createDataFrame(rows, "key long, c binary, w int, n long, text binary"))
        sizes.append([level is not None for level in family.levels])
    assert sizes == [[True], [False, True], [True, True], [False, False, True]]


def test_disk_is_given_back_while_it_runs(spark, rng):
    """Nothing that is shuffled, and no table of all chunks, outlives its step; the session's setting is as it was."""
    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for d in local for f in Path(d).glob("*/shuffle_*")}
    stored = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("skeinrisk-*"))
    old, before, setting = shuffled(), stored(), spark.conf.get(BRIEF_SHUFFLES, None)
    result = sf.suffix_digest(documents(spark, [r + ("en", "s", None) for r in rows_of(rng, 60)]))
    for _ in range(50):  # Spark deletes in the background
        if shuffled() <= old:
            break
        time.sleep(0.2)
    assert shuffled() <= old
    assert {p.name.rsplit("-", 1)[1] for p in stored() - before} <= {"texts", "meeting", "occurring", "marks", "repeated", "gone"}
    assert spark.conf.get(BRIEF_SHUFFLES, None) == setting and result.count() == 60


def test_only_chunks_of_keys_that_meet_go_on(spark, rng):
    both = prose(rng, 90)
    texts = [(b"1", f"one {both}".encode(), 1), (b"2", f"{both} two".encode(), 1), (b"3", prose(rng, 90).encode(), 1), (b"4", prose(rng, 90).encode(), 2)]
    df = spark.createDataFrame(texts, "t binary, text binary, n long")
    every, met = (Counter(bytes(r["t"]) for r in x.select("t").collect()) for x in (sf.chunk_table(df, 400), sf.meeting(df, 400)))
    assert set(every) == {b"1", b"2", b"3", b"4"} and set(met) == {b"1", b"2", b"4"} and met[b"4"] == every[b"4"]
