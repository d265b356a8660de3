from __future__ import annotations


import numpy as np
import pytest
import xxhash

from skeinrisk.llm import components, shingle_sets, simhash, substring_dedup

from .conftest import ODD, documents, prose


def brute_components(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components_match_union_find(spark, rng):
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + k, 301 + k) for k in range(60)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components({x for ab in links for x in ab}, links)
    assert found == {n: c for n, c in want.items() if n != c}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_are_sparks_xxhash64(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64
    assert simhash.shingle_hashes([b"a", b"b", b"c"], 3).tolist() == [got]


def test_simhash_digest_matches_brute_force(spark, rng):
    rows = []
    for g in range(40):
        base = prose(rng, rng.choice([2, 5, 30, 200]))
        for _ in range(rng.randint(1, 5)):
            w = base.split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = "edited"
            rows.append((len(rows), " ".join(w)))
    docs = documents(spark, rows + ODD)
    got = {(r["doc_id"]): (r["fingerprint"], r["component_id"]) for r in simhash.simhash_digest(docs).collect()}
    assert simhash.simhash_digest(docs).count() == docs.count()
    ids = [r[0] for r in rows] + [r[0] for r in ODD if r[0] is not None]
    texts = dict([(r[0], r[1]) for r in rows + [o for o in ODD if o[0] is not None]])
    prints = {i: plain_fingerprint(texts[i]) for i in set(ids)}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = brute_components(set(ids), links)
    for i in set(ids):
        assert got[i] == (f"{prints[i]:016x}", want[i])
    assert prints[9001] == prints[9002] == prints[9003] == 0
    assert got[None][1] is None


@pytest.mark.parametrize("n", [10, 200, 3000])
def test_bucket_links_lose_none_and_stay_few(n):
    """Random and crowded fingerprints of one key: the links join what pairs at three bits or less join."""
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**48, max(2, n // 50), dtype=np.uint64)
    f = centres[rng.integers(0, len(centres), n)].copy()
    for _ in range(3):
        f ^= np.uint64(1) << rng.integers(0, 48, n).astype(np.uint64)
    f = np.unique(f)
    ring = f << np.uint64(16)  # the key's segment, lowest, is equal
    ids = np.arange(len(f))
    forest = simhash.bucket_links(np.zeros(len(f), np.int32), ring, ids, 3)
    assert len(forest.a) <= len(f) - 1
    rows = []
    budgets = [0, 1, 2, 3]
    for i in range(len(f)):
        hit = simhash.near(ring[i + 1 :] ^ ring[i], budgets)
        rows += [(i, i + 1 + int(j)) for j in np.flatnonzero(hit)]
    assert brute_components(range(len(f)), zip(forest.a, forest.b)) == brute_components(range(len(f)), rows)


def test_pigeonring_keeps_every_near_pair(rng):
    """Any two fingerprints within three bits pass the chains from one of the four segments."""
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, 3)):
            b ^= 1 << rng.randrange(64)
        x = a ^ b
        turned = [np.array([((x >> 16 * s) | (x << (64 - 16 * s))) % 2**64], np.uint64) for s in range(4)]
        assert any(simhash.near(t, [0, 1, 2, 3])[0] for t in turned)


def test_long_texts_are_counted_in_parts(rng, monkeypatch):
    text = prose(rng, 900)
    monkeypatch.setattr(simhash, "PART", 64)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_crowded_fingerprints_link_as_by_brute_force(spark, rng):
    """Many fingerprints around few centres, in all segments: keys of a segment and a byte lose no link."""
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = set()
    while len(prints) < 600:
        f = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        prints.add(f)
    rows = [(k, f - 2**64 if f >= 2**63 else f) for k, f in enumerate(sorted(prints))]
    found = {r["node"]: r["component"] for r in components.components(simhash.link_nodes(spark.createDataFrame(rows, "id long, f long"))).collect()}
    links = [(i, j) for i, a in rows for j, b in rows if i < j and ((a ^ b) % 2**64).bit_count() <= 3]
    want = brute_components(range(len(rows)), links)
    assert len(links) > 200 and found == {n: c for n, c in want.items() if n != c}


def jaccard(a, b, k=5):
    s = [set(zip(*(t.lower().split()[i:] for i in range(k)))) for t in (a, b)]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_near_copies_go_and_others_stay(spark, rng):
    rows, groups = [], []
    for g in range(30):
        base = prose(rng, rng.randint(120, 400))
        own = [(len(rows), base)]
        rows.append(own[0])
        for _ in range(rng.randint(1, 4)):
            w = base.split()
            for _ in range(rng.randint(0, max(1, len(w) // 80))):
                w[rng.randrange(len(w))] = rng.choice(["extra", "words", "here"])
            rows.append((len(rows), " ".join(w)))
            own.append(rows[-1])
        groups.append(own)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(documents(spark, rows + ODD)).collect()}
    missed = sum(1 for own in groups for i, t in own[1:] if jaccard(own[0][1], t) >= 0.8 and i in kept)
    near = sum(1 for own in groups for i, t in own[1:] if jaccard(own[0][1], t) >= 0.8)
    assert near > 30 and missed <= 0.05 * near
    assert all(own[0][0] in kept for own in groups)
    assert None in kept and 9004 in kept and 9005 not in kept


def test_simhash_takes_empty_tables_and_other_columns(spark):
    docs = documents(spark, [(1, "a b c d"), (2, "a b c d")]).withColumnRenamed("n_chars", "component").withColumnRenamed("lang", "key")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [1]
    assert simhash.simhash_digest(docs.limit(0)).count() == 0


def brute_spans(docs, least=3, words=20):
    runs = {i: substring_dedup.runs(t.encode() if t is not None else None, least, words) for i, t in docs}
    first = {}
    for i in sorted(runs):
        for h, s, e in zip(*runs[i][:3]):
            first.setdefault(h, (i, s))
    out = {}
    for i, (h, s, e, n) in runs.items():
        gone = set()
        for x, a, b in zip(h, s, e):
            if first[x] != (i, a):
                gone |= set(range(a, b))
        if gone:
            out[i] = gone
    return out


def test_repeated_spans_match_brute_force(spark, rng):
    passage = prose(rng, 60)
    rows = []
    for k in range(40):
        t = prose(rng, rng.randint(20, 150))
        if k % 4 == 0:
            w = t.split()
            cut = rng.randrange(len(w))
            t = " ".join([*w[:cut], passage, *w[cut:]])
        if k % 10 == 3:
            t = rows[-1][1]
        rows.append((k, t))
    got = {}
    for r in substring_dedup.repeated_spans(documents(spark, rows + ODD)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["first_sentence"], r["end_sentence"]))
    assert got == brute_spans(rows)
    assert {k for k in range(4, 40, 4)} <= set(got)
    assert 0 not in got


def test_cut_texts_keep_the_first_occurrence(spark, rng):
    passage = prose(rng, 80)
    rows = [(1, prose(rng, 30) + "\n" + passage), (2, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)), (3, prose(rng, 50))]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated(documents(spark, rows + ODD)).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1]
    assert passage[20:-20] not in out[2] and out[2].startswith(rows[1][1][:60])
    assert out[9001] is None and out[9002] == "" and out[9004] == "same text"


def test_sentences_cover_the_text_and_cut_by_words(rng):
    t = prose(rng, 300).replace(".", "").encode()
    found = substring_dedup.sentences(t)
    assert found[0][0] == 0 and found[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    shifted = substring_dedup.sentences(b"one two three " + t)
    assert {b" ".join(s[2]) for s in found[3:-1]} <= {b" ".join(s[2]) for s in shifted}


def test_rows_of_one_id_lose_only_their_own_spans(spark, rng):
    shared, own = prose(rng, 90), prose(rng, 90)
    docs = documents(spark, [(0, shared), (1, own), (1, shared), (1, own)]).withColumnRenamed("lang", "_spans").withColumnRenamed("source", "_span_id")
    out = substring_dedup.drop_repeated(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(0, shared), (1, own), (1, ""), (1, own)])


def test_spans_name_the_first_document(spark, rng):
    """Documents 5 and 7 are copies whose first half stands in 1 already; 9 holds the second half, which is first in 5."""
    p, q = (prose(rng, 90).replace(" ", "  ") for _ in range(2))
    rows = [(1, p), (5, p + "\n" + q), (7, p + "\n" + q), (9, prose(rng, 30) + "\n" + q)]
    got = {(r["doc_id"], r["first_doc_id"]) for r in substring_dedup.repeated_spans(documents(spark, rows + ODD)).collect()}
    assert got == {(5, 1), (7, 1), (9, 5)}


def test_a_very_long_text_is_cut_to_its_end(spark, rng):
    long = prose(rng, 30_000)
    rows = [(1, long), (2, prose(rng, 40) + "\n" + long)]
    (span,) = substring_dedup.repeated_spans(documents(spark, rows)).collect()
    assert span["doc_id"] == 2 and span["end_sentence"] == span["n_sentences"] and span["first_sentence"] < 40


def test_spans_of_an_empty_table(spark):
    assert substring_dedup.repeated_spans(documents(spark, []).limit(0)).count() == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n)]


def edited(rng, n):
    """Bases of n distinct words, and copies with words appended, cut and replaced, from near to just beyond 0.8."""
    rows = []
    for _ in range(6):
        w = words(rng, n)
        rows.append(w)
        for part in (0.04, 0.1, 0.18, 0.22, 0.3):
            k = max(1, int(part * n))
            rows += [w + words(rng, k), w[: n - k], words(rng, k // 2) + w + words(rng, k // 2)]
            changed = list(w)
            for at in rng.sample(range(n), max(1, k // 9)):
                changed[at] = words(rng, 1)[0]
            rows.append(changed)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def brute_kept(rows):
    links = [(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.8]
    top = brute_components([i for i, _ in rows], links)
    return {i for i in top if top[i] == i}


@pytest.mark.parametrize("n", [50, 100, 400])
def test_appended_cut_and_replaced_copies_go_as_by_brute_force(spark, rng, n):
    """All pairs at 0.8 or more, at every length, on texts whose words are all different."""
    rows = edited(rng, n)
    want = brute_kept(rows)
    assert 6 <= len(want) < len(rows) / 2
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()} == want


@pytest.mark.parametrize(("shortest", "longest"), [(10, 20), (14, 20), (8, 24), (60, 60)])
def test_passages_from_mid_sentence_to_mid_sentence_have_a_run(rng, shortest, longest):
    """51 words that begin and end inside sentences, between unfinished sentences of other texts, always share a run."""

    def text(n):
        w = words(rng, n)
        at = rng.randint(shortest, longest)
        while at < n:
            w[at - 1] += "."
            at += rng.randint(shortest, longest)
        return w

    for _ in range(200):
        passage = text(51)
        passage[-1] = passage[-1].rstrip(".")
        a, b = (" ".join(["Begun.", *words(rng, rng.randint(1, 15)), *passage, *words(rng, rng.randint(1, 15))]) for _ in range(2))
        assert set(substring_dedup.runs(a.encode(), 3, 20)[0]) & set(substring_dedup.runs(b.encode(), 3, 20)[0])


def test_documents_below_the_similarity_stay(spark, rng):
    """Pairs from 0.70 to just below 0.8, of which fingerprints take many for copies, stay; those just above go."""
    rows, want = [], set()
    for near in [False] * 40 + [True] * 20:
        w = words(rng, 204)  # 200 shingles; k more words at the end: similarity 200 / (200 + k)
        k = rng.randint(48, 50) if near else rng.randint(51, 85)
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w + words(rng, k)))]
        want |= {rows[-2][0]} if near else {rows[-2][0], rows[-1][0]}
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()} == want


def test_near_copies_are_met_by_fingerprints_and_completed_by_the_join(spark, rng, monkeypatch):
    """What near fingerprints link is decided first and not met again; the join adds only what three differing bits can't tell."""
    rows, near = [], 0
    for k in range(40):
        w = words(rng, 300)
        pair = " ".join(w), " ".join(w + words(rng, 1 + 12 * (k % 2)))
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        near += (simhash.fingerprint(pair[0].encode()) ^ simhash.fingerprint(pair[1].encode())).bit_count() <= simhash.BITS
    decided, found = shingle_sets._decided, []

    def told(pairs, whole):
        out = decided(pairs, whole)
        found.append(out.count())
        return out

    monkeypatch.setattr(shingle_sets, "_decided", told)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()} == set(range(0, 80, 2))
    assert 0 < near < 40 and found == [near, 40 - near, 0]
