from __future__ import annotations

import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard

from skeinrisk.llm import decontaminate, licenses, quality

from .conftest import ODD, documents, prose


def edit(rng, text, n):
    t = list(text)
    for _ in range(n):
        k, o = rng.randrange(len(t)), rng.random()
        if o < 0.4:
            t[k] = "q"
        elif o < 0.7:
            del t[k]
        else:
            t.insert(k, "z")
    return "".join(t)


def plain_distance(passage, text):
    """Least edits between the passage and any piece of the text."""
    row = np.zeros(len(text) + 1, int)
    for c in passage:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j in range(1, len(text) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != text[j - 1]))
        row = new
    return int(row.min())


def test_leaks_match_an_alignment_with_every_passage(spark, rng):
    items = [(k, prose(rng, rng.randint(15, 30))) for k in range(6)] + [(90, None), (91, ""), (92, "tiny one")]
    rows = [(k, prose(rng, 40)) for k in range(12)]
    rows += [(100 + k, prose(rng, 10) + " " + edit(rng, t, n) + " " + prose(rng, 10)) for k, t in items[:6] for n in [(0, 3, 6, 30)[k % 4]]]
    rows.append((200, "a tiny one here, TINY   One!"))
    docs = documents(spark, rows + ODD)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    passages = decontaminate.Passages.of([(i, decontaminate.normal(t)) for i, t in items if t], decontaminate.Q, decontaminate.RATE)
    for i, t in rows:
        for n, (k, own) in enumerate((k, own) for k, own in items if own):
            d = plain_distance(decontaminate.normal(own), decontaminate.normal(t))
            assert got.get((i, k)) == (d if d <= passages.edits[n] else None)
    assert (200, 92) in got and not any(i in (9001, 9002) for i, _ in got)


def test_decontaminate_keeps_columns_and_clean_rows(spark, rng):
    items = spark.createDataFrame([(1, prose(rng, 25))], "item_id long, text string")
    leak = items.first()["text"]
    docs = documents(spark, [(1, prose(rng, 50)), (2, prose(rng, 5) + " " + leak.upper())] + ODD).withColumnRenamed("lang", "edits")
    out = decontaminate.decontaminate(docs, items)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == sorted((r["doc_id"] or 0) for r in docs.collect() if r["doc_id"] != 2)
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.leaks(docs.limit(0), items).count() == 0


def test_a_very_long_text_is_searched_part_by_part(rng, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 1000)
    t = prose(rng, 20)
    p = decontaminate.Passages.of([(1, decontaminate.normal(t))], 10, 0.08)
    long = " ".join([prose(rng, 400), t, prose(rng, 400)])
    assert p.matches(long)[0][0] == 0 and not p.matches(prose(rng, 900))


def test_passages_in_blocks_find_the_same(spark, rng):
    items = spark.createDataFrame([(k, prose(rng, 25)) for k in range(5)] + [(None, prose(rng, 25))], "item_id long, text string")
    assert len(list(decontaminate.passage_blocks(items, "item_id", "text", 10, 0.08, block_chars=200))) > 3
    own = [r["text"] for r in items.collect()]
    rows = [(k, prose(rng, 20) + " " + edit(rng, own[k % 6], k % 4) + " " + own[(k + 1) % 6 if k % 3 == 0 else k % 6]) for k in range(12)] + [(50, prose(rng, 60))]
    docs = documents(spark, rows + ODD)
    rows_of = lambda **how: sorted(map(str, decontaminate.leaks(docs, items, **how).collect()))
    assert len(rows_of()) >= 12 and rows_of() == rows_of(block_chars=200)
    kept = [sorted(str(r["doc_id"]) for r in decontaminate.decontaminate(docs, items, **how).collect()) for how in ({}, {"block_chars": 200})]
    assert kept[0] == kept[1] and "50" in kept[0] and "0" not in kept[0]


def test_hits_are_counted_in_parts(rng, monkeypatch):
    p = decontaminate.Passages.of([(1, "ab " * 40), (2, decontaminate.normal(prose(rng, 40)))], 10, 0.08)
    text = decontaminate.codes("ab " * 100 + decontaminate.normal(prose(rng, 100)))
    whole = sorted(p.bands(text))
    monkeypatch.setattr(decontaminate, "HITS", 64)
    assert whole and sorted(p.bands(text)) == whole


def test_a_passage_much_longer_than_the_text(rng):
    p = decontaminate.Passages.of([(1, decontaminate.normal(prose(rng, 300))), (2, decontaminate.normal("a few words that stand alone"))], 10, 0.08)
    assert set(p.matches("A few words, that stand alone!")) == {1}


def test_licenses_match_their_sql(spark):
    rows = [
        (1, "x\nReleased under the MIT License.\ny"), (2, "under the mit license under the MIT-license"), (3, "Licensed under CC BY-NC 4.0."), (4, "cc by nc cc by nc"),
        (5, "This work is licensed under the GNU General Public License, version 3."), (6, "Apache License, Version 2.0 and under the\nmit license"), (7, "released under some license"),
        (8, "worK under the mİt license"), (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files"), (10, "the " * 500),
    ]
    docs = documents(spark, rows + ODD)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(licenses.oracle()).fetchall()
    names = [c[0] for c in con.description]
    got = [tuple(r[c] for c in names) for r in licenses.license_digest(docs).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    clean = lambda r: tuple(None if x is None or x != x else x for x in r)
    assert sorted(map(clean, got), key=key) == sorted(map(clean, want), key=key)
    by_id = {r[names.index("doc_id")]: dict(zip(names, r)) for r in got}
    assert by_id[2]["n_base"] == 2 and (by_id[2]["first_word"], by_id[2]["last_word"]) == (0, 4)
    assert by_id[6]["base_labels"] == "apache-2,mit" and by_id[5]["labels"] == "gpl-3" and by_id[7]["labels"] == ""
    assert by_id[9]["labels"] == "mit" and by_id[9]["base_labels"] == "" and 0.9 <= by_id[9]["score"] < 1
    assert by_id[9001]["n_words"] == 0 and by_id[9001]["labels"] == "" and by_id[9001]["first_word"] is None


def plain_parts(text):
    """label -> the largest part of a template that a window of it holds, if the threshold is met; every window is looked at."""
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for template, label in licenses.TEMPLATES:
        own = licenses.notice(template)
        size = len(own) + len(own) // 4
        most = max((len(set(own) & set(words[at : at + size])) for at in range(len(words))), default=0)
        if most >= licenses.least_words(len(set(own)), 0.9):
            out[label] = max(out.get(label, 0), most / len(set(own)))
    return out


def test_notices_are_found_in_windows_across_lines(spark, rng):
    """Whole notices, wrapped, with words lost and put in, cut into others and scattered over much text, against every window."""
    rows = []
    for template, _ in licenses.TEMPLATES:
        w = template.split()
        wrapped = "\n".join(" ".join(w[k : k + 6]) for k in range(0, len(w), 6))
        lost = [x for x in w if rng.random() > 0.08]
        filled = [y for x in w for y in ([x, rng.choice(["ba", "ce", "di"])] if rng.random() < 0.15 else [x])]
        far = " ".join(x + " " + prose(rng, 30) for x in w)
        rows += [prose(rng, 400) + "\n" + wrapped + "\n" + prose(rng, 400), prose(rng, 30) + " " + " ".join(lost), " ".join(filled) + prose(rng, 10), far]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: (r["labels"], r["score"], r["base_labels"]) for r in licenses.license_digest(documents(spark, rows + ODD)).collect()}
    for i, t in rows:
        want = plain_parts(t)
        labels = set(want) | set(got[i][2].split(",")) - {""}
        assert got[i][0] == ",".join(sorted(labels)), i
        assert got[i][1] == pytest.approx(1.0 if got[i][2] else max(want.values(), default=0.0))
    assert all(got[4 * k][0] for k in range(len(licenses.TEMPLATES))) and not any(got[4 * k + 3][0] for k in range(len(licenses.TEMPLATES)))


def test_license_scan_with_clashing_columns(spark):
    docs = documents(spark, [(1, "under the mit license")]).withColumnRenamed("lang", "score").withColumnRenamed("source", "labels")
    row = licenses.scan(docs).first()
    assert row["labels"] == "mit" and row["score"] == 1.0 and licenses.scan(docs.limit(0)).count() == 0


@pytest.fixture()
def labelled(spark, rng):
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.8
        t = prose(rng, rng.randint(20, 200))
        rows.append((k, t if good else " ".join(w.upper() + "!!" for w in t.split())))
        labels.append((k, int(good), 0))
    return documents(spark, rows + ODD), spark.createDataFrame([*labels, (5000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"), dict((a, b) for a, b, _ in labels)


def test_quality_on_held_out_labels(spark, labelled):
    docs, labels, truth = labelled
    out = quality.quality_digest(docs, labels)
    rows = out.collect()
    assert out.count() == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95


def plain_model(docs, labels):
    """The dictionaries from the rows that the docstrings say: those of each class with the smallest hashes of their ids, of these
    every other one, and of each up to eight pieces of 1,024 bytes, evenly spread."""
    known = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    place = lambda i: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(str(i).encode(), 42))
    out = []
    for y in (1, 0):
        samples = []
        for i in sorted((i for i in known if known[i] == y and docs.get(i)), key=place)[::2]:
            data = docs[i].encode()
            own = [data[k : k + 1024] for k in range(0, len(data), 1024)]
            samples += own if len(own) <= 8 else [own[len(own) * k // 8] for k in range(8)]
        out.append(zstandard.train_dictionary(1 << 16, samples))
    return out


def test_quality_scores_match_a_plain_version(spark, labelled):
    """The model's dictionaries and every row's score, recomputed one text at a time."""
    docs, labels, truth = labelled
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 9000").collect()}
    model = quality.trained(docs, labels)
    dictionaries = plain_model(texts, [(i, y) for i, y in truth.items() if i != 3] + [(3, truth[3])])
    assert [d.as_bytes() for d in dictionaries] == [model.good, model.bad]
    assert list(model.at) == sorted(model.at) and list(model.share) == sorted(model.share, reverse=True)
    for r in quality.quality_digest(docs, labels).where("doc_id < 200 OR doc_id > 9000").join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        data, total = (r["text"] or "").encode(), 0
        for k in range(0, len(data), 1024):
            good, bad = (len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d.as_bytes()), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[k : k + 1024])) for d in dictionaries)
            total += good - bad
        assert r["score"] == pytest.approx(np.interp(total / len(data) if data else 0.0, model.at, model.share), abs=1e-12)


def test_repeated_labelled_ids_train_on_one_text(spark, labelled):
    docs, labels, _ = labelled
    one = quality.trained(docs, labels)
    again = quality.trained(docs.unionByName(docs.where("doc_id < 40")).repartition(3), labels)
    assert (one.good, one.bad, one.at) == (again.good, again.bad, again.at)


def test_quality_filter_keeps_columns(spark, labelled):
    docs, labels, truth = labelled
    out = quality.keep_good(docs.withColumnRenamed("lang", "y"), labels)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == ["doc_id", "text", "y", "source", "n_chars"]
    assert sum(k in kept for k, v in truth.items() if v) > 0.97 * sum(truth.values())


def test_quality_without_labels_of_both_kinds(spark, labelled):
    docs, labels, _ = labelled
    assert {r["score"] for r in quality.quality_digest(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["predicted"] for r in quality.quality_digest(docs, labels.where("quality = 1")).collect()} == {1}
    assert quality.quality_digest(docs.limit(0), labels).count() == 0


def test_isotonic_curve_falls():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(3 * x))).astype(float)
    at, share = quality.fit_curve(x, y, np.ones(500))
    assert at == sorted(at) and share == sorted(share, reverse=True) and share[0] > 0.9 > 0.1 > share[-1]


def test_passages_without_an_id_are_looked_for(spark, rng):
    big = 2**53 + 1
    known, nameless = prose(rng, 25), prose(rng, 25)
    items = spark.createDataFrame([(big, known), (None, nameless)], "item_id long, text string")
    docs = documents(spark, [(1, nameless), (2, prose(rng, 60)), (3, known + " " + nameless)])
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()} == {2}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == {(1, None), (3, None), (3, big)}
