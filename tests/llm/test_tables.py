from __future__ import annotations

import gzip
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skeinrisk.llm import mixing, sharding, topk, url_filter, warc

from .conftest import ODD, documents, prose


def plain_hash(*values):
    """Spark's xxhash64 of longs, ints and strings, in Python: each value's hash is the next one's seed."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else v.to_bytes({"l": 8, "i": 4}[kind], "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


def plain_walk(x, n, seed):
    """The permutation, step by step: Feistel rounds over two digits, again while the value is n or more."""
    a, b = sharding.radices(n)
    while True:
        high, low = divmod(x, b)
        for key in sharding.ROUND_KEYS:
            high = (high + plain_hash(("l", low), ("l", key), ("i", seed)) % a) % a
            low = (low + plain_hash(("l", high), ("l", key), ("i", ~seed)) % b) % b
        x = high * b + low
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 7, 100, 1000])
def test_walk_matches_a_plain_feistel_network(spark, n):
    got = {r[0]: r[1] for r in spark.range(n).select("id", sharding.walk(F.col("id"), n, 20240229, 64)).collect()}
    assert got == {k: plain_walk(k, n, 20240229) for k in range(n)}


def test_digest_matches_brute_force(spark, rng):
    rows = [(k, prose(rng, rng.randint(0, 9))) for k in range(230)]
    got = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_digest(documents(spark, rows).repartition(5)).collect()}
    assert got == {(k, plain_walk(k, 230, 20240229) % 40, plain_walk(k, 230, 20240229) // 40) for k in range(230)}


def test_documents_alike_but_for_the_text_keep_their_shards(spark):
    """Whatever the input's partitions; a map column and a clashing one pass through."""
    rows = [(7, f"text {k}", {"a": k % 2}, k % 3) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, _row int")
    out = [sorted((r["text"], r["_row"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs.repartition(n).orderBy(F.rand(n)), 4).collect()) for n in (1, 3, 6)]
    assert out[0] == out[1] == out[2] and len(out[0]) == 50
    assert sharding.shard_documents(docs.limit(0), 4).columns == [*docs.columns, "shard", "slot"]


def test_feistel_permutes(spark):
    for n in (1, 2, 7, 100, 1000):
        a, b = sharding.radices(n)
        assert a * b >= n and (a - 1) * (b - 1) < n
        out = [r[0] for r in spark.range(a * b).select(sharding.feistel(F.col("id"), n, 1)).collect()]
        assert sorted(out) == list(range(a * b))
    out = [r[0] for r in spark.range(1000).select(sharding.walk(F.col("id"), 1000, 1, 64)).collect()]
    assert sorted(out) == list(range(1000)) and out != sorted(out)


def test_shards_are_even_gapless_and_reproducible(spark, rng):
    docs = documents(spark, [(k, prose(rng, 5)) for k in range(333)] + ODD * 3)
    out = sharding.shard_digest(docs, 40)
    rows = out.collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    again = sharding.shard_digest(docs.repartition(7).orderBy(F.rand(3)), 40).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["shard"], r["slot"])
    assert sorted(rows, key=key) == sorted(again, key=key)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[9001]["size"] == 16 and by_id[9001]["text_crc32"] is None
    assert by_id[9006]["size"] == len(ODD[7][1].encode()) + 16 and by_id[9006]["text_crc32"] == zlib.crc32(ODD[7][1].encode())


def test_shards_with_other_columns_and_without_rows(spark):
    docs = documents(spark, [(k, "t") for k in range(5)]).withColumnRenamed("lang", "shard").withColumnRenamed("source", "slot")
    out = sharding.shard_rows(docs, ["doc_id"], 3)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == 5
    assert sharding.shard_rows(docs.limit(0), ["doc_id"], 3).count() == 0


def test_one_key_for_all_rows(spark):
    docs = documents(spark, [(1, "t")] * 500)
    rows = sharding.shard_rows(docs, ["doc_id"], 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(4) for k in range(125)]


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_reaches_its_targets(spark, rng):
    rows = [(k, prose(rng, rng.randint(1, 60)), "en", rng.choice(["b", "a", None, "Z", "é", "hot", "hot", "hot"]), 1) for k in range(1500)]
    docs = documents(spark, rows + ODD)
    out = mixing.mix_digest(docs).collect()
    size = lambda t: len((t or "").encode().split())
    all_rows = rows + ODD
    sizes = {}
    for r in all_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = plain_targets(sizes)
    source = {r[0]: r[3] for r in all_rows}
    assert len(out) == len(all_rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], abs_tol=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = mixing.mix_digest(docs.repartition(9)).collect()
    assert sorted((r["doc_id"] or 0, r["taken"]) for r in out) == sorted((r["doc_id"] or 0, r["taken"]) for r in again)


def test_mix_takes_the_rows_below_each_threshold(spark, rng):
    """Rows in order of their places: taken once more up to where the sum comes nearest to what the target leaves."""
    rows = [(k, prose(rng, rng.randint(1, 60)), "en", rng.choice("abc"), 1) for k in range(400)] + [(900, "lone words", "en", "d", 1)]
    got = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_digest(documents(spark, rows)).collect()}
    sizes, own = {}, {}
    for i, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
        own.setdefault(s, []).append(((plain_hash(("l", i), ("s", t)) % 2**64) >> 1, len(t.split()), i))
    for s, target in plain_targets(sizes).items():
        whole = int(target // sizes[s])
        left, total = target - whole * sizes[s], 0
        for _, n, i in sorted(own[s]):
            more = left > 0 and total + n - left < left - total if total + n > left else True
            assert got[i] == whole + more, (s, i)
            total = total + n if total <= left else math.inf


@pytest.mark.parametrize("n", [40, 400])
def test_a_source_of_one_repeated_row_meets_its_target(spark, n):
    rows = [(1, "ten words " * 5, "en", "a", 1)] * n + [(k, "ten words " * 5, "en", "b", 1) for k in range(100, 100 + n)]
    docs = documents(spark, rows)
    out = mixing.mix_digest(docs).groupBy((F.col("doc_id") == 1).alias("a")).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(out) == 2 and all(abs(r["taken"] - r["target"]) <= 10 for r in out)
    assert mixing.mix(docs).count() == sum(r["taken"] for r in out) // 10


def test_one_id_and_text_in_several_sources(spark, rng):
    """Whatever the order and partitions of the rows, the same of them are taken, and each source meets its target."""
    rows = [(1, "ten words " * 5, "en", rng.choice("abc"), k % 3) for k in range(300)] + [(2, "ten words " * 5, None, None, None)] * 40
    size, seen = 10, []
    for k in range(3):
        own = rows[:]
        rng.shuffle(own)
        docs = documents(spark, own).repartition(2 + 3 * k)
        digest = mixing.mix_digest(docs).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert all(abs(r["taken"] - r["target"]) <= 2 * size for r in digest)
        out = sorted(map(str, mixing.mix(docs).collect()))
        assert len(out) == sum(r["taken"] for r in digest) // size
        seen.append((out, sorted((r["source_size"], r["taken"]) for r in digest)))
    assert seen[0] == seen[1] == seen[2]


def test_mix_repeats_rows(spark, rng):
    docs = documents(spark, [(k, prose(rng, 20), "en", "ab"[k % 2], 1) for k in range(200)]).withColumnRenamed("lang", "target")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_digest(docs).collect()}
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n == {k: v for k, v in taken.items() if v}


def test_mix_of_nothing(spark):
    assert mixing.mix_digest(documents(spark, []).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix_digest(documents(spark, [(1, ""), (2, None)])).collect()} == {0}


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


def plain_rule(host, path):
    fits = [r for r in url_filter.RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p))(r[: r.index("/")], r[r.index("/") :])]
    return max(fits, key=len, default=None)


def test_urls_match_plain_rules(spark, rng):
    hosts = ["example.org", "a.Example.ORG", "org", "xorg", "notexample.org", "x.com", "com", "y.example.net", "K.org", "a.org:80"]
    paths = ["", "/", "/es/1", "/en/1", "/en/12/a.html", "/en/2", "/fr/9?x=1&y=2", "/de/3#f", "/de", "?q=/es/", "#/es/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c/d", "http://\nx.org/es/", "http://x.org/" + "a1" * 3000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(rows) == len(urls)
    for k, u in enumerate(urls):
        host, path = plain_url(u)
        r = plain_rule(host, path)
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == (host, path, r), u
        assert rows[k]["verdict"] in ("allow", "block") and 0 <= rows[k]["score"] <= 1
        if r:
            assert rows[k]["verdict"] == url_filter.RULES[r]


def test_url_trees_learn(spark, rng):
    """Labels that depend on digits in the host, which no rule sees: the trees tell them on hosts that no rule covers."""
    rows = []
    for k in range(600):
        bad = rng.random() < 0.5
        name = "".join(rng.choice("0123456789" if bad else "abcdefgh") for _ in range(12))
        rows.append((k, f"http://{name}.{'one' if k % 3 else 'two'}/{'x/' if bad else 'y/'}page"))
    rules = {"one/x/": "block", "one/y/": "allow"}
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).where("rule IS NULL").collect()
    assert len(out) == 200
    assert sum((r["verdict"] == "block") == r["host"][0].isdigit() for r in out) / len(out) > 0.95


def test_urls_held_out_are_not_learnt_from(spark, rng):
    """Labels on half of the rows; those of the other half, which contradict them, change no score."""
    name = lambda bad: "".join(rng.choice("0123456789" if bad else "abcdefgh") for _ in range(12))
    rows = [(k, f"http://{name(k % 4 < 2)}.one/{'x/' if (k % 4 < 2) == (k % 2 == 0) else 'y/'}p") for k in range(400)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = {"one/x/": "block", "one/y/": "allow"}
    learnt = url_filter.judge(pages, rules=rules, train_on=F.col("page_id") % 2 == 0)
    alone = url_filter.judge(pages.where("page_id % 2 = 0"), rules=rules)
    score = lambda df: sorted((r["page_id"], round(r["score"], 9)) for r in df.where("page_id % 2 = 0").collect())
    assert score(learnt) == score(alone) and learnt.count() == 800
    assert all((s > 0.5) == (i % 4 < 2) for i, s in score(learnt))


def test_the_same_urls_get_the_same_scores_in_any_order(spark, rng):
    name = lambda: "".join(rng.choice("0123456789abcdefgh") for _ in range(rng.randint(3, 14)))
    rows = [(k, f"http://{name()}.one/{rng.choice('xyz')}/{name()}?{name()}={k % 7}") for k in range(300)]
    seen = []
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        pages = spark.createDataFrame(rows, "page_id long, url string").repartition(parts)
        seen.append(sorted((r["page_id"], r["score"]) for r in url_filter.judge(pages, rules={"one/x/": "block", "one/y/": "allow"}).collect()))
    assert seen[0] == seen[1] == seen[2] and len({s for _, s in seen[0]}) > 5


def plain_boosting(bins, y, weight):
    """Boosted trees grown row by row: at each node the split of the most gain over all features and edges; log odds of each row."""
    score = np.full(len(y), np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1)))
    worth = lambda g, h: g * g / (h + url_filter.RIDGE)
    for _ in range(url_filter.TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y) * weight, p * (1 - p) * weight
        step = np.zeros(len(y))

        def grow(rows, depth):
            best = (1e-9, None)
            for f in range(bins.shape[1]) if depth < url_filter.DEPTH else ():
                for b in np.unique(bins[rows, f])[:-1]:
                    left = rows[bins[rows, f] <= b]
                    rest = np.setdiff1d(rows, left)
                    gain = worth(g[left].sum(), h[left].sum()) + worth(g[rest].sum(), h[rest].sum()) - worth(g[rows].sum(), h[rows].sum())
                    if gain > best[0] + 1e-12:
                        best = (gain, (left, rest))
            if best[1] is None:
                step[rows] = -url_filter.RATE * g[rows].sum() / (h[rows].sum() + url_filter.RIDGE)
            else:
                for part in best[1]:
                    grow(part, depth + 1)

        grow(np.arange(len(y)), 0)
        score = score + step
    return score


def test_trees_match_plain_boosting(spark):
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 9, (300, 4))
    y = (bins[:, 0] + 2 * (bins[:, 1] > 5) * bins[:, 2] + rng.normal(size=300) * 3 > 8).astype(float)
    weight = rng.integers(1, 5, 300)
    rows = [([int(v) for v in b], float(a), int(n), k) for k, (b, a, n) in enumerate(zip(bins, y, weight))]
    binned = spark.createDataFrame(rows, "bins array<int>, y double, n long, k int")
    start, trees = url_filter.boost(binned.drop("k"), 4)
    z = sum((url_filter.tree_value(t, 1, lambda f, b: F.col("bins")[f] <= b) for t in trees), F.lit(start))
    got = [r["z"] for r in binned.select("k", z.alias("z")).orderBy("k").collect()]
    assert len(trees) == url_filter.TREES and np.allclose(got, plain_boosting(bins, y, weight), atol=1e-7)


def test_urls_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "r")], "page_id long, url string, rule string")
    assert url_filter.judge(pages).first()["verdict"] == "allow" and url_filter.judge(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, rng):
    big, small_ = prose(rng, 300), "short"
    rows = [(k, f"http://x/{k}", t) for k, t in enumerate([big, small_, big, small_, None, "", "é" * 999, "é" * 999, "a" * 999, "a" * 999, "b" * 1000, "b" * 1000, "x\r\n\r\ny" * 300])]
    rows += [(50, None, big), (50, "http://again", big), (None, "u", big), (None, "u", None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    data = {}
    for i, _, t in rows:
        data.setdefault((t or "").encode(), []).append(i)
    want = []
    for payload, ids in data.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(payload) >= 1000 and top is not None and i != top
            want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_over_many_archives_and_ranges(spark, rng, monkeypatch):
    """Archives that roll over, and more than one range of records in each; a payload beyond a chunk."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "READ_RECORDS", 4)
    rows = [(k, f"http://x/{k}", prose(rng, 200), "own") for k in range(120)] + [(500, "http://long", "z" * 3_000_000, "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(2)
    folder = warc.new_path(spark, "warc-test")
    written = warc.write_archives(warc.planned(pages, "page_id", "url", "html"), folder)
    assert written.count() >= 6
    members = warc.normalise_archives(written)
    assert members.where("size(marks) > 2").count() >= 6
    read = warc.read_archives(members)
    assert read.rdd.getNumPartitions() >= 8
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in read.collect())
    assert got == sorted((i, len(t), hashlib.sha1(t.encode()).hexdigest(), "response") for i, _, t, _ in rows)


def test_normaliser_makes_members_and_an_index(tmp_path, rng):
    recs = [warc.record("response", k, "http://x", prose(rng, 50).encode(), "d", 1, None) for k in range(40)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(recs)))
    n, size, marks = warc.normalise(str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc.gz"), 15)
    data = (tmp_path / "b.warc.gz").read_bytes()
    assert n == 40 and size == len(data) and gzip.decompress(data) == b"".join(recs)
    import json

    index = [json.loads(x) for x in (tmp_path / "b.warc.gz.idx").read_text().splitlines()]
    assert [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index] == recs
    lines = (tmp_path / "b.warc.gz.idx").read_bytes()
    assert [len(lines[a:b].splitlines()) for a, b in zip(marks, marks[1:])] == [15, 15, 10] and marks[-1] == len(lines)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(recs)[:-30]))
    with pytest.raises(ValueError, match="ends within"):
        warc.normalise(str(tmp_path / "c.warc.gz"), str(tmp_path / "d.warc.gz"))


def plain_top(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted(((-int(a[: min(len(a), len(b))] @ b[: min(len(a), len(b))]), c) for c, b in ok if c != q))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims"), [(90, 5), (400, 40)])
def test_top_k_matches_brute_force(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=dims) * (0.1 if k % 3 else 1)]) for k in range(n)]
    rows += [(1000 + k, rows[k][1]) for k in range(8)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [math.nan] * dims), (2003, [math.inf] * dims), (2004, []), (2005, [1.0]), (None, [1.0] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k_digest(df).collect())
    assert got == plain_top(rows)
    assert topk.top_k_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [1, 32 << 20])
def test_top_k_over_many_blocks_and_groups_of_queries(spark, monkeypatch, sent):
    monkeypatch.setattr(topk, "SENT_BYTES", sent)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=40) * (3 if k % 7 == 0 else 1)]) for k in range(300)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k_digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)).collect())
    assert got == plain_top(rows)


@pytest.mark.parametrize("wave", [1, 3, 1 << 40])
def test_top_k_from_the_scores_of_a_first_wave(spark, monkeypatch, wave):
    """All, some or none of the blocks go first; ties with the score that they tell are kept."""
    monkeypatch.setattr(topk, "WAVE", wave)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k_digest(df).collect())
    assert got == plain_top(rows)


def test_top_k_of_one_id_with_two_vectors_in_two_partitions(spark):
    rows = [(20, [1.0, 0.0]), (1, [2.0, 5.0]), (20, [0.0, 1.0]), (2, [3.0, 1.0]), (3, [4.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k_digest(df).collect())
    first, second = [(3, 4), (2, 3), (1, 2)], [(1, 5), (3, 2), (2, 1)]
    assert got == sorted((20, n + 1, v, s * 4096) for own in (first, second) for n, (v, s) in enumerate(own))


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 3.0]), (4, [0.0, 2.0]), (5, [2.0**40, -1.0])]
    got = [(r["vec_id"], r["score"]) for r in topk.top_k_digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (5, 2**63 - 1), (3, 3 * 4096), (4, 2 * 4096), (2, -(2**63) + 1)]
