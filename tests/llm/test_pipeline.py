from __future__ import annotations


import pytest

import corpus_pipeline
from skeinrisk.llm import common, decontaminate, quality, queries, shingle_sets, simhash

from .conftest import ODD, SCHEMA, prose
from .test_dedup import brute_components, jaccard
from .test_tables import plain_hash, plain_targets, plain_walk
from .test_text import plain_distance

#: Extra columns, some with names that operators use themselves.
EXTRA = ", shard int, _gone string, set long, component string, tags map<string,int>"


def test_stages_pass_on_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, tables), f"test-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k < 3:
            assert 0 < docs.count() <= n
            n = docs.count()
    assert set(docs.columns) == {*columns, "shard", "slot"}
    per = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(per) - min(per) <= 1


def test_queries_run(spark, tables):
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    for name, q in queries.QUERIES.items():
        assert q(spark, tables).limit(1).columns, name


@pytest.fixture()
def corpus(spark, rng, tmp_path):
    """A folder of small tables with good and bad, near and exact copies, benchmark passages and odd rows; and the rows."""
    rows, labels = [], []
    items = [(k, prose(rng, 25)) for k in range(3)] + [(None, None), (9, "")]
    for k in range(160):
        good = k % 5 != 4
        text = prose(rng, rng.randint(30, 120)) if good else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())
        if k % 20 == 3:
            text = " ".join([*rows[-1][1].split(), "one", "more"])
        if k % 20 == 6:
            text = rows[-1][1]
        if k % 40 == 10:
            text += " " + items[k // 40 % 3][1]
        rows.append((k, text, "en", rng.choice(["a", "b", None, "hot", "hot"]), len(text)))
        labels.append((k, int(good), 0))
    rows += ODD
    extra = [r + (1, "x", 2, None, {"k": 1} if n % 3 else None) for n, r in enumerate(rows)]
    spark.createDataFrame(extra, SCHEMA + EXTRA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}", rows, items


def keys(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_each_stage_matches_a_brute_force_version(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    steps = []
    for k, stage in enumerate(stages):
        docs = common.written(stage(spark, docs, folder), f"brute-{k}")
        assert docs.columns == (columns if k < 4 else [*[c for c in columns if c != "shard"], "shard", "slot"]), k
        steps.append(docs)
    source = {(r[0], r[1]): r[3] for r in rows}

    # quality: every row scored on its own
    model = quality.trained(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = model.scorer()
    good = sorted(((i, t) for i, t, *_ in rows if scorer.score(t.encode() if t else None) >= 0.3), key=str)
    assert keys(steps[0]) == good and 100 < len(good) < len(rows)

    # near copies: all pairs
    texts = sorted({(i, t) for i, t in good if i is not None}, key=lambda r: (r[0], str(r[1])))
    alike = lambda a, b: jaccard(a or "", b or "") >= 0.8 or (a or "").lower().split() == (b or "").lower().split()
    links = [(x, y) for x in range(len(texts)) for y in range(x) if alike(texts[x][1], texts[y][1])]
    top = brute_components(range(len(texts)), links)
    first = {texts[k] for k, c in top.items() if c == k}
    single = sorted(((i, t) for i, t in good if i is None or (i, t) in first), key=str)
    assert keys(steps[1]) == single and len(single) < len(good)

    # decontamination: an alignment with every passage
    known = decontaminate.Passages.of([(i, decontaminate.normal(t)) for i, t in items if t], decontaminate.Q, decontaminate.RATE)
    passages = [(decontaminate.normal(t), int(e)) for (i, t), e in zip([x for x in items if x[1]], known.edits)]
    clean = [(i, t) for i, t in single if not any(plain_distance(p, decontaminate.normal(t)) <= e for p, e in passages)]
    assert keys(steps[2]) == clean and len(clean) < len(single)

    # mixing: rows in order of their places, up to the nearest sum
    size = lambda t: len((t or "").encode().split())
    sizes, own, mixed = {}, {}, []
    seen = {}
    for i, t in clean:
        s, at = source[i, t], (plain_hash(("l", i), ("s", t)) % 2**64) >> 1
        n = seen[i, t] = seen.get((i, t), -1) + 1
        at = at if not n else (plain_hash(("l", at), ("l", n)) % 2**64) >> 1
        sizes[s] = sizes.get(s, 0) + size(t)
        own.setdefault(s, []).append((at, size(t), i, t))
    for s, target in plain_targets(sizes).items():
        whole = int(target // sizes[s]) if sizes[s] else 0
        left, total, done = target - whole * sizes[s], 0, not sizes[s]
        for _, n, i, t in sorted(own[s], key=lambda r: r[0]):
            more = not done and left > 0 and (total + n <= left or total + n - left < left - total)
            done = done or total + n > left
            total += n
            mixed += [(i, t)] * (whole + more)
    got = keys(steps[3])
    assert [x for x in got if size(x[1])] == [x for x in sorted(mixed, key=str) if size(x[1])]

    # sharding: ranks by id and text through the plain network
    n = len(got)
    rank = sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, plain_hash(("s", r[1]))))
    want = sorted((str(i), str(t), plain_walk(k, n, 20240229) % 40, plain_walk(k, n, 20240229) // 40) for k, (i, t) in enumerate(rank))
    assert sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in steps[4].collect()) == want


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_mixing", "op6_simhash", "op7_warc"])
def test_results_dont_depend_on_what_is_broadcast(spark, tables, monkeypatch, name):
    """Sides that are counted and sent, and the same ones by shuffle."""
    sent = sorted(map(str, queries.QUERIES[name](spark, tables).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, queries.QUERIES[name](spark, tables).collect())) == sent and sent


def test_near_copies_dont_depend_on_what_is_broadcast(spark, corpus, monkeypatch):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    sent = keys(simhash.drop_near_duplicates(docs))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shingle_sets, "BLOCK", 2)
    assert keys(simhash.drop_near_duplicates(docs)) == sent and len(sent) < docs.count()


def test_stages_take_empty_tables(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, folder), f"empty-{k}")
        assert docs.count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
