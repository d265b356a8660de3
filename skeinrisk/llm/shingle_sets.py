"""Near copies: candidates by fingerprints, decided and completed by an exact set-similarity join on five-word shingles.

Fingerprints come first (``simhash``): what their search links, and texts of one fingerprint, are candidates, which are decided on
whole sets; those that hold become trees. Fingerprints can't tell every similar pair, so a join then finds what links these trees.

Two texts are near copies if the Jaccard similarity of their sets of shingles is 0.8 or more. Such a set shares at least four
fifths of its shingles with the other, so a set whose own shingles (those of no other set) are more than a fifth has no near
copy, and in any one order of all shingles the first fifth and one more of both have a shingle in common (prefix filter).

Shingles are counted over the whole corpus, in two rounds. The first counts those whose hash is in the lowest ``LOW`` of the hash
space: most sets have enough shingles of their own among these and are done. All shingles of the sets left are counted then,
rarest first is the order, and the shared ones among a set's first fifth are the keys of the join.

Pairs of a key come in two rounds. First each set meets the key's central member, that with the fewest shingles of its own, where
that is in another tree; what links becomes one tree. Then only sets of different trees meet, block by block, so a large group of copies costs about one
comparison for each member. A pair goes on if its sizes fit and its parity bitmaps differ in no more places than the sets may
(a bitmap's bit is the parity of the shingles that fall on it, so bitmaps differ in no more places than the sets in members);
pairs that go on are decided by counting the shared shingles of the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, small
from .components import components

SHINGLE = 5
#: The part of the hash space that the first round counts.
LOW = 0.3
#: Bits of a parity bitmap, and members of a key that one block holds.
BITMAP, BLOCK = 2048, 1024


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of k words, space-joined; fewer words: of them all; no words: none."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    if k == 1:
        return np.array([digest(w, 42) for w in words], np.uint64)
    runs = zip(*(words[i:] for i in range(k)), strict=False)
    return np.array([digest(b" ".join(r), 42) for r in runs], np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The shingles of a text, each once, sorted."""
    return np.unique(shingle_hashes((text or b"").lower().split(), SHINGLE))


def bitmap(own: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles that fall on each of BITMAP bits, as 64-bit words."""
    odd = np.bincount((own & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_similar(n, m, differing):
    """Sizes n and m and at least ``differing`` members in one set only leave room for a similarity of 0.8."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * differing <= n + m)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("th"), text.alias("text")).where("doc_id IS NOT NULL")


def _signed(slim: DataFrame, fingerprint: Callable[[bytes | None], int]) -> DataFrame:
    """(doc_id, th: hash of the text, f: fingerprint, set: digest of its shingles, n: their number, low: those of the first round)."""
    end = np.uint64(int(LOW * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(2)]
            digests = pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
            sizes = pa.array([len(s) for s in sets], pa.int32())
            low = pa.array([s[: np.searchsorted(s, end)].view(np.int64) for s in sets], pa.list_(pa.int64()))
            prints = pa.array(np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), prints, digests, sizes, low], ["doc_id", "th", "f", "set", "n", "low"])

    return slim.mapInArrow(run, "doc_id long, th long, f long, set long, n int, low array<long>")


def _whole(slim: DataFrame) -> DataFrame:
    """(set, n, all shingles, bits: parity bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(2)]
            digests = pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
            sizes = pa.array([len(s) for s in sets], pa.int32())
            whole, bits = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([digests, sizes, whole, bits], ["set", "n", "shingles", "bits"])

    return slim.mapInArrow(run, "set long, n int, shingles array<long>, bits array<long>")


def _own(rows: DataFrame) -> DataFrame:
    """rows(h, set) -> (set, own): how many of its shingles no other set has; copies of a set are one."""
    alone = rows.groupBy("h").agg(F.min("set").alias("set"), F.max("set").alias("_last")).where("set = _last")
    return alone.groupBy("set").agg(F.count("*").alias("own"))


def _keys(whole: DataFrame) -> DataFrame:
    """(key, set, own): the shared shingles among the first fifth, and one, of each set, rarest first."""
    rows = whole.select(F.explode("shingles").alias("h"), "set", "n")
    shared = Written(rows.groupBy("h").agg(F.min("set").alias("_a"), F.max("set").alias("_b"), F.count("*").alias("c")).where("_a <> _b").select("h", "c"), "shared").df
    order = Window.partitionBy("set").orderBy("c", "h")  # the shingles of one text
    ranked = rows.join(shared, "h").withColumn("r", F.dense_rank().over(order))
    ranked = ranked.withColumn("own", F.col("n") - F.max("r").over(Window.partitionBy("set")))
    return ranked.where("own + r <= n div 5 + 1").select(F.col("h").alias("key"), "set", "own").distinct()


def _decided(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar, in whole numbers: 9 shared >= 4 (n + m)."""
    a, b = (whole.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}")) for x in ("a", "b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(9 * shared >= 4 * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def _print_pairs(nodes: DataFrame, link_nodes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes(set, f) -> (a, b): sets that the search for near fingerprints links, and each set with the head of its fingerprint."""
    heads = Written(nodes.groupBy("f").agg(F.min("set").alias("id")), "heads").df
    same = nodes.join(heads, "f").where("set <> id").select(F.col("set").alias("a"), F.col("id").alias("b"))
    return same.unionByName(link_nodes(heads.select("id", "f"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _grown(trees: DataFrame, links: DataFrame) -> DataFrame:
    """Trees (node, component) with further links."""
    if links.isEmpty():
        return trees
    return Written(components(trees.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "trees").df


def _apart(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are in different trees."""
    a, b = (trees.select(F.col("node").alias(x), F.col("component").alias(f"_t{x}")) for x in ("a", "b"))
    tree = lambda x: F.coalesce(F.col(f"_t{x}"), F.col(x))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(tree("a") != tree("b")).select("a", "b")


def _central_pairs(keys: DataFrame, briefs: DataFrame, trees: DataFrame) -> DataFrame:
    """(a, b): the members of each key with its central one, of different trees, where sizes and bitmaps allow it."""
    central = keys.groupBy("key").agg(F.min(F.struct("own", "set"))["set"].alias("b"))
    met = _apart(keys.join(central, "key").where("set <> b").select(F.col("set").alias("a"), "b").distinct(), trees)
    a, b = (briefs.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"t{x}")) for x in ("a", "b"))
    differing = F.aggregate(F.zip_with("ta", "tb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    fitting = 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")
    return met.join(a, "a").join(b, "b").where(fitting & (9 * differing <= F.col("na") + F.col("nb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _blocks(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks(block, set): members of a key, about BLOCK at most; meets(x, y): blocks of one key), equal blocks of several keys once."""
    sizes = keys.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))
    dealt = keys.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("set", "key"), F.col("_parts")))
    lists = dealt.repartition("key", "part").groupBy("key", "part").agg(F.array_sort(F.collect_list("set")).alias("sets"))
    lists = Written(lists.select("key", "part", F.xxhash64("sets", F.lit(0)).alias("block"), "sets"), "lists").df
    blocks = lists.groupBy("block").agg(F.first("sets").alias("sets")).select("block", F.explode("sets").alias("set"))
    x, y = lists.select("key", F.col("part").alias("px"), F.col("block").alias("x")), lists.select("key", F.col("part").alias("py"), F.col("block").alias("y"))
    return blocks, x.join(y, "key").where("px <= py").select("x", "y").distinct()


def _cross_pairs(keys: DataFrame, briefs: DataFrame, trees: DataFrame) -> DataFrame:
    """(a, b): sets of different trees that share a key, where sizes and bitmaps allow it."""
    placed = keys.select("key", "set").join(trees.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("tree", F.coalesce("component", "set"))
    mixed = placed.groupBy("key").agg(F.min("tree").alias("_a"), F.max("tree").alias("_b")).where("_a <> _b").select("key")
    placed = Written(placed.join(mixed, "key").select("key", "set", "tree"), "placed").df
    blocks, meets = _blocks(placed)
    known = briefs.join(placed.select("set", "tree").distinct(), "set")
    full = blocks.join(known, "set").groupBy("block").agg(F.collect_list(F.struct("set", "n", "tree", "bits")).alias("m"))
    full = Written(full.select("block", *[F.col(f"m.{c}").alias(c) for c in ("set", "n", "tree")], F.flatten("m.bits").alias("bits")), "blocks").df
    x, y = (full.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("set", "n", "tree", "bits")]) for s in ("x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                (s, n, t, w), (s2, n2, t2, w2) = ([b.column(f"{c}_{side}")[row].values.to_numpy() for c in ("set", "n", "tree", "bits")] for side in ("x", "y"))
                w, w2 = w.view(np.uint64).reshape(len(s), -1), w2.view(np.uint64).reshape(len(s2), -1)
                found: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
                for k in range(len(s)):
                    at = np.flatnonzero((t2 != t[k]) & may_be_similar(n[k], n2, 0))
                    at = at[may_be_similar(n[k], n2[at], np.bitwise_count(w2[at] ^ w[k]).sum(1, dtype=np.int64))]
                    found[0].append(np.minimum(s2[at], s[k]))
                    found[1].append(np.maximum(s2[at], s[k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], ["a", "b"])

    return meets.join(x, "x").join(y, "y").drop("x", "y").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, fingerprint: Callable[[bytes | None], int], link_nodes: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, component, first): th is ``xxhash64`` of the text's bytes; component the smallest doc_id reachable over links
    between near copies, itself included; first: whether the row is the one that stays of its group.

    ``fingerprint`` gives a text's as 64 bits; ``link_nodes`` takes (id, f), each f once, and gives links (a, b) of ids that are near.

    Null and empty texts have the empty set and are copies of each other; rows without an id take no part; rows that repeat an id
    and text are one document, rows that repeat an id with another text are judged by their own text each (of two in one group
    with the smallest id, that with the smaller th stays). Texts of any length are taken whole.
    """
    slim = _slim(docs, id_col, text_col)
    signed = Written(_signed(slim, fingerprint), "signed").df
    own = _own(signed.select(F.explode("low").alias("h"), "set"))
    nodes = Written(signed.groupBy("set").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.first("n").alias("n"), F.min("f").alias("f")).select("set", "r.doc_id", "r.th", "n", "f"), "nodes").df
    open_ = nodes.join(own, "set", "left").where("coalesce(own, 0) <= n div 5 AND n > 0").select("doc_id", "th")
    open_ = Written(open_, "open").df
    whole = Written(_whole(slim.join(small(open_), ["doc_id", "th"], "left_semi").select("doc_id", "th", "text")), "whole").df
    keys = Written(_keys(whole), "keys").df
    briefs = Written(whole.select("set", "n", "bits").join(keys.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"]), "briefs").df
    links = Written(_decided(_print_pairs(nodes.where("n > 0").select("set", "f"), link_nodes), whole), "links").df
    found = Written(components(links), "trees").df
    found = _grown(found, Written(_decided(_central_pairs(keys, briefs, found), whole), "links").df)
    found = _grown(found, Written(_decided(_cross_pairs(keys, briefs, found), whole), "links").df)
    named = nodes.join(found, nodes["set"] == found["node"], "left").select("set", "doc_id", "th", F.coalesce("component", "set").alias("label"))
    named = Written(named, "named").df
    heads = named.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("head"))
    head_of = named.join(heads, "label").select("set", "head")
    out = signed.select("doc_id", "th", "set").join(head_of, "set")
    return out.select("doc_id", "th", F.col("head.doc_id").alias("component"), ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))).alias("first"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("binary"))
