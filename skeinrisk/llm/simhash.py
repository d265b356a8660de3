"""SimHash near-duplicates by pigeonring filtering.

Two fingerprints of 64 bits that differ in at most ``bits`` places, cut into a ring of segments, have a segment from which
every chain of consecutive segments keeps within its part of the budget: l segments together differ in at most
l * bits / segments places. With three bits and four segments the first segment is equal and the second differs in one place at
most, so one of its two bytes is equal too: segment and byte are the key of the join. Longer chains are then held against their
parts before the whole fingerprint is (the full Hamming check).

Rows of a key are sorted by Spark and met in a streaming function, which sends out the links of a spanning forest, never all
pairs: n rows that share a key give at most n - 1 links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, small
from .components import components
from .shingle_sets import near_copies, shingle_hashes, text_hash

SEGMENTS, SEGMENT_BITS = 4, 16
#: The contract's: shingles of three words, repeats included, and three differing bits.
SHINGLE, BITS = 3, 3
#: Hashes whose bits are counted at a time.
PART = 1 << 16


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), PART):
        part = h[at : at + PART].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces
    return majority(shingle_hashes(words, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f: the fingerprint as a long); whole texts, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], ["doc_id", "f"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, f long")


class Forest:
    """Keeps the links that join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.a: list[int] = []
        self.b: list[int] = []

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.a.append(a)
            self.b.append(b)


def near(x: np.ndarray, budgets: list[int]) -> np.ndarray:
    """Which rows of differences pass, chain by chain from the first segment on; the last chain is the whole fingerprint."""
    ok = np.ones(len(x), bool)
    for n, most in enumerate(budgets, 1):
        mask = np.uint64((1 << (SEGMENT_BITS * n)) - 1)
        ok &= np.bitwise_count(x & mask) <= most
    return ok


def chain_budgets(bits: int) -> list[int]:
    return [bits * n // SEGMENTS for n in range(1, SEGMENTS + 1)]


def _spread(rows: np.ndarray, ring: np.ndarray, ids: np.ndarray, budgets: list[int], forest: Forest) -> None:
    """Links of the rows with each other: from a row to all that are near and not met yet, and so on from these."""
    left = rows
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = near(ring[left] ^ ring[at], budgets)
            for k in left[hit]:
                forest.add(int(ids[at]), int(ids[k]))
                todo.append(k)
            left = left[~hit]


def bucket_links(key: np.ndarray, ring: np.ndarray, ids: np.ndarray, bits: int = BITS) -> Forest:
    """Links between rows of equal key. ring: fingerprints turned so that the key's segment is lowest; sorted by key."""
    budgets, forest = chain_budgets(bits), Forest()
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[cuts, len(key)])
    size_at = np.repeat(sizes, sizes)
    few = 24
    for step in range(1, min(few, int(sizes.max(initial=1)))):
        a = np.flatnonzero((size_at[:-step] > step) & (size_at[:-step] <= few) & (key[:-step] == key[step:]))
        if not len(a):
            continue
        b = a + step
        hit = near(ring[a] ^ ring[b], budgets)
        for i, j in zip(ids[a[hit]].tolist(), ids[b[hit]].tolist(), strict=True):
            forest.add(i, j)
    for k in np.flatnonzero(sizes > few):
        _spread(np.arange(cuts[k], cuts[k] + sizes[k]), ring, ids, budgets, forest)
    return forest


def link_nodes(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """nodes(id long, f long), different fingerprints -> links (a, b) that join all nodes which link, directly or by others."""
    if chain_budgets(bits)[:2] > [0, 1]:
        raise ValueError("keys are exact for up to three differing bits")
    keys = []
    for start in range(SEGMENTS):
        turned = F.col("f") if not start else F.shiftrightunsigned("f", SEGMENT_BITS * start).bitwiseOR(F.shiftleft("f", 64 - SEGMENT_BITS * start))
        for byte in (0, 1):
            own = F.shiftrightunsigned(turned, SEGMENT_BITS + 8 * byte).bitwiseAND(255)
            key = F.shiftleft(turned.bitwiseAND((1 << SEGMENT_BITS) - 1), 8).bitwiseOR(own) + ((2 * start + byte) << (SEGMENT_BITS + 8))
            keys.append(F.struct(key.cast("int").alias("key"), turned.alias("ring")))
    rows = nodes.select("id", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.ring", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            key, ring, ids = (t.column(c).to_numpy() for c in ("key", "ring", "id"))
            found = bucket_links(key, ring.view(np.uint64), ids, bits)
            return pa.RecordBatch.from_arrays([pa.array(found.a, pa.int64()), pa.array(found.b, pa.int64())], ["a", "b"])

        held: list[pa.RecordBatch] = []  # rows of the last key, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != key[0]):
                if held or cut:
                    yield links_of([*held, b.slice(0, cut)] if cut else held)
                held = []
            held.append(b.slice(cut))
        if held:
            yield links_of(held)

    # 2 ** 24 keys for each start and byte
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f, component): the fingerprint, and the smallest doc_id reachable over links, itself included.

    Rows with equal fingerprints are one node of the graph, named by their smallest id, so copies cost one row each. Null and
    empty texts have fingerprint zero and link like any other; texts of any length are hashed whole; rows without an id take no
    part and have no component; rows that repeat an id are one document; an empty table gives an empty result.
    """
    prints = Written(fingerprints(docs, shingle, id_col, text_col), "prints").df
    nodes = Written(prints.groupBy("f").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL"), "nodes").df
    found = components(link_nodes(nodes, bits))
    named = nodes.join(small(found), nodes["id"] == found["node"], "left").select("f", F.coalesce("component", "id").alias("component"))
    return prints.join(named, "f", "left").select("doc_id", "f", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id.

    Fingerprints are met by pigeonring filtering; ``shingle_sets.near_copies`` decides what they link on whole sets of five-word
    shingles (similarity 0.8 or more), and adds the near copies that three differing bits can't tell.

    Rows without an id stay; rows that repeat an id and text stay or go together; extra columns of any name pass through.
    """
    gone = near_copies(docs, fingerprint, link_nodes, id_col, text_col).where(~F.col("first")).select("doc_id", "th").distinct()
    gone = small(Written(gone, "gone").df).alias("g")
    own = (F.col(f"d.`{id_col}`").cast("long") == F.col("g.doc_id")) & (text_hash(F.col(f"d.`{text_col}`")) == F.col("g.th"))
    return docs.alias("d").join(gone, own, "left_anti")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
