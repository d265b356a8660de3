"""Removal of long repeated strings by a logarithmic family of suffix arrays.

A string is found where two suffixes that stand side by side in suffix order share ``least`` bytes. No task holds all suffixes:

* Each window of ``least`` bytes is owned by the place of its least gram hash (its anchor), which equal windows share. The windows
  of one anchor and one half of the distances to it are a *chunk*: their union is its text, and what is common to all windows of
  that half is its *key*. Equal windows are in chunks of equal key, so keys deal the suffixes to shards.
* Chunks whose key occurs once hold no repeat; chunks that occur twice are repeated from end to end; both are told by counting
  hashes (128 bits of the text). What is left, chunks of one key and different texts, needs suffix arrays.
* ``Family`` takes such chunks in batches. A batch becomes a suffix array in each shard, which is scanned side by side with the
  arrays of the levels there are; equal windows are marked on both sides. Then the batch becomes the lowest level, and while two
  levels have equal size they are merged into one of twice as many shards, so n batches lie in log n levels.
* Keys with more chunks than a shard should hold are dealt again by finer distances to the anchor, the keys grow longer, and at a
  distance of one the window is its own key. So no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, brief_shuffles

#: The contract's length of a string; bytes of a gram.
LEAST, GRAM = 400, 8
#: Bytes of texts that are cut at a time, bytes of chunks in a shard of the lowest level, chunks of one key in a shard at most.
TURN_BYTES, SHARD_BYTES, KEY_CHUNKS = 2 << 20, 512 << 10, 512
#: Batches that a table is taken in, and distances to the anchor by which crowded keys are dealt again.
BATCHES, FINER = 4, (64, 16, 4, 1)

CHUNK = "key long, c binary, w int, far int"


def anchors(buf: np.ndarray, least: int) -> np.ndarray:
    """For each place, where the least gram hash of the ``least`` bytes from there on is (the first of equal ones)."""
    n, wide = len(buf) - GRAM + 1, least - GRAM + 1
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram |= buf[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    gram *= np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    rank = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // wide)
    rank = np.pad(rank, (0, blocks * wide - n), constant_values=np.iinfo(np.uint64).max).reshape(blocks, wide)
    ahead = np.minimum.accumulate(rank, 1).ravel()
    back = np.minimum.accumulate(rank[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - wide + 1
    return (np.minimum(back[:starts], ahead[wide - 1 : wide - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def core(first: int, far: int, least: int, cell: int, size: int) -> tuple[int, int]:
    """(start, end) of what all windows have in common whose distance to the anchor is in a cell of ``size`` distances; ``first`` is a
    chunk's place and ``far`` the distance of its first window."""
    anchor = first + far
    return anchor - cell * size, anchor - min((cell + 1) * size - 1, least - GRAM) + least


def chunks_of(texts: list[bytes], least: int) -> Iterator[list[tuple[int, bytes, int, int, list[int]]]]:
    """For each text, (key, hash, windows, distance of the first window to its anchor, places) of its different chunks."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    data = b"".join(texts)
    if len(data) < least:
        yield from ([] for _ in texts)
        return
    at = anchors(np.frombuffer(data, np.uint8), least)
    valid = np.zeros(len(data), bool)
    for a, b in zip(ends - sizes, ends, strict=True):
        valid[a : max(a, b - least + 1)] = True
    half = least // 2
    v = np.flatnonzero(valid)
    far = at[v] - v
    own = at[v] * 2 + (far >= half)
    cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(v) else np.zeros(0, np.int64)
    lo, dist, width = v[cut], far[cut], np.diff(np.r_[cut, len(v)])
    begin = np.searchsorted(lo, ends - sizes)
    stop = np.searchsorted(lo, ends)
    view = memoryview(data)
    lo, dist, width = lo.tolist(), dist.tolist(), width.tolist()
    for first, i, j in zip((ends - sizes).tolist(), begin.tolist(), stop.tolist(), strict=True):
        found: dict[bytes, tuple[int, bytes, int, int, list[int]]] = {}
        for k in range(i, j):
            p, d, w = lo[k], dist[k], width[k]
            c = xxhash.xxh3_128_digest(view[p : p + w - 1 + least])
            if c in found:
                found[c][4].append(p - first)
            else:
                a, b = core(p, d, least, int(d >= half), half)
                found[c] = (xxhash.xxh3_64_intdigest(view[a:b], int(d >= half)) - (1 << 63), c, w, d, [p - first])
        yield list(found.values())


def turns(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about TURN_BYTES bytes of a binary column (one row at least)."""
    for b in batches:
        sizes = np.cumsum([len(x.as_buffer() or b"") if x.is_valid else 0 for x in b.column(column)]) // TURN_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                yield b.slice(a, z - a)


def chunk_table(texts: DataFrame, least: int) -> DataFrame:
    """texts(t, text binary, n) -> (t, copies, key, c, w, far, n: occurrences, p: the first place, at: all places as int32) of each text's different chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in turns(batches, 1):
            own = zip(b.column(0).to_pylist(), b.column(2).to_pylist(), chunks_of(b.column(1).to_pylist(), least), strict=True)
            yield batch([(t, n, key, c, w, far, n * len(at), at[0], np.array(at, np.int32).tobytes()) for t, n, found in own for key, c, w, far, at in found], kinds)

    kinds = {"t": pa.binary(), "copies": pa.int64(), "key": pa.int64(), "c": pa.binary(), "w": pa.int32(), "far": pa.int32(), "n": pa.int64(), "p": pa.int32(), "at": pa.binary()}
    return texts.select("t", "text", "n").mapInArrow(run, f"t binary, copies long, {CHUNK}, n long, p int, at binary")


def batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def with_texts(texts: DataFrame, chosen: DataFrame, least: int) -> DataFrame:
    """chosen(key, c, w, far, n, m, t, p) -> the same with the chunk's text, cut at place p of text t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in turns(batches, 0):
            rows = [(x["key"], x["c"], x["w"], x["far"], x["n"], x["m"], t[x["p"] : x["p"] + x["w"] - 1 + least]) for t, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in own]
            yield batch(rows, kinds)

    kinds = {"key": pa.int64(), "c": pa.binary(), "w": pa.int32(), "far": pa.int32(), "n": pa.int64(), "m": pa.int64(), "text": pa.binary()}
    lists = chosen.groupBy("t").agg(F.collect_list(F.struct("key", "c", "w", "far", "n", "m", "p")).alias("own"))  # one text's chunks
    return texts.join(lists, "t").select("text", "own").mapInArrow(run, f"{CHUNK}, n long, m long, text binary")


def pieces_of(rows: DataFrame, least: int, size: int) -> DataFrame:
    """Chunks dealt by cells of ``size`` distances: (root, shift, key, c, w, far, n, text), where root's window ``shift`` is the
    piece's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for root, shift, w, far, n, text in zip(*[b.column(k).to_pylist() for k in range(6)], strict=True):
                first = 0
                while first < w:
                    d = far - first
                    cell = d // size
                    many = min(w - first, d - cell * size + 1)
                    own = text[first : first + many - 1 + least]
                    a, z = core(0, d, least, cell, size)
                    key = xxhash.xxh3_64_intdigest(own[max(a, 0) : z], cell * 512 + size) - (1 << 63)
                    out.append((root, shift + first, key, xxhash.xxh3_128_digest(own), many, d, n, own))
                    first += many
            yield batch(out, kinds)

    kinds = {"root": pa.binary(), "shift": pa.int32(), "key": pa.int64(), "c": pa.binary(), "w": pa.int32(), "far": pa.int32(), "n": pa.int64(), "text": pa.binary()}
    return rows.select("root", "shift", "w", "far", "n", "text").mapInArrow(run, f"root binary, shift int, {CHUNK}, n long, text binary")


class Shard:
    """A suffix array over chunks: their texts end to end, and their different windows in order.

    ``at``: where each window starts; ``owner``: its chunk; ``seen``: whether it is known to be repeated.
    """

    FIELDS = {name: pa.binary() for name in ("ids", "keys", "ends", "at", "seen", "text")}
    SCHEMA = "shard long, " + ", ".join(f"{name} binary" for name in FIELDS)

    def __init__(self, ids: np.ndarray, keys: np.ndarray, ends: np.ndarray, at: np.ndarray, owner: np.ndarray, seen: np.ndarray, text: bytes, least: int):
        self.ids, self.keys, self.ends, self.at, self.owner, self.seen, self.text, self.least = ids, keys, ends, at, owner, seen, text, least

    @classmethod
    def build(cls, rows: list[tuple[bytes, int, int, int, bytes]], least: int) -> tuple[Shard, list[tuple[bytes, bytes]]]:
        """rows (chunk, key, windows, occurrences, text) -> the array, and the marks of windows that repeat within it."""
        ids, text = np.array([r[0] for r in rows], "V16"), b"".join(r[4] for r in rows)
        keys, w, sizes = (np.array(x, np.int64) for x in ([r[1] for r in rows], [r[2] for r in rows], [len(r[4]) for r in rows]))
        ends = np.cumsum(sizes)
        at = np.arange(w.sum()) + np.repeat(ends - sizes - np.cumsum(w) + w, w)
        own = cls(ids, keys, ends, at, np.repeat(np.arange(len(rows)), w), np.repeat(np.array([r[3] > 1 for r in rows], bool), w), text, least)
        return own, own._settle(np.argsort(own.windows(), kind="stable"))

    @classmethod
    def read(cls, row: dict, prefix: str, least: int) -> Shard:
        take = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        at, ends = take("at", np.int32).astype(np.int64), take("ends", np.int64)
        return cls(take("ids", "V16"), take("keys", np.int64), ends, at, np.searchsorted(ends, at, "right"), take("seen", bool), row[prefix + "text"], least)

    def row(self, shard: int) -> tuple:
        arrays = self.ids, self.keys.astype(np.int64), self.ends.astype(np.int64), self.at.astype(np.int32), self.seen
        return (shard, *(x.tobytes() for x in arrays), self.text)

    def windows(self) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, f"V{self.least}")
        all_ = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.text, np.uint8), self.least)
        return np.ascontiguousarray(all_[self.at]).view(f"V{self.least}").ravel()

    def first(self, owner: np.ndarray) -> np.ndarray:
        return np.r_[0, self.ends][owner]

    def marks(self, which: np.ndarray) -> list[tuple[bytes, bytes]]:
        """(chunk, spans as pairs of int32) of windows, given by number."""
        if not len(which):
            return []
        order = which[np.lexsort((self.at[which], self.owner[which]))]
        owner = self.owner[order]
        place = self.at[order] - self.first(owner)
        new = np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]
        begin = np.flatnonzero(new)
        spans = np.stack([place[begin], place[np.r_[begin[1:], len(place)] - 1] + 1], 1).astype(np.int32)
        chunk = owner[begin]
        cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        return [(self.ids[chunk[a]].tobytes(), spans[a:b].tobytes()) for a, b in zip(cuts, np.r_[cuts[1:], len(chunk)], strict=True)]

    def _settle(self, order: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Puts the windows in order, keeps one of equal ones, and returns the marks of those that were not seen yet."""
        v = self.windows()[order]
        new = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        many = np.diff(np.r_[begin, len(v)])
        repeated = np.repeat(many > 1, many)
        known = self.seen[order]
        found = self.marks(order[repeated & ~known])
        seen = (np.bitwise_or.reduceat(known, begin) if len(begin) else known) | (many > 1)
        kept = order[begin]
        self.at, self.owner, self.seen = self.at[kept], self.owner[kept], seen
        return found

    def meet(self, other: Shard, mine: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Marks of windows that both have and that weren't seen yet, of either side; ``mine``: which of this side's to look at."""
        a, b = self.windows()[mine], other.windows()
        if not len(a) or not len(b):
            return []
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = b[at] == a
        mine, at = np.flatnonzero(mine)[both], at[both]
        return self.marks(mine[~self.seen[mine]]) + other.marks(at[~other.seen[at]])

    def merged(self, other: Shard, mine: np.ndarray, theirs: np.ndarray) -> tuple[Shard, list[tuple[bytes, bytes]]]:
        """One array over some chunks of each side (masks), and the marks of windows that both have and that weren't seen yet."""
        a, b = self.only(mine), other.only(theirs)
        both = Shard(
            np.r_[a.ids, b.ids], np.r_[a.keys, b.keys], np.r_[a.ends, b.ends + len(a.text)], np.r_[a.at, b.at + len(a.text)],
            np.r_[a.owner, b.owner + len(a.ids)], np.r_[a.seen, b.seen], a.text + b.text, self.least,
        )
        return both, both._settle(np.argsort(both.windows(), kind="stable"))  # two sorted runs: a merge

    def only(self, chunks: np.ndarray) -> Shard:
        """The array over some of the chunks (a mask)."""
        first, texts = np.r_[0, self.ends], []
        for k in np.flatnonzero(chunks):
            texts.append(self.text[first[k] : first[k + 1]])
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        number = np.cumsum(chunks) - 1
        keep = chunks[self.owner]
        owner = number[self.owner[keep]]
        at = self.at[keep] - first[self.owner[keep]] + np.r_[0, ends][owner]
        return Shard(self.ids[chunks], self.keys[chunks], ends, at, owner, self.seen[keep], b"".join(texts), self.least)


MARKS = "c binary, spans binary"
_MARKS = {"c": pa.binary(), "spans": pa.binary()}


TOLD = f"{Shard.SCHEMA}, marks array<struct<c:binary,spans:binary>>"


def told(shard: int, own: Shard, marks: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """An array as a row, with the marks that its making found."""
    kinds = {"shard": pa.int64(), **Shard.FIELDS, "marks": pa.list_(pa.struct(list(_MARKS.items())))}
    return batch([(*own.row(shard), [{"c": c, "spans": x} for c, x in marks])], kinds)


class Family:
    """Levels of suffix arrays: level k has ``shards`` * 2 ** k shards and holds 2 ** k batches, or isn't there."""

    def __init__(self, shards: int, least: int = LEAST):
        self.shards, self.least = shards, least
        self.levels: list[Written | None] = []

    def add(self, chunks: DataFrame) -> DataFrame:
        """chunks(key, c, w, n, text), none of which is in the family yet -> marks (c, spans): windows of new chunks, and of those
        in the family, that are found to be repeated. Chunks that occur more than once (n) are known to be and get no marks."""
        made, k = [Written(self._arrays(chunks), "suffixes")], 0
        while k < len(self.levels) and self.levels[k] is not None:  # a merge scans both sides, too
            made.append(Written(self._merge(made[-1].df, self.levels[k].df, k), "suffixes"))
            k += 1
        found = [x.df.select(F.explode("marks").alias("m")).select("m.c", "m.spans") for x in made]
        found += [self._scan(made[0].df, level.df, j) for j, level in enumerate(self.levels) if j >= k and level is not None]
        marks = Written(reduce(DataFrame.unionByName, found), "marks").df
        for old in [*made[:-1], *self.levels[:k]]:
            old.discard()
        self.levels = [*[None] * k, made[-1], *self.levels[k + 1 :]]
        return marks

    def discard(self) -> None:
        """Deletes the family's files."""
        for level in self.levels:
            if level is not None:
                level.discard()
        self.levels = []

    def _arrays(self, chunks: DataFrame) -> DataFrame:
        least = self.least

        def made(shard: int, rows: list[tuple]) -> pa.RecordBatch:
            return told(shard, *Shard.build(rows, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, last = [], None
            for b in batches:
                for shard, *row in zip(*[b.column(k).to_pylist() for k in range(6)], strict=True):
                    if shard != last and held:
                        yield made(last, held)
                        held = []
                    last = shard
                    held.append(tuple(row))
            if held:
                yield made(last, held)

        rows = chunks.select(F.pmod("key", F.lit(self.shards)).alias("shard"), "c", "key", "w", "n", "text")
        rows = rows.repartition("shard").sortWithinPartitions("shard")
        return rows.mapInArrow(run, TOLD)

    @staticmethod
    def _pairs(a: DataFrame, b: DataFrame, on: Column, how: str) -> DataFrame:
        side = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in ("shard", *Shard.FIELDS)])
        return side(a, "a_").join(side(b, "b_").hint("merge"), on, how)

    def _scan(self, new: DataFrame, level: DataFrame, k: int) -> DataFrame:
        least, shards = self.least, self.shards << k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(batches):
                mine, theirs = Shard.read(row, "a_", least), Shard.read(row, "b_", least)
                own = (mine.keys % shards == row["b_shard"])[mine.owner]
                yield batch(mine.meet(theirs, own), _MARKS)

        return self._pairs(new, level, F.col("a_shard") == F.pmod("b_shard", F.lit(self.shards)), "inner").mapInArrow(run, MARKS)

    def _merge(self, new: DataFrame, level: DataFrame, k: int) -> DataFrame:
        least, shards = self.least, self.shards << k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = Shard.build([], least)[0]
            for row in one_by_one(batches):
                sides = [Shard.read(row, p, least) if row[f"{p}shard"] is not None else none for p in ("a_", "b_")]
                shard = row["b_shard"] if row["a_shard"] is None else row["a_shard"]
                for to in (shard, shard + shards):
                    both, marks = sides[0].merged(sides[1], *[x.keys % (2 * shards) == to for x in sides])
                    if len(both.ids):
                        yield told(to, both, marks)

        return self._pairs(new, level, F.col("a_shard") == F.col("b_shard"), "full").mapInArrow(run, TOLD)


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for at in range(b.num_rows):
            yield b.slice(at, 1).to_pylist()[0]


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def meeting(texts: DataFrame, least: int) -> DataFrame:
    """The rows of ``chunk_table`` whose key occurs more than once; no other can hold a repeated window. All rows are only kept until
    keys are counted, so that what follows moves these few."""
    table = Written(chunk_table(texts, least), "chunks")
    keys = Written(table.df.groupBy("key").agg(F.sum("n").alias("many")).where("many > 1").select("key"), "keys")
    met = Written(table.df.join(keys.df, "key"), "meeting").df
    table.discard()
    keys.discard()
    return met


def occurring(chunks: DataFrame) -> DataFrame:
    """chunks(key, c, n, ...), one row a chunk -> those that occur twice or share their key, with m: the key's chunks, or null."""
    shared = chunks.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return Written(chunks.join(shared, "key", "left").where("n > 1 OR m IS NOT NULL"), "occurring").df


def repeated_chunks(texts: DataFrame, table: DataFrame, least: int, batches: int, key_chunks: int, shard_bytes: int) -> DataFrame:
    """(c, spans, shift, w): of chunk c, the windows ``shift`` + each of ``spans``, or all w from ``shift`` on, are repeated."""
    once = table.groupBy("key", "c").agg(F.sum("n").alias("n"), F.first("w").alias("w"), F.first("far").alias("far"), F.min(F.struct("t", "p")).alias("at"))
    seen = occurring(once)
    whole = lambda x: x.where("n > 1").select("c", F.lit(None).cast("binary").alias("spans"), "w")
    mixed = seen.where("m IS NOT NULL").select("key", "c", "w", "far", "n", "m", "at.t", "at.p")
    cut_out = [Written(with_texts(texts, mixed, least), "chunks")]
    mixed = cut_out[0].df
    out = whole(seen).withColumn("shift", F.lit(0))
    ready = mixed.where(F.col("m") <= key_chunks).select("key", "c", "w", "n", "text")
    hot = mixed.where(F.col("m") > key_chunks).select(F.col("c").alias("root"), F.lit(0).alias("shift"), "w", "far", "n", "text")
    roots, told = None, None
    for size in FINER:
        if hot.isEmpty():
            break
        cut_out.append(Written(pieces_of(hot, least, size), "pieces"))
        cut = cut_out[-1].df
        own = cut.select("c", "root", "shift").distinct()
        roots = own if roots is None else roots.unionByName(own)
        once = cut.groupBy("key", "c").agg(F.sum("n").alias("n"), *[F.first(x).alias(x) for x in ("w", "far", "root", "shift", "text")])
        seen = occurring(once)
        told = whole(seen) if told is None else told.unionByName(whole(seen))
        mixed = seen.where("m IS NOT NULL")
        ready = ready.unionByName(mixed.where(F.col("m") <= key_chunks).select(*ready.columns))
        hot = mixed.where(F.col("m") > key_chunks).select(*hot.columns)
    total = ready.agg(F.sum(F.length("text"))).first()[0] or 0
    family = Family(max(1, -(-total // (batches * shard_bytes))), least)
    marks = out.limit(0)
    for k in range(batches if total else 0):
        found = family.add(ready.where(F.pmod(F.xxhash64("c"), F.lit(batches)) == k))
        marks = marks.unionByName(found.withColumns({"w": F.lit(0), "shift": F.lit(0)}))
    family.discard()
    out = out.unionByName(marks)
    if roots is not None:  # what is told of pieces, told of the chunks that they were cut from
        pieces = marks.drop("shift").unionByName(told).join(roots, "c")
        out = out.unionByName(pieces.select(F.col("root").alias("c"), "spans", "shift", "w"))
    out = Written(out, "repeated").df
    for own in cut_out:
        own.discard()
    return out


def covered(rows: list[dict], least: int) -> np.ndarray:
    """(start, end) of the stretches that repeated windows cover, from a text's chunks' places and windows."""
    found = []
    for r in rows:
        at = np.frombuffer(r["at"], np.int32).astype(np.int64) + r["shift"]
        spans = np.array([[0, r["w"]]]) if r["spans"] is None else np.frombuffer(r["spans"], np.int32).reshape(-1, 2)
        found.append((at[:, None, None] + spans[None]).reshape(-1, 2))
    spans = np.concatenate(found)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    spans[:, 1] += least - 1
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.r_[new[1:], len(spans)] - 1]], 1)


def cut_texts(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, key_chunks: int = KEY_CHUNKS, shard_bytes: int = SHARD_BYTES, text_col: str = "text") -> DataFrame:
    """(t, spans: array of (start, end) in bytes, kept binary): every different text, by its hash t (``text_hash`` of its bytes), that
    loses bytes: those in a string of ``least`` bytes that starts at another place of any row, too."""
    slim = docs.select(F.col(text_col).cast("binary").alias("text")).where(F.length("text") >= least)
    texts = Written(slim.groupBy(text_hash(F.col("text")).alias("t")).agg(F.first("text").alias("text"), F.count("*").alias("n")), "texts").df
    table = meeting(texts, least)
    told = repeated_chunks(texts, table, least, batches, key_chunks, shard_bytes)
    hits = table.where("copies = 1").select("t", "c", "at", F.col("w").alias("own")).join(told, "c")
    hits = hits.groupBy("t").agg(F.collect_list(F.struct("at", "spans", "shift", F.coalesce("w", "own").alias("w"))).alias("hits"))  # one text's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in turns(batches, 1):
            rows = []
            for t, text, own in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                spans = covered(own, least)
                edges = [0, *spans.ravel().tolist(), len(text)]
                rows.append((t, [{"start": a, "end": z} for a, z in spans.tolist()], b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))))
            yield batch(rows, kinds)

    kinds = {"t": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
    some = texts.where("n = 1").join(hits, "t").select("t", "text", "hits").mapInArrow(run, "t binary, spans array<struct<start:long,end:long>>, kept binary")
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end")))
    copied = texts.where("n > 1").select("t", span.alias("spans"), F.lit(b"").alias("kept"))
    return some.unionByName(copied)


def drop_repeated(docs: DataFrame, least: int = LEAST, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the bytes of every string of ``least`` bytes that another place holds, too; all rows and columns stay.

    Of repeated strings no copy stays. Cuts may fall into a character; the bytes around it stay as they are. Null texts stay null.
    """
    with brief_shuffles(docs.sparkSession):
        gone = Written(cut_texts(docs, least, text_col=text_col, **how).select("t", "kept"), "kept").df.alias("g")
    text = F.col(f"d.`{text_col}`")
    out = docs.alias("d").join(gone, text_hash(text.cast("binary")) == F.col("g.t"), "left")
    kept = F.when(F.col("g.t").isNull(), text).otherwise(F.col("g.kept").cast("string"))
    return out.select(*[kept.alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def suffix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The contract's rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    One row for each row of ``docs``: rows that repeat an id, or a text, are documents of their own. Null texts are empty; texts of
    fewer bytes than a string keep all; texts of any length are taken whole; rows without an id are answered, too; an empty table
    gives an empty result; other columns are ignored.
    """
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    with brief_shuffles(docs.sparkSession):
        gone = cut_texts(docs, text_col=text_col, **how)
        gone = Written(gone.select("t", removed.alias("removed"), F.size("spans").cast("long").alias("spans"), F.sha2("kept", 256).alias("sha")), "gone").df
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_bytes"), text_hash(text).alias("t"), F.sha2(text, 256).alias("own"))
    none = F.lit(0).cast("long")
    return rows.join(gone, "t", "left").select("doc_id", "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("spans", none).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))
