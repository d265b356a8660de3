"""Benchmark decontamination by q-gram lemma filtering.

A region of a text that is within e edits of a passage of n characters shares at least n - q + 1 - q * e of its q-grams with
it, and all of them lie on at most e + 1 neighbouring diagonals (place in the text less place in the passage). Shared q-grams
are counted in bands of 2 (e + 1) diagonals, each overlapping the next by half, so one band holds them all; bands that reach
the bound are verified by an alignment that is confined to their diagonals.

Characters are letters and digits, lower-cased, with one space for whatever stands between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

_BETWEEN = re.compile(r"[\W_]+")
#: Characters of a text that are looked at together; the next part begins a passage's length before the end of the last.
PART = 1 << 20
#: Shared q-grams that are counted at a time.
HITS = 1 << 21
#: Characters of the benchmark that are searched for in one pass.
BLOCK_CHARS = 4_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def normal(text: str | None) -> str:
    return _BETWEEN.sub(" ", text.lower()).strip() if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A polynomial hash of every q-gram, by doubling."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, width, base = None, 0, np.uint64(_BASE)
        power, size = c + np.uint64(1), 1
        rest = q
        while rest:
            if rest & 1:
                n = len(c) - width - size + 1
                if out is None:
                    out = power[:n].copy()
                else:
                    out = out[:n] * base**np.uint64(size) + power[width : width + n]
                width += size
            rest >>= 1
            if rest:
                power = power[: len(power) - size] * base**np.uint64(size) + power[size:]
                size *= 2
        return out ^ (out >> np.uint64(29))


def edits_within(passage: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The least edits that turn a piece of ``text`` into the passage, with the alignment on diagonals low to high.

    -> (edits, start, end) of the nearest piece, or None if it takes over ``most`` edits. Cells off the diagonals aren't made.
    """
    n, width = len(passage), high - low + 1
    for at in range(max(low, 0), min(high, len(text) - n) + 1):  # most are exact
        if text[at] == passage[0] and np.array_equal(text[at : at + n], passage):
            return 0, at, at + n
    far = most + 1
    # cell (i, d): the passage's first i characters against a piece of the text that ends before place i + d
    places, own = np.arange(low, high + 1), np.arange(width)
    cost = np.where((places >= 0) & (places <= len(text)), 0, far)
    begin = places.copy()
    # what the text has at each place that a cell looks at; none (0, which no character is) beyond its ends
    seen = np.zeros(n + width, text.dtype)
    inner = slice(max(low, 0), max(min(high + n, len(text)), 0))
    seen[inner.start - low : inner.stop - low] = text[inner]
    drop, from_drop, before = np.empty(width, np.int64), np.empty(width, np.int64), np.empty(width, np.int64)
    for i in range(1, n + 1):
        here, at = seen[i - 1 : i - 1 + width], places + i
        now = cost + (here != passage[i - 1])
        now[here == 0] = far
        drop[:-1], drop[-1] = cost[1:] + 1, far  # a character of the passage that the text lacks
        from_drop[:-1], from_drop[-1] = begin[1:], 0
        inside = (at >= 0) & (at <= len(text))
        less = (drop < now) & inside
        now, start = np.where(less, drop, now), np.where(less, from_drop, begin)
        # characters of the text that the passage lacks: one more for each diagonal, from the nearest cell that is no worse itself
        flat = now - own
        least = np.minimum.accumulate(flat)
        before[0], before[1:] = flat[0], least[:-1]
        source = np.maximum.accumulate(np.where(flat <= before, own, 0))
        cost, begin = np.minimum(np.where(at <= len(text), least + own, far), far), start[source]
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return (int(cost[k]), int(begin[k]), int(low + k + n)) if cost[k] <= most else None


@dataclass(frozen=True)
class Passages:
    """The q-grams of a block of passages, ready to be probed."""

    ids: list[int | None]
    texts: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    longest: int

    @staticmethod
    def of(items: list[tuple[int, str]], q: int, rate: float) -> Passages:
        """items: (id, normal text). A passage gets the edits that ``rate`` allows and the lemma can still tell by three
        q-grams; passages too short for that get q-grams of their whole length, so only exact ones are found."""
        ids, texts, edits, least, by_q = [], [], [], [], {}
        for k, (i, t) in enumerate(items):
            c = codes(t)
            own_q = min(q, len(c))
            e = max(0, min(int(rate * len(c)), (len(c) - own_q + 1 - 3) // own_q))
            ids.append(i)
            texts.append(c)
            edits.append(e)
            least.append(len(c) - own_q + 1 - own_q * e)
            by_q.setdefault(own_q, []).append(k)
        grams = {}
        for own_q, ks in by_q.items():
            h = [gram_hashes(texts[k], own_q) for k in ks]
            keys = np.concatenate(h)
            item = np.repeat(ks, [len(x) for x in h])
            at = np.concatenate([np.arange(len(x)) for x in h])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            grams[own_q] = (keys[order], item[order], at[order], seen)
        return Passages(ids, texts, np.array(edits), np.array(least), grams, max(map(len, texts), default=0))

    def bands(self, c: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first and last diagonal) of the bands that reach their passage's bound."""
        out = []
        for q, (keys, item, at, seen) in self.grams.items():
            h = gram_hashes(c, q)
            place = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(keys, h[place])
            n = np.searchsorted(keys, h[place], "right") - lo
            place, lo, n = place[n > 0], lo[n > 0], n[n > 0]
            if not len(place):
                continue
            # a gram that stands k times in the passages gives k hits; HITS of them, or one place's, are made at a time
            part = (np.cumsum(n) - 1) // HITS
            counted = [self.counted(place[part == k], lo[part == k], n[part == k], item, at) for k in np.unique(part)]
            pair, which = np.unique(np.concatenate([x for x, _ in counted]), return_inverse=True)
            count = np.bincount(which, np.concatenate([c for _, c in counted]))
            for p in pair[count >= self.least[pair >> 40]].tolist():
                k = p >> 40
                start = (p & (1 << 40) - 1) * (int(self.edits[k]) + 1) - self.shift(k)
                out.append((k, start, start + 2 * int(self.edits[k]) + 1))
        return out

    def shift(self, k):
        """What is added to diagonals, so that neither they nor the band before them is below zero."""
        return self.longest + self.edits[k] + 1

    def counted(self, place: np.ndarray, lo: np.ndarray, n: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage and band in one number, shared q-grams) for grams at ``place`` of the text and ``lo`` to lo + n of the passages'."""
        hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        k = item[hit]
        band = (np.repeat(place, n) - at[hit] + self.shift(k)) // (self.edits[k] + 1)
        return np.unique(np.concatenate([k << 40 | band, k << 40 | (band - 1)]), return_counts=True)  # bands of two halves, starting at either

    def matches(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """The nearest match of each passage in a text: passage -> (edits, start, end) in the normal text."""
        t = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        step = max(PART, 4 * self.longest)
        for begin in range(0, max(len(t), 1), step):
            c = codes(t[begin : begin + step + 2 * self.longest + 64])
            for k, low, high in self.bands(c):
                if best.get(k, (1,))[0] == 0:
                    continue
                x = edits_within(self.texts[k], c, low, high, int(self.edits[k]))
                if x and x[0] < best.get(k, (1 << 30,))[0]:
                    best[k] = (x[0], begin + x[1], begin + x[2])
        return best


def passage_blocks(benchmark: DataFrame, id_col: str, text_col: str, q: int, rate: float, block_chars: int = BLOCK_CHARS) -> Iterator[Passages]:
    """The benchmark in blocks of ``block_chars`` characters, or one passage, at most, in order of id, those without an id first;
    null and empty passages match nothing.

    The driver holds one block at a time, and one goes to every task; each takes a pass over the texts.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").orderBy("i", "t")
    now, size = [], 0
    for r in rows.toLocalIterator():
        t = normal(r["t"])
        if not t:
            continue
        if now and size + len(t) > block_chars:
            yield Passages.of(now, q, rate)
            now, size = [], 0
        now.append((r["i"], t))
        size += len(t)
    if now:
        yield Passages.of(now, q, rate)


Q, RATE = 10, 0.08
SCHEMA = "doc_id long, item_id long, edits int, similarity double, start long, end long"


def leaks_of(slim: DataFrame, block: Passages) -> DataFrame:
    """slim(doc_id, text) -> the rows of ``leaks`` for one block of passages."""
    sent = slim.sparkSession.sparkContext.broadcast(block)  # of bounded size

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = sent.value
        for part in parts:
            rows = []
            for i, text in zip(part["doc_id"].array, part["text"], strict=True):
                for k, (e, start, end) in b.matches(text).items():
                    rows.append((i, b.ids[k], e, 1 - e / len(b.texts[k]), start, end))
            frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "similarity", "start", "end"])
            whole = {c: pd.array([None if pd.isna(r[k]) else int(r[k]) for r in rows], "Int64") for k, c in enumerate(("doc_id", "item_id"))}
            yield frame.assign(**whole)  # null for documents and passages without an id

    return slim.mapInPandas(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Which documents hold which passages: (doc_id, item_id, edits, similarity, start, end), the nearest match of each pair.

    A passage is found where some piece of a document is within ``rate`` of its characters in edits. start and end are places
    in the document's normal text; of regions with equally few edits, the one whose band comes first. Texts of any length are
    searched whole, PART characters at a time with an overlap. Documents with null or empty text match nothing; rows that repeat
    a document or an item repeat their matches; an empty benchmark or table gives no rows; other columns are ignored.

    One block of passages is searched when the result is read; of more, all but the last are searched and their matches written
    at once, so memory doesn't grow with the benchmark.
    """
    # ids as text: beside nulls, pandas would make floats of them
    slim = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    path, before, last = None, 0, None
    for block in passage_blocks(benchmark, item_id_col, item_text_col, q, rate, block_chars):
        if last is not None:
            path = path or new_path(docs.sparkSession, "leaks")
            leaks_of(slim, last).write.mode("append").parquet(path)
            before += 1
        last = block
    out = leaks_of(slim, last) if last is not None else docs.sparkSession.createDataFrame([], SCHEMA)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path).unionByName(out) if before else out


def holds_passage(text: Column, block: Passages, spark: SparkSession) -> Column:
    """Whether a text holds a passage of the block."""
    sent = spark.sparkContext.broadcast(block)  # of bounded size

    @F.pandas_udf("boolean")
    def holds(s: pd.Series) -> pd.Series:
        return s.map(lambda t: bool(sent.value.matches(t))).astype(bool)

    return holds(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the documents that hold a passage; rows with null text stay, rows that repeat stay or go together, and all
    columns of any name pass through.

    One block of passages filters as the result is read; of more, what each but the last leaves is written for the next.
    """
    last = None
    for block in passage_blocks(benchmark, item_id_col, item_text_col, q, rate, block_chars):
        if last is not None:
            docs = written(docs.where(~holds_passage(F.col(text_col), last, docs.sparkSession)), "clean")
        last = block
    return docs if last is None else docs.where(~holds_passage(F.col(text_col), last, docs.sparkSession))
