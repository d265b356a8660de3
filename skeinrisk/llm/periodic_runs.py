"""Runs of repeating words, found in suffix trees by Stoye and Gusfield's method.

A node of depth D holds the places that share D words. A place i and the place i + D in two different children of it make a
branching tandem repeat: D words twice, which don't go on with that period. Only the leaves of the smaller side of each node are
looked at, and each asks whether the leaf D words on, or D words back, lies on the other side, so a text of n words costs
O(n log n) questions. Every other tandem repeat is a branching one rotated to the left; rotating a branching one as far as it
goes gives the run that ends there, and repeats of several periods that fill the same stretch are one run, of the least period.

The trees of many texts are built together, as suffix array and depths between neighbours; a node with several children is a row
of nodes of equal depth with two sides each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The contract's: a run has at least 6 words and 4 periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words whose trees are built together (a longer text has a turn of its own), and leaves asked at a time.
TURN_WORDS, ASK = 300_000, 2_000_000


class SuffixTrees:
    """Suffix trees of texts laid end to end: ``sa``, ``rank`` and ``depth`` (words that a suffix shares with the one before it)."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n = len(words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.doc, self.end = doc, np.repeat(np.cumsum(sizes), sizes)
        key = doc * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        first = np.r_[True, key[order][1:] != key[order][:-1]]
        head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = head
        open_ = self._shared(order, head)
        h, self.levels = 1, []
        while len(open_):  # places that share 2, 4, 8, ... words with another; their ranks get exact by twice as many
            old = self.rank[open_]
            self.levels.append((open_, old))
            on = open_ + h
            inside = on < self.end[open_]
            key = old * (n + 1) + np.where(inside, self.rank[np.where(inside, on, 0)] + 1, 0)
            order = np.argsort(key, kind="stable")
            key, old, open_ = key[order], old[order], open_[order]
            at = np.arange(len(open_))
            group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
            own = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
            self.rank[open_] = old + own - group
            open_ = self._shared(open_, own)
            h *= 2
        self.sa = np.empty(n, np.int64)
        self.sa[self.rank] = np.arange(n)
        self.depth = self._depths(n)

    @staticmethod
    def _shared(places: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The places whose head (the first of the equal ones, in order) another place has too."""
        new = np.r_[head[1:] != head[:-1], True]
        alone = new & np.r_[True, new[:-1]]
        return places[~alone]

    def _depths(self, n: int) -> np.ndarray:
        depth = np.zeros(n + 1, np.int64)
        depth[[0, n]] = -1
        level = np.full(n + 1, -1)
        for k in range(len(self.levels) - 1, -1, -1):
            places, ranks = self.levels[k]
            level[places] = ranks
            a, b = level[self.sa[:-1] + depth[1:n]], level[self.sa[1:] + depth[1:n]]
            depth[1:n] += ((a == b) & (a >= 0)).astype(np.int64) << k
            level[places] = -1
        return depth

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) of the node between suffixes x - 1 and x: suffixes lo to x - 1 are its one side, x to hi - 1 its other."""
        d, n = self.depth, len(self.sa)
        lo, hi = np.arange(-1, n), np.arange(1, n + 2)
        inner = np.flatnonzero(d > 0)  # roots have no repeats
        x = inner
        while len(x := x[d[lo[x]] > d[x]]):
            lo[x] = lo[lo[x]]
        x = inner
        while len(x := x[d[hi[x]] >= d[x]]):
            hi[x] = hi[hi[x]]
        return lo, hi

    def branching(self, periods: int) -> tuple[np.ndarray, np.ndarray]:
        """(ends, periods) of the branching tandem repeats whose period fits its text ``periods`` times."""
        n = len(self.sa)
        if n < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.bincount(self.doc)
        lo, hi = self.sides()
        x = np.arange(1, n)
        x = x[(self.depth[x] > 0) & (self.depth[x] * periods <= sizes[self.doc[self.sa[x]]])]
        left = x - lo[x] <= hi[x] - x
        begin, many = np.where(left, lo[x], x), np.where(left, x - lo[x], hi[x] - x)
        other, beyond = np.where(left, x, lo[x]), np.where(left, hi[x], x)
        total, ends, found = np.cumsum(many), [], []
        cuts = np.searchsorted(total, np.arange(ASK, total[-1] + ASK, ASK), "right") if len(x) else []
        at = 0
        for cut in np.unique(np.r_[cuts, len(x)]).astype(int):
            cut = min(max(cut, at + 1), len(x))
            own = slice(at, cut)
            size = many[own]
            leaf = np.repeat(begin[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
            d = np.repeat(self.depth[x[own]], size)
            i, a, b = self.sa[leaf], np.repeat(other[own], size), np.repeat(beyond[own], size)
            for start, mate in ((i, i + d), (i - d, i - d)):
                ok = (mate >= 0) & (mate < n)
                r = self.rank[np.where(ok, mate, 0)]
                ok &= (r >= a) & (r < b)
                ends.append(start[ok] + 2 * d[ok])
                found.append(d[ok])
            at = cut
            if at >= len(x):
                break
        return (np.concatenate(ends), np.concatenate(found)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _start(w: np.ndarray, first: int, end: int, q: int) -> int:
    """How far left the run of period q that ends at ``end`` reaches, not beyond ``first``."""
    to, step = end - 2 * q, 16
    while to > first:
        a = max(first, to - step)
        wrong = np.flatnonzero(w[a:to] != w[a + q : to + q])
        if len(wrong):
            return a + int(wrong[-1]) + 1
        to, step = a, step * 4
    return first


def maximal_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of the runs of texts of ``sizes`` words laid end to end, by text, start and period."""
    if not len(words):
        return []
    tree = SuffixTrees(words, sizes)
    end, q = tree.branching(periods)
    if not len(end):
        return []
    first = np.r_[0, np.cumsum(sizes)]
    need = np.maximum(least, periods * q)
    lowest = first[tree.doc[end - 1]]
    fits = end - need >= lowest
    end, q, need = end[fits], q[fits], need[fits]
    # a look at two places spares most of the rest
    fits = (words[end - need] == words[end - need + q]) & (words[end - need // 2 - q] == words[end - need // 2])
    end, q = end[fits], q[fits]
    runs, last, order = [], -1, np.lexsort((q, end))
    known: list[tuple[int, int]] = []  # (period, length) of the runs that end here
    for e, p in zip(end[order].tolist(), q[order].tolist(), strict=True):
        if e != last:
            last, known = e, []
        if any(p % a == 0 and 2 * p <= length for a, length in known):
            continue
        doc = int(tree.doc[e - 1])
        start = _start(words, int(first[doc]), e, p)
        known.append((p, e - start))
        if e - start >= max(least, periods * p):
            runs.append((doc, start - int(first[doc]), e - start, p))
    return sorted(runs)


Rewrite = Callable[[int | None, np.ndarray], np.ndarray]


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs: array of (start, length, period) by start and period, collapsed: the words left, joined by spaces).

    One row for each row of ``docs``, rows that repeat too; nothing is shuffled. Words are what the six ASCII spaces part. A run is
    a stretch of ``least`` words and ``periods`` periods at least that can't be made longer; of each, all words after the first
    period go. Null and empty texts have no words and an empty ``collapsed``; texts of any length are taken whole, each in one
    task; an empty table gives an empty result; other columns are ignored. ``rewrite(doc_id, word numbers)``, if given, changes a
    text's words first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: list[tuple[int | None, list[bytes]]] = []
        held = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (t.as_py() or b"").split()
                if held and held + len(words) > TURN_WORDS:
                    yield answer(turn)
                    turn, held = [], 0
                turn.append((i, words))
                held += len(words)
        if turn:
            yield answer(turn)

    def answer(turn: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        texts = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for _, words in turn]
        if rewrite is not None:
            texts = [rewrite(i, t) for (i, _), t in zip(turn, texts, strict=True)]
        spelt = list(known)
        runs: list[list[dict]] = [[] for _ in turn]
        keeps: dict[int, np.ndarray] = {}
        for doc, start, length, period in maximal_runs(np.concatenate(texts), np.array([len(t) for t in texts]), least, periods):
            runs[doc].append({"start": start, "length": length, "period": period})
            keep = keeps.setdefault(doc, np.ones(len(texts[doc]), bool))
            keep[start + period : start + length] = False
        left = [b" ".join([spelt[w] for w in (t[keeps[k]] if k in keeps else t).tolist()]) for k, t in enumerate(texts)]
        columns = [pa.array([i for i, _ in turn], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind), pa.array(left, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = slim.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The contract's rewriting: in a tenth of the texts, by their ids, the words from some place on repeat."""
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    return np.r_[words[:a], words[a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]]


def runs_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows. A row without an id keeps its words as they are."""
    found = collapse_runs(docs, rewrite=planted)
    # greatest length, then smallest start, then smallest period
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("b.length * 1000 div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
