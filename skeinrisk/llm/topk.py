"""Exact top-k search by columnar branch-and-bound.

Candidates lie in blocks, dimension by dimension, dealt and written once and scanned where they lie; bounded groups of queries are
sent to all tasks. One in ``WAVE`` blocks goes first and tells each query a score that its k-th best reaches at least; the tasks
that scan all others start from it and send on only what reaches it, so what they write doesn't grow with their number. For a block of queries and one of candidates, scores are summed one block of dimensions after the other; after each,
what the dimensions left can still add is bounded by the product of the two vectors' remaining norms, and candidates (and
queries) of which no pair's sum and bound reach the query's k-th score so far are compacted away. The k-th scores rise from
block to block, so later blocks lose most candidates early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, new_path

#: Vectors in a block, dimensions summed between two cuts, bytes of queries that are sent at once.
BLOCK, STEP, SENT_BYTES = 1024, 16, 32 << 20
#: One in so many blocks is scanned first.
WAVE = 32
QUANTUM = 64
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def packed(vectors: DataFrame, id_col: str, vector_col: str, quantum: int) -> DataFrame:
    """(ids, dims, narrow, data): blocks of up to BLOCK vectors, one dimension after the other; as floor(quantum * x) in int16,
    or, in blocks of their own, as x itself where a component is too wide for that.

    Vectors that are null or hold null, NaN or infinite components are left out, and rows without an id.
    """

    def block(ids: np.ndarray, x: np.ndarray, narrow: bool) -> pa.RecordBatch:
        data = np.floor(quantum * x).astype(np.int16) if narrow else x
        return pa.RecordBatch.from_pylist([{"ids": ids.tobytes(), "dims": x.shape[1], "narrow": narrow, "data": np.ascontiguousarray(data.T).tobytes()}], schema=kinds)

    kinds = pa.schema([("ids", pa.binary()), ("dims", pa.int32()), ("narrow", pa.bool_()), ("data", pa.binary())])

    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        dims = max(x.shape[1] for _, x in parts)  # a shorter vector has zeros
        return np.concatenate([i for i, _ in parts]), np.concatenate([np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for _, x in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            sizes, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            x = np.zeros((len(ids), int(sizes.max(initial=0))))
            x[np.arange(x.shape[1]) < sizes[:, None]] = values
            is_narrow = np.abs(x).max(1, initial=0) < (1 << 15) // quantum - 1
            for narrow in (True, False):
                held[narrow].append((ids[is_narrow == narrow], x[is_narrow == narrow]))
                if sum(len(i) for i, _ in held[narrow]) >= BLOCK:
                    i, v = joined(held[narrow])
                    full = len(i) // BLOCK * BLOCK
                    for at in range(0, full, BLOCK):
                        yield block(i[at : at + BLOCK], v[at : at + BLOCK], narrow)
                    held[narrow] = [(i[full:], v[full:])]
        for narrow, parts in held.items():
            if parts and len((both := joined(parts))[0]):
                yield block(*both, narrow)

    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    slim = vectors.select(F.col(id_col).cast("long").alias("i"), v.alias("v")).where(F.col("i").isNotNull() & F.col("v").isNotNull() & good)
    return slim.mapInArrow(run, "ids binary, dims int, narrow boolean, data binary")


class Block:
    """A block's vectors, one dimension after the other: ``m``, whole numbers as floats that are exact where ``most`` says so."""

    def __init__(self, ids: bytes, dims: int, narrow: bool, data: bytes, quantum: int):
        self.ids, self.quantum = np.frombuffer(ids, np.int64), quantum
        raw = np.frombuffer(data, np.int16 if narrow else np.float64).reshape(dims, len(self.ids))
        self.x = None if narrow else raw
        with np.errstate(over="ignore"):
            self.m = raw.astype(np.float64) if narrow else np.floor(quantum * raw)
            self.most = float(np.abs(self.m).max(initial=0))
            square = self.m**2
            self.tails = np.sqrt(np.r_[np.cumsum(square[::-1], 0)[::-1], np.zeros((1, len(self.ids)))])

    def whole(self) -> np.ndarray:
        """The vectors as Python's whole numbers, for sums beyond what floats hold exactly."""
        if self.x is None:
            return self.m.astype(np.int64).astype(object)
        big = lambda v: int(v) * self.quantum if abs(v) >= 2.0**53 else int(np.floor(v * self.quantum))
        return np.array([[big(v) for v in row] for row in self.x.tolist()], object).reshape(self.x.shape)


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, numbers: np.ndarray, q: Block, k: int):
        self.numbers, self.q, self.k = numbers, q, k
        self.score = np.full((len(numbers), k), _LEAST)
        self.vec = np.full((len(numbers), k), _MOST)
        self.full = np.zeros(len(numbers), np.int64)  # how many of the k are there
        self.floor = np.full(len(numbers), _LEAST)  # what the k-th best is known to reach

    def least(self) -> np.ndarray:
        """The score that a candidate must reach."""
        return np.maximum(np.where(self.full == self.k, self.score[:, -1], _LEAST), self.floor)

    def meet(self, c: Block) -> None:
        dims = min(len(self.q.m), len(c.m))
        if self.q.most * c.most * max(dims, 1) >= 2.0**53:
            rows, cols = np.arange(len(self.q.ids)), np.arange(len(c.ids))
            s = np.zeros((len(rows), len(cols)), object) + (self.q.whole()[:dims].T @ c.whole()[:dims] if dims else 0)
            s = np.clip(s, _LEAST + 1, _MOST).astype(np.int64)
        else:
            rows, cols, s = self.bounded(c, dims)
        own = self.q.ids[rows][:, None] == c.ids[cols][None, :]
        least = self.least()[rows]
        if s.shape[1] > self.k:  # no more than the block's own k best, and what ties with the last
            least = np.maximum(least, np.partition(np.where(own, _LEAST, s), s.shape[1] - self.k, 1)[:, -self.k])
        at, to = np.nonzero((s >= least[:, None]) & ~own)
        self.merge(rows[at], c.ids[cols[to]], s[at, to])

    def bounded(self, c: Block, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, candidates, scores of all their pairs) after compaction."""
        rows, cols = np.arange(len(self.q.ids)), np.arange(len(c.ids))
        least = self.least()
        least = np.where(least == _LEAST, -np.inf, least)
        s = np.zeros((len(rows), len(cols)))
        for begin in range(0, dims, STEP):
            end = min(begin + STEP, dims)
            s += self.q.m[begin:end, rows].T @ c.m[begin:end, cols]
            if end < dims:
                alive = s + self.q.tails[end][rows][:, None] * (c.tails[end][cols] * (1 + 1e-9))[None, :] + 1e-6 >= least[rows][:, None]
                r, n = alive.any(1), alive.any(0)
                if r.sum() * n.sum() < 0.8 * alive.size:
                    rows, cols, s = rows[r], cols[n], s[np.ix_(r, n)]
        return rows, cols, s.astype(np.int64)

    def merge(self, qi: np.ndarray, vec: np.ndarray, s: np.ndarray) -> None:
        touched = np.unique(qi)
        real = np.arange(self.k) < self.full[touched][:, None]
        qi = np.r_[qi, np.repeat(touched, self.full[touched])]
        vec, s = np.r_[vec, self.vec[touched][real]], np.r_[s, self.score[touched][real]]
        order = np.lexsort((vec, ~s, qi))  # ~s falls as s rises, without overflow
        qi, vec, s = qi[order], vec[order], s[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = place < self.k
        self.score[qi[keep], place[keep]], self.vec[qi[keep], place[keep]] = s[keep], vec[keep]
        self.full[touched] = np.minimum(self.k, np.searchsorted(qi, touched, "right") - np.searchsorted(qi, touched))

    def rows(self) -> pa.RecordBatch:
        real = np.arange(self.k) < self.full[:, None]
        columns = np.repeat(self.numbers, self.full), np.repeat(self.q.ids, self.full), self.vec[real], self.score[real]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["number", "query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", quantum: int = QUANTUM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all candidates with another id.

    Ties go to the smaller vec_id; fewer candidates give fewer rows. A candidate row that repeats counts each time; a query row
    that repeats counts once; query rows of one id and different vectors are queries of their own, each with ranks from 1 under
    that id. Vectors of other lengths count as if filled up with zeros. Sums are exact at any size; a score beyond a long is
    given, and ranked, as the nearest long. Empty tables give an empty result; other columns are ignored.

    Queries pass through the driver in groups of SENT_BYTES; each group goes to all tasks, which scan the candidate blocks where they
    lie. No group shuffles candidates, and the driver gets one number a query of the group.
    """
    spark = queries.sparkSession
    blocks = packed(candidates, id_col, vector_col, quantum).withColumn("first", (F.pmod(F.xxhash64("ids"), F.lit(WAVE)) == 0).cast("int"))
    c = Written(blocks.repartition(2 * spark.sparkContext.defaultParallelism, "ids"), "candidates").df
    q = Written(packed(queries.select(id_col, vector_col).dropDuplicates(), id_col, vector_col, quantum), "queries").df
    path, schema = new_path(spark, "found"), "number long, query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    n_first = c.where("first = 1").count()

    def scan(group: list[tuple[int, bytes, int, bool, bytes]], part: DataFrame, floors: list[np.ndarray] | None) -> None:
        sent = spark.sparkContext.broadcast((group, floors))  # SENT_BYTES, a block and a score a query at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = []
            for k_, (first, *row) in enumerate(sent.value[0]):
                own = Block(*row, quantum)
                best.append(Best(first + np.arange(len(own.ids)), own, k))
                if sent.value[1] is not None:
                    best[-1].floor = sent.value[1][k_]
            for b in batches:
                for row in zip(*b.columns, strict=True):
                    block = Block(*(x.as_py() for x in row), quantum)
                    for own in best:
                        own.meet(block)
            for own in best:
                yield own.rows()

        part.select("ids", "dims", "narrow", "data").mapInArrow(run, schema).write.mode("append").parquet(path)
        sent.destroy()

    def floors_of(group: list[tuple[int, bytes, int, bool, bytes]]) -> list[np.ndarray]:
        """The k-th best score so far of each of the group's queries, where there are k."""
        first, last = group[0][0], group[-1][0] + len(group[-1][1]) // 8
        known = np.full(last - first, _LEAST)
        own = spark.read.schema(schema).parquet(path).where(F.col("number").between(first, last - 1))
        place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score")))
        for r in own.withColumn("place", place).where(F.col("place") == k).select("number", "score").toLocalIterator():
            known[r["number"] - first] = r["score"]
        return [known[g[0] - first : g[0] - first + len(g[1]) // 8] for g in group]

    def search(group: list[tuple[int, bytes, int, bool, bytes]]) -> None:
        if n_first:
            scan(group, c.where("first = 1"), None)
        scan(group, c.where("first = 0"), floors_of(group) if n_first else None)

    group, first = [], 0
    for row in q.toLocalIterator():
        group.append((first, bytes(row.ids), row.dims, row.narrow, bytes(row.data)))
        first += len(row.ids) // 8
        if sum(len(x[4]) for x in group) >= SENT_BYTES:
            search(group)
            group = []
    if group:
        search(group)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(schema).parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_digest(vectors: DataFrame) -> DataFrame:
    """The contract's rows: queries are the rows whose vec_id is divisible by 20, candidates every row but the query's own."""
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
