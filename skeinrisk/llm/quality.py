"""A quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled text. A text is compressed in pieces with
either; the difference of the compressed sizes over the text's size says which of the two it
is more like, and a falling curve fitted on the labels turns that into a probability. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are compressed on their own, so that what a text repeats within itself weighs little against the dictionary.
PIECE = 1024
DICTIONARY, LEVEL = 1 << 16, 3
#: The bound on training: so many labelled rows of each class, and so many pieces of each, evenly from the whole text.
TRAIN_ROWS, TRAIN_PIECES = 3000, 8
#: A text is good if its score is at least this.
CUTOFF = 0.3


def pieces(text: bytes) -> list[bytes]:
    return [text[k : k + PIECE] for k in range(0, len(text), PIECE)]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; of too few samples for that, the samples themselves."""
    try:
        d = zstandard.train_dictionary(size, samples)
    except (zstandard.ZstdError, ValueError):
        d = zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return d


@dataclass(frozen=True)
class Model:
    """Bytes of either dictionary (None: a class had no rows) and the points of the curve."""

    good: bytes | None
    bad: bytes | None
    at: tuple[float, ...] = ()
    share: tuple[float, ...] = ()
    prior: float = 0.5

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.sides = []
        if model.good and model.bad:
            for data in (model.good, model.bad):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                self.sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: bytes | None) -> float:
        """(size with the good dictionary - size with the bad one) / size; 0 for an empty text."""
        if not text:
            return 0.0
        good, bad = (c.compress for c in self.sides)
        return sum(len(good(p)) - len(bad(p)) for p in pieces(text)) / len(text)

    def score(self, text: bytes | None) -> float:
        if not self.sides:
            return self.model.prior
        return float(np.interp(self.difference(text), self.model.at, self.model.share))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """The share of good that falls with x, by isotonic regression: points of a line from block to block.

    Neighbours in x are pooled until the shares fall; a block's share is drawn a little towards the middle, by one row.
    """
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, weight, good weight, rows
    for k in order:
        blocks.append([x[k] * weight[k], weight[k], weight[k] * y[k], 1])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] <= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    at = [b[0] / b[1] for b in blocks]
    share = [(b[2] / b[1] * b[3] + 0.5) / (b[3] + 1) for b in blocks]
    return at, list(np.minimum.accumulate(share))


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, y): one row for each labelled id whose rows agree; null ids and labels are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_m")).where("y = _m").drop("_m")


def train(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, per_row: int = TRAIN_PIECES) -> Model:
    """known(doc_id, y) -> Model.

    The sample is ``rows`` of each class, those with the smallest hashes of their ids, and ``per_row`` pieces of each, spread
    over the whole text; half of the rows train the dictionaries, the other half the curve, weighted back to the classes'
    shares among all of ``known``. Of rows that repeat an id one text is taken, that with the smallest hash, so what comes to the
    driver is bounded however often ids repeat.
    """
    share = known.agg(F.coalesce(F.avg("y"), F.lit(0.5))).first()[0]
    ranked = known.withColumn("o", F.xxhash64(F.col("doc_id").cast("string")))
    picked = [ranked.where(F.col("y") == y).orderBy("o", "doc_id").limit(rows) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "_id")
    chosen = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    chosen = chosen.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))  # 2 * rows at most are sent
    # of several texts of one id, that with the smallest hash
    chosen = chosen.groupBy("_id", "o", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("o", "y", "text")

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for o, y, t in part.itertuples(index=False):
                own = pieces(bytes(t))
                keep = [own[len(own) * k // per_row] for k in range(per_row)] if len(own) > per_row else own
                out += [(o, y, n, p) for n, p in enumerate(keep)]
            yield pd.DataFrame(out, columns=["o", "y", "n", "p"])

    got = sorted((r["o"], r["n"], r["y"], bytes(r["p"])) for r in chosen.mapInPandas(spread, "o long, y int, n int, p binary").collect())
    texts: dict[int, list[bytes]] = {}
    label: dict[int, int] = {}
    for o, _, y, p in got:
        texts.setdefault(o, []).append(p)
        label[o] = y
    order = {y: [o for o in sorted(texts) if label[o] == y] for y in (0, 1)}
    if not order[0] or not order[1]:
        return Model(None, None, prior=float(share))
    halves = {y: (order[y][::2], order[y][1::2] or order[y]) for y in (0, 1)}
    good, bad = (dictionary([p for o in halves[y][0] for p in texts[o]]).as_bytes() for y in (1, 0))
    s = Scorer(Model(good, bad))
    x, y = zip(*((s.difference(b"".join(texts[o])), k) for k in (0, 1) for o in halves[k][1]), strict=True)
    x, y = np.array(x), np.array(y, float)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    at, shares = fit_curve(x, y, weight)
    return Model(good, bad, tuple(at), tuple(shares), float(share))


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    """A text's probability of being good, 0 to 1; null and empty texts get the curve's value at no difference."""
    sent = spark.sparkContext.broadcast(model)  # two dictionaries: 128 KB

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = sent.value.scorer()
        for s in batches:
            yield pd.Series([scorer.score(t) for t in s], dtype="float64")

    return run(text.cast("binary"))


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model is trained on: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    known = training_labels(labels, "doc_id", label_col)
    return train(docs, known.where(~held_out(F.col("doc_id"))), id_col, text_col)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents.

    Texts of any length are scored whole; null and empty ones get the curve's value at no difference; rows that repeat, and texts
    that compress alike, get equal scores; without labels of both kinds, all get the good share (0.5 without any); an empty table
    gives an empty result; other columns are ignored.
    """
    model = trained(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose score is below the cutoff; all columns pass through."""
    model = trained(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(score(F.col(text_col), model, docs.sparkSession) >= CUTOFF)

