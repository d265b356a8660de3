"""Substring deduplication over sliding sentence spans.

A text is cut into sentences; from every sentence on, the shortest run of at least ``sentences`` sentences and ``words`` words
is hashed, the hashes of all documents are met in one aggregation, and the sentences of every run that isn't the first with
its hash are removed. First is the smallest (doc_id, text, sentence) over the whole table.

Sentences are cut further where a word's hash is the least of some ``WINDOW`` words in a row (winnowing), so the cuts depend on
the words and not on where the sentence or passage began, and one comes in any ``WINDOW`` words. Of a passage of over 50 words,
from the middle of one sentence to the middle of another, at least 29 words lie between cuts that all its copies share; a run of
20 words ends within 25 of its start, so each has a whole run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, small

SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?]+|\n|$)")
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
WINDOW = 6
#: A repeated run has at least so many sentences and words.
RUN_SENTENCES, RUN_WORDS = 3, 20


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each sentence, or part of one, that has words, as bytes of the text; they cover it in order."""
    words, ends, last = [], [], []
    for m in SENTENCE.finditer(text):
        own = [(w[0], w.end()) for w in WORDS.finditer(text, m.start(), m.end())]
        if own:
            words += [w for w, _ in own]
            ends += [e for _, e in own[:-1]] + [m.end()]
            last.append(len(words) - 1)
    if not words:
        return []
    h = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words))
    h[last] = -1  # ends of sentences are cuts, and spare the windows that hold them another
    cut = np.zeros(len(h), bool)
    cut[last] = True
    if len(h) >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[:, ::-1].argmin(1)
        cut[np.arange(WINDOW - 1, len(h)) - least] = True
    out, at, start = [], 0, 0
    for k in np.flatnonzero(cut).tolist():
        out.append((at, ends[k], words[start : k + 1]))
        at, start = ends[k], k + 1
    return out


def runs(text: bytes | None, least: int, words: int) -> tuple[list[int], list[int], list[int], int]:
    """(hashes, starts, ends (exclusive)) of the runs, and the number of sentences.

    From each sentence on there is one run, as far as the text has enough. Where the last of them ends before the text does,
    one more from the same start reaches to the end, so that a copy of a whole text is covered to its end.
    """
    found = sentences(text) if text else []
    own = np.array([xxhash.xxh64_intdigest(b" ".join(s[2])) for s in found], np.uint64)
    size = [len(s[2]) for s in found]
    n, hashes, ends = len(found), [], []
    end, total = 0, 0
    for start in range(n):
        while end < n and (end - start < least or total < words):
            total += size[end]
            end += 1
        if end - start < least or total < words:
            break
        hashes.append(xxhash.xxh64_intdigest(own[start:end].tobytes()))
        ends.append(end)
        total -= size[start]
    starts = list(range(len(hashes)))
    if hashes and ends[-1] < n:
        starts.append(starts[-1])
        hashes.append(xxhash.xxh64_intdigest(own[starts[-1] : n].tobytes()))
        ends.append(n)
    return hashes, starts, ends, n


def run_table(docs: DataFrame, least: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th: hash of the text, n sentences, and arrays h, s and e: hash, start and end of each run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [runs(t.as_py(), least, words) for t in b.column(2)]
            h = pa.array([np.array(r[0], np.uint64).view(np.int64) for r in rows], pa.list_(pa.int64()))
            s, e = (pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[3] for r in rows], pa.int32()), h, s, e], ["doc_id", "th", "n", "h", "s", "e"])

    text = F.col(text_col).cast("binary")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return slim.mapInArrow(run, "doc_id long, th long, n int, h array<long>, s array<int>, e array<int>")


def repeated_spans(docs: DataFrame, sentences: int = RUN_SENTENCES, words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What goes: (doc_id, text_hash, first_sentence, end_sentence (exclusive), n_sentences of the document, first_doc_id), one row
    for each largest span of a document that repeated runs cover. text_hash: ``xxhash64`` of the text's bytes; first_doc_id: the
    smallest id of the documents that hold a first run of the span.

    A document is an id and a text: rows that repeat both are one, rows of one id and different texts are judged by their own
    text each. Of equal runs the one with the smallest (id, text_hash, sentence) is first and stays; a run that repeats within
    its own document goes too. Null and empty texts, and texts of fewer sentences or words, have no runs; rows without an id take
    no part; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
    """
    table = Written(run_table(docs, sentences, words, id_col, text_col).where(F.size("h") > 0), "runs").df
    # of copies of a whole text only the first goes on: the others are covered from end to end
    table = table.withColumn("w", F.xxhash64("h", "e")).withColumn("w0", F.element_at("h", 1)).withColumn("own", F.struct("doc_id", "th"))
    same = table.groupBy("w", "w0").agg(F.min("own").alias("first"), F.max("own").alias("last"))
    same = Written(same.where("first <> last").select("w", "w0", "first"), "copies").df
    alone = table.join(small(same), ["w", "w0"], "left").where("first IS NULL OR first = own")
    at = alone.select("doc_id", "th", "n", F.explode(F.arrays_zip("h", "s", "e")).alias("r")).select("doc_id", "th", "n", "r.h", "r.s", "r.e")
    place = F.struct("doc_id", "th", "s")
    firsts = at.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = Written(firsts.select("h", "first"), "firsts").df
    # by shuffle at every size: the repeated hashes grow with the corpus
    again = at.join(firsts.hint("merge"), "h").where(place != F.col("first")).select("doc_id", "th", "s", "e", "n", F.col("first.doc_id").alias("first_doc_id"))
    spans = Written(_merged(again), "spans").df
    # a copy's span comes from where the first copy's runs come from
    origin = spans.groupBy(F.struct("doc_id", "th").alias("first")).agg(F.min("first_doc_id").alias("origin"))
    same = Written(same.join(origin, "first", "left").select("w", "w0", "first", F.least("first.doc_id", "origin").alias("first_doc_id")), "copies").df
    copies = table.select("w", "w0", "own", "n").join(small(same), ["w", "w0"]).where("own <> first").distinct()
    copies = copies.select("own.doc_id", F.col("own.th").alias("text_hash"), F.lit(0).alias("first_sentence"), F.col("n").alias("end_sentence"), F.col("n").alias("n_sentences"), "first_doc_id")
    return spans.withColumnRenamed("th", "text_hash").unionByName(copies)


def _merged(covered: DataFrame) -> DataFrame:
    """Runs of one document that touch or overlap, as one span; they come from one text, so a document has few."""
    own = ("doc_id", "th")
    order = Window.partitionBy(*own).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = covered.withColumn("o", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int"))
    spans = opened.withColumn("g", F.sum("o").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*own, "g")
    return spans.agg(F.min("s").alias("first_sentence"), F.max("e").alias("end_sentence"), F.max("n").alias("n_sentences"), F.min("first_doc_id").alias("first_doc_id")).drop("g")


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the sentences of the spans (first, end)."""
    if text is None or not spans:
        return text
    data = text.encode()
    found = sentences(data)
    gone = {k for first, end in spans for k in range(first, end)}
    tail = data[found[-1][1] :] if found else data
    return (b"".join(data[a:b] for k, (a, b, _) in enumerate(found) if k not in gone) + tail).decode("utf-8", "ignore")


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the repeated spans cut out of the text column; all rows and columns stay, whatever their names.

    Only spans of a row's own id and text are cut from it; see ``repeated_spans``.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, **how)
    mine = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first_sentence", "end_sentence")).alias("spans"))
    cut_udf = F.udf(lambda t, x: cut(t, [(r[0], r[1]) for r in x]), "string", useArrow=True)
    column = lambda c: F.col(f"d.`{c}`")
    own = (column(id_col).cast("long") == F.col("s.doc_id")) & (F.xxhash64(column(text_col).cast("binary")) == F.col("s.text_hash"))
    none = F.array().cast("array<struct<first_sentence:int,end_sentence:int>>")
    text = F.when(F.col("s.spans").isNull(), column(text_col)).otherwise(cut_udf(column(text_col), F.coalesce("s.spans", none)))
    return docs.alias("d").join(mine.alias("s"), own, "left").select(*[text.alias(c) if c == text_col else column(c).alias(c) for c in docs.columns])
