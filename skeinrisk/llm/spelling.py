"""Spelling variants: words at an edit distance of one, found by meeting each word's Levenshtein automaton with tries of all words.

The vocabulary, in code-point order, is cut into ranges; each becomes a compact trie (edges hold strings), made in a task. Tries go
to all tasks in groups of bounded size, and words stay where they are: for each word and trie the automaton that accepts what is one
edit away walks the trie depth-first, so branches that no edit can reach are never entered. A task sends on one row a word: how many
neighbours it met and the best of them; the ranges share no word, so these rows add up.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, new_path, small

#: Characters of a trie's words, and bytes of tries that go to the tasks at once (and one trie more).
TRIE_CHARS, SENT_BYTES = 4 << 20, 48 << 20
#: Distinct words that a task counts before it sends their counts on.
COUNTED = 200_000
#: The contract's: words of 5 code points and 3 occurrences; a form is twice as frequent.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Runs of letters, once A-Z are lower-cased.
LETTERS = re.compile("[a-z\u00c0-\u00ff]+")

Spelt = Callable[[int | None], Callable[[str], str]]


def word_counts(docs: DataFrame, spelt: Spelt | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of ``least_length`` code points and ``least_count`` occurrences in all texts.

    ``spelt(doc_id)``, if given, gives a function that tells how a run of letters of that row is to be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = LETTERS.findall((t.as_py() or b"").lower().decode("utf-8", "replace"))  # bytes: A-Z only
                if spelt is None:
                    counts.update(own)
                    continue
                read = spelt(i)
                for w, n in Counter(own).items():
                    w = read(w)
                    counts[w] = counts.get(w, 0) + n
                if len(counts) >= COUNTED:
                    yield batch(counts)
                    counts.clear()
        if counts:
            yield batch(counts)

    def batch(counts: Counter[str]) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if len(w) >= least_length]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A compact trie of sorted words. A node's children stand side by side: ``heads`` holds the first character of each node's
    edge, ``kids`` where its children begin, ``edges`` where its edge's string begins in ``text``; ``ends`` is the number of the
    word that ends at it, or -1."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, array("q", counts)
        heads, texts, self.ends, self.kids, self.edges = [""], [], array("i"), array("i"), array("i", [0, 0])
        size, todo = 0, [(0, len(words), 0)]
        for lo, hi, depth in todo:  # grows as it goes: breadth first
            self.kids.append(len(heads))
            own = lo < hi and len(words[lo]) == depth
            self.ends.append(lo if own else -1)
            lo += own
            while lo < hi:
                c, to = words[lo][depth], lo + 1
                while to < hi and words[to][depth] == c:
                    to += 1
                a, b = words[lo], words[to - 1]
                reach = depth + 1
                while reach < min(len(a), len(b)) and a[reach] == b[reach]:
                    reach += 1
                heads.append(c)
                texts.append(a[depth:reach])
                size += reach - depth
                self.edges.append(size)
                todo.append((lo, to, reach))
                lo = to
        self.kids.append(len(heads))
        self.heads, self.text = "\0" + "".join(heads[1:]), "".join(texts)

    def child(self, node: int, c: str) -> int:
        return self.heads.find(c, self.kids[node], self.kids[node + 1])

    def rest(self, node: int, at: int, word: str, i: int) -> int:
        """Where exact reading of ``word[i:]`` ends, from ``at`` on the edge into ``node``: the number of a word, or -1."""
        heads, kids, edges, text, n = self.heads, self.kids, self.edges, self.text, len(word)
        while True:
            size = edges[node + 1] - at
            if i + size > n or (size and text[at : at + size] != word[i : i + size]):
                return -1
            i += size
            if i == n:
                return self.ends[node]
            node = heads.find(word[i], kids[node], kids[node + 1])
            if node < 0:
                return -1
            at = edges[node]

    def near(self, word: str) -> set[int]:
        """Numbers of the words that differ from ``word`` by one inserted, deleted or replaced character.

        The automaton's states before the edit are walked along the one path that spells ``word``; at each place on it all
        edits are tried, and the state after an edit reads the rest exactly.
        """
        heads, kids, edges, text, n = self.heads, self.kids, self.edges, self.text, len(word)
        found = set()
        node, at = 0, 0  # read so far: up to ``at`` on the edge into ``node``
        for i in range(n + 1):
            if i < n and (i == 0 or word[i] != word[i - 1]):  # of equal characters in a row, one is deleted
                found.add(self.rest(node, at, word, i + 1))
            inner = at < edges[node + 1]
            for kid in (node,) if inner else range(kids[node], kids[node + 1]):
                to = at if inner else edges[kid]
                c, on = text[to], text[to + 1] if to + 1 < edges[kid + 1] else ""
                # an insertion after an equal character is the same word; where the edge goes on, its next character decides most
                if (i == 0 or c != word[i - 1]) and (not on or on == word[i : i + 1]):
                    found.add(self.rest(kid, to + 1, word, i))
                if i < n and c != word[i] and (not on or on == word[i + 1 : i + 2]):
                    found.add(self.rest(kid, to + 1, word, i + 1))
            if i == n:
                break
            if inner:
                if text[at] != word[i]:
                    break
                at += 1
            else:
                node = heads.find(word[i], kids[node], kids[node + 1])
                if node < 0:
                    break
                at = edges[node] + 1
        found.discard(-1)
        return found


def tries(vocabulary: DataFrame, chars: int = TRIE_CHARS) -> DataFrame:
    """(trie binary): pickled tries over sorted ranges of the vocabulary of about ``chars`` characters (one word at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0
        shard = lambda: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Trie(words, counts))], pa.binary())], ["trie"])
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.append(w)
                counts.append(n)
                held += len(w)
                if held >= chars:
                    yield shard()
                    words, counts, held = [], [], 0
        if words:
            yield shard()

    return vocabulary.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, "trie binary")


def neighbours(vocabulary: DataFrame, times: int = TIMES, chars: int = TRIE_CHARS, sent: int = SENT_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n): how many words of the vocabulary are one edit away, and the most frequent of them (ties: the
    smallest in code-point order) if it is ``times`` as frequent as the word, else null."""
    spark = vocabulary.sparkSession
    path, schema = new_path(spark, "near"), "word string, near long, best_n long, best string"
    spark.createDataFrame([], schema).write.parquet(path)
    words = Written(vocabulary.select("word", "n").repartition(2 * spark.sparkContext.defaultParallelism, "word"), "words").df

    def meet(group: list[bytes]) -> None:
        shards = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [pickle.loads(x) for x in shards.value]
            for b in batches:
                rows = []
                for w in b.column(0).to_pylist():
                    near, best = 0, (0, "")
                    for t in own:
                        hits = t.near(w)
                        near += len(hits)
                        for k in hits:
                            n = t.counts[k]
                            if n > best[0] or (n == best[0] and t.words[k] < best[1]):
                                best = n, t.words[k]
                    if near:
                        rows.append((w, near, *best))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "near", "best_n", "best"])

        words.mapInArrow(run, schema).write.mode("append").parquet(path)
        shards.destroy()

    group = []
    for row in Written(tries(words, chars), "tries").df.toLocalIterator():
        group.append(bytes(row["trie"]))
        if sum(map(len, group)) >= sent:
            meet(group)
            group = []
    if group:
        meet(group)
    found = spark.read.schema(schema).parquet(path)
    # of equal counts the smaller word: the least of (-n, word), as strings compare by code point
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"))
    out = words.join(found, "word", "left").withColumn("ok", F.coalesce(-F.col("b.m") >= times * F.col("n"), F.lit(False)))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("b.w")).alias("form"), F.when(F.col("ok"), -F.col("b.m")).alias("form_n"))


def variants(docs: DataFrame, spelt: Spelt | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word of all texts: ``form`` its more usual spelling, ``root`` where forms end.

    Words are runs of Latin letters, lower-cased in A-Z. Null and empty texts have none; rows that repeat are counted each time;
    texts and words of any length are taken whole; an empty table gives an empty result; other columns are ignored.
    """
    found = Written(neighbours(word_counts(docs, spelt, least_length, least_count, id_col, text_col), times, **how), "forms").df
    # forms at least double the count from step to step, so chains are short; jumps double, so rounds are few
    now = Written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots").df
    while True:
        jump = small(now.select(F.col("word").alias("root"), F.col("root").alias("_next")))
        ahead = Written(now.join(jump, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots").df
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            break
    return found.join(small(now), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(doc_id: int | None) -> Callable[[str], str]:
    """The contract's spelling: in one of 97 words of a document, by id and word, a character is missing. No id reads as empty."""
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def read(word: str) -> str:
        h = zlib.crc32(word.encode(), begun)
        if h % 97:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    return read


def spelling_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return variants(docs, misspelt)
