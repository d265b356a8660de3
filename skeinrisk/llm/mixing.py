"""Mixing sources to target weights by hash-threshold histograms.

Every row has a place on a hash line. Words are summed by source and hash bucket; the running sums tell in which bucket a
source's budget ends, only that bucket is looked into again, and so on until the threshold falls between two rows. A source
then takes the rows below its threshold: nothing is sorted, and a smaller budget always takes a subset of a larger one's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Written, small, written
from .sharding import numbered

#: Bits of the hash line, and bits that one histogram resolves.
LINE_BITS, STEP_BITS = 63, 12


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Parts into which equal rows are dealt to be numbered.
PARTS = 64


def place(*cols: Column) -> Column:
    """A place on the hash line, 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def identity(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash of all that a row holds, of whatever types; nulls count."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return F.xxhash64(F.lit("row"), F.to_json(F.struct(F.col(id_col).alias("i"), F.col(text_col).isNull().alias("t"), *[c.alias(f"c{k}") for k, c in enumerate(rest)])), F.col(text_col))


def repeated(rows: DataFrame) -> DataFrame:
    """(_mix_k): the places that several rows have, which are those that repeat an id and text, of whatever source."""
    return Written(rows.groupBy(F.col("at").alias("_mix_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_mix_k"), "mix-again").df


def told_apart(rows: DataFrame, at: str, own: str, again: DataFrame) -> DataFrame:
    """``rows``, where those that share a place get places of their own, so that they aren't all on one side of a threshold: by
    what they hold (``own``), and by a number among those that hold the same and can stand for each other. So the places depend on
    the rows only, not on their order or partitions.

    Equal rows are dealt into parts, numbered in each, and start where the parts before end; no other row is moved.
    """
    if again.isEmpty():
        return rows
    again = small(again)
    one = rows.join(again, F.col(at) == F.col("_mix_k"), "left_anti")
    many = rows.join(again, F.col(at) == F.col("_mix_k"), "left_semi").withColumn("_mix_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    many = written(many, "mix-many")
    sizes = many.groupBy(at, own, "_mix_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(at, own).orderBy("_mix_part")) - F.col("_n")  # PARTS rows at most
    starts = sizes.select(F.col(at).alias("_a"), F.col(own).alias("_o"), F.col("_mix_part").alias("_p"), before.alias("_start"))
    number = F.row_number().over(Window.partitionBy(at, own, "_mix_part").orderBy(F.lit(0))) - 1
    many = many.withColumn("_mix_n", number).join(starts, (F.col(at) == F.col("_a")) & (F.col(own) == F.col("_o")) & (F.col("_mix_part") == F.col("_p")))
    many = many.withColumn(at, place(F.col(at), F.col(own), F.col("_start") + F.col("_mix_n")))
    return one.unionByName(many.select(*rows.columns))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes(source, source_size), one row a source -> with ``target``.

    Sources by code point, null last, take ``weights`` in turn and divide ``share`` of all words by weight. A target stops at
    ``most`` times its source's size; what is over goes to the others by weight, until none is above. Only sums over the
    sources come to the driver.
    """
    ranked, _ = numbered(sizes.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "sources")
    cyclic = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__skein_row"), F.lit(len(weights))) + 1).cast("int"))
    sources = written(ranked.select("source", "source_size", cyclic.alias("_w"), (F.lit(float(most)) * F.col("source_size")).alias("_cap")), "sources")
    budget = share * float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = 0.0, -1
    while True:
        # water filling: a source is full once its part at this level reaches its cap; the level only rises
        is_full = F.col("_cap") <= F.lit(level) * F.col("_w")
        n, capped, weight = sources.agg(
            F.coalesce(F.sum(is_full.cast("int")), F.lit(0)),
            F.coalesce(F.sum(F.when(is_full, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("_w"))), F.lit(0.0)),
        ).first()
        if n == full or not weight:
            break
        full, level = n, (budget - capped) / weight
    return sources.select("source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows(source, size, at), goals(source, source_size, target) -> goals with ``whole``, ``upto`` and ``extra``.

    A row is taken ``whole`` times, and once more if its place is below ``upto``. ``upto`` is the place at which the source's
    sum of words comes nearest to what ``target`` leaves after the whole times.
    """
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goals = goals.withColumn("_left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    open_ = written(goals.withColumn("_from", F.lit(0).cast("long")), "mix-open")
    done = []
    bits = LINE_BITS
    while True:
        step = min(STEP_BITS, bits)
        bits -= step
        bucket = F.shiftright(F.col("at"), bits)
        inside = rows.alias("r").join(small(open_).alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
        if bits + step < LINE_BITS:
            inside = inside.where(F.shiftright(F.col("r.at"), bits + step) == F.shiftright(F.col("g._from"), bits + step))
        bars = inside.groupBy("r.source", bucket.alias("_b")).agg(F.sum("size").alias("_s"), F.min("at").alias("_lo"), F.max("at").alias("_hi"))
        run = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # 4,096 bars a source at most
        bars = bars.withColumn("_sum", F.sum("_s").over(run)).alias("b")
        edge = (
            bars.join(small(open_).alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
            .where((F.col("b._sum") > F.col("g._left")) & (F.col("b._sum") - F.col("b._s") <= F.col("g._left")) & (F.col("b._s") > 0))
            .select("g.*", "b._b", "b._s", "b._sum", "b._lo", "b._hi")
        )
        edge = edge.withColumn("_left", F.col("_left") - (F.col("_sum") - F.col("_s"))).withColumn("_from", F.shiftleft(F.col("_b"), bits))
        edge = written(edge, "mix-edge")
        # a bar whose rows share one place isn't split: the threshold is on the side that is nearer
        end = F.col("_lo") == F.col("_hi")
        nearer = F.when(F.col("_s") - F.col("_left") < F.col("_left"), F.col("_hi") + 1).otherwise(F.col("_lo"))
        done.append(edge.where(end).select("source", nearer.alias("upto")))
        open_ = edge.where(~end).select("source", "source_size", "target", "whole", "_left", "_from")
        if not bits or open_.isEmpty():
            break
    ends = done[0]
    for x in done[1:]:
        ends = ends.unionByName(x)
    goals, ends = goals.alias("g"), small(written(ends, "mix-ends")).alias("e")
    # no edge: nothing is left (0), or the rest takes all (no row's place is beyond the line)
    none = F.when(F.col("g._left") > 0, F.lit(2**63 - 1)).otherwise(0).cast("long")
    out = goals.join(ends, F.col("g.source").eqNullSafe(F.col("e.source")), "left")
    return written(out.select("g.source", "g.source_size", "g.target", "g.whole", F.coalesce("e.upto", none).alias("upto")), "mix-plan")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows(doc_id, source, size, at), thresholds a source, places that repeat) of a mix over all documents; one pass over the texts."""
    at, own = place(F.col(id_col), F.col(text_col)), identity(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), at.alias("at"), own.alias("own"))
    rows = written(rows, "mix-rows")
    again = repeated(rows)
    rows = told_apart(rows, "at", "own", again).drop("own")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    return rows, thresholds(rows, goals), again


def times(whole: Column, upto: Column, at: Column) -> Column:
    return whole + (at < upto).cast("int")


def mix_digest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken: the words that the mix takes of the document.

    Documents are taken whole, 0, 1 or 2 times, texts of any length. Null texts have size 0; null sources form one source; rows
    that repeat an id and text, in one source or several, each have a place of their own; an empty table gives an empty result.
    The choice depends on what the rows hold only: other columns tell rows of one id and text apart, and count for nothing else.
    """
    rows, ends, _ = plan(docs, **how)
    rows, ends = rows.alias("r"), small(ends).alias("e")
    out = rows.join(ends, F.col("r.source").eqNullSafe(F.col("e.source")))
    return out.select("r.doc_id", "r.size", "e.source_size", "e.target", (F.col("r.size") * times(F.col("e.whole"), F.col("e.upto"), F.col("r.at"))).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed rows: every document's row as many times as the mix takes it, with the columns of ``docs``.

    Texts aren't moved: each row finds its source's threshold by a join on the source and is kept, repeated or dropped where
    it is. Nulls, ties and empty tables as in ``mix_digest``; extra columns of any name pass through.
    """
    _, ends, again = plan(docs, id_col, text_col, source_col, **how)
    ends = small(ends.select(F.col("source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), F.col("upto").alias("_mix_upto")))
    placed = docs.withColumns({"_mix_at": place(F.col(id_col), F.col(text_col)), "_mix_own": identity(docs, id_col, text_col)})
    out = told_apart(placed, "_mix_at", "_mix_own", again).join(ends, F.col(source_col).eqNullSafe(F.col("_mix_source")))
    n = times(F.col("_mix_whole"), F.col("_mix_upto"), F.col("_mix_at"))
    out = out.withColumn("_mix_n", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    return out.select(*docs.columns)
