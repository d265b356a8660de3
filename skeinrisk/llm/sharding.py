"""Sharding by a keyed permutation of global row numbers.

A Feistel network over the two digits of a row number (mixed radix a x b >= n, a and b near the square root of n) permutes
[0, a*b); values of n and above walk on along their cycle until they fall below n, which leaves a permutation of [0, n).
The permuted number gives shard (mod) and slot (quotient), so shard sizes differ by one row at most and a reader can compute
where any row number went. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

#: Keys of the rounds of the network; fixed values of this library.
ROUND_KEYS = (11, 29, 47, 71, 97, 113)


def radices(n: int) -> tuple[int, int]:
    """The smallest a >= sqrt(n) and b with a * b >= n."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int, keys: tuple[int, ...] = ROUND_KEYS) -> Column:
    """One pass through the network: a permutation of [0, a*b)."""
    a, b = radices(n)

    def turn(acc: Column, key: Column) -> Column:
        high = F.pmod(acc["high"] + F.pmod(F.xxhash64(acc["low"], key, F.lit(seed)), F.lit(a)), F.lit(a))
        return F.struct(high.alias("high"), acc["low"].alias("low"))

    def turn_back(acc: Column, key: Column) -> Column:
        low = F.pmod(acc["low"] + F.pmod(F.xxhash64(acc["high"], key, F.lit(~seed)), F.lit(b)), F.lit(b))
        return F.struct(acc["high"].alias("high"), low.alias("low"))

    start = F.struct(F.floor(x / b).cast("long").alias("high"), F.pmod(x, F.lit(b)).cast("long").alias("low"))
    mixed = F.aggregate(
        F.array(*[F.lit(k).cast("long") for k in keys]),
        start,
        lambda acc, key: F.transform(F.array(turn(acc, key)), lambda t: turn_back(t, key))[0],
        lambda acc: acc["high"] * F.lit(b).cast("long") + acc["low"],
    )
    return mixed


def walk(x: Column, n: int, seed: int, steps: int) -> Column:
    """Up to ``steps`` passes, ending at the first value below n."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), x, lambda acc, i: F.when((acc < n) & (i > 1), acc).otherwise(feistel(acc, n, seed))
    )


def numbered(df: DataFrame, keys: list[str], tag: str) -> tuple[DataFrame, int]:
    """Adds ``__skein_row``, the row's rank from 0 by ``keys`` (nulls first), over all rows, without one task seeing them all.

    Rows are range-partitioned with their place in the input as last key, so that a key that many rows share is split. The
    partitions are written with each row's place in them; their sizes, one row a partition, give the offsets. Rows that
    agree in all keys may swap numbers.
    """
    place = F.monotonically_increasing_id()
    ranged = df.withColumn("__skein_place", place).repartitionByRange(*[F.col(k) for k in keys], F.col("__skein_place"))
    ranged = ranged.sortWithinPartitions(*keys, "__skein_place").drop("__skein_place")
    at = F.monotonically_increasing_id()
    stored = Written(
        ranged.withColumn("__skein_part", F.shiftright(at, 33).cast("int")).withColumn("__skein_at", at.bitwiseAND((1 << 33) - 1)), tag
    ).df
    # one row for each partition of the sort: bounded by the number of partitions, not by the data
    sizes = Written(stored.groupBy("__skein_part").agg(F.count("*").alias("__skein_n")), f"{tag}-sizes").df
    total = sizes.agg(F.coalesce(F.sum("__skein_n"), F.lit(0))).first()[0]
    before = F.sum("__skein_n").over(Window.orderBy("__skein_part")) - F.col("__skein_n")
    offsets = F.broadcast(sizes.select(F.col("__skein_part"), before.alias("__skein_before")))
    return stored.join(offsets, "__skein_part").withColumn("__skein_row", F.col("__skein_before") + F.col("__skein_at")).drop("__skein_part", "__skein_at", "__skein_before"), total


def row_keys(df: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """Columns that order rows by what they hold: the id, a hash of the text, and one of all else, of whatever types."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]
    return {"__skein_id": F.col(id_col), "__skein_text": F.xxhash64(text_col), "__skein_rest": F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)}


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard_rows`` for documents with any other columns: rows are ordered by ``row_keys``, so those that still tie are equal."""
    docs = docs.drop("shard", "slot")
    keys = row_keys(docs, id_col, text_col)
    return shard_rows(docs.withColumns(keys), list(keys), shards).drop(*keys)


def shard_rows(df: DataFrame, keys: list[str], shards: int, seed: int = 20240229) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (int, 0 to shards-1) and ``slot`` (long, gapless from 0 in each shard).

    keys: columns that order the rows; the result depends on the rows and ``seed`` only, not on files or partitions, if rows
    that agree in all keys are equal. Nulls in keys sort first; equal rows each have a slot of their own; texts of any length
    are moved whole; an empty table gives an empty result; columns named ``shard`` or ``slot`` are replaced.
    """
    df = df.drop("shard", "slot")
    rows, n = numbered(df, keys, "numbered")
    if not n:
        return rows.drop("__skein_row").withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    steps = 4
    # on average 1 in sqrt(n) values walks on, so 4 passes nearly always do; the largest value tells
    while rows.agg(F.max(walk(F.col("__skein_row"), n, seed, steps))).first()[0] >= n:
        steps *= 2
    out = rows.withColumn("__skein_row", walk(F.col("__skein_row"), n, seed, steps))
    return (
        out.withColumn("shard", F.pmod(F.col("__skein_row"), F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("__skein_row") / shards).cast("long"))
        .drop("__skein_row")
    )


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``shard_rows`` over (doc_id, size, text_crc32) of every document: the rows that the query returns.

    size: UTF-8 bytes of the text (null: none) plus 16; text_crc32: of the UTF-8 text, null for null. Law: rows.
    """
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    out = shard_rows(slim, ["doc_id", "text_crc32", "size"], shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
