"""Joins by nearness in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, value: str, on: str = "dt", by: list[str] | None = None, block: str = "month") -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before each row's ``on``, a date or timestamp.

    Both sides go through one sort of their union, block of time by block, whatever their sizes; where a block has no value yet,
    the last one of the blocks before is carried over, from a table of one row a block. ``by``: columns that must agree.
    """
    by, columns = by or [], left.columns
    a = left.select(F.struct(*columns).alias("_row"), *by, F.col(on).alias("_at"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *by, F.col(on).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    b = b.withColumn("_block", F.date_trunc(block, "_at"))
    both = a.withColumn("_block", F.date_trunc(block, "_at")).unionByName(b)
    order = Window.partitionBy(*by, "_block").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    ends = b.where("_v IS NOT NULL").groupBy(*by, "_block").agg(F.max_by("_v", "_at").alias("_end"))
    blocks = both.select(*by, "_block").distinct().join(ends, [*by, "_block"], "left")
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_start"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    same = F.col("_block").eqNullSafe(F.col("_start"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return met.join(carried, same, "left").select("_row.*", F.coalesce("_last", "_carried").alias(value))


def nearest(points: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(label, day), a short list -> (label, day, dt): the date of ``points`` nearest to each label, the earlier at a tie."""
    pairs = points.select("dt").distinct().crossJoin(F.broadcast(labels))
    return pairs.groupBy("label", "day").agg(F.min_by("dt", F.struct(F.abs(F.date_diff("dt", "day")), "dt")).alias("dt"))
