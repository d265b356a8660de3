"""Connected components of a table of links, without any group of links coming to one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def _round(e: DataFrame) -> DataFrame:
    """A large-star step, then a small-star step, over links a > b."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    hooked = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b), two longs each -> (node, component): every linked node but the smallest of its component, which is ``component``.

    Large-star and small-star steps in turn (Kiveris et al., 2014) shrink the links to one star a component in a number of
    rounds that grows as the logarithm of the largest one's size. Links of a node to itself and nulls are left out.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = Written(links, "links"), None
    seen = None
    while True:
        state = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen, before = state, now
        now = Written(_round(before.df), "links")
        before.discard()
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
