"""Small relations that a display derives from saved sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def all_scenarios(historical: DataFrame, hypothetical: DataFrame) -> DataFrame:
    """Both kinds as one list, hypothetical first, then by result; columns that one kind lacks are null."""
    both = historical.withColumn("kind", F.lit("historical")).unionByName(hypothetical.withColumn("kind", F.lit("hypothetical")), allowMissingColumns=True)
    order = Window.partitionBy("portfolio").orderBy(F.desc("kind"), "pnl", "id")
    return both.select("portfolio", "id", "kind", "pnl", "coverage_pct", F.row_number().over(order).alias("rank"))


def ranked_shares(values: DataFrame) -> DataFrame:
    """values(fund, security, symbol, v) -> weights in percent of the fund, and ranks."""
    share = F.round(ratio(F.col("v"), F.sum("v").over(Window.partitionBy("fund"))) * 100, 4)
    out = values.withColumn("weight", share).drop("v")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("fund").orderBy(F.desc("weight"), "security")))


def sorted_table(rows: DataFrame, by: str, key: str, pinned: list[str], descending: bool = True) -> DataFrame:
    """Adds pos: pinned keys first, then by a column, nulls last. A displayed table, so one task orders it."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    w = Window.orderBy(F.when(F.col(key).isin(pinned), 0).otherwise(1), order, key)
    return rows.withColumn("pos", F.row_number().over(w))


def weight_deltas(new: DataFrame, old: DataFrame, least: float = 0.001) -> DataFrame:
    """Tickers whose weight changes by at least ``least``."""
    both = new.select("ticker", "w").join(old.select("ticker", F.col("w").alias("w0")), "ticker", "full")
    both = both.select("ticker", F.coalesce("w0", F.lit(0.0)).alias("w0"), F.coalesce("w", F.lit(0.0)).alias("w"))
    return both.withColumn("delta", F.col("w") - F.col("w0")).where(F.abs("delta") >= least)


def reference_bands(classes: DataFrame, bands: DataFrame) -> DataFrame:
    """classes(ticker, class), bands(class, map of metric to text) -> (ticker, class, metric, band)."""
    return classes.join(bands, "class", "left").select("ticker", "class", F.explode_outer("bands").alias("metric", "band"))


def loss_history(yearly: DataFrame, since: int = 1990) -> DataFrame:
    """Years from ``since`` on: VaR as negative numbers, and the year's return where it is a loss."""
    loss = F.when(F.col("annual_return_pct") < 0, F.col("annual_return_pct"))
    return yearly.where(F.col("year") >= since).select("year", (-F.col("min_var")).alias("best"), (-F.col("max_var")).alias("worst"), loss.alias("loss"))


def yield_spread(prices: DataFrame, long: str, short: str) -> DataFrame:
    """Latest long and short yield and their difference; a yield above 30 is quoted times ten."""
    last = lambda t: F.max_by(F.when(F.col("ticker") == t, F.col("px")), F.when(F.col("ticker") == t, F.col("dt")))
    plain = lambda c: F.when(F.col(c) > 30, F.col(c) / 10).otherwise(F.col(c))
    out = prices.agg(last(long).alias("a"), last(short).alias("b")).select(plain("a").alias("y10"), plain("b").alias("y3m"))
    return out.withColumn("spread", F.col("y10") - F.col("y3m"))
