"""Out-of-sample tests of one-day VaR forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Z99, cap, ratio
from .models import rolling_forecasts
from .risk import LAMBDA, P, WINDOW, ewma_series


def _last(series: DataFrame, lookback: int, key: str) -> DataFrame:
    """The rows that forecasts are made for: all but the first ``lookback + 1``, if there are 30 of them."""
    w = Window.partitionBy(key)
    rows = series.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("dt")) - 1)
    return rows.withColumn("n_eval", F.col("n") - lookback - 1).where("n_eval >= 30")


def historical_forecasts(series: DataFrame, lookback: int = WINDOW, p: float = P, key: str = "portfolio") -> DataFrame:
    """(key, dt, r, var): the loss of rank floor(n p) among the ``lookback`` rows before each row, by chunks of rows."""
    return rolling_forecasts(series, "hs", lookback, key=key, p=p)


def ewma_forecasts(series: DataFrame, lookback: int = WINDOW, lam: float = LAMBDA, key: str = "portfolio") -> DataFrame:
    """(key, dt, r, var): EWMA forecasts; what a window's seed weighs after ``lookback`` rows is below 1e-26."""
    rows = ewma_series(_last(series, lookback, key).drop("n", "i"), 30, lam, key).where(F.col("i") >= lookback + 1)
    return rows.select(key, "dt", "r", cap(F.sqrt("v") * Z99 * 100).alias("var"))


def violations(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("v", (-F.col("r") * 100 > F.col("var")).cast("int"))


def counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, violations and the four transitions between one row and the next."""
    order = Window.partitionBy(*keys).orderBy("dt")
    rows = hits.withColumn("u", F.lag("v").over(order))
    pair = lambda a, b: F.count_if((F.col("u") == a) & (F.col("v") == b))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("x"), pair(0, 0).alias("n00"), pair(0, 1).alias("n01"), pair(1, 0).alias("n10"), pair(1, 1).alias("n11"))


def kupiec(n: Column, x: Column, p: float = P) -> Column:
    """Likelihood ratio of unconditional coverage; null without rows."""
    q = ratio(x, n)
    mixed = -2 * ((n - x) * F.ln((1 - p) / (1 - q)) + x * F.ln(F.lit(p) / q))
    return F.when(n == 0, None).when(x == 0, -2 * n * math.log(1 - p)).when(x == n, -2 * n * math.log(p)).otherwise(mixed)


def christoffersen(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Likelihood ratio of independence; null where a state is never left."""
    least = lambda c: F.greatest(c, F.lit(1e-12))
    p01, p11, q = ratio(n01, n00 + n01), ratio(n11, n10 + n11), ratio(n01 + n11, n00 + n01 + n10 + n11)
    one = (n00 + n10) * F.ln(least(1 - q)) + (n01 + n11) * F.ln(least(q))
    two = n00 * F.ln(least(1 - p01)) + n01 * F.ln(least(p01)) + n10 * F.ln(least(1 - p11)) + n11 * F.ln(least(p11))
    return F.when((n00 + n01 > 0) & (n10 + n11 > 0), -2 * (one - two))


#: 95 % quantile of chi-squared with one degree of freedom: a statistic beyond it rejects at 5 %.
CHI2_95 = 3.841458820694124


def verdict(rate: Column, uc: Column, ind: Column, p: float = P) -> Column:
    return F.when((uc > CHI2_95) & (rate > p), "UNDER-EST").when((uc > CHI2_95) & (rate < p), "OVER-CONSERV").when(ind > CHI2_95, "CLUSTERED").otherwise("CALIBRATED")


def record(hits: DataFrame, keys: list[str], p: float = P) -> DataFrame:
    """The backtest's row for each key: counts, rates, both statistics and the verdict."""
    c = counts(hits, keys)
    c = c.withColumn("rate", F.col("x") / F.col("n")).withColumn("kupiec_stat", kupiec(F.col("n"), F.col("x"), p)).withColumn("christoffersen_stat", christoffersen(*map(F.col, ("n00", "n01", "n10", "n11"))))
    return c.select(*keys, F.col("n").alias("n_eval"), F.col("x").alias("exceptions"), (F.col("n") * p).alias("expected"), (F.col("rate") * 100).alias("rate_pct"), "kupiec_stat", "christoffersen_stat", verdict(F.col("rate"), F.col("kupiec_stat"), F.col("christoffersen_stat"), p).alias("verdict"))


def exception_calendar(hits: DataFrame, days: int = 252) -> DataFrame:
    """(portfolio, dt, week, dow, models): which models a day's loss exceeded, over the last ``days`` days; week from the first Monday."""
    daily = hits.groupBy("portfolio", "dt").agg(F.array_sort(F.collect_list(F.when(F.col("v") == 1, F.col("model")))).alias("m"))
    newest = Window.partitionBy("portfolio").orderBy(F.desc("dt"))
    daily = daily.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= days)
    start = F.date_trunc("week", F.min("dt").over(Window.partitionBy("portfolio"))).cast("date")
    return daily.select("portfolio", "dt", F.floor(F.date_diff("dt", start) / 7).cast("int").alias("week"), (F.weekday("dt") + 1).alias("dow"), F.concat_ws(",", "m").alias("models"))


def with_cached(backtests: DataFrame, stored: DataFrame) -> DataFrame:
    """Backtests of books with the stored ones of slow models, for the books that have some; a stored row that was made again
    since is left out."""
    keys = ["portfolio", "model"]
    books = backtests.select("portfolio").distinct()
    kept = stored.join(books, "portfolio", "left_semi").join(backtests.select(*keys), keys, "left_anti")
    return backtests.unionByName(kept.select(*backtests.columns))
