"""Books of weights over the return panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Z99, ratio
from . import gram
from .risk import LAMBDA, WINDOW


def survivors(returns: DataFrame, weights: DataFrame, least: int = 252) -> DataFrame:
    """(portfolio, ticker, w, w_norm): tickers with at least ``least`` returns, weights to a sum of 1 again."""
    long_enough = returns.groupBy("ticker").agg(F.count("r").alias("_n")).where(F.col("_n") >= least)
    kept = weights.join(long_enough, "ticker", "left_semi")
    return kept.withColumn("w_norm", ratio(F.col("w"), F.sum("w").over(Window.partitionBy("portfolio"))))


def dropped(returns: DataFrame, weights: DataFrame, least: int = 252) -> DataFrame:
    """(portfolio, ticker, n_returns, reason): what ``survivors`` leaves out and why."""
    n = returns.groupBy("ticker").agg(F.count("r").alias("n_returns"))
    out = weights.select("portfolio", "ticker").join(n, "ticker", "left").withColumn("n_returns", F.coalesce("n_returns", F.lit(0)))
    return out.where(F.col("n_returns") < least).select("portfolio", "ticker", "n_returns", F.when(F.col("n_returns") == 0, "no data").otherwise("short history").alias("reason"))


def book_returns(returns: DataFrame, weights: DataFrame, least: int = 252) -> DataFrame:
    """(portfolio, dt, r): weighted return on the dates that all of the book's surviving tickers have."""
    kept = survivors(returns, weights, least)
    need = kept.groupBy("portfolio").agg(F.count("*").alias("need"))
    daily = returns.join(kept, "ticker").groupBy("portfolio", "dt").agg(F.sum(F.col("r") * F.col("w_norm")).alias("r"), F.count("*").alias("have"))
    return daily.join(need, "portfolio").where("have = need").select("portfolio", "dt", "r")


def synthetic_nav(book: DataFrame) -> DataFrame:
    run = Window.partitionBy("portfolio").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return book.select("portfolio", "dt", (100 * F.exp(F.sum("r").over(run))).alias("nav"))


def component_var(returns: DataFrame, weights: DataFrame, window: int = WINDOW, lam: float = LAMBDA) -> DataFrame:
    """(portfolio, ticker, component_var): w_i (S w)_i / s_p z, with S the EWMA covariance of the last ``window`` rows.

    S is the weighted sum of products over pairs of tickers, seeded on the sample covariance; both are sums over blocks of dates.
    """
    kept = survivors(returns, weights, 1)
    need = kept.groupBy("portfolio").agg(F.count("*").alias("need")).where("need >= 2")
    rows = gram.last_complete(returns.join(kept, "ticker").join(need, "portfolio"), window, 30)
    mean = F.avg("r").over(Window.partitionBy("portfolio", "ticker"))
    rows = rows.withColumn("plain", F.col("r") - mean).withColumn("weighted", F.col("r") * F.pow(F.lit(lam), F.col("back") / 2))
    own = rows.groupBy("portfolio", F.col("ticker").alias("a")).agg(F.max("w_norm").alias("w"), F.max("n").alias("n"))
    other = own.select("portfolio", F.col("a").alias("b"), F.col("w").alias("wb"))
    cells = gram.gram(rows, ["plain", "weighted"]).join(own, ["portfolio", "a"]).join(other, ["portfolio", "b"])
    s = (1 - lam) * F.col("weighted") + F.pow(F.lit(lam), F.col("n")) * F.col("plain") / (F.col("n") - 1)
    sums = cells.groupBy("portfolio", "a").agg(F.max("w").alias("w"), F.sum(s * F.col("wb")).alias("sw"))
    total = F.sum(F.col("w") * F.col("sw")).over(Window.partitionBy("portfolio"))
    return sums.withColumn("v", total).where("v > 0").select("portfolio", F.col("a").alias("ticker"), (F.col("w") * F.col("sw") / F.sqrt("v") * Z99 * 100).alias("component_var"))


def exposure(weights: DataFrame, base: DataFrame) -> DataFrame:
    """Per portfolio: holdings, Herfindahl index, effective number, largest weight and turnover against ``base``."""
    start = base.select("ticker", F.col("w").alias("w0"))
    both = weights.select("portfolio").distinct().crossJoin(F.broadcast(start)).join(weights.select("portfolio", "ticker", "w"), ["portfolio", "ticker"], "full")
    w, w0 = F.coalesce("w", F.lit(0.0)), F.coalesce("w0", F.lit(0.0))
    out = both.groupBy("portfolio").agg(F.count_if(w > 0).alias("n_holdings"), F.sum(w * w).alias("hhi"), F.max(w).alias("max_weight"), F.sum(F.abs(w - w0)).alias("turnover"))
    return out.withColumn("effective_n", ratio(F.lit(1.0), F.col("hhi")))


def clean_weights(weights: DataFrame, least: float = 0.005) -> DataFrame:
    """Weights below ``least`` go, the rest sum to 1 again, to 4 digits."""
    kept = weights.where(F.col("w") >= least)
    return kept.withColumn("w", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("portfolio")), 4))
