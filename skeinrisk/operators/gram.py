"""Sums of products over dates for all pairs of tickers, by blocks of dates.

A task turns a block's rows into a dense matrix of dates and tickers and multiplies it with itself; only its result, a row of sums a
ticker, leaves the task. So what is shuffled is the panel once, and tickers x tickers x blocks sums, not pairs x dates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import spread

#: Days of the calendar in a block.
BLOCK_DAYS = 512


def gram(rows: DataFrame, values: list[str], key: str = "portfolio") -> DataFrame:
    """rows(key, dt, ticker, values) -> (key, a, b, and for each value the sum over dates of its products): all pairs of tickers.

    A date that lacks one of a pair counts as zero for it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tickers, at = np.unique(pdf["ticker"].to_numpy(str), return_inverse=True)
        days, day = np.unique(pdf["dt"].to_numpy("datetime64[D]"), return_inverse=True)
        out = {key: pdf[key].iloc[0], "a": tickers, "b": [tickers.tolist()] * len(tickers)}
        for v in values:
            dense = np.zeros((len(days), len(tickers)))
            dense[day, at] = pdf[v].to_numpy(float)
            out[v] = list(dense.T @ dense)
        return pd.DataFrame(out)

    blocked = rows.select(key, "dt", "ticker", *values).withColumn("_block", F.floor(F.unix_date("dt") / BLOCK_DAYS))
    schema = f"{key} string, a string, b array<string>, " + ", ".join(f"{v} array<double>" for v in values)
    parts = spread(blocked, key, "_block").groupBy(key, "_block").applyInPandas(run, schema)
    cells = parts.select(key, "a", F.inline(F.arrays_zip("b", *values)))
    return cells.groupBy(key, "a", "b").agg(*[F.sum(v).alias(v) for v in values])


def last_complete(rows: DataFrame, window: int, least: int, key: str = "portfolio") -> DataFrame:
    """rows(key, dt, ticker, r, need: the key's tickers) -> the last ``window`` dates that all of them have, with ``back`` (0: the
    newest) and ``n``, of keys with ``least`` such dates."""
    rows = rows.withColumn("_have", F.count("*").over(Window.partitionBy(key, "dt"))).where("_have = need").drop("_have")
    newest = Window.partitionBy(key, "ticker").orderBy(F.desc("dt"))
    rows = rows.withColumn("back", F.row_number().over(newest) - 1).where(F.col("back") < window)
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(key, "ticker"))).where(F.col("n") >= least)


def shrunk(rows: DataFrame, key: str = "portfolio") -> DataFrame:
    """rows(key, dt, ticker, r), every date whole -> (key, a, b, cov, shrinkage): the annual covariance, shrunk towards the mean variance
    by the optimal amount (Ledoit and Wolf, 2004)."""
    mean = F.avg("r").over(Window.partitionBy(key, "ticker"))
    rows = rows.withColumn("_c", F.col("r") - mean).withColumn("_cc", F.col("_c") * F.col("_c"))
    n = rows.groupBy(key).agg(F.count_distinct("dt").alias("_n"))
    cells = gram(rows, ["_c", "_cc"], key).join(n, key).withColumn("_s", F.col("_c") / F.col("_n"))
    same = F.col("a") == F.col("b")
    # of each key: tickers k, mean variance, squares of the cells, and the mean error of the cells
    sums = cells.groupBy(key).agg(
        F.count_if(same).alias("_k"), F.sum(F.when(same, F.col("_s"))).alias("_trace"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"),
        (F.sum(F.col("_cc") / F.col("_n") - F.col("_s") * F.col("_s")) / F.max("_n")).alias("_b2"),
    )
    mu = F.col("_trace") / F.col("_k")
    spread_ = F.col("_ss") - mu * F.col("_trace")  # squares of the difference from mu times the identity
    amount = F.when(spread_ > 0, F.least(F.col("_b2") / spread_, F.lit(1.0))).otherwise(0.0)
    out = cells.join(sums.select(key, mu.alias("_mu"), amount.alias("shrinkage")), key)
    cov = (1 - F.col("shrinkage")) * F.col("_s") + F.when(same, F.col("shrinkage") * F.col("_mu")).otherwise(0.0)
    return out.select(key, "a", "b", (252 * cov).alias("cov"), "shrinkage")
