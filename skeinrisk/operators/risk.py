"""Value-at-Risk and Expected Shortfall by window functions: historical, EWMA, tail index, trends, exceptions.

Returns come as (key, dt, r) with one series a key. A key's series is ordered within its own partition and all keys run side by
side; EWMA recursions are weighted sums, so nothing loops over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PHI99, Z99, cap, ratio
from ..sources.panel import tail, weekdays

LAMBDA, P, WINDOW, WARMUP = 0.94, 0.01, 1000, 252
#: Rows of an EWMA series that one prefix sum covers; beyond, the weights of what came before are below 1e-100.
BLOCK = 4096


def indexed(returns: DataFrame, key: str) -> DataFrame:
    """Adds i, the row's number from 0, and n, the rows of its key."""
    w = Window.partitionBy(key)
    return returns.withColumn("i", F.row_number().over(w.orderBy("dt")) - 1).withColumn("n", F.count("*").over(w))


def var_es_hs(returns: DataFrame, window: int = WINDOW, p: float = P, key: str = "ticker") -> DataFrame:
    """Historical simulation over the last ``window`` rows: the loss of rank floor(n p) from the worst, and the mean up to it."""
    recent = tail(returns, window, key)
    worst = Window.partitionBy(key).orderBy("r")
    ranked = recent.withColumn("k", F.row_number().over(worst)).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    at = F.floor(F.col("n") * p) + 1
    return ranked.groupBy(key).agg(cap(-F.max(F.when(F.col("k") == at, F.col("r"))) * 100).alias("var_hs"), cap(-F.avg(F.when(F.col("k") <= at, F.col("r"))) * 100).alias("es_hs"))


def ewma_variance(returns: DataFrame, window: int = WINDOW, lam: float = LAMBDA, key: str = "ticker") -> DataFrame:
    """(key, v): the EWMA variance after the last row of the window, seeded on its first 30 rows (fewer: the first row)."""
    rows = indexed(tail(returns, window, key), key)
    seed = F.when(F.max("n") >= 30, F.var_pop(F.when(F.col("i") < 30, F.col("r")))).otherwise(F.max(F.when(F.col("i") == 0, F.col("r") * F.col("r"))))
    weighted = F.sum(F.pow(F.lit(lam), F.col("n") - 1 - F.col("i")) * F.col("r") * F.col("r"))
    return rows.groupBy(key).agg(((1 - lam) * weighted + F.pow(F.lit(lam), F.max("n")) * seed).alias("v"))


def var_es_ewma(returns: DataFrame, window: int = WINDOW, lam: float = LAMBDA, key: str = "ticker") -> DataFrame:
    v = ewma_variance(returns, window, lam, key)
    return v.select(key, cap(F.sqrt("v") * Z99 * 100).alias("var_ewma"), cap(F.sqrt("v") * (PHI99 / P) * 100).alias("es_ewma"))


def ewma_series(returns: DataFrame, warmup: int = WARMUP, lam: float = LAMBDA, key: str = "ticker") -> DataFrame:
    """Adds i, n, ``v`` (variance forecast for the row, made before it) and ``v_next`` (after it); seeded on the first rows.

    A prefix sum of r**2 * lam**-(k+1) within blocks of BLOCK rows, times lam**k; a block starts from the sum of the one before.
    """
    rows = indexed(returns, key)
    w = Window.partitionBy(key)
    rows = rows.withColumn("seed", F.var_pop(F.when((F.col("i") < warmup) | (F.col("n") < warmup), F.col("r"))).over(w))
    rows = rows.withColumn("b", F.floor(F.col("i") / BLOCK)).withColumn("k", F.col("i") % BLOCK)
    rows = rows.withColumn("x", (1 - lam) * F.col("r") * F.col("r") * F.pow(F.lit(1 / lam), F.col("k") + 1))
    in_block = Window.partitionBy(key, "b").orderBy("i")
    rows = rows.withColumn("s", F.sum("x").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    # variance after each block's last row, carried to the next one's rows
    rows = rows.withColumn("last", F.when(F.col("k") == BLOCK - 1, F.col("s") * F.pow(F.lit(lam), F.lit(BLOCK))))
    carry = F.last("last", ignorenulls=True).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(carry, F.col("seed")))
    after = F.pow(F.lit(lam), F.col("k") + 1) * (F.col("start") + F.col("s"))
    before = F.pow(F.lit(lam), F.col("k")) * (F.col("start") + F.col("s") - F.col("x"))
    return rows.withColumn("v", before).withColumn("v_next", after).drop("seed", "b", "k", "x", "s", "last", "start")


def var_series(returns: DataFrame, warmup: int = WARMUP, key: str = "ticker") -> DataFrame:
    """(key, dt, r, var): one-step EWMA VaR forecasts from row ``warmup`` on."""
    rows = ewma_series(returns, warmup, key=key).where(F.col("i") >= warmup)
    return rows.select(key, "dt", "r", (F.sqrt("v") * Z99 * 100).alias("var"))


def trajectory(book: DataFrame, warmup: int = 252, every: int = 5, key: str = "portfolio") -> DataFrame:
    """(key, dt, var): EWMA VaR of a book every ``every`` rows from row ``warmup`` on."""
    rows = ewma_series(book, key=key)
    kept = rows.where((F.col("i") >= warmup) & ((F.col("i") - warmup) % every == 0))
    return kept.select(key, "dt", (F.sqrt("v") * Z99 * 100).alias("var"))


def risk_level(returns: DataFrame, history: int = 504, window: int = WINDOW, key: str = "ticker") -> DataFrame:
    """The share of the last ``history`` EWMA variances that don't exceed the latest; 0.5 on a shorter series."""
    rows = ewma_series(returns, 30, key=key)
    latest = F.max_by("v_next", "i").over(Window.partitionBy(key))
    recent = rows.withColumn("now", latest).where(F.col("i") >= F.col("n") - history)
    level = F.when(F.max("n") >= window + history, F.avg((F.col("v_next") <= F.col("now")).cast("double"))).otherwise(0.5)
    return recent.groupBy(key).agg(level.alias("risk_level"))


def hill_tail_index(returns: DataFrame, window: int = WINDOW, key: str = "ticker") -> DataFrame:
    """k / sum of ln(L_i / L_k) over the k = max(10, floor(sqrt n)) largest losses."""
    largest = Window.partitionBy(key).orderBy("r")
    rows = tail(returns, window, key).withColumn("j", F.row_number().over(largest)).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    rows = rows.withColumn("k", F.least(F.greatest(F.lit(10), F.floor(F.sqrt("n"))), F.col("n") - 1))
    at = F.max(F.when(F.col("j") == F.col("k") + 1, -F.col("r"))).over(Window.partitionBy(key))
    rows = rows.withColumn("at", at).where((F.col("j") <= F.col("k")) & (F.col("at") > 0))
    return rows.groupBy(key).agg(ratio(F.max("k"), F.sum(F.ln(-F.col("r") / F.col("at")))).alias("tail_index"))


def monthly_downside(returns: DataFrame, rows: int = 21, least: int = 771, key: str = "ticker") -> DataFrame:
    """5th percentile and worst of the compounded returns of ``rows`` weekdays; only for keys of at least ``least`` weekdays."""
    frame = Window.partitionBy(key).orderBy("dt").rowsBetween(1 - rows, 0)
    days = weekdays(returns).withColumn("n", F.count("*").over(Window.partitionBy(key))).withColumn("m", F.when(F.count("r").over(frame) == rows, F.exp(F.sum("r").over(frame)) - 1))
    return days.where(F.col("n") >= least).groupBy(key).agg((F.percentile("m", 0.05) * 100).alias("monthly_p5"), (F.min("m") * 100).alias("monthly_worst"))


def var_trend(series: DataFrame, rows: int = 5, key: str = "ticker") -> DataFrame:
    """up, down or flat: the latest VaR against that ``rows`` rows before, by 5 %."""
    back = F.lag("var", rows).over(Window.partitionBy(key).orderBy("dt"))
    last = series.withColumn("past", back).groupBy(key).agg(F.max_by("var", "dt").alias("now"), F.max_by("past", "dt").alias("past"))
    change = ratio(F.col("now") - F.col("past"), F.nullif(F.col("past"), F.lit(0.0)))
    return last.select(key, F.when(change > 0.05, "up").when(change < -0.05, "down").otherwise("flat").alias("var_trend"))


def var_exceptions(series: DataFrame, lookback: int = 504, key: str = "ticker") -> DataFrame:
    """How often the loss exceeded the forecast in the last ``lookback`` rows, and the share in percent."""
    hit = (-F.col("r") * 100 > F.col("var")).cast("int")
    return tail(series, lookback, key).groupBy(key).agg(F.sum(hit).alias("exception_count"), (F.sum(hit) / F.count("*") * 100).alias("exception_rate"))


def yearly(series: DataFrame, prices: DataFrame, vix: DataFrame, least: int = 20) -> DataFrame:
    """Per year of one series: smallest and largest VaR, return from year end to year end, mean volatility index."""
    year = F.year("dt").alias("year")
    ends = prices.groupBy(year).agg(F.max_by("px", "dt").alias("px"))
    ends = ends.withColumn("annual_return_pct", (ratio(F.col("px"), F.lag("px").over(Window.orderBy("year"))) - 1) * 100)  # one row a year
    out = series.groupBy(year).agg(F.count("*").alias("n"), F.min("var").alias("min_var"), F.max("var").alias("max_var")).where(F.col("n") >= least)
    means = vix.groupBy(year).agg(F.avg("vix").alias("vix_avg"))
    return out.join(ends, "year", "left").join(means, "year", "left").select("year", "min_var", "max_var", "annual_return_pct", "vix_avg")


def last_move(prices: DataFrame, returns: DataFrame, key: str = "ticker") -> DataFrame:
    """Last price, last return that isn't zero (fills give zeros), and the last date on which the price changed."""
    moved = returns.where("r <> 0").groupBy(key).agg((F.max_by("r", "dt") * 100).alias("last_return_pct"), F.max("dt").alias("as_of"))
    return prices.where("px IS NOT NULL").groupBy(key).agg(F.max_by("px", "dt").alias("last_price")).join(moved, key, "left")
