"""Risk-adjusted performance of a book against its benchmark."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import YEAR, annual_ratio, annual_return, annual_volatility, beta, ratio, sample_excess_kurtosis, sample_skewness, tier, THEME_TIERS


def aligned(book: DataFrame, bench: DataFrame) -> DataFrame:
    """(portfolio, dt, p, b) on common dates."""
    return book.select("portfolio", "dt", F.col("r").alias("p")).join(bench.select("dt", F.col("r").alias("b")), "dt").where("p IS NOT NULL AND b IS NOT NULL")


def metrics(pairs: DataFrame, least: int = 60) -> DataFrame:
    """One row a portfolio: returns, volatilities, ratios, drawdown, 5 % shortfall, batting and capture."""
    own = Window.partitionBy("portfolio")
    run = own.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = pairs.withColumn("a", F.col("p") - F.col("b")).withColumn("cum", F.sum("p").over(run)).withColumn("q", F.percentile("p", 0.05).over(own))
    rows = rows.withColumn("dd", F.exp(F.col("cum") - F.max("cum").over(run)) - 1)
    zero = F.lit(0.0)
    down = F.sqrt(F.avg(F.pow(F.least(F.col("p"), zero), 2)))
    es = -F.avg(F.when(F.col("p") <= F.col("q"), F.col("p")))
    daily = rows.groupBy("portfolio").agg(
        F.count("*").alias("n"), annual_return(F.col("p")).alias("ann_return_pct"), annual_volatility(F.col("p")).alias("ann_vol_pct"),
        annual_return(F.col("b")).alias("bench_return_pct"), annual_volatility(F.col("b")).alias("bench_vol_pct"),
        annual_return(F.col("a")).alias("active_return_pct"), annual_volatility(F.col("a")).alias("tracking_error_pct"),
        (F.min("dd") * 100).alias("max_drawdown_pct"), annual_ratio(F.col("p")).alias("sharpe"),
        (ratio(F.avg("p"), F.nullif(down, zero)) * math.sqrt(YEAR)).alias("sortino"), annual_ratio(F.col("a")).alias("information_ratio"),
        (es * 100).alias("es5_daily_pct"), ratio(F.avg("p") * YEAR, F.nullif(es * math.sqrt(YEAR), zero)).alias("starr"),
    ).where(F.col("n") >= least).withColumn("calmar", F.when(F.col("max_drawdown_pct") < 0, F.col("ann_return_pct") / F.abs("max_drawdown_pct")))
    months = pairs.groupBy("portfolio", F.trunc("dt", "MM").alias("m")).agg(F.sum("p").alias("p"), F.sum("b").alias("b")).withColumn("a", F.col("p") - F.col("b"))
    part = lambda c, cond: F.avg(F.when(cond, c))
    win, loss = part(F.col("a"), F.col("a") > 0), part(F.col("a"), F.col("a") < 0)
    capture = lambda cond: ratio(part(F.col("p"), cond), F.nullif(part(F.col("b"), cond), zero)) * 100
    monthly = months.groupBy("portfolio").agg(
        (F.avg((F.col("a") > 0).cast("double")) * 100).alias("batting_avg_pct"), ratio(F.coalesce(win, zero), F.abs(loss)).alias("win_loss_ratio"),
        capture(F.col("b") > 0).alias("up_capture_pct"), capture(F.col("b") < 0).alias("down_capture_pct"), F.count("*").alias("n_months"),
    )
    return daily.join(monthly, "portfolio").drop("n")


def regimes(pairs: DataFrame, window: int = 21) -> DataFrame:
    """Active return by the benchmark's volatility terciles; regimes of 10 days and more, portfolios of two regimes and more."""
    own = Window.partitionBy("portfolio")
    frame = own.orderBy("dt").rowsBetween(1 - window, 0)
    rows = pairs.withColumn("a", F.col("p") - F.col("b")).withColumn("v", F.when(F.count("b").over(frame) == window, F.stddev_samp("b").over(frame) * math.sqrt(YEAR)))
    rows = rows.where("v IS NOT NULL").withColumn("q1", F.percentile("v", 1 / 3).over(own)).withColumn("q2", F.percentile("v", 2 / 3).over(own)).withColumn("n", F.count("*").over(own))
    rows = rows.where(F.col("n") >= YEAR).withColumn("regime", F.when(F.col("v") < F.col("q1"), "calm").when(F.col("v") < F.col("q2"), "normal").otherwise("stressed"))
    out = rows.groupBy("portfolio", "regime").agg(
        F.count("*").alias("n_days"), (F.count("*") / F.max("n") * 100).alias("share_pct"), annual_return(F.col("a")).alias("ann_active_pct"), annual_ratio(F.col("a")).alias("info_ratio"),
        annual_return(F.col("p")).alias("ann_port_pct"), annual_return(F.col("b")).alias("ann_bench_pct"), (F.avg("v") * 100).alias("avg_bench_vol_pct"),
        (F.avg((F.col("a") > 0).cast("double")) * 100).alias("hit_rate_pct"),
    ).where("n_days >= 10")
    return out.withColumn("k", F.count("*").over(own)).where("k >= 2").drop("k")


def calm_less_stressed(by_regime: DataFrame) -> DataFrame:
    pick = lambda k: F.max(F.when(F.col("regime") == k, F.col("ann_active_pct")))
    spread = by_regime.groupBy("portfolio").agg((pick("calm") - pick("stressed")).alias("spread"))
    story = F.when(F.col("spread") > 5, "earned when risk is cheap").when(F.col("spread") < -5, "earned when risk is expensive").otherwise("steady across regimes")
    return spread.select("portfolio", "spread", F.when(F.col("spread").isNotNull(), story).alias("narrative"))


def active_moments(pairs: DataFrame) -> DataFrame:
    a = F.col("p") - F.col("b")
    return pairs.groupBy("portfolio").agg(F.count("*").alias("n"), sample_skewness(a).alias("skew"), sample_excess_kurtosis(a).alias("excess_kurtosis"))


def histogram(values: DataFrame, key: str, value: str, bins: int = 41, margin: float = 0.05) -> DataFrame:
    """(key, bin from 0, center, n): counts in ``bins`` equal bins over the key's range and ``margin`` on both sides."""
    own = Window.partitionBy(key)
    rows = values.withColumn("lo", F.min(value).over(own) - margin).withColumn("hi", F.max(value).over(own) + margin)
    width = (F.col("hi") - F.col("lo")) / bins
    rows = rows.withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    return rows.groupBy(key, "bin").agg(F.count("*").alias("n"), F.max(F.col("lo") + (F.col("bin") + 0.5) * width).alias("center"))


def market_beta(pairs: DataFrame, key: str = "portfolio", lookback: int = 252, least: int = 60) -> DataFrame:
    """pairs(key, dt, p, b) -> slope of p on b over the last ``lookback`` rows."""
    newest = Window.partitionBy(key).orderBy(F.desc("dt"))
    rows = pairs.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= lookback)
    return rows.groupBy(key).agg(F.when(F.count("*") >= least, beta(F.col("p"), F.col("b"))).alias("beta"))


def _theme_fit(s: dict) -> dict:
    """Two-factor slopes from moments: market, and the theme's part beyond it. s: n and covariances by pair of y, m, s."""
    b = ratio(s["sm"], s["mm"])
    rest = s["ss"] - b * s["sm"]
    theme = ratio(s["ys"] - b * s["ym"], F.nullif(rest, F.lit(0.0)))
    market = ratio(s["ym"], s["mm"])
    residual = (s["yy"] - market * s["ym"] - theme * (s["ys"] - b * s["ym"])) * (s["n"] - 1) / (s["n"] - 3)
    t = ratio(theme, F.sqrt(ratio(residual, rest * (s["n"] - 1))))
    return {"beta_market": market, "beta_theme": theme, "t_theme": t, "risk_share": ratio(theme * theme * rest, s["yy"]), "beta_raw": ratio(s["ys"], s["ss"])}


def _moments(over=None) -> dict:
    w = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    cols = {k: w(F.covar_samp(k[0], k[1])) for k in ("ym", "ys", "sm", "mm", "ss", "yy")}
    return cols | {"n": w(F.count("y")).cast("double")}


def theme_now(triples: DataFrame, lookback: int = 252, shock: float = -20.0) -> DataFrame:
    """triples(portfolio, dt, y, m, s): book, market and theme -> exposure beyond the market over the last ``lookback`` rows."""
    newest = Window.partitionBy("portfolio").orderBy(F.desc("dt"))
    rows = triples.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= lookback)
    stats = rows.groupBy("portfolio").agg(*[v.alias(k) for k, v in _moments().items()]).where("n >= 60")
    fit = _theme_fit({k: F.col(k) for k in ("ym", "ys", "sm", "mm", "ss", "yy", "n")})
    out = stats.select("portfolio", F.col("n").cast("long").alias("n_obs"), *[v.alias(k) for k, v in fit.items()])
    return out.select("*", (F.abs("t_theme") >= 1.96).alias("theme_significant"), tier(F.col("beta_theme"), THEME_TIERS, "low").alias("tier"), (F.col("beta_raw") * shock).alias("shock_impact_pct"))


def theme_rolling(triples: DataFrame, window: int = 90, step: int = 10, span: int = 504) -> DataFrame:
    """(portfolio, dt, beta): the theme's slope over rolling windows of the last ``span`` rows, every ``step`` rows, the last included."""
    order = Window.partitionBy("portfolio").orderBy("dt")
    rows = triples.withColumn("back", F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc("dt")))).where(F.col("back") <= span)
    rows = rows.withColumn("i", F.row_number().over(order))
    fit = _theme_fit(_moments(order.rowsBetween(1 - window, 0)))
    return rows.withColumn("beta", fit["beta_theme"]).where((F.col("i") >= window) & ((F.col("i") - window) % step == 0)).select("portfolio", "dt", "beta")


def direct_weight(weights: DataFrame, members: list[str]) -> DataFrame:
    """Weight that a book holds in a curated list: total, count and the names by weight."""
    total = F.sum("w").over(Window.partitionBy("portfolio"))
    hits = weights.withColumn("pct", ratio(F.col("w"), total) * 100).where(F.col("ticker").isin(members) & (F.col("w") > 0))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("pct")).alias("o"), "ticker"))), lambda x: x["ticker"])
    return hits.groupBy("portfolio").agg(F.sum("pct").alias("weight_pct"), F.count("*").alias("n_names"), F.concat_ws(",", ranked).alias("names"))


def drift(points: DataFrame, key: str, value: str, least: int = 4) -> DataFrame:
    """Latest value against mean and deviation of all points: an alert where it is a deviation or more away."""
    stats = points.groupBy(key).agg(F.max("dt").alias("dt"), F.max_by(value, "dt").alias("latest"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).where(F.col("n") >= least)
    z = ratio(F.col("latest") - F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0)))
    return stats.select(key, "dt", "latest", "mean", "sd", z.alias("z"), (F.abs(z) >= 1).alias("alert"))
