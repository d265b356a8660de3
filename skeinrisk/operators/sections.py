"""Composites: what a book, a benchmark and a sector show, put together from the operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import RISK_TIERS, YEAR, tier
from . import detectors, factors, models, performance, portfolio, risk


def stacked(base: DataFrame, *parts: DataFrame, key: str = "ticker") -> DataFrame:
    """``base`` with the columns of ``parts``, all of at most one row a key; null where a part has none, as by left joins.

    Parts that are all dealt by the same key would be joined in one task, which then holds the sorts of all of them at once. Rows are
    stacked instead, so a task holds those of one part.
    """
    own = base.columns
    rows = base.withColumn("_base", F.lit(True))
    for part in parts:
        rows = rows.unionByName(part.where(F.col(key).isNotNull()), allowMissingColumns=True)
    values = [c for c in rows.columns if c not in (key, "_base")]
    out = rows.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values], F.max("_base").alias("_base"))
    return out.where("_base").select(*own, *[c for c in values if c not in own])


def risk_rows(returns: DataFrame, prices: DataFrame) -> DataFrame:
    """One row a ticker: five models, tail, downside, trend, exceptions, last move, spread and mean of the models, risk tier."""
    series = risk.var_series(returns)
    out = risk.var_es_hs(returns)
    parts = (
        risk.var_es_ewma(returns), models.asset_models(returns).drop("n", "nu_garch", "nu_gjr"), risk.hill_tail_index(returns), risk.monthly_downside(returns), risk.risk_level(returns),
        risk.var_trend(series), risk.var_exceptions(series), risk.last_move(prices, returns),
    )
    out = stacked(out, *parts)
    five = [F.col(f"var_{m}") for m in ("hs", "ewma", "garch", "gjr", "evt")]
    out = out.withColumn("mean_var", sum(five[1:], five[0]) / 5).withColumn("model_spread", F.greatest(*five) - F.least(*five))
    return out.withColumn("risk_tier", tier(F.col("risk_level"), RISK_TIERS, "low"))


def portfolio_rows(returns: DataFrame, weights: DataFrame, nav: DataFrame | None = None) -> DataFrame:
    """The risk row of each book's weighted series, priced by its synthetic NAV.

    nav(portfolio, dt, px): prices of the real fund; where a book has some, its last one is shown instead.
    """
    book = portfolio.book_returns(returns, weights)
    label = portfolio.synthetic_nav(book).select(F.col("portfolio").alias("ticker"), "dt", F.col("nav").alias("px"))
    out = risk_rows(book.withColumnRenamed("portfolio", "ticker"), label)
    if nav is not None:
        real = nav.where("px IS NOT NULL").groupBy(F.col("portfolio").alias("ticker")).agg(F.max_by("px", "dt").alias("_real"))
        out = out.join(real, "ticker", "left").withColumn("last_price", F.coalesce("_real", "last_price")).drop("_real")
    return out.withColumnRenamed("ticker", "portfolio")


def complete_benchmarks(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """The benchmarks whose tickers all have returns; the others are left out whole."""
    known = returns.select("ticker").distinct()
    missing = weights.join(known, "ticker", "left_anti").select("portfolio").distinct()
    return weights.join(missing, "portfolio", "left_anti")


def asset_table(weights: DataFrame, rows: DataFrame, components: DataFrame) -> DataFrame:
    """A book's holdings with their risk rows and component VaR, each null where it is missing."""
    return weights.select("portfolio", "ticker", "w").join(rows, "ticker", "left").join(components, ["portfolio", "ticker"], "left")


def with_probabilities(scenarios: DataFrame, sources: DataFrame) -> DataFrame:
    """Scenarios with the list of their probability sources, (source, probability) in order of source; empty where there is none."""
    said = sources.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("source", "probability"))).alias("probabilities"))
    return scenarios.join(said, "id", "left").withColumn("probabilities", F.coalesce("probabilities", F.array().cast(said.schema["probabilities"].dataType)))


def with_disclosure(books: DataFrame, coverage: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Books with what their fund discloses and how much of it the basket models."""
    return books.join(coverage, "fund", "left").join(disclosures.select("fund", "as_of").distinct(), "fund", "left")


def risk_profile(returns: DataFrame, market: DataFrame, window: int = 60) -> DataFrame:
    """(ticker, vol_60, beta): latest annualised volatility over ``window`` rows, and beta to market(dt, r)."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("dt"))
    recent = returns.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= window)
    vol = recent.groupBy("ticker").agg(F.when(F.count("r") == window, F.stddev_samp("r") * math.sqrt(YEAR) * 100).alias(f"vol_{window}"))
    both = returns.select("ticker", "dt", F.col("r").alias("p")).join(market.select("dt", F.col("r").alias("b")), "dt")
    return vol.join(performance.market_beta(both, "ticker"), "ticker", "left")


def performance_skill(pairs: DataFrame, least: int = 252, draws: int = 4000) -> DataFrame:
    """pairs(portfolio, dt, p, b) -> one row a book with ``least`` common rows: their span, metrics, regimes and skill against luck."""
    span = pairs.groupBy("portfolio").agg(F.count("*").cast("int").alias("n_obs"), F.min("dt").alias("first_date"), F.max("dt").alias("last_date")).where(F.col("n_obs") >= least)
    span = span.select("portfolio", "n_obs", (F.col("n_obs") / YEAR).alias("years"), "first_date", "last_date")
    one = lambda df, name: df.select("portfolio", F.struct(*[c for c in df.columns if c != "portfolio"]).alias(name))
    regimes = one(performance.regimes(pairs), "r").groupBy("portfolio").agg(F.sort_array(F.collect_list("r")).alias("regime_alpha"))
    out = span.join(one(performance.metrics(pairs), "metrics"), "portfolio", "left").join(regimes, "portfolio", "left")
    return out.join(one(models.skill_or_luck(pairs, draws), "skill_vs_luck"), "portfolio", "left")


def bundle(parts: dict[str, DataFrame]) -> DataFrame:
    """(portfolio, value): the rows of every part, as one JSON document for each book of the first; a part that it lacks is missing.

    For display-sized parts; books are rows, so many books spread over tasks.
    """
    out = None
    for name, df in parts.items():
        own = df.groupBy("portfolio").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "portfolio"])).alias(name))
        out = own if out is None else out.join(own, "portfolio", "left")
    return out.select("portfolio", F.to_json(F.struct(*parts)).alias("value"))


def anomaly_view(returns: DataFrame, rows: int = 504, least: int = 100) -> DataFrame:
    """z, both CUSUM sums, GARCH residual and the detectors that fire, over the last rows of tickers with enough history."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    enough = returns.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")
    scored = detectors.cusum(detectors.z_scores(enough)).join(models.garch_residuals(enough), ["ticker", "dt"], "left")
    newest = Window.partitionBy("ticker").orderBy(F.desc("dt"))
    return detectors.flags(scored, "residual").withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= rows).drop("_k")


def sector_view(returns: DataFrame, market: DataFrame, factor_table: DataFrame, baskets: list[str], least: int = 252) -> dict[str, DataFrame]:
    """A sector's sections by name: anomalies, profile, loadings, cascade, rolling loadings and themes."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    enough = returns.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")
    return {
        "anomalies": anomaly_view(enough), "profile": risk_profile(enough, market), "loadings": factors.factor_ols(enough, factor_table), "cascade": factors.cascade(enough, factor_table),
        "rolling_loadings": factors.rolling_loadings(enough, factor_table), "themes": factors.thematic(enough, baskets),
    }
