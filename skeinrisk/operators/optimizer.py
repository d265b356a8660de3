"""Risk-based portfolio construction on a shrunk covariance: six objectives, their figures, and an efficient frontier."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numerics as nm
from ..functions import quadratic
from ..sources.panel import spread
from . import gram
from .portfolio import survivors

CASH, LEAST = 0.045, 0.005
OBJECTIVES = ("gmv", "erc", "max_div", "concentrated", "lowvol_te", "max_sharpe")
#: Largest weight by objective, and tracking-error caps.
CAPS = {"gmv": 0.35, "erc": 1.0, "max_div": 0.35, "concentrated": 0.40, "lowvol_te": 0.30, "max_sharpe": 0.35}
TE_CAPS = {"concentrated": 0.015, "lowvol_te": 0.03}


def solve(objective: str, s: np.ndarray, mu: np.ndarray, w0: np.ndarray, caps: dict | None = None, te_caps: dict | None = None) -> tuple[np.ndarray, float | None]:
    """(w, slack): long-only weights that sum to 1 under the objective's cap, and how far they are from the conditions of the optimum
    (``quadratic.slack``; for equal risk the spread of the shares). The concentrated objective isn't convex: a local optimum, no slack.
    """
    n = len(w0)
    high, te = max((caps or CAPS)[objective], 1 / n), (te_caps or TE_CAPS).get(objective)
    told = lambda found, c: (np.clip(found[0], 0.0, high), quadratic.slack(s, c, found[1], found[0], high))
    if objective == "gmv":
        return told((quadratic.least_variance(s, high), 0.0), np.zeros(n))
    if objective == "erc":
        w = quadratic.equal_risk(s)
        share = w * (s @ w)
        return w, float(share.max() / share.min() - 1)
    if objective == "max_div":
        c = np.sqrt(np.diag(s))
        return told(quadratic.best_ratio(s, c, high), c)
    if objective == "lowvol_te":
        found = quadratic.least_variance_near(s, w0, high, te)
        # where the cap keeps all away from the base, the nearest to it
        return told(found or (next(x for x in quadratic.critical_line(s, s @ w0, high) if x.low <= 1).at(1.0), 1.0), s @ w0)
    if objective == "max_sharpe":
        if (found := quadratic.best_ratio(s, mu - CASH, high)) is not None:
            return told(found, mu - CASH)
        vol = lambda w: math.sqrt(float(w @ s @ w))
        ratio, slope = lambda w: -(float(w @ mu) - CASH) / vol(w), lambda w: -mu / vol(w) + (float(w @ mu) - CASH) * (s @ w) / vol(w) ** 3
        return nm.minimise(ratio, slope, [w0, np.full(n, 1 / n)], 0.0, high), None
    return concentrate(s, w0, high, te), None


def concentrate(s: np.ndarray, w0: np.ndarray, high: float, te: float) -> np.ndarray:
    """The greatest sum of squares within a tracking error, by an augmented Lagrangian in its square, from the base and from equal
    weights; the best of the local optima."""
    best, worth = None, math.inf
    for start in (w0, np.full(len(w0), 1 / len(w0))):
        w, dual, weight = start, 0.0, 1e3
        for _ in range(12):
            over = lambda v: float((v - w0) @ s @ (v - w0)) / te**2 - 1
            pen = lambda v: max(0.0, dual + weight * over(v))  # noqa: B023, E731
            w = nm.minimise(lambda v: -float(v @ v) + pen(v) ** 2 / (2 * weight), lambda v: -2 * v + pen(v) * 2 * (s @ (v - w0)) / te**2, [w], 0.0, high, 300)  # noqa: B023
            dual, weight = max(0.0, dual + weight * over(w)), weight * 3
        gap = float((w - w0) @ s @ (w - w0))
        if gap > te**2:  # the set is convex: back along the line to a base within the cap
            base = nm.to_box(w0, 0.0, high)
            w = base + (w - base) * min(1.0, te / math.sqrt(gap)) if float((base - w0) @ s @ (base - w0)) < 1e-12 else w
        if -float(w @ w) < worth:
            best, worth = w, -float(w @ w)
    return best


def clean(w: np.ndarray) -> np.ndarray:
    w = np.where(w < LEAST, 0.0, w)
    return np.round(w / w.sum(), 4) if w.sum() > 0 else w


def figures(w: np.ndarray, w0: np.ndarray, s: np.ndarray, mu: np.ndarray, betas: np.ndarray | None) -> dict[str, float | None]:
    vol, ret = math.sqrt(float(w @ s @ w)), float(w @ mu)
    te, active = math.sqrt(max(float((w - w0) @ s @ (w - w0)), 0.0)), float((w - w0) @ mu)
    hhi = float(w @ w)
    return {
        "return_ann": ret * 100, "vol_ann": vol * 100, "sharpe": (ret - CASH) / vol if vol > 0 else 0.0, "beta": None if betas is None else float(w @ betas), "tracking_error": te * 100, "active_return": active * 100,
        "info_ratio": active / te if te > 1e-9 else None, "max_weight": float(w.max()) * 100, "hhi": hhi, "eff_n": 1 / hhi if hhi > 0 else None,
        "turnover": float(np.abs(w - w0).sum()) * 100, "div_ratio": float(w @ np.sqrt(np.diag(s))) / vol if vol > 0 else 0.0,
    }


FIGURES = ("return_ann", "vol_ann", "sharpe", "beta", "tracking_error", "active_return", "info_ratio", "max_weight", "hhi", "eff_n", "turnover", "div_ratio")
SCHEMA = "portfolio string, variant string, ticker string, w double, w0 double, risk_pct double, slack double, " + ", ".join(f"{c} double" for c in FIGURES)


def inputs(returns: DataFrame, weights: DataFrame, market: str, window: int = 1000) -> DataFrame:
    """(portfolio, ticker, ord, w0, mu, beta, cells: array of (b, cov)): a row for each holding of the books that have three tickers with
    252 returns and as many dates in common: its share, annual mean, beta to the market over the last 252 of the ``window`` dates
    (null below 60 of them), and its row of the shrunk covariance."""
    kept = survivors(returns, weights)
    need = kept.groupBy("portfolio").agg(F.count("*").alias("need")).where("need >= 3")
    rows = gram.last_complete(returns.join(kept, "ticker").join(need, "portfolio"), window, 252)
    cells = gram.shrunk(rows).groupBy("portfolio", F.col("a").alias("ticker")).agg(F.collect_list(F.struct("b", "cov")).alias("cells"))
    m = returns.where(F.col("ticker") == market).select("dt", F.col("r").alias("m"))
    near = F.when(F.col("back") < 252, F.col("m"))
    beta = F.when((F.count(near) >= 60) & (F.var_samp(near) > 0), F.covar_samp(F.when(near.isNotNull(), F.col("r")), near) / F.var_samp(near))
    own = rows.join(m, "dt", "left").groupBy("portfolio", "ticker").agg(F.max("ord").alias("ord"), F.max("w_norm").alias("w0"), (F.avg("r") * 252).alias("mu"), beta.alias("beta"))
    return own.join(cells, ["portfolio", "ticker"])


def unpacked(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """A book's rows of ``inputs`` as tickers, covariance, means, shares and betas."""
    pdf = pdf.sort_values("ord")
    tickers = pdf["ticker"].tolist()
    s = np.array([[{c["b"]: c["cov"] for c in cells}[t] for t in tickers] for cells in pdf["cells"]])
    betas = pdf["beta"].to_numpy(float)
    return tickers, (s + s.T) / 2, pdf["mu"].to_numpy(float), pdf["w0"].to_numpy(float), None if np.isnan(betas).any() else betas


def shrunk_covariance(returns: DataFrame, window: int = 1000) -> DataFrame:
    """(a, b, cov, shrinkage): the annual covariance of all pairs of tickers over the last ``window`` dates that all have, shrunk
    towards the mean variance by the optimal amount, as the objectives use it."""
    all_ = returns.select("ticker").distinct().agg(F.count("*").alias("need")).withColumn("portfolio", F.lit("all"))  # one row
    rows = gram.last_complete(returns.crossJoin(F.broadcast(all_)), window, 1)
    return gram.shrunk(rows).drop("portfolio")


def variants(returns: DataFrame, weights: DataFrame, market: str, window: int = 1000) -> DataFrame:
    """A row for each book, variant (the base and six objectives, one task each) and ticker: weights, risk shares and figures."""
    jobs = F.explode(F.array(*[F.lit(x) for x in ("base", *OBJECTIVES)]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        tickers, s, mu, w0, betas = unpacked(pdf)
        variant = pdf["variant"].iloc[0]
        base = np.round(w0, 4)
        w, slack = (base, None) if variant == "base" else solve(variant, s, mu, w0)
        w = base if variant == "base" else clean(w)
        f = figures(w, base, s, mu, betas)
        risk = w * (s @ w)
        share = 100 * risk / risk.sum() if risk.sum() else np.zeros(len(w))
        return pd.DataFrame([(pdf["portfolio"].iloc[0], variant, t, w[k], base[k], share[k], slack, *[f[c] for c in FIGURES]) for k, t in enumerate(tickers)], columns=names)

    rows = inputs(returns, weights, market, window).withColumn("variant", jobs)
    return spread(rows, "portfolio", "variant").groupBy("portfolio", "variant").applyInPandas(run, SCHEMA)


def frontier(returns: DataFrame, weights: DataFrame, market: str, points: int = 25, window: int = 1000, cap: float = 0.35) -> DataFrame:
    """(portfolio, k, ret, vol): least volatility at ``points`` returns from the minimum-variance book's up; targets that the cap
    can't reach are missing. All points lie on one critical line."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, s, mu, w0, _ = unpacked(pdf)
        line = quadratic.critical_line(s, mu, max(cap, 1 / len(w0)))
        out = []
        for k, target in enumerate(np.linspace(float(line[-1].a @ mu), float(mu.max()), points)):
            w = quadratic.at_target(line, mu, float(target))
            if w is not None:
                out.append((pdf["portfolio"].iloc[0], k, float(w @ mu) * 100, math.sqrt(float(w @ s @ w)) * 100))
        return pd.DataFrame(out, columns=["portfolio", "k", "ret", "vol"])

    return spread(inputs(returns, weights, market, window), "portfolio").groupBy("portfolio").applyInPandas(run, "portfolio string, k int, ret double, vol double")


def line_weights(returns: DataFrame, weights: DataFrame, market: str, at: tuple[float, ...], cap: float = 0.35, window: int = 1000) -> DataFrame:
    """(portfolio, t, ticker, w, slack): the weights that trade variance for return at the rates ``at`` (0: least variance), and how far
    each row's book is from the conditions of the optimum."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tickers, s, mu, w0, _ = unpacked(pdf)
        high, out = max(cap, 1 / len(w0)), []
        line = quadratic.critical_line(s, mu, high)
        for t in at:
            w = np.clip(next(x for x in line if x.low <= t <= x.high).at(t), 0.0, high)
            gap = quadratic.slack(s, mu, t, w, high)
            out += [(pdf["portfolio"].iloc[0], t, name, w[k], gap) for k, name in enumerate(tickers)]
        return pd.DataFrame(out, columns=["portfolio", "t", "ticker", "w", "slack"])

    return spread(inputs(returns, weights, market, window), "portfolio").groupBy("portfolio").applyInPandas(run, "portfolio string, t double, ticker string, w double, slack double")


def equal_risk(returns: DataFrame, weights: DataFrame, market: str, window: int = 1000) -> DataFrame:
    """(portfolio, ticker, w, risk_pct): weights by which all holdings have equal shares of the variance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tickers, s, *_ = unpacked(pdf)
        w = quadratic.equal_risk(s)
        share = w * (s @ w) / float(w @ s @ w) * 100
        return pd.DataFrame({"portfolio": pdf["portfolio"].iloc[0], "ticker": tickers, "w": w, "risk_pct": share})

    return spread(inputs(returns, weights, market, window), "portfolio").groupBy("portfolio").applyInPandas(run, "portfolio string, ticker string, w double, risk_pct double")
