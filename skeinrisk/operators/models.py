"""Estimators that run on one group's rows: GARCH, extreme values, year-ahead loss, integrated variance, bootstrap.

Each is one pass of a grouped function, with all fits of a group in it: a group is one series' window or history, or a chunk of
a backtest's windows, so its size doesn't grow with the number of series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions, garch
from ..functions import numerics as nm
from ..sources.panel import spread

from .risk import P, WINDOW


def _finite(x: float) -> float | None:
    return float(x) if x is not None and math.isfinite(x) else None


def garch_forecasts(windows: np.ndarray, leverage: bool, p: float = P, rolling: bool = False) -> list[tuple[float, float, float | None]]:
    """(VaR, ES, nu) of each row of returns, all fitted together; EWMA where a fit gives no variance. ``rolling``: rows are windows
    that follow each other."""
    with np.errstate(all="ignore"):
        fit = (garch.fit_rolling if rolling else garch.fit)(windows * 100, leverage)
    out = []
    for r, sigma, nu in zip(windows, fit.sigma / 100, fit.parameters.nu, strict=True):
        if not (math.isfinite(sigma) and sigma > 0 and math.isfinite(nu)):
            sigma, nu = nm.ewma_sigma(r), math.inf
        var, es = nm.standardised_t_var_es(float(sigma), p, float(nu))
        out.append((min(var, 100.0), min(es, 100.0), _finite(nu)))
    return out


def year_ahead(r: np.ndarray, q: float = 0.10) -> tuple[float | None, float | None, float | None]:
    """(VaR, ES, nu) over a year by square root of time with a fitted t; zero returns left out; null below 252."""
    r = r[np.abs(r) > 1e-12]
    if len(r) < 252:
        return None, None, None
    sigma = float(np.std(r, ddof=1)) * math.sqrt(252)
    nu, _, _ = nm.fit_t(r)
    var, es = nm.standardised_t_var_es(sigma, q, nu)
    return var, es, nu if nu > 2 else None


#: What each model gives: VaR and ES, and the t's degrees of freedom.
MODELS = {"garch": ("var_garch", "es_garch", "nu_garch"), "gjr": ("var_gjr", "es_gjr", "nu_gjr"), "evt": ("var_evt", "es_evt"), "year": ("var_year", "es_year", "nu_year")}


def asset_models(returns: DataFrame, window: int = WINDOW, which: tuple[str, ...] = tuple(MODELS), together: int = 64) -> DataFrame:
    """One row a ticker: (ticker, n, and the columns of ``which`` in MODELS): GARCH-t, GJR-t and extreme-value VaR and ES over the
    last ``window`` rows, year-ahead loss over all. Up to ``together`` series of a task are fitted together."""
    names = ["ticker", "n", *[c for m in which for c in MODELS[m]]]

    def fitted(series: dict[str, np.ndarray]) -> pd.DataFrame:
        found: dict[str, list] = {t: [t, len(r)] for t, r in series.items()}
        sizes: dict[int, list[str]] = {}
        for t, r in series.items():
            sizes.setdefault(min(len(r), window), []).append(t)
        for m in which:
            for tickers in sizes.values():
                if m in ("garch", "gjr"):
                    rows = garch_forecasts(np.stack([series[t][-window:] for t in tickers]), m == "gjr")
                elif m == "evt":
                    rows = [nm.var_es_evt(series[t][-window:]) for t in tickers]
                else:
                    rows = [year_ahead(series[t]) for t in tickers]
                for t, row in zip(tickers, rows, strict=True):
                    found[t] += row
        return pd.DataFrame(list(found.values()), columns=names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}  # a series may go on in the next batch
        for part in parts:
            for t, own in part.groupby("ticker", sort=False):
                if t not in held and len(held) == together:
                    yield fitted({k: np.concatenate(v) for k, v in held.items()})
                    held = {}
                held.setdefault(t, []).append(own["r"].to_numpy(float))
        if held:
            yield fitted({k: np.concatenate(v) for k, v in held.items()})

    schema = ", ".join(f"{c} {'string' if c == 'ticker' else 'long' if c == 'n' else 'double'}" for c in names)
    rows = spread(returns.where("r IS NOT NULL AND ticker IS NOT NULL").select("ticker", "dt", "r"), "ticker")
    return rows.sortWithinPartitions("ticker", "dt").mapInPandas(run, schema)


def garch_likelihood(returns: DataFrame, alpha: float = 0.05, gamma: float = 0.04, beta: float = 0.9, nu: float = 8.0, window: int = WINDOW) -> DataFrame:
    """(ticker, model, n, loglik, d_mu, d_omega, d_alpha, d_gamma, d_beta, d_nu, no_worse, stationary) of both models, over the last
    ``window`` returns in percent.

    The likelihood and its score are those that the fits climb, here at a stated point (mean and variance of the sample; no
    leverage for ``garch``); ``no_worse``: the fit's likelihood is at least that; ``stationary``: its score is nil.
    """
    names = ["loglik", *(f"d_{x}" for x in garch.Parameters._fields)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("dt")["r"].to_numpy(float)[None, -window:] * 100
        rows = []
        for model in ("garch", "gjr"):
            own = gamma if model == "gjr" else 0.0
            numbers = r.mean(), r.var() * (1 - alpha - own / 2 - beta), alpha, own, beta, nu
            value, score = garch.likelihood(r, garch.Parameters(*(np.array([x]) for x in numbers)))
            fit = garch.fit(r, model == "gjr")
            flat = bool(np.abs(fit.score).max() <= 10 * garch.SCORE * r.shape[1])
            rows.append((pdf["ticker"].iloc[0], model, r.shape[1], float(value[0]), *score[0].tolist(), bool(-fit.loss[0] >= value[0] - 1e-6), flat))
        return pd.DataFrame(rows, columns=["ticker", "model", "n", *names, "no_worse", "stationary"])

    schema = f"ticker string, model string, n long, {', '.join(f'{x} double' for x in names)}, no_worse boolean, stationary boolean"
    return spread(returns.where("r IS NOT NULL"), "ticker").groupBy("ticker").applyInPandas(run, schema)


def garch_residuals(returns: DataFrame) -> DataFrame:
    """(ticker, dt, residual): standardised GJR-t residuals over each ticker's history."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        res = garch.fit(pdf["r"].to_numpy(float) * 100, True).residuals[0] if len(pdf) >= 100 else np.full(len(pdf), np.nan)
        return pd.DataFrame({"ticker": pdf["ticker"], "dt": pdf["dt"], "residual": [_finite(x) for x in res]})

    return spread(returns, "ticker").groupBy("ticker").applyInPandas(run, "ticker string, dt date, residual double")


def rolling_forecasts(series: DataFrame, model: str, lookback: int = WINDOW, chunk: int = 128, key: str = "portfolio", p: float = P, last: DataFrame | None = None) -> DataFrame:
    """(key, dt, r, var): out-of-sample forecasts by ``model`` (hs, evt, garch or gjr) from the ``lookback`` rows before each row.

    Rows are dealt into chunks that carry their own lookback, so a long backtest spreads over tasks; the windows of a chunk are
    fitted together. ``last`` (key, last): only dates after it are forecast; other keys from their beginning.
    """
    w = Window.partitionBy(key)
    rows = series.withColumn("i", F.row_number().over(w.orderBy("dt")) - 1).withColumn("n", F.count("*").over(w)).where(F.col("n") - lookback - 1 >= 30)
    first = F.greatest(F.floor((F.col("i") - lookback - 1) / chunk), F.lit(0))
    final = F.floor((F.col("i") - 1) / chunk)
    rows = rows.withColumn("new", F.lit(True)) if last is None else rows.join(last.select(key, "last"), key, "left").withColumn("new", F.coalesce(F.col("dt") > F.col("last"), F.lit(True))).drop("last")
    dealt = rows.withColumn("c", F.explode(F.sequence(first.cast("int"), F.greatest(final, first).cast("int"))))
    if last is not None:  # chunks without a new row aren't sent
        own = F.floor((F.col("i") - lookback - 1) / chunk)
        wanted = rows.where(F.col("new") & (F.col("i") > lookback)).select(F.col(key).alias("_key"), own.cast("int").alias("_c")).distinct()
        dealt = dealt.join(wanted, (F.col(key) == F.col("_key")) & (F.col("c") == F.col("_c")), "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        c, i0, r = int(pdf["c"].iloc[0]), int(pdf["i"].iloc[0]), pdf["r"].to_numpy(float)
        begin = lookback + 1 + c * chunk
        new = pdf["new"].to_numpy(bool)
        targets = [i for i in range(begin, begin + chunk) if i - i0 < len(r) and i - lookback - i0 >= 0 and new[i - i0]]
        if not targets:
            return pd.DataFrame(columns=[key, "dt", "r", "var"])
        windows = np.stack([r[i - lookback - i0 : i - i0] for i in targets])
        if model == "hs":
            at = int(lookback * p)
            var = np.minimum(-np.partition(windows, at, 1)[:, at] * 100, 100.0)
        elif model == "evt":
            var = np.array([nm.var_es_evt(x, p)[0] for x in windows])
        else:
            var = np.array([x[0] for x in garch_forecasts(windows, model == "gjr", p, rolling=True)])
        at = [i - i0 for i in targets]
        return pd.DataFrame({key: pdf[key].iloc[0], "dt": pdf["dt"].to_numpy()[at], "r": r[at], "var": var})

    return spread(dealt, key, "c").groupBy(key, "c").applyInPandas(run, f"{key} string, dt date, r double, var double")


def backtest_tests(record: DataFrame) -> DataFrame:
    """Adds p-values to a backtest's statistics."""
    return record.withColumn("kupiec_p", distributions.chi2_tail(F.col("kupiec_stat"))).withColumn("christoffersen_p", distributions.chi2_tail(F.col("christoffersen_stat")))


def recession_probability(yields: DataFrame) -> DataFrame:
    """Adds the probit probability of a recession from a yield spread in percent."""
    return yields.withColumn("recession_probability", distributions.normal_cdf(-0.5333 - 0.6330 * F.col("spread")))


QMLE_SCHEMA = "dt date, n_obs int, corr_naive double, corr_qmle double, method string"


def daily_qmle(pairs: DataFrame, least: int = 20, together: int = 64) -> DataFrame:
    """pairs(dt, ts, x, y) -> (dt, n_obs, corr_naive, corr_qmle, method): noise-robust correlation of each day, by polarisation.

    Up to ``together`` days of a task are searched side by side, four series a day.
    """

    def answer(days: dict) -> pd.DataFrame:
        used, series = [], []
        for day, parts in days.items():
            own = pd.concat(parts).sort_values("ts")
            x, y = own["x"].to_numpy(float), own["y"].to_numpy(float)
            if len(x) >= least and x.std() > 0 and y.std() > 0:
                used.append((day, len(x), float(np.corrcoef(x, y)[0, 1])))
                series += [x, y, x + y, x - y]
        found, rows = nm.integrated_variances(series), []
        for k, (day, n, naive) in enumerate(used):
            (vx, a), (vy, b), (vs, c), (vd, d) = found[4 * k : 4 * k + 4]
            if "fail" in (a, b, c, d) or vx <= 0 or vy <= 0:
                corr, method = naive, "fallback"
            else:
                corr = max(-1.0, min(1.0, (vs - vd) / 4 / math.sqrt(vx * vy)))
                method = "qmle" if {a, b, c, d} == {"qmle"} else "qmle_partial"
            rows.append((day, n, naive, corr, method))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in QMLE_SCHEMA.split(", ")])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}  # a day may go on in the next batch
        for part in parts:
            for day, own in part.groupby("dt", sort=False):
                if day not in held and len(held) == together:
                    yield answer(held)
                    held = {}
                held.setdefault(day, []).append(own)
        if held:
            yield answer(held)

    return spread(pairs.select("dt", "ts", "x", "y"), "dt").sortWithinPartitions("dt").mapInPandas(run, QMLE_SCHEMA)


def ma1_likelihood(bars: DataFrame, thetas: tuple[float, ...], key: str = "ticker") -> DataFrame:
    """bars(key, dt, ts, x) -> (key, dt, theta, n, loss, variance): the likelihood that ``daily_qmle`` searches, at stated thetas, of each
    day of a series with two values or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")["x"].to_numpy(float)
        if len(x) < 2:
            return pd.DataFrame(columns=[key, "dt", "theta", "n", "loss", "variance"])
        loss, variance = nm.ma1_loss(x[None], np.array([len(x)]), np.array([thetas]))
        return pd.DataFrame({key: pdf[key].iloc[0], "dt": pdf["dt"].iloc[0], "theta": thetas, "n": len(x), "loss": loss[0], "variance": variance[0]})

    return spread(bars, key, "dt").groupBy(key, "dt").applyInPandas(run, f"{key} string, dt date, theta double, n int, loss double, variance double")


SKILL_SCHEMA = "portfolio string, n_obs int, years double, information_ratio double, t_stat double, p_luck double, observed_percentile double, psr_pct double, years_for_significance double, null_p5 double, null_p50 double, null_p95 double, hist_centers array<double>, hist_counts array<int>, verdict string"


def skill_or_luck(pairs: DataFrame, draws: int = 4000, block: int = 10, seed: int = 20260626) -> DataFrame:
    """pairs(portfolio, dt, p, b) -> where the observed information ratio lies among those of block-bootstrapped returns without
    an edge, and the probabilistic Sharpe ratio."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        a = (pdf["p"] - pdf["b"]).to_numpy(float)
        n, names = len(a), [c.split()[0] for c in SKILL_SCHEMA.split(", ")]
        sd = a.std(ddof=1) if n > 1 else 0.0
        if n < 252 or sd <= 0:
            return pd.DataFrame(columns=names)
        ir, flat = a.mean() / sd * math.sqrt(252), a - a.mean()
        rng, k = np.random.default_rng(seed), math.ceil(n / block)
        null = np.empty(draws)
        for at in range(0, draws, 200):  # a draw's starts come from the generator one draw after the other
            m = min(200, draws - at)
            starts = rng.integers(0, n - block + 1, (m, k))
            s = flat[(starts[:, :, None] + np.arange(block)).reshape(m, -1)[:, :n]]
            dev = s.std(1, ddof=1)
            null[at : at + m] = np.where(dev > 0, s.mean(1) / np.where(dev > 0, dev, 1) * math.sqrt(252), 0.0)
        luck, sr = float((null >= ir).mean()), a.mean() / sd
        series = pd.Series(a)
        room = 1 - series.skew() * sr + (series.kurtosis() + 2) / 4 * sr * sr
        psr = nm.norm_cdf(sr * math.sqrt(n - 1) / math.sqrt(room)) * 100 if room > 0 else None
        counts, edges = np.histogram(null, 41, (min(null.min(), ir) - 0.05, max(null.max(), ir) + 0.05))
        verdict = "Skill likely" if luck < 0.05 else "Suggestive, not conclusive" if luck < 0.20 else "Cannot reject luck"
        row = (pdf["portfolio"].iloc[0], n, n / 252, ir, ir * math.sqrt(n / 252), luck, float((null <= ir).mean() * 100), psr, (2 / ir) ** 2 if ir > 0 else None, *np.percentile(null, [5, 50, 95]), list((edges[:-1] + edges[1:]) / 2), [int(c) for c in counts], verdict)
        return pd.DataFrame([row], columns=names)

    return spread(pairs, "portfolio").groupBy("portfolio").applyInPandas(run, SKILL_SCHEMA)


