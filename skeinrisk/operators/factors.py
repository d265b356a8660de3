"""Factor regressions and risk decompositions. Factors: (dt, mkt, smb, hml, rmw, cma, mom, rf), one row a date."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions, regression
from ..functions import numerics as nm
from ..sources.panel import spread

FACTORS = ("mkt", "smb", "hml", "rmw", "cma", "mom")


def joined(returns: DataFrame, factors: DataFrame) -> DataFrame:
    """Returns with their date's factors; rows that lack one are left out. A factor table has a row a date, so it is sent."""
    return returns.join(F.broadcast(factors), "dt").where(" AND ".join(f"{c} IS NOT NULL" for c in ("r", *FACTORS, "rf")))


def _ann(v: float) -> float:
    return math.sqrt(max(v, 0.0) * 252) * 100


def _share(a: float, b: float) -> float | None:
    return 100 * a / b if b else None


OLS_SCHEMA = "ticker string, factor string, n int, beta double, t double, p double, boot_se double, ci_low double, ci_high double, r2 double, total_vol double, factor_vol double, idio_vol double"


def _newest(rows: DataFrame, lookback: int, least: int) -> DataFrame:
    """The last ``lookback`` rows of each ticker that has ``least``."""
    own = Window.partitionBy("ticker")
    rows = rows.withColumn("_back", F.row_number().over(own.orderBy(F.desc("dt")))).where(F.col("_back") <= lookback)
    return rows.withColumn("_n", F.count("*").over(own)).where(F.col("_n") >= least).drop("_back", "_n")


def factor_ols(returns: DataFrame, factors: DataFrame, lookback: int = 252, draws: int = 500) -> DataFrame:
    """A row for each ticker and coefficient ('alpha' first): slope, t, p, bootstrap error and interval, fit and volatility split.

    A factor that depends on those before it has slope, t and p of 0, 0 and 1. Without ``draws`` there is no bootstrap, and its columns
    are null.
    """
    rows = _newest(joined(returns, factors), lookback, 60)
    sums = rows.groupBy("ticker").agg(*[F.sum(v).alias(k) for k, v in regression.products(F.col("r") - F.col("rf"), [F.col(c) for c in FACTORS]).items()])
    fit = sums.select("ticker", regression.solved(len(FACTORS)).alias("f")).select("ticker", "f.*")
    df = F.col("n") - (len(FACTORS) + 1)
    names = F.array(*[F.lit(x) for x in ("alpha", *FACTORS)])
    cells = fit.withColumn("s2", F.col("rss") / df).select("*", F.inline(F.arrays_zip(names.alias("factor"), F.col("b").alias("beta"), F.col("v").alias("_v"))))
    error = F.sqrt(F.col("s2") * F.col("_v"))
    cells = cells.withColumn("t", F.when(error > 0, F.col("beta") / error).otherwise(0.0))
    part = F.greatest(F.col("r2"), F.lit(0.0))
    cells = cells.withColumn("p", distributions.t_two_sided(F.col("t"), df.cast("double"))).withColumn("r2", F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss")).otherwise(0.0))
    cells = cells.withColumn("total_vol", F.sqrt(F.greatest(F.col("tss"), F.lit(0.0)) / (F.col("n") - 1) * 252) * 100)
    out = cells.select("ticker", "factor", "n", "beta", "t", "p", "r2", "total_vol", (F.col("total_vol") * F.sqrt(part)).alias("factor_vol"), (F.col("total_vol") * F.sqrt(1 - part)).alias("idio_vol"))
    boot = _bootstrapped(rows, draws) if draws else None
    if boot is None:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("boot_se", "ci_low", "ci_high")})
    else:
        out = out.join(boot, ["ticker", "factor"])
    return out.select(*[c.split()[0] for c in OLS_SCHEMA.split(", ")])


def _bootstrapped(rows: DataFrame, draws: int) -> DataFrame:
    """(ticker, factor, boot_se, ci_low, ci_high): spread of the coefficients over paired resamples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        z = np.column_stack([np.ones(len(pdf)), pdf[list(FACTORS)].to_numpy(float)])
        boot = nm.bootstrap_betas(z, (pdf["r"] - pdf["rf"]).to_numpy(float), draws)
        low, high = np.percentile(boot, [2.5, 97.5], axis=0)
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[0], "factor": ["alpha", *FACTORS], "boot_se": boot.std(0, ddof=1), "ci_low": low, "ci_high": high})

    return spread(rows, "ticker").groupBy("ticker").applyInPandas(run, "ticker string, factor string, boot_se double, ci_low double, ci_high double")


CASCADE_SCHEMA = "ticker string, step int, factor string, ortho_loading double, incr_var_pct double, cumulative_r2_pct double, share_of_explained_pct double"


def cascade(returns: DataFrame, factors: DataFrame, order: tuple[str, ...] = FACTORS, lookback: int = 252) -> DataFrame:
    """What each factor explains beyond those before it; the steps sum to the fit of all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in CASCADE_SCHEMA.split(", ")]
        pdf = pdf.sort_values("dt").tail(lookback)
        y = (pdf["r"] - pdf["rf"]).to_numpy(float)
        y = y - y.mean() if len(y) else y
        if len(y) < 60 or not float(y @ y) > 0:
            return pd.DataFrame(columns=names)
        q = nm.gram_schmidt(pdf[list(order)].to_numpy(float))
        norm = (q * q).sum(0)
        b = np.where(norm > 1e-18, q.T @ y / np.where(norm > 1e-18, norm, 1), 0.0)
        part = 100 * b * b * norm / float(y @ y)
        total = np.cumsum(part)
        return pd.DataFrame([(pdf["ticker"].iloc[0], k + 1, f, b[k], part[k], total[k], _share(part[k], total[-1])) for k, f in enumerate(order)], columns=names)

    return spread(joined(returns, factors), "ticker").groupBy("ticker").applyInPandas(run, CASCADE_SCHEMA)


def _book(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[str], np.ndarray]:
    """A book's rows as dates x tickers, complete dates only, with factors; tickers in order of the book, and their weights."""
    own = pdf.drop_duplicates("ticker").sort_values("ord")
    wide = pdf.pivot(index="dt", columns="ticker", values="r").dropna()
    daily = pdf.drop_duplicates("dt").set_index("dt")[[*FACTORS, "rf"]]
    tickers = own["ticker"].tolist()
    w = own["w"].to_numpy(float)
    return wide[tickers].join(daily).sort_index(), tickers, w / w.sum()


def _block(panel: pd.DataFrame, tickers: list[str]) -> dict[str, np.ndarray]:
    x = panel[list(FACTORS)].to_numpy(float)
    fits = [nm.ols((panel[t] - panel["rf"]).to_numpy(float), x) for t in tickers]
    return {"b": np.array([f["b"][1:] for f in fits]), "s": np.cov(x, rowvar=False), "d": np.array([f["s2"] for f in fits]), "r2": np.array([f["r2"] for f in fits])}


DECOMPOSITION_SCHEMA = "portfolio string, kind string, name string, weight_pct double, r2 double, net_beta double, factor_contrib_pct double, specific_contrib_pct double, total_contrib_pct double, specific_share_pct double, vol_pct double"


def _books(returns: DataFrame, weights: DataFrame, factors: DataFrame) -> DataFrame:
    return joined(returns, factors).join(weights.where("w > 0"), "ticker")


def decomposition(returns: DataFrame, weights: DataFrame, factors: DataFrame, lookback: int = 252) -> DataFrame:
    """Book variance as factor exposure and specific risk: rows of kind total, holding and factor.

    Holdings' and factors' parts are Euler contributions, so the total contributions of holdings sum to 100 %.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in DECOMPOSITION_SCHEMA.split(", ")]
        panel, tickers, w = _book(pdf)
        panel = panel.tail(lookback)
        if len(tickers) < 2 or len(panel) < 60:
            return pd.DataFrame(columns=names)
        m = _block(panel, tickers)
        net = m["b"].T @ w
        along = m["s"] @ net
        system, own = float(net @ along), w * w * m["d"]
        model = system + float(own.sum())
        excess = panel[tickers].to_numpy(float) - panel["rf"].to_numpy(float)[:, None]
        realised = float(np.var(excess @ w, ddof=1))
        p = pdf["portfolio"].iloc[0]
        rows = [(p, "total", k, None, None, None, None, None, _share(v, model), None, _ann(v)) for k, v in (("systematic", system), ("specific", float(own.sum())), ("model", model), ("realised", realised))]
        shared = w * (m["b"] @ along)
        for k, t in enumerate(tickers):
            both = shared[k] + own[k]
            clean = shared[k] >= 0 and own[k] >= 0 and both > 1e-3 * model
            rows.append((p, "holding", t, w[k] * 100, m["r2"][k], None, _share(shared[k], model), _share(own[k], model), _share(both, model), _share(own[k], both) if clean else None, None))
        rows += [(p, "factor", f, None, None, net[k], _share(net[k] * along[k], system), None, _share(net[k] * along[k], model), None, None) for k, f in enumerate(FACTORS)]
        return pd.DataFrame(rows, columns=names)

    return spread(_books(returns, weights, factors), "portfolio").groupBy("portfolio").applyInPandas(run, DECOMPOSITION_SCHEMA)


BRIDGE_SCHEMA = "portfolio string, window_days int, component string, delta_var double, vol_points double, share_pct double, direction string, vol_then_pct double, vol_now_pct double, dominant boolean"


def bridge(returns: DataFrame, weights: DataFrame, factors: DataFrame, most: int = 252, least: int = 90) -> DataFrame:
    """The change of book variance between two adjacent windows: exposure drift, factor volatility and specific risk, which sum to it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in BRIDGE_SCHEMA.split(", ")]
        panel, tickers, w = _book(pdf)
        win = min(len(panel) // 2, most)
        if len(tickers) < 2 or win < least:
            return pd.DataFrame(columns=names)
        then, now = _block(panel.iloc[-2 * win : -win], tickers), _block(panel.tail(win), tickers)
        n0, n1 = then["b"].T @ w, now["b"].T @ w
        middle = float(n1 @ then["s"] @ n1)
        s0, s1 = float(n0 @ then["s"] @ n0), float(n1 @ now["s"] @ n1)
        d0, d1 = float(w * w @ then["d"]), float(w * w @ now["d"])
        parts = {"exposure": middle - s0, "factor_vol": s1 - middle, "specific": d1 - d0}
        total = s1 + d1 - s0 - d0
        v0, v1 = _ann(s0 + d0), _ann(s1 + d1)
        top = max(parts, key=lambda k: abs(parts[k]))
        some = abs(total) >= 1e-18
        rows = [(pdf["portfolio"].iloc[0], win, k, v, (v1 - v0) * v / total if some else None, 100 * v / total if some else None, "raised" if v > 0 else "lowered" if v < 0 else "flat", v0, v1, k == top) for k, v in parts.items()]
        return pd.DataFrame(rows, columns=names)

    return spread(_books(returns, weights, factors), "portfolio").groupBy("portfolio").applyInPandas(run, BRIDGE_SCHEMA)


def rolling_loadings(returns: DataFrame, factors: DataFrame, window: int = 252, step: int = 21, years: int = 5) -> DataFrame:
    """(ticker, dt, factor, loading, r2) over windows that end every ``step`` rows of the last ``years`` years; the last row is in none
    of them.

    Products are summed by blocks of rows, and a window is the sum of its blocks, so each row is looked at once however many windows
    it is in.
    """
    unit = math.gcd(window, step)
    per_window, per_step = window // unit, step // unit
    own = Window.partitionBy("ticker")
    rows = joined(returns, factors).withColumn("_i", F.row_number().over(own.orderBy("dt")) - 1).withColumn("_len", F.count("*").over(own)).where(F.col("_len") >= window + 4 * step)
    size = F.least(F.col("_len"), F.lit(years * 252 + window))
    rows = rows.withColumn("_size", size).withColumn("_at", F.col("_i") - F.col("_len") + size).where("_at >= 0")
    products = regression.products(F.col("r") - F.col("rf"), [F.col(c) for c in FACTORS])
    blocks = rows.groupBy("ticker", F.floor(F.col("_at") / unit).alias("_block")).agg(F.max("dt").alias("dt"), F.max("_size").alias("_size"), *[F.sum(v).alias(k) for k, v in products.items()])
    over = own.orderBy("_block").rowsBetween(1 - per_window, 0)
    windows = blocks.select("ticker", "dt", "_block", "_size", F.count("*").over(over).alias("_have"), *[F.sum(k).over(over).alias(k) for k in products])
    end = (F.col("_block") + 1) * unit
    windows = windows.where((F.col("_have") == per_window) & (end < F.col("_size")) & ((F.col("_block") + 1 - per_window) % per_step == 0))
    fit = windows.select("ticker", "dt", regression.solved(len(FACTORS)).alias("f"))
    loadings = F.arrays_zip(F.array(*[F.lit(x) for x in FACTORS]).alias("factor"), F.slice("f.b", 2, len(FACTORS)).alias("loading"))
    return fit.select("ticker", "dt", F.when(F.col("f.tss") > 0, 1 - F.col("f.rss") / F.col("f.tss")).alias("r2"), F.inline(loadings)).select("ticker", "dt", "factor", "loading", "r2")


THEME_SCHEMA = "ticker string, basket string, n int, beta double, t double, p double, r2 double, total_vol double, factor_vol double, idio_vol double"


def thematic(returns: DataFrame, baskets: list[str], lookback: int = 252) -> DataFrame:
    """Exposure to baskets beyond the market: the first basket is the market, the others lose their part along it; a ticker that
    is a basket itself is left out of its own regression."""
    sides = returns.where(F.col("ticker").isin(baskets)).groupBy("dt").pivot("ticker", baskets).agg(F.first("r"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in THEME_SCHEMA.split(", ")]
        me = pdf["ticker"].iloc[0]
        use = [b for b in baskets if b != me]
        pdf = pdf.dropna(subset=["r", *use]).sort_values("dt").tail(lookback)
        if len(use) < 3 or len(pdf) < 60:
            return pd.DataFrame(columns=names)
        market, columns = pdf[use[0]].to_numpy(float), {}
        for b in use:
            v = pdf[b].to_numpy(float)
            columns[b] = v if b == use[0] else v - np.cov(v, market)[0, 1] / np.var(market, ddof=1) * market
        y = pdf["r"].to_numpy(float)
        fit = nm.ols(y, np.column_stack(list(columns.values())))
        total, idio = float(y.std(ddof=1)) * math.sqrt(252) * 100, math.sqrt(fit["s2"] * 252) * 100
        rest = math.sqrt(max(0.0, total * total - idio * idio))
        rows = [(me, b, len(y), fit["b"][k], fit["t"][k], fit["p"][k], fit["r2"], total, rest, idio) for k, b in enumerate(("alpha", *columns))]
        return pd.DataFrame(rows, columns=names)

    return spread(returns.join(F.broadcast(sides), "dt"), "ticker").groupBy("ticker").applyInPandas(run, THEME_SCHEMA)
