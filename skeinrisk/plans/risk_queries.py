"""Queries on single series, books, correlations and detectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import PHI99, Z99
from ..operators import asof, correlation, detectors, portfolio, risk
from ..sources import panel
from ..sources.panel import BOND, MARKET, THEME, sql
from .registry import query, rounded

V0 = "(SELECT ticker, CASE WHEN max(fwd - lo) >= 29 THEN var_pop(CASE WHEN fwd - lo < 30 THEN r END) ELSE max(CASE WHEN fwd = lo THEN r * r END) END AS v0, count(*) AS n, min(lo) AS lo FROM (SELECT *, min(fwd) OVER (PARTITION BY ticker) AS lo FROM last1000) GROUP BY 1)"
#: (ticker, dt, r, i, v, v_next): the EWMA series seeded on its first ``warm`` rows, by the defining prefix sum.
EWMA = """SELECT *, pow(0.94, i) * (v0 + coalesce(sum(x) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS v,
 pow(0.94, i + 1) * (v0 + sum(x) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v_next
 FROM (SELECT *, 0.06 * r * r * pow(1 / 0.94, i + 1) AS x, var_pop(CASE WHEN i < {warm} OR n < {warm} THEN r END) OVER (PARTITION BY {key}) AS v0
 FROM (SELECT {key}, dt, r, row_number() OVER (PARTITION BY {key} ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source}))"""


def ewma_sql(source: str = "returns", key: str = "ticker", warm: int = 252) -> str:
    return EWMA.format(source=source, key=key, warm=warm)


SERIES = f"SELECT ticker, dt, r, sqrt(v) * {Z99!r} * 100 AS var FROM ewma WHERE i >= 252"


@query(sql("SELECT ticker, dt, round(r, 8) AS r FROM (SELECT ticker, dt, ln(px / lag(px) OVER (PARTITION BY ticker ORDER BY dt)) AS r FROM prices) WHERE r IS NOT NULL", "prices"))
def log_returns(spark, d):
    return rounded(panel.log_returns(panel.prices(spark, d)), 8)


@query(sql("SELECT ticker, dt, round(px, 6) AS px FROM filled", "filled"))
def ffill_panel(spark, d):
    return rounded(panel.fill(panel.prices(spark, d)))


@query(sql("SELECT t.ticker, d.dt, round(p.px, 6) AS px FROM (SELECT DISTINCT dt FROM prices) d CROSS JOIN (VALUES ('AF'), ('NO'), ('ZZ')) t(ticker) LEFT JOIN prices p ON p.dt = d.dt AND p.ticker = t.ticker AND p.ticker = 'none' WHERE t.ticker = 'ZZ' UNION ALL SELECT ticker, dt, round(px, 6) FROM filled WHERE ticker IN ('AF', 'NO')", "filled"))
def schema_pinning(spark, d):
    wanted = spark.createDataFrame([("AF",), ("NO",), ("ZZ",)], "ticker string")
    return rounded(panel.fill(panel.prices(spark, d), wanted))


@query(sql("SELECT ticker, round(least(-max(CASE WHEN k = floor(n * 0.01) + 1 THEN r END) * 100, 100), 6) AS var_hs, round(least(-avg(CASE WHEN k <= floor(n * 0.01) + 1 THEN r END) * 100, 100), 6) AS es_hs FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY r) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM last1000) GROUP BY 1", "last1000"))
def var_es_hs(spark, d):
    return rounded(risk.var_es_hs(panel.returns(spark, d)))


@query(sql(f"SELECT l.ticker, round(least(sqrt(0.06 * sum(pow(0.94, n - 1 - (fwd - v.lo)) * r * r) + pow(0.94, max(n)) * max(v0)) * {Z99!r} * 100, 100), 6) AS var_ewma, round(least(sqrt(0.06 * sum(pow(0.94, n - 1 - (fwd - v.lo)) * r * r) + pow(0.94, max(n)) * max(v0)) * {PHI99 / 0.01!r} * 100, 100), 6) AS es_ewma FROM last1000 l JOIN {V0} v USING (ticker) GROUP BY 1", "last1000"))
def var_es_ewma(spark, d):
    return rounded(risk.var_es_ewma(panel.returns(spark, d)))


@query(sql("SELECT ticker, dt, round(r, 6) AS r, round(var, 6) AS var FROM series", "returns", ewma=ewma_sql(), series=SERIES))
def ewma_var_series(spark, d):
    return rounded(risk.var_series(panel.returns(spark, d)))


@query(sql("SELECT ticker, round(CASE WHEN max(n) >= 1504 THEN avg((v_next <= now)::INT) ELSE 0.5 END, 6) AS risk_level FROM (SELECT *, max_by(v_next, i) OVER (PARTITION BY ticker) AS now FROM ewma) WHERE i >= n - 504 GROUP BY 1", "returns", ewma=ewma_sql(warm=30)))
def risk_level(spark, d):
    return rounded(risk.risk_level(panel.returns(spark, d)))


@query(sql("SELECT ticker, round(max(k) / sum(ln(-r / lk)), 6) AS tail_index FROM (SELECT *, max(CASE WHEN j = k + 1 THEN -r END) OVER (PARTITION BY ticker) AS lk FROM (SELECT *, least(greatest(10, floor(sqrt(n))), n - 1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY r) AS j, count(*) OVER (PARTITION BY ticker) AS n FROM last1000))) WHERE j <= k AND lk > 0 GROUP BY 1", "last1000"))
def hill_tail_index(spark, d):
    return rounded(risk.hill_tail_index(panel.returns(spark, d)))


@query(sql("SELECT ticker, round(quantile_cont(m, 0.05) * 100, 6) AS monthly_p5, round(min(m) * 100, 6) AS monthly_worst FROM (SELECT ticker, count(*) OVER (PARTITION BY ticker) AS n, CASE WHEN count(r) OVER w = 21 THEN exp(sum(r) OVER w) - 1 END AS m FROM returns WHERE isodow(dt) <= 5 WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE n >= 771 GROUP BY 1", "returns"))
def monthly_downside(spark, d):
    return rounded(risk.monthly_downside(panel.returns(spark, d)))


@query(sql("SELECT ticker, CASE WHEN now / past - 1 > 0.05 THEN 'up' WHEN now / past - 1 < -0.05 THEN 'down' ELSE 'flat' END AS var_trend FROM (SELECT ticker, max_by(var, dt) AS now, max_by(past, dt) AS past FROM (SELECT *, lag(var, 5) OVER (PARTITION BY ticker ORDER BY dt) AS past FROM series) GROUP BY 1)", "returns", ewma=ewma_sql(), series=SERIES))
def var_trend(spark, d):
    return risk.var_trend(risk.var_series(panel.returns(spark, d)))


@query(sql("SELECT ticker, sum((-r * 100 > var)::INT)::BIGINT AS exception_count, round(sum((-r * 100 > var)::INT) / count(*) * 100, 6) AS exception_rate FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS k FROM series) WHERE k <= 504 GROUP BY 1", "returns", ewma=ewma_sql(), series=SERIES))
def var_exceptions(spark, d):
    return rounded(risk.var_exceptions(risk.var_series(panel.returns(spark, d))))


@query(sql(f"SELECT s.year, round(min_var, 6) AS min_var, round(max_var, 6) AS max_var, round(annual_return_pct, 6) AS annual_return_pct, round(vix_avg, 6) AS vix_avg FROM (SELECT year(dt)::INT AS year, count(*) AS n, min(var) AS min_var, max(var) AS max_var FROM series WHERE ticker = '{MARKET}' GROUP BY 1 HAVING count(*) >= 20) s LEFT JOIN (SELECT year, (px / lag(px) OVER (ORDER BY year) - 1) * 100 AS annual_return_pct FROM (SELECT year(dt) AS year, max_by(px, dt) AS px FROM filled WHERE ticker = '{MARKET}' AND px IS NOT NULL GROUP BY 1)) USING (year) LEFT JOIN (SELECT year(dt) AS year, avg(vix) AS vix_avg FROM vix GROUP BY 1) USING (year)", "vix", ewma=ewma_sql(), series=SERIES))
def yearly_risk(spark, d):
    filled = panel.fill(panel.prices(spark, d)).where((F.col("ticker") == MARKET) & F.col("px").isNotNull())
    r = panel.log_returns(filled)
    return rounded(risk.yearly(risk.var_series(r), filled, panel.volatility_index(r)))


@query(sql("SELECT ticker, round(last_price, 6) AS last_price, round(last_return_pct, 6) AS last_return_pct, as_of FROM (SELECT ticker, max_by(px, dt) AS last_price FROM filled WHERE px IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT ticker, max_by(r, dt) * 100 AS last_return_pct, max(dt) AS as_of FROM returns WHERE r <> 0 GROUP BY 1) USING (ticker)", "returns"))
def data_as_of(spark, d):
    filled = panel.fill(panel.prices(spark, d))
    return rounded(risk.last_move(filled, panel.log_returns(filled)))


@query(sql("SELECT portfolio, dt, round(r, 8) AS r FROM port", "port"))
def portfolio_returns(spark, d):
    return rounded(portfolio.book_returns(panel.returns(spark, d), panel.weights(spark)), 8)


@query(sql("SELECT portfolio, dt, round(100 * exp(sum(r) OVER (PARTITION BY portfolio ORDER BY dt ROWS UNBOUNDED PRECEDING)), 6) AS nav FROM port", "port"))
def synthetic_nav(spark, d):
    return rounded(portfolio.synthetic_nav(portfolio.book_returns(panel.returns(spark, d), panel.weights(spark))))


MIXED = {"M": {"AF": 0.5, "NO": 0.3, "ZZ": 0.2}}


@query(sql("SELECT portfolio, ticker, n AS n_returns, CASE WHEN n = 0 THEN 'no data' ELSE 'short history' END AS reason FROM (SELECT b.portfolio, b.ticker, count(r.r)::BIGINT AS n FROM (VALUES " + ", ".join(f"('{p}', '{t}')" for p, own in MIXED.items() for t in own) + ") b(portfolio, ticker) LEFT JOIN returns r USING (ticker) GROUP BY 1, 2) WHERE n < 252", "returns"))
def dropped_tickers(spark, d):
    return portfolio.dropped(panel.returns(spark, d), panel.weights(spark, MIXED))


@query(sql("SELECT 'M' AS portfolio, b.ticker, round(w, 6) AS w, round(w / sum(w) OVER (), 6) AS w_norm FROM (VALUES ('AF', 0.5::DOUBLE), ('NO', 0.3::DOUBLE)) b(ticker, w) JOIN (SELECT ticker FROM returns GROUP BY 1 HAVING count(*) >= 252) USING (ticker)", "returns"))
def surviving_weights(spark, d):
    return rounded(portfolio.survivors(panel.returns(spark, d), panel.weights(spark, MIXED)).select("portfolio", "ticker", "w", "w_norm"))


@query(sql(f"SELECT portfolio, a AS ticker, round(wa * sw / sqrt(sum(wa * sw) OVER (PARTITION BY portfolio)) * {Z99!r} * 100, 6) AS component_var FROM (SELECT portfolio, a, max(wa) AS wa, sum(s * wb) AS sw FROM pairs GROUP BY 1, 2)", "last1000", "books",
    rows="SELECT b.portfolio, r.ticker, r.dt, r.r, b.w / sum(b.w) OVER (PARTITION BY b.portfolio, r.dt) AS w, r.back - 1 AS back FROM last1000 r JOIN books b USING (ticker)",
    pairs="SELECT x.portfolio, x.ticker AS a, y.ticker AS b, max(x.w) AS wa, max(y.w) AS wb, 0.06 * sum(pow(0.94, x.back) * x.r * y.r) + pow(0.94, count(*)) * covar_samp(x.r, y.r) AS s FROM rows x JOIN rows y ON x.portfolio = y.portfolio AND x.dt = y.dt GROUP BY 1, 2, 3"))
def component_var(spark, d):
    return rounded(portfolio.component_var(panel.returns(spark, d), panel.weights(spark)))


@query(sql(f"SELECT portfolio, dt, round(sqrt(v) * {Z99!r} * 100, 6) AS var FROM ewma WHERE i >= 252 AND (i - 252) % 5 = 0", "port", ewma=ewma_sql("port", "portfolio")))
def portfolio_trajectory(spark, d):
    return rounded(risk.trajectory(portfolio.book_returns(panel.returns(spark, d), panel.weights(spark))))


CORR_DATES = "SELECT *, count(*) OVER (PARTITION BY dt) AS k FROM oret"
ORET = "SELECT * FROM (SELECT ticker, dt, ln(px / lag(px) OVER (PARTITION BY ticker ORDER BY dt)) AS r FROM (SELECT t.ticker, d.dt, last_value(p.px IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.dt) AS px FROM (SELECT DISTINCT dt FROM order_px) d CROSS JOIN (SELECT DISTINCT ticker FROM order_px) t LEFT JOIN order_px p ON p.dt = d.dt AND p.ticker = t.ticker)) WHERE r IS NOT NULL"


def order_returns(spark, d) -> DataFrame:
    return panel.log_returns(panel.fill(panel.order_prices(spark, d)))


@query(sql("SELECT dt, round(avg(c), 6) AS avg_corr FROM (SELECT a, b, dt, row_number() OVER (PARTITION BY a, b ORDER BY dt) - 1 AS i, covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) AS c FROM (SELECT p.dt, p.ticker AS a, q.ticker AS b, p.r AS x, q.r AS y FROM days p JOIN days q ON p.dt = q.dt AND p.ticker < q.ticker WHERE p.k = 5 AND q.k = 5) WINDOW w AS (PARTITION BY a, b ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE i >= 60 AND (i - 60) % 5 = 0 GROUP BY 1", "order_px", oret=ORET, days=CORR_DATES))
def avg_pairwise_corr(spark, d):
    return rounded(correlation.average_pairwise(order_returns(spark, d)))


_FRAMES = ", ".join(f"w{n} AS (ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (20, 60, 252))
_CORRS = ", ".join(f"CASE WHEN row_number() OVER (ORDER BY dt) >= {n} THEN covar_samp(x, y) OVER w{n} / nullif(stddev_samp(x) OVER w{n} * stddev_samp(y) OVER w{n}, 0) END AS corr_{n}" for n in (20, 60, 252))
MULTI = f"SELECT * FROM (SELECT dt, row_number() OVER (ORDER BY dt) AS i, {_CORRS} FROM (SELECT m.dt, m.r AS x, b.r AS y FROM returns m JOIN returns b ON m.dt = b.dt WHERE m.ticker = '{MARKET}' AND b.ticker = '{BOND}') WINDOW {_FRAMES}) WHERE i >= 20 AND (i - 20) % 5 = 0"


@query(sql("SELECT dt, round(corr_20, 6) AS corr_20, round(corr_60, 6) AS corr_60, round(corr_252, 6) AS corr_252 FROM multi", "returns", multi=MULTI))
def multi_window_corr(spark, d):
    return rounded(correlation.multi_window(panel.returns(spark, d), MARKET, BOND))


@query(sql("SELECT dt, round(short_corr, 6) AS short_corr, round(long_corr, 6) AS long_corr, round(short_corr - long_corr, 6) AS gap, CASE WHEN short_corr - long_corr >= 0.15 THEN 'rising' WHEN short_corr - long_corr <= -0.15 THEN 'falling' ELSE 'stable' END AS flag FROM (SELECT max(dt) AS dt, max_by(corr_20, dt) AS short_corr, max_by(corr_252, dt) AS long_corr FROM multi WHERE corr_20 IS NOT NULL AND corr_252 IS NOT NULL)", "returns", multi=MULTI))
def regime_intensification(spark, d):
    return rounded(correlation.intensification(correlation.multi_window(panel.returns(spark, d), MARKET, BOND)))


INTRADAY = "SELECT * FROM (SELECT ts, CAST(ts AS DATE) AS dt, ln(a / lag(a) OVER (ORDER BY ts)) AS x, ln(b / lag(b) OVER (ORDER BY ts)) AS y FROM (SELECT v.ts, v.px AS a, c.px AS b FROM bars v JOIN bars c ON v.ts = c.ts WHERE v.ticker = 'view' AND c.ticker = 'click')) WHERE x IS NOT NULL AND y IS NOT NULL"
DAILY = "SELECT dt, count(*) AS n, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS corr FROM intraday GROUP BY 1 HAVING count(*) >= 20"


@query(sql("SELECT dt, n::BIGINT AS n, round(corr, 6) AS corr FROM daily", "bars", intraday=INTRADAY, daily=DAILY))
def intraday_corr_naive(spark, d):
    return rounded(correlation.daily_correlation(correlation.paired_bars(panel.bars(spark, d), "view", "click")))


@query(sql("SELECT dt, sign::INT AS sign, streak::BIGINT AS streak, n_days::BIGINT AS n_days, n_positive::BIGINT AS n_positive, round(rate, 6) AS rate, round(pow(rate, streak), 6) AS probability, round(1 / pow(rate, streak), 4) AS odds FROM (SELECT *, CASE WHEN sign > 0 THEN n_positive / n_days ELSE 1 - n_positive / n_days END AS rate, (SELECT count(*) FROM s WHERE dt > coalesce((SELECT max(dt) FROM s WHERE s.sign <> e.sign), DATE '1900-01-01')) AS streak FROM e WHERE n_days > 0)", "bars", intraday=INTRADAY, daily=DAILY,
    s="SELECT dt, CASE WHEN corr > 0 THEN 1 ELSE -1 END AS sign FROM daily WHERE corr IS NOT NULL", e="SELECT max(dt) AS dt, max_by(sign, dt) AS sign, count(*) AS n_days, count_if(sign > 0) AS n_positive FROM s"))
def corr_streak(spark, d):
    out = correlation.streak(correlation.daily_correlation(correlation.paired_bars(panel.bars(spark, d), "view", "click")))
    return rounded(out.withColumn("odds", F.round("odds", 4)))


@query(sql("SELECT ticker, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS ts, round(max_by(px, ts), 6) AS px FROM bars GROUP BY 1, 2", "bars"))
def coarse_bars(spark, d):
    return rounded(panel.coarser(panel.bars(spark, d), "4 hours"))


@query(sql("SELECT p.dt, round(p.avg_corr, 6) AS avg_corr, round(v.vix, 6) AS vix FROM points p ASOF LEFT JOIN vix v ON p.dt >= v.dt", "vix", "order_px", oret=ORET, days=CORR_DATES,
    points="SELECT dt, avg(c) AS avg_corr FROM (SELECT a, b, dt, row_number() OVER (PARTITION BY a, b ORDER BY dt) - 1 AS i, covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) AS c FROM (SELECT p.dt, p.ticker AS a, q.ticker AS b, p.r AS x, q.r AS y FROM days p JOIN days q ON p.dt = q.dt AND p.ticker < q.ticker WHERE p.k = 5 AND q.k = 5) WINDOW w AS (PARTITION BY a, b ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE i >= 60 AND (i - 60) % 5 = 0 GROUP BY 1"))
def asof_vix(spark, d):
    market = panel.returns(spark, d).where(F.col("ticker") == MARKET)
    return rounded(asof.backward(correlation.average_pairwise(order_returns(spark, d)), panel.volatility_index(market), "vix"))


CRISES = [("spring", "1996-04-07"), ("autumn", "1998-09-13"), ("late", "2020-01-01"), ("early", "1990-01-01")]


@query(sql("SELECT label, day, dt FROM (SELECT label, day, dt, row_number() OVER (PARTITION BY label ORDER BY abs(dt - day), dt) AS k FROM (SELECT DISTINCT dt FROM returns) CROSS JOIN (VALUES " + ", ".join(f"('{n}', DATE '{x}')" for n, x in CRISES) + ") c(label, day)) WHERE k = 1", "returns"))
def nearest_event(spark, d):
    labels = spark.createDataFrame(CRISES, "label string, day string").withColumn("day", F.to_date("day"))
    return asof.nearest(panel.returns(spark, d), labels)


ZS = "SELECT ticker, dt, r, CASE WHEN count(r) OVER w >= 20 THEN (r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0) END AS z FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
STEPS = "SELECT *, sum(CASE WHEN z IS NOT NULL AND i > 1 THEN z - 0.5 ELSE 0 END) OVER w AS u, sum(CASE WHEN z IS NOT NULL AND i > 1 THEN z + 0.5 ELSE 0 END) OVER w AS l FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS i FROM zs) WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)"
CS = "SELECT ticker, dt, r, z, u - least(0, min(u) OVER w) AS cusum_pos, l - greatest(0, max(l) OVER w) AS cusum_neg FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)"
FLAGS = "SELECT *, array_to_string(list_filter([CASE WHEN abs(z) >= 3 THEN 'zscore' END, CASE WHEN cusum_pos >= 5 OR cusum_neg <= -5 THEN 'cusum' END], lambda x: x IS NOT NULL), ',') AS detectors FROM cs"


@query(sql("SELECT ticker, dt, round(z, 6) AS z FROM zs", "returns", zs=ZS))
def zscore(spark, d):
    return rounded(detectors.z_scores(panel.returns(spark, d)).select("ticker", "dt", "z"))


@query(sql("SELECT ticker, dt, round(cusum_pos, 6) AS cusum_pos, round(cusum_neg, 6) AS cusum_neg FROM cs", "returns", zs=ZS, steps=STEPS, cs=CS))
def cusum(spark, d):
    return rounded(detectors.cusum(detectors.z_scores(panel.returns(spark, d))).select("ticker", "dt", "cusum_pos", "cusum_neg"))


def _flagged(spark, d) -> DataFrame:
    return detectors.flags(detectors.cusum(detectors.z_scores(panel.returns(spark, d))))


@query(sql("SELECT ticker, dt, round(r, 6) AS r, round(z, 6) AS z, detectors FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS k FROM flags) WHERE k <= 504", "returns", zs=ZS, steps=STEPS, cs=CS, flags=FLAGS))
def anomaly_flags(spark, d):
    return rounded(panel.tail(_flagged(spark, d), 504).select("ticker", "dt", "r", "z", F.concat_ws(",", "detectors").alias("detectors")))


@query(sql("SELECT ticker, k::INT AS k, dt, detectors, round(px, 6) AS px FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS k FROM flags WHERE detectors <> '') JOIN filled USING (ticker, dt) WHERE k <= 15", "returns", zs=ZS, steps=STEPS, cs=CS, flags=FLAGS))
def anomaly_markers(spark, d):
    marks = detectors.recent_anomalies(_flagged(spark, d)).select("ticker", "k", "dt", F.concat_ws(",", "detectors").alias("detectors"))
    return rounded(marks.join(panel.fill(panel.prices(spark, d)), ["ticker", "dt"]))
