"""Queries on performance, backtests, scenarios, holdings and what the display derives, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CORRELATION_TIERS, EXCEPTION_TIERS, RISK_TIERS, Z99, tier
from ..operators import backtest, correlation, holdings, performance, portfolio, risk, scenarios, sections, views
from ..sources import panel
from ..sources.panel import BOND, MARKET, THEME, sql
from .registry import query, rounded
from .risk_queries import SERIES, ewma_sql

PAIRS = "SELECT p.portfolio, p.dt, p.r AS p, b.r AS b FROM port p JOIN bench b USING (dt)"


def book(spark, d) -> DataFrame:
    return portfolio.book_returns(panel.returns(spark, d), panel.weights(spark))


def pairs(spark, d) -> DataFrame:
    r = panel.returns(spark, d)
    bench = portfolio.book_returns(r, panel.weights(spark, {"bench": panel.BENCHMARK}))
    return performance.aligned(portfolio.book_returns(r, panel.weights(spark)), bench)


_ANN = "sqrt(252.0)"
PERF = f"""SELECT portfolio, round(avg(p) * 25200, 6) AS ann_return_pct, round(stddev_samp(p) * {_ANN} * 100, 6) AS ann_vol_pct, round(avg(b) * 25200, 6) AS bench_return_pct, round(stddev_samp(b) * {_ANN} * 100, 6) AS bench_vol_pct,
 round(avg(a) * 25200, 6) AS active_return_pct, round(stddev_samp(a) * {_ANN} * 100, 6) AS tracking_error_pct, round(min(dd) * 100, 6) AS max_drawdown_pct, round(avg(p) / stddev_samp(p) * {_ANN}, 6) AS sharpe,
 round(avg(p) / sqrt(avg(pow(least(p, 0), 2))) * {_ANN}, 6) AS sortino, round(avg(a) / stddev_samp(a) * {_ANN}, 6) AS information_ratio, round(-avg(CASE WHEN p <= q THEN p END) * 100, 6) AS es5_daily_pct,
 round(avg(p) * 252 / (-avg(CASE WHEN p <= q THEN p END) * {_ANN}), 6) AS starr, round(CASE WHEN min(dd) < 0 THEN avg(p) * 25200 / abs(min(dd) * 100) END, 6) AS calmar
 FROM (SELECT *, exp(cum - max(cum) OVER (PARTITION BY portfolio ORDER BY dt ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM (SELECT *, p - b AS a, sum(p) OVER (PARTITION BY portfolio ORDER BY dt ROWS UNBOUNDED PRECEDING) AS cum, quantile_cont(p, 0.05) OVER (PARTITION BY portfolio) AS q FROM pairs)) GROUP BY 1 HAVING count(*) >= 60"""
MONTHS = """SELECT portfolio, round(avg((p - b > 0)::INT) * 100, 6) AS batting_avg_pct, round(coalesce(avg(CASE WHEN p > b THEN p - b END), 0) / abs(avg(CASE WHEN p < b THEN p - b END)), 6) AS win_loss_ratio,
 round(avg(CASE WHEN b > 0 THEN p END) / avg(CASE WHEN b > 0 THEN b END) * 100, 6) AS up_capture_pct, round(avg(CASE WHEN b < 0 THEN p END) / avg(CASE WHEN b < 0 THEN b END) * 100, 6) AS down_capture_pct, count(*)::BIGINT AS n_months
 FROM (SELECT portfolio, date_trunc('month', dt) AS m, sum(p) AS p, sum(b) AS b FROM pairs GROUP BY 1, 2) GROUP BY 1"""


@query(sql("SELECT * FROM perf JOIN months USING (portfolio)", "port", "bench", pairs=PAIRS, perf=PERF, months=MONTHS))
def perf_metrics(spark, d):
    return rounded(performance.metrics(pairs(spark, d)))


REGIMES = f"""SELECT portfolio, regime, count(*)::BIGINT AS n_days, count(*) / max(n) * 100 AS share_pct, avg(p - b) * 25200 AS ann_active_pct, avg(p - b) / stddev_samp(p - b) * {_ANN} AS info_ratio, avg(p) * 25200 AS ann_port_pct, avg(b) * 25200 AS ann_bench_pct, avg(v) * 100 AS avg_bench_vol_pct, avg((p > b)::INT) * 100 AS hit_rate_pct
 FROM (SELECT *, CASE WHEN v < q1 THEN 'calm' WHEN v < q2 THEN 'normal' ELSE 'stressed' END AS regime FROM (SELECT *, quantile_cont(v, 1 / 3.0::DOUBLE) OVER (PARTITION BY portfolio) AS q1, quantile_cont(v, 2 / 3.0::DOUBLE) OVER (PARTITION BY portfolio) AS q2, count(*) OVER (PARTITION BY portfolio) AS n FROM (SELECT *, CASE WHEN count(b) OVER w = 21 THEN stddev_samp(b) OVER w * {_ANN} END AS v FROM pairs WINDOW w AS (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE v IS NOT NULL) WHERE n >= 252) GROUP BY 1, 2 HAVING count(*) >= 10"""
_R = ", ".join(f"round({c}, 6) AS {c}" for c in ("share_pct", "ann_active_pct", "info_ratio", "ann_port_pct", "ann_bench_pct", "avg_bench_vol_pct", "hit_rate_pct"))


@query(sql(f"SELECT portfolio, regime, n_days, {_R} FROM regimes", "port", "bench", pairs=PAIRS, regimes=REGIMES))
def regime_alpha(spark, d):
    return rounded(performance.regimes(pairs(spark, d)))


@query(sql("SELECT portfolio, round(s, 6) AS spread, CASE WHEN s > 5 THEN 'earned when risk is cheap' WHEN s < -5 THEN 'earned when risk is expensive' ELSE 'steady across regimes' END AS narrative FROM (SELECT portfolio, max(CASE WHEN regime = 'calm' THEN ann_active_pct END) - max(CASE WHEN regime = 'stressed' THEN ann_active_pct END) AS s FROM regimes GROUP BY 1)", "port", "bench", pairs=PAIRS, regimes=REGIMES))
def regime_narrative(spark, d):
    return rounded(performance.calm_less_stressed(performance.regimes(pairs(spark, d))))


@query(sql("SELECT portfolio, count(*)::BIGINT AS n, round(skewness(p - b), 6) AS skew, round(kurtosis(p - b), 6) AS excess_kurtosis FROM pairs GROUP BY 1", "port", "bench", pairs=PAIRS))
def active_moments(spark, d):
    return rounded(performance.active_moments(pairs(spark, d)))


@query(sql("SELECT portfolio, bin::INT AS bin, count(*)::BIGINT AS n, round(max(lo + (bin + 0.5) * wd), 6) AS center FROM (SELECT *, least(floor((a - lo) / wd), 40) AS bin FROM (SELECT *, (hi - lo) / 41 AS wd FROM (SELECT portfolio, p - b AS a, min(p - b) OVER w - 0.05 AS lo, max(p - b) OVER w + 0.05 AS hi FROM pairs WINDOW w AS (PARTITION BY portfolio)))) GROUP BY 1, 2", "port", "bench", pairs=PAIRS))
def null_histogram(spark, d):
    return rounded(performance.histogram(pairs(spark, d).withColumn("a", F.col("p") - F.col("b")), "portfolio", "a"))


@query(sql(f"SELECT ticker, round(covar_samp(p, b) / var_samp(b), 6) AS beta FROM (SELECT r.ticker, r.r AS p, m.r AS b, row_number() OVER (PARTITION BY r.ticker ORDER BY r.dt DESC) AS k FROM returns r JOIN market m USING (dt)) WHERE k <= 252 GROUP BY 1", "market"))
def beta(spark, d):
    r = panel.returns(spark, d)
    both = r.select("ticker", "dt", F.col("r").alias("p")).join(r.where(F.col("ticker") == MARKET).select("dt", F.col("r").alias("b")), "dt")
    return rounded(performance.market_beta(both, "ticker"))


def triples(spark, d) -> DataFrame:
    r = panel.returns(spark, d)
    one = lambda t, c: r.where(F.col("ticker") == t).select("dt", F.col("r").alias(c))
    return portfolio.book_returns(r, panel.weights(spark)).withColumnRenamed("r", "y").join(one(MARKET, "m"), "dt").join(one(THEME, "s"), "dt")


TRIPLES = f"SELECT p.portfolio, p.dt, p.r AS y, m.r AS m, s.r AS s FROM port p JOIN market m USING (dt) JOIN returns s ON s.dt = p.dt AND s.ticker = '{THEME}'"
MOMENTS = "SELECT portfolio, count(*) AS n, covar_samp(y, m) AS ym, covar_samp(y, s) AS ys, covar_samp(s, m) AS sm, var_samp(m) AS mm, var_samp(s) AS ss, var_samp(y) AS yy FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY dt DESC) AS k FROM triples) WHERE k <= 252 GROUP BY 1"
FIT = "SELECT *, sqrt((yy - beta_market * ym - beta_theme * (ys - sm / mm * ym)) * (n - 1) / (n - 3) / (rest * (n - 1))) AS se FROM (SELECT *, ym / mm AS beta_market, (ys - sm / mm * ym) / (ss - sm / mm * sm) AS beta_theme, ss - sm / mm * sm AS rest FROM moments)"


@query(sql("SELECT portfolio, n::BIGINT AS n_obs, round(beta_market, 6) AS beta_market, round(beta_theme, 6) AS beta_theme, round(beta_theme / se, 6) AS t_theme, round(beta_theme * beta_theme * rest / yy, 6) AS risk_share, round(ys / ss, 6) AS beta_raw, abs(beta_theme / se) >= 1.96 AS theme_significant, CASE WHEN beta_theme >= 0.35 THEN 'high' WHEN beta_theme >= 0.15 THEN 'moderate' ELSE 'low' END AS tier, round(ys / ss * -20, 6) AS shock_impact_pct FROM fit", "port", "market", triples=TRIPLES, moments=MOMENTS, fit=FIT))
def theme_now(spark, d):
    return rounded(performance.theme_now(triples(spark, d)))


ROLLING = "SELECT portfolio, dt, (ys - sm / mm * ym) / (ss - sm / mm * sm) AS beta FROM (SELECT portfolio, dt, row_number() OVER (PARTITION BY portfolio ORDER BY dt) AS i, covar_samp(y, m) OVER w AS ym, covar_samp(y, s) OVER w AS ys, covar_samp(s, m) OVER w AS sm, var_samp(m) OVER w AS mm, var_samp(s) OVER w AS ss FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY dt DESC) AS back FROM triples) WHERE back <= 504 WINDOW w AS (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)) WHERE i >= 90 AND (i - 90) % 10 = 0"


@query(sql("SELECT portfolio, dt, round(beta, 6) AS beta FROM rolling", "port", "market", triples=TRIPLES, rolling=ROLLING))
def theme_rolling(spark, d):
    return rounded(performance.theme_rolling(triples(spark, d)))


@query(sql("SELECT portfolio, dt, round(latest, 6) AS latest, round(mean, 6) AS mean, round(sd, 6) AS sd, round((latest - mean) / sd, 6) AS z, abs((latest - mean) / sd) >= 1 AS alert FROM (SELECT portfolio, max(dt) AS dt, max_by(beta, dt) AS latest, avg(beta) AS mean, stddev_samp(beta) AS sd FROM rolling GROUP BY 1 HAVING count(*) >= 4)", "port", "market", triples=TRIPLES, rolling=ROLLING))
def drift_alerts(spark, d):
    return rounded(performance.drift(performance.theme_rolling(triples(spark, d)), "portfolio", "beta"))


# backtests

WEEK = "SELECT portfolio, dt, r, row_number() OVER (PARTITION BY portfolio ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY portfolio) AS n FROM port WHERE isodow(dt) <= 5"
HS = "SELECT portfolio, dt, r, least(-list_sort(past)[11] * 100, 100) AS var, 'HS' AS model FROM (SELECT *, list(r) OVER (PARTITION BY portfolio ORDER BY dt ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS past FROM week) WHERE i >= 1001 AND n >= 1031"
EW = f"SELECT portfolio, dt, r, least(sqrt(v) * {Z99!r} * 100, 100) AS var, 'EWMA' AS model FROM ewma WHERE i >= 1001 AND n >= 1031"
HITS = "SELECT *, (-r * 100 > var)::INT AS v FROM (SELECT * FROM hs UNION ALL SELECT * FROM ew)"
_BT = dict(week=WEEK, ewma=ewma_sql("week", "portfolio", 30), hs=HS, ew=EW, hits=HITS)


def hits(spark, d) -> DataFrame:
    days = panel.weekdays(book(spark, d))
    hs = backtest.historical_forecasts(days).withColumn("model", F.lit("HS"))
    return backtest.violations(hs.unionByName(backtest.ewma_forecasts(days).withColumn("model", F.lit("EWMA"))))


@query(sql("SELECT portfolio, dt, model, round(var, 6) AS var, v FROM hits WHERE model = 'HS'", "port", **_BT))
def backtest_hs(spark, d):
    return rounded(hits(spark, d).where("model = 'HS'").select("portfolio", "dt", "model", "var", "v"))


@query(sql("SELECT portfolio, dt, model, round(var, 6) AS var, v FROM hits WHERE model = 'EWMA'", "port", **_BT))
def backtest_ewma(spark, d):
    return rounded(hits(spark, d).where("model = 'EWMA'").select("portfolio", "dt", "model", "var", "v"))


COUNTS = "SELECT portfolio, model, count(*) AS n, sum(v) AS x, count_if(u = 0 AND v = 0) AS n00, count_if(u = 0 AND v = 1) AS n01, count_if(u = 1 AND v = 0) AS n10, count_if(u = 1 AND v = 1) AS n11 FROM (SELECT *, lag(v) OVER (PARTITION BY portfolio, model ORDER BY dt) AS u FROM hits) GROUP BY 1, 2"
STATS = """SELECT *, CASE WHEN x = 0 THEN -2 * n * ln(0.99) WHEN x = n THEN -2 * n * ln(0.01) ELSE -2 * ((n - x) * ln(0.99 / (1 - x / n)) + x * ln(0.01 / (x / n))) END AS uc,
 CASE WHEN n00 + n01 > 0 AND n10 + n11 > 0 THEN -2 * ((n00 + n10) * ln(greatest(1 - (n01 + n11) / (n00 + n01 + n10 + n11), 1e-12)) + (n01 + n11) * ln(greatest((n01 + n11) / (n00 + n01 + n10 + n11), 1e-12))
 - n00 * ln(greatest(1 - n01 / (n00 + n01), 1e-12)) - n01 * ln(greatest(n01 / (n00 + n01), 1e-12)) - n10 * ln(greatest(1 - n11 / (n10 + n11), 1e-12)) - n11 * ln(greatest(n11 / (n10 + n11), 1e-12))) END AS ind FROM counts"""


@query(sql("SELECT portfolio, model, n::BIGINT AS n, x::BIGINT AS x, round(uc, 6) AS kupiec_stat FROM stats", "port", **_BT, counts=COUNTS, stats=STATS))
def kupiec_stat(spark, d):
    c = backtest.counts(hits(spark, d), ["portfolio", "model"])
    return rounded(c.select("portfolio", "model", "n", "x", backtest.kupiec(F.col("n"), F.col("x")).alias("kupiec_stat")))


@query(sql("SELECT portfolio, model, n00::BIGINT AS n00, n01::BIGINT AS n01, n10::BIGINT AS n10, n11::BIGINT AS n11, round(ind, 6) AS christoffersen_stat FROM stats", "port", **_BT, counts=COUNTS, stats=STATS))
def christoffersen_stat(spark, d):
    c = backtest.counts(hits(spark, d), ["portfolio", "model"])
    cols = ("n00", "n01", "n10", "n11")
    return rounded(c.select("portfolio", "model", *cols, backtest.christoffersen(*map(F.col, cols)).alias("christoffersen_stat")))


@query(sql("SELECT portfolio, model, n::BIGINT AS n_eval, x::BIGINT AS exceptions, round(n * 0.01, 6) AS expected, round(x / n * 100, 6) AS rate_pct, round(uc, 6) AS kupiec_stat, round(ind, 6) AS christoffersen_stat, CASE WHEN uc > 3.841458820694124 AND x / n > 0.01 THEN 'UNDER-EST' WHEN uc > 3.841458820694124 AND x / n < 0.01 THEN 'OVER-CONSERV' WHEN ind > 3.841458820694124 THEN 'CLUSTERED' ELSE 'CALIBRATED' END AS verdict FROM stats", "port", **_BT, counts=COUNTS, stats=STATS))
def backtest_record(spark, d):
    return rounded(backtest.record(hits(spark, d), ["portfolio", "model"]))


@query(sql("SELECT portfolio, dt, floor((dt - date_trunc('week', min(dt) OVER (PARTITION BY portfolio))::DATE) / 7)::INT AS week, isodow(dt)::INT AS dow, models FROM (SELECT portfolio, dt, coalesce(string_agg(CASE WHEN v = 1 THEN model END, ',' ORDER BY model), '') AS models, row_number() OVER (PARTITION BY portfolio ORDER BY dt DESC) AS k FROM hits GROUP BY 1, 2) WHERE k <= 252", "port", **_BT))
def exception_calendar(spark, d):
    return backtest.exception_calendar(hits(spark, d))


# scenarios

HIST = [("s1", "1996-03-01", "1996-06-30"), ("s2", "1998-08-01", "1998-10-15"), ("s3", "2000-09-01", "2000-12-31"), ("s4", "1994-01-01", "1994-06-30")]
BOOKS = {"A": panel.PORTFOLIOS["A"], "M": {"AF": 0.5, "NO": 0.3, "ZZ": 0.15, "YY": 0.05}}
PROXIES = [("ZZ", "RF"), ("AF", "RO")]
HIST_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{i}', DATE '{a}', DATE '{b}')" for i, a, b in HIST) + ') h(id, "start", "end")'
BOOKS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{t}', {w!r}::DOUBLE)" for p, own in BOOKS.items() for t, w in own.items()) + ") b(portfolio, ticker, w)"
RETS = 'SELECT id, ticker, max_by(px, dt) / min_by(px, dt) - 1 AS ret FROM filled JOIN hist ON dt >= "start" AND dt <= "end" WHERE px IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2'
PROXIED = "SELECT i.id, b.ticker, coalesce(o.ret, p.ret) AS ret, CASE WHEN o.ret IS NULL THEN x.proxy END AS proxied FROM (SELECT DISTINCT id FROM rets) i CROSS JOIN (SELECT DISTINCT ticker FROM sb) b LEFT JOIN (VALUES ('ZZ', 'RF'), ('AF', 'RO')) x(ticker, proxy) ON x.ticker = b.ticker LEFT JOIN rets o ON o.id = i.id AND o.ticker = b.ticker LEFT JOIN rets p ON p.id = i.id AND p.ticker = x.proxy WHERE o.ret IS NOT NULL OR p.ret IS NOT NULL"
PARTS = "SELECT b.portfolio, m.id, m.ticker, m.ret, b.w, b.w / sum(b.w) OVER (PARTITION BY b.portfolio, m.id) * m.ret * 100 AS contribution FROM sb b JOIN moves m USING (ticker)"
TOTALS = "SELECT portfolio, id, sum(contribution) AS portfolio_pnl, sum(w) * 100 AS coverage_pct, count(*)::BIGINT AS n_assets FROM parts GROUP BY 1, 2"
_HIST = dict(hist=HIST_SQL, sb=BOOKS_SQL, rets=RETS, moves=PROXIED, parts=PARTS, totals=TOTALS)


def hist_parts(spark, d) -> DataFrame:
    windows = spark.createDataFrame(HIST, "id string, start string, end string").select("id", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    w = panel.weights(spark, BOOKS)
    rets = scenarios.window_returns(panel.fill(panel.prices(spark, d)), windows)
    return scenarios.contributions(scenarios.with_proxies(rets, w, spark.createDataFrame(PROXIES, "ticker string, proxy string")), w)


@query(sql("SELECT portfolio, id, ticker, round(ret, 6) AS ret, round(w, 6) AS w, round(contribution, 6) AS contribution, proxied FROM parts JOIN moves USING (id, ticker, ret)", "filled", **_HIST))
def hist_scenarios(spark, d):
    return rounded(hist_parts(spark, d).select("portfolio", "id", "ticker", "ret", "w", "contribution", "proxied"))


@query(sql("SELECT portfolio, id, round(portfolio_pnl, 6) AS portfolio_pnl, round(coverage_pct, 6) AS coverage_pct, n_assets FROM totals", "filled", **_HIST))
def hist_scenario_totals(spark, d):
    return rounded(scenarios.totals(hist_parts(spark, d)))


@query(sql("SELECT x.id, x.portfolio AS a, y.portfolio AS b, round(x.portfolio_pnl, 6) AS pnl_a, round(y.portfolio_pnl, 6) AS pnl_b, round(x.portfolio_pnl - y.portfolio_pnl, 6) AS delta_pp FROM totals x JOIN totals y ON x.id = y.id AND x.portfolio <> y.portfolio", "filled", **_HIST))
def scenario_compare(spark, d):
    return rounded(scenarios.compare(scenarios.totals(hist_parts(spark, d))))


#: Securities of the derived panel by nation (a class under its region) or as blends; segments are sectors.
SECURITIES = [("AF", "NATION_3", None, None), ("AO", "NATION_2", "BUILDING", None), ("NF", "NATION_0", None, None), ("NO", None, None, {"NATION_1": 0.6, "NATION_7": 0.4}), ("RF", "NATION_12", "MACHINERY", None), ("RO", None, None, {"NATION_4": 0.7, "NATION_6": 0.3})]
SHOCKS = [("h1", "EUROPE", -0.1), ("h1", "ASIA", -0.2), ("h1", "MACHINERY", -0.3), ("h1", "NATION_7", -0.25), ("h2", "AFRICA", 0.05), ("h2", "AMERICA", -0.08), ("h2", "NATION_3", 0.02)]
OVERRIDES = [("h2", "RF", -0.5)]
GROUPS = [("EUROPE", "west"), ("AMERICA", "west"), ("ASIA", "east"), ("NATION_7", "china"), ("AFRICA", "south")]
MULTIPLIERS = [("west", 0.5), ("east", 2.0)]
_v = lambda rows, cols: "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x) + ("::DOUBLE" if isinstance(x, float) else "") for x in r) + ")" for r in rows) + f") t({cols})"
_HYPO = dict(
    tree="SELECT n_name AS class, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name FROM region",
    sec=_v([(t, c or "", s or "") for t, c, s, _ in SECURITIES], "ticker, class, sector"), sleeve=_v([(t, c, w) for t, _, _, b in SECURITIES for c, w in (b or {}).items()], "ticker, class, sw"),
    shocks=_v(SHOCKS, "id, category, shock"), over_=_v(OVERRIDES, "id, ticker, shock"),
    reach="SELECT class, class AS anc, 0 AS depth FROM tree UNION ALL SELECT class, parent, 1 FROM tree WHERE class <> parent",
    bc="SELECT id, class, min_by(shock, depth) AS shock FROM reach JOIN shocks ON anc = category GROUP BY 1, 2",
    bl="SELECT id, ticker, sum(sw * shock) / sum(sw) AS shock FROM sleeve JOIN bc USING (class) GROUP BY 1, 2",
    res="SELECT i.id, s.ticker, coalesce(o.shock, b.shock, x.shock, c.shock) AS shock, CASE WHEN o.shock IS NOT NULL THEN 'override' WHEN s.class = '' THEN 'blend' WHEN x.shock IS NOT NULL THEN 'sector' ELSE 'class' END AS path FROM (SELECT DISTINCT id FROM shocks) i CROSS JOIN sec s LEFT JOIN over_ o ON o.id = i.id AND o.ticker = s.ticker LEFT JOIN bl b ON b.id = i.id AND b.ticker = s.ticker LEFT JOIN shocks x ON x.id = i.id AND x.category = s.sector LEFT JOIN bc c ON c.id = i.id AND c.class = s.class WHERE coalesce(o.shock, b.shock, x.shock, c.shock) IS NOT NULL",
    parts="SELECT b.portfolio, m.id, m.ticker, m.shock AS ret, b.w, b.w / sum(b.w) OVER (PARTITION BY b.portfolio, m.id) * m.shock * 100 AS contribution FROM books b JOIN res m USING (ticker)",
    grps=_v(GROUPS, "gclass, grp"), named="SELECT class, min_by(grp, depth) AS grp FROM reach JOIN grps ON anc = gclass GROUP BY 1",
    heavy="SELECT id, ticker, max_by(class, sw) AS class FROM sleeve JOIN bc USING (class) GROUP BY 1, 2",
    ingrp="SELECT id, ticker, coalesce(own, grp) AS grp FROM (SELECT i.id, s.ticker, s.class, CASE WHEN s.sector = 'MACHINERY' AND x.shock IS NOT NULL THEN 'machines' END AS own FROM (SELECT DISTINCT id FROM shocks) i CROSS JOIN sec s LEFT JOIN shocks x ON x.id = i.id AND x.category = s.sector WHERE s.class <> '' UNION ALL SELECT id, ticker, class, NULL FROM heavy) LEFT JOIN named USING (class) WHERE coalesce(own, grp) IS NOT NULL",
)


def taxonomy(spark, d) -> dict[str, DataFrame]:
    nation, region = panel.table(spark, d, "nation"), panel.table(spark, d, "region")
    tree = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("class"), F.col("r_name").alias("parent"))
    return {
        "tree": tree.unionByName(region.select(F.col("r_name").alias("class"), F.col("r_name").alias("parent"))),
        "securities": spark.createDataFrame(SECURITIES, "ticker string, class string, sector string, blend map<string, double>"),
        "shocks": spark.createDataFrame(SHOCKS, "id string, category string, shock double"), "overrides": spark.createDataFrame(OVERRIDES, "id string, ticker string, shock double"),
        "groups": spark.createDataFrame(GROUPS, "gclass string, grp string"), "multipliers": spark.createDataFrame(MULTIPLIERS, "grp string, multiplier double"),
    }


def hypo_parts(spark, d) -> DataFrame:
    t = taxonomy(spark, d)
    moves = scenarios.resolve(t["securities"], t["tree"], t["shocks"], t["overrides"]).withColumnRenamed("shock", "ret")
    return scenarios.contributions(moves, panel.weights(spark))


def hypo_groups(spark, d) -> DataFrame:
    t = taxonomy(spark, d)
    return scenarios.groups(t["securities"], t["tree"], t["shocks"], t["groups"], {"MACHINERY": "machines"})


@query(sql("SELECT id, ticker, round(shock, 6) AS shock, path FROM res", "books", **_HYPO))
def shock_resolution(spark, d):
    t = taxonomy(spark, d)
    return rounded(scenarios.resolve(t["securities"], t["tree"], t["shocks"], t["overrides"]))


@query(sql("SELECT portfolio, id, ticker, round(ret, 6) AS ret, round(w, 6) AS w, round(contribution, 6) AS contribution FROM parts", "books", **_HYPO))
def hypo_scenarios(spark, d):
    return rounded(hypo_parts(spark, d).select("portfolio", "id", "ticker", "ret", "w", "contribution"))


@query(sql("SELECT id, ticker, grp FROM ingrp", "books", **_HYPO))
def slider_groups(spark, d):
    return hypo_groups(spark, d)


@query(sql("SELECT portfolio, id, round(sum(contribution), 6) AS pnl, round(sum(contribution * coalesce(m, 1)), 6) AS pnl_scaled FROM parts LEFT JOIN ingrp USING (id, ticker) LEFT JOIN (VALUES ('west', 0.5), ('east', 2.0)) f(grp, m) USING (grp) GROUP BY 1, 2", "books", **_HYPO))
def scenario_what_if(spark, d):
    return rounded(scenarios.what_if(hypo_parts(spark, d), hypo_groups(spark, d), taxonomy(spark, d)["multipliers"]))


@query(sql("SELECT portfolio, id, grp, round(arg_max(ret, (abs(ret), ticker)), 6) AS anchor FROM parts JOIN ingrp USING (id, ticker) GROUP BY 1, 2, 3", "books", **_HYPO))
def slider_anchors(spark, d):
    return rounded(scenarios.anchors(hypo_parts(spark, d), hypo_groups(spark, d)))


@query(sql("SELECT portfolio, round(sum(CASE WHEN id = 'h1' THEN w END), 6) AS h1, round(sum(CASE WHEN id = 'h2' THEN w END), 6) AS h2 FROM (SELECT portfolio, id, w / (SELECT sum(w) FROM books b WHERE b.portfolio = parts.portfolio) AS w FROM parts) GROUP BY 1", "books", **_HYPO))
def scenario_coverage(spark, d):
    c = scenarios.coverage(hypo_parts(spark, d), panel.weights(spark))
    return rounded(c.groupBy("portfolio").pivot("id", ["h1", "h2"]).agg(F.first("coverage")))


@query(f"SELECT ticker, string_agg(DISTINCT portfolio, ',' ORDER BY portfolio) AS portfolios FROM ({BOOKS_SQL}) WHERE ticker NOT IN (SELECT ticker FROM ({_v([(t,) for t, *_ in SECURITIES], 'ticker')})) GROUP BY 1")
def unmapped_guard(spark, d):
    return scenarios.unmapped(panel.weights(spark, BOOKS), taxonomy(spark, d)["securities"])


@query(sql("SELECT portfolio, id, kind, round(pnl, 6) AS pnl, round(coverage_pct, 6) AS coverage_pct, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY kind DESC, pnl, id) AS rank FROM (SELECT portfolio, id, 'historical' AS kind, portfolio_pnl AS pnl, coverage_pct FROM ht UNION ALL SELECT portfolio, id, 'hypothetical', sum(contribution), NULL FROM parts GROUP BY 1, 2))", "filled", "books", hist=HIST_SQL, sb="SELECT portfolio, ticker, w FROM books", rets=RETS, moves=PROXIED, hp=PARTS, ht=TOTALS.replace("FROM parts", "FROM hp"), **_HYPO))
def all_scenarios(spark, d):
    windows = spark.createDataFrame(HIST, "id string, start string, end string").select("id", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    w = panel.weights(spark)
    rets = scenarios.window_returns(panel.fill(panel.prices(spark, d)), windows)
    hist = scenarios.totals(scenarios.contributions(scenarios.with_proxies(rets, w, spark.createDataFrame(PROXIES, "ticker string, proxy string")), w))
    hypo = scenarios.totals(hypo_parts(spark, d)).select("portfolio", "id", F.col("portfolio_pnl").alias("pnl"))
    return rounded(views.all_scenarios(hist.select("portfolio", "id", F.col("portfolio_pnl").alias("pnl"), "coverage_pct"), hypo))


# holdings

#: A disclosed row of each part: brands are funds. Names carry boilerplate, tickers take the forms of exchanges, weights are percents
#: in some funds and fractions in others, and some rows are cash, broken or negative.
_FORMS = ["lpad(k, 6, '0') || ' KS'", "'A' || lpad(k, 6, '0')", "k || ' HK'", "'NESN'", "upper(substr(p_name, 1, 3)) || ' US'", "lpad(k, 4, '0')", "' SAP GR '", "'nan'", "'a b c'", "'X ZZ'", "upper(substr(p_name, 1, 4))"]
_NOISE = ["", " INC", " Co., Ltd.", " SP ADR", " COMMON STOCK USD.1", " PLC", " INC CL A"]
_FRACTIONS = "CAST(substr(p_brand, 7) AS INT) % 2 = 0"
_CASES = lambda on, values: f"CASE {on} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
_NOISES = _CASES(f"p_partkey % {len(_NOISE)}", [f"'{x}'" for x in _NOISE])
_RAW_COLUMNS = f"""p_brand AS fund, upper(p_name) || {_NOISES} AS name, {_CASES(f'p_partkey % {len(_FORMS)}', _FORMS)} AS ticker,
 CASE WHEN p_partkey % 31 = 0 THEN 'n/a' WHEN p_partkey % 37 = 0 THEN '-1' WHEN {_FRACTIONS} THEN CAST(p_retailprice / 100000 AS STRING) ELSE CAST(p_retailprice / 1000 + 1 AS STRING) || '%' END AS weight,
 CASE p_size % 5 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Equity' WHEN 2 THEN 'Equity - common' END AS asset_type, CASE p_size % 4 WHEN 0 THEN ' ' || p_type || ' ' WHEN 1 THEN 'nan' WHEN 2 THEN '' END AS country"""
_RAW_EXPRESSIONS = _RAW_COLUMNS.replace(" AS name, ", " AS name;;").replace(" AS ticker,", " AS ticker;;").replace(" AS fund, ", " AS fund;;").replace(" AS weight,", " AS weight;;").replace(" AS asset_type, ", " AS asset_type;;").split(";;")
_PARTS = "(SELECT *, CAST(p_partkey AS STRING) AS k FROM part)"
#: A ticker's symbol by the rules, in their order, with the fixed tables.
_LOOKUP = lambda pairs: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"
_SYMBOL = f"""CASE WHEN t IS NULL OR t = '' OR lower(t) IN ('nan', 'none') THEN NULL WHEN named IS NOT NULL THEN named WHEN suffix IS NOT NULL THEN split_part(t, ' ', 1) || suffix
 WHEN regexp_full_match(t, 'A[0-9]{{6}}') THEN substr(t, 2) || '.KS' WHEN regexp_full_match(t, '[A-Z]{{1,5}}') THEN t WHEN regexp_full_match(t, '[0-9]{{4,5}}') THEN t || '.HK' END"""
_RAW_SQL = f"""SELECT *, trim(ticker) AS t, {_LOOKUP(holdings.TICKER_OVERRIDES)}[trim(ticker)] AS named,
 CASE WHEN regexp_full_match(trim(ticker), '\\S+ [A-Za-z]{{2}}') THEN {_LOOKUP(holdings.EXCHANGE_SUFFIX)}[upper(split_part(trim(ticker), ' ', 2))] END AS suffix
 FROM (SELECT {_RAW_COLUMNS}, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || CASE WHEN p_partkey % {len(_NOISE)} = 2 THEN ' Co' ELSE '' END AS security FROM {_PARTS})""".replace("STRING", "VARCHAR")
_CANON = f"""SELECT *, row_number() OVER (PARTITION BY fund ORDER BY weight DESC, name, ticker) AS rank FROM (SELECT fund, security, name, ticker, {_SYMBOL} AS symbol,
 CASE WHEN trim(country) NOT IN ('', 'nan') THEN trim(country) END AS country, round(CASE WHEN max(v) OVER (PARTITION BY fund) <= 1.5 THEN v * 100 ELSE v END, 4) AS weight
 FROM (SELECT *, TRY_CAST(replace(weight, '%', '') AS DOUBLE) AS v FROM raw WHERE asset_type IS NULL OR asset_type LIKE 'Equity%') WHERE v > 0)"""


def raw_holdings(spark, d) -> DataFrame:
    part = panel.table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    return part.selectExpr(*[x.strip() for x in _RAW_EXPRESSIONS])


@query(f"WITH raw AS ({_RAW_SQL}), canon AS ({_CANON}) SELECT fund, security, trim(coalesce(ticker, '')) AS ticker, symbol, country, weight, rank::INT AS rank FROM canon")
def holdings_normalise(spark, d):
    return holdings.normalise(raw_holdings(spark, d))


@query(f"SELECT DISTINCT ticker, {_SYMBOL} AS symbol FROM ({_RAW_SQL})")
def ticker_map(spark, d):
    return raw_holdings(spark, d).select("ticker", holdings.map_ticker(F.col("ticker")).alias("symbol")).distinct()


@query(f"SELECT DISTINCT name, security FROM ({_RAW_SQL})")
def name_clean(spark, d):
    return raw_holdings(spark, d).select("name", holdings.clean_name(F.col("name")).alias("security")).distinct()


SHARES = "SELECT 'BRANDS' AS fund, p_brand AS security, p_brand AS symbol, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER () * 100, 4) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"
RANKED = "SELECT *, row_number() OVER (PARTITION BY fund ORDER BY weight DESC, security) AS rank FROM shares"


def brand_fund(spark, d) -> DataFrame:
    """The parts' brands as a fund, weighted by revenue."""
    lines, part = panel.table(spark, d, "lineitem"), panel.table(spark, d, "part")
    sums = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy("p_brand").agg(F.sum("l_extendedprice").alias("v"))
    return views.ranked_shares(sums.select(F.lit("BRANDS").alias("fund"), F.col("p_brand").alias("security"), F.col("p_brand").alias("symbol"), "v"))


#: Each brand as a fund of the types of its parts, by revenue.
TYPE_SHARES = "SELECT p_brand AS fund, p_type AS security, p_type AS symbol, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY p_brand) * 100, 4) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type"


def type_funds(spark, d) -> DataFrame:
    lines, part = panel.table(spark, d, "lineitem"), panel.table(spark, d, "part")
    sums = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy("p_brand", "p_type").agg(F.sum("l_extendedprice").alias("v"))
    return views.ranked_shares(sums.select(F.col("p_brand").alias("fund"), F.col("p_type").alias("security"), F.col("p_type").alias("symbol"), "v"))


def type_weights(spark, d) -> DataFrame:
    """(portfolio, ticker, w) of those funds."""
    return type_funds(spark, d).select(F.col("fund").alias("portfolio"), F.col("symbol").alias("ticker"), (F.col("weight") / 100).alias("w"))


@query("WITH s AS (SELECT fund, symbol, weight / 100 AS w FROM (" + TYPE_SHARES + ")), g AS (SELECT f.fund, t.symbol, coalesce(s.w, 0) AS w, coalesce(b.w, 0) AS w0 FROM (SELECT DISTINCT fund FROM s) f CROSS JOIN (SELECT DISTINCT symbol FROM s) t LEFT JOIN s ON s.fund = f.fund AND s.symbol = t.symbol LEFT JOIN s b ON b.fund = 'Brand#1' AND b.symbol = t.symbol)"
 " SELECT fund AS portfolio, count_if(w > 0)::BIGINT AS n_holdings, round(sum(w * w), 6) AS hhi, round(max(w), 6) AS max_weight, round(sum(abs(w - w0)), 6) AS turnover, round(1 / sum(w * w), 6) AS effective_n FROM g GROUP BY 1")
def exposure_metrics(spark, d):
    """Each brand's fund against one brand's."""
    w = type_weights(spark, d)
    return rounded(portfolio.exposure(w, w.where("portfolio = 'Brand#1'")))


@query("SELECT portfolio, ticker, round(w / sum(w) OVER (PARTITION BY portfolio), 4) AS w FROM (SELECT p_brand AS portfolio, p_name AS ticker, sum(p_retailprice) / sum(sum(p_retailprice)) OVER (PARTITION BY p_brand) AS w FROM part GROUP BY 1, 2) WHERE w >= 0.02")
def clean_weights(spark, d):
    """Of each brand, the part names that make up two hundredths of its list prices or more."""
    sums = panel.table(spark, d, "part").groupBy(F.col("p_brand").alias("portfolio"), F.col("p_name").alias("ticker")).agg(F.sum("p_retailprice").alias("v"))
    share = F.col("v") / F.sum("v").over(Window.partitionBy("portfolio"))
    return portfolio.clean_weights(sums.select("portfolio", "ticker", share.alias("w")), 0.02)


@query("WITH shares AS (" + TYPE_SHARES + ") SELECT fund AS portfolio, round(sum(weight) / max(total) * 100, 6) AS weight_pct, count(*)::BIGINT AS n_names, string_agg(symbol, ',' ORDER BY weight DESC, symbol) AS names FROM (SELECT *, sum(weight) OVER (PARTITION BY fund) AS total FROM shares) WHERE symbol IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY 1")
def theme_direct_weight(spark, d):
    return rounded(performance.direct_weight(type_weights(spark, d), ["ECONOMY", "SMALL", "PROMO"]))


@query(sql("SELECT fund, count(*)::BIGINT AS n_holdings, round(sum(weight), 4) AS total_weight_pct, round(sum(CASE WHEN rank <= 10 THEN weight ELSE 0 END), 4) AS top10_concentration_pct, round(sum(CASE WHEN rank <= 25 THEN weight ELSE 0 END), 4) AS top25_concentration_pct FROM ranked GROUP BY 1", shares=SHARES, ranked=RANKED))
def concentration(spark, d):
    return rounded(holdings.concentration(brand_fund(spark, d)), 4)


@query(sql("SELECT fund, symbol, round(weight / sum(weight) OVER (), 6) AS w, weight AS disclosed_weight, rank::INT AS rank FROM ranked WHERE rank <= 10", shares=SHARES, ranked=RANKED))
def look_through(spark, d):
    return rounded(holdings.look_through(brand_fund(spark, d), 10))


@query(f"WITH raw AS ({_RAW_SQL}), canon AS ({_CANON}) SELECT fund, count_if(rank <= 10 AND symbol IS NOT NULL)::BIGINT AS modeled_n, round(sum(CASE WHEN rank <= 10 THEN weight END), 6) AS modeled_weight_pct, round(sum(CASE WHEN rank <= 10 AND symbol IS NOT NULL THEN weight ELSE 0 END), 6) AS mapped_weight_pct, count(*)::BIGINT AS total_holdings, round(sum(weight), 6) AS total_disclosed_pct FROM canon GROUP BY 1")
def look_through_coverage(spark, d):
    return rounded(holdings.look_through_coverage(holdings.normalise(raw_holdings(spark, d)), 10))


@query("SELECT ticker, row_number() OVER (ORDER BY first)::INT AS pos FROM (SELECT p_brand AS ticker, min((p_size, p_partkey)) AS first FROM part GROUP BY 1)")
def benchmark_union(spark, d):
    """Brands in the order in which lists by size name them."""
    lists = panel.table(spark, d, "part").select(F.col("p_size").alias("src"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("ticker"))
    return holdings.ordered_union(lists)


@query(sql("SELECT p_brand AS key, min_by(p_name, p_partkey) AS name, round(sum(p_retailprice), 4) AS value, round(sum(p_retailprice) / sum(sum(p_retailprice)) OVER () * 100, 6) AS weight, 'all' AS fund FROM part GROUP BY 1"))
def merge_lots(spark, d):
    rows = panel.table(spark, d, "part").select(F.lit("all").alias("fund"), F.col("p_brand").alias("ticker"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("value"), F.col("p_partkey").alias("ord"))
    out = holdings.merge_lots(rows)
    return out.select("fund", "key", "name", F.round("value", 4).alias("value"), F.round("weight", 6).alias("weight"))


# what the display derives



@query(sql("SELECT s.ticker, round(h.var_hs, 6) AS var_hs, e.exception_count, round(e.exception_rate, 6) AS exception_rate, CASE WHEN e.exception_rate >= 3 THEN 'high' WHEN e.exception_rate >= 1.5 THEN 'elevated' ELSE 'normal' END AS exception_tier, row_number() OVER (ORDER BY (s.ticker <> 'NO')::INT, h.var_hs DESC NULLS LAST, s.ticker)::INT AS pos FROM (SELECT DISTINCT ticker FROM series) s JOIN (SELECT ticker, least(-max(CASE WHEN k = floor(n * 0.01) + 1 THEN r END) * 100, 100) AS var_hs FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY r) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM last1000) GROUP BY 1) h USING (ticker) JOIN (SELECT ticker, sum((-r * 100 > var)::INT)::BIGINT AS exception_count, sum((-r * 100 > var)::INT) / count(*) * 100 AS exception_rate FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS k FROM series) WHERE k <= 504 GROUP BY 1) e USING (ticker)", "last1000", ewma=ewma_sql(), series=SERIES))
def risk_table(spark, d):
    r = panel.returns(spark, d)
    rows = risk.var_es_hs(r).select("ticker", "var_hs").join(risk.var_exceptions(risk.var_series(r)), "ticker")
    rows = rows.withColumn("exception_tier", tier(F.col("exception_rate"), EXCEPTION_TIERS, "normal"))
    return rounded(views.sorted_table(rows, "var_hs", "ticker", pinned=[MARKET]))


@query(sql("SELECT c.dt, round(c.corr_60, 6) AS corr_60, CASE WHEN c.corr_60 >= 0.6 THEN 'strong' WHEN c.corr_60 >= 0.3 THEN 'moderate' WHEN c.corr_60 IS NOT NULL THEN 'weak' END AS tier FROM multi c", "returns", multi="SELECT * FROM (SELECT dt, row_number() OVER (ORDER BY dt) AS i, CASE WHEN row_number() OVER (ORDER BY dt) >= 60 THEN covar_samp(x, y) OVER w / (stddev_samp(x) OVER w * stddev_samp(y) OVER w) END AS corr_60 FROM (SELECT m.dt, m.r AS x, b.r AS y FROM returns m JOIN returns b ON m.dt = b.dt WHERE m.ticker = 'NO' AND b.ticker = 'AF') WINDOW w AS (ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE i >= 60 AND (i - 60) % 5 = 0"))
def correlation_tiers(spark, d):
    m = correlation.multi_window(panel.returns(spark, d), MARKET, BOND, (60,))
    return rounded(m.withColumn("tier", tier(F.col("corr_60"), CORRELATION_TIERS, "weak")))


_YEAR_SHARE = "(SELECT p_name AS ticker, sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER () AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = {} GROUP BY 1)"


@query(f"SELECT ticker, round(coalesce(b.w, 0), 6) AS w0, round(coalesce(a.w, 0), 6) AS w, round(coalesce(a.w, 0) - coalesce(b.w, 0), 6) AS delta FROM {_YEAR_SHARE.format(1997)} a FULL JOIN {_YEAR_SHARE.format(1996)} b USING (ticker) WHERE abs(coalesce(a.w, 0) - coalesce(b.w, 0)) >= 0.001")
def weight_deltas(spark, d):
    """How the revenue shares of part names changed from one year to the next."""
    lines, part = panel.table(spark, d, "lineitem"), panel.table(spark, d, "part")
    sums = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy(F.year("l_shipdate").alias("portfolio"), F.col("p_name").alias("ticker")).agg(F.sum("l_extendedprice").alias("v"))
    w = sums.withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("portfolio")))
    return rounded(views.weight_deltas(w.where("portfolio = 1997"), w.where("portfolio = 1996")))


@query("""SELECT ticker, c.class, metric, band FROM (SELECT p_brand AS ticker, p_type AS class FROM part GROUP BY 1, 2) c LEFT JOIN (SELECT p_type AS class, unnest(['price', 'size']) AS metric,
 unnest([floor(min(p_retailprice))::INT || ' to ' || floor(max(p_retailprice))::INT, min(p_size) || ' to ' || max(p_size)]) AS band FROM part WHERE p_type <> 'SMALL' GROUP BY 1) b ON b.class = c.class""")
def reference_bands(spark, d):
    """The usual prices and sizes of each type, one of which has none, told of the brands that hold it."""
    part = panel.table(spark, d, "part")
    band = lambda c: F.concat_ws(" to ", F.floor(F.min(c)).cast("int"), F.floor(F.max(c)).cast("int"))
    bands = part.where("p_type <> 'SMALL'").groupBy(F.col("p_type").alias("class")).agg(F.create_map(F.lit("price"), band("p_retailprice"), F.lit("size"), band("p_size")).alias("bands"))
    return views.reference_bands(part.select(F.col("p_brand").alias("ticker"), F.col("p_type").alias("class")).distinct(), bands)


@query(sql("SELECT year, round(-min_var, 6) AS best, round(-max_var, 6) AS worst, CASE WHEN ret < 0 THEN round(ret, 6) END AS loss FROM (SELECT year(dt)::INT AS year, min(var) AS min_var, max(var) AS max_var FROM series WHERE ticker = 'NO' GROUP BY 1 HAVING count(*) >= 20) LEFT JOIN (SELECT year, (px / lag(px) OVER (ORDER BY year) - 1) * 100 AS ret FROM (SELECT year(dt) AS year, max_by(px, dt) AS px FROM filled WHERE ticker = 'NO' AND px IS NOT NULL GROUP BY 1)) USING (year) WHERE year >= 1997", "returns", ewma=ewma_sql(), series=SERIES))
def loss_history(spark, d):
    filled = panel.fill(panel.prices(spark, d)).where((F.col("ticker") == MARKET) & F.col("px").isNotNull())
    r = panel.log_returns(filled)
    return rounded(views.loss_history(risk.yearly(risk.var_series(r), filled, panel.volatility_index(r)), 1997))


@query(sql("SELECT round(y10, 6) AS y10, round(y3m, 6) AS y3m, round(y10 - y3m, 6) AS spread FROM (SELECT CASE WHEN a > 30 THEN a / 10 ELSE a END AS y10, CASE WHEN b > 30 THEN b / 10 ELSE b END AS y3m FROM (SELECT max_by(px, dt) FILTER (ticker = 'NO') AS a, max_by(px, dt) FILTER (ticker = 'AF') AS b FROM filled))", "filled"))
def yield_spread(spark, d):
    return rounded(views.yield_spread(panel.fill(panel.prices(spark, d)), MARKET, BOND))


@query(sql("SELECT ticker, round(v, 6) AS vol_60, round(beta, 6) AS beta FROM (SELECT ticker, CASE WHEN count(*) = 60 THEN stddev_samp(r) * sqrt(252.0) * 100 END AS v FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS k FROM returns) WHERE k <= 60 GROUP BY 1) JOIN (SELECT ticker, covar_samp(p, b) / var_samp(b) AS beta FROM (SELECT r.ticker, r.r AS p, m.r AS b, row_number() OVER (PARTITION BY r.ticker ORDER BY r.dt DESC) AS k FROM returns r JOIN market m USING (dt)) WHERE k <= 252 GROUP BY 1) USING (ticker)", "market"))
def risk_profile(spark, d):
    r = panel.returns(spark, d)
    return rounded(sections.risk_profile(r, r.where(F.col("ticker") == MARKET)))


_MARKS = {"60/40": panel.BENCHMARK, "broken": {MARKET: 0.5, "ZZ": 0.5}}


@query(sql("SELECT portfolio, ticker, w FROM marks m WHERE NOT EXISTS (SELECT 1 FROM marks x WHERE x.portfolio = m.portfolio AND x.ticker NOT IN (SELECT ticker FROM returns))", "returns", marks=_v([(p, t, w) for p, own in _MARKS.items() for t, w in own.items()], "portfolio, ticker, w")))
def complete_benchmarks(spark, d):
    marks = panel.weights(spark, _MARKS)
    return sections.complete_benchmarks(marks, panel.returns(spark, d)).select("portfolio", "ticker", "w")


SOURCES = [("h1", "survey", 0.2), ("h1", "market", 0.1)]


@query(sql("SELECT DISTINCT portfolio, id, CASE WHEN id = 'h1' THEN 'market:0.1,survey:0.2' ELSE '' END AS probabilities FROM parts", "books", **_HYPO))
def scenario_probabilities(spark, d):
    listed = sections.with_probabilities(scenarios.totals(hypo_parts(spark, d)), spark.createDataFrame(SOURCES, "id string, source string, probability double"))
    text = F.array_join(F.transform("probabilities", lambda x: F.concat(x["source"], F.lit(":"), x["probability"].cast("string"))), ",")
    return listed.select("portfolio", "id", text.alias("probabilities"))
