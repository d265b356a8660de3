"""Queries on estimators: regressions with SQL by normal equations, and iterative ones that SQL can't express, which tests hold
against closed forms, invariants and simulated parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions
from ..operators import backtest, correlation, factors, models, optimizer, performance, portfolio, sections, views
from ..sources import panel, sinks
from ..sources.panel import BOND, MARKET, THEME, sql
from . import factor_sql
from .book_queries import book, pairs
from .registry import query, rounded


def factor_panel(spark, d) -> DataFrame:
    """(dt, six factors, rf) from orders: mean and differences of the priorities' returns, and of two segments'."""
    r = panel.log_returns(panel.fill(panel.order_prices(spark, d)))
    place = F.row_number().over(Window.orderBy("ticker"))  # of a handful of priorities
    wide = r.join(r.select("ticker").distinct().withColumn("k", place), "ticker").groupBy("dt").agg(*[F.max(F.when(F.col("k") == k, F.col("r"))).alias(f"c{k}") for k in range(1, 6)])
    c = [F.col(f"c{k}") for k in range(1, 6)]
    orders, customers = panel.table(spark, d, "orders"), panel.table(spark, d, "customer")
    seg = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    seg = seg.groupBy(F.col("c_mktsegment").alias("ticker"), F.col("o_orderdate").cast("date").alias("dt")).agg(panel.damped(F.avg("o_totalprice")).alias("px"))
    s = panel.log_returns(panel.fill(seg)).groupBy("dt").agg((F.sum(F.when(F.col("ticker") == "BUILDING", F.col("r"))) - F.sum(F.when(F.col("ticker") == "MACHINERY", F.col("r")))).alias("mom"))
    base = wide.select("dt", ((c[0] + c[1] + c[2] + c[3] + c[4]) / 5).alias("mkt"), (c[0] - c[1]).alias("smb"), (c[1] - c[2]).alias("hml"), (c[2] - c[3]).alias("rmw"), (c[3] - c[4]).alias("cma"))
    return base.join(s, "dt").withColumn("rf", F.lit(0.0001)).where("mkt IS NOT NULL AND mom IS NOT NULL")


def asset_models(spark, d, *which: str) -> DataFrame:
    return models.asset_models(panel.returns(spark, d), which=which)


@query()
def var_es_garch(spark, d):
    return rounded(asset_models(spark, d, "garch").drop("n"))


@query()
def var_es_gjr(spark, d):
    return rounded(asset_models(spark, d, "gjr").drop("n"))


@query()
def var_es_evt(spark, d):
    return rounded(asset_models(spark, d, "evt").drop("n"))


@query()
def var_year_t(spark, d):
    return rounded(asset_models(spark, d, "year").drop("n"))


@query()
def asset_risk(spark, d):
    filled = panel.fill(panel.prices(spark, d))
    return rounded(sections.risk_rows(panel.log_returns(filled), filled))


@query()
def portfolio_rows(spark, d):
    nav = panel.prices(spark, d).where(F.col("ticker") == THEME).select(F.lit("B").alias("portfolio"), "dt", "px")
    return rounded(sections.portfolio_rows(panel.returns(spark, d), panel.weights(spark), nav))


@query()
def benchmark_row(spark, d):
    r = panel.returns(spark, d)
    marks = panel.weights(spark, {"60/40": panel.BENCHMARK, "broken": {MARKET: 0.5, "ZZ": 0.5}})
    return rounded(sections.portfolio_rows(r, sections.complete_benchmarks(marks, r)))


@query()
def asset_table(spark, d):
    filled = panel.fill(panel.prices(spark, d))
    r, w = panel.log_returns(filled), panel.weights(spark)
    return rounded(sections.asset_table(w, sections.risk_rows(r, filled), portfolio.component_var(r, w)))


@query()
def sector_view(spark, d):
    """The sections of the sector view as one document."""
    r = panel.returns(spark, d)
    market = r.where(F.col("ticker") == MARKET)
    return sinks.document(sections.sector_view(r, market, factor_panel(spark, d), [MARKET, THEME, BOND, "AO"]), "2001-11-04")


@query()
def garch_residuals(spark, d):
    return rounded(models.garch_residuals(panel.returns(spark, d)))


#: The likelihood and its score by their definition, one return after the other.
LIKELIHOOD = sql("""SELECT ticker, model, n, round(n * (lgamma(4.5) - lgamma(4) - 0.5 * ln(pi() * 6)) - sum(0.5 * ln(h) + 4.5 * ln(1 + z)), 6) AS loglik,
 round(sum(s * dm + 9 * e / (h * 6 * (1 + z))), 3) AS d_mu, round(sum(s * dw), 3) AS d_omega, round(sum(s * da), 3) AS d_alpha, round(sum(s * dg), 3) AS d_gamma, round(sum(s * db), 3) AS d_beta,
 round(sum(0.5 * (2 * (1 + 1/3.0 + 0.2 + 1/7.0) - 2 * ln(2) - (1 + 0.5 + 1/3.0) - 1/6.0) - 0.5 * ln(1 + z) + 0.75 * z / (1 + z)), 3) AS d_nu, TRUE AS no_worse, TRUE AS stationary
 FROM (SELECT *, (9 * z / (1 + z) - 1) / (2 * h) AS s FROM (SELECT *, e * e / (h * 6) AS z FROM walk)) GROUP BY ticker, model, n""", "last1000",
 x="""SELECT ticker, model, g, n, i, 0.05 AS a, 0.9 AS b, v * (1 - 0.95 - g / 2) AS w, r - m AS e FROM (SELECT ticker, 100 * r AS r, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i,
 count(*) OVER (PARTITION BY ticker) AS n, avg(100 * r) OVER (PARTITION BY ticker) AS m, var_pop(100 * r) OVER (PARTITION BY ticker) AS v FROM last1000) CROSS JOIN (VALUES ('garch', 0.0::DOUBLE), ('gjr', 0.04::DOUBLE)) k(model, g)""",
 first="SELECT ticker, model, sum(pow(0.94, i) * e * e) / sum(pow(0.94, i)) AS h0, -2 * sum(pow(0.94, i) * e) / sum(pow(0.94, i)) AS m0 FROM x WHERE i < 75 GROUP BY ALL",
 walk="""SELECT x.ticker, x.model, n, i, e, g, a, b, w, h0::DOUBLE AS h, m0::DOUBLE AS dm, 0::DOUBLE AS dw, 0::DOUBLE AS da, 0::DOUBLE AS dg, 0::DOUBLE AS db FROM x JOIN first USING (ticker, model) WHERE i = 0
 UNION ALL SELECT x.ticker, x.model, x.n, x.i, x.e, x.g, x.a, x.b, x.w, p.w + (p.a + p.g * (p.e < 0)::INT) * p.e * p.e + p.b * h, -2 * p.e * (p.a + p.g * (p.e < 0)::INT) + p.b * dm, 1 + p.b * dw,
 p.e * p.e + p.b * da, (p.e < 0)::INT * p.e * p.e + p.b * dg, h + p.b * db FROM walk p JOIN x ON x.ticker = p.ticker AND x.model = p.model AND x.i = p.i + 1""").replace("WITH ", "WITH RECURSIVE ", 1)


@query(LIKELIHOOD)
def garch_likelihood(spark, d):
    """The likelihood and score that the fits of both models climb, and whether the fits end where it is highest."""
    out = models.garch_likelihood(panel.returns(spark, d))
    return out.withColumns({"loglik": F.round("loglik", 6), **{c: F.round(c, 3) for c in out.columns if c.startswith("d_")}})


@query()
def anomaly_view(spark, d):
    return rounded(sections.anomaly_view(panel.returns(spark, d)).withColumn("detectors", F.concat_ws(",", "detectors")))


def _tested(spark, d, model: str) -> DataFrame:
    f = models.rolling_forecasts(panel.weekdays(book(spark, d)), model).withColumn("model", F.lit(model.upper()))
    return rounded(models.backtest_tests(backtest.record(backtest.violations(f), ["portfolio", "model"])))


@query()
def backtest_evt(spark, d):
    return _tested(spark, d, "evt")


@query()
def backtest_garch(spark, d):
    return _tested(spark, d, "garch")


@query()
def backtest_gjr(spark, d):
    return _tested(spark, d, "gjr")


@query()
def qmle_corr(spark, d):
    return rounded(models.daily_qmle(correlation.paired_bars(panel.bars(spark, d), "view", "click")))


#: The innovations of each day one after the other.
INNOVATIONS = sql("""SELECT ticker, dt, theta, count(*)::INT AS n, round(count(*) * ln(sum(u * u / v) / count(*)) + sum(ln(v)), 6) AS loss, round(sum(u * u / v) / count(*), 6) AS variance FROM walk WHERE n >= 2 GROUP BY ticker, dt, theta""", "bars",
 steps="SELECT *, row_number() OVER (PARTITION BY ticker, dt ORDER BY ts) AS i, count(*) OVER (PARTITION BY ticker, dt) AS n FROM (SELECT ticker, ts::DATE AS dt, ts, ln(px / lag(px) OVER (PARTITION BY ticker, ts::DATE ORDER BY ts)) * 100 AS x FROM bars) WHERE x IS NOT NULL",
 walk="""SELECT ticker, dt, theta, n, i, x AS u, 1 + theta * theta AS v FROM steps CROSS JOIN (VALUES (-0.6::DOUBLE), (0.2)) t(theta) WHERE i = 1
 UNION ALL SELECT s.ticker, s.dt, theta, s.n, s.i, s.x - theta / v * u, 1 + theta * theta - theta * theta / v FROM walk w JOIN steps s ON s.ticker = w.ticker AND s.dt = w.dt AND s.i = w.i + 1""").replace("WITH ", "WITH RECURSIVE ", 1)


@query(INNOVATIONS)
def ma1_likelihood(spark, d):
    """The likelihood that the noise-robust correlation searches, for each type of events and day."""
    bars = panel.bars(spark, d).withColumn("dt", F.to_date("ts"))
    before = F.lag("px").over(Window.partitionBy("ticker", "dt").orderBy("ts"))
    rows = bars.withColumn("x", F.ln(F.col("px") / before) * 100).where("x IS NOT NULL").select("ticker", "dt", "ts", "x")
    return rounded(models.ma1_likelihood(rows, (-0.6, 0.2)))


@query(factor_sql.RECESSION)
def recession_probability(spark, d):
    return rounded(models.recession_probability(views.yield_spread(panel.fill(panel.prices(spark, d)), MARKET, BOND)))


@query()
def factor_ols(spark, d):
    return rounded(factors.factor_ols(panel.returns(spark, d), factor_panel(spark, d)))


@query(factor_sql.BETAS)
def factor_betas(spark, d):
    out = factors.factor_ols(panel.returns(spark, d), factor_panel(spark, d), draws=0)
    return rounded(out.drop("boot_se", "ci_low", "ci_high"))


@query(factor_sql.CASCADE)
def factor_cascade(spark, d):
    return rounded(factors.cascade(panel.returns(spark, d), factor_panel(spark, d)))


@query(factor_sql.DECOMPOSITION)
def factor_decomposition(spark, d):
    return rounded(factors.decomposition(panel.returns(spark, d), panel.weights(spark), factor_panel(spark, d)))


@query(factor_sql.BRIDGE)
def factor_bridge(spark, d):
    return rounded(factors.bridge(panel.returns(spark, d), panel.weights(spark), factor_panel(spark, d)), 10)


@query(factor_sql.ROLLING)
def rolling_loadings(spark, d):
    return rounded(factors.rolling_loadings(panel.returns(spark, d), factor_panel(spark, d)))


@query(factor_sql.LOADING_DRIFT)
def loading_drift(spark, d):
    points = factors.rolling_loadings(panel.returns(spark, d), factor_panel(spark, d)).withColumn("key", F.concat_ws("/", "ticker", "factor"))
    return rounded(performance.drift(points, "key", "loading"))


@query(factor_sql.THEMATIC)
def thematic(spark, d):
    return rounded(factors.thematic(panel.returns(spark, d), [MARKET, THEME, BOND, "AO"]))


@query()
def skill_vs_luck(spark, d):
    return rounded(models.skill_or_luck(pairs(spark, d)))


@query(factor_sql.SKILL)
def skill_ratio(spark, d):
    """What of skill_vs_luck doesn't rest on random draws."""
    return rounded(models.skill_or_luck(pairs(spark, d), draws=200).select("portfolio", "n_obs", "years", "information_ratio", "t_stat", "psr_pct"))


@query(factor_sql.SHRUNK)
def shrunk_covariance(spark, d):
    out = optimizer.shrunk_covariance(panel.returns(spark, d))
    return out.withColumns({"cov": F.round("cov", 8), "shrinkage": F.round("shrinkage", 6)})


@query()
def optimizer_variants(spark, d):
    return rounded(optimizer.variants(panel.returns(spark, d), panel.weights(spark), MARKET))


@query()
def frontier(spark, d):
    return rounded(optimizer.frontier(panel.returns(spark, d), panel.weights(spark), MARKET))


@query(factor_sql.LINE)
def critical_line(spark, d):
    """Weights on the critical line, and that none of them could gain by a transfer."""
    out = optimizer.line_weights(panel.returns(spark, d), panel.weights(spark), MARKET, factor_sql.RATES)
    return rounded(out.select("portfolio", "t", "ticker", "w", (F.col("slack") < 1e-7).alias("optimal")))


@query(factor_sql.PARITY)
def risk_parity(spark, d):
    return rounded(optimizer.equal_risk(panel.returns(spark, d), panel.weights(spark), MARKET))


#: Student's distribution in closed form for whole degrees of freedom, and the normal and chi-squared ones by series.
_STUDENT = """CASE WHEN nu % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, nu // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(th), 2 * j)))
 ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (nu - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos(th), 2 * j + 1))), 0)) END"""
TAILS = f"""SELECT p_partkey, nu, round(0.5 + a / 2, 7) AS t_cdf, round(1 - abs(a), 7) AS t_p, round({factor_sql.normal_probability('x')}, 7) AS normal_cdf, round(2 * (1 - ({factor_sql.normal_probability('abs(x)')})), 7) AS chi2_tail
 FROM (SELECT *, {_STUDENT} AS a FROM (SELECT p_partkey, x, nu, atan(x / sqrt(nu)) AS th FROM (SELECT p_partkey, (p_partkey % 101 - 50) / 12.0::DOUBLE AS x, p_size::INT AS nu FROM part)))"""


@query(TAILS)
def distribution_tails(spark, d):
    """Student's, the normal and the chi-squared distribution at points and degrees of freedom that parts tell."""
    point = (F.col("p_partkey") % 101 - 50) / F.lit(12.0)
    rows = panel.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("nu"), point.alias("x"))
    x, nu = F.col("x"), F.col("nu")
    told = distributions.at_points(rows, ["x", "nu"], t_cdf=distributions.t_cdf(x, nu), t_p=distributions.t_two_sided(x, nu), normal_cdf=distributions.normal_cdf(x), chi2_tail=distributions.chi2_tail(x * x))
    return rounded(told.drop("x"), 7)


#: Points between which a quantile lies, told by the distribution in closed form on a grid of thousandths.
QUANTILES = f"""SELECT nu, p, max(x) FILTER (0.5 + a / 2 <= p) AS below FROM (SELECT *, {_STUDENT} AS a FROM (SELECT nu, x, atan(x / sqrt(nu)) AS th FROM (SELECT DISTINCT p_size::INT AS nu FROM part)
 CROSS JOIN (SELECT (k - 13000) / 1000.0::DOUBLE AS x FROM range(26001) r(k)))) CROSS JOIN (VALUES (0.05::DOUBLE), (0.2), (0.6), (0.975)) v(p) GROUP BY nu, p"""


@query(QUANTILES)
def t_quantiles(spark, d):
    """Quantiles of Student's distribution for the degrees of freedom that parts tell, down to the thousandth."""
    rows = panel.table(spark, d, "part").select(F.col("p_size").cast("int").alias("nu")).distinct().withColumn("p", F.explode(F.array(*[F.lit(p) for p in (0.05, 0.2, 0.6, 0.975)])))
    return rows.select("nu", "p", (F.floor(distributions.t_quantile(F.col("p"), F.col("nu")) * 1000) / 1000).alias("below"))
