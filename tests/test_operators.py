from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinrisk.functions import numerics as nm
from skeinrisk.functions.columns import correlation
from skeinrisk.operators import asof, backtest, detectors, factors, gram, models, optimizer, performance, portfolio, risk, scenarios
from skeinrisk.sources import panel

DAY = dt.date(1990, 1, 1)


def series(spark, r, ticker="A", key="ticker"):
    return spark.createDataFrame([(ticker, DAY + dt.timedelta(k), float(x)) for k, x in enumerate(r)], f"{key} string, dt date, r double")


@pytest.mark.parametrize("n", [29, 30, 700])
def test_ewma_is_the_recursion(spark, n):
    r = np.random.default_rng(n).standard_t(4, n) * 0.01
    v = np.var(r[:30]) if n >= 30 else r[0] ** 2
    for x in r:
        v = 0.06 * x * x + 0.94 * v
    assert risk.ewma_variance(series(spark, r)).first()["v"] == pytest.approx(v, rel=1e-12)


def test_ewma_series_is_the_recursion_over_blocks(spark, monkeypatch):
    r = np.random.default_rng(0).standard_t(4, 1500) * 0.01
    monkeypatch.setattr(risk, "BLOCK", 400)
    got = {x["i"]: x["v"] for x in risk.ewma_series(series(spark, r)).collect()}
    v = np.var(r[:252])
    for k, x in enumerate(r):
        assert got[k] == pytest.approx(v, rel=1e-9)
        v = 0.06 * x * x + 0.94 * v


def test_a_series_longer_than_a_prefix_sum_can_hold(spark):
    r = np.random.default_rng(1).normal(size=13_000) * 0.01
    last = risk.ewma_series(series(spark, r)).where("i = 12999").first()["v_next"]
    v = 0.0
    for x in r[-2000:]:
        v = 0.06 * x * x + 0.94 * v
    assert last == pytest.approx(v, rel=1e-9)


@pytest.mark.parametrize("n", [1503, 1504])
def test_risk_level_needs_its_history(spark, n):
    r = np.random.default_rng(2).normal(size=n) * 0.01
    level = risk.risk_level(series(spark, r)).first()["risk_level"]
    if n < 1504:
        assert level == 0.5
        return

    def after(chunk):
        v = np.var(chunk[:30])
        for x in chunk:
            v = 0.06 * x * x + 0.94 * v
        return v

    past = [after(r[max(0, e - 1000) : e]) for e in range(n - 504 + 1, n + 1)]
    assert level == pytest.approx(np.mean(np.array(past) <= past[-1]), abs=1e-9)


def test_historical_simulation_takes_the_eleventh_worst(spark):
    r = np.random.default_rng(3).normal(size=1200) * 0.01
    s = np.sort(r[-1000:])
    row = risk.var_es_hs(series(spark, r)).first()
    assert row["var_hs"] == pytest.approx(-s[10] * 100) and row["es_hs"] == pytest.approx(-s[:11].mean() * 100)


def test_constant_and_short_series(spark):
    flat = series(spark, [0.0] * 300)
    assert risk.var_es_ewma(flat).first()["var_ewma"] == 0
    assert detectors.z_scores(flat).where("z IS NOT NULL").count() == 0
    assert risk.hill_tail_index(flat).count() == 0 and risk.monthly_downside(flat).count() == 0
    assert flat.agg(correlation(F.col("r"), F.col("r")).alias("c")).first()["c"] is None
    assert risk.var_series(series(spark, [0.01] * 252)).count() == 0


def test_cusum_is_the_reflected_walk_and_holds_at_nulls(spark):
    z = np.random.default_rng(4).normal(size=400)
    z[300:] += 1
    rows = [("A", DAY + dt.timedelta(k), None if k % 50 == 7 else float(x)) for k, x in enumerate(z)]
    out = detectors.cusum(spark.createDataFrame(rows, "ticker string, dt date, z double")).orderBy("dt").collect()
    up = down = 0.0
    for k, row in enumerate(out):
        x = rows[k][2]
        if k and x is not None:
            up, down = max(0.0, up + x - 0.5), min(0.0, down + x + 0.5)
        assert row["cusum_pos"] == pytest.approx(up, abs=1e-9) and row["cusum_neg"] == pytest.approx(down, abs=1e-9)
    assert up > 5


def test_component_var_sums_to_the_books(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(size=(400, 3)) * 0.01
    df = spark.createDataFrame([(t, DAY + dt.timedelta(k), float(r[k, j])) for k in range(400) for j, t in enumerate("abc")], "ticker string, dt date, r double")
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    out = {x["ticker"]: x["component_var"] for x in portfolio.component_var(df, panel.weights(spark, {"P": w})).collect()}
    s = np.cov(r.T)
    for x in r:
        s = 0.06 * np.outer(x, x) + 0.94 * s
    v = np.array(list(w.values()))
    want = v * (s @ v) / math.sqrt(v @ s @ v) * 2.3263478740408408 * 100
    assert [out[t] for t in "abc"] == pytest.approx(list(want), rel=1e-9)
    assert portfolio.component_var(df, panel.weights(spark, {"P": {"a": 1.0}})).count() == 0


def test_missing_tickers_and_gaps(spark):
    rows = [("a", DAY + dt.timedelta(k), 100.0 + k) for k in range(5)] + [("b", DAY + dt.timedelta(2), 50.0)]
    filled = panel.fill(spark.createDataFrame(rows, "ticker string, dt date, px double"), spark.createDataFrame([("a",), ("b",), ("c",)], "ticker string"))
    got = {(r["ticker"], r["dt"].day): r["px"] for r in filled.collect()}
    assert got["b", 1] is None and got["b", 5] == 50 and all(got["c", d] is None for d in range(1, 6))


def violations(spark, v):
    return spark.createDataFrame([("P", "M", DAY + dt.timedelta(k), int(x)) for k, x in enumerate(v)], "portfolio string, model string, dt date, v int")


@pytest.mark.parametrize(("v", "kupiec", "christoffersen"), [([0] * 500, -2 * 500 * math.log(0.99), None), ([1] * 50, -2 * 50 * math.log(0.01), None), ([0] * 99 + [1], 0.0, None), ([0, 1] * 50, "big", "big"), ([0] * 90 + [1] * 10, "big", "big")])
def test_coverage_tests(spark, v, kupiec, christoffersen):
    c = backtest.counts(violations(spark, v), ["portfolio", "model"])
    row = c.select(backtest.kupiec(F.col("n"), F.col("x")).alias("k"), backtest.christoffersen(*map(F.col, ("n00", "n01", "n10", "n11"))).alias("c")).first()
    for got, want in ((row["k"], kupiec), (row["c"], christoffersen)):
        assert got is None if want is None else got > backtest.CHI2_95 if want == "big" else got == pytest.approx(want, abs=1e-9)


def test_asof_takes_the_latest_before(spark):
    days = lambda ks: [DAY + dt.timedelta(k) for k in ks]
    left = spark.createDataFrame([(d, k) for k, d in enumerate(days([0, 3, 5, 9]))], "dt date, k int")
    right = spark.createDataFrame([(d, float(k)) for k, d in enumerate(days([1, 3, 7]))], "dt date, v double")
    assert [r["v"] for r in asof.backward(left, right, "v").orderBy("k").collect()] == [None, 1.0, 1.0, 2.0]


def test_shocks_resolve_in_order(spark):
    tree = spark.createDataFrame([("root", "root"), ("eq", "root"), ("us", "eq"), ("em", "eq")], "class string, parent string")
    sec = spark.createDataFrame([("a", "us", "tech", None), ("b", "em", None, None), ("c", None, None, {"us": 0.5, "bonds": 0.5}), ("d", "us", None, None), ("e", "bonds", None, None), ("f", "us", None, None)], "ticker string, class string, sector string, blend map<string,double>")
    shocks = spark.createDataFrame([("s", "eq", -0.2), ("s", "em", -0.3), ("s", "tech", -0.4)], "id string, category string, shock double")
    over = spark.createDataFrame([("s", "f", 0.9)], "id string, ticker string, shock double")
    got = {r["ticker"]: (r["shock"], r["path"]) for r in scenarios.resolve(sec, tree, shocks, over).collect()}
    assert got == {"a": (-0.4, "sector"), "b": (-0.3, "class"), "c": (-0.2, "blend"), "d": (-0.2, "class"), "f": (0.9, "override")}


def panel_of(spark, n=700, seed=6):
    rng = np.random.default_rng(seed)
    f = rng.normal(size=(n, 6)) * 0.01
    b = rng.normal(size=(3, 6))
    r = f @ b.T + rng.normal(size=(n, 3)) * 0.004
    days = [DAY + dt.timedelta(k) for k in range(n)]
    returns = spark.createDataFrame([(t, days[k], float(r[k, j])) for k in range(n) for j, t in enumerate("abc")], "ticker string, dt date, r double")
    fac = spark.createDataFrame([(days[k], *map(float, f[k]), 0.0) for k in range(n)], "dt date, mkt double, smb double, hml double, rmw double, cma double, mom double, rf double")
    return returns, fac, b


def test_factor_identities(spark):
    returns, fac, b = panel_of(spark)
    fit = {(r["ticker"], r["factor"]): r for r in factors.factor_ols(returns, fac).collect()}
    assert fit["a", "mkt"]["beta"] == pytest.approx(b[0, 0], abs=0.1) and fit["a", "mkt"]["ci_low"] < b[0, 0] < fit["a", "mkt"]["ci_high"]
    steps = [r for r in factors.cascade(returns, fac).collect() if r["ticker"] == "a"]
    assert sum(r["incr_var_pct"] for r in steps) == pytest.approx(100 * fit["a", "mkt"]["r2"], abs=1e-6)
    w = panel.weights(spark, {"P": {"a": 0.5, "b": 0.3, "c": 0.2}})
    parts = factors.decomposition(returns, w, fac).collect()
    assert sum(r["total_contrib_pct"] for r in parts if r["kind"] == "holding") == pytest.approx(100, abs=1e-6)
    assert sum(r["factor_contrib_pct"] for r in parts if r["kind"] == "factor") == pytest.approx(100, abs=1e-6)
    moves = factors.bridge(returns, w, fac).collect()
    assert sum(r["share_pct"] for r in moves) == pytest.approx(100, abs=1e-6) and sum(r["dominant"] for r in moves) == 1
    assert sum(r["vol_points"] for r in moves) == pytest.approx(moves[0]["vol_now_pct"] - moves[0]["vol_then_pct"], abs=1e-9)
    assert factors.factor_ols(returns.where("dt < '1990-02-01'"), fac).count() == 0
    loads = factors.rolling_loadings(returns, fac).where("ticker = 'a' AND factor = 'mkt'").collect()
    assert len(loads) == len(range(252, 700, 21))


def test_theme_fit_is_least_squares(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=300) * 0.01
    s = 0.8 * m + rng.normal(size=300) * 0.01
    y = 1.1 * m + 0.3 * s + rng.normal(size=300) * 0.005
    df = spark.createDataFrame([("P", DAY + dt.timedelta(k), *map(float, (y[k], m[k], s[k]))) for k in range(300)], "portfolio string, dt date, y double, m double, s double")
    row = performance.theme_now(df).first()
    y, m, s = y[-252:], m[-252:], s[-252:]
    rest = s - np.cov(s, m)[0, 1] / np.var(m, ddof=1) * m
    z = np.column_stack([np.ones(252), m, rest])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ beta
    se = math.sqrt(e @ e / 249 * np.linalg.inv(z.T @ z)[2, 2])
    assert (row["beta_market"], row["beta_theme"], row["t_theme"]) == pytest.approx((beta[1], beta[2], beta[2] / se), rel=1e-9)


def test_skill_verdicts(spark):
    rng = np.random.default_rng(8)
    rows = lambda edge: [("P", DAY + dt.timedelta(k), float(x), 0.0) for k, x in enumerate(rng.normal(size=800) * 0.01 + edge)]
    schema = "portfolio string, dt date, p double, b double"
    assert models.skill_or_luck(spark.createDataFrame(rows(0.003), schema)).first()["verdict"] == "Skill likely"
    none = models.skill_or_luck(spark.createDataFrame(rows(-0.001), schema)).first()
    assert none["verdict"] == "Cannot reject luck" and sum(none["hist_counts"]) == 4000
    assert models.skill_or_luck(spark.createDataFrame(rows(0)[:100], schema)).count() == 0


def test_rolling_forecasts_cover_each_row_once(spark):
    r = np.random.default_rng(9).standard_t(5, 500) * 0.01
    s = series(spark, r, "P", "portfolio")
    out = models.rolling_forecasts(s, "evt", lookback=300, chunk=64).orderBy("dt").collect()
    assert [x["dt"] for x in out] == [DAY + dt.timedelta(k) for k in range(301, 500)]
    from skeinrisk.functions.numerics import var_es_evt

    assert out[70]["var"] == pytest.approx(var_es_evt(r[71:371])[0], rel=1e-9)
    assert models.rolling_forecasts(s.where("dt < '1990-11-20'"), "evt", lookback=300).count() == 0


def test_garch_residuals_are_standardised(spark):
    r = np.random.default_rng(10).standard_t(6, 800) * 0.01
    z = [x["residual"] for x in models.garch_residuals(series(spark, r)).collect()]
    assert len(z) == 800 and np.std(z) == pytest.approx(1, abs=0.15)


def test_taxonomies_are_walked_to_the_root(spark):
    """A shock on the root of a chain of nine classes reaches its leaf; a circle is an error."""
    chain = [(f"c{k}", f"c{max(k - 1, 0)}") for k in range(9)]
    tree = spark.createDataFrame(chain, "class string, parent string")
    assert {(r["ancestor"], r["depth"]) for r in scenarios.closure(tree).where("class = 'c8'").collect()} == {(f"c{k}", 8 - k) for k in range(9)}
    with pytest.raises(ValueError, match="circle"):
        scenarios.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "class string, parent string"))


def test_as_of_values_cross_blocks(spark):
    left = [(1, "x", 70), (2, "x", 5), (3, "y", 400), (4, "x", 200), (5, "x", -3)]
    right = [("x", 0, 1.0), ("x", 60, 2.0), ("x", 61, None), ("y", 390, 3.0), ("y", 401, 4.0)]
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    a = spark.createDataFrame([(i, b, day(k)) for i, b, k in left], "i int, b string, dt date")
    c = spark.createDataFrame([(b, day(k), v) for b, k, v in right], "b string, dt date, v double")
    assert {r["i"]: r["v"] for r in asof.backward(a, c, "v", by=["b"]).collect()} == {1: 2.0, 2: 1.0, 3: 3.0, 4: 2.0, 5: None}
    assert {r["i"]: r["v"] for r in asof.backward(a, c.where("b = 'x'"), "v").collect()} == {1: 2.0, 2: 1.0, 3: 2.0, 4: 2.0, 5: None}


def plain_shrunk(x):
    n, k = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / k
    d2 = float(((s - mu * np.eye(k)) ** 2).sum())
    b2 = min(float(((c * c).T @ (c * c) / n - s * s).sum()) / n, d2)
    shrink = b2 / d2 if d2 > 0 else 0.0
    return 252 * ((1 - shrink) * s + shrink * mu * np.eye(k)), shrink


def test_blocked_sums_match_one_matrix(spark, monkeypatch):
    monkeypatch.setattr(gram, "BLOCK_DAYS", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)) * 0.01
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=3 * k) for k in range(90)]
    rows = [(f"t{j}", d, float(x[i, j])) for i, d in enumerate(days) for j in range(5) if not (i in (4, 50) and j == 2)]
    r = spark.createDataFrame(rows, "ticker string, dt date, r double")
    whole = np.delete(x, [4, 50], 0)
    for window in (1000, 30):
        want, shrink = plain_shrunk(whole[-window:])
        got = optimizer.shrunk_covariance(r, window).collect()
        assert len(got) == 25 and all(g["cov"] == pytest.approx(want[int(g["a"][1]), int(g["b"][1])], rel=1e-9) and g["shrinkage"] == pytest.approx(shrink) for g in got)
    plan = optimizer.shrunk_covariance(r)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan


def test_frontier_and_line_of_one_book(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) * 0.01 + np.array([1, 2, 3, 4]) * 1e-4
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(400)]
    r = spark.createDataFrame([(f"t{j}", d, float(x[i, j])) for i, d in enumerate(days) for j in range(4)], "ticker string, dt date, r double")
    w = spark.createDataFrame([("p", f"t{j}", 0.25, j) for j in range(4)], "portfolio string, ticker string, w double, ord int")
    points = optimizer.frontier(r, w, "t0", 10).orderBy("k").collect()
    assert points[0]["k"] == 0 and all(b["vol"] >= a["vol"] - 1e-9 and b["ret"] > a["ret"] for a, b in zip(points, points[1:]))
    assert all(x["slack"] < 1e-8 for x in optimizer.line_weights(r, w, "t0", (0.0, 0.5)).collect())
    assert all(x["risk_pct"] == pytest.approx(25) for x in optimizer.equal_risk(r, w, "t0").collect())
    assert optimizer.variants(r, w.limit(2), "t0").count() == 0


def test_distributions_match_tables(spark):
    from skeinrisk.functions import distributions as ds

    rows = [(x, nu) for x in (-30.0, -4.0, -1.3, -0.2, 0.0, 0.7, 2.5, 9.0) for nu in (1.0, 2.5, 4.0, 30.0, 400.0)]
    df = spark.createDataFrame(rows, "x double, nu double")
    x, nu = F.col("x"), F.col("nu")
    for r in df.select("x", "nu", ds.t_cdf(x, nu).alias("t"), ds.t_two_sided(x, nu).alias("p"), ds.normal_cdf(x).alias("n"), ds.chi2_tail(x).alias("c"), ds.log_gamma(nu).alias("g")).collect():
        assert r["t"] == pytest.approx(nm.t_cdf(r["x"], r["nu"]), rel=1e-9, abs=1e-13) and r["p"] == pytest.approx(2 * nm.t_cdf(-abs(r["x"]), r["nu"]), rel=1e-9, abs=1e-13)
        assert r["n"] == pytest.approx(nm.norm_cdf(r["x"]), rel=1e-10) and r["c"] == pytest.approx(nm.chi2_1_sf(r["x"]), rel=1e-10) and r["g"] == pytest.approx(math.lgamma(r["nu"]), rel=1e-10, abs=1e-10)
    rows = [(p, nu) for p in (1e-8, 0.01, 0.3, 0.5, 0.9, 0.999) for nu in (1.0, 3.3, 12.0, 200.0)]
    df = spark.createDataFrame([*rows, (0.0, 3.0), (1.0, 3.0), (None, 3.0)], "p double, nu double")
    for r in df.select("p", "nu", ds.t_quantile(F.col("p"), F.col("nu")).alias("t"), ds.normal_quantile(F.col("p")).alias("n")).collect():
        if r["p"] is None or r["p"] in (0.0, 1.0):
            assert r["t"] is None and r["n"] is None
        else:
            assert r["t"] == pytest.approx(nm.t_ppf(r["p"], r["nu"]), rel=1e-7, abs=1e-9) and r["n"] == pytest.approx(nm.normal.inv_cdf(r["p"]), rel=1e-8, abs=1e-12)


def test_points_are_computed_once_each_and_by_many_tasks(spark):
    from skeinrisk.functions import distributions as ds

    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 7 / 2).alias("x"), F.lit(4).alias("nu"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def task(_):
        from pyspark import TaskContext

        seen.add(1)
        return TaskContext.get().partitionId()

    got = ds.at_points(rows, ["x", "nu"], t=ds.t_cdf(F.col("x"), F.col("nu")), task=task("x")).collect()
    assert len(got) == 3000 and seen.value == 7 and len({r["task"] for r in got}) > 1
    assert all(r["t"] is None if r["x"] is None else r["t"] == pytest.approx(nm.t_cdf(r["x"], 4.0), rel=1e-9) for r in got)


def test_tails_of_copied_parts_cost_no_more_folds(spark, tmp_path):
    from skeinrisk.plans import catalogue

    part = spark.range(1010).select((F.col("id") % 101).alias("p_partkey"), F.lit(3).alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    out = catalogue.QUERIES["distribution_tails"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert len(rows) == 1010 and len(set(rows)) == 101
    assert "aggregate(" in plan and "aggregate(" not in plan[: plan.index("Join")]  # folds stand beneath the join only


def test_regression_by_sweeping(spark):
    from skeinrisk.functions import regression as rg

    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3)) * [1, 0.01, 5] + 0.3
    y = x @ [1.0, -20, 0.1] + rng.normal(size=80) * 0.1
    x = np.column_stack([x, x[:, 0] - x[:, 2]])  # the last depends on the others
    df = spark.createDataFrame([(*map(float, x[k]), float(y[k]), k % 3) for k in range(80)], "a double, b double, c double, d double, y double, part int")
    for names in ("abc", "abcd"):
        products = rg.products(F.col("y"), [F.col(n) for n in names])
        sums = df.groupBy("part").agg(*[F.sum(v).alias(k) for k, v in products.items()]).agg(*[F.sum(k).alias(k) for k in products])
        got = sums.select(rg.solved(len(names)).alias("f")).first()["f"]
        want = nm.ols(y, x[:, :3])
        assert got["b"][:4] == pytest.approx(want["b"].tolist(), rel=1e-8) and got["n"] == 80 and 1 - got["rss"] / got["tss"] == pytest.approx(want["r2"])
        assert names == "abc" or got["b"][4] == 0.0
        errors = [math.sqrt(got["rss"] / want["df"] * v) for v in got["v"][:4]]
        assert names == "abcd" or [b / e for b, e in zip(got["b"], errors)] == pytest.approx(want["t"].tolist(), rel=1e-7)


@pytest.mark.parametrize(("window", "step"), [(60, 20), (50, 20)])
def test_rolling_loadings_match_each_window_alone(spark, window, step):
    rng = np.random.default_rng(7)
    n = 190
    f, y = rng.normal(size=(n, 6)) * 0.01, rng.normal(size=n) * 0.01
    days = [DAY + dt.timedelta(k) for k in range(n)]
    factor = spark.createDataFrame([(days[k], *map(float, f[k]), 0.0001) for k in range(n)], "dt date, mkt double, smb double, hml double, rmw double, cma double, mom double, rf double")
    got = {(r["dt"], r["factor"]): (r["loading"], r["r2"]) for r in factors.rolling_loadings(series(spark, y), factor, window, step).collect()}
    want = {}
    for end in range(window, n, step):
        fit = nm.ols(y[end - window : end] - 0.0001, f[end - window : end])
        want |= {(days[end - 1], name): (fit["b"][k + 1], fit["r2"]) for k, name in enumerate(factors.FACTORS)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_p_values_need_no_python(spark):
    record = spark.createDataFrame([("p", 3.84, 1.0)], "portfolio string, kupiec_stat double, christoffersen_stat double")
    plan = models.recession_probability(models.backtest_tests(record).withColumn("spread", F.lit(1.0)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_risk_rows_hold_one_part_a_task(spark):
    """Null tickers and those of no part stay, as by left joins, and no operator of one part stands above another's."""
    from skeinrisk.operators import sections

    base = spark.createDataFrame([("A", 1.0), ("B", 2.0), (None, 3.0)], "ticker string, x double")
    one = spark.createDataFrame([("A", "up"), (None, "lost"), ("C", "lost")], "ticker string, y string")
    two = spark.createDataFrame([("B", None), ("A", float("nan"))], "ticker string, z double")
    got = {r["ticker"]: r for r in sections.stacked(base, one, two).collect()}
    assert got.keys() == {"A", "B", None} and list(got["A"].asDict()) == ["ticker", "x", "y", "z"]
    assert got["A"]["y"] == "up" and math.isnan(got["A"]["z"]) and (got[None]["x"], got[None]["y"], got["B"]["z"]) == (3.0, None, None)
    out = sections.risk_rows(series(spark, np.zeros(5)), spark.createDataFrame([("A", DAY, 1.0)], "ticker string, dt date, px double"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join") <= 1  # last_move's own


def test_deep_taxonomies_and_circles(spark):
    deep = [(f"c{k}", f"c{max(k - 1, 0)}") for k in range(65)] + [("side", "c3")]
    tree = spark.createDataFrame(deep, "class string, parent string")
    got = {(r["class"], r["ancestor"]): r["depth"] for r in scenarios.closure(tree).collect()}
    want = {(f"c{i}", f"c{j}"): i - j for i in range(65) for j in range(i + 1)} | {("side", f"c{j}"): 4 - j for j in range(4)} | {("side", "side"): 0}
    assert got == want
    with pytest.raises(ValueError, match="circle above a, b"):
        scenarios.closure(spark.createDataFrame([("a", "b"), ("b", "a"), ("r", "r")], "class string, parent string"))
