from __future__ import annotations

import math

import numpy as np
import pytest

from skeinrisk.functions import garch
from skeinrisk.functions import numerics as nm
from skeinrisk.functions import quadratic
from skeinrisk.operators import optimizer


def test_quantile_tables():
    assert nm.t_ppf(0.01, 5) == pytest.approx(-3.3649300, abs=1e-6)
    assert nm.t_ppf(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)
    assert nm.chi2_1_sf(3.8414588) == pytest.approx(0.05, abs=1e-7)
    assert nm.normal.inv_cdf(0.99) == pytest.approx(2.3263479, abs=1e-6)
    assert nm.t_cdf(nm.t_ppf(0.2, 3.3), 3.3) == pytest.approx(0.2, abs=1e-10)
    assert nm.t_two_sided(2.2281389, 10) == pytest.approx(0.05, abs=1e-6)


def test_t_var_es_tends_to_normal():
    assert nm.standardised_t_var_es(0.01, 0.01, 1e4)[0] == pytest.approx(nm.standardised_t_var_es(0.01, 0.01, math.inf)[0], rel=1e-3)
    var, es = nm.standardised_t_var_es(0.01, 0.01, 4)
    assert es > var > 0


def test_t_fit_recovers():
    x = np.random.default_rng(1).standard_t(4, 5000) * 0.01
    nu, loc, scale = nm.fit_t(x)
    assert nu == pytest.approx(4, rel=0.15) and abs(loc) < 5e-4 and scale == pytest.approx(0.01, rel=0.05)


def test_gpd_fit_recovers():
    u = np.random.default_rng(2).random(20_000)
    xi, beta = nm.fit_gpd(((1 - u) ** -0.2 - 1) / 0.2)
    assert xi == pytest.approx(0.2, abs=0.03) and beta == pytest.approx(1, abs=0.03)


@pytest.mark.parametrize("gamma", [0.0, 0.1])
def test_garch_fit_recovers(gamma):
    rng, n = np.random.default_rng(3), 4000
    h = 0.05 / (1 - 0.07 - gamma / 2 - 0.86)
    r = np.empty(n)
    for t in range(n):
        r[t] = math.sqrt(h) * rng.standard_t(6) * math.sqrt(4 / 6)
        h = 0.05 + (0.07 + gamma * (r[t] < 0)) * r[t] ** 2 + 0.86 * h
    f = garch.fit(r, True)
    q = f.parameters
    assert q.alpha[0] + q.gamma[0] / 2 + q.beta[0] < 1
    assert q.beta[0] == pytest.approx(0.86, abs=0.08) and q.gamma[0] == pytest.approx(gamma, abs=0.05)
    assert f.sigma[0] == pytest.approx(math.sqrt(h), rel=0.15) and q.nu[0] == pytest.approx(6, rel=0.35)


def plain_loss(r, q):
    """The likelihood by its definition, one return after the other."""
    weight = [garch.DECAY**k for k in range(min(garch.BACKCAST, len(r)))]
    h, total = sum(w * (x - q.mu) ** 2 for w, x in zip(weight, r, strict=False)) / sum(weight), 0.0
    for x in r:
        e = x - q.mu
        c = math.lgamma((q.nu + 1) / 2) - math.lgamma(q.nu / 2) - 0.5 * math.log(math.pi * (q.nu - 2) * h)
        total += c - (q.nu + 1) / 2 * math.log1p(e * e / (h * (q.nu - 2)))
        h = q.omega + (q.alpha + q.gamma * (e < 0)) * e * e + q.beta * h
    return -total


@pytest.mark.parametrize("leverage, n", [(False, 40), (True, 300)])
def test_likelihood_and_score(leverage, n):
    rng = np.random.default_rng(11)
    m = garch.Model(rng.standard_t(5, (4, n)), leverage)
    p = rng.normal(size=(4, m.size)) + garch.STARTS[0][: m.size]
    loss, score = m.loss(p)
    q, _ = m.parameters(p)
    assert loss == pytest.approx([plain_loss(m.r[k], garch.Parameters(*(x[k] for x in q))) for k in range(4)], rel=1e-10)
    steps = np.eye(m.size) * 1e-5
    apart = np.stack([(m.loss(p + s)[0] - m.loss(p - s)[0]) / 2e-5 for s in steps], 1)
    assert score == pytest.approx(apart, rel=1e-5, abs=1e-5)


def test_gamma_functions():
    x = np.array([0.3, 1.0, 2.5, 40.0, 300.0])
    assert garch.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    assert garch.digamma(np.array([1.0, 4.5])) == pytest.approx([-0.5772156649015329, 1.3888709263595289], abs=1e-10)


@pytest.mark.parametrize("leverage", [False, True])
def test_fits_end_where_the_score_is_nil_and_no_simplex_goes_lower(leverage):
    rng = np.random.default_rng(12)
    r = np.stack([rng.standard_t(5, 600), rng.normal(size=600) * (1 + np.arange(600) / 300), np.round(rng.normal(size=600), 1)])
    f = garch.fit(r, leverage)
    assert np.abs(f.score).max() <= 10 * garch.SCORE * 600
    m = garch.Model(r, leverage)
    for start in garch.STARTS:
        _, value = nm.nelder_mead(lambda p: m.loss(np.clip(p, -garch.BOUNDS[: m.size], garch.BOUNDS[: m.size]))[0], np.tile(start[: m.size], (3, 1)), 0.5, 400)
        assert (f.loss <= value + 1e-4 * np.abs(value)).all()


def test_odd_windows_end():
    r = np.stack([np.zeros(300), np.r_[np.zeros(299), 5.0], np.tile([1.0, -1.0], 150)])
    f = garch.fit(r, True)
    assert np.isfinite(f.loss).all()


def test_rolling_fits_are_no_worse_than_alone():
    r = np.random.default_rng(4).standard_t(5, 700)
    w = np.lib.stride_tricks.sliding_window_view(r, 600)[:100]
    both, alone = garch.fit_rolling(w, False), garch.fit(w[::9], False)
    assert (both.loss[::9] <= alone.loss + 0.02).all() and np.abs(both.score).max() <= 10 * garch.SCORE * 600


def plain_ma1(x, theta):
    """Innovations one after the other."""
    v, u, total, logs = 1 + theta * theta, x[0], 0.0, 0.0
    for k in range(len(x)):
        if k:
            gain = theta / v
            v, u = 1 + theta * theta - theta * gain, x[k] - gain * u
        total, logs = total + u * u / v, logs + math.log(v)
    return len(x) * math.log(total / len(x)) + logs, total / len(x)


def test_ma1_likelihood_of_many_series():
    rng = np.random.default_rng(15)
    series = [rng.normal(size=k) for k in (7, 40, 23)]
    x = np.zeros((3, 40))
    for k, own in enumerate(series):
        x[k, : len(own)] = own
    thetas = np.array([-0.95, -0.3, 0.0, 0.6, 0.9999])
    loss, variance = nm.ma1_loss(x, np.array([7, 40, 23]), np.tile(thetas, (3, 1)))
    for k, own in enumerate(series):
        want = [plain_ma1(own, t) for t in thetas]
        assert loss[k] == pytest.approx([w[0] for w in want], rel=1e-10) and variance[k] == pytest.approx([w[1] for w in want], rel=1e-10)


@pytest.mark.parametrize("theta", [-0.3, 0.3])
def test_ma1_and_integrated_variance(theta):
    e = np.random.default_rng(5).normal(size=4001)
    x = e[1:] + theta * e[:-1]
    assert nm.fit_ma1([x, x[:500]])[0][0] == pytest.approx(theta, abs=0.05)
    (iv, how), (rv, short) = nm.integrated_variances([x, x[:4]])
    assert how == ("qmle" if theta < 0 else "rv") and short == "rv" and rv == pytest.approx(float(x[:4] @ x[:4]))
    assert iv == pytest.approx(4000 * (1 + theta) ** 2 if theta < 0 else float(x @ x), rel=0.15)


def test_evt_is_monotone_and_capped():
    r = np.random.default_rng(6).standard_t(4, 1000) * 0.01
    var, es = nm.var_es_evt(r)
    assert 0 < var < es <= 100 and nm.var_es_evt(r, 0.001)[0] > var


def test_ols_and_gram_schmidt_agree():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(300, 4)), rng.normal(size=300)
    q = nm.gram_schmidt(x)
    assert abs(q.T @ q - np.diag(np.diag(q.T @ q))).max() < 1e-10
    c = y - y.mean()
    assert float((((q.T @ c) ** 2) / (q * q).sum(0)).sum() / (c @ c)) == pytest.approx(nm.ols(y, x)["r2"], abs=1e-12)


def covariance(rng, n, rows=60):
    return np.cov((rng.normal(size=(rows, n)) * rng.uniform(0.3, 2, n) + rng.normal(size=(rows, 1))).T)


def by_transfers(s, c, t, cap):
    """The same optimum by moving weight between the two entries that gain most, until none do."""
    w = np.full(len(c), 1 / len(c))
    for _ in range(20_000):
        g = s @ w - t * c
        i = min((k for k in range(len(c)) if w[k] < cap - 1e-15), key=lambda k: g[k])
        j = max((k for k in range(len(c)) if w[k] > 1e-15), key=lambda k: g[k])
        if g[j] - g[i] < 1e-15:
            break
        d = min((g[j] - g[i]) / (s[i, i] + s[j, j] - 2 * s[i, j]), cap - w[i], w[j])
        w[i], w[j] = w[i] + d, w[j] - d
    return w


@pytest.mark.parametrize("ties", [False, True])
def test_critical_line_matches_transfers(ties):
    rng = np.random.default_rng(13)
    for _ in range(40):
        n = int(rng.integers(3, 12))
        s, c, cap = covariance(rng, n), rng.normal(size=n), max(0.35, 1.2 / n)
        line = quadratic.critical_line(s, np.round(c) if ties else c, cap)
        c = np.round(c) if ties else c
        assert line[-1].low == 0 and all(x.low == pytest.approx(y.high) for x, y in zip(line, line[1:]))
        for t in (0.0, 0.1, 0.5, 3.0, 50.0):
            w = next(x for x in line if x.low <= t <= x.high).at(t)
            assert w.sum() == pytest.approx(1) and w.min() > -1e-9 and w.max() < cap + 1e-9
            assert quadratic.slack(s, c, t, w, cap) < 1e-8 * (1 + t)
            assert w == pytest.approx(by_transfers(s, c, t, cap), abs=1e-5 * (1 + t))
        target = float(c @ line[-1].a) * 0.5 + float(c.max()) * 0.2
        if (w := quadratic.at_target(line, c, target)) is not None and target >= float(c @ line[-1].a):
            assert float(c @ w) == pytest.approx(target, abs=1e-7)
        assert quadratic.at_target(line, c, float(c.max()) + 1) is None


def test_ratios_distances_and_equal_risk():
    rng = np.random.default_rng(14)
    for _ in range(40):
        n = int(rng.integers(3, 10))
        s, c, cap = covariance(rng, n), rng.normal(size=n), max(0.35, 1.2 / n)
        ratio = lambda w: float(c @ w) / math.sqrt(float(w @ s @ w))  # noqa: B023, E731
        base = nm.to_box(rng.random(n), 0, cap)
        near, _ = quadratic.least_variance_near(s, base, cap, 0.1)
        assert (near - base) @ s @ (near - base) <= 0.01 + 1e-9
        best = quadratic.best_ratio(s, c, cap)
        for _ in range(60):
            v = nm.to_box(near + rng.normal(size=n) * rng.choice([0.01, 0.2]), 0, cap)
            assert best is None or ratio(v) <= ratio(best[0]) + 1e-9
            assert (v - base) @ s @ (v - base) > 0.01 or v @ s @ v >= near @ s @ near - 1e-9
        share = (w := quadratic.equal_risk(s)) * (s @ w)
        assert w.sum() == pytest.approx(1) and share.max() / share.min() == pytest.approx(1)


@pytest.fixture()
def market():
    rng = np.random.default_rng(9)
    r = rng.normal(size=(1000, 6)) @ np.diag([1, 0.5, 2, 1.5, 0.8, 1.2]) * 0.01 + rng.normal(size=(1000, 1)) * 0.005
    return np.cov(r.T) * 252, r.mean(0) * 252, np.array([0.3, 0.2, 0.15, 0.15, 0.1, 0.1])


@pytest.mark.parametrize("objective", optimizer.OBJECTIVES)
def test_objectives_keep_their_constraints(market, objective):
    s, mu, w0 = market
    w, slack = optimizer.solve(objective, s, mu, w0)
    assert slack is None or slack < 1e-8
    assert w.sum() == pytest.approx(1) and w.min() >= -1e-12 and w.max() <= optimizer.CAPS[objective] + 1e-9
    te = math.sqrt((w - w0) @ s @ (w - w0))
    assert te <= optimizer.TE_CAPS.get(objective, 10) * 1.01
    if objective == "erc":
        rc = w * (s @ w)
        assert rc.max() / rc.min() < 1.02
    if objective == "gmv":
        rng = np.random.default_rng(1)
        assert all(w @ s @ w <= v @ s @ v + 1e-9 for v in (nm.to_box(rng.random(6), 0, 0.35) for _ in range(200)))
    if objective == "concentrated":
        assert w @ w > w0 @ w0
