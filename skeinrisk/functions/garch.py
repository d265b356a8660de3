"""GARCH(1,1) and GJR with unit-variance t innovations, many windows at once: likelihood, score and a quasi-Newton search.

The variance recursion h = u + beta * (h before) is a linear scan, and so is its adjoint, run backwards: lambda = (what the
likelihood gains by h) + beta * (lambda after). Every derivative of the likelihood is a sum of lambdas with what multiplies the
parameter, so a score costs two scans whatever the number of parameters. A scan doubles sums over 1, 2, 4, ... places and takes
log n steps over whole arrays.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

#: Smallest variance, places and decay of the backcast that starts the recursion, largest persistence, least degrees of freedom.
FLOOR, BACKCAST, DECAY, PERSISTENCE, LEAST_NU = 1e-12, 75, 0.94, 0.9995, 2.05
#: Starts of a cold search: location, variance, persistence, share of shocks, tail, share of leverage, all without bounds.
STARTS = np.array([[0.0, 0.0, 3.0, -2.5, 1.5, -1.0], [0.0, 0.0, 1.0, -1.0, 1.0, 0.0], [0.0, 0.0, 5.0, -3.5, 2.0, -1.0]])
ROUNDS, SCORE = 200, 1e-6
#: Bounds of the numbers searched over.
BOUNDS = np.array([50.0, 10.0, 30.0, 30.0, 6.0, 30.0])


class Parameters(NamedTuple):
    mu: np.ndarray
    omega: np.ndarray
    alpha: np.ndarray
    gamma: np.ndarray
    beta: np.ndarray
    nu: np.ndarray


def scan(u: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """out[:, t] = u[:, t] + factor * out[:, t - 1]."""
    out, power, places = u.copy(), factor[:, None].copy(), 1
    while places < out.shape[1]:
        out[:, places:] += power * out[:, :-places].copy()
        power, places = power * power, 2 * places
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after ten steps up."""
    shift = np.prod([x + k for k in range(10)], axis=0)
    y = x + 10
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(shift)


def digamma(x: np.ndarray) -> np.ndarray:
    y = x + 10
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - sum(1 / (x + k) for k in range(10))


def variances(r: np.ndarray, q: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(residuals, variances, next variance) of each row's recursion."""
    e = r - q.mu[:, None]
    square = e * e
    weight = DECAY ** np.arange(min(BACKCAST, r.shape[1]))
    first = square[:, : len(weight)] @ weight / weight.sum()
    hit = square * (q.alpha[:, None] + q.gamma[:, None] * (e < 0))
    h = scan(np.column_stack([first, q.omega[:, None] + hit]), q.beta)
    return e, h[:, :-1], h[:, -1]


def likelihood(r: np.ndarray, q: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood, its derivatives by mu, omega, alpha, gamma, beta and nu) of each row."""
    n = r.shape[1]
    e, h, _ = variances(r, q)
    free, h = h > FLOOR, np.maximum(h, FLOOR)
    nu, room = q.nu[:, None], q.nu - 2
    z = e * e / (h * room[:, None])
    logs = np.log1p(z)
    constant = log_gamma((q.nu + 1) / 2) - log_gamma(q.nu / 2) - 0.5 * np.log(math.pi * room)
    value = n * constant - 0.5 * np.log(h).sum(1) - (q.nu + 1) / 2 * logs.sum(1)
    pull = z / (1 + z)
    by_h = np.where(free, ((nu + 1) * pull - 1) / (2 * h), 0.0)
    adjoint = scan(by_h[:, ::-1], q.beta)[:, ::-1]
    later, before = adjoint[:, 1:], e[:, :-1]
    fall = before < 0
    load = q.alpha[:, None] + q.gamma[:, None] * fall
    weight = DECAY ** np.arange(min(BACKCAST, n))
    by_mu = ((nu + 1) * e / (h * room[:, None] * (1 + z))).sum(1) - 2 * (later * before * load).sum(1) - 2 * adjoint[:, 0] * (e[:, : len(weight)] @ weight) / weight.sum()
    square = later * before * before
    by_nu = n / 2 * (digamma((q.nu + 1) / 2) - digamma(q.nu / 2) - 1 / room) - 0.5 * logs.sum(1) + (q.nu + 1) / 2 / room * pull.sum(1)
    return value, np.stack([by_mu, later.sum(1), square.sum(1), (square * fall).sum(1), (later * h[:, :-1]).sum(1), by_nu], 1)


class Fit(NamedTuple):
    p: np.ndarray
    parameters: Parameters
    loss: np.ndarray
    score: np.ndarray
    sigma: np.ndarray
    residuals: np.ndarray


class Model:
    """The likelihood of windows (rows of returns in percent) over numbers without bounds, five or, with leverage, six a window."""

    def __init__(self, r: np.ndarray, leverage: bool):
        self.r, self.leverage, self.size = r, leverage, 6 if leverage else 5
        self.level, self.mean, self.scale = r.var(1) + 1e-12, r.mean(1), r.std(1) + 1e-12

    def rows(self, which: np.ndarray) -> Model:
        own = Model.__new__(Model)
        own.r, own.leverage, own.size = self.r[which], self.leverage, self.size
        own.level, own.mean, own.scale = self.level[which], self.mean[which], self.scale[which]
        return own

    def parameters(self, p: np.ndarray) -> tuple[Parameters, np.ndarray]:
        """The parameters, and their derivatives by p: (row, parameter, number)."""
        share = lambda x: 1 / (1 + np.exp(-x))
        up, tail = np.exp(p[:, 1]), np.exp(p[:, 4])
        a, b = share(p[:, 2]), share(p[:, 3])
        c = share(p[:, 5]) if self.leverage else np.zeros(len(p))
        keep, left = PERSISTENCE * a, 1 - b
        alpha, half = keep * b, keep * left * c
        q = Parameters(self.mean + self.scale * p[:, 0], self.level * up * (1 - keep), alpha, 2 * half, keep * left * (1 - c), LEAST_NU + tail)
        keep_a, b_b, c_c = keep * (1 - a), b * left, c * (1 - c)
        d = np.zeros((len(p), 6, self.size))
        d[:, 0, 0] = self.scale
        d[:, 1, 1], d[:, 1, 2] = q.omega, -self.level * up * keep_a
        d[:, 2, 2], d[:, 2, 3] = keep_a * b, keep * b_b
        d[:, 3, 2], d[:, 3, 3] = 2 * keep_a * left * c, -2 * keep * b_b * c
        d[:, 4, 2], d[:, 4, 3] = keep_a * left * (1 - c), -keep * b_b * (1 - c)
        d[:, 5, 4] = tail
        if self.leverage:
            d[:, 3, 5], d[:, 4, 5] = 2 * keep * left * c_c, -keep * left * c_c
        return q, d

    def loss(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(minus the log-likelihood, its gradient) at p."""
        q, d = self.parameters(p)
        value, by = likelihood(self.r, q)
        gradient = -(by[:, None, :] @ d)[:, 0]
        bad = ~(np.isfinite(value) & np.isfinite(gradient).all(1))
        return np.where(bad, 1e12, -value), np.where(bad[:, None], 0.0, gradient)

    def search(self, p: np.ndarray, rounds: int = ROUNDS, score: float = SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(p, loss, gradient) where each row's gradient is below ``score`` a return, or no step lowers its loss any more.

        BFGS with backtracking, all rows side by side; rows that have ended are taken out. A number at its bound stays there while
        its gradient points beyond, and counts as zero then.
        """
        k, bound = self.size, BOUNDS[: self.size]
        inward = lambda x, d: np.where((np.abs(x) >= bound) & (x * d < 0), 0.0, d)
        p = np.clip(p, -bound, bound)
        f, g = self.loss(p)
        g = inward(p, g)
        inverse = np.tile(np.eye(k), (len(p), 1, 1)) / np.maximum(1.0, np.abs(g).max(1))[:, None, None]
        fresh = np.ones(len(p), bool)
        open_ = np.flatnonzero(np.abs(g).max(1) > score * self.r.shape[1])
        for _ in range(rounds):
            if not len(open_):
                break
            own = self.rows(open_)
            step = -(inverse[open_] @ g[open_][:, :, None])[:, :, 0] * (g[open_] != 0)
            step *= np.minimum(1.0, 3.0 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
            slope = (step * g[open_]).sum(1)
            size, left = np.ones(len(open_)), np.arange(len(open_))
            new_p, new_f, new_g = p[open_].copy(), f[open_].copy(), g[open_].copy()
            for _ in range(25):
                at = np.clip(p[open_[left]] + size[left, None] * step[left], -bound, bound)
                value, gradient = (own if len(left) == len(open_) else own.rows(left)).loss(at)
                good = value <= f[open_[left]] + 1e-4 * size[left] * slope[left]
                took = left[good]
                new_p[took], new_f[took], new_g[took] = at[good], value[good], inward(at, gradient)[good]
                left = left[~good]
                if not len(left):
                    break
                size[left] *= 0.3
            moved, change = new_p - p[open_], new_g - g[open_]
            curve = (moved * change).sum(1)
            turn = np.flatnonzero(curve > 1e-12)
            if len(turn):
                s, y, rows = moved[turn], change[turn], open_[turn]
                rho = 1 / curve[turn]
                first = fresh[rows]
                if first.any():  # the size of the first curvature seen
                    inverse[rows[first]] = np.eye(k) * (curve[turn][first] / (y[first] ** 2).sum(1))[:, None, None]
                    fresh[rows] = False
                m = np.eye(k) - rho[:, None, None] * s[:, :, None] * y[:, None, :]
                inverse[rows] = m @ inverse[rows] @ m.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
            gain = f[open_] - new_f
            p[open_], f[open_], g[open_] = new_p, new_f, new_g
            stuck = np.zeros(len(open_), bool)
            stuck[left] = True
            again = stuck & ~fresh[open_]  # once more straight down before a row is given up
            inverse[open_[again]] = np.eye(k) / np.maximum(1.0, np.abs(new_g[again]).max(1))[:, None, None]
            fresh[open_[again]] = True
            ended = (np.abs(new_g).max(1) <= score * self.r.shape[1]) | (stuck & ~again) | (~stuck & (gain < 1e-12 * np.abs(new_f)))
            open_ = open_[~ended]
        return p, f, g


def fit(windows: np.ndarray, leverage: bool) -> Fit:
    """The fit of each row of ``windows`` (returns in percent): the best from all of STARTS."""
    model = Model(np.atleast_2d(windows), leverage)
    return _found(model, *_best(model, [np.tile(s[: model.size], (len(model.r), 1)) for s in STARTS]))


def _best(model: Model, starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [model.search(s) for s in starts]
    best, rows = np.argmin([x[1] for x in found], 0), np.arange(len(model.r))
    return tuple(np.stack([x[j] for x in found])[best, rows] for j in range(3))


def _found(model: Model, p: np.ndarray, f: np.ndarray, g: np.ndarray) -> Fit:
    q, _ = model.parameters(p)
    e, h, ahead = variances(model.r, q)
    return Fit(p, q, f, g, np.sqrt(ahead), e / np.sqrt(np.maximum(h, FLOOR)))


def fit_rolling(windows: np.ndarray, leverage: bool, stride: int = 16, sweeps: int = 3) -> Fit:
    """Fits of windows that follow each other: each ``stride``-th from all of STARTS, all others from the nearest of those.

    Then fits are carried from day to day: where the day before or after has numbers that suit a window better than its own do,
    the window is searched again from there.
    """
    model, n = Model(windows, leverage), len(windows)
    marks = np.arange(0, n, stride)
    p, f, g = model.search(fit(windows[marks], leverage).p[np.minimum((np.arange(n) + stride // 2) // stride, len(marks) - 1)])
    for _ in range(sweeps if n > 1 else 0):
        moved = False
        for near in (np.r_[0, np.arange(n - 1)], np.r_[np.arange(1, n), n - 1]):
            loss, _ = model.loss(p[near])
            rows = np.flatnonzero(loss < f - 1e-3)
            if len(rows):
                own = model.rows(rows).search(p[near][rows])
                better = own[1] < f[rows]
                for old, new in zip((p, f, g), own, strict=True):
                    old[rows[better]] = new[better]
                moved = True
        if not moved:
            break
    return _found(model, p, f, g)
