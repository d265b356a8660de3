"""Portfolio programmes solved exactly: the critical line of a quadratic programme over a capped simplex, and equal risk shares.

``critical_line`` gives all w(t) that minimise w'Sw / 2 - t c'w with entries in [0, cap] that sum to 1. They are piecewise linear
in t: between two corners the same entries are free and w = a + t b. The walk starts where t is so large that c alone decides,
and goes down; at each corner an entry reaches a bound or leaves it. Least variance (t = 0), every target of c'w, the greatest ratio
of c'w to volatility, and the least variance within a tracking error all lie on such a line.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np


class Stretch(NamedTuple):
    """w = a + t b for t from ``low`` to ``high``."""

    low: float
    high: float
    a: np.ndarray
    b: np.ndarray

    def at(self, t: float) -> np.ndarray:
        return self.a if t == 0 or not self.b.any() else self.a + t * self.b


def _solve(s: np.ndarray, c: np.ndarray, free: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, and the slacks of all entries as d0 + t d1) while ``free`` entries move and the others stay as in ``w``."""
    f, n = np.flatnonzero(free), len(w)
    held = np.where(free, 0.0, w)
    # unknowns: the free weights and the multiplier of the sum
    m = np.zeros((len(f) + 1, len(f) + 1))
    m[:-1, :-1], m[:-1, -1], m[-1, :-1] = s[np.ix_(f, f)], -1.0, 1.0
    x = np.linalg.solve(m, np.column_stack([np.r_[-(s @ held)[f], 1 - held.sum()], np.r_[c[f], 0.0]]))
    a, b = held.copy(), np.zeros(n)
    a[f], b[f] = x[:-1, 0], x[:-1, 1]
    return a, b, s @ a - x[-1, 0], s @ b - c - x[-1, 1]


def critical_line(s: np.ndarray, c: np.ndarray, cap: float) -> list[Stretch]:
    """The stretches from large t to 0, for a positive definite ``s`` and a cap of 1 / n or more."""
    n = len(c)
    c = c - np.sqrt(np.arange(n) + 2.0) * 1e-10 * max(float(np.abs(c).max()), float(np.abs(s).max()))  # tells ties apart
    order = np.argsort(-c, kind="stable")
    w, left = np.zeros(n), 1.0
    for k in order:
        w[k] = min(cap, left)
        left -= w[k]
        if left <= 1e-15:
            last = k
            break
    free = np.zeros(n, bool)
    free[last] = True
    t, out, moved = math.inf, [], -1
    for _ in range(20 * n * n + 20):
        a, b, d0, d1 = _solve(s, c, free, w)
        best, which = 0.0, None
        for i in range(n):
            if free[i]:
                if b[i] == 0:
                    continue
                hit = ((0.0 if b[i] > 0 else cap) - a[i]) / b[i]  # as t falls, entries with b > 0 fall
            else:
                if d1[i] == 0:
                    continue
                hit = -d0[i] / d1[i]
                # going down, the slack must get the wrong sign: below 0 at the lower bound, above 0 at the cap
                if (d1[i] > 0) != (w[i] < cap / 2):
                    continue
            # corners may coincide, but what has just moved doesn't move back at the same one
            if best < hit and (hit < t * (1 - 1e-9) if i == moved else hit <= t * (1 + 1e-9)):
                best, which = hit, i
        out.append(Stretch(min(best, t), t, a, b))
        if which is None:
            return out
        t, moved = min(best, t), which
        w = np.where(free, a + t * b, w)
        if free[which]:
            w[which] = 0.0 if b[which] > 0 else cap
            if free.sum() == 1:  # the only free entry is at its bound: the one whose slack turns next takes over
                free[which] = False
                with np.errstate(divide="ignore", invalid="ignore"):
                    turn = np.where(np.arange(n) == which, -np.inf, -d0 / d1)
                turn[~np.isfinite(turn) | (turn > t * (1 + 1e-9))] = -np.inf
                free[int(np.argmax(turn))] = True
                continue
        free[which] = not free[which]
    return out


def least_variance(s: np.ndarray, cap: float) -> np.ndarray:
    """At t = 0, whatever leads there: the variances do."""
    return np.clip(critical_line(s, -np.diag(s), cap)[-1].a, 0.0, cap)


def at_target(line: list[Stretch], c: np.ndarray, target: float) -> np.ndarray | None:
    """Least variance at c'w = target, from the least-variance point up; None beyond the greatest."""
    for x in line:
        lowest = float(c @ x.at(x.low))
        if math.isfinite(x.high) and target > float(c @ x.at(x.high)) + 1e-9:
            return None
        if target >= lowest - 1e-12:
            rise = float(c @ x.b)
            if not math.isfinite(x.high) and target > lowest + 1e-9:
                return None
            return x.at(max(x.low, (target - float(c @ x.a)) / rise)) if rise > 1e-15 else x.at(x.low)
    return line[-1].a


def best_ratio(s: np.ndarray, c: np.ndarray, cap: float) -> tuple[np.ndarray, float] | None:
    """(w, t) of the greatest c'w / sqrt(w'Sw); None where no c'w is above 0 (the line doesn't hold it then)."""
    worth, best = 0.0, None
    for x in critical_line(s, c, cap):
        c0, c1, q0, q1, q2 = c @ x.a, c @ x.b, x.a @ s @ x.a, x.a @ s @ x.b, x.b @ s @ x.b
        stops = [x.low] + ([x.high] if math.isfinite(x.high) else [])
        if abs(low := c1 * q1 - c0 * q2) > 1e-300 and x.low < (inner := (c0 * q1 - c1 * q0) / low) < x.high:
            stops.append(inner)
        for t in stops:
            w = x.at(t)
            ratio = float(c @ w) / math.sqrt(float(w @ s @ w))
            if ratio > worth:
                worth, best = ratio, (w, t)
    return best


def least_variance_near(s: np.ndarray, base: np.ndarray, cap: float, apart: float) -> tuple[np.ndarray, float] | None:
    """(w, t) of least variance among those whose difference from ``base`` has a volatility of ``apart`` at most; None where there are
    none.

    With c = S base the line leads from least variance to ``base`` itself at t = 1 (or what the cap leaves of it).
    """
    def gap(w: np.ndarray) -> float:
        return float((w - base) @ s @ (w - base)) - apart**2

    line = critical_line(s, s @ base, cap)
    for x in reversed(line):
        if x.low >= 1:
            return None
        high = min(x.high, 1.0)
        if gap(x.at(x.low)) <= 0:
            return x.at(x.low), x.low
        if gap(x.at(high)) <= 0:
            d = x.a - base
            q2, q1, q0 = float(x.b @ s @ x.b), float(d @ s @ x.b), float(d @ s @ d) - apart**2
            t = (-q1 - math.sqrt(max(q1 * q1 - q2 * q0, 0.0))) / q2
            t = min(max(t, x.low), high)
            return x.at(t), t
    return None


def equal_risk(s: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights with equal risk shares: the one least point of x'Sx / 2 - sum of log x, by Newton's exact step in one entry after the
    other, scaled to a sum of 1."""
    x = 1 / np.sqrt(np.diag(s))
    for _ in range(rounds):
        before = x.copy()
        for i in range(len(x)):
            rest = float(s[i] @ x) - s[i, i] * x[i]
            x[i] = (-rest + math.sqrt(rest * rest + 4 * s[i, i])) / (2 * s[i, i])
        if np.abs(x - before).max() <= 1e-14 * x.max():
            break
    return x / x.sum()


def slack(s: np.ndarray, c: np.ndarray, t: float, w: np.ndarray, cap: float) -> float:
    """How far w is from the conditions of the optimum: the largest spread of the gradient S w - t c that a transfer between two
    entries could still gain by, over the largest entry of S."""
    g = s @ w - t * c
    down, up = w > 1e-9, w < cap - 1e-9
    return max(0.0, float(g[down].max() - g[up].min())) / float(np.abs(s).max()) if down.any() and up.any() else 0.0
