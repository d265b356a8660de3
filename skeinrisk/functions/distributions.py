"""Distribution functions as column expressions: error function, normal, chi-squared and Student's t, with quantiles.

Series and continued fractions are folds over a fixed number of terms, so they run where the rows are, without Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.panel import spread

#: Terms of the error function's series and fraction and where one takes over from the other; terms of the beta's fraction; halvings
#: and Newton's steps of a quantile.
SERIES, FRACTION, SWITCH, BETA, HALVINGS, NEWTON = 50, 60, 2.0, 120, 12, 5


def fold(steps: int, start: Column, step, down: bool = False) -> Column:
    """``step(acc, k)`` from ``start`` over k = 1 to ``steps``, or from ``steps`` down."""
    ks = F.sequence(F.lit(steps), F.lit(1), F.lit(-1)) if down else F.sequence(F.lit(1), F.lit(steps))
    return F.aggregate(ks, start, step)


def bound(x: Column, body) -> Column:
    """``body(x)`` with x computed once: within folds a column would be computed at each step."""
    return F.transform(F.array(x.cast("double")), body)[0]


def at_points(rows: DataFrame, points: list[str], **values: Column) -> DataFrame:
    """``rows`` with columns that are functions of ``points`` alone, each different point computed once.

    A fold costs a third of a millisecond and more, so points are dealt out over tasks by their number, not by their bytes; by their
    hash, because an exchange by the points themselves would be taken for that of the distinct ones. Null is a point like any other.
    """
    told = spread(rows.select(*points).distinct(), F.xxhash64(*points)).select(*[F.col(c).alias(f"_{c}") for c in points], *[v.alias(k) for k, v in values.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in points]
    return rows.join(told, same, "left").drop(*[f"_{c}" for c in points])


def erfc(x: Column) -> Column:
    """The complementary error function; null for null."""

    def body(x: Column) -> Column:
        a = F.abs(x)
        # erf = 2 / sqrt(pi) exp(-a a) a (1 + 2 a a / 3 (1 + 2 a a / 5 (1 + ...))), all terms positive
        series = fold(SERIES, F.lit(1.0), lambda s, k: 1 + s * 2 * a * a / (2 * k + 1), down=True)
        inner = 1 - 2 / math.sqrt(math.pi) * F.exp(-a * a) * a * series
        # erfc = exp(-a a) / sqrt(pi) / (a + 1/2 / (a + 2/2 / (a + 3/2 / (a + ...))))
        fraction = fold(FRACTION, a, lambda f, k: a + k / (2 * f), down=True)
        outer = F.exp(-a * a) / math.sqrt(math.pi) / fraction
        tail = F.when(a < SWITCH, inner).otherwise(outer)
        return F.when(x < 0, 2 - tail).otherwise(tail)

    return bound(x, body)


def normal_cdf(x: Column) -> Column:
    return erfc(-x / math.sqrt(2)) / 2


def chi2_tail(x: Column) -> Column:
    """P(chi-squared with one degree of freedom > x); 1 below 0."""
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def log_gamma(x: Column) -> Column:
    """Stirling's series after ten steps up, for x above 0."""

    def body(x: Column) -> Column:
        shift = F.lit(1.0)
        for k in range(10):
            shift = shift * (x + k)
        y = x + 10
        return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - F.ln(shift)

    return bound(x, body)


def beta_cdf(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, for x from 0 to 1."""

    def side(p: Column, q: Column, z: Column) -> Column:
        """Where the fraction converges fast, z below (p + 1) / (p + q + 2)."""

        def step(f: Column, k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / f

        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(z) + q * F.log1p(-z))
        return F.when(z <= 0, 0.0).otherwise(front / p / fold(BETA, F.lit(1.0), step, down=True))

    def body(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        return F.when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), side(a, b, x)).otherwise(1 - side(b, a, 1 - x))

    return F.transform(F.array(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x"))), body)[0]


def _both(x: Column, nu: Column, body) -> Column:
    """``body(x, nu)`` with both computed once."""
    return F.transform(F.array(F.struct(x.cast("double").alias("x"), nu.cast("double").alias("nu"))), lambda v: body(v["x"], v["nu"]))[0]


def t_cdf(x: Column, nu: Column) -> Column:
    """Student's distribution function, for nu above 0."""

    def body(x: Column, nu: Column) -> Column:
        tail = beta_cdf(nu / 2, F.lit(0.5), nu / (nu + x * x)) / 2
        return F.when(x < 0, tail).otherwise(1 - tail)

    return _both(x, nu, body)


def t_pdf(x: Column, nu: Column) -> Column:
    return _both(x, nu, lambda x, nu: F.exp(log_gamma((nu + 1) / 2) - log_gamma(nu / 2) - F.ln(nu * math.pi) / 2 - (nu + 1) / 2 * F.log1p(x * x / nu)))


def t_two_sided(t: Column, df: Column) -> Column:
    """The probability of a larger absolute t."""
    return _both(t, df, lambda t, df: beta_cdf(df / 2, F.lit(0.5), df / (df + t * t)))


def _quantile(p: Column, cdf, pdf) -> Column:
    """On the side of the smaller tail: halving in u = x / (1 - x) for a start, then Newton's steps on the tail's logarithm, by x or, far
    out, by the logarithm of -x."""

    def body(p: Column) -> Column:
        small = F.least(p, 1 - p)

        def halve(acc: Column, _: Column) -> Column:
            middle = (acc["low"] + acc["high"]) / 2
            below = cdf(middle / (1 + middle)) < small
            return F.struct(F.when(below, middle).otherwise(acc["low"]).alias("low"), F.when(below, acc["high"]).otherwise(middle).alias("high"))

        def newton(x: Column, _: Column) -> Column:
            step = bound(cdf(x), lambda tail: (F.ln(tail) - F.ln(small)) * tail / pdf(x))
            return F.transform(F.array(step), lambda s: F.when(x < -1, x * F.exp(-s / x)).otherwise(x - s))[0]

        first = F.struct(F.lit(-1.0).alias("low"), F.lit(0.0).alias("high"))
        start = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), first, halve, lambda acc: acc["high"] / (1 + acc["high"]))
        x = fold(NEWTON, start, newton)
        return F.when((p > 0) & (p < 1), F.when(p == 0.5, 0.0).when(p < 0.5, x).otherwise(-x))

    return bound(p, body)


def normal_quantile(p: Column) -> Column:
    """Null outside of 0 to 1."""
    return _quantile(p, normal_cdf, lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi))


def t_quantile(p: Column, nu: Column) -> Column:
    """Null outside of 0 to 1."""
    return _quantile(p, lambda x: t_cdf(x, nu), lambda x: t_pdf(x, nu))
