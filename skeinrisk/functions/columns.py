"""Column expressions that the operators share."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 252
#: Normal quantile and density at the 1 % tail.
Z99 = NormalDist().inv_cdf(0.99)
PHI99 = NormalDist().pdf(NormalDist().inv_cdf(0.01))
CAP = 100.0


def cap(x: Column) -> Column:
    """Losses are per 100 of value, and no more than that."""
    return F.least(x, F.lit(CAP))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(a: Column, b: Column, over=None) -> Column:
    """Pearson correlation, null where a side doesn't vary (``corr`` raises there under ANSI rules)."""
    w = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return ratio(w(F.covar_samp(a, b)), F.nullif(w(F.stddev_samp(a)) * w(F.stddev_samp(b)), F.lit(0.0)))


def beta(y: Column, x: Column) -> Column:
    return ratio(F.covar_samp(y, x), F.nullif(F.var_samp(x), F.lit(0.0)))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null below 3 values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_excess_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null below 4 values."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def annual_return(r: Column) -> Column:
    return F.avg(r) * YEAR * 100


def annual_volatility(r: Column) -> Column:
    return F.stddev_samp(r) * math.sqrt(YEAR) * 100


def annual_ratio(r: Column) -> Column:
    """Mean over standard deviation, annualised: Sharpe on returns, information ratio on active returns."""
    return ratio(F.avg(r), F.nullif(F.stddev_samp(r), F.lit(0.0))) * math.sqrt(YEAR)


def tier(x: Column, steps: list[tuple[float, str]], other: str) -> Column:
    """The label of the first step that x reaches, steps from high to low."""
    out = F.lit(other)
    for least, label in reversed(steps):
        out = F.when(x >= least, F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


THEME_TIERS = [(0.35, "high"), (0.15, "moderate")]
CORRELATION_TIERS = [(0.6, "strong"), (0.3, "moderate")]
RISK_TIERS = [(0.75, "high"), (0.40, "elevated")]
EXCEPTION_TIERS = [(3.0, "high"), (1.5, "elevated")]
