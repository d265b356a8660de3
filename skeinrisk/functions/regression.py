"""Least squares as column expressions: sums of products, and their normal equations solved by sweeping.

Sums of products add up, so a regression's rows can be anywhere, and windows that overlap share their parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot below this part of its sum of squares is taken for none: the column depends on those before it, and gets no weight.
NO_PIVOT = 1e-12


def products(y: Column, x: list[Column]) -> dict[str, Column]:
    """The products whose sums a regression with an intercept needs, by name p_i_j; 0 is the intercept and the last is y."""
    z = [F.lit(1.0), *[c.cast("double") for c in x], y.cast("double")]
    return {f"p_{i}_{j}": z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))}


def solved(n_x: int, sums: str = "p_{}_{}") -> Column:
    """A struct from columns of summed products: b (intercept first), v (diagonal of the inverse), rss, tss, n."""
    size = n_x + 2
    cell = lambda i, j: F.col(sums.format(min(i, j), max(i, j)))
    whole = F.array(*[F.array(*[cell(i, j) for j in range(size)]) for i in range(size)])

    def sweep(m: Column, k: Column) -> Column:
        d = F.get(F.get(m, k), k)

        def row(own: Column, i: Column) -> Column:
            def value(x: Column, j: Column) -> Column:
                across = F.get(F.get(m, k), j)
                return F.when((i == k) & (j == k), 1 / d).when(i == k, x / d).when(j == k, -x / d).otherwise(x - F.get(own, k) * across / d)

            return F.transform(own, value)

        none = F.transform(m, lambda own, i: F.transform(own, lambda x, j: F.when((i == k) | (j == k), 0.0).otherwise(x)))
        return F.when(d > NO_PIVOT * F.get(F.get(whole, k), k), F.transform(m, row)).otherwise(none)

    def answer(m: Column) -> Column:
        at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
        return F.struct(
            F.array(*[at(i, size - 1) for i in range(n_x + 1)]).alias("b"), F.array(*[at(i, i) for i in range(n_x + 1)]).alias("v"),
            F.greatest(at(size - 1, size - 1), F.lit(0.0)).alias("rss"),
        )

    fit = F.aggregate(F.sequence(F.lit(0), F.lit(n_x)), whole, sweep, answer)
    tss = cell(size - 1, size - 1) - cell(0, size - 1) * cell(0, size - 1) / cell(0, 0)
    return F.struct(fit["b"].alias("b"), fit["v"].alias("v"), fit["rss"].alias("rss"), tss.alias("tss"), cell(0, 0).cast("int").alias("n"))
