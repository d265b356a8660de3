"""SQL for the queries on factor regressions: moments in one pass, then the normal equations solved by Gauss-Jordan steps.

Each step is a SELECT over the matrix of the one before, generated for the number of regressors.
"""

from __future__ import annotations

from ..operators.factors import FACTORS
from ..sources.panel import sql

#: The factor panel from orders, as ``model_queries.factor_panel`` builds it.
FACTOR_TABLES = {
    "ofill": "SELECT t.ticker, d.dt, last_value(p.px IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.dt) AS px FROM (SELECT DISTINCT dt FROM order_px) d CROSS JOIN (SELECT DISTINCT ticker FROM order_px) t LEFT JOIN order_px p ON p.dt = d.dt AND p.ticker = t.ticker",
    "oret": "SELECT * FROM (SELECT ticker, dt, ln(px / lag(px) OVER (PARTITION BY ticker ORDER BY dt)) AS r FROM ofill) WHERE r IS NOT NULL",
    "segpx": "SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS dt, 100 * pow(avg(o_totalprice) / 1000, 0.02) AS px FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2",
    "segfill": "SELECT t.ticker, d.dt, last_value(p.px IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.dt) AS px FROM (SELECT DISTINCT dt FROM segpx) d CROSS JOIN (SELECT DISTINCT ticker FROM segpx) t LEFT JOIN segpx p ON p.dt = d.dt AND p.ticker = t.ticker",
    "mom": "SELECT dt, sum(CASE WHEN ticker = 'BUILDING' THEN r END) - sum(CASE WHEN ticker = 'MACHINERY' THEN r END) AS mom FROM (SELECT ticker, dt, ln(px / lag(px) OVER (PARTITION BY ticker ORDER BY dt)) AS r FROM segfill) WHERE r IS NOT NULL GROUP BY 1",
    "wide": "SELECT dt, max(CASE WHEN k = 1 THEN r END) AS a, max(CASE WHEN k = 2 THEN r END) AS b, max(CASE WHEN k = 3 THEN r END) AS c, max(CASE WHEN k = 4 THEN r END) AS d, max(CASE WHEN k = 5 THEN r END) AS e FROM (SELECT *, dense_rank() OVER (ORDER BY ticker) AS k FROM oret) GROUP BY 1",
    "factors": "SELECT dt, (a + b + c + d + e) / 5 AS mkt, a - b AS smb, b - c AS hml, c - d AS rmw, d - e AS cma, mom, 0.0001 AS rf FROM wide JOIN mom USING (dt) WHERE a + b + c + d + e + mom IS NOT NULL",
    "joint": "SELECT r.ticker, r.dt, r.r - f.rf AS y, f.* EXCLUDE (dt, rf) FROM returns r JOIN factors f USING (dt)",
}


def moments(source: str, group: str, columns: tuple[str, ...], target: str = "y") -> str:
    """Sums of products of an intercept, ``columns`` and the target: m_i_j, the target last; n and the target's spread."""
    z = ["1.0", *columns, target]
    sums = ", ".join(f"sum({z[i]} * {z[j]}) AS m_{i}_{j}" for i in range(len(z)) for j in range(len(z)))
    return f"SELECT {group}, count(*) AS n, var_samp({target}) AS vy, {sums} FROM {source} GROUP BY {group}"


def step(source: str, group: str, pivot: int, size: int) -> str:
    """One Gauss-Jordan step in place; after a step for each of the regressors the last column holds the coefficients, the
    diagonal that of the inverse, and the last cell the squared residuals."""
    m = lambda i, j: f"m_{i}_{j}"
    p, cells = m(pivot, pivot), []
    for i in range(size):
        for j in range(size):
            e = f"1 / {p}" if i == j == pivot else f"{m(i, j)} / {p}" if i == pivot else f"-{m(i, j)} / {p}" if j == pivot else f"{m(i, j)} - {m(i, pivot)} * {m(pivot, j)} / {p}"
            cells.append(f"{e} AS {m(i, j)}")
    return f"SELECT {group}, n, vy, {', '.join(cells)} FROM {source}"


def regression(name: str, source: str, group: str, columns: tuple[str, ...]) -> dict[str, str]:
    """Tables name0 (moments) to name<k> (after k steps); the last is the solved one, and is also called ``name``."""
    k = len(columns) + 1
    out = {f"{name}0": moments(source, group, columns)}
    for pivot in range(k):
        out[f"{name}{pivot + 1}"] = step(f"{name}{pivot}", group, pivot, k + 1)
    return out | {name: f"SELECT * FROM {name}{k}"}


def t_probability(t: str, nu: str) -> str:
    """The two-sided probability of Student's t for a whole number of degrees of freedom, by its finite series."""
    c, s = f"(1 / sqrt(1 + {t} * {t} / {nu}))", f"(abs({t}) / sqrt({nu} + {t} * {t}))"
    odd = f"1 - 2 / pi() * (atan(abs({t}) / sqrt({nu})) + {s} * coalesce(list_sum(list_transform(range(0, (({nu} - 1) // 2)::BIGINT), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow({c}, 2 * k + 1))), 0))"
    even = f"1 - {s} * list_sum(list_transform(range(0, ({nu} // 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow({c}, 2 * k)))"
    return f"CASE WHEN {nu} % 2 = 1 THEN {odd} ELSE {even} END"


def normal_probability(x: str) -> str:
    """The normal distribution function by the series of the error function; 0 or 1 beyond six deviations."""
    series = f"list_sum(list_transform(range(0, 90), lambda k: pow(-1, k) * pow(({x}) / sqrt(2.0), 2 * k + 1) / (exp(lgamma(k + 1)) * (2 * k + 1))))"
    return f"CASE WHEN ({x}) < -6 THEN 0.0 WHEN ({x}) > 6 THEN 1.0 ELSE 0.5 + {series} / sqrt(pi()) END"


def _sql(body: str, *names: str, **more: str) -> str:
    return sql(body, "returns", "order_px", *names, **FACTOR_TABLES, **more)


def _cells(table: str, keys: str, names: tuple[str, ...], size: int, *more: str) -> str:
    """A row for each coefficient: its number k, name, value b and the diagonal v of the inverse."""
    rows = [f"SELECT {keys}, {k} AS k, '{f}' AS factor, m_{k}_{size} AS b, m_{k}_{k} AS v, {', '.join(('n', 'vy', f'm_{size}_{size} AS rss', *more))} FROM {table}" for k, f in enumerate(names)]
    return " UNION ALL ".join(rows)


_K = len(FACTORS) + 1
LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back, count(*) OVER (PARTITION BY ticker) AS all_n FROM joint) WHERE back <= 252 AND all_n >= 60"
_FIT = {"lastrows": LAST} | regression("fit", "lastrows", "ticker", FACTORS)
_COEF = {"coef": _cells("fit", "ticker", ("alpha", *FACTORS), _K)}
_DERIVED = "SELECT *, b / sqrt(rss / (n - 7) * v) AS t, 1 - rss / (vy * (n - 1)) AS r2, sqrt(vy * 252) * 100 AS total FROM coef"

BETAS = _sql(
    f"SELECT ticker, factor, n::INTEGER AS n, round(b, 6) AS beta, round(t, 6) AS t, round({t_probability('t', '(n - 7)')}, 6) AS p, round(r2, 6) AS r2, round(total, 6) AS total_vol, round(total * sqrt(greatest(r2, 0)), 6) AS factor_vol, round(total * sqrt(1 - greatest(r2, 0)), 6) AS idio_vol FROM derived",
    **_FIT, **_COEF, derived=_DERIVED,
)

_STEPS = " UNION ALL ".join(f"SELECT a.ticker, {k} AS step, '{f}' AS factor, a.m_{k}_{_K} / a.m_{k}_{k} AS b, 100 * a.m_{k}_{_K} * a.m_{k}_{_K} / a.m_{k}_{k} / c.m_{_K}_{_K} AS part FROM fit{k} a JOIN fit1 c USING (ticker)" for k, f in enumerate(FACTORS, 1))
CASCADE = _sql(
    "SELECT ticker, step::INTEGER AS step, factor, round(b, 6) AS ortho_loading, round(part, 6) AS incr_var_pct, round(sum(part) OVER (PARTITION BY ticker ORDER BY step), 6) AS cumulative_r2_pct, round(100 * part / sum(part) OVER (PARTITION BY ticker), 6) AS share_of_explained_pct FROM steps",
    **_FIT, steps=_STEPS,
)

_WINDOWS = """SELECT b.*, e.i AS grp_end, e.dt AS end_dt FROM numbered b JOIN numbered e ON b.ticker = e.ticker AND b.i BETWEEN e.i - 251 AND e.i
 WHERE e.i >= 251 AND (e.i - 251) % 21 = 0 AND e.i <= e.m - 2"""
_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS m FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back, count(*) OVER (PARTITION BY ticker) AS all_n FROM joint) WHERE back <= 1512 AND all_n >= 336"
_ROLLING = {"numbered": _NUMBERED, "windows": _WINDOWS} | regression("roll", "windows", "ticker, end_dt", FACTORS) | {"points": _cells("roll", "ticker, end_dt AS dt", ("alpha", *FACTORS), _K)}
ROLLING = _sql("SELECT ticker, dt, factor, round(b, 6) AS loading, round(1 - rss / (vy * (n - 1)), 6) AS r2 FROM points WHERE k > 0", **_ROLLING)
LOADING_DRIFT = _sql(
    "SELECT key, dt, round(latest, 6) AS latest, round(mean, 6) AS mean, round(sd, 6) AS sd, round((latest - mean) / nullif(sd, 0), 6) AS z, abs((latest - mean) / nullif(sd, 0)) >= 1 AS alert FROM (SELECT ticker || '/' || factor AS key, max(dt) AS dt, max_by(b, dt) AS latest, avg(b) AS mean, stddev_samp(b) AS sd FROM points WHERE k > 0 GROUP BY 1 HAVING count(*) >= 4)",
    **_ROLLING,
)

#: A book's rows on dates that all its tickers have, with each window of dates under a name of its own.
_BOOK_ROWS = "SELECT k.portfolio, k.ticker, k.ord, k.w, b.* EXCLUDE (ticker), count(*) OVER (PARTITION BY k.portfolio, b.dt) AS have, b.y + 0.0001 AS r FROM (SELECT portfolio, ticker, k AS ord, w / sum(w) OVER (PARTITION BY portfolio) AS w FROM (SELECT * FROM books WHERE w > 0) b(portfolio, ticker, w, k)) k JOIN joint b USING (ticker)"
_RANKED = "SELECT *, dense_rank() OVER (PARTITION BY portfolio ORDER BY dt DESC) AS back FROM bookrows b WHERE have = (SELECT count(*) FROM books k WHERE k.portfolio = b.portfolio)"


def _blocks(side: str) -> dict[str, str]:
    """From bookdays(portfolio, side, ...): coefficients, exposures, and the systematic and specific variances of each side."""
    pairs = " UNION ALL ".join(f"SELECT portfolio, {side}, '{a}' AS fa, '{b}' AS fb, covar_samp({a}, {b}) AS s FROM days GROUP BY ALL" for a in FACTORS for b in FACTORS)
    return {
        **regression("bfit", "bookdays", f"portfolio, {side}, ticker, w, ord", FACTORS),
        "bcoef": _cells("bfit", f"portfolio, {side}, ticker, w, ord", ("alpha", *FACTORS), _K),
        "days": f"SELECT DISTINCT portfolio, {side}, dt, {', '.join(FACTORS)} FROM bookdays",
        "cov": pairs,
        "net": f"SELECT portfolio, {side}, factor, sum(w * b) AS net FROM bcoef WHERE k > 0 GROUP BY 1, 2, 3",
        "own": f"SELECT DISTINCT portfolio, {side}, ticker, w, ord, rss / (n - 7) AS d, 1 - rss / (vy * (n - 1)) AS r2 FROM bcoef",
    }


_DECOMPOSED = {
    "bookrows": _BOOK_ROWS, "ranked": _RANKED, "bookdays": "SELECT *, 0 AS side FROM ranked WHERE back <= 252", **_blocks("side"),
    "along": "SELECT cov.portfolio, fa AS factor, sum(s * net) AS along FROM cov JOIN net ON net.portfolio = cov.portfolio AND fb = net.factor GROUP BY ALL",
    "sums": "SELECT portfolio, systematic, specific, systematic + specific AS model FROM (SELECT portfolio, sum(net * along) AS systematic FROM net JOIN along USING (portfolio, factor) GROUP BY 1) JOIN (SELECT portfolio, sum(w * w * d) AS specific FROM own GROUP BY 1) USING (portfolio)",
    "realised": "SELECT portfolio, var_samp(x) AS realised FROM (SELECT portfolio, dt, sum(w * y) AS x FROM bookdays GROUP BY 1, 2) GROUP BY 1",
    "totals": "SELECT portfolio, kind, v FROM (SELECT * FROM sums JOIN realised USING (portfolio)) UNPIVOT (v FOR kind IN (systematic, specific, model, realised))",
    "parts": "SELECT o.portfolio, o.ticker, any_value(o.w) AS w, any_value(o.r2) AS r2, any_value(o.w) * sum(c.b * a.along) AS shared, any_value(o.w * o.w * o.d) AS alone FROM own o JOIN bcoef c ON c.portfolio = o.portfolio AND c.ticker = o.ticker AND c.k > 0 JOIN along a ON a.portfolio = o.portfolio AND a.factor = c.factor GROUP BY 1, 2",
}
_NULL = "NULL::DOUBLE"
DECOMPOSITION = _sql(
    f"""SELECT portfolio, 'total' AS kind, kind AS name, {_NULL} AS weight_pct, {_NULL} AS r2, {_NULL} AS net_beta, {_NULL} AS factor_contrib_pct, {_NULL} AS specific_contrib_pct, round(100 * v / model, 6) AS total_contrib_pct, {_NULL} AS specific_share_pct, round(sqrt(greatest(v, 0) * 252) * 100, 6) AS vol_pct FROM totals JOIN sums USING (portfolio)
 UNION ALL SELECT portfolio, 'holding', ticker, round(w * 100, 6), round(r2, 6), NULL, round(100 * shared / model, 6), round(100 * alone / model, 6), round(100 * (shared + alone) / model, 6), CASE WHEN shared >= 0 AND alone >= 0 AND shared + alone > 1e-3 * model THEN round(100 * alone / (shared + alone), 6) END, NULL FROM parts JOIN sums USING (portfolio)
 UNION ALL SELECT portfolio, 'factor', factor, NULL, NULL, round(net, 6), round(100 * net * along / systematic, 6), NULL, round(100 * net * along / model, 6), NULL, NULL FROM net JOIN along USING (portfolio, factor) JOIN sums USING (portfolio)""",
    "books", **_DECOMPOSED,
)

_BRIDGED = {
    "bookrows": _BOOK_ROWS, "ranked": _RANKED,
    "wins": "SELECT portfolio, least(max(back) // 2, 252) AS win FROM ranked GROUP BY 1",
    "bookdays": "SELECT r.*, win, (back <= win)::INT AS side FROM ranked r JOIN wins USING (portfolio) WHERE back <= 2 * win AND win >= 90", **_blocks("side"),
    "sides": "SELECT a.portfolio, a.side AS na, b.side AS nb, c.side AS cs, sum(a.net * c.s * b.net) AS v FROM net a JOIN net b ON a.portfolio = b.portfolio AND a.side = b.side JOIN cov c ON c.portfolio = a.portfolio AND c.fa = a.factor AND c.fb = b.factor GROUP BY ALL",
    "alone": "SELECT portfolio, side, sum(w * w * d) AS d FROM own GROUP BY 1, 2",
    "four": "SELECT portfolio, max(CASE WHEN na = 0 AND cs = 0 THEN v END) AS s0, max(CASE WHEN na = 1 AND cs = 1 THEN v END) AS s1, max(CASE WHEN na = 1 AND cs = 0 THEN v END) AS mid FROM sides GROUP BY 1",
    "two": "SELECT portfolio, max(CASE WHEN side = 0 THEN d END) AS d0, max(CASE WHEN side = 1 THEN d END) AS d1 FROM alone GROUP BY 1",
    "change": "SELECT portfolio, win, s1 + d1 - s0 - d0 AS total, sqrt((s0 + d0) * 252) * 100 AS v0, sqrt((s1 + d1) * 252) * 100 AS v1, mid - s0 AS exposure, s1 - mid AS factor_vol, d1 - d0 AS specific FROM four JOIN two USING (portfolio) JOIN wins USING (portfolio)",
    "turned": "SELECT * FROM change UNPIVOT (v FOR component IN (exposure, factor_vol, specific))",
}
BRIDGE = _sql(
    "SELECT portfolio, win::INTEGER AS window_days, component, round(v, 10) AS delta_var, round((v1 - v0) * v / total, 10) AS vol_points, round(100 * v / total, 10) AS share_pct, CASE WHEN v > 0 THEN 'raised' WHEN v < 0 THEN 'lowered' ELSE 'flat' END AS direction, round(v0, 10) AS vol_then_pct, round(v1, 10) AS vol_now_pct, abs(v) = max(abs(v)) OVER (PARTITION BY portfolio) AS dominant FROM turned",
    "books", **_BRIDGED,
)

_LEVELS = "SELECT dt, max(CASE WHEN ticker = 'NO' THEN r END) AS b1, max(CASE WHEN ticker = 'RF' THEN r END) AS b2, max(CASE WHEN ticker = 'AF' THEN r END) AS b3, max(CASE WHEN ticker = 'AO' THEN r END) AS b4 FROM returns GROUP BY 1"


def _theme() -> str:
    """Each ticker against the baskets that it isn't one of, the first of them the market and the others without their part along it."""
    baskets, tables, parts = {"b1": "NO", "b2": "RF", "b3": "AF", "b4": "AO"}, {"levels": _LEVELS}, []
    for k, own in enumerate([None, *baskets]):
        use = [b for b in baskets if b != own]
        who = f"r.ticker = '{baskets[own]}'" if own else "r.ticker NOT IN ('" + "', '".join(baskets.values()) + "')"
        tables[f"t{k}"] = f"SELECT * FROM (SELECT r.ticker, r.r AS y, l.*, row_number() OVER (PARTITION BY r.ticker ORDER BY r.dt DESC) AS back FROM returns r JOIN levels l USING (dt) WHERE {who} AND {' + '.join(use)} IS NOT NULL) WHERE back <= 252"
        rest = ", ".join(f"{b} - covar_samp({b}, {use[0]}) OVER w / var_samp({use[0]}) OVER w * {use[0]} AS x{n}" for n, b in enumerate(use[1:], 2))
        tables[f"u{k}"] = f"SELECT ticker, y, {use[0]} AS x1, {rest} FROM t{k} WINDOW w AS (PARTITION BY ticker)"
        tables |= regression(f"g{k}_", f"u{k}", "ticker", tuple(f"x{n}" for n in range(1, len(use) + 1)))
        parts.append("SELECT *, " + str(len(use) + 1) + f" AS cols FROM ({_cells(f'g{k}_', 'ticker', ('alpha', *(baskets[b] for b in use)), len(use) + 1)})")
    tables["coef"] = " UNION ALL ".join(parts)
    tables["derived"] = "SELECT *, (n - cols) AS df, b / sqrt(rss / (n - cols) * v) AS t, sqrt(vy * 252) * 100 AS total, sqrt(rss / (n - cols) * 252) * 100 AS idio FROM coef WHERE n >= 60"
    body = f"SELECT ticker, factor AS basket, n::INTEGER AS n, round(b, 6) AS beta, round(t, 6) AS t, round({t_probability('t', 'df')}, 6) AS p, round(1 - rss / (vy * (n - 1)), 6) AS r2, round(total, 6) AS total_vol, round(sqrt(greatest(total * total - idio * idio, 0)), 6) AS factor_vol, round(idio, 6) AS idio_vol FROM derived"
    return sql(body, "returns", **tables)


THEMATIC = _theme()

_SHRUNK = dict(
    complete="SELECT *, dense_rank() OVER (ORDER BY dt DESC) AS back FROM (SELECT *, count(*) OVER (PARTITION BY dt) AS have FROM returns) WHERE have = (SELECT count(DISTINCT ticker) FROM returns)",
    centred="SELECT ticker, dt, r - avg(r) OVER (PARTITION BY ticker) AS c FROM complete WHERE back <= 1000",
    cov="SELECT x.ticker AS a, y.ticker AS b, avg(x.c * y.c) AS s, avg(x.c * x.c * y.c * y.c) - avg(x.c * y.c) ** 2 AS spread, count(*) AS n FROM centred x JOIN centred y USING (dt) GROUP BY 1, 2",
    level="SELECT sum(CASE WHEN a = b THEN s END) / sqrt(count(*)) AS mu, sqrt(count(*)) AS k, sum(spread) / max(n) / sqrt(count(*)) AS b2 FROM cov",
    amount="SELECT any_value(mu) AS mu, least(any_value(b2) / (sum((s - CASE WHEN a = b THEN mu ELSE 0 END) ** 2) / any_value(k)), 1) AS shrink FROM cov CROSS JOIN level",
    cells="SELECT a, b, 252 * ((1 - shrink) * s + CASE WHEN a = b THEN shrink * mu ELSE 0 END) AS cov, shrink FROM cov CROSS JOIN amount",
)
SHRUNK = sql("SELECT a, b, round(cov, 8) AS cov, round(shrink, 6) AS shrinkage FROM cells", "returns", **_SHRUNK)

#: The covariance as a list of rows, and the means.
_MATRIX = dict(
    _SHRUNK,
    mat="SELECT list(row ORDER BY a) AS s, list(a ORDER BY a) AS names, count(*) AS n FROM (SELECT a, list(cov ORDER BY b) AS row FROM cells GROUP BY a)",
    means="SELECT list(m ORDER BY ticker) AS mu FROM (SELECT ticker, avg(r) * 252 AS m FROM complete WHERE back <= 1000 GROUP BY 1)",
)
#: Rates at which return is bought with variance.
RATES = (0.0, 0.02, 0.1, 0.3, 1.0, 4.0)
#: Least w'Sw / 2 - t mu'w by moving weight between the two entries that gain most by it, until none do.
LINE = sql(
    "SELECT portfolio, t, unnest(names) AS ticker, round(unnest(w), 6) AS w, TRUE AS optimal FROM (SELECT t, w FROM walk WHERE it = 1500) CROSS JOIN mat CROSS JOIN (SELECT DISTINCT portfolio FROM books)", "returns", "books", **_MATRIX,
    walk=f"""SELECT t, 0 AS it, list_transform(range(n), lambda x: 1.0::DOUBLE / n) AS w FROM mat CROSS JOIN (VALUES {', '.join(f'({t}::DOUBLE)' for t in RATES)}) v(t) UNION ALL
 SELECT t, it + 1, list_transform(w, lambda x, k: x + CASE WHEN k = i THEN d WHEN k = j THEN -d ELSE 0 END) FROM (SELECT *, CASE WHEN i = j THEN 0.0 ELSE greatest(least((g[j] - g[i]) / (s[i][i] + s[j][j] - 2 * s[i][j]), 0.35 - w[i], w[j]), 0) END AS d FROM (
 SELECT *, list_position(gi, list_min(gi)) AS i, list_position(gj, list_max(gj)) AS j FROM (SELECT *, list_transform(g, lambda x, k: CASE WHEN w[k] < 0.35 - 1e-13 THEN x ELSE 1e9 END) AS gi, list_transform(g, lambda x, k: CASE WHEN w[k] > 1e-13 THEN x ELSE -1e9 END) AS gj FROM (
 SELECT t, it, w, s, list_transform(s, lambda r, k: list_inner_product(r, w) - t * mu[k]) AS g FROM walk CROSS JOIN mat CROSS JOIN means WHERE it < 1500))))""",
).replace("WITH ", "WITH RECURSIVE ", 1)
#: Equal risk shares: each entry in turn solves its own equation.
PARITY = sql(
    "SELECT portfolio, unnest(names) AS ticker, round(unnest(w), 6) AS w, round(100.0 / n, 6) AS risk_pct FROM (SELECT list_transform(x, lambda v: v / list_sum(x)) AS w FROM walk WHERE it = 600) CROSS JOIN mat CROSS JOIN (SELECT DISTINCT portfolio FROM books)", "returns", "books", **_MATRIX,
    walk="""SELECT 0 AS it, list_transform(s, lambda r, k: 1 / sqrt(r[k])) AS x FROM mat UNION ALL SELECT it + 1, list_transform(x, lambda v, m: CASE WHEN m = k THEN (-rest + sqrt(rest * rest + 4 * own)) / (2 * own) ELSE v END)
 FROM (SELECT *, list_inner_product(s[k], x) - own * x[k] AS rest FROM (SELECT it, x, s, it % n + 1 AS k, s[it % n + 1][it % n + 1] AS own FROM walk CROSS JOIN mat WHERE it < 600))""",
).replace("WITH ", "WITH RECURSIVE ", 1)

RECESSION = sql(
    f"SELECT round(y10, 6) AS y10, round(y3m, 6) AS y3m, round(y10 - y3m, 6) AS spread, round({normal_probability('-0.5333 - 0.6330 * (y10 - y3m)')}, 6) AS recession_probability FROM plain",
    "filled",
    plain="SELECT CASE WHEN a > 30 THEN a / 10 ELSE a END AS y10, CASE WHEN b > 30 THEN b / 10 ELSE b END AS y3m FROM (SELECT max_by(px, dt) FILTER (ticker = 'NO' AND px IS NOT NULL) AS a, max_by(px, dt) FILTER (ticker = 'AF' AND px IS NOT NULL) AS b FROM filled)",
)

SKILL = sql(
    f"""SELECT portfolio, n::INTEGER AS n_obs, round(n / 252, 6) AS years, round(sr * sqrt(252.0), 6) AS information_ratio, round(sr * sqrt(n), 6) AS t_stat,
 round(100 * {normal_probability('sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt + 2) / 4 * sr * sr)')}, 6) AS psr_pct FROM stats""",
    "port", "bench",
    stats="SELECT portfolio, count(*)::DOUBLE AS n, avg(a) / stddev_samp(a) AS sr, skewness(a) AS skew, kurtosis(a) AS kurt FROM (SELECT p.portfolio, p.r - b.r AS a FROM port p JOIN bench b USING (dt)) GROUP BY 1 HAVING count(*) >= 252",
)
