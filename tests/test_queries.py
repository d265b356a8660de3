"""Every query with SQL gives the rows that DuckDB gives; the others give so many rows, with keys and finite figures within bounds."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest

from skeinrisk.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.8g}"
    if isinstance(v, dt.datetime):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, tables, name):
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    out = con.execute(ORACLE_SQL[name])
    order = [c[0] for c in out.description]
    assert sorted(order) == columns
    want = sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in out.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or abs(float(x) - float(y)) <= 2e-6 * max(1, abs(float(y))), (a, b)


#: Queries without SQL: key columns, the number of rows at sf0.01, and bounds of columns.
SHAPES = {
    "var_es_garch": (["ticker"], 6, {"var_garch": (0, 100), "es_garch": (0, 100), "nu_garch": (2, 1000)}),
    "var_es_gjr": (["ticker"], 6, {"var_gjr": (0, 100), "es_gjr": (0, 100), "nu_gjr": (2, 1000)}),
    "var_es_evt": (["ticker"], 6, {"var_evt": (0, 100), "es_evt": (0, 100)}),
    "var_year_t": (["ticker"], 6, {"var_year": (0, 500), "es_year": (0, 1000)}),
    "asset_risk": (["ticker"], 6, {"var_hs": (0, 100), "var_garch": (0, 100), "mean_var": (0, 100), "model_spread": (0, 100)}),
    "portfolio_rows": (["portfolio"], 2, {"var_hs": (0, 100), "var_evt": (0, 100), "last_price": (0, 1e6)}),
    "benchmark_row": (["portfolio"], 1, {"var_hs": (0, 100), "var_gjr": (0, 100)}),
    "asset_table": (["portfolio", "ticker"], 12, {"w": (0, 1), "var_hs": (0, 100)}),
    "sector_view": ([], 1, {}),
    "garch_residuals": (["ticker", "dt"], None, {"residual": (-60, 60)}),
    "anomaly_view": (["ticker", "dt"], 6 * 504, {}),
    "backtest_evt": (["portfolio", "model"], 2, {"rate_pct": (0, 6), "kupiec_p": (0, 1)}),
    "backtest_garch": (["portfolio", "model"], 2, {"rate_pct": (0, 6), "kupiec_p": (0, 1)}),
    "backtest_gjr": (["portfolio", "model"], 2, {"rate_pct": (0, 6), "kupiec_p": (0, 1)}),
    "qmle_corr": (["dt"], None, {"corr_naive": (-1, 1), "corr_qmle": (-1, 1)}),
    "factor_ols": (["ticker", "factor"], 42, {"p": (0, 1), "boot_se": (0, 10), "r2": (0, 1)}),
    "skill_vs_luck": (["portfolio"], 2, {"p_luck": (0, 1), "psr_pct": (0, 100), "observed_percentile": (0, 100)}),
    "optimizer_variants": (["portfolio", "variant", "ticker"], 2 * 7 * 6, {"w": (0, 1), "vol_ann": (0, 100)}),
    "frontier": ([], None, {}),
    "portfolio_bundle": (["portfolio"], 2, {}),
}


def test_every_query_without_sql_has_a_shape():
    assert set(SHAPES) == set(QUERIES) - set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_query_has_its_rows_and_bounds(spark, name):
    keys, n, bounds = SHAPES[name]
    rows = [r.asDict() for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()]
    assert len(rows) == n if n else len(rows) > 5
    if keys:
        assert len({tuple(r[k] for k in keys) for r in rows}) == len(rows) and all(r[k] is not None for r in rows for k in keys)
    for c, (low, high) in bounds.items():
        values = [r[c] for r in rows if r[c] is not None]
        assert len(values) > 0.9 * len(rows) and all(math.isfinite(v) and low <= v <= high for v in values), c
    for r in rows:
        assert all(math.isfinite(v) for v in r.values() if isinstance(v, float))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80
