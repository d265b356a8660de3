"""Queries that write files to the shared folder and read them again through the file sources, and composites of a whole book."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, backtest, correlation, factors, holdings, models, performance, portfolio, risk, scenarios, sections
from ..sources import config, files, panel, scratch, sinks
from ..sources.panel import MARKET, THEME, sql
from .book_queries import _BT, _HYPO, COUNTS, PAIRS, PERF, RANKED, REGIMES, STATS, TYPE_SHARES, book, hist_parts, hits, pairs, taxonomy, triples, type_funds
from .factor_sql import FACTOR_TABLES, normal_probability
from .model_queries import factor_panel
from .registry import query, rounded
from .risk_queries import order_returns

SMOOTH = "SELECT * FROM (SELECT dt, CASE WHEN count(vix) OVER w >= 20 THEN avg(vix) OVER w END AS vix FROM vix WINDOW w AS (ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE vix IS NOT NULL"


def _files(rows: DataFrame, key: str, make, kind: str) -> DataFrame:
    """(path, content): a file for each value of ``key``, made of its rows where they are; ``make`` takes them by rank and returns bytes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = re.sub(r"[^A-Za-z0-9]", "", str(pdf[key].iloc[0]))
        return pd.DataFrame([(f"{name}{kind}", make(pdf.sort_values("rank")))], columns=["path", "content"])

    return rows.groupBy(key).applyInPandas(run, files.FILES)


#: Holdings of each brand's fund, with the fund's name as its file's.
FUND_FILES = "SELECT replace(fund, '#', '') AS fund, * EXCLUDE (fund) FROM (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY weight DESC, security) AS rank FROM shares)"


@query(sql("SELECT fund, security AS name, symbol AS ticker, weight, DATE '2025-12-31' AS as_of FROM named", shares=TYPE_SHARES, named=FUND_FILES))
def csv_holdings(spark, d):
    """A file a fund with a title, a day-first date, a header and quoted names."""

    def make(pdf: pd.DataFrame) -> bytes:
        rows = [f'"{r.security}, Inc",{r.symbol},{r.weight:.4f},' for r in pdf.itertuples()]
        return "\n".join(["Fund holdings", '"As of 31/12/2025"', "Name,Ticker,Weighting (%),", *rows]).encode()

    rows = files.read_holdings(_files(type_funds(spark, d), "fund", make, ".csv")).where("error IS NULL")
    return rows.select("fund", F.regexp_replace("name", ", Inc$", "").alias("name"), "ticker", holdings.number(F.col("weight")).alias("weight"), "as_of")


def _disclosed(spark, d) -> DataFrame:
    """Funds as JSON documents, one each, written as text and read."""
    rows = type_funds(spark, d).withColumn("ticker", F.col("symbol")).withColumn("country", F.lit(None).cast("string"))
    one = rows.groupBy("fund").agg(F.sort_array(F.collect_list(F.struct("rank", "security", "ticker", "weight", "symbol", "country"))).alias("holdings"))
    whole = one.select(F.create_map("fund", F.struct(F.lit("2026-05-05").alias("as_of"), "holdings")).alias("funds"))
    path = scratch.new_path(spark, "json")
    whole.select(F.to_json(F.struct("funds")).alias("value")).write.text(path)
    return files.disclosures(spark.read.text(path))


@query(sql("SELECT fund, DATE '2026-05-05' AS as_of, security, symbol, weight, rank::INT AS rank FROM ranked", shares=TYPE_SHARES, ranked=RANKED))
def json_holdings(spark, d):
    return _disclosed(spark, d).select("fund", "as_of", "security", "symbol", "weight", "rank")


@query(sql("SELECT fund, rank::INT AS rank, security, symbol, weight FROM ranked", shares=TYPE_SHARES, ranked=RANKED))
def holdings_json(spark, d):
    """Holdings records as the JSON that a display reads, written and read again."""
    path = scratch.new_path(spark, "holdings")
    sinks.write_holdings(type_funds(spark, d).withColumn("ticker", F.col("symbol")).withColumn("country", F.lit(None).cast("string")), path)
    return spark.read.schema("fund string, holdings array<struct<rank: int, security: string, symbol: string, weight: double>>").json(path).select("fund", F.inline("holdings"))


@query(sql("SELECT b.portfolio, b.fund, n AS n_holdings, CASE WHEN n IS NOT NULL THEN DATE '2026-05-05' END AS as_of FROM (VALUES ('A', 'Brand#3'), ('B', 'NONE')) b(portfolio, fund) LEFT JOIN (SELECT fund, count(*) AS n FROM shares GROUP BY 1) USING (fund)", shares=TYPE_SHARES))
def books_with_disclosure(spark, d):
    books = spark.createDataFrame([("A", "Brand#3"), ("B", "NONE")], "portfolio string, fund string")
    shown = _disclosed(spark, d)
    return sections.with_disclosure(books, shown.groupBy("fund").agg(F.count("*").alias("n_holdings")), shown).select("portfolio", "fund", "n_holdings", "as_of")


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook: sheets of rows of texts and numbers."""
    cell = lambda ref, v: "" if v is None else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v!r}</v></c>'
    sheet = lambda own: f'<worksheet xmlns="{_SHEET}"><sheetData>' + "".join(f'<row r="{i}">' + "".join(cell(f"{c}{i}", v) for c, v in zip("ABC", row, strict=True)) + "</row>" for i, row in enumerate(own, 1)) + "</sheetData></worksheet>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SHEET}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{name}" r:id="r{k}"/>' for k, name in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, own in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{k}.xml", sheet(own))
    return data.getvalue()


@query(sql("SELECT fund, security AS name, symbol AS ticker, weight, DATE '2026-05-05' AS as_of FROM named", shares=TYPE_SHARES, named=FUND_FILES))
def xlsx_holdings(spark, d):
    """A workbook a fund, whose second sheet holds the holdings."""

    def make(pdf: pd.DataFrame) -> bytes:
        head = [["Fund", None, None], ["As of 05/05/2026", None, None], ["Security Name", "Ticker", "% of Net Assets"]]
        return _workbook({"Notes": [["nothing", None, None]], "Holdings": [*head, *[[r.security, r.symbol, float(r.weight)] for r in pdf.itertuples()]]})

    read = files.read_holdings(_files(type_funds(spark, d), "fund", make, ".xlsx")).where("error IS NULL")
    return read.select("fund", "name", "ticker", F.round(holdings.number(F.col("weight")), 4).alias("weight"), "as_of")


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


@query(sql("SELECT fund || '-Q1-2026' AS fund, security AS name, CASE WHEN security <> 'SMALL' THEN 'T' || security END AS ticker, round(v / sum(v) OVER (PARTITION BY fund) * 100, 6) AS weight, DATE '2026-03-31' AS as_of FROM (SELECT fund, security, round(weight * 10000) AS v FROM named)", shares=TYPE_SHARES, named=FUND_FILES))
def docx_holdings(spark, d):
    """A quarterly document a fund, without tickers and each holding in two lots; the quarter is in the file's name, and names map to
    tickers by a table that lacks one."""

    def make(pdf: pd.DataFrame) -> bytes:
        rows = [["Stocks 99%", "Shares", "Value"]]
        for r in pdf.itertuples():
            rows += [[f"{r.security} (a)", "1,000", f"${round(r.weight * 10000) - 1:,}"], [r.security, "10", "1"]]
        body = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in rows)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{_WORD}"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
        return data.getvalue()

    tickers = panel.table(spark, d, "part").where("p_type <> 'SMALL'").select(F.col("p_type").alias("name"), F.concat(F.lit("T"), "p_type").alias("ticker")).distinct()
    read = files.document_holdings(_files(type_funds(spark, d), "fund", make, "-Q1-2026.docx"), tickers)
    return rounded(read.select("fund", "name", "ticker", "weight", "as_of"))


@query("SELECT month, count(*)::INTEGER AS n_lines FROM (SELECT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem) GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
def latest_file(spark, d):
    """The last by name of files of each month's lines, and what it holds."""
    folder = scratch.new_path(spark, "months")
    rows = panel.table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.concat_ws(",", "l_orderkey", "l_linenumber").alias("value"))
    rows.repartition("month").write.partitionBy("month").text(folder)
    path = files.latest_file(spark, folder, "*.txt")
    month = F.regexp_extract("path", r"month=([^/]+)", 1)
    return files.lines(spark, path).where("line <> ''").groupBy(month.alias("month")).agg(F.count("*").cast("int").alias("n_lines"))


def _yaml(rows: DataFrame, key: str, make) -> DataFrame:
    return _files(rows, key, lambda pdf: yaml.safe_dump(make(pdf)).encode(), ".yaml")


@query(sql("SELECT fund AS portfolio, symbol AS ticker, round(weight / 100, 6) AS w FROM named WHERE fund <> 'Brand2'", shares=TYPE_SHARES, named=FUND_FILES))
def yaml_portfolios(spark, d):
    """Books as YAML files, one a fund with its benchmark; one book is hidden, one file is broken and stops no other."""

    def make(pdf: pd.DataFrame) -> dict:
        name = pdf["fund"].iloc[0].replace("#", "")
        own = {"id": name, "benchmark": "mark", "weights": dict(zip(pdf["symbol"], (float(w) for w in pdf["weight"] / 100), strict=True)), "visible": name != "Brand2"}
        return {"benchmarks": {"mark": {"weights": panel.BENCHMARK}}, "portfolios": [own]}

    broken = spark.createDataFrame([("broken.yaml", bytearray(b"portfolios: [{id: x}]"))], files.FILES)
    read = config.read_portfolios(_yaml(type_funds(spark, d), "fund", make).unionByName(broken)).where("error IS NULL")
    return rounded(read.select("portfolio", "ticker", "w"))


def _taxonomy(spark, d) -> DataFrame:
    rows = taxonomy(spark, d)["tree"].withColumn("rank", F.lit(0))
    return config.read_taxonomy(_yaml(rows, "parent", lambda pdf: {"classes": dict(zip(pdf["class"], pdf["parent"], strict=True))}))


@query(f"SELECT class, parent FROM ({_HYPO['tree']})")
def yaml_taxonomy(spark, d):
    """A YAML file of classes for each root."""
    return _taxonomy(spark, d).where("error IS NULL").select("class", "parent")


@query("""WITH years AS (SELECT year(l_shipdate) AS y, min(l_shipdate)::DATE AS a FROM lineitem GROUP BY 1)
 SELECT 'y' || y AS id, a::VARCHAR AS what, NULL::DOUBLE AS shock FROM years UNION ALL SELECT 'z' || y, n_name, round(-0.01 * n_nationkey, 6) FROM years JOIN nation ON n_regionkey = y % 5 WHERE y <> 1997""")
def yaml_scenarios(spark, d):
    """A YAML file a year, with its window and a region's shocks; that of one year shocks a class that no taxonomy has."""
    years = panel.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.min(F.to_date("l_shipdate")).alias("a"), F.max(F.to_date("l_shipdate")).alias("z"))
    rows = years.join(panel.table(spark, d, "nation"), F.col("n_regionkey") == F.col("y") % 5).withColumn("rank", F.col("n_nationkey"))

    def make(pdf: pd.DataFrame) -> dict:
        y = int(pdf["y"].iloc[0])
        shocks = {n: round(-0.01 * k, 6) for n, k in zip(pdf["n_name"], pdf["n_nationkey"].tolist(), strict=True)} | ({"MARS": -0.2} if y == 1997 else {})
        return {"historical": [{"id": f"y{y}", "start": pdf["a"].iloc[0], "end": pdf["z"].iloc[0]}], "hypothetical": [{"id": f"z{y}", "categories": shocks}]}

    read = config.read_scenarios(_yaml(rows, "y", make), _taxonomy(spark, d).select(F.col("class").alias("category")))
    good = read.where("error IS NULL")
    windows = good.where("start IS NOT NULL").select("id", F.col("start").cast("string").alias("what"), F.lit(None).cast("double").alias("shock"))
    return windows.unionByName(rounded(good.where("category IS NOT NULL").select("id", F.col("category").alias("what"), "shock")))


_DECIMALS = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in (*factors.FACTORS, "rf"))


@query(sql(f"SELECT dt, {_DECIMALS} FROM factors", "returns", "order_px", **{k: v for k, v in FACTOR_TABLES.items() if k != "joint"}))
def factor_files(spark, d):
    """Two factor files a year, a plain and a zipped one, with a preamble and a second block, in percent, made of the factor panel;
    in every second year the columns stand the other way round. Read, joined and cached."""
    table = factor_panel(spark, d).withColumn("year", F.year("dt")).withColumn("rank", F.col("dt"))

    def block(names: dict[str, str], pack) -> DataFrame:
        def make(pdf: pd.DataFrame) -> bytes:
            order = list(names) if pdf["year"].iloc[0] % 2 else list(names)[::-1]
            rows = [",".join([f"{r['dt']:%Y%m%d}", *[repr(float(r[names[n]]) * 100) for n in order]]) for r in pdf.to_dict("records")]
            lines = ["This file was made by a query.", "", "," + ",".join(order), *rows, "", " Annual factors", "," + ",".join(order), "1999,1.0"]
            return pack("\n".join(lines).encode())

        return _files(table, "year", make, ".csv")

    def zipped(text: bytes) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("factors.csv", text)
        return data.getvalue()

    def plain_lines(made: DataFrame) -> DataFrame:
        return made.select("path", F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("n", "line"))

    five = lambda: files.factor_block(plain_lines(block(files.FACTOR_NAMES, bytes)), "Mkt-RF", list(files.FACTOR_NAMES))
    momentum = lambda: files.factor_block(files.unzipped_lines(block({"Mom": "mom"}, zipped)), "Mom", ["Mom"])
    return rounded(files.cached_factors(spark, lambda: files.factors(five(), momentum()), scratch.new_path(spark, "factors")))


@query(sql("SELECT p_brand AS ticker, regexp_full_match(p_brand, '[A-Za-z0-9.^-]+') AS valid FROM (SELECT p_brand FROM part UNION SELECT replace(p_brand, '#', '-') FROM part)"))
def valid_tickers(spark, d):
    brands = panel.table(spark, d, "part").select(F.col("p_brand").alias("ticker"))
    both = brands.union(brands.select(F.replace("ticker", F.lit("#"), F.lit("-")))).distinct()
    return both.select("ticker", holdings.valid_ticker(F.col("ticker")).alias("valid"))


@query(sql("SELECT dt, round(vix, 6) AS vix FROM smooth", "vix", smooth=SMOOTH))
def smoothed_vix(spark, d):
    market = panel.returns(spark, d).where(F.col("ticker") == MARKET)
    return rounded(panel.smoothed_volatility(panel.volatility_index(market)))


@query(sql(
    "SELECT p.dt, round(v.vix, 6) AS vix FROM points p ASOF LEFT JOIN smooth v ON p.dt >= v.dt", "vix", "order_px", smooth=SMOOTH,
    oret="SELECT * FROM (SELECT ticker, dt, ln(px / lag(px) OVER (PARTITION BY ticker ORDER BY dt)) AS r FROM (SELECT t.ticker, d.dt, last_value(p.px IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.dt) AS px FROM (SELECT DISTINCT dt FROM order_px) d CROSS JOIN (SELECT DISTINCT ticker FROM order_px) t LEFT JOIN order_px p ON p.dt = d.dt AND p.ticker = t.ticker)) WHERE r IS NOT NULL",
    points="SELECT dt FROM (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM oret GROUP BY dt HAVING count(*) = 5) WHERE i >= 60 AND (i - 60) % 5 = 0",
))
def correlation_with_smoothed_vix(spark, d):
    """The dates of the correlation series with the smoothed index at or before each."""
    market = panel.returns(spark, d).where(F.col("ticker") == MARKET)
    points = correlation.average_pairwise(order_returns(spark, d)).select("dt")
    return rounded(asof.backward(points, panel.smoothed_volatility(panel.volatility_index(market)), "vix"))


@query(sql("SELECT portfolio, model, n::BIGINT AS n_eval, x::BIGINT AS exceptions, round(uc, 6) AS kupiec_stat FROM stats", "port", **_BT, counts=COUNTS, stats=STATS))
def backtests_with_cache(spark, d):
    """Fresh backtests of one model, and those of another from a cache that this query fills."""
    fresh = backtest.record(hits(spark, d).where("model = 'HS'"), ["portfolio", "model"])
    path = scratch.new_path(spark, "backtests")
    stored = sinks.cached(spark, lambda: backtest.record(hits(spark, d).where("model = 'EWMA'"), ["portfolio", "model"]), path)
    return rounded(backtest.with_cached(fresh, stored).select("portfolio", "model", "n_eval", "exceptions", "kupiec_stat"))


@query(sql("SELECT portfolio, dt, model, round(var, 6) AS var, v FROM hits WHERE model = 'HS'", "port", **_BT))
def forecasts_by_date(spark, d):
    """Forecasts kept by book, model and date: a first run up to one date, and a second one that adds the later dates only."""
    days = panel.weekdays(book(spark, d))
    store = sinks.DatedStore(spark, scratch.new_path(spark, "forecasts"), "portfolio string, model string, dt date, r double, var double")
    for upto in ("2000-12-31", "9999-12-31"):
        known = days.where(F.col("dt") <= F.lit(upto).cast("date"))
        store.update(lambda last, known=known: models.rolling_forecasts(known, "hs", last=last).withColumn("model", F.lit("HS")))
    return rounded(backtest.violations(store.read()).select("portfolio", "dt", "model", "var", "v"))


_P = "2 * (1 - ({}))"


@query(sql(f"SELECT portfolio, model, round({_P.format(normal_probability('sqrt(uc)'))}, 6) AS kupiec_p, CASE WHEN ind IS NOT NULL THEN round({_P.format(normal_probability('sqrt(greatest(ind, 0))'))}, 6) END AS christoffersen_p FROM stats", "port", **_BT, counts=COUNTS, stats=STATS))
def backtest_p_values(spark, d):
    tested = models.backtest_tests(backtest.record(hits(spark, d), ["portfolio", "model"]))
    return rounded(tested.select("portfolio", "model", "kupiec_p", "christoffersen_p"))


@query(sql(
    "SELECT h.*, m.sharpe, m.information_ratio, r.n AS n_regimes, round(s, 6) AS skill_ratio FROM head h JOIN perf m USING (portfolio) JOIN (SELECT portfolio, count(*)::INTEGER AS n FROM regimes GROUP BY 1) r USING (portfolio)", "port", "bench",
    pairs=PAIRS, perf=PERF, regimes=REGIMES,
    head="SELECT portfolio, count(*)::INTEGER AS n_obs, round(count(*) / 252, 6) AS years, min(dt) AS first_date, max(dt) AS last_date, avg(p - b) / stddev_samp(p - b) * sqrt(252.0) AS s FROM pairs GROUP BY 1 HAVING count(*) >= 252",
).replace("SELECT h.*,", "SELECT h.portfolio, h.n_obs, h.years, h.first_date, h.last_date,"))
def performance_skill(spark, d):
    out = sections.performance_skill(pairs(spark, d), draws=200)
    flat = out.select("portfolio", "n_obs", "years", "first_date", "last_date", "metrics.sharpe", "metrics.information_ratio", F.size("regime_alpha").alias("n_regimes"), F.col("skill_vs_luck.information_ratio").alias("skill_ratio"))
    return rounded(flat)


@query()
def portfolio_bundle(spark, d):
    """Everything about each book as one document a book."""
    filled = panel.fill(panel.prices(spark, d))
    r, w, f = panel.log_returns(filled), panel.weights(spark), factor_panel(spark, d)
    rows = sections.risk_rows(r, filled)
    totals = scenarios.totals(hist_parts(spark, d))
    return sections.bundle({
        "weights": w.select("portfolio", "ticker", "w"), "assets": sections.asset_table(w, rows, portfolio.component_var(r, w)), "total": sections.portfolio_rows(r, w), "scenarios": totals,
        "risk_history": risk.trajectory(book(spark, d)), "backtests": backtest.record(hits(spark, d), ["portfolio", "model"]), "decomposition": factors.decomposition(r, w, f),
        "bridge": factors.bridge(r, w, f), "performance": sections.performance_skill(pairs(spark, d)), "theme_now": performance.theme_now(triples(spark, d)), "direct_theme": performance.direct_weight(w, [THEME]),
    })
